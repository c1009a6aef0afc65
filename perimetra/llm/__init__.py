"""Training-data operators: fixity, search, near duplicates, mixing, quality, codecs, media, shards, token counts,
secrets, whitening, hard negatives, exact duplicates.

Nothing else in the library imports this subpackage; it can be deleted with its tests.
"""
