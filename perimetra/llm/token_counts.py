"""Token counts with a digest cache.

Each text has a digest, each tokenizer has one of its model file. Digests join the stored counts; of those not yet
stored, one text each is encoded, and the new counts are appended. Copies and later runs cost no encoding.

Edge cases: null counts as the empty text, which is also the only normalisation, since any other would change counts;
rows without a doc_id and repeated rows each get their count; ties cannot arise; long texts are encoded whole; extra
columns are not carried.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perimetra.llm.common import map_texts, materialize, shared_dir

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
_CACHE = "tokenizer string, digest string, n_tokens long"
_loaded: dict[str, object] = {}


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _processor(path: str) -> object:
    if path not in _loaded:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            _loaded[path] = Tokenizer.from_file(path)
        else:
            import sentencepiece

            _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[path]


def _lengths(path: str, texts: list[str]) -> np.ndarray:
    tokenizer = _processor(path)
    if path.endswith(".json"):
        return np.array([len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)], np.int64)
    return np.array([len(ids) for ids in tokenizer.encode(texts, num_threads=1)], np.int64)


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def token_counts(docs: DataFrame, path: str | None = None, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    cache: folder of the stored counts, shared by all executors; a new one in the shared folder if None.
    """
    spark = docs.sparkSession
    path = path or model_path()
    version = tokenizer_digest(path)
    cache = cache or f"{shared_dir(spark)}/perimetra/token-cache-{uuid.uuid4().hex}"
    spark.createDataFrame([], _CACHE).write.mode("append").parquet(cache)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", "text", F.sha2(text, 256).alias("digest"))
    narrow = materialize(keyed.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), "digest"), "digests")
    stored = spark.read.schema(_CACHE).parquet(cache).filter(F.col("tokenizer") == version).select("digest", "n_tokens")
    missing = materialize(narrow.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(stored, "digest", "left_anti"), "misses")
    wanted = keyed.alias("k").join(missing.alias("m"), F.col("k.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("k.digest") == F.col("m.digest"))).select("k.digest", "k.text")

    def work(texts: list[str | None]) -> dict[str, object]:
        return {"n_tokens": _lengths(path, [t or "" for t in texts])}

    counted = map_texts(wanted, work, "n_tokens long", keep=("digest",)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    known = spark.read.schema(_CACHE).parquet(cache).filter(F.col("tokenizer") == version).select("digest", "n_tokens")
    # Written out, the join's two sides are plain shuffles, and Spark can split the partition of a hot digest.
    needed = narrow.select("digest").distinct()
    counts = materialize(known.join(needed, "digest", "left_semi").dropDuplicates(["digest"]), "counts")
    return narrow.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
