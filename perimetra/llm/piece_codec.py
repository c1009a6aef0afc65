"""SentencePiece encoding and decoding with a batched numpy Viterbi.

Distinct words of a batch are grouped by length, and all words of one length advance together, character by character.
Rolling hashes of the substrings that begin at a position probe the sorted keys of the pieces (and of their beginnings,
so that hopeless rows drop out). For each end position a vectorised maximum keeps the best way there and its
backpointer.

For unigram models the best way is the one with the largest sum of scores. For BPE models, sums of scores would not give
the library's merges. There a way is open only if each two neighbouring pieces are what merging the two alone would
leave; one way is open to each end, and it is the merges' result. That test follows the merge histories of the two
pieces along their common border and is kept per pair of pieces. Words with runs of spaces, whose pieces tie, are merged
step by step instead.

Edge cases: null and empty texts have no ids; characters without a piece become byte pieces (or the unknown id if the
model has none); long words and texts are encoded whole; repeated rows and rows without a doc_id are kept; decoding
skips control ids, and ids out of range are an error; ties of scores go to the shorter last piece; extra columns are not
carried.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perimetra.llm.common import list_array, map_texts, mix

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
CACHE_WORDS = 600_000
SLICE_BYTES = 4_000_000
#: Words from this length on are cut where no piece can lie, and are looked at so many characters at once.
LONG_WORD, PART_CHARS = 48, 1 << 16
_STEP = np.uint64(0xD6E8FEB86659FD93)
_NEVER = float("-inf")
#: Stands for the piece before the first.
BORDER = 0xFFFFFFF
_RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_loaded: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """The codec of a model file, made once per process."""
    if path not in _loaded:
        _loaded[path] = PieceCodec(path)
    return _loaded[path]


class _Sorted:
    """Sorted 64-bit keys, evenly spread, with values. A probe begins where the key's leading bits do."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(8, int(len(keys)).bit_length() + 2))
        self.start = np.searchsorted(self.keys >> self.shift, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64)).astype(np.int32)
        self.depth = int(np.bincount((self.keys >> self.shift).astype(np.int64)).max()) if len(keys) else 0
        self.padded = np.concatenate((self.keys, np.zeros(self.depth + 1, np.uint64)))

    def probe(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and whether the key is there; the value of an absent key is any."""
        at = self.start[(key >> self.shift).astype(np.int64)]
        place = at.copy()
        hit = self.padded[at] == key
        for k in range(1, self.depth):
            more = self.padded[at + k] == key
            place[more] += k
            hit |= more
        if not len(self.keys):
            return np.zeros(len(key), np.int64), np.zeros(len(key), np.bool_)
        hit &= place < len(self.keys)
        place[~hit] = 0
        return self.values[place], hit


class PieceCodec:
    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with the identity normaliser and leading spaces are supported")
        kinds = {p.type for p in model.pieces}
        if 4 in kinds:
            raise ValueError("user-defined pieces are not supported")
        self.bpe = model.trainer_spec.model_type == 2
        self.dummy = spec.add_dummy_prefix
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = np.array([p.type for p in model.pieces])
        self.unknown = int(np.flatnonzero(self.kinds == 2)[0])
        self.byte_ids = np.zeros(256, np.int32)
        for i in np.flatnonzero(self.kinds == 6):
            self.byte_ids[int(self.pieces[i][1:-1], 16)] = i
        self.has_bytes = bool((self.kinds == 6).any())
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.id_of = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == 1}
        self.worst = min(self.score.values(), default=0.0) - 10.0
        self.histories: dict[int, tuple[list, list] | None] = {}
        self._sorted_keys()
        self.cache: dict[str, bytes] = {}
        raw = [self._bytes_of(i) for i in range(len(self.pieces))]
        self.out_first = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        self.out_bytes = np.frombuffer(b"".join(raw), np.uint8)

    def _bytes_of(self, i: int) -> bytes:
        if self.kinds[i] == 6:
            return bytes([int(self.pieces[i][1:-1], 16)])
        if self.kinds[i] == 2:
            return " ⁇ ".encode()
        return b"" if self.kinds[i] == 3 else self.pieces[i].replace(SPACE, " ").encode()

    # --- merging one string, step by step

    def merged(self, text: str, note: list | None = None) -> list[str]:
        """The pieces that merging leaves: best score first, leftmost of equals. note: gets (level, left, right, made) of each merge, as spans."""
        start = list(range(len(text)))
        end = [i + 1 for i in start]
        before, after = [i - 1 for i in start], [*range(1, len(text)), -1]
        alive = [True] * len(text)
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            s = self.score.get(text[start[a] : end[b]])
            if s is not None:
                heapq.heappush(heap, (-s, a, b, end[b]))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        level = float("inf")
        while heap:
            s, a, b, stop = heapq.heappop(heap)
            if not (alive[a] and alive[b] and after[a] == b and end[b] == stop):
                continue
            level = min(level, -s)
            if note is not None:
                note.append((level, (start[a], end[a]), (start[b], end[b])))
            end[a], alive[b], after[a] = end[b], False, after[b]
            if after[a] >= 0:
                before[after[a]] = a
                offer(a, after[a])
            if before[a] >= 0:
                offer(before[a], a)
        return [text[start[i] : end[i]] for i in range(len(text)) if alive[i]]

    def _history(self, piece: int) -> tuple[list, list] | None:
        """The symbols at the piece's left and right border in time, each with the level at which it was merged on; None if merging never makes the piece."""
        if piece not in self.histories:
            note: list = []
            text = self.pieces[piece]
            made = self.merged(text, note) == [text]
            left = [(text[a[0] : a[1]], level) for level, a, _ in note if a[0] == 0] + [(text, _NEVER)]
            right = [(text[b[0] : b[1]], level) for level, _, b in note if b[1] == len(text)] + [(text, _NEVER)]
            self.histories[piece] = (left, right) if made else None
        return self.histories[piece]

    def open_pair(self, one: int, two: int) -> bool:
        """Whether merging the two pieces' strings alone leaves just these two. one: BORDER where a word or a character without a piece ends, which merge with nothing."""
        begins = self._history(two)
        ends = self._history(one) if one != BORDER else None
        if begins is None or ends is None:
            return begins is not None
        right, left, i, j = ends[1], begins[0], 0, 0
        while True:
            (x, to_x), (y, to_y) = right[i], left[j]
            across = self.score.get(x + y, _NEVER)
            if across > to_x and across >= to_y:
                return across == _NEVER
            if to_x == _NEVER and to_y == _NEVER:
                return True
            if to_x >= to_y:
                i += 1
            else:
                j += 1

    # --- the batched Viterbi

    def _sorted_keys(self) -> None:
        """Sorted hashes of all pieces and of their beginnings; the piece's id, or -1 for a mere beginning."""
        ids: dict[str, int] = {}
        for piece, i in self.id_of.items():
            for k in range(1, len(piece)):
                ids.setdefault(piece[:k], -1)
        ids |= self.id_of
        alphabet = sorted({c for p in ids for c in p})
        mixed = dict(zip(alphabet, mix(np.array([ord(c) for c in alphabet], np.uint64) + np.uint64(1)).tolist(), strict=True))
        hashes: dict[str, int] = {"": 0}
        for text in sorted(ids, key=len):
            hashes[text] = (hashes[text[:-1]] * int(_STEP) + mixed[text[-1]]) & (2**64 - 1)
        keys = np.array([hashes[p] for p in ids], np.uint64)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        self.vocabulary = _Sorted(keys, np.array(list(ids.values()), np.int64))
        self.pairs = _Sorted(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.new_pairs: dict[int, bool] = {}
        self.longest = max(map(len, ids), default=1)
        self.inner = np.unique(np.array([(ord(a) << 32) | ord(b) for p in self.id_of for a, b in itertools.pairwise(p)] or [0], np.int64))

    def _pairs_open(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        pair = (one << 32) | two
        value, known = self.pairs.probe(pair.astype(np.uint64) * _STEP)  # odd factor: one to one
        if not known.all():
            new, at = np.unique(pair[~known], return_inverse=True)
            fresh = self.new_pairs
            found = []
            for k in new.tolist():
                if k not in fresh:
                    fresh[k] = self.open_pair(k >> 32, k & 0xFFFFFFFF)
                found.append(fresh[k])
            value[~known] = np.array(found, np.int64)[at]
            if len(fresh) > 20_000 + len(self.pairs.keys) // 2:  # now and then the new pairs join the sorted ones
                keys = np.array(list(fresh), np.int64).astype(np.uint64) * _STEP
                old = self.pairs if len(self.pairs.keys) < 4_000_000 else _Sorted(keys[:0], value[:0])  # memory stays bounded
                self.pairs = _Sorted(np.concatenate((old.keys, keys)), np.concatenate((old.values, np.array(list(fresh.values()), np.int64))))
                self.new_pairs = {}
        return value > 0

    def _advance(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """chars: words x length. For each end position, the id of the best way's last piece (-1: a character without one) and where that piece begins."""
        rows, n = chars.shape
        mixed = mix(chars.astype(np.uint64) + np.uint64(1))
        best = np.full((n + 1, rows), _NEVER)
        best[0] = 0
        last = np.full((n + 1, rows), -2, np.int64)
        back = np.full((n + 1, rows), -1, np.int64)
        for i in range(n):
            value = np.zeros(rows, np.uint64)
            live = np.arange(rows)
            for size in range(1, min(self.longest, n - i) + 1):
                value = value * _STEP + mixed[live, i + size - 1]
                found, hit = self.vocabulary.probe(value)
                if size == 1 and not hit.all():  # a character without a piece
                    lost = live[~hit]
                    gain = best[i, lost] + (0.0 if self.bpe else self.worst)
                    last[i + 1, lost], back[i + 1, lost], best[i + 1, lost] = -1, i, gain
                live, value, found = live[hit], value[hit], found[hit]
                if not len(live):
                    break
                full = found >= 0
                who, piece = live[full], found[full]
                if self.bpe:
                    came = last[i, who]
                    free = self._pairs_open(np.where(came < 0, BORDER, came), piece)
                    who, piece = who[free], piece[free]
                    gain = best[i, who]
                else:
                    gain = best[i, who] + self.piece_scores[piece]
                better = gain > best[i + size, who]
                who, piece = who[better], piece[better]
                best[i + size, who], last[i + size, who], back[i + size, who] = gain[better], piece, i
        return last, back

    @property
    def piece_scores(self) -> np.ndarray:
        if not hasattr(self, "_piece_scores"):
            self._piece_scores = np.array([self.score.get(p, 0.0) for p in self.pieces])
        return self._piece_scores

    def _spelled(self, char: str) -> list[int]:
        return self.byte_ids[list(char.encode())].tolist() if self.has_bytes else [self.unknown]

    def _by_merging(self, word: str) -> list[int]:
        out: list[int] = []
        for p in self.merged(word):
            out += [self.id_of[p]] if p in self.id_of else [i for c in p for i in self._spelled(c)]
        return out

    def _parts(self, word: str) -> list[str]:
        """The word cut between any two characters that stand side by side in no piece, which no piece and no merge can cross."""
        cuts = [0]
        for low in range(0, len(word) - 1, PART_CHARS):
            chars = np.frombuffer(word[low : low + PART_CHARS + 1].encode("utf-32-le"), np.uint32).astype(np.int64)
            pair = (chars[:-1] << 32) | chars[1:]
            known = self.inner[np.minimum(np.searchsorted(self.inner, pair), len(self.inner) - 1)] == pair
            cuts += (np.flatnonzero(~known) + low + 1).tolist()
        return [word[a:b] for a, b in itertools.pairwise([*cuts, len(word)])]

    def _encode_long(self, words: list[str]) -> list[bytes]:
        parts = [self._parts(w) for w in words]
        distinct = list(dict.fromkeys(p for own in parts for p in own))
        known = dict(zip(distinct, self.encode_words(distinct), strict=True))
        return [b"".join(map(known.__getitem__, own)) for own in parts]

    def encode_words(self, words: Sequence[str]) -> list[bytes]:
        """Ids (32-bit) of each word; words of equal length advance together."""
        out: list[bytes] = [b""] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[order])) + 1
        for group in np.split(order, cuts):
            n = int(size[group[0]]) if len(group) else 0
            if not n:
                continue
            for low in range(0, len(group), max(1, 400_000 // n)):
                few = group[low : low + max(1, 400_000 // n)]
                chars = np.frombuffer("".join([words[k] for k in few]).encode("utf-32-le"), np.uint32).reshape(len(few), n)
                last, back = self._advance(chars)
                self._collect(few, chars, last, back, out, words)
        return out

    def _collect(self, group: np.ndarray, chars: np.ndarray, last: np.ndarray, back: np.ndarray, out: list[bytes], words: Sequence[str]) -> None:
        """Follow the backpointers of all words of the group at once, from the end."""
        rows, n = chars.shape
        place = np.full((rows, n), -2, np.int64)  # id at the position where its piece begins
        at = np.full(rows, n)
        live = np.arange(rows)
        stuck = np.zeros(rows, np.bool_)
        while len(live):
            piece, begin = last[at[live], live], back[at[live], live]
            dead = begin < 0
            stuck[live[dead]] = True
            live, piece, begin = live[~dead], piece[~dead], begin[~dead]
            place[live, begin] = piece
            at[live] = begin
            live = live[begin > 0]
        plain = (place != -1).all(axis=1) & ~stuck
        ids = place[plain]
        used = ids >= 0
        flat = ids[used].astype(np.int32).tobytes()
        ends = np.cumsum(used.sum(axis=1)) * 4
        start = 0
        for k, end in zip(group[plain].tolist(), ends.tolist(), strict=True):
            out[k] = flat[start:end]
            start = end
        for r in np.flatnonzero(~plain):
            k = group[r]
            if stuck[r]:
                ids_r = self._by_merging(words[k])
            else:
                ids_r = []
                for pos in np.flatnonzero(place[r] != -2):
                    ids_r += [int(place[r, pos])] if place[r, pos] >= 0 else self._spelled(words[k][pos])
            out[k] = np.array(ids_r, np.int32).tobytes()

    def _words(self, text: str) -> list[str]:
        """The text cut before each space (or run of spaces): no piece reaches over such a place. Words that do not begin with just one space are marked by a NUL."""
        if "  " not in text and "\0" not in text and text[:1] != " " and text[-1:] != " " and SPACE not in text and self.dummy:
            return text.split(" ")
        cut = _RUNS.findall((SPACE if self.dummy else "") + text.replace(" ", SPACE))
        return [w[1:] if w[0] == SPACE and w[1:2] not in ("", SPACE, "\0") else f"\0{w}" for w in cut]

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the first id of each text (one more at the end)."""
        split = [self._words(t) if t else [] for t in texts]
        flat: list[str] = []
        for words in split:
            flat.extend(words)
        index = {w: k for k, w in enumerate(dict.fromkeys(flat))}
        cache = self.cache
        missing = [w for w in index if w not in cache]
        if len(cache) + len(missing) > CACHE_WORDS:
            cache.clear()
            missing = list(index)
        plain = [w for w in missing if w[:1] != "\0" and len(w) < LONG_WORD]
        cache.update(zip(plain, self.encode_words([SPACE + w for w in plain]), strict=True))
        long = [w for w in missing if w[:1] != "\0" and len(w) >= LONG_WORD]
        cache.update(zip(long, self._encode_long([SPACE + w for w in long]), strict=True))
        for w in missing:
            if w[:1] == "\0":
                cache[w] = np.array(self._by_merging(w[1:]), np.int32).tobytes() if self.bpe else self.encode_words([w[1:]])[0]
        own = [cache[w] for w in index]
        if len(cache) > CACHE_WORDS:
            cache.clear()
        first = np.concatenate(([0], np.cumsum([len(o) // 4 for o in own], dtype=np.int64)))
        pool = np.frombuffer(b"".join(own), np.int32)
        code = np.array(list(map(index.__getitem__, flat)), np.int64)
        ids, ends = _gather(pool, first, code)
        text_first = np.concatenate(([0], np.cumsum([len(words) for words in split])))
        return ids, ends[text_first]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """The texts of lists of ids, cut at the offsets `first`."""
        flat, ends = _gather(self.out_bytes, self.out_first, np.asarray(ids, np.int64))
        raw = flat.tobytes()
        cut = ends[first].tolist()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return [t[1:] if self.dummy and t[:1] == " " else t for t in texts]


def _gather(pool: np.ndarray, first: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pool's stretches in the order of code, joined, and where each begins (one more at the end)."""
    size = (first[1:] - first[:-1])[code]
    ends = np.concatenate(([0], np.cumsum(size)))
    return pool[np.repeat(first[code] - ends[:-1], size) + np.arange(ends[-1])], ends


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode_documents(docs: DataFrame, path: str | None = None, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`keep` columns, n_tokens and ids of every document's whole text."""
    path = path or model_path()

    def work(texts: list[str | None]) -> dict[str, object]:
        ids, first = codec(path).encode(texts)
        return {"n_tokens": np.diff(first), "ids": list_array(ids, first)}

    return map_texts(docs, work, "n_tokens long, ids array<int>", keep=keep, limit=SLICE_BYTES)


def round_trip_documents(docs: DataFrame, path: str | None = None, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """As encode_documents, with the SHA-256 of the text that the ids decode to, and whether that is the document's text (null as empty)."""
    path = path or model_path()

    def work(texts: list[str | None]) -> dict[str, object]:
        ids, first = codec(path).encode(texts)
        back = codec(path).decode(ids, first)
        same = [b == (t or "") for b, t in zip(back, texts, strict=True)]
        return {"n_tokens": np.diff(first), "ids": list_array(ids, first), "decoded_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in back], "round_trip": same}

    return map_texts(docs, work, "n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean", keep=keep, limit=SLICE_BYTES)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with ids; null ids give a null text."""
    path = path or model_path()

    def decode(ids):
        import pandas as pd

        rows = [np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in ids]
        first = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int64)
        texts = codec(path).decode(np.concatenate(rows) if rows else np.zeros(0, np.int64), first)
        return pd.Series([None if x is None else t for x, t in zip(ids, texts, strict=True)])

    return encoded.select("doc_id", F.pandas_udf(decode, "string")("ids").alias("text"))
