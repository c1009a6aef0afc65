"""Secret scans by grammar inference.

Fixed patterns find the base spans. Their values, labelled by kind, are the credentials from which one probabilistic
automaton per kind is inferred: a prefix tree of character classes whose statistically compatible states are merged
(Hoeffding bounds on the frequencies of endings and of next classes). Every other token of every text is then scored by
its likelihood under these automata against that of the tokens at large, whose classes are counted over all texts. A
token becomes an added span if it fits a format as well as the labelled credentials do and if its likelihood ratio
outweighs the odds against it, which are the numbers of tokens and of labelled credentials in all texts.

A token is a run of letters, digits and + / _ . - of MIN_ASSIGN characters or more, without dots and hyphens at its ends
but with up to two closing equals signs; base spans end runs. Whole values and tokens are scored, however long.

Bounds of learning, all documented parameters: SAMPLE distinct values of a kind, first by hash; values of more than
LEARNED characters do not teach; states passed by fewer than RARE values are not merged upwards, since the test says
nothing about them; what follows two states is compared LOOKAHEAD steps far.

Edge cases: null and empty texts have no spans; base spans never go, added ones never overlap them; equal scores go to
the kind listed first; without labelled credentials nothing is added; rows without a doc_id and repeated rows are kept;
texts are scanned whole; extra columns are not carried by `find_secrets` and are kept by `redact`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perimetra.llm.common import discard, joined, map_texts, materialize, span_hashes, spans

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Parts of the assignments' names, one of which a text with an assignment holds.
NAMED = ("passw", "secret", "token", "api")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
SAMPLE = 20_000
LEARNED = 512
RARE = 30
LOOKAHEAD = 64
#: Confidence of the compatibility test, and the share of labelled credentials that may lie below a kind's least likelihood.
ALPHA = 0.05
QUANTILE = 0.01
#: Tokens whose kind a worker remembers, at most.
REMEMBERED = 500_000
_LOST = math.log(1e-4)

_CLASSES = np.zeros(128, np.int8)
for _i, _members in enumerate(("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/", "-_", ".=")):
    for _c in _members:
        _CLASSES[ord(_c)] = _i
_WIDTH = np.array([10, 6, 20, 6, 20, 2, 2, 2], float)
END = len(_WIDTH)
SYMBOLS = END + 1


_HEX = np.zeros(256, np.bool_)
_HEX[list(b"0123456789abcdef")] = True
_INNER = np.zeros(256, np.bool_)
_INNER[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_.-"]] = True
_EDGE = _INNER.copy()
_EDGE[list(b".-")] = False


def _runs(owner: np.ndarray) -> list[tuple[int, int, int]]:
    """Each value of the sorted array, where it begins and where it ends."""
    values, first = np.unique(owner, return_index=True)
    return list(zip(values.tolist(), first.tolist(), np.append(first, len(owner))[1:].tolist(), strict=True))


class Scan:
    """Base spans and tokens of a slice of texts."""

    def __init__(self, texts: Sequence[str | None]) -> None:
        self.texts = [t or "" for t in texts]
        self.buffer, self.offsets = joined(self.texts)
        self.base = self._base()  # by text: (kind, start, end, value), by start, then kind as listed
        self._tokens()

    def _points(self, i: int, places: np.ndarray) -> list[int]:
        """Code points of byte places within text i, in one pass over the text."""
        if self.texts[i].isascii():
            return places.tolist()
        begins = (self.buffer[self.offsets[i] : self.offsets[i + 1]] & 0xC0) != 0x80
        edges = np.unique(np.append(places, 0))
        before = np.concatenate(([0], np.cumsum(np.add.reduceat(begins, edges, dtype=np.int64)[:-1])))
        return before[np.searchsorted(edges, places)].tolist()

    def _bytes(self, i: int, points: list[int]) -> dict[int, int]:
        """Byte places of code points within text i, in one pass over the text."""
        text, out, at, low = self.texts[i], {}, 0, 0
        if text.isascii():
            return {p: p for p in points}
        for p in sorted(set(points)):
            at += len(text[low:p].encode())
            out[p], low = at, p
        return out

    def _base(self) -> list[list[tuple[str, int, int, str]]]:
        found: list[list[tuple[str, int, int, str]]] = [[] for _ in self.texts]
        start, end = spans(self.buffer, _HEX)
        long = end - start >= MIN_HEX
        start, end = start[long], end[long]
        owner = np.searchsorted(self.offsets, start, "right") - 1
        for i, low, high in _runs(owner):
            points = self._points(i, np.concatenate((start[low:high], end[low:high])) - self.offsets[i])
            found[i] += [("hex", a, b, self.texts[i][a:b]) for a, b in zip(points[: high - low], points[high - low :], strict=True)]
        for i, text in enumerate(self.texts):
            low = text.lower()
            if any(name in low for name in NAMED):
                found[i] += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
            if "AKIA" in text:
                found[i] += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
            found[i].sort(key=lambda x: (x[1], KINDS.index(x[0])))
        return found

    def _tokens(self) -> None:
        """Byte places of the tokens, in order, and the text of each."""
        free = self.buffer
        if any(self.base):
            free = free.copy()
            for i, own in enumerate(self.base):
                place = self._bytes(i, [p for _, a, b, _ in own for p in (a, b)])
                for _, a, b, _ in own:
                    free[self.offsets[i] + place[a] : self.offsets[i] + place[b]] = 0
        start, end = spans(free, _INNER)
        rough = np.flatnonzero(~(_EDGE[free[start]] & _EDGE[free[end - 1]]))
        for _ in range(8):  # most runs lose a character or two
            start[rough] += ~_EDGE[free[start[rough]]] & (start[rough] < end[rough])
            end[rough] -= ~_EDGE[free[end[rough] - 1]] & (start[rough] < end[rough])
            rough = rough[(start[rough] < end[rough]) & ~(_EDGE[free[start[rough]]] & _EDGE[free[end[rough] - 1]])]
        for k in rough.tolist():
            kept = np.flatnonzero(_EDGE[free[start[k] : end[k]]])
            start[k], end[k] = (start[k] + kept[0], start[k] + kept[-1] + 1) if len(kept) else (start[k], start[k])
        for _ in range(2):
            end += free[end] == ord("=")
        long = end - start >= MIN_ASSIGN
        self.start, self.end = start[long], end[long]
        self.owner = np.searchsorted(self.offsets, self.start, "right") - 1

    def value(self, k: int) -> str:
        return self.buffer[self.start[k] : self.end[k]].tobytes().decode("ascii")

    def class_counts(self) -> np.ndarray:
        """How often each symbol comes in the tokens, their ends with it."""
        delta = np.zeros(len(self.buffer) + 1, np.int8)
        delta[self.start] = 1
        delta[self.end] -= 1
        symbols = _CLASSES[self.buffer[np.cumsum(delta[:-1], dtype=np.int8).view(np.bool_)] & 127]
        out = np.bincount(symbols, minlength=SYMBOLS)
        out[END] = len(self.start)
        return out

    def added(self, model: Model, memo: dict[int, int]) -> list[list[tuple[str, int, int]]]:
        """By text, the tokens that fit a format, as (kind, start, end) in code points. memo: kinds of token hashes met before."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in self.texts]
        if not model.automata or not len(self.start):
            return out
        names, at, back = np.unique(span_hashes(self.buffer, self.start, self.end), return_index=True, return_inverse=True)
        keys = names.tolist()
        new = [n for n, key in enumerate(keys) if key not in memo]
        if len(memo) + len(new) > REMEMBERED:
            memo.clear()
            new = list(range(len(keys)))
        memo.update(zip([keys[n] for n in new], model.kinds_of([self.value(k) for k in at[new]]), strict=True))
        kind = np.array([memo[key] for key in keys])[back]
        fits = np.flatnonzero(kind >= 0)
        for i, low, high in _runs(self.owner[fits]):
            own = fits[low:high]
            points = self._points(i, np.concatenate((self.start[own], self.end[own])) - self.offsets[i])
            out[i] = [(f"like_{KINDS[k]}", a, b) for k, a, b in zip(kind[own].tolist(), points[: len(own)], points[len(own) :], strict=True)]
        return out


def _symbols(value: str) -> np.ndarray:
    return np.append(_CLASSES[np.frombuffer(value.encode("ascii", "replace"), np.uint8) & 127], np.int8(END))


def _compatible(a: np.ndarray, b: np.ndarray, alpha: float) -> bool:
    """Hoeffding test on two states' counts of next classes and endings."""
    na, nb = a.sum(), b.sum()
    bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
    return bool((np.abs(a / na - b / nb) <= bound).all())


class Automaton:
    """A probabilistic automaton over character classes: counts and targets of each state."""

    def __init__(self, counts: np.ndarray, targets: np.ndarray) -> None:
        self.counts, self.targets = counts, targets
        total = counts.sum(axis=1, keepdims=True)
        width = np.append(_WIDTH, 1.0)
        self.cost = np.log((counts + 0.01) / (total + 0.01 * SYMBOLS)) - np.log(width)

    def totals(self, values: Sequence[str]) -> np.ndarray:
        """Log-likelihood of each value; off the learned paths every step costs its smoothed least.

        Values of about one length advance together, a symbol a step, until they leave the paths or end; long ones go alone.
        """
        size = np.array([len(v) for v in values], np.int64)
        out = np.zeros(len(values))
        order = np.argsort(size, kind="stable")
        short = order[size[order] <= 256]
        for few in (short[i : i + 8192] for i in range(0, len(short), 8192)):
            width = int(size[few].max()) + 1
            symbols = np.full((len(few), width), END, np.int8)
            filled = np.arange(width)[None, :] < size[few][:, None]
            symbols[filled] = _CLASSES[np.frombuffer("".join([values[k] for k in few]).encode("ascii", "replace"), np.uint8) & 127]
            live, state, total = np.arange(len(few)), np.zeros(len(few), np.int64), np.zeros(len(few))
            for step in range(width):
                s = symbols[live, step]
                total[live] += self.cost[state, s]
                ended, state = s == END, self.targets[state, s]
                lost = ~ended & (state < 0)
                total[live[lost]] += _LOST * (size[few][live[lost]] - step)
                on = ~ended & ~lost
                live, state = live[on], state[on]
            out[few] = total
        cost, targets = self.cost.tolist(), self.targets.tolist()
        for k in order[len(short) :].tolist():
            state, total = 0, 0.0
            for step, s in enumerate(_symbols(values[k]).tolist()):
                if state < 0:
                    total += _LOST * (size[k] + 1 - step)
                    break
                total += cost[state][s]
                state = targets[state][s]
            out[k] = total
        return out


def infer(values: Sequence[str], alpha: float = ALPHA) -> Automaton:
    """Prefix tree of the values, its states merged level by level with the most frequent compatible state there, then with compatible states above.

    Merging by level first keeps what a format says about length; merging upwards then folds loops. A state goes upwards
    only if all that can follow agrees, step for step, with what follows the state above.
    """
    words = [_symbols(v).tolist() for v in values]
    counts = [np.zeros(SYMBOLS, np.int64)]
    targets = [np.full(SYMBOLS, -1, np.int64)]
    level: dict[int, list[int]] = {0: list(range(len(words)))}  # state -> words that pass through it
    depth = 0
    while level:
        reached: dict[tuple[int, int], list[int]] = defaultdict(list)
        for state, members in level.items():
            for w in members:
                s = words[w][depth]
                counts[state][s] += 1
                if s != END:
                    reached[state, s].append(w)
        depth += 1
        tails = []
        for (state, s), members in reached.items():
            own = np.bincount([words[w][depth] for w in members], minlength=SYMBOLS)
            tails.append((len(members), state, s, members, own))
        tails.sort(key=lambda x: (-x[0], x[1], x[2]))
        level, blocks = {}, []  # blocks: state, pooled counts
        for _, state, s, members, own in tails:
            for block in blocks:
                if _compatible(block[1], own, alpha):
                    break
            else:
                block = [len(counts), np.zeros(SYMBOLS, np.int64)]
                counts.append(np.zeros(SYMBOLS, np.int64))
                targets.append(np.full(SYMBOLS, -1, np.int64))
                blocks.append(block)
                level[block[0]] = []
            block[1] = block[1] + own
            level[block[0]].extend(members)
            targets[state][s] = block[0]
    merged = _merge_upwards(counts, targets, alpha)
    return Automaton(*merged)


def _merge_upwards(counts: list[np.ndarray], targets: list[np.ndarray], alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Fold each state into the first earlier one that it is compatible with along all paths."""

    tested: dict[tuple[int, int], bool] = {}

    def alike(a: int, b: int) -> bool:
        """Breadth first over the pairs of states that both reach by equal symbols; each pair is tested once."""
        seen, pairs = set(), {(a, b)}
        for _ in range(LOOKAHEAD):
            for pair in pairs:
                if pair not in tested:
                    tested[pair] = _compatible(counts[pair[0]], counts[pair[1]], alpha)
                if not tested[pair]:
                    return False
            seen |= pairs
            pairs = {(x, y) for i, j in pairs for x, y in zip(targets[i][:END].tolist(), targets[j][:END].tolist(), strict=True) if x >= 0 and y >= 0 and x != y} - seen
        return True

    into = list(range(len(counts)))
    heads: list[int] = []
    for state in range(len(counts)):
        if counts[state].sum() >= RARE:
            for head in heads:
                if alike(head, state):
                    into[state] = head
                    break
        if into[state] == state and counts[state].sum() >= RARE:
            heads.append(state)
    total, to = np.array(counts), np.array(targets)
    for state, head in enumerate(into):
        if head != state:
            total[head] += total[state]
    to = np.where(to >= 0, np.array(into)[to], -1)
    return total, to


class Model:
    """Automata, least mean log-likelihoods and odds by kind, and the classes of tokens at large."""

    def __init__(self, labelled: dict[str, Sequence[str]], plain: np.ndarray, number: dict[str, int] | None = None, alpha: float = ALPHA, quantile: float = QUANTILE) -> None:
        """labelled: distinct values to learn from; plain: counts of the symbols of all tokens; number: labelled credentials in all texts."""
        self.automata = {kind: infer(labelled[kind], alpha) for kind in KINDS if labelled.get(kind)}
        share = plain + 1.0
        self.plain = np.log(share / share.sum()) - np.log(np.append(_WIDTH, 1.0))
        self.least, self.odds = {}, {}
        for kind in self.automata:
            self.least[kind] = float(np.quantile(self.automata[kind].totals(labelled[kind]) / self._steps(labelled[kind]), quantile))
            self.odds[kind] = max(0.0, math.log(max(float(plain[END]), 1.0) / max((number or {}).get(kind, len(labelled[kind])), 1)))

    @staticmethod
    def _steps(values: Sequence[str]) -> np.ndarray:
        return np.array([len(v) + 1 for v in values], float)

    def at_large(self, values: Sequence[str]) -> np.ndarray:
        """Log-likelihood of each value as a token at large."""
        joined = np.frombuffer("|".join([*values, ""]).encode("ascii", "replace"), np.uint8)
        if not len(joined):
            return np.zeros(0)
        costs = np.where(joined == ord("|"), self.plain[END], self.plain[_CLASSES[joined & 127]])  # a bar ends a value
        return np.add.reduceat(costs, np.concatenate(([0], np.cumsum([len(v) + 1 for v in values[:-1]]))).astype(np.int64))

    def kinds_of(self, values: Sequence[str]) -> list[int]:
        """Place in KINDS of the format that each value fits best of those it fits as well as credentials do, against all odds; -1 if none."""
        found, best = np.full(len(values), -1), np.full(len(values), -np.inf)
        steps, plain = self._steps(values), self.at_large(values)
        for kind in self.automata:
            total = self.automata[kind].totals(values)
            ratio = total - plain
            fits = (total / steps >= self.least[kind]) & (ratio > 0) & (ratio >= self.odds[kind]) & (ratio > best)
            found[fits], best[fits] = KINDS.index(kind), ratio[fits]
        return found.tolist()


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Infer the automata from the base matches of all documents: per kind the `sample` distinct values that come first by
    hash. The numbers of credentials and the classes of tokens are counted over all texts."""

    def work(texts: list[str | None]) -> dict[str, object]:
        scan = Scan(texts)
        values: list[list[dict[str, str]]] = [[{"kind": k, "value": v} for k, _, _, v in own] for own in scan.base]
        counts = [scan.class_counts().tolist()] + [None] * (len(texts) - 1)  # a slice's counts stand in its first row
        return {"base": values, "counts": counts}

    held = materialize(map_texts(docs.select("text"), work, "base array<struct<kind:string,value:string>>, counts array<long>", keep=()), "secrets")
    sums = held.filter("counts is not null").agg(*[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(SYMBOLS)]).first()
    values = held.select(F.explode("base").alias("x")).select("x.kind", "x.value").filter("value is not null")
    number = {r["kind"]: r["count"] for r in values.groupBy("kind").count().collect()}
    labelled = {}
    for kind in KINDS:
        rows = values.filter((F.col("kind") == kind) & (F.length("value") <= LEARNED)).select("value").distinct().orderBy(F.xxhash64("value"), "value").limit(sample).collect()
        labelled[kind] = [r["value"] for r in rows]
    discard(held)
    return Model(labelled, np.array([sums[f"c{i}"] or 0 for i in range(SYMBOLS)], float), number)


def _joined(found: Sequence[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def _order(span: tuple[str, int, int]) -> tuple[int, int]:
    return span[1], (*KINDS, *(f"like_{k}" for k in KINDS)).index(span[0])


def find_secrets(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added.

    spans has all spans as kind:start:end in code points; added ones are of kind like_<kind>.
    """
    model = learn(docs, sample)
    memo: dict[int, int] = {}

    def work(texts: list[str | None]) -> dict[str, object]:
        rows, scan = defaultdict(list), Scan(texts)
        for base, more in zip(scan.base, scan.added(model, memo), strict=True):
            own = [(k, a, b) for k, a, b, _ in base]
            count = Counter(k for k, _, _ in own)
            for kind in KINDS:
                rows[f"n_{kind}"].append(count[kind])
            rows["base_sha256"].append(hashlib.sha256(_joined(own).encode()).hexdigest())
            rows["spans"].append(_joined(sorted(own + more, key=_order)))
            rows["n_added"].append(len(more))
        return rows

    return map_texts(docs, work, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, mask: str = "[secret]", sample: int = SAMPLE) -> DataFrame:
    """The documents with each secret's characters replaced by `mask`, and n_chars, if there is one, counted anew. All rows and columns stay."""
    model = learn(docs, sample)
    memo: dict[int, int] = {}

    def work(texts: list[str | None]) -> dict[str, object]:
        out, scan = [], Scan(texts)
        for text, base, more in zip(texts, scan.base, scan.added(model, memo), strict=True):
            if not base and not more:
                out.append(text)
                continue
            parts, at = [], 0
            for a, b in sorted([(a, b) for _, a, b, _ in base] + [(a, b) for _, a, b in more]):
                if a >= at:
                    parts += [text[at:a], mask]
                at = max(at, b)
            out.append("".join([*parts, text[at:]]))
        return {"text": out}

    cleaned = map_texts(docs, work, "text string", keep=[c for c in docs.columns if c != "text"])
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return cleaned.select(docs.columns)
