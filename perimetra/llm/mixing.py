"""Mixing to target weights with soft membership.

A classifier learned from the labelled table gives every document a posterior over domains. Projected gradient steps
then fit a nonnegative rate to each document so that the expected tokens of each domain (rate x tokens x posterior,
summed) match the targets, by least squares, starting from and staying as near as they can to a rate of one.

A rate depends on the document's posterior and on the steps so far alone, so no rate is stored between steps: each step
is one pass over the narrow posterior table that returns a sum per domain for each partition.

Edge cases: null and empty texts have no tokens and a rate like any other; labels that are null or contradictory teach
nothing (of several texts under one doc_id the first by hash teaches); a domain without a labelled document has a posterior of 0 and can only get 0 tokens; with no labels all
posteriors are equal; an empty table gives no rows; repeated rows each have their rate; ties cannot arise; rows without
a doc_id keep a rate; extra columns are not carried by `fit_rates` and are kept by `mix_documents`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perimetra.llm import quality
from perimetra.llm.common import discard, map_texts, materialize, spare_name, words

#: Domains of the labelled table (quality 0: poor, else toxic 1: toxic, else clean), and their target shares of all tokens.
DOMAINS = ("clean", "toxic", "poor")
TARGETS = {"clean": 0.97, "toxic": 0.02, "poor": 0.01}
STEPS = 60
TOLERANCE = 1e-4
#: Damping of the steps, as a share of the moments' mean.
DAMPING = 0.02
TRAIN_ROWS = 20_000
HASHED = 1 << 17
#: Documents' worth of the domains' shares that a word's counts are shrunk with.
SHRINK = 20.0


def _profile(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Tokens (words) of each text, its quality features, and its distinct hashed words."""
    hashes, first = words(texts)
    slots = (hashes >> np.uint64(40)).astype(np.int64) % HASHED
    return np.diff(first), quality.features(texts), [np.unique(slots[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


class DomainClassifier:
    """Posteriors from words: log-odds of hashed words' presence per domain, calibrated with counts of the text by a softmax."""

    def __init__(self, count: np.ndarray, table: np.ndarray) -> None:
        """count: labelled documents of each domain; table: of them, those that hold a slot (slots x domains)."""
        k = len(DOMAINS)
        count = np.asarray(count, float)
        self.seen = count > 0 if count.any() else np.ones(k, np.bool_)
        share = (count + 0.5) / (count.sum() + 0.5 * k)
        self.odds = np.log((table + SHRINK * share) / (table.sum(1, keepdims=True) + SHRINK) / share)
        self.mean, self.scale = np.zeros(len(quality.NAMES)), np.ones(len(quality.NAMES))
        self.weights = np.zeros((len(quality.NAMES) + k + 1, k))

    def calibrate(self, features: np.ndarray, top: np.ndarray, domain: np.ndarray) -> None:
        """Fit the softmax to labelled documents: their features, the odds of their tellingest words, their domains."""
        if len(domain):
            self.mean, self.scale = features.mean(0), features.std(0) + 1e-6
            self._calibrate(self._inputs(features, top), domain)

    def top(self, present: list[np.ndarray]) -> np.ndarray:
        """For each domain, the sum of a text's three largest odds."""
        top = np.zeros((len(present), len(DOMAINS)))
        for i, slots in enumerate(present):
            if len(slots):
                top[i] = np.sort(self.odds[slots], axis=0)[-3:].sum(0)
        return top

    def _inputs(self, features: np.ndarray, top: np.ndarray) -> np.ndarray:
        return np.column_stack((np.clip((features - self.mean) / self.scale, -5, 5), top, np.ones(len(top))))

    def _calibrate(self, x: np.ndarray, domain: np.ndarray) -> None:
        y = np.eye(len(DOMAINS))[domain]
        velocity = np.zeros_like(self.weights)
        step = len(x) / (np.linalg.norm(x, 2) ** 2 + 1e-9)
        for _ in range(300):
            p = self._softmax(x @ self.weights)
            velocity = 0.9 * velocity - step * (x.T @ (p - y) / len(x) + 1e-5 * self.weights)
            self.weights += velocity

    def _softmax(self, z: np.ndarray) -> np.ndarray:
        z = np.where(self.seen[None, :], z, -np.inf)
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def posterior(self, features: np.ndarray, present: list[np.ndarray]) -> np.ndarray:
        return self._softmax(self._inputs(features, self.top(present)) @ self.weights)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DomainClassifier:
    """Learn domains from at most `rows` labelled documents, those first by a hash of their doc_id."""
    clear = labels.filter("quality in (0, 1) and toxic in (0, 1)").withColumn("domain", F.when(F.col("quality") == 0, 2).otherwise(F.col("toxic")).cast("int"))
    clear = clear.groupBy("doc_id").agg(F.min("domain").alias("domain"), F.max("domain").alias("most")).filter("domain = most").select("doc_id", "domain")
    chosen = clear.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).join(F.broadcast(chosen), "doc_id")

    def slots(texts: list[str | None]) -> dict[str, object]:
        return {"present": [p.astype(np.int32) for p in _profile(texts)[2]]}

    # Of several texts under one doc_id the first by hash teaches, and its copies once; slots are counted before the driver sees them.
    seen = map_texts(texts, slots, "present array<int>", keep=("doc_id", "digest", "domain"))
    one = materialize(seen.groupBy("doc_id").agg(F.min_by(F.struct("domain", "digest", "present"), "digest").alias("of")).select("doc_id", "of.*"), "labelled-words")
    count, table = np.zeros(len(DOMAINS)), np.zeros((HASHED, len(DOMAINS)))
    for r in one.groupBy("domain").count().collect():
        count[r["domain"]] = r["count"]
    held = one.select("domain", F.explode("present").alias("slot")).groupBy("slot", "domain").count().toPandas()  # slots x domains at most
    table[held["slot"].to_numpy(), held["domain"].to_numpy()] = held["count"].to_numpy()
    model = DomainClassifier(count, table)

    def inputs(texts: list[str | None]) -> dict[str, object]:
        _, x, present = _profile(texts)
        return {"x": x.tolist(), "top": model.top(present).tolist()}

    firsts = one.select("doc_id", F.col("digest").alias("first"))
    first = texts.join(firsts, "doc_id").filter(F.col("digest").eqNullSafe(F.col("first"))).select("doc_id", "text", "domain")
    made = map_texts(first, inputs, "x array<double>, top array<double>", keep=("doc_id", "domain"))
    got = made.groupBy("doc_id").agg(F.first(F.struct("domain", "x", "top")).alias("of")).select("doc_id", "of.*").toPandas().sort_values("doc_id")
    x, top = (np.array(got[c].tolist(), float).reshape(len(got), n) for c, n in (("x", len(quality.NAMES)), ("top", len(DOMAINS))))
    model.calibrate(x, top, got["domain"].to_numpy(np.int64))
    discard(one)
    return model


def posteriors(docs: DataFrame, model: DomainClassifier, keep: Sequence[str] = ("doc_id",), names: tuple[str, str] = ("n_tokens", "posterior")) -> DataFrame:
    """`keep` columns, tokens and posterior (by DOMAINS), the last two called `names`."""

    def work(texts: list[str | None]) -> dict[str, object]:
        n, x, present = _profile(texts)
        return {names[0]: n.astype(np.int64), names[1]: pa.array(list(model.posterior(x, present)), pa.list_(pa.float64()))}

    return map_texts(docs, work, f"{names[0]} long, {names[1]} array<double>", keep=keep)


class Rates:
    """The steps so far; gives the rate of any posterior by taking them again. Rates are at most `most`, and one where `held` is the likeliest domain."""

    def __init__(self, steps: Sequence[np.ndarray] = (), most: float = np.inf, held: int | None = None) -> None:
        self.steps, self.most, self.held = list(steps), most, held

    def of(self, posterior: np.ndarray) -> np.ndarray:
        rate = np.ones(len(posterior))
        for step in self.steps:
            rate = np.clip(rate - posterior @ step, 0, self.most)
        return np.where(self.holds(posterior), 1.0, rate)

    def column(self, posterior: str) -> Column:
        """The same for a column, as an expression."""
        p = [F.col(posterior)[i] for i in range(len(DOMAINS))]
        steps = F.array(*[F.array(*map(F.lit, s.tolist())) for s in self.steps]) if self.steps else F.array().cast("array<array<double>>")
        most = F.lit(float(self.most))
        rate = F.aggregate(steps, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), F.least(most, r - sum(p[i] * s[i] for i in range(len(p))))))
        likeliest = F.array_position(posterior, F.array_max(posterior)) - 1
        return rate if self.held is None else F.when(likeliest == self.held, 1.0).otherwise(rate)

    def holds(self, posterior: np.ndarray) -> np.ndarray:
        return posterior.argmax(1) == (-1 if self.held is None else self.held)

    def free(self, posterior: np.ndarray, rate: np.ndarray, gap: np.ndarray | None) -> np.ndarray:
        """Which rates a step moves: those not held, nor (by the last gap) pressed against a bound."""
        if gap is None:
            return (rate > 0) & ~self.holds(posterior)
        down = posterior @ gap > 0
        return np.where(down, rate > 0, rate < self.most) & ~self.holds(posterior)


def _sums(table: DataFrame, rates: Rates, moments: bool, last_gap: np.ndarray | None = None) -> np.ndarray:
    """Expected tokens by domain, and with moments the K x K matrix of tokens x posterior x posterior, summed over all rows."""
    k = len(DOMAINS)

    def run(batches):
        total = np.zeros(k + k * k)
        for batch in batches:
            n = batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(float)
            p = batch.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            rate = rates.of(p)
            total[:k] += (n * rate) @ p
            if moments:
                total[k:] += ((p * (n * rates.free(p, rate, last_gap))[:, None]).T @ p).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(k + k * k), pa.int32()), pa.array(total)], names=["i", "v"])

    rows = table.select("n_tokens", "posterior").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(k + k * k)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def solve(table: DataFrame, targets: dict[str, float], total: float | None = None, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[Rates, np.ndarray, np.ndarray, np.ndarray]:
    """Rates for the posterior table, the tokens that domains come to, their targets, and their tokens at rate one.

    total: tokens of the mixture; as many as there are by default. Each step is a gradient step in the metric of the
    domains' damped second moments, over the documents whose rate is not held at zero, followed by the projection
    onto nonnegative rates.
    """
    sums = _sums(table, Rates(), True)
    k = len(DOMAINS)
    natural = sums[:k]
    weights = np.array([targets.get(d, 0.0) for d in DOMAINS])
    goal = weights / max(weights.sum(), 1e-12) * (natural.sum() if total is None else total)
    rates, best = Rates(), (np.inf, 0, natural)
    for _ in range(steps):
        gap = sums[:k] - goal
        miss = np.abs(gap).sum() / max(goal.sum(), 1.0)
        if miss < best[0]:
            best = (miss, len(rates.steps), sums[:k])
        if miss <= tolerance:
            break
        moment = sums[k:].reshape(k, k)
        ridge = DAMPING * max(np.trace(moment), 1.0) / k
        rates = Rates([*rates.steps, np.linalg.solve(moment + ridge * np.eye(k), gap)])
        sums = _sums(table, rates, True)
    else:
        gap = sums[:k] - goal
        if np.abs(gap).sum() / max(goal.sum(), 1.0) < best[0]:
            best = (0, len(rates.steps), sums[:k])
    return Rates(rates.steps[: best[1]]), best[2], goal, natural


def solve_draw(table: DataFrame, targets: dict[str, float], steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[Rates, np.ndarray, np.ndarray]:
    """Rates of at most one for the posterior table, the tokens that domains come to, and the tokens aimed at.

    Documents whose likeliest domain is the most wanted one that has documents (clean, where there are any) have rate
    one. The other domains are fitted to their targets in proportion to that domain's tokens. A domain that has fewer
    tokens than that, or none, is left whole, as nothing is drawn twice.
    """
    k = len(DOMAINS)
    weights = np.array([targets.get(d, 0.0) for d in DOMAINS])
    likeliest = table.select((F.array_position("posterior", F.array_max("posterior")) - 1).cast("int").alias("d")).distinct().collect()
    present = [r["d"] for r in likeliest if r["d"] is not None and weights[r["d"]] > 0]
    rates = Rates(most=1.0, held=max(present, key=lambda d: weights[d], default=None))
    sums = _sums(table, rates, True)
    if rates.held is None:
        return rates, sums[:k], sums[:k]
    natural, others = sums[:k], np.arange(k) != rates.held

    def aim(got: np.ndarray) -> np.ndarray:
        return np.where(others, np.minimum(natural, weights / weights[rates.held] * got[rates.held]), got)

    best, since = (np.inf, rates, sums[:k], natural), 0
    for taken in range(steps + 1):
        goal = aim(sums[:k])
        gap = sums[:k] - goal
        miss = np.abs(gap).sum() / max(goal.sum(), 1.0)
        since = 0 if miss < 0.999 * best[0] else since + 1
        if miss < best[0]:
            best = (miss, rates, sums[:k], goal)
        if miss <= tolerance or since == 3 or taken == steps:
            break
        moment = sums[k:].reshape(k, k)[np.ix_(others, others)]
        step = np.zeros(k)
        step[others] = np.linalg.solve(moment + DAMPING * max(np.trace(moment), 1.0) / k * np.eye(k - 1), gap[others])
        rates = Rates([*rates.steps, step], rates.most, rates.held)
        sums = _sums(table, rates, True, gap)
    return best[1:]


def fit_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, total: float | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, posterior, rate (nonnegative expected copies), miss (by how much the
    domains' expected tokens miss their targets, as a share of all; above TOLERANCE if the targets cannot be met or not
    within STEPS steps)."""
    table = materialize(posteriors(docs, train(docs, labels)), "posteriors")
    rates, got, goal, _ = solve(table, targets or TARGETS, total)
    miss = float(np.abs(got - goal).sum() / max(goal.sum(), 1.0))
    return table.select("doc_id", "n_tokens", "posterior", rates.column("posterior").alias("rate"), F.lit(miss).alias("miss"))


def _drawable(docs: DataFrame, labels: DataFrame, targets: dict[str, float]) -> tuple[DataFrame, tuple[str, str], Rates, np.ndarray, np.ndarray]:
    """The documents with tokens and posterior under spare names, written out, and what `solve_draw` finds for them."""
    names = spare_name(docs, "n_tokens"), spare_name(docs, "posterior")
    held = materialize(posteriors(docs, train(docs, labels), docs.columns, names), "posteriors")
    return held, names, *solve_draw(held.select(F.col(names[0]).alias("n_tokens"), F.col(names[1]).alias("posterior")), targets)


def mix_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The documents drawn at the rates of `solve_draw`, without repeats: all columns kept.

    A document stays if a uniform number hashed from its doc_id and text lies below its rate. Posteriors are written
    with the documents once, so that drawing reads no text in Python again.
    """
    held, (_, posterior), rates, _, _ = _drawable(docs, labels, targets or TARGETS)
    uniform = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    return held.filter(uniform < rates.column(posterior)).select(docs.columns)


def drawn_shares(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """What `mix_documents` comes to, one row per domain: target (share asked for), tokens (there are), aimed, expected (tokens at the rates), drawn (in the draw)."""
    targets = targets or TARGETS
    held, (tokens, posterior), rates, expected, aimed = _drawable(docs, labels, targets)
    uniform = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    stays = F.when(uniform < rates.column(posterior), F.col(tokens)).otherwise(0)
    own = [F.sum(F.col(posterior)[i] * F.col(tokens)).alias(f"t{i}") for i in range(len(DOMAINS))]
    got = held.agg(*own, *[F.sum(F.col(posterior)[i] * stays).alias(f"d{i}") for i in range(len(DOMAINS))]).first()
    rows = [(d, float(targets.get(d, 0.0)), got[f"t{i}"] or 0.0, float(aimed[i]), float(expected[i]), got[f"d{i}"] or 0.0) for i, d in enumerate(DOMAINS)]
    return docs.sparkSession.createDataFrame(rows, "domain string, target double, tokens double, aimed double, expected double, drawn double")
