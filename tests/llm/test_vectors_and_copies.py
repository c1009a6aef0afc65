"""Whitening, hard negatives and exact duplicates against brute force, on small and awkward tables."""

import hashlib
import math
import re

import numpy as np
import pytest
from perimetra.llm import exact_dedup, hard_negatives, whitening
from perimetra.llm.common import common_width
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, label long, embedding array<double>, anchor string, cell int, key string, slot int, n long, home int"


def vectors(spark, rows):
    """Rows with extra columns, some of them named as the operators' own."""
    return spark.createDataFrame([(i, la, v, "a", 3, "k", 7, 8, 9) for i, la, v in rows], VECTORS)


def some(count, width, seed=3, labels=4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, width))
    return [(i, int(r.integers(labels)), (0.6 * centres[i % 6] + 0.5 * r.normal(size=width)).tolist()) for i in range(count)]


AWKWARD = [(None, 1, [0.5] * 6), (900, None, [0.25] * 6), (901, 1, None), (902, 1, []), (903, 1, [0.1] * 5), (904, 1, [0.1, None, 0.1, 0.1, 0.1, 0.1]), (905, 1, [NAN] * 6), (906, 1, [INF] + [0.0] * 5), (907, 1, [0.0] * 6)]


# whitening


def plain_whitening(rows, width):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in rows], dtype=object).reshape(-1, width)
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, total = len(fit), fit.sum(axis=0)
    centred = (fit * n - total).astype(float) / n
    values, components = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:16]
    own = (x * n - total).astype(float) / n
    return n, ((x * n - total) ** 2).sum(axis=1), np.abs(own @ components[:, order] / np.sqrt(values[order])), values[order] / values.sum()


def test_whitening_against_a_centred_covariance(spark):
    rows = some(300, 6) + some(300, 6)[:40] + AWKWARD
    used = [r for r in rows if r[2] and len(r[2]) == 6 and all(c is not None and math.isfinite(c) for c in r[2])]
    n, deviation, whitened, explained = plain_whitening([r[2] for r in used], 6)
    got = whitening.whiten(vectors(spark, rows).repartition(5)).collect()
    assert len(got) == 6 * len(used)
    key = lambda i: (i is None, i or 0)
    want = sorted(range(len(used)), key=lambda k: key(used[k][0]))
    mine = sorted(got, key=lambda r: (key(r["vec_id"]), r["component"]))
    twice = [k for k in range(len(want)) if k and used[want[k]][0] == used[want[k - 1]][0]]
    assert len(twice) == 40
    for k in twice:  # the same rows again
        mine[6 * k - 6 : 6 * k + 6] = mine[6 * k - 6 : 6 * k + 6 : 2] + mine[6 * k - 5 : 6 * k + 6 : 2]
    assert {r["n"] for r in got} == {n} and {type(r["identity_error"]) for r in got} == {float} and got[0]["identity_error"] < 1e-9
    for k, at in enumerate(want):
        own = mine[6 * k : 6 * k + 6]
        assert [r["component"] for r in own] == [1, 2, 3, 4, 5, 6] and {r["deviation"] for r in own} == {deviation[at]}
        assert np.allclose(np.abs([r["whitened"] for r in own]), whitened[at], atol=1e-9) and np.allclose([r["explained"] for r in own], explained, rtol=1e-9)


def test_whitening_of_large_and_of_repeated_and_of_no_vectors(spark):
    far = [(i, 0, [1e9 + i % 7, 3.0 - 1e6 * (i % 5), 0.25 * i]) for i in range(60)]
    n, deviation, whitened, _ = plain_whitening([r[2] for r in far], 3)
    got = whitening.whiten(vectors(spark, far)).orderBy("vec_id", "component").collect()
    assert got[0]["n"] == n == 60
    assert [r["deviation"] for r in got[::3]] == [int(d) if d < 2**63 else None for d in deviation]
    assert np.allclose(np.abs([r["whitened"] for r in got]).reshape(60, 3), whitened, rtol=1e-4, atol=1e-4)  # a single decomposition is that far off
    assert got[0]["identity_error"] < 1e-7
    same = whitening.whiten(vectors(spark, [(i, 0, [1.0, 2.0]) for i in range(5)])).collect()
    assert len(same) == 10 and {(r["n"], r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in same} == {(1, None, None, 0, 0.0)}
    flat = whitening.whiten(vectors(spark, [(i, 0, [float(i), 2.0]) for i in range(5)])).filter("component = 2").collect()
    assert {(r["whitened"], r["explained"]) for r in flat} == {(None, 0.0)}
    assert whitening.whiten(vectors(spark, [])).count() == whitening.whiten(vectors(spark, AWKWARD[2:4])).count() == 0


def test_residues_give_exact_sums():
    r = np.random.default_rng(1)
    values = [int(v) * 2**40 + 3 for v in r.integers(-(2**40), 2**40, 50)]
    primes = whitening.primes_beyond(2 * 2**81)
    assert all(pow(2, p - 1, p) == 1 for p in primes) and math.prod(primes) > 2**82
    assert whitening.reconstructed({p: np.array([v % p for v in values]) for p in primes}).tolist() == values


# hard negatives


def plain_negatives(rows, is_anchor, positives=5, negatives=5):
    """Over distinct usable rows."""
    width = len(next(v for i, la, v in sorted(rows, key=lambda r: (r[0] is None, r[0])) if i is not None and la is not None and v))
    fine = {(i, la, tuple(math.floor(256 * c) for c in v)) for i, la, v in rows if i is not None and la is not None and v and len(v) == width and all(c is not None and math.isfinite(c) for c in v)}
    out = []
    for i, la, q in fine:
        if is_anchor(i):
            scored = sorted(((sum(a * b for a, b in zip(q, y, strict=True)), j, lb) for j, lb, y in fine if j != i), key=lambda s: (-s[0], s[1]))
            for ps, p, _ in [s for s in scored if s[2] == la][:positives]:
                hit = [s for s in scored if s[2] != la and 80 * ps <= 100 * s[0] <= 100 * ps][:negatives]
                out += [(i, p, k + 1, n, ps, ns) for k, (ns, n, _) in enumerate(hit)]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **options).collect())


def test_hard_negatives_against_all_pairs(spark, monkeypatch):
    rows = some(500, 6) + AWKWARD + [(907, 2, [0.0] * 6)] + some(500, 6)[:60]
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 500 and mined(vectors(spark, rows).repartition(4)) == want
    monkeypatch.setattr(hard_negatives, "BLOCK_NUMBERS", 60)  # many blocks to a cell
    monkeypatch.setattr(hard_negatives, "STEP", 3)
    assert mined(vectors(spark, rows).repartition(4), pivots=3) == want


def test_hard_negatives_with_ties_repeats_large_values_and_nothing(spark):
    ties = [(i, i % 2, [1.0, 0.5]) for i in range(40)] + [(50 + i, 1, [0.9, 0.5]) for i in range(9)] + [(10, 0, [1.0, 0.5]), (10, 1, [0.7, 0.1])]
    assert mined(vectors(spark, ties)) == plain_negatives(ties, lambda i: i % 10 == 0)
    large = [(i, i % 3, [3e5 * (i % 11), 2e5 + i]) for i in range(80)] + [(81, 1, [1e300, 0.0])]
    assert mined(vectors(spark, large)) == plain_negatives(large[:-1], lambda i: i % 10 == 0)
    opposite = [(0, 0, [1.0]), (1, 0, [-1.0]), (2, 1, [-1.1])]
    assert mined(vectors(spark, opposite)) == []
    assert mined(vectors(spark, [])) == mined(vectors(spark, AWKWARD[1:4])) == mined(vectors(spark, [(10, 1, [0.5])])) == []


def test_brackets_hold_every_score():
    r = np.random.default_rng(2)
    y = np.floor(256 * r.normal(size=(200, 5))).astype(np.int32)
    longest = float((y.astype(float) ** 2).sum(axis=1).max())
    near = hard_negatives.Pivots(y, longest, 4)
    rows, asks = near.distances(near.lifted(y)), near.distances(near.lifted(y[:20], True))
    gap = near.radius((y[:20].astype(float) ** 2).sum(axis=1)[:, None], y[:20].astype(float) @ y.T)
    assert (np.abs(asks[:, None] - rows[None]).max(axis=2) <= gap + near.slack()).all() and ((asks[:, None] + rows[None]).min(axis=2) >= gap - near.slack()).all()


def test_common_width_is_that_of_the_first_usable_row(spark):
    rows = vectors(spark, [(3, 1, [1.0, 2.0]), (1, 1, [NAN]), (2, 1, None), (5, 1, [4.0]), (4, 1, [3.0, 1.0]), (None, 1, [1.0] * 3)])
    assert common_width(rows.select("vec_id", "embedding"), lambda v: v.max(axis=1), 100.0) == (2, 2, 3.0)


# exact duplicates

TEXTS = "doc_id long, text string, digest string, place long, delivery int, n_rows long"


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "d", 1, 2, 3) for i, t in rows], TEXTS)


def check_copies(spark, rows, earlier):
    got = exact_dedup.exact_dedup(texts(spark, rows).repartition(3), earlier).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i))
    want = []
    for norm, own in groups.items():
        own = sorted(own, key=lambda r: (r[0], r[1], r[2] or 0))
        want += [(i, own[0][2], len(own), k == 0, hashlib.sha256(norm.encode()).hexdigest()) for k, (_, _, i) in enumerate(own)]
    order = lambda r: (r[0] is None, r[0] or 0, r[4], r[3])
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)


COPIES = [(1, "one text"), (2, "onetext"), (3, "one \t text"), (4, "o n e t e x t"), (5, None), (6, ""), (7, " \n\r\f\v"), (8, "no break"), (9, "nobreak"), (10, "é" * 50_000), (11, "é" * 49_999 + " é"), (12, "日本 語"), (13, "日本語"), (13, "日本語"), (14, "x\0y"), (None, "one text"), (None, "only without id"), (None, "only without id"), (-5, "alone")]


@pytest.mark.parametrize("earlier", ["doc_id % 2 = 0", "true", "false", "doc_id < 4"])
def test_exact_copies_against_a_dictionary(spark, earlier):
    check_copies(spark, COPIES, F.expr(earlier))


def test_exact_copies_of_a_hot_text_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET_KEYS", 16)
    monkeypatch.setattr(exact_dedup, "BLOCK_KEYS", 4)
    check_copies(spark, [(i, f"text {i % 90}" if i % 3 else "hot text") for i in range(900)], F.expr("doc_id < 300"))
    assert exact_dedup.exact_dedup(texts(spark, []), F.lit(True)).count() == 0


def test_perfect_hash_is_minimal_and_refuses_others():
    r = np.random.default_rng(4)
    for count in (0, 1, 2, 9, 5000):
        keys = r.integers(0, 2**63, (count, 4)).astype(np.uint64)
        if count > 2:
            keys[1, :3] = keys[0, :3]  # digests that differ in their last bytes only
        levels = exact_dedup.perfect_hash(keys)
        assert sorted(exact_dedup.slots(levels, keys).tolist()) == list(range(count))
    assert exact_dedup.slots(levels, r.integers(0, 2**63, (100, 4)).astype(np.uint64)).max() < 5000


def test_an_index_grows_with_deliveries(spark):
    first = exact_dedup.groups(exact_dedup.records(texts(spark, [(i, f"t{i}") for i in range(50)]), F.lit(0)))
    second = exact_dedup.groups(exact_dedup.records(texts(spark, [(100 + i, f"t {i}") for i in range(40, 60)]), F.lit(1)))
    index = exact_dedup.build_index(first)
    assert exact_dedup.lookup(second, index).filter("slot is not null").count() == 10
    after = exact_dedup.build_index(exact_dedup.settled(second, index))
    held = {bytes(r["digest"]): r["doc_id"] for r in exact_dedup.stored_entries(after).collect()}
    assert len(held) == 60 and held[hashlib.sha256(b"t45").digest()] == 145 and held[hashlib.sha256(b"t7").digest()] == 7
