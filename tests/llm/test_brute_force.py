"""The numeric kernels of the training-data operators against plain versions of the same definitions."""

import cmath
import collections
import math
import re
import time
import tracemalloc

import numpy as np
import pytest
from perimetra.llm import media, mixing, ngram_join, quality, secrets
from perimetra.llm import common
from pyspark.sql import functions as F

from tests.llm.test_operators import prose, shingle_set

TEXTS = [None, "", "   ", "one", "One TWO x9Y\ttwo two\n\ntwo lines\ntwo lines\n", "é日本 語é", "A,b;c! $x$ |a| a_b", "w" * 30 + " " + "z" * 21, "same same same other same", "\n\n", "tail\n", prose(300, 4)]


def plain_features(text):
    text = text or ""
    raw = text.encode()
    words = [w for w in re.split(rb"[ \t\r\n]+", raw) if w]
    lines = [x for x in raw.split(b"\n") if x]
    some, size = max(len(words), 1), max(len(raw), 1)
    kind = lambda chars: sum(c in chars for c in raw)
    low = [sum(97 <= c <= 122 for c in w) for w in words]
    up = [sum(65 <= c <= 90 for c in w) for w in words]
    symbols = b"!#$%&*+/<=>@[\\]^_`{}~"
    upper = sum(u > 1 and not x for u, x in zip(up, low))
    mixed = sum(u > 1 and x > 0 for u, x in zip(up, low))
    marked = sum(any(c in symbols for c in w) for w in words)
    same = sum(a == b for a, b in zip(words, words[1:]))
    run = longest = 1 if words else 0
    for a, b in zip(words, words[1:]):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    return [
        math.log1p(len(raw)), math.log1p(len(words)), sum(map(len, words)) / some, sum(len(w) > 20 for w in words) / some, upper / some, mixed / some,
        kind(b"0123456789") / size, kind(symbols) / size, kind(b".,;:'\"()-?") / size, kind(b" \t\r\n") / size, sum(c > 127 for c in raw) / size,
        same / some, math.log1p(longest), len(set(words)) / some, math.log1p(len(lines)), (len(lines) - len(set(lines))) / max(len(lines), 1), marked / some,
        math.log1p(marked), math.log1p(upper), math.log1p(same), math.log1p(kind(b"|")), max(collections.Counter(words).values(), default=0) / some,
    ]


@pytest.mark.parametrize("block", [1 << 17, 64])
def test_features_equal_plain_counts(monkeypatch, block):
    monkeypatch.setattr(common, "BLOCK", block)
    got = quality.features(TEXTS)
    assert np.allclose(got, [plain_features(t) for t in TEXTS], atol=1e-12)
    whole = common.words(TEXTS)
    monkeypatch.setattr(common, "BLOCK", 1 << 16)
    assert all((a == b).all() for a, b in zip(whole, common.words(TEXTS)))


def test_a_long_text_costs_a_small_multiple_of_itself():
    long = prose(200_000, 1) + " " + "x" * 3_000_000 + " " + prose(1_000_000, 2)
    size = len(long)
    for work, most in ((quality.features, 16), (common.shingles, 16), (lambda t: secrets.Scan(t).class_counts(), 12), (lambda t: media.all_peaks([media.padded(x)[0] for x in t]), 16)):
        tracemalloc.start()
        work([long])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most * size + 20e6, (work, peak / size)
    assert np.allclose(quality.features([long])[0], plain_features(long), atol=1e-12)


def plain_tree(g, h, leaves):
    spans = [(0, len(g))]
    gain = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + 1)
    for _ in range(leaves - 1):
        options = [(gain(a, k) + gain(k, b) - gain(a, b), -i, -k) for i, (a, b) in enumerate(spans) for k in range(a + 1, b)]
        best = max(options, default=(0, 0, 0))
        if best[0] <= 1e-9:
            break
        a, b = spans.pop(-best[1])
        spans += [(a, -best[2]), (-best[2], b)]
    out = [0.0] * len(g)
    for a, b in spans:
        out[a:b] = [sum(g[a:b]) / (sum(h[a:b]) + 1)] * (b - a)
    return out


def test_boosting_equals_a_plain_version(monkeypatch):
    monkeypatch.setattr(quality, "ROUNDS", 4)
    monkeypatch.setattr(quality, "PAIR_ROUNDS", 0)
    monkeypatch.setattr(quality, "PAIRS", 0)
    r = np.random.default_rng(0)
    x = r.normal(size=(120, 3))
    y = (x[:, 0] + np.sin(3 * x[:, 1]) + 0.3 * r.normal(size=120) > 0).astype(float)
    model = quality.fit(x, y)
    bins = [[sum(v >= e for e in model.edges[j]) for v in x[:, j]] for j in range(3)]
    logit, tables = [math.log(y.mean() / (1 - y.mean()))] * 120, [[0.0] * (len(e) + 1) for e in model.edges]
    for _ in range(4):
        for j in range(3):
            g, h = [0.0] * len(tables[j]), [0.0] * len(tables[j])
            for i in range(120):
                p = 1 / (1 + math.exp(-logit[i]))
                g[bins[j][i]] += y[i] - p
                h[bins[j][i]] += p * (1 - p)
            step = [quality.RATE * v for v in plain_tree(g, h, quality.LEAVES)]
            tables[j] = [a + b for a, b in zip(tables[j], step)]
            logit = [v + step[bins[j][i]] for i, v in enumerate(logit)]
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(model.tables, tables))
    assert np.allclose(model.score(x), [1 / (1 + math.exp(-v)) for v in logit], atol=1e-9)


def test_pairs_find_an_interaction():
    r = np.random.default_rng(1)
    x = r.uniform(-1, 1, size=(4000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9 and any({i, j} == {0, 1} for i, j, _ in model.pairs)


def test_rates_are_as_good_as_plain_nonnegative_least_squares(spark):
    r = np.random.default_rng(7)
    for goal, shares in (((0.6, 0.3, 0.1), ((20, 1, 1), (1, 20, 1), (1, 1, 20))), ((0.1, 0.1, 0.8), ((20, 2, 1), (2, 20, 1)))):
        p = np.concatenate([r.dirichlet(a, 60) for a in shares])
        n = r.integers(10, 100, len(p)).astype(float)
        table = spark.createDataFrame([(int(k), x.tolist()) for k, x in zip(n, p)], "n_tokens long, posterior array<double>")
        rates, got, aim, _ = mixing.solve(table, dict(zip(mixing.DOMAINS, goal)))
        a = (p * n[:, None]).T  # tokens of each domain are a @ rate
        rate, step = np.ones(len(p)), 1 / np.linalg.norm(a, 2) ** 2
        for _ in range(20_000):
            rate = np.maximum(rate - step * (a.T @ (a @ rate - aim)), 0)
        assert np.allclose(got, a @ rates.of(p))
        assert np.linalg.norm(got - aim) <= np.linalg.norm(a @ rate - aim) + 2e-3 * aim.sum()
        column = [x["r"] for x in table.select(rates.column("posterior").alias("r")).collect()]
        assert np.allclose(sorted(column), sorted(rates.of(p)), atol=1e-9)


def test_posteriors_equal_a_plain_classifier():
    texts = [prose(30, i) + (" zzbad" if i % 3 == 0 else "") for i in range(60)]
    domain = np.array([int(i % 3 == 0) for i in range(60)])
    _, x, present = mixing._profile(texts)
    table = np.zeros((mixing.HASHED, 3))
    for own, d in zip(present, domain):
        table[own, d] += 1
    model = mixing.DomainClassifier(np.bincount(domain, minlength=3), table)
    model.calibrate(x, model.top(present), domain)
    seen = [collections.Counter() for _ in mixing.DOMAINS]
    for own, d in zip(present, domain):
        seen[d].update(own.tolist())
    share = [(collections.Counter(domain.tolist())[d] + 0.5) / (60 + 1.5) for d in range(3)]
    for i in (0, 1, 17):
        odds = [[math.log((seen[d][s] + mixing.SHRINK * share[d]) / (sum(c[s] for c in seen) + mixing.SHRINK) / share[d]) for s in present[i].tolist()] for d in range(3)]
        inputs = [*np.clip((x[i] - x.mean(0)) / (x.std(0) + 1e-6), -5, 5), *(sum(sorted(o)[-3:]) for o in odds), 1.0]
        z = np.array(inputs) @ model.weights
        e = [math.exp(z[0]), math.exp(z[1]), 0.0]  # the third domain has no label
        assert np.allclose(model.posterior(x[i : i + 1], present[i : i + 1])[0], np.array(e) / sum(e), atol=1e-9)
    assert (model.posterior(x, present).argmax(1) == domain).mean() > 0.95


def test_spectrum_peaks_and_pairs_equal_plain_loops():
    raw, _ = media.padded(prose(400, 3))
    got, first = media.spectrogram([raw])
    frames = max(1, -(-(len(raw) - media.FRAME) // media.HOP) + 1)
    samples = list(raw) + [128] * media.FRAME
    assert got.shape == (frames, media._BINS) and first.tolist() == [0, frames]
    for f in (0, frames // 2, frames - 1):
        cut = [(samples[f * media.HOP + k] - 128) * (0.5 - 0.5 * math.cos(2 * math.pi * k / media.FRAME)) for k in range(media.FRAME)]
        for b in (1, 17, 64, 128):
            assert abs(got[f, b] - abs(sum(v * cmath.exp(-2j * math.pi * b * k / media.FRAME) for k, v in enumerate(cut)))) < 1e-6
    m, found = np.round(got, 6), []
    for f in range(frames):
        own = [b for b in range(1, media._BINS - 1) if m[f, b] > m[f, b - 1] and m[f, b] >= m[f, b + 1] and m[f, b] > 1e-3 and (f == 0 or m[f, b] >= m[f - 1, b]) and (f == frames - 1 or m[f, b] >= m[f + 1, b])]
        found += [(f, b) for b in sorted(sorted(own, key=lambda b: (-m[f, b], b))[: media.PEAKS_PER_FRAME])]
    frame, at = media.peaks(got, first)
    assert list(zip(frame.tolist(), at.tolist())) == found
    codes = sorted((f << 32) | (b << 20) | (c << 8) | (g - f) for k, (f, b) in enumerate(found) for g, c in found[k + 1 : k + 1 + media.FAN_OUT] if g - f <= media.MAX_GAP)
    assert media.fingerprints(frame, at, first)[0].tolist() == codes and len(codes) > 40


@pytest.mark.parametrize("block", [1, 2, 7, 64, 100_000])
def test_peaks_by_blocks_are_those_of_the_whole(monkeypatch, block):
    raw = [media.padded(t)[0] for t in ("", prose(3, 1), prose(700, 2), "é" * 900, prose(40, 3), "x", prose(90, 4))]
    frame, at = media.peaks(*(whole := media.spectrogram(raw)))
    monkeypatch.setattr(media, "BLOCK_FRAMES", block)
    got = media.all_peaks(raw)
    assert got[0].tolist() == frame.tolist() and got[1].tolist() == at.tolist() and got[2].tolist() == whole[1].tolist()
    assert [len(x) for x in media.all_peaks([])] == [0, 0, 1]


def test_a_long_text_of_many_spans_beyond_ascii_is_scanned_in_seconds():
    """In time that grows with the text: one pass for all its places."""
    part = "é deadbeefdeadbeefdeadbeef 日本 token=abc123def AKIA" + "A" * 16 + " "
    count = 100_000
    began = time.perf_counter()
    scan = secrets.Scan([part * count, "short é secret: abcdef1", None])
    took = time.perf_counter() - began
    assert len(scan.base[0]) == 3 * count and took < 40, took
    for k in (0, 1, count // 2, count - 1):
        own = scan.base[0][3 * k : 3 * k + 3]
        low = k * len(part)
        assert own == [("hex", low + 2, low + 26, "deadbeef" * 3), ("assign", low + 30, low + 45, "abc123def"), ("access", low + 46, low + 66, "AKIA" + "A" * 16)]
    assert scan.base[1] == [("assign", 8, 23, "abcdef1")]


def test_places_in_bytes_and_in_code_points_agree():
    text = "aé日😀-" * 50 + "end"
    scan = secrets.Scan([text, "plain", "é"])
    points = [0, 1, 2, 3, 4, 5, 100, 99, 249, len(text)]
    places = scan._bytes(0, points)
    assert all(len(text[:p].encode()) == places[p] for p in points)
    assert scan._points(0, np.array([places[p] for p in points])) == points


def plain_total(automaton, value):
    state, total = 0, 0.0
    for s in secrets._symbols(value).tolist():
        if state < 0:
            total += math.log(1e-4)
            continue
        total += automaton.cost[state, s]
        state = int(automaton.targets[state, s]) if s != secrets.END else -1
    return total


def test_automata_score_whole_values_like_a_plain_walk():
    r = np.random.default_rng(4)
    values = ["".join(r.choice(list("abcdefghij0123456789XYZ-_"), int(r.integers(6, 60)))) for _ in range(400)]
    automaton = secrets.infer(values)
    asked = values[:50] + ["", "x", "ab" * 300, "0" * 257, "a" * 600 + "0" * 10, "a" * 600 + "Z" * 10]
    assert np.allclose(automaton.totals(asked), [plain_total(automaton, v) for v in asked])
    loops = secrets.infer(["".join(r.choice(list("0123456789"), int(r.integers(300, 500)))) for _ in range(200)])
    long = ["1" * 512 + end for end in ("2" * 88, "2" * 89, "2" * 80 + "g" * 8)]
    assert len(set(loops.totals(long).tolist())) == 3


def test_short_and_digit_free_credentials_of_a_learned_format_are_added(spark):
    r = np.random.default_rng(6)
    short = lambda: "".join(r.choice(list("0123456789"), 4)) + "".join(r.choice(list("GHJKLMN"), 4))
    letters = lambda: "-".join("".join(r.choice(list("GHJKLMNPQRSTUVWXYZ"), 4)) for _ in range(4))
    rows = [(i, f"{prose(20, i)} password: {short() if i % 2 else letters()} {prose(5, i)}") for i in range(400)]
    bare = [short(), letters()]
    rows += [(1000 + i, f"é see {v}. {prose(30, i)}") for i, v in enumerate(bare)] + [(2000 + i, prose(200, 50 + i) + " Sentence-like Words, Numbers 12345678.") for i in range(50)]
    got = {x["doc_id"]: x for x in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, v in enumerate(bare):
        assert got[1000 + i]["spans"] == f"like_assign:6:{6 + len(v)}" and got[1000 + i]["n_added"] == 1
    assert all(got[2000 + i]["spans"] == "" for i in range(50))


def test_tokens_are_runs_without_base_spans_and_edges():
    scan = secrets.Scan(["key=VALUE123== .dots-inside.x9- password: abcdef12,rest_of_it", None, "é ünïabcdefg short"])
    assert [scan.value(k) for k in range(len(scan.start))] == ["VALUE123==", "dots-inside.x9", "rest_of_it", "abcdefg"]
    counts = collections.Counter(s for k in range(len(scan.start)) for s in secrets._symbols(scan.value(k)).tolist())
    assert scan.class_counts().tolist() == [counts[i] for i in range(secrets.SYMBOLS)]


def test_links_under_a_shared_doc_id_are_kept(spark):
    a, b = prose(80, 1), prose(80, 2)
    rows = [(1, a), (1, b), (2, b + " more"), (3, a + " more"), (None, a + " more"), (None, "alone " + prose(40, 3))]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    links = collections.defaultdict(list)
    for r in got:
        links[r["doc_id"]].append(r["n_links"])
    assert {k: sorted(v) for k, v in links.items()} == {1: [1, 2], 2: [1], 3: [2], None: [0, 2]}
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(1, a), (1, b), (0, rows[5][1])])


def test_shortening_goes_on_until_the_recall_is_met(spark, monkeypatch):
    texts = []
    for i in range(60):
        base = prose(70, 100 + i).split()
        texts += [" ".join(base), " ".join([*base[:35], "edited", *base[36:]])]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    depths, plain = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda d, c, depth, *a: depths.append(depth) or plain(d, c, depth, *a))
    got = ngram_join.ngram_join(rows, trees=3, max_depth=6, target_recall=0.999)
    sets = [shingle_set(t) for t in texts]
    want = sum(len(s & o) >= 0.8 * len(s | o) for s in sets for o in sets) - len(texts)
    assert got.agg(F.sum("n_links")).first()[0] == want > 100
    assert depths[0] == ngram_join.first_depth(0.8, 3, 6) and depths == list(range(depths[0], depths[-1] - 1, -1))
