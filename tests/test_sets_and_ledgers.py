"""Windows over frames, grids of suppression limits, split policies, proofs, recovery, stretches without rows."""

import hashlib

import numpy as np
import pytest
from perimetra.operators import datasets, evaluation, events, evidence, ranging, stateful, tracks, windows
from perimetra.sources import readers
from perimetra.sources.store import settled
from pyspark.sql import functions as F

# windows

DETECTION = "image long, id long, cls int, score double, x1 double, y1 double, x2 double, y2 double, window struct<x1:double,y1:double,x2:double,y2:double>"


def detections(spark, *rows):
    """rows: window or None, box, score, class."""
    return spark.createDataFrame([(1, i, c, float(s), *map(float, box), None if w is None else tuple(map(float, w))) for i, (w, box, s, c) in enumerate(rows)], DETECTION)


def merged(spark, *rows, **options):
    got = windows.merged(detections(spark, *rows), 1920, 1080, **({"full_score": 0.1, "iou": 0.5} | options))
    return {r["id"]: (r["x1"], r["y1"], r["x2"], r["y2"], r["windowed"]) for r in got.collect()}


def test_windows_cover_a_band():
    grid = windows.cover(1920, 1080, grid=(3, 2))
    assert len(grid) == 6 and min(w[0] for w in grid) == min(w[1] for w in grid) == 0 and max(w[2] for w in grid) == 1920 and max(w[3] for w in grid) == 1080
    assert windows.cover(640, 640) == []
    strip = windows.cover(1920, 1080, band=(0.0, 0.55))
    assert {(w[1], w[3]) for w in strip} == {(0, 594)} and strip[0][0] == 0 and strip[-1][2] == 1920
    assert all(b[0] < a[2] for a, b in zip(strip, strip[1:]))


def test_a_cut_box_goes_where_a_whole_one_covers_it(spark):
    at = (640, 0, 1280, 640)
    half = (at, (641, 100, 700, 300), 0.8, 0)
    assert set(merged(spark, (None, (600, 100, 700, 300), 0.9, 0), half, (at, (900, 100, 960, 220), 0.7, 0), iou=0.9)) == {0, 2}
    assert set(merged(spark, half)) == {0}  # nothing covers it
    assert set(merged(spark, (None, (600, 100, 700, 300), 0.5, 0), half, covered=0.0, iou=0.9)) == {0, 1}
    assert set(merged(spark, (None, (600, 100, 700, 300), 0.5, 1), half, iou=0.9)) == {0, 1}  # of another class
    assert set(merged(spark, (None, (690, 100, 800, 300), 0.5, 0), half, iou=0.9)) == {0, 1}  # covers too little
    far = (at, (1278, 500, 1279.5, 530), 0.8, 0)
    assert set(merged(spark, far)) == set()  # less than two pixels across


def test_only_edges_within_the_frame_cut(spark):
    cut = detections(spark, ((640, 0, 1280, 640), (641, 100, 700, 200), 1, 0), ((640, 0, 1280, 640), (800, 100, 900, 200), 1, 0), ((640, 0, 1280, 640), (1100, 0, 1200, 100), 1, 0), (None, (0, 0, 50, 50), 1, 0))
    assert [r[0] for r in cut.orderBy("id").select(windows.cut_by_window(1920, 1080)).collect()] == [True, False, False, False]


def test_scores_by_pass_classes_apart_and_clipping(spark):
    got = merged(spark, (None, (0, 0, 50, 50), 0.2, 0), (None, (0, 0, 50, 50), 0.3, 2), ((0, 0, 640, 640), (300, 300, 340, 360), 0.3, 0), window_score=0.4)
    assert set(got) == {0, 1} and not any(v[4] for v in got.values())
    got = merged(spark, (None, (1900, 1000, 1935, 1083.5), 0.9, 0), (None, (-6, -4, 40, 90), 0.8, 0))
    assert got == {0: (1900.0, 1000.0, 1920.0, 1080.0, False), 1: (0.0, 0.0, 40.0, 90.0, False)}
    assert len(merged(spark, *[(None, (10 * i, 0, 10 * i + 8, 20), 0.5 + i / 100, 0) for i in range(9)], most=4)) == 4


# suppression for several limits at once


@pytest.mark.parametrize("most", [300, 5])
def test_limits_of_one_pass_are_those_of_a_pass_each(spark, most):
    r = np.random.default_rng(6)
    rows = [(k, i, *(p := r.uniform(0, 60, 2)).tolist(), *(p + r.uniform(10, 40, 2)).tolist(), round(float(r.random()), 2)) for k in range(6) for i in range(40)]
    boxes = spark.createDataFrame(rows, "image long, id long, x1 double, y1 double, x2 double, y2 double, score double")
    limits = [0.05, 0.2, 0.5, 0.8]
    grid = {(x["image"], x["id"]): set(x["limits"]) for x in stateful.nms_grid(boxes, ["image"], limits, most).collect()}
    for limit in limits:
        own = {(x["image"], x["id"]) for x in stateful.nms(boxes, ["image"], limit, most).collect()}
        assert own == {k for k, v in grid.items() if limit in v}


def test_the_best_point_goes_by_each_key_in_turn(spark):
    points = spark.createDataFrame([("a", 0.5, 0.1, 3), ("a", 0.5, 0.2, 1), ("a", 0.4, 0.3, 0), ("b", 0.1, 0.1, 9)], "cls string, f1 double, limit double, fp int")
    got = evaluation.best_point(points, [-F.col("f1"), F.col("fp")]).orderBy("cls").collect()
    assert [(r["cls"], r["limit"]) for r in got] == [("a", 0.2), ("b", 0.1)]


# splits

ROW = "source string, sequence_key string, official string, image string, seq long, hash long"


def test_split_policies_and_their_errors(spark):
    rows = [("a", f"a/{i % 10}", "train" if i % 10 < 8 else "test", f"i{i}", i, None) for i in range(100)]
    rows += [("b", f"b/{i % 20}", None, f"j{i}", i, None) for i in range(200)]
    df = spark.createDataFrame(rows, ROW)
    policies = {"a": datasets.SplitPolicy("official", {"train": "train", "test": "test"}, ("train", 0.25)), "b": datasets.SplitPolicy("resplit", val=0.1, test=0.2)}
    split = datasets.split_by_policy(df, policies, "seed")
    n = {}
    for r in split.collect():
        assert r["problem"] is None
        n[r["source"], r["split"]] = n.get((r["source"], r["split"]), 0) + r["n"]
    assert n == {("a", "train"): 60, ("a", "val"): 20, ("a", "test"): 20, ("b", "val"): 20, ("b", "test"): 40, ("b", "train"): 140}
    assert {tuple(r) for r in split.collect()} == {tuple(r) for r in datasets.split_by_policy(df.repartition(7), policies, "seed").collect()}
    assert datasets.assigned(split).count() == 30
    torn = df.unionByName(spark.createDataFrame([("a", "a/1", "test", "x", 999, None), ("c", "c/1", "train", "y", 1000, None)], ROW))
    bad = {(r["sequence_key"], r["problem"]) for r in datasets.split_by_policy(torn, policies, "seed").filter("problem is not null").collect()}
    assert bad == {("a/1", "spans official splits"), ("c/1", "no policy")}
    with pytest.raises(Exception, match="spans official splits|no policy"):
        datasets.assigned(datasets.split_by_policy(torn, policies, "seed")).collect()
    with pytest.raises(ValueError):
        datasets.split_by_policy(df, {"a": datasets.SplitPolicy("other")}, "seed")


def test_pseudo_sequences_follow_near_hashes(spark):
    rows = [("a", None, "t", "i0", 0, 0), ("a", None, "t", "i1", 1, 0b111), ("a", None, "t", "i2", 2, (1 << 20) - 1), ("b", None, "t", "i3", 3, 1), ("a", "known", "t", "i4", 4, 0), ("a", None, "t", "i5", 5, None)]
    got = datasets.pseudo_sequences(spark.createDataFrame(rows, ROW), 6).orderBy("seq").collect()
    assert [r["sequence_key"] for r in got] == ["a/pseudo/0", "a/pseudo/0", "a/pseudo/2", "b/pseudo/3", "known", "a/orphan/i5"]


# proofs


@pytest.mark.parametrize("halvings", [10, 2])
def test_proofs_of_whole_groups(spark, monkeypatch, halvings):
    monkeypatch.setattr(evidence, "HALVINGS", halvings)
    sizes = [1, 2, 3, 4, 5, 7, 16, 17, 21] + ([1025] if halvings == 10 else [])
    rows = [(n, i, f"{n * 10_000 + i:064x}") for n in sizes for i in range(n)]
    df = spark.createDataFrame(rows, "g long, place long, hash string")
    made = evidence.inclusion_proofs(df.repartition(5), ["g"])
    got = made.withColumn("ok", evidence.proven(made)).collect()
    roots = {r["g"]: r["root"] for r in evidence.merkle_root(df, ["g"]).collect()}
    assert len(got) == len(rows)
    for r in got:
        hashes = [f"{r['g'] * 10_000 + i:064x}" for i in range(r["g"])]
        assert r["ok"] and r["leaves"] == r["g"] and r["hash"] == hashes[r["index"]] and r["root"] == roots[r["g"]]
        if r["g"] <= 21:
            assert list(r["proof"]) == evidence.inclusion_proof(hashes, r["index"])
    other = made.withColumn("hash", F.sha2("hash", 256))
    assert other.filter(evidence.proven(other)).count() == 0


def test_paths_are_not_written_on_their_way_to_the_proofs(spark, monkeypatch):
    written = []
    monkeypatch.setattr(evidence, "settled", lambda df: written.append(df) or settled(df))
    n = 12_000
    hashes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    leaves = spark.createDataFrame([("g", i, h) for i, h in enumerate(hashes)], "g string, place long, hash string")
    made = evidence.inclusion_proofs(leaves, ["g"])
    assert written and not [df.columns for df in written if any(kind.startswith(("array", "struct")) for _, kind in df.dtypes)]
    assert made.filter(evidence.proven(made)).count() == n
    own = {r["index"]: list(r["proof"]) for r in made.filter("index in (0, 1023, 1024, 11999)").collect()}
    assert own == {i: evidence.inclusion_proof(hashes, i) for i in (0, 1023, 1024, 11999)}


def test_proofs_cut_short_or_of_other_words_do_not_stand(spark):
    hashes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(5)]
    proof = evidence.inclusion_proof(hashes, 1)
    root = evidence.merkle_root(spark.createDataFrame([("g", i, h) for i, h in enumerate(hashes)], "g string, place long, hash string"), ["g"]).first()["root"]
    rows = [(hashes[1], proof, 1), (hashes[1], proof[:-1], 1), (hashes[1], [*proof, proof[0]], 1), (hashes[1], [], 1), (hashes[1], proof, 0), (hashes[1], proof, 5)]
    odd = [(hashes[1], [proof[0][:62], *proof[1:]], 1), (hashes[1], proof, 1)]
    for given, stands in ((rows, [True] + [False] * 5), (odd, [False, True])):
        df = spark.createDataFrame([(i, *r, 5, root) for i, r in enumerate(given)], "i long, hash string, proof array<string>, index long, leaves long, root string").coalesce(1)
        assert [r["ok"] for r in df.select("i", evidence.proven(df).alias("ok")).orderBy("i").collect()] == stands


# recovery


def test_gaps_of_every_way_to_start(spark):
    boots = spark.createDataFrame([(d, 1, 100) for d in range(8)], "device long, boot int, at long")
    markers = spark.createDataFrame([(1, "stopped", 80, 81), (2, "running", 80, None), (3, "stopped", 80, 81), (4, "unreadable", None, None), (5, "stopped", 80, 130), (6, "running", 80, None)], "device long, state string, last_alive long, stopped_at long")
    heads = spark.createDataFrame([(1, 7, 70), (2, 7, 90), (3, 7, 70), (4, 7, 60), (7, 4, 50)], "device long, last_n long, last_sealed long")
    torn = spark.createDataFrame([(3, "ledger", 12), (6, "gaps", 5)], "device long, log string, bytes long")
    pending = spark.createDataFrame([(2, "c1"), (2, "c2")], "device long, clip string")
    got = {r["device"]: (r["kind"], r["start"], r["after_n"], r["reason"]) for r in evidence.recovered(boots, markers, heads, pending, torn).collect()}
    assert got == {
        1: ("restart", 81, 7, "restart after a clean shutdown"),
        2: ("power loss", 90, 7, "no clean shutdown; 2 unsealed clips set aside"),
        3: ("power loss", 80, 7, "no clean shutdown; ledger tail of 12 bytes set aside"),
        4: ("power loss", 60, 7, "no clean shutdown"),
        5: ("restart", 100, 0, "restart after a clean shutdown"),  # its clock went back
        6: ("power loss", 80, 0, "no clean shutdown; gap log tail of 5 bytes set aside"),
        7: ("power loss", 50, 4, "no run marker"),
    }  # 0 starts for the first time


def test_a_recovery_that_is_run_again_logs_nothing_twice(spark):
    empty = spark.createDataFrame([], "device long, boot int, kind string, start long, end long, after_n long, reason string, n long, prev_block_hash string, block_hash string")
    gap = lambda d, b, t: (d, b, "restart", t, t + 5, 3, "r")
    new = lambda *rows: spark.createDataFrame(list(rows), "device long, boot int, kind string, start long, end long, after_n long, reason string")
    log = spark.createDataFrame(evidence.log_gaps(empty, new(gap(1, 1, 10), gap(2, 1, 20))).select(empty.columns).collect(), empty.schema)
    assert evidence.log_gaps(log, new(gap(1, 1, 10), gap(2, 1, 20))).count() == 0
    more = evidence.log_gaps(log, new(gap(1, 1, 10), gap(1, 2, 40), gap(1, 3, 60), gap(3, 1, 5))).select(empty.columns)
    whole = log.unionByName(more)
    assert sorted((r["device"], r["boot"], r["n"]) for r in whole.collect()) == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 1), (3, 1, 1)]
    checked = evidence.verify(whole.withColumn("sealed_at", F.col("end")), evidence.chain_hash(evidence.GAP_FIELDS, "gap/1"), ["device"])
    assert checked.filter("not ok").count() == 0
    altered = whole.withColumn("reason", F.when(F.col("boot") == 2, "other").otherwise(F.col("reason"))).withColumn("sealed_at", F.col("end"))
    assert sorted((r["device"], r["n"]) for r in evidence.verify(altered, evidence.chain_hash(evidence.GAP_FIELDS, "gap/1"), ["device"]).filter("not ok").collect()) == [(1, 2), (1, 3)]


def test_a_day_has_one_root_for_good(spark, tmp_path):
    roots = lambda **days: spark.createDataFrame([(d.replace("_", "-")[1:], r) for d, r in days.items()], "day string, root string")
    store, mirror = str(tmp_path / "store"), f"file://{tmp_path}/mirror"
    status = lambda df: {r["day"]: r["status"] for r in df.collect()}
    assert status(evidence.publish_roots(roots(d2024_01_01="aa", d2024_01_02="bb"), store)) == {"2024-01-01": "sealed", "2024-01-02": "sealed"}
    assert status(evidence.publish_roots(roots(d2024_01_01="aa", d2024_01_02="cc", d2024_01_03="dd"), store)) == {"2024-01-01": "held", "2024-01-02": "conflict", "2024-01-03": "sealed"}
    assert status(evidence.publish_roots(roots(d2024_01_02="bb"), store)) == {"2024-01-02": "held"}  # the first stayed
    assert status(evidence.publish_roots(roots(d2024_01_01="zz"), mirror)) == {"2024-01-01": "sealed"}
    with pytest.raises(ValueError):
        evidence.publish_roots(roots(d2024_01_01="aa", d2024_01_02="bb"), store, 1)


# stretches without rows


@pytest.mark.parametrize("margin", [0, 1, 2])
def test_stretches_at_both_ends_and_of_silent_keys(spark, margin):
    seen = {1: [3, 4, 9, 15], 2: [0, 19], 3: [], 4: [-4, 25, 10]}
    spans = spark.createDataFrame([(k, 0, 19) for k in seen], "k long, first long, last long")
    rows = spark.createDataFrame([(k, u) for k, us in seen.items() for u in us], "k long, unit long")
    got = sorted(tuple(r) for r in ranging.empty_windows(rows.union(rows), ["k"], spans, margin).collect())
    want = []
    for k, us in seen.items():
        free = [u for u in range(20) if all(abs(u - b) > margin for b in us)]
        while free:
            end = free[0]
            while end + 1 in free:
                end += 1
            want.append((k, free[0], end + 1, end + 1 - free[0]))
            free = [u for u in free if u > end]
    assert got == sorted(want)


# exact choices by counts


@pytest.mark.parametrize("digits", [1, 4])
def test_first_of_is_the_head_of_the_shuffled_order(spark, monkeypatch, digits):
    monkeypatch.setattr(datasets, "ORDER_DIGITS", digits)
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"), (F.col("id") % 7 == 0).alias("small"))
    wants = spark.createDataFrame([(0, 0), (1, 137), (2, 5000)], "g long, want long")
    got = {g: {r["v"] for r in datasets.first_of(rows, wants, ["g"], "s", F.col("v"), F.col("small")).filter(F.col("g") == g).collect()} for g in range(3)}
    ranked = rows.filter("g = 1").orderBy(~F.col("small"), datasets.shuffle_key("s", F.col("v")), "v").limit(137)
    assert got[0] == set() and got[1] == {r["v"] for r in ranked.collect()} and len(got[2]) == 1000


def test_tile_plan_fills_either_side(spark):
    make = lambda ir, others: spark.createDataFrame([(i, "lwir" if i < ir else "visible", 0, 0, 1, i % 4 == 0) for i in range(ir + others)], "image long, modality string, ox int, oy int, n_boxes long, small boolean")

    def share(ir, others, budget):
        got = datasets.tile_plan(make(ir, others), budget, 0.35).collect()
        return sum(r["modality"] == "lwir" for r in got), sum(r["modality"] != "lwir" for r in got), sum(r["small"] for r in got)

    assert share(100, 100, 100) == (35, 65, 50)  # small ones first: all 25 of each side
    assert share(10, 100, 100)[:2] == (10, 90) and share(100, 10, 100)[:2] == (90, 10) and share(5, 6, 100)[:2] == (5, 6) and share(0, 0, 10)[:2] == (0, 0)


def test_strip_windows_of_thin_strips_and_small_frames(spark):
    frames = spark.createDataFrame([("a", 1920, 1080), ("b", 1000, 2000), ("c", 600, 2000), ("d", 640, 640), ("e", 2000, 700)], "image string, width int, height int")
    places = {}
    for r in datasets.strip_windows(frames, 640, 0.2, 0.0, 0.4).collect():
        places.setdefault(r["image"], set()).add((r["ox"], r["oy"]))
    assert places["a"] == {(0, 0), (512, 0), (1024, 0), (1280, 0)}  # the strip of 432 is thinner than a tile
    assert places["b"] == {(0, 0), (360, 0), (0, 160), (360, 160)} and places["d"] == {(0, 0)} and "c" not in places
    assert {oy for _, oy in places["e"]} == {0}
    low = datasets.strip_windows(frames.filter("image = 'e'"), 640, 0.2, 0.5, 0.9)
    assert low.count() == 0  # no room below the strip's top


def test_negatives_are_filled_by_others_and_then_by_tiles(spark):
    candidates = spark.createDataFrame([(f"i{k}", "animal" if k < 3 else "road") for k in range(13)], "image string, category string")
    empty = spark.createDataFrame([(f"t{k // 2}", k, 0) for k in range(20)], "image string, ox int, oy int")
    count = lambda target, **o: {k: v for k, v in datasets.filled_negatives(candidates, empty, target, {"animal": 0.5, "road": 0.5}, "s", **o).groupBy("origin").count().collect()}
    assert datasets.negatives_wanted(90, 0.1) == 10
    assert count(6) == {"quota": 6} and count(10) == {"quota": 8, "redistributed": 2} and count(20) == {"quota": 13, "tile": 7}
    assert count(40) == {"quota": 13, "tile": 10} and count(40, per_frame=2) == {"quota": 13, "tile": 20} and count(0) == {}


# field summaries, groups within verdicts, metres


def test_nearest_pairs_first_and_warm_up_left_out(spark):
    truth = spark.createDataFrame([(1, "p", 1, 5.0), (1, "p", 2, 10.0), (1, "p", 3, 11.0), (1, "v", 4, 50.0), (2, "p", 5, 9.0)], "camera_id long, cls string, id long, t double")
    found = spark.createDataFrame([(1, 100, 5.0), (1, 101, 10.6), (1, 102, 80.0), (2, 103, 9.0)], "camera_id long, id long, t double")
    warm = spark.createDataFrame([(1, 6.0)], "camera_id long, ready double")
    assert sorted(tuple(r) for r in stateful.match_nearest(truth, found, ["camera_id"], 2.0).select("truth_id", "found_id").collect()) == [(1, 100), (3, 101), (5, 103)]
    got = {r["cls"]: r for r in evaluation.field_summary(truth, found, ["camera_id"], 2.0, warm=warm).collect()}
    assert (got["p"]["n"], got["p"]["detected"], got["p"]["missed"], got["p"]["extra"]) == (2, 1, 1, 2) and got["v"]["verdict"] == "fails" and set(got) == {"p", "v"}
    fates = spark.createDataFrame([(0.0, 0.01, 5), (0.03, 0.2, 5), (0.0, 0.4, 5), (0.0, 1.0, 0)], "low double, high double, n int")
    assert [r[0] for r in fates.select(evaluation.miss_verdict(F.col("low"), F.col("high"), F.col("n"))).collect()] == ["meets", "fails", "not shown", "none to miss"]


def test_the_group_rule_joins_its_members_verdicts(spark):
    verdicts = spark.createDataFrame([(1, 1, "loitering", "stayed 4 s", 1), (1, 2, "", "", 0), (1, 3, "", "", 0)], "camera_id long, track_id long, rule_fired string, reason string, n_rules long")
    groups = spark.createDataFrame([(["1|1", "1|2"], 5.0, 7.9), (["1|1", "1|9"], 2.0, 3.0)], "members array<string>, first_at double, duration double")
    got = [tuple(r)[1:] for r in tracks.with_groups(verdicts, groups).orderBy("track_id").collect()]
    assert got == [(1, "loitering + group formed", "stayed 4 s; in a group of 2 for 3 s; in a group of 2 for 7 s", 2), (2, "group formed", "in a group of 2 for 7 s", 1), (3, "", "", 0)]


def test_loitering_by_metres_where_there_is_a_plane(spark):
    feats = spark.createDataFrame([(1, 1, 5.0, 100.0, 0.0, 0.0), (1, 2, 5.0, 40.0, 0.0, 0.0), (2, 3, 5.0, 80.0, 0.0, 0.0), (2, 4, 5.0, 100.0, 0.0, 0.0), (1, 5, 1.0, 1.0, 0.0, 0.0)], "camera_id long, track_id long, dwell double, net double, x0 double, y0 double")
    planes = spark.createDataFrame([(1, [0.05, 0.0, 0.0, 0.0, 0.05, 0.0, 0.0, 0.0, 1.0])], "camera_id long, homography array<double>")
    held = lambda *a: [(r["track_id"], r["net_m"] and round(r["net_m"], 6), r["unit"]) for r in tracks.loitering(feats, 3.0, 90.0, *a).orderBy("track_id").collect()]
    assert held(3.0, planes) == [(2, 2.0, "m"), (3, None, "px")] and held(None, planes) == [(2, 2.0, "px"), (3, None, "px")] and held() == [(2, None, "px"), (3, None, "px")]


# formats and logs


def test_word_boxes_and_track_lines(spark):
    lines = spark.createDataFrame([("a", "% bbGt version=3"), ("a", "class x y w h"), ("a", "Person 10 20 30.5 40 0 0 0 0 0 0"), ("a", "person 1 2 x 4"), ("b", "cyclist 5 6"), ("b", "  "), ("b", "people 1 1 2 2")], "image string, line string")
    good, bad = readers.word_boxes(lines)
    assert sorted(map(tuple, good.collect())) == [("a", "person", 10.0, 20.0, 40.5, 60.0), ("b", "people", 1.0, 1.0, 3.0, 3.0)] and bad.count() == 2
    tracks_of = spark.createDataFrame([("c", "- { geom: {'g0': '10 20 30.5 40', 'id0': 4, 'id1': 7, 'keyframe': True, 'ts0': 12}}"), ("c", "- { meta: none }"), ("c", "'g0': '1 2 3', 'id1': 1, 'ts0': 2")], "clip string, line string")
    assert [tuple(r) for r in readers.geometry_lines(tracks_of).collect()] == [("c", 7, 12, 10.0, 20.0, 30.5, 40.0)]
    types = spark.createDataFrame([("c", "- { types: {'cset3': {'person': 0.7, 'vehicle': 0.3}, 'id1': 7}}"), ("c", "- { types: {'cset3': {vehicle: 1.0}, 'id1': 8}}"), ("c", "- { meta: none }")], "clip string, line string")
    assert sorted(tuple(r) for r in readers.type_lines(types).collect()) == [("c", 7, "person"), ("c", 8, "vehicle")]


def test_training_summary(spark):
    log = spark.createDataFrame([(1.0, "a", 0.2, 10.0), (2.0, "a", 0.5, 30.0), (2.0, "b", 0.5, 20.0), (3.0, "b", None, None), (None, None, 0.9, 40.0)], "epoch double, session string, fitness double, seconds double")
    assert tuple(readers.training_summary(log).first()) == (5, 1, 3, 2, 2, 30.0, 100 / 3600, [2])
    assert tuple(readers.training_summary(log.select("epoch").limit(0)).first()) == (0, None, None, 0, None, None, None, [])


def test_letterbox_of_wide_and_tall_frames(spark):
    from perimetra.functions import geometry as g

    frames = spark.createDataFrame([(1920, 1080), (640, 512), (300, 900)], "w int, h int")
    scale, left, top = g.letterbox(F.col("w"), F.col("h"))
    assert [(round(r[0], 6), r[1], r[2]) for r in frames.select(scale, left, top).collect()] == [(round(640 / 1920, 6), 0.0, 140.0), (1.0, 0.0, 64.0), (round(640 / 900, 6), 213.0, 0.0)]
    w, h = g.working_size(F.col("w"), F.col("h"))
    assert [tuple(r) for r in frames.select(w, h).collect()] == [(640, 360), (640, 512), (300, 900)]
    box = tuple(F.lit(v) for v in (10.0, 20.0, 100.0, 200.0))
    back = g.out_of_letterbox(g.into_letterbox(box, F.col("w"), F.col("h")), F.col("w"), F.col("h"))
    for r in frames.select(*back).collect():
        assert np.allclose(list(r), [10, 20, 100, 200])


def test_folder_frames_in_natural_order(spark, tmp_path):
    for cam, names in (("c1", ["f10.jpg", "f2.JPG", "f1.png", "notes.txt"]), ("c2", ["b.png", "a10x2.png", "a10x10.png", "a9.png"])):
        (tmp_path / cam).mkdir()
        for n in names:
            (tmp_path / cam / n).write_bytes(b"x")
    got = [(r["camera_id"], r["seq"], r["t"], r["path"].rsplit("/", 1)[1]) for r in readers.folder_frames(spark, str(tmp_path), 2.0).orderBy("camera_id", "seq").collect()]
    assert got == [("c1", 0, 0.0, "f1.png"), ("c1", 1, 0.5, "f2.JPG"), ("c1", 2, 1.0, "f10.jpg"), ("c2", 0, 0.0, "a9.png"), ("c2", 1, 0.5, "a10x2.png"), ("c2", 2, 1.0, "a10x10.png"), ("c2", 3, 1.5, "b.png")]


def test_alerts_show_what_an_event_knows(spark):
    full = '{"event_id":"12345678-90ab-4def-8123-456789abcdef","camera_id":"c1","captured_at":"2024-05-06T07:08:09Z","stage":"sealed","detection":{"track_id":4,"class":"two_wheeler","channel_scores":{"appearance":0.5,"motion":0.7},"threshold":0.6},"rule":{"fired":["a","b"]},"explanation":{"text":"said"},"anpr":{"text":"BA1"},"evidence":{"evidence_id":"e1","clip_sha256":"0123456789abcdef0123"},"confidence":61}'
    bare = '{"event_id":"x","camera_id":"c2","captured_at":"bad","stage":"other","detection":{"class":"bird","threshold":0.0},"confidence":5}'
    got = events.alerts_of(spark.createDataFrame([(1, full), (2, bare), (3, "[1]"), (4, None)], "k int, raw string")).orderBy("k").collect()
    assert len(got) == 2
    assert tuple(got[0][c] for c in ("alert_id", "camera", "stage", "at", "reason", "plate", "hash", "appearance", "motion")) == ("A1234567890ab4def", "c1", "sealed", "07:08:09", "said", "BA1", "01234567…ef0123", False, True)
    assert got[0]["more"] == '{"track_id":4,"channel_scores":{"appearance":0.5,"motion":0.7},"rule_fired":"a + b","evidence_id":"e1"}'
    assert tuple(got[1][c] for c in ("stage", "at", "reason", "plate", "hash", "appearance", "motion", "more")) == (None, None, "Object flagged on c2; appearance and motion channels agree at 5% confidence.", None, "pending…", True, True, "{}")


@pytest.mark.parametrize("block", ["64", "134217728"])
def test_lines_are_numbered_over_blocks_and_torn_tails_told(spark, tmp_path, block):
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        texts = {"whole.jsonl": [f'{{"n":{i},"k":"é{"x" * (i % 40)}"}}' for i in range(60)], "torn.jsonl": ['{"n":100}', "", "not json", '{"n":101}\r', '{"n":10'], "one.jsonl": ['{"n":2']}
        (tmp_path / "whole.jsonl").write_text("\n".join(texts["whole.jsonl"]) + "\n")
        for name in ("torn.jsonl", "one.jsonl"):
            (tmp_path / name).write_bytes("\n".join(texts[name]).encode())
        (tmp_path / "empty.jsonl").write_text("")
        got = {(r["path"].rsplit("/", 1)[1], r["n"]): (r["line"], r["torn"]) for r in readers.numbered_lines(spark, str(tmp_path)).collect()}
        assert got == {(name, i): (line, name != "whole.jsonl" and i == len(own) - 1) for name, own in texts.items() for i, line in enumerate(own)}
        blocks, problems, torn = readers.ledger(spark, str(tmp_path), "n long")
        assert sorted(r["n"] for r in blocks.collect()) == [*range(60), 100, 101] and [(r["n"], r["line"]) for r in problems.collect()] == [(2, "not json")] and sorted(r["line"] for r in torn.collect()) == ['{"n":10', '{"n":2']
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("digits", [1, 4])
def test_carving_takes_the_head_of_the_shuffled_order(spark, monkeypatch, digits):
    import hashlib

    monkeypatch.setattr(datasets, "ORDER_DIGITS", digits)
    rows = [(f"s{i}", 1 + i * 7 % 13, "a" if i % 3 else None) for i in range(90)]
    df = spark.createDataFrame(rows, "sequence_key string, n long, source string")
    for by, share in (((), 0.3), (("source",), 0.5)):
        want = set()
        for group in {None} if not by else {r[2] for r in rows}:
            own = sorted((hashlib.sha256(f"x:{k}".encode()).hexdigest(), k, n) for k, n, s in rows if not by or s == group)
            total, held = sum(n for *_, n in own), 0
            for _, k, n in own:
                if held < share * total:
                    want.add(k)
                held += n
        got = datasets.carve(df.repartition(4), share, "x", by=by)
        assert got.columns == ["sequence_key", "n", "source", "carved"] and got.count() == 90
        assert {r["sequence_key"] for r in got.filter("carved").collect()} == want
