"""Golden fixtures and invariants of the core operators."""

import hashlib
import itertools
import os
import re
from functools import partial

import numpy as np
import pytest
from perimetra.functions import homography, stats, text, timeutil
from perimetra.operators import calibration, camera_state, datasets, evaluation, evidence, grouping, ranging, search, serving, stateful, tracker, tracks, validate
from pyspark.sql import functions as F

WAYPOINTS = {
    1: ([50, 294], 3.5, ""), 2: ([600, 449], 1.4, "wrong direction"), 3: ([700, 510], 1.6, "wrong direction"), 4: ([200, 516], 4.8, "fence crossed"), 5: ([500, 401], 1.0, "wrong direction"),
    6: ([300, 254, 344, 370], 5.0, "fence crossed + loitering"), 9: ([250, 412], 4.7, "fence crossed"), 12: ([100, 97, 103], 1.2, ""), 26: ([200, 227, 222], 0.7, ""), 28: ([150, 184], 0.5, ""),
}
POINT = "camera_id long, track_id long, seq long, t double, x double, y double"


def _points(spark, ways):
    rows = []
    for track, (xs, dwell) in ways.items():
        for i, x in enumerate(xs):
            rows.append((1, track, len(rows), 1000.0 + dwell * i / (len(xs) - 1), float(x), 500.0))
    return spark.createDataFrame(rows, POINT)


@pytest.fixture(scope="module")
def points(spark):
    return _points(spark, {k: v[:2] for k, v in WAYPOINTS.items()})


@pytest.fixture(scope="module")
def segments(spark):
    return spark.createDataFrame([(1, "line", 0, 320.0, 0.0, 320.0, 1000.0, None)], "camera_id long, fence string, segment int, ax double, ay double, bx double, by double, only string")


def test_ten_tracks_give_the_published_verdicts(spark, points, segments):
    feats = tracks.features(points)
    flow = _points(spark, {i: ([100, 160], 2.0) for i in range(6)} | {10 + i: ([700, 640], 2.0) for i in range(4)})
    base = tracks.learn_baseline(tracks.features(flow))
    b = base.first()
    assert (round(b["baseline"], 6) % 360, b["with_flow"], b["against_flow"]) == (0.0, 6, 4)
    hits = [("fence crossed", tracks.fence_crossings(points, segments), F.lit("fence")), ("loitering", tracks.loitering(feats), F.lit("stay")), ("wrong direction", tracks.wrong_direction(feats, base), F.lit("way"))]
    got = {r["track_id"]: r["rule_fired"] for r in tracks.verdicts(feats, hits).collect()}
    assert got == {k: v[2] for k, v in WAYPOINTS.items()}


def test_point_on_the_fence_counts_once_and_a_touch_does_not(spark, segments):
    got = tracks.fence_crossings(_points(spark, {1: ([300, 320, 340], 2.0), 2: ([300, 320, 300], 2.0), 3: ([340, 300], 1.0)}), segments).collect()
    assert {(r["track_id"], r["t"], r["direction"]) for r in got} == {(1, 1002.0, "in"), (3, 1001.0, "out")}


def test_features_of_one_point_and_of_no_elapsed_time(spark):
    rows = spark.createDataFrame([(1, 1, 0, 5.0, 1.0, 2.0), (1, 2, 1, 5.0, 0.0, 0.0), (1, 2, 2, 5.0, 3.0, 4.0)], POINT)
    got = {r["track_id"]: r for r in tracks.features(rows).collect()}
    assert got[1]["net"] == got[1]["path"] == got[1]["vx"] == 0 and got[2]["net"] == got[2]["path"] == 5 and got[2]["vx"] == 0


def test_groups_need_members_and_time(spark):
    rows = [(1, k, k * 100 + i, float(i), i * 2.0 + k, 0.0) for k in range(4) for i in range(12)] + [(1, 9, 999 + i, float(i), 500.0, 0.0) for i in range(12)]
    got = grouping.groups(spark.createDataFrame(rows, POINT), radius=5.0).collect()
    assert len(got) == 1 and got[0]["members"] == [f"1|{k}" for k in range(4)] and got[0]["duration"] == 11.0


def test_hours_wrap_and_equal_ends(spark):
    rows = spark.createDataFrame([(1380, 1320, 360), (100, 1320, 360), (700, 1320, 360), (700, 5, 5), (360, 360, 400), (400, 360, 400)], "m int, a int, b int")
    assert [r[0] for r in rows.select(timeutil.in_window(F.col("m"), F.col("a"), F.col("b"))).collect()] == [True, True, False, True, True, False]


@pytest.mark.parametrize(("offers", "admitted"), [([(0, 1)] * 50, 1), ([(0, k) for k in range(50)], 5), ([(k % 10, k) for k in range(50)], 12)])
def test_throttle_budgets(spark, offers, admitted):
    rows = spark.createDataFrame([("s", float(i), i, c, k, "fence") for i, (c, k) in enumerate(offers)], "site string, t double, seq long, camera_id long, track_id long, rule string")
    got = stateful.batch(rows.repartition(4), ["site"], stateful.Throttle).collect()
    assert sum(r["decision"] == "admitted" for r in got) == admitted
    if admitted == 1:
        assert max(r["repeats"] for r in got) == 50


def _folded(fold, rows):
    return [out for row in rows for out in fold.step(row)]


def _fusion(rows, **options):
    """rows: (t, agree, fused) with the frame numbers and times of a camera that sees the track in every frame, or (t, agree, fused, frame, before)."""
    full = [(float(r[0]), i, r[1], r[2], *(r[3:] or (i, float(rows[i - 1][0]) if i else None))) for i, r in enumerate(rows)]
    return _folded(stateful.Fusion(**options), full)


def test_fusion_is_armed_by_a_late_disagreement_only():
    agree, break_ = [(0, True, 0.5), (1, True, 0.7), (2, True, 0.6)], (3, False, 0.0)
    again = [(14, True, 0.5), (15, True, 0.5), (16, True, 0.9)]
    assert [(o[0], o[2], o[3], o[4]) for o in _fusion([*agree, break_, *again])] == [(2, 3, 0.0, 1)]
    late = _fusion([*agree, break_, (13.5, False, 0.0), *again])
    assert [(o[0], o[4], o[5]) for o in late] == [(2, 1, 0.7), (7, 7, 0.9)]
    between = _fusion([*agree, break_, (8, True, 0.5), (9, False, 0.0), (14, False, 0.0), *again])
    assert [o[0] for o in between] == [2]  # agreement in between ends the break, and the next one is too short


def test_fusion_counts_frames_without_the_track_as_breaks_of_the_streak():
    gap = [(0, True, 0.5, 0, None), (1, True, 0.5, 1, 0.0), (3, True, 0.5, 3, 2.0), (4, True, 0.5, 4, 3.0)]
    assert _fusion(gap) == [] and len(_fusion([*gap, (5, True, 0.5, 5, 4.0)])) == 1
    fired = [(0, True, 0.5, 0, None), (1, True, 0.5, 1, 0.0), (2, True, 0.5, 2, 1.0)]
    back = lambda t: [(t + k, True, 0.5, 100 + k, t + k - 1.0) for k in range(3)]
    assert len(_fusion([*fired, *back(20)])) == 1 and len(_fusion([*fired, *back(50)])) == 2


CANDIDATE = "camera_id long, track_id long, t double, seq long, appearance double, age int, motion double, iou double, modality string, status string"


def _candidates(spark, *rows):
    """rows: appearance, age, motion, iou, modality, status; one track's frames in order."""
    return spark.createDataFrame([(1, 1, float(i), i, *r) for i, r in enumerate(rows)], CANDIDATE)


def test_fusion_gates_each_at_its_edge(spark):
    rows = [(0.8, 2, 0.6, 0.2, "visible", "ok"), (0.8, 3, 0.9, 0.5, "visible", "ok"), (0.8, 0, 0.6, 0.19, "visible", "ok"), (0.8, 0, 0.6, 0.5, "visible", "camera_state")]
    rows += [(0.15, 0, 1.0, 0.5, "visible", "ok"), (0.14, 0, 1.0, 0.5, "lwir", "ok"), (1.0, 0, 0.25, 0.5, "visible", "ok"), (1.0, 0, 0.24, 0.5, "visible", "ok"), (0.5, 0, None, 0.5, "visible", "ok"), (0.2, 0, 0.9, 0.5, None, "ok")]
    got = stateful.judged(_candidates(spark, *rows)).orderBy("seq").collect()
    assert [r["agree"] for r in got] == [True, False, False, False, False, False, True, False, False, False]  # 0.53 * 0.15 + 0.47 is 0.5495
    assert got[8]["status"] == "no_motion_yet"


@pytest.mark.parametrize(("modality", "fused", "fires"), [("lwir", 0.69, 1), ("visible", 0.53, 0)])
def test_a_weak_box_on_strong_motion_fires_by_night_only(spark, modality, fused, fires):
    judged = stateful.judged(_candidates(spark, *[(0.20, 0, 0.90, 0.5, modality, "ok")] * 4))
    assert {round(r["fused"], 2) for r in judged.collect()} == {fused}
    assert stateful.batch(judged, ["camera_id", "track_id"], stateful.Fusion).count() == fires


def test_weights_follow_measured_contrast_and_may_be_set(spark):
    assert stateful.modality_weights() == {"visible": (0.53, 0.47), "lwir": (0.2967, 0.7033)}
    assert stateful.modality_weights({"lwir": 0.4})["lwir"] == (0.6, 0.4)


@pytest.mark.parametrize("row", [(0.95, 0, 0.0, 0.0, "visible", "ok"), (0.05, 0, 0.95, 0.9, "lwir", "ok"), (0.9, 0, 0.9, 0.1, "visible", "ok"), (0.8, 0, 0.9, 0.9, "visible", "camera_state")])
def test_one_signal_another_place_or_a_blind_camera_raises_nothing(spark, row):
    assert stateful.batch(stateful.judged(_candidates(spark, *[row] * 12)), ["camera_id", "track_id"], stateful.Fusion).count() == 0


def test_both_signals_fire_once_after_three_frames(spark):
    good, off = (0.8, 0, 0.9, 0.5, "visible", "ok"), (0.8, 0, 0.1, 0.5, "visible", "ok")
    fired = stateful.batch(stateful.judged(_candidates(spark, good, good, off, *[good] * 9)), ["camera_id", "track_id"], stateful.Fusion).collect()
    assert [(r["seq"], r["streak"], r["started"]) for r in fired] == [(5, 3, 3.0)]
    own = _candidates(spark, *[good] * 4).withColumn("threshold", F.lit(0.9))
    assert not [r for r in stateful.judged(own).collect() if r["agree"]]  # a camera's own threshold


FRAME = "camera_id long, seq long, t double, brightness double, std double, detail double, saturated double, diff double, gap_s double"
SEEN = (100.0, 40.0, 0.2, 0.0, 1.0, None)


def _states(spark, frames, scene=True, **options):
    """frames: (brightness, std, detail, saturated, diff, gap_s), one each second."""
    df = spark.createDataFrame([(1, i, float(i), *f) for i, f in enumerate(frames)], FRAME)
    scenes = spark.createDataFrame([(1, -1.0, 100.0, 40.0, 0.2)], "camera_id long, ready_at double, scene_brightness double, scene_std double, scene_detail double") if scene else None
    judged = camera_state.judged_frames(df, scenes, **options)
    events = [(r["seq"], r["anomaly"], r["active"], r["since"]) for r in camera_state.anomalies(judged).orderBy("seq", "step").collect()]
    return events, [r["status"] for r in judged.orderBy("seq").collect()]


def test_anomalies_persist_and_clear(spark):
    flat = (0.0, 0.5, 0.2, 0.0, 1.0, None)
    events, status = _states(spark, [SEEN, flat, flat, SEEN, flat, flat, flat, SEEN, SEEN, flat, *[SEEN] * 5])
    assert events == [(6, "SIGNAL_LOSS", True, 4.0), (14, "SIGNAL_LOSS", False, 4.0)]
    assert status == ["ok"] * 6 + ["camera_state"] * 8 + ["ok"]


@pytest.mark.parametrize(("frame", "kind"), [
    ((100.0, 40.0, 0.029, 0.0, 1.0, None), "LENS_TAMPER"), ((100.0, 3.1, 0.2, 0.0, 1.0, None), "LENS_TAMPER"), ((100.0, 13.0, 0.07, 0.0, 1.0, None), "LENS_TAMPER"), ((100.0, 13.0, 0.09, 0.0, 1.0, None), None), ((100.0, 15.0, 0.07, 0.0, 1.0, None), None),
    ((160.0, 40.0, 0.2, 0.25, 1.0, None), "IR_FLOOD"), ((159.0, 40.0, 0.2, 0.9, 1.0, None), None), ((220.0, 40.0, 0.2, 0.0, 1.0, None), "IR_FLOOD"), ((230.0, 0.3, 0.0, 1.0, 0.0, None), "IR_FLOOD"), ((20.0, 8.0, 0.19, 0.0, 1.0, None), None), ((0.0, 0.9, 0.0, 0.0, 0.0, None), "SIGNAL_LOSS"),
])
def test_each_anomaly_by_the_learnt_scene_and_the_strongest_alone(spark, frame, kind):
    events, _ = _states(spark, [SEEN, frame, frame, frame])
    assert events == ([(3, kind, True, 1.0)] if kind else [])


def test_without_a_scene_only_a_collapse_counts(spark):
    assert _states(spark, [(100.0, 40.0, 0.02, 0.0, 1.0, None)] * 4, False)[0] == []
    assert _states(spark, [(100.0, 2.0, 0.2, 0.0, 1.0, None)] * 4, False)[0] == [(2, "LENS_TAMPER", True, 0.0)]
    assert _states(spark, [(225.0, 19.0, 0.2, 0.0, 1.0, None)] * 4, False)[0] == [(2, "IR_FLOOD", True, 0.0)]


def test_a_still_picture_is_lost_after_two_seconds_and_a_gap_at_once(spark):
    still = (100.0, 40.0, 0.2, 0.0, 0.01, None)
    events, _ = _states(spark, [SEEN, *[still] * 6, SEEN, still])
    assert events == [(5, "SIGNAL_LOSS", True, 3.0)]
    gone, status = _states(spark, [SEEN, (*SEEN[:5], 2.0), (*SEEN[:5], 1.9)])
    assert gone == [(1, "SIGNAL_LOSS", True, -1.0), (1, "SIGNAL_LOSS", False, -1.0)] and set(status) == {"ok"}


def test_scenes_are_learnt_from_one_size(spark):
    rows = [(1, i, i * 0.25, 100.0 + i, 40.0, 0.2, 0.0, 1.0, None, "a" if i < 10 else "b") for i in range(60)] + [(2, i, i * 0.25, 1.0, 1.0, 1.0, 0.0, 1.0, None, "a") for i in range(20)]
    df = spark.createDataFrame(rows, FRAME + ", size string")
    got = camera_state.learnt_scenes(df).collect()
    assert [(r["camera_id"], r["ready_at"], r["scene_brightness"]) for r in got] == [(1, 8.5, 122.0)]  # frames 10 to 34
    status = [r["status"] for r in camera_state.judged_frames(df, camera_state.learnt_scenes(df)).filter("camera_id = 1").orderBy("seq").collect()]
    assert status == ["warming_up"] * 35 + ["ok"] * 25


def test_hysteresis_and_samplers():
    hits = [1, 1, 1, 0, 0, 1, 0, 0, 0, 0, 0, 1]
    assert [(o[0], o[2]) for o in _folded(stateful.Hysteresis(), [(float(i), i, bool(h)) for i, h in enumerate(hits)])] == [(2, "raised"), (10, "cleared")]
    frames = [(i * 0.1, i) for i in range(21)]
    assert [o[0] for o in _folded(stateful.Sampler(5.0), frames)] == list(range(0, 21, 2))
    assert [o[0] for o in _folded(stateful.MinGap(0.35), frames)] == [0, 4, 8, 12, 16, 20]
    assert [o[0] for o in _folded(stateful.DueSchedule(3, 10.0), frames)] == list(range(0, 21, 3))


def test_folds_do_not_depend_on_input_order(spark):
    rows = [(k, float(i), i * 10 + k, bool((i + k) % 7), 0.5, i, i - 1.0) for k in range(5) for i in range(40)]
    df = spark.createDataFrame(rows, "camera_id long, t double, seq long, agree boolean, fused double, frame long, before double")
    one = sorted(map(tuple, stateful.batch(df, ["camera_id"], stateful.Fusion).collect()))
    two = sorted(map(tuple, stateful.batch(df.orderBy(F.desc("seq")).repartition(7), ["camera_id"], stateful.Fusion).collect()))
    assert one == two and one


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    from perimetra.streaming import folds

    rows = [(k, float(i), i * 10 + k, bool((i + k) % 7), 0.5, i, i - 1.0) for k in range(4) for i in range(30)]
    df = spark.createDataFrame(rows, "camera_id long, t double, seq long, agree boolean, fused double, frame long, before double").withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = folds.stream(live, ["camera_id"], stateful.Fusion).writeStream.format("memory").queryName("fused").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, stateful.batch(df, ["camera_id"], stateful.Fusion).collect()))
    assert sorted(map(tuple, spark.table("fused").collect())) == want


def test_chain_tampering_taints_later_blocks_only(spark):
    rows = spark.createDataFrame([(1, i, f"clip{i}", 100 + i) for i in range(1, 21)], "chain long, id long, clip string, sealed_at long")
    fields = ("id", "clip", "sealed_at")
    chain = evidence.chained(rows, ["chain"], ["id"], fields).persist()
    ok = lambda df: [r["ok"] for r in evidence.verify(df, evidence.chain_hash(fields), ["chain"]).orderBy("n").collect()]
    assert all(ok(chain))
    assert ok(chain.withColumn("clip", F.when(F.col("n") == 8, "x").otherwise(F.col("clip")))) == [True] * 7 + [False] * 13
    assert ok(chain.filter("n <> 5")) == [True] * 4 + [False] * 15


@pytest.mark.parametrize("count", [1, 2, 3, 5, 8, 13])
def test_merkle_roots_and_proofs(spark, count):
    hashes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(count)]
    leaves = spark.createDataFrame([("d", i, h) for i, h in enumerate(hashes)], "day string, place long, hash string")
    root = evidence.merkle_root(leaves, ["day"]).first()["root"]
    for i in range(count):
        proof = evidence.inclusion_proof(hashes, i)
        assert evidence.verify_inclusion(hashes[i], proof, i, count, root)
        assert not evidence.verify_inclusion(hashes[i], proof, (i + 1) % (count + 1), count, root) or count == 1
    assert not evidence.verify_inclusion("00" * 32, evidence.inclusion_proof(hashes, 0), 0, count, root)


@pytest.mark.parametrize("count", [1024, 1025, 2049])
def test_roots_of_several_blocks_equal_a_level_by_level_tree(spark, count):
    hashes = [hashlib.sha256(str(i).encode()).digest() for i in range(count)]
    leaves = spark.createDataFrame([("d", i, h.hex()) for i, h in enumerate(hashes)], "day string, place long, hash string")
    for variant in ("promote", "duplicate"):
        level = [hashlib.sha256(b"\0" + h).digest() for h in hashes] if variant == "promote" else hashes
        while len(level) > 1:
            if variant == "promote":
                level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            else:
                level = [hashlib.sha256((level[i].hex() + level[min(i + 1, len(level) - 1)].hex()).encode()).digest() for i in range(0, len(level), 2)]
        got = evidence.merkle_root(leaves, ["day"], variant).first()
        assert (got["root"], got["leaves"]) == (level[0].hex(), count)


def test_first_bad_entry_of_a_log(spark, monkeypatch):
    monkeypatch.setattr(evidence, "STRETCH", 16)
    rows, before = [], evidence.GENESIS
    for i in range(100):
        own = hashlib.sha256(f"{i}{before}".encode()).hexdigest()
        rows.append((i * 3, str(i), before, own))
        before = own
    own = F.sha2(F.concat("body", "prev_hash"), 256)
    first = lambda r: evidence.first_bad(spark.createDataFrame(r, "id long, body string, prev_hash string, hash string"), own).first()[0]
    assert first(rows) is None
    assert first([r if r[0] != 150 else (150, "tampered", *r[2:]) for r in rows]) == 150
    assert first([r for r in rows if r[0] != 96]) == 99 and first(rows[1:]) == 3


def test_perfect_detector_and_no_truth(spark):
    gt = spark.createDataFrame([(i, "a", i, 0.0, 0.0, 10.0, 10.0) for i in range(20)] + [(99, "b", 1, 0.0, 0.0, 5.0, 5.0)], "image long, cls string, gt_id long, x1 double, y1 double, x2 double, y2 double")
    pred = gt.filter("cls = 'a'").withColumnRenamed("gt_id", "pred_id").withColumn("conf", F.lit(0.9))
    m = evaluation.match(gt, pred)
    ap = {r["cls"]: r["ap"] for r in evaluation.average_precision(evaluation.curve(m, gt), gt).collect()}
    assert ap["b"] == 0.0 and ap["a"] == pytest.approx(0.995, abs=1e-9)
    assert stats.ap_of(np.full(20, 0.9), np.ones(20), np.zeros(20), 20.0) == pytest.approx(0.995)
    extra = pred.limit(1).withColumn("cls", F.lit("z"))
    rows = {r["cls"]: (r["n_gt"], r["ap50"], r["ap50_95"]) for r in evaluation.average_precisions(gt, pred.unionByName(extra)).collect()}
    assert rows["z"] == (0, None, None) and rows["b"] == (1, 0.0, 0.0) and rows["a"][1:] == pytest.approx((0.995, 0.995), abs=1e-9)
    mean = evaluation.mean_over_present(spark.createDataFrame([("s", c, *v) for c, v in rows.items()], "slice string, cls string, n_gt long, ap50 double, ap50_95 double"), ["slice"], ["ap50"]).first()
    assert (mean["classes"], mean["ap50"]) == (2, pytest.approx(0.995 / 2, abs=1e-9))


def test_ten_overlaps_match_like_one_each(spark):
    rng = np.random.default_rng(5)
    box = "image long, cls string, {} long, x1 double, y1 double, x2 double, y2 double"
    boxes = [(int(i % 12), "a", i, *(xy := rng.integers(0, 40, 2).astype(float)), *(xy + rng.integers(8, 20, 2))) for i in range(150)]
    moved = [(im, c, i, *(np.array(b) + rng.integers(-3, 4, 4)).tolist(), float(rng.random())) for im, c, i, *b in boxes]
    gt, pred = spark.createDataFrame([tuple(map(lambda v: v.item() if hasattr(v, "item") else v, b)) for b in boxes], box.format("gt_id")), spark.createDataFrame(moved, box.format("pred_id") + ", conf double")
    every = evaluation.match_at(gt, pred, evaluation.TEN)
    for t in (0.5, 0.7, 0.9):
        one = {r["pred_id"] for r in evaluation.match(gt, pred, t).filter("gt_id is not null").collect()}
        assert {r["pred_id"] for r in every.filter((F.col("threshold") == t) & F.col("hit")).collect()} == one


def test_budget_points(spark):
    points = spark.createDataFrame([("a", 0.1, 50, 40, 100, 0.8), ("a", 0.5, 50, 10, 2, 0.2), ("a", 0.9, 50, 0, 0, 0.0), ("b", 0.1, 50, 40, 9, 0.8), ("b", 0.2, 50, 30, 9, 0.6), ("c", 0.1, 50, 40, 90, 0.8), ("c", 0.2, 50, 0, 80, 0.0)], "cls string, threshold double, n_gt long, tp long, fp long, recall double")
    at = lambda images, allowed: {r["cls"]: r for r in evaluation.budget_point(points, images, allowed).collect()}
    wide = at(1000, 0.01)  # ten false positives: two are sure enough, nine are not
    assert (wide["a"]["status"], wide["a"]["threshold"], wide["a"]["frames_needed"]) == ("met", 0.5, 0)
    assert (wide["b"]["status"], wide["b"]["threshold"], wide["b"]["frames_needed"]) == ("unresolvable", 0.1, -(-stats.poisson_upper(9) // 0.01))
    assert (wide["c"]["status"], wide["c"]["threshold"], wide["c"]["vacuous"], wide["c"]["frames_needed"]) == ("unreachable", 0.2, True, None)
    tight = at(1000, 0.001)["a"]  # only no false positive fits, which a thousand images cannot show
    assert (tight["status"], tight["vacuous"], tight["frames_needed"]) == ("unresolvable", True, 3000)


def test_hard_set_offers_leftovers_to_later_buckets(spark):
    rows = spark.createDataFrame([(i, i < 6, i < 8) for i in range(20)], "id long, tiny boolean, crowd boolean")
    got = {r["id"]: r["bucket"] for r in datasets.hard_set(rows, [("tiny", F.col("tiny"), 3, ("id",), None), ("crowd", F.col("crowd"), 4, ("id",), None)], 10, "id").collect()}
    assert got == {0: "tiny", 1: "tiny", 2: "tiny", 3: "crowd", 4: "crowd", 5: "crowd", 6: "crowd", 7: "filler", 8: "filler", 9: "filler"}
    share = datasets.hard_set(rows, [("tenth", F.lit(True), 5, (F.desc("id"),), 0.1)], 3, "id").collect()
    assert {r["id"]: r["bucket"] for r in share} == {19: "tenth", 18: "tenth", 0: "filler"}


def test_paired_change_is_zero_for_equal_models(spark):
    rng = np.random.default_rng(2)
    rows = [("a", i, i % 25, float(rng.random()), i if rng.random() < 0.7 else None) for i in range(300)]
    matched = spark.createDataFrame(rows, "cls string, pred_id long, cluster long, conf double, gt_id long")
    gt = spark.createDataFrame([("a", i, i % 25) for i in range(320)], "cls string, gt_id long, cluster long")
    same = evaluation.bootstrap_delta(matched, matched, gt, "cluster", 40).first()
    assert (same["delta"], same["low"], same["high"], same["replicates"]) == (0.0, 0.0, 0.0, 40)
    worse = evaluation.bootstrap_delta(matched, matched.withColumn("gt_id", F.when(F.col("pred_id") % 3 != 0, F.col("gt_id"))), gt, "cluster", 40).first()
    assert worse["delta"] < 0 and worse["high"] < 0


@pytest.mark.parametrize("bins", [1, 7, 1000])
def test_curve_ranges_agree_with_one_ordered_pass(spark, bins):
    rng = np.random.default_rng(bins)
    rows = [(c, i, i, float(rng.integers(0, 40)) / 40, int(i) if rng.random() < 0.6 else None) for c in ("a", "b") for i in range(120)]
    matched = spark.createDataFrame(rows, "cls string, image long, pred_id long, conf double, gt_id long")
    gt = spark.createDataFrame([(c, i) for c in ("a", "b", "c") for i in range(130)], "cls string, gt_id long")
    curves = evaluation.curve(matched, gt, bins=bins)
    found = {(r["cls"], r["pos"]): r for r in curves.collect()}
    ap = {r["cls"]: r["ap"] for r in evaluation.average_precision(curves, gt).collect()}
    at = {(r["cls"], r["threshold"]): (r["tp"], r["fp"]) for r in evaluation.at_thresholds(matched, gt, [0.0, 0.5, 0.9]).collect()}
    assert len(found) == len(rows) and ap["c"] == 0.0
    for cls in ("a", "b"):
        own = sorted((r for r in rows if r[0] == cls), key=lambda r: (-r[3], r[1], r[2]))
        tp = np.cumsum([r[4] is not None for r in own])
        precision = tp / np.arange(1, len(own) + 1)
        envelope = np.maximum.accumulate(precision[::-1])[::-1]
        for k, r in enumerate(own):
            f = found[cls, k + 1]
            assert (f["image"], f["tp"], f["fp"]) == (r[1], tp[k], k + 1 - tp[k]) and f["envelope"] == pytest.approx(envelope[k])
        marks = np.linspace(0, 1, 101)
        value = np.interp(marks, np.r_[0.0, tp / 130, 1.0], np.r_[1.0, envelope, 0.0])
        assert ap[cls] == pytest.approx(((value[1:] + value[:-1]) / 2 * 0.01).sum(), abs=1e-9)
        for t in (0.0, 0.5, 0.9):
            hits = [r[4] is not None for r in own if r[3] >= t]
            assert at[cls, t] == (sum(hits), len(hits) - sum(hits))


def test_sized_match_ignores_other_buckets(spark):
    box = "image long, cls string, {} long, x1 double, y1 double, x2 double, y2 double"
    gt = spark.createDataFrame([(1, "a", 1, 0.0, 0.0, 10.0, 30.0), (1, "a", 2, 50.0, 0.0, 60.0, 90.0)], box.format("gt_id"))
    rows = [(1, "a", 1, 0.0, 0.0, 10.0, 30.0), (1, "a", 2, 50.0, 0.0, 60.0, 88.0), (1, "a", 3, 200.0, 0.0, 210.0, 30.0), (1, "a", 4, 300.0, 0.0, 310.0, 80.0)]
    pred = spark.createDataFrame(rows, box.format("pred_id")).withColumn("conf", F.lit(0.5))
    small = {r["pred_id"]: (r["gt_id"], r["ignored"]) for r in evaluation.match_sized(gt, pred, 3).collect()}
    assert small == {1: (1, False), 2: (None, True), 3: (None, False), 4: (None, True)}
    large = {r["pred_id"]: (r["gt_id"], r["ignored"]) for r in evaluation.match_sized(gt, pred, 0).collect()}
    assert large == {1: (None, True), 2: (2, False), 3: (None, True), 4: (None, False)}


def test_intervals():
    assert stats.poisson_interval(0)[1] == pytest.approx(3.6889, abs=1e-3) and stats.poisson_upper(0) == 3.0
    low, high = stats.poisson_interval(10)
    assert (low, high) == (pytest.approx(4.7954, abs=1e-3), pytest.approx(18.3904, abs=1e-3))
    assert stats.frames_needed(7.234e-06) == 414709 or abs(stats.frames_needed(7.234e-06) - 414720) < 50


def test_homography_recovers_a_known_map():
    h = np.array([[0.02, 0.001, 1.0], [0.0, 0.03, 2.0], [0.0, 0.0005, 1.0]])
    image = [(0, 0), (640, 0), (640, 480), (0, 480), (320, 200)]
    world = [homography.apply(h, p) for p in image]
    got = homography.calibrate(image, world)
    assert np.allclose(got, h, atol=1e-8) and homography.trusted(got, image, world)
    assert np.allclose(homography.apply(homography.for_frame(got, (640, 480), (1280, 960)), (640, 400)), homography.apply(got, (320, 200)))
    with pytest.raises(ValueError):
        homography.for_frame(got, (640, 480), (640, 640))


def test_plates_and_sentences():
    assert text.plate_fields("बा२च९५८५")[0] == "zone" and text.plate_fields("BP-1-A1234")[0] == "bhutan" and text.plate_fields("BAGMATI B AC 5763")[0] == "embossed"
    assert text.best_plate("बतपरेश०४बा२च९५८५") == "बा२च९५८५" and text.plate_fields("nonsense") is None
    facts = text.Facts(frozenset({"loitering"}), "10:30", (("duration_s", 12.0),))
    assert text.violations(text.repaired('- "Reason: one person waited 12 s near the road at 10:30"'), facts) == []
    assert set(text.violations(text.repaired("He may be a smuggler."), facts)) >= {"speculation", "person_identity", "missing_time", "missing_reason"}


@pytest.mark.parametrize(("sentence", "facts", "codes"), [
    ("One person waited 3 min near Pillar 42 at 10:30.", {"measures": (("duration_s", 170.0), ("label", 42.0)), "names": frozenset({"pillar"})}, []),
    ("One person waited 3 h near the road at 10:30.", {"measures": (("duration_s", 170.0),)}, ["invented_number"]),
    ("Several persons waited near the road at 10:30.", {"count": 3, "measures": (("count", 3.0),)}, []),
    ("Two trucks waited near the road at 10:30.", {"count": 2, "measures": (("count", 2.0),)}, ["invented_object"]),
    ("A person waited and went north-east at 10:30.", {"bearing": 90.0}, []),
    ("A person waited and went west at 10:30 am.", {"bearing": 90.0}, ["invented_direction"]),
    ("A person waited left to right at 10:30 by night.", {"motion": "left to right", "night": True}, []),
    ("A person waited at noon in infrared at 10:30.", {"night": True}, ["invented_claim"]),
    ("A person waited at 10:30 pm near the road.", {}, ["invented_time", "missing_time"]),
    ("A muslim in a turban waited at 10:30 near the road.", {}, ["person_identity"]),
    ("A person in a group waited near the road at 10:30.", {}, ["invented_claim"]),
    ("A person went south near the road at 10:30.", {"rules": frozenset({"wrong direction"}), "bearing": 180.0}, []),
    ("A person of Acme waited near the road at 10:30.", {"names": frozenset({"acme"}), "vendors": ("s:", frozenset({hashlib.sha256(b"s:acme").hexdigest()[:16]}))}, ["vendor"]),
])
def test_sentences_may_state_facts_only(sentence, facts, codes):
    assert text.violations(sentence, text.Facts(**({"rules": frozenset({"loitering"}), "hhmm": "10:30"} | facts))) == codes


def test_search_batch_equals_a_plain_search(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(200, 8))
    rows = [(i, i // 7, v[i].tolist()) for i in range(200)]
    frames = spark.createDataFrame(rows, "keyframe_id long, clip_id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(q, v[q].tolist()) for q in (3, 50)], "query_id long, vector array<double>")
    got = search.search_batch(frames, asked, 4).collect()
    for q in (3, 50):
        best = {}
        for i, c, x in rows:
            best[c] = max(best.get(c, (-9.0, 0)), (float(np.dot(v[q], x)), -i))
        want = sorted(((s, -m, c) for c, (s, m) in best.items()), key=lambda b: (-b[0], b[1]))[:4]
        assert [(r["clip_id"], r["keyframe_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(c, k) for _, k, c in want]


def test_matching_in_time_within_reach(spark):
    kind = "camera_id long, id long, t double, x double, y double"
    truth = spark.createDataFrame([(1, 1, 10.0, 0.0, 0.0), (1, 2, 11.0, 0.0, 0.0)], kind)
    found = spark.createDataFrame([(1, 5, 10.5, 300.0, 0.0), (1, 6, 12.0, 3.0, 4.0), (1, 7, 13.0, 0.0, 5.0)], kind)
    got = {(r["truth_id"], r["found_id"]) for r in stateful.match_in_time(truth, found, ["camera_id"], 2.0, 250.0).collect()}
    assert got == {(1, 6), (2, 7)} and {(r["truth_id"], r["found_id"]) for r in stateful.match_in_time(truth, found, ["camera_id"], 2.0).collect()} == {(1, 5), (2, 6)}


def test_split_leaks_and_tiles(spark):
    rows = spark.createDataFrame([("a", "train"), ("a", "val"), ("b", "train")], "sequence_key string, split string")
    assert [r["sequence_key"] for r in datasets.leaks(rows).collect()] == ["a"]
    seen = np.zeros((50, 70), bool)
    for x1, y1, x2, y2 in datasets.tiles(70, 50, 32, 0.25):
        seen[y1:y2, x1:x2] = True
    assert seen.all() and datasets.negatives_needed(80, 0.2) == 20


def test_search_add_is_idempotent_and_round_trips(spark):
    k = spark.createDataFrame([(i, i, [float(i == j) for j in range(3)]) for i in range(3)], "keyframe_id long, clip_id long, embedding array<float>")
    index = search.add_keyframes(k.limit(0), k)
    assert search.add_keyframes(index, k).count() == 3
    assert search.search(index, F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)), 1).first()["clip_id"] == 1


def _plain_simhash(text):
    words = re.findall(r"\w+", (text or "").lower())
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else [text or ""]
    values = [int(hashlib.sha256(p.encode()).hexdigest()[:16], 16) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


@pytest.mark.parametrize("kept", [1, 2])
def test_every_pair_within_four_bits_is_found_once(spark, monkeypatch, kept):
    """Random hashes and near copies of them; a third of all share one band and more, so that band values are hot."""
    monkeypatch.setattr(search, "HOT_BAND", 40)
    monkeypatch.setattr(search, "BLOCK_HASHES", 16)
    monkeypatch.setattr(search, "CROWDED", 256 if kept == 1 else 1e-3)
    assert len(search.band_masks(4, 1)) == 5 and len(search.band_masks(4, 2)) == 15
    r = np.random.default_rng(8)
    base = [int(x) for x in r.integers(0, 2**64, 200, dtype=np.uint64)] + [(int(x) & 0xFF) | (0xABC << 40) for x in r.integers(0, 2**63, 150)]
    values = list(base)
    for x in base[:200]:
        for most in (1, 3, 4, 5):
            values.append(x ^ sum(1 << int(b) for b in r.choice(64, most, replace=False)))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    distinct = sorted({signed(v) for v in values})
    mask = 2**64 - 1
    want = sorted((a, b, ((a ^ b) & mask).bit_count()) for i, a in enumerate(distinct) for b in distinct[i:] if ((a ^ b) & mask).bit_count() <= 4)
    got = sorted(tuple(x) for x in search.near_hashes(spark.createDataFrame([(signed(v),) for v in [*values, *values[:50]]] + [(None,)], "hash long")).collect())
    assert got == want and len(got) > len(distinct) + 500


def test_cells_bound_the_rows_of_a_hot_group(spark):
    rows = spark.range(2000).select(F.lit("hot").alias("g"), F.col("id").alias("v")).unionByName(spark.range(3).select(F.lit("cold").alias("g"), F.col("id").alias("v")))
    sizes = {(r["g"], r["low"], r["high"]): r["count"] for r in search.cells(rows, ["g"], "v", 100).groupBy("g", "low", "high").count().collect()}
    assert sizes[("cold", 0, 0)] == 3 and len(sizes) == 1 + 20 * 21 // 2 and max(sizes.values()) < 320


def test_majorities_of_long_and_empty_lists(monkeypatch):
    lists = [[], ["a"], [f"w{i}" for i in range(300)], ["x", "x", "y"]]
    plain = [sum(1 << b for b in range(64) if 2 * sum(int(hashlib.sha256(w.encode()).hexdigest()[:16], 16) >> b & 1 for w in own) > len(own)) for own in lists]
    assert search.majorities(lists).tolist() == plain
    monkeypatch.setattr(search, "WORDS_AT_ONCE", 7)
    assert search.majorities(lists).tolist() == plain


def test_queries_beyond_one_block_give_the_same(spark):
    k = spark.createDataFrame([(i, i // 3, [float(i % 7), float(i % 5)]) for i in range(60)], "keyframe_id long, clip_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, [1.0 * i, 3.0 - i]) for i in range(11)], "query_id long, vector array<double>")
    one, many = (sorted(map(tuple, search.search_batch(k, asked, 4, block).collect())) for block in (1000, 3))
    assert one == many and len(one) == 44


def test_near_copies_are_told_by_whole_texts(spark, tmp_path):
    import __spark_entry__ as entry

    r = np.random.default_rng(4)
    long = [" ".join(f"w{x}" for x in r.integers(0, 5000, 600)) for _ in range(6)]
    opening = "the same opening of every text, longer than any cut "
    texts = [opening + t for t in long] + ["Other first words, " + long[0], opening + long[0], long[1] + " end", None, "", "!!!", "two words", long[2], long[2] + " tail"]
    rows = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    h = [_plain_simhash(t) for t in texts]

    def near(a, b, most=4):
        return (a ^ b).bit_count() <= most

    mask = 2**64 - 1
    pairs = {(frozenset((p["ha"] & mask, p["hb"] & mask)), p["distance"]) for p in entry.queries()["simhash_pairs"](spark, str(tmp_path)).collect()}
    assert pairs == {(frozenset((a, b)), (a ^ b).bit_count()) for a in h for b in h if near(a, b)}
    got = {x["seq"]: (x["dropped"], x["within"]) for x in entry.queries()["simhash_duplicates"](spark, str(tmp_path)).collect()}
    assert got == {i: (any(near(h[j], h[i]) and (i - j) % 2 for j in range(i)), any(near(h[j], h[i], 2) and (i - j) % 2 == 0 for j in range(i))) for i in range(len(h))}
    leads, leaders = {}, {0: [], 1: []}
    for i, x in enumerate(h):
        leads[i] = next((j for j in leaders[i % 2] if (h[j] ^ x).bit_count() <= 4), i)
        leaders[i % 2] += [i] * (leads[i] == i)
    assert {x["seq"]: x["leader"] for x in entry.queries()["leader_clusters"](spark, str(tmp_path)).collect()} == leads
    assert not any(got[i][0] or got[i][1] for i in range(6)) and leads[6] == 0 and leads[2] == 2  # a shared opening is no near copy; a changed one stays one


def test_merge_moves_forward_only(spark):
    rows = [("a", 1, "e1", ["fence"], "tpl", "template", None, 50, "provisional"), ("a", 2, "e2", ["loiter", "fence"], "said", "model", None, 60, "confirmed"), ("a", 3, "e3", [], "tpl2", "template", None, 70, "provisional"), ("a", 4, "e4", [], "tpl3", "template", None, 80, "sealed")]
    df = spark.createDataFrame(rows, "k string, seq long, event_id string, rules array<string>, reason string, reason_source string, evidence_id string, confidence int, stage string")
    got = serving.merge_alerts(df, ["k"], ["seq"]).first()
    assert (got["event_id"], got["events"], got["stage"], got["reason"], got["rule_fired"], got["confidence"]) == ("e1", 4, "confirmed", "said", "fence + loiter", 80)


def test_validation_lists_all_errors_and_unknown_keys(spark):
    df = spark.createDataFrame([('{"a": 1, "zz": 2}', None, 7), ('{"a": 1}', "x1", 3)], "raw string, id string, n int")
    s = validate.Schema().required(F.col("id"), "id").between(F.col("n"), "n", 0, 5).known_keys(F.col("raw"), "", ("a",))
    assert [len(r[0]) for r in df.select(s.errors()).collect()] == [3, 0]
    event = validate.consistent_event(F.lit("sealed"), F.lit("why"), F.lit(None).cast("string"))
    assert df.select(event.errors()).first()[0] == ["evidence: goes with sealed"]


def test_band_join_and_asof(spark):
    a = spark.createDataFrame([(1, 10.0, 0), (1, 55.0, 1)], "k long, t double, seq long")
    b = spark.createDataFrame([(1, 12.0, 5, 7.0), (1, 40.0, 6, 8.0), (2, 10.0, 7, 9.0)], "k long, t double, seq long, v double")
    assert ranging.band_join(a, b.select("k", "t", "v"), ["k"], "t", 5.0).count() == 1
    assert [(r["t"], r["v"]) for r in ranging.asof(a, b, ["k"], "v", 20.0).orderBy("t").collect()] == [(10.0, None), (55.0, 8.0)]


def test_cell_threshold_floor_and_fallback(spark):
    rows = [(1, 0, 0.01, float(i)) for i in range(6)] + [(1, 1, 1.0, float(i)) for i in range(6)] + [(1, 2, 9.0, 0.0)]
    schema = "camera long, cell long, energy double, t double"
    got = {r["cell"]: r["tau"] for r in calibration.cell_thresholds(spark.createDataFrame(rows, schema), ["camera"], ["cell"]).collect()}
    assert got == {0: 0.35, 1: 1.0, 2: pytest.approx(0.675)}
    longer = [*rows, *((1, 1, 1.0, 10.0 + i) for i in range(60))]  # of 66 frames, six samples are a tenth, five are not
    got = {r["cell"]: r["tau"] for r in calibration.cell_thresholds(spark.createDataFrame(longer[1:], schema), ["camera"], ["cell"]).collect()}
    assert got[0] == got[2] == 1.0


def test_nms_and_time_matching(spark):
    rows = [(1, i, float(x), 0.0, float(x + 10), 10.0, s) for i, (x, s) in enumerate([(0, 0.9), (1, 0.8), (30, 0.7)])]
    b = spark.createDataFrame(rows, "image long, id long, x1 double, y1 double, x2 double, y2 double, score double")
    assert sorted(r["id"] for r in stateful.nms(b, ["image"]).collect()) == [0, 2]
    t = spark.createDataFrame([(1, 1, 10.0), (1, 2, 11.0)], "clip long, id long, t double")
    f = spark.createDataFrame([(1, 7, 10.5), (1, 8, 30.0)], "clip long, id long, t double")
    assert [(r["truth_id"], r["found_id"]) for r in stateful.match_in_time(t, f, ["clip"], 2.0).collect()] == [(1, 7)]


def test_assignment_is_optimal():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 4), (5, 5)):
        for _ in range(20):
            cost = np.round(rng.random((n, m)), 2)
            pairs = tracker.assigned(cost)
            few, many = (cost, m) if n <= m else (cost.T, n)
            best = min(sum(few[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(many), len(few)))
            assert len(pairs) == min(n, m) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
            assert sum(cost[i, j] for i, j in pairs) == pytest.approx(best)


def _tracked(frames, **options):
    """frames: (t, detections or None where no detector looked); detections: (cls, score, box)."""
    fold, out, seq = tracker.Tracks(tracker.Settings(**options)), [], 0
    for t, found in frames:
        ids = list(range(seq, seq + len(found or ())))
        seq += len(ids)
        rows = list(fold.step((t, found is not None, ids, [f[0] for f in found or ()], [f[1] for f in found or ()], [f[2] for f in found or ()])))
        out.append({r[1]: r for r in rows})
    return out


def _box(x, y=100.0, w=40.0, h=80.0):
    return [x, y, x + w, y + h]


def test_tracks_keep_their_names_where_boxes_meet():
    frames = [(k * 0.05, [("person", 0.9, _box(100 + 6 * k)), ("person", 0.9, _box(340 - 6 * k, 130))]) for k in range(40)]
    got = _tracked(frames)
    assert all(set(f) == {1, 2} for f in got)
    assert got[-1][1][6] > 300 and got[-1][2][6] < 140  # both went on in their direction


def test_unsure_detections_and_skipped_frames_carry_a_track_on():
    frames = [(k * 0.05, [("person", 0.9 if k < 10 else 0.2, _box(100 + 4 * k))] if k % 2 == 0 else None) for k in range(20)]
    got = _tracked(frames)
    assert all(set(f) == {1} and f[1][3] == "confirmed" for f in got)
    assert [f[1][2] is None for f in got] == [k % 2 == 1 for k in range(20)]
    assert abs(got[11][1][6] - 144) < 3  # the predicted place


def test_tracks_are_lost_and_end_by_seconds():
    frames = [(k * 0.1, [("person", 0.9, _box(100))] if k < 5 else []) for k in range(25)]
    got = _tracked(frames, buffer=1.0)
    assert got[5][1][3] == "lost" and 1 in got[14] and 1 not in got[15]
    late = _tracked([(0.0, []), (0.1, [("person", 0.9, _box(100))]), (0.2, [])])
    assert late[1][1][3] == "tentative" and not late[2]


def test_cars_may_turn_trucks_but_not_persons():
    cars = _tracked([(0.0, [("car", 0.9, _box(100))]), (0.1, [("truck", 0.8, _box(101))])])
    assert set(cars[1]) == {1} and cars[1][1][4] == "car"
    mixed = _tracked([(0.0, [("car", 0.9, _box(100))]), (0.1, [("person", 0.8, _box(101))])])
    assert set(mixed[1]) == {1, 2}


def test_tracking_a_table_equals_folding_its_frames(spark):
    rows = [(c, k * 0.1, c * 1000 + k, "car", 0.9, *_box(100.0 + 3 * k)) for c in (1, 2) for k in range(10) if k % 4]
    kind = "camera_id long, t double, seq long, cls string, score double, x1 double, y1 double, x2 double, y2 double"
    frames = spark.createDataFrame([(c, k * 0.1, True) for c in (1, 2) for k in range(10)], "camera_id long, t double, detected boolean")
    got = tracker.track_boxes(spark.createDataFrame(rows, kind), frames, ["camera_id"]).filter("camera_id = 2").orderBy("t", "track").collect()
    want = [r for f in _tracked([(k * 0.1, [("car", 0.9, _box(100.0 + 3 * k))] if k % 4 else []) for k in range(10)]) for r in f.values()]
    assert [(r["t"], r["track"], r["state"], round(r["x1"], 6)) for r in got] == [(r[0], r[1], r[3], round(r[6], 6)) for r in want]


def test_readers_report_what_does_not_parse(spark, tmp_path):
    from perimetra.sources import readers

    (tmp_path / "rows.jsonl").write_text('{"k": "a", "n": 1}\nnot json\n{"k": "b", "n": 2}\n')
    rows = readers.json_lines(spark, str(tmp_path / "rows.jsonl"), "k string, n long").cache()
    assert rows.filter("_corrupt_record is null").count() == 2 and readers.json_lines(spark, str(tmp_path / "none.jsonl"), "k string").count() == 0
    (tmp_path / "led.jsonl").write_text('{"n": 1}\nbroken\n{"n": 2}\n{"n": 3')
    blocks, problems, torn = readers.ledger(spark, str(tmp_path / "led.jsonl"), "n long")
    assert (blocks.count(), problems.count(), torn.count()) == (2, 1, 1)
    (tmp_path / "img.txt").write_text("0 0.5 0.5 0.1 0.1\n1 0.5 0.5\n")
    good, bad = readers.labels(spark, str(tmp_path / "img.txt"))
    assert good.first()["image"] == "img" and bad.count() == 1


def test_ledgers_configurations_and_reports(spark, tmp_path):
    from perimetra.sources import readers

    ledger = tmp_path / "ledger"
    readers.append_lines(spark.createDataFrame([(1, "a"), (2, "b")], "n long, k string").coalesce(1), str(ledger), ["n", "k"])
    (ledger / "part-torn.txt").write_text('{"n":3,"k":"c"}\n{"n":4')
    assert readers.without_torn_tails(spark, str(ledger), str(tmp_path / "mended")) == 1
    blocks, problems, torn = readers.ledger(spark, str(tmp_path / "mended"), "n long, k string")
    assert sorted(r["n"] for r in blocks.collect()) == [1, 2, 3] and problems.count() == torn.count() == 0
    (tmp_path / "conf").mkdir()
    for name, stamp, dwell in (("a.json", 1_000, 3), ("b.json", 2_000, 5)):
        (tmp_path / "conf" / name).write_text('{\n "camera_id": 1,\n "dwell": %d\n}' % dwell)
        os.utime(tmp_path / "conf" / name, (stamp, stamp))
    assert [r["dwell"] for r in readers.configs(spark, str(tmp_path / "conf"), "camera_id long, dwell int").collect()] == [5]
    assert readers.located(spark, [str(tmp_path / "none"), str(tmp_path)], "conf/*.json") == str(tmp_path) and readers.located(spark, [str(tmp_path)], "*.xyz") is None
    assert readers.markdown(spark.createDataFrame([("x|y", 0.5, None)], "a string, b double, c int")) == "| a | b | c |\n| --- | --- | --- |\n| x\\|y | 0.5 |  |"


def test_baselines_are_replaced_by_camera_and_checked(spark, tmp_path):
    from perimetra.sources import readers

    kind = "camera_id long, grid array<double>"
    readers.save_baselines(spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.3])], kind), str(tmp_path / "base"))
    readers.save_baselines(spark.createDataFrame([(1, [0.5, 0.6])], kind), str(tmp_path / "base"))
    good, refused = readers.load_baselines(spark, str(tmp_path / "base"), kind, 2)
    assert [(r["camera_id"], r["grid"]) for r in good.collect()] == [(1, [0.5, 0.6])] and [r["camera_id"] for r in refused.collect()] == [2]


def test_baselines_are_learnt_anew_from_the_latest_tracks(spark, tmp_path):
    from perimetra.streaming import folds

    mean = lambda rows: rows.groupBy("camera_id").agg(F.avg("net").alias("net"), F.count(F.lit(1)).alias("n"))
    relearn = folds.relearner(str(tmp_path / "store"), str(tmp_path / "features"), mean, least=3, most=4)
    kind = "camera_id long, t1 double, net double"
    relearn(spark.createDataFrame([(1, float(i), 1.0) for i in range(3)] + [(2, 0.0, 9.0)], kind), 0)
    relearn(spark.createDataFrame([(1, 10.0, 5.0), (2, 1.0, 9.0)], kind), 1)
    relearn(spark.createDataFrame([(1, 10.0, 5.0), (2, 1.0, 9.0)], kind), 1)  # a batch that comes again changes nothing
    got = {r["camera_id"]: (r["net"], r["n"]) for r in spark.read.parquet(str(tmp_path / "store")).collect()}
    assert got == {1: (2.0, 4)}


def test_fold_factory_pickles():
    import pickle

    assert pickle.loads(pickle.dumps(partial(stateful.Fusion, 3, 10.0)))().need == 3
