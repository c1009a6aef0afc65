"""Results of operators whose work used to grow faster than their input, on crowded input."""

import itertools
import math
import time
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
from perimetra.functions import stats
from perimetra.operators import evaluation, events, grouping, ranging, search, stateful, tracker, tracks
from perimetra.plans import catalogue
from perimetra.sources import store
from pyspark.sql import functions as F


def _closed(place, radius):
    """Sets of connected points by comparing all with all."""
    top = list(range(len(place)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(range(len(place)), 2):
        if np.sqrt(((place[a] - place[b]) ** 2).sum()) <= radius:
            top[find(a)] = find(b)
    sets = {}
    for x in range(len(place)):
        sets.setdefault(find(x), []).append(f"m{x:05d}")
    return sorted(s for s in sets.values() if len(s) >= 2)


def test_clusters_equal_the_closure_of_all_pairs(monkeypatch):
    monkeypatch.setattr(grouping, "FEW", 3)
    rng = np.random.default_rng(5)
    for spread in (20, 60, 150):
        place = np.concatenate((rng.uniform(-spread, spread, (150, 2)).round(1), [[0, 0], [10, 0], [300, 0], [310, 0], [310, 10.0001]]))
        pdf = pd.DataFrame({"scope": "a", "at": 1.0, "member": [f"m{x:05d}" for x in range(len(place))], "px": place[:, 0], "py": place[:, 1]})
        assert sorted(grouping._clusters(pdf, 10.0, 2)["members"]) == _closed(place, 10.0)


def test_a_crowd_is_one_group_without_its_pairs(spark):
    n = 20_000  # 200 million pairs
    rows = spark.range(n).select(F.lit(1).cast("long").alias("camera_id"), F.col("id").alias("track_id"), F.explode(F.array(F.lit(0.0), F.lit(6.0))).alias("t"))
    rows = rows.select("*", F.col("track_id").alias("seq"), (F.col("track_id") % 100 / 10.0).alias("x"), F.lit(1.0).alias("y"))
    got = grouping.groups(rows, 20.0, 4, 5.0, 3.0).select(F.size("members").alias("n"), "first_at", "last_at").collect()
    assert [tuple(r) for r in got] == [(n, 0.0, 6.0)]


def test_members_do_not_carry_the_names_of_their_group(spark):
    n = 20_000
    verdicts = spark.range(n).select(F.lit(1).cast("long").alias("camera_id"), F.col("id").alias("track_id"), F.lit("").alias("rule_fired"), F.lit("").alias("reason"), F.lit(0).cast("long").alias("n_rules"))
    names = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.concat(F.lit("1|"), k.cast("string")))
    groups = spark.range(1).select(names.alias("members"), F.lit(3.0).alias("first_at"), F.lit(5.0).alias("duration"))
    pairs = spark.createDataFrame([(["1|1", "1|3"], 2.0, 1.0), (["1|1", "1|2"], 2.0, 2.0)], "members array<string>, first_at double, duration double")
    got = tracks.with_groups(verdicts, groups.unionByName(pairs)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("track_id").alias("least")).collect()
    crowd = f"in a group of {n} for 5 s"
    two = lambda s: f"in a group of 2 for {s} s; "
    assert {tuple(r) for r in got} == {(crowd, n - 3, 0), (two(2) + two(1) + crowd, 1, 1), (two(2) + crowd, 1, 2), (two(1) + crowd, 1, 3)}


def test_trailing_counts_equal_a_plain_count(spark):
    rng = np.random.default_rng(3)
    rows = [(int(c), float(t)) for c, t in zip(rng.integers(0, 2, 600), rng.integers(-300, 900, 600) / 4, strict=True)] + [(None, 1.0), (None, 5.0), (1, None), (1, None)]
    got = {(r["k"], r["t"]): (r["n0"], r["n1"]) for r in ranging.trailing_counts(spark.createDataFrame(rows, "k long, t double"), ["k"], "t", (10.0, 24.25)).collect()}
    assert got.keys() == set(rows)
    for (k, t), n in got.items():
        assert n == tuple(sum(a == k and (u is None if t is None else u is not None and t - w <= u <= t) for a, u in rows) for w in (10.0, 24.25))


def test_a_full_window_is_not_counted_row_by_row(spark):
    rows = spark.range(150_000).select(F.lit(1).alias("k"), F.col("id").alias("t"))  # 150,000 rows in each window: 22 thousand million, one by one
    got = ranging.trailing_counts(rows, ["k"], "t", (150_000,))
    assert got.filter("n0 <> t + 1").count() == 0 and got.count() == 150_000


def test_triggers_of_one_hour_do_not_meet_all_its_frames(spark, tmp_path):
    n = 30_000  # 900 million pairs
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") * 100_000).alias("ts"), F.lit(6).cast("long").alias("user_id"), F.lit("purchase").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k":1}').alias("props"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = catalogue.queries()["clip_window"](spark, str(tmp_path)).groupBy("frames").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, n - 4)]


def test_poisson_intervals_of_large_counts_take_no_longer():
    began = time.perf_counter()
    low, high = stats.poisson_interval(6_000_000)
    assert time.perf_counter() - began < 5
    assert abs(low - 5995200.0355) < 0.01 and abs(high - 6004802.8592) < 0.01  # by the cube of Wilson and Hilferty
    for k in (stats.MANY, 3000):  # the same sums with and without the terms that do not count
        for mean in (k / 6, k * 0.9, k - 2 * k**0.5, k, k + 2 * k**0.5, k * 1.5, k * 4):
            plain = sum(math.exp(-mean + i * math.log(mean) - math.lgamma(i + 1)) for i in range(k + 1))
            assert abs(stats._poisson_below(k, mean) - min(1.0, plain)) < 1e-10


def test_headings_at_an_edge_are_cut_like_the_statement(spark):
    from perimetra.functions import geometry as g

    rows = [(7.000000000000001, 7.0), (7.0, 7.0), (-7.0, 7.000000000000001), (1.0, -1e-16), (0.0, -1.0)]
    h = g.heading(F.col("vx"), F.col("vy"))
    got = spark.createDataFrame(rows, "vx double, vy double").select("vx", "vy", h.alias("h"), g.flow_label(h).alias("flow"), g.compass(h).alias("compass")).collect()
    for r in got:
        own = (math.degrees(math.atan2(r["vy"], r["vx"])) + 360.0) % 360.0
        assert r["h"] == own and r["flow"] == ("ltr" if own < 45 or own >= 315 else "ttb" if own < 135 else "rtl" if own < 225 else "btt")
    assert got[0]["flow"] == "ttb" and got[3]["h"] == 0.0


def test_tracks_along_a_diagonal_have_the_statements_labels(spark, tmp_path):
    rng = np.random.default_rng(3)
    start, way, turn = rng.uniform(0, 500, 4000).round(2), rng.integers(1, 100, 4000), rng.choice([-1, 1], (2, 4000))
    began, took = rng.integers(0, 40_000_000_000, 4000), rng.integers(1, 40_000_000_000, 4000)
    rows = [(user, "view", int(t), x, y) for user in range(4000) for t, x, y in ((began[user], start[user], 100), (began[user] + took[user], round(start[user] + turn[0, user] * way[user], 2), 100 + turn[1, user] * way[user]))]
    pd.DataFrame([(i, pd.Timestamp("2024-01-01") + pd.Timedelta(microseconds=t), user, kind, float(x), f'{{"k": {y}}}') for i, (user, kind, t, x, y) in enumerate(rows)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
        told = db.sql(catalogue.oracle_sql()["direction_labels"]).fetchall()
    got = catalogue.queries()["direction_labels"](spark, str(tmp_path)).collect()
    assert len(told) == 4000 and sorted(told) == sorted(map(tuple, got))


def test_ordering_once_gives_what_the_curves_give(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i // 5), int(i), "abcz"[int(c)], float(v) / 40, int(a), int(b)) for i, (c, v, a, b) in enumerate(zip(rng.integers(0, 4, 400), rng.integers(0, 41, 400), rng.random(400) < 0.6, rng.random(400) < 0.1, strict=True))]
    rows = spark.createDataFrame(rows, "image long, pred_id long, cls string, conf double, one long, two long")
    gt = spark.createDataFrame([("a",)] * 70 + [("b",)] * 90 + [("c",)] * 300 + [("d",)] * 3, "cls string")
    got = {(r["hits"], r["cls"]): (r["n_gt"], r["ap"]) for r in evaluation.precisions_of(rows, gt, ["one", "two"], predicted=rows).collect()}
    for name in ("one", "two"):
        plain = evaluation.average_precision(evaluation.curve(rows.withColumn("gt_id", F.when(F.col(name) == 1, 1)), gt), gt, predicted=rows).collect()
        assert {(name, r["cls"]) for r in plain} == {k for k in got if k[0] == name} and len(plain) == 5
        for r in plain:
            n, ap = got[name, r["cls"]]
            assert n == r["n_gt"] and (ap is None) == (r["ap"] is None) and (ap is None or abs(ap - r["ap"]) < 1e-12)


def test_matching_step_by_step_takes_the_same_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(i % 2), int(i), float(t), float(x), float(y)) for i, (t, x, y) in enumerate(zip(rng.integers(0, 3000, 300), *rng.integers(0, 100, (2, 300)), strict=True))]
    both = spark.createDataFrame(rows, "k long, id long, t double, x double, y double")
    got = {tuple(r) for r in stateful.match_nearest(both.filter("id < 160"), both.filter("id >= 160"), ["k"], 600.0, 40.0).collect()}
    monkeypatch.setattr(stateful, "SCALES", (1,))
    assert len(got) > 50 and got == {tuple(r) for r in stateful.match_nearest(both.filter("id < 160"), both.filter("id >= 160"), ["k"], 600.0, 40.0).collect()}


def test_a_document_is_parsed_once_for_all_its_checks(spark, capsys):
    rows = spark.createDataFrame([('{"schema":"event.v1","detection":{"bbox":[0,2],"channel_scores":{"odd":1}},"rule":{"metrics":{"net_px":-1}}}',), ("[1]",), (None,)], "raw string")
    for errors in (events.event_errors, events.update_errors):
        rows.select(errors(F.col("raw"), "event.v1").alias("e")).explain(True)
        plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
        assert plan.count("from_json") == 2  # the document, and the texts of its objects
    got = [r["e"] for r in rows.select(events.event_errors(F.col("raw"), "event.v1", 40).alias("e")).collect()]
    assert got[1:] == [["$: no object"], ["$: no object"]]
    assert {"$.detection.channel_scores: unknown key", "$.detection.bbox: bad length", "$.detection.bbox: out of range", "$.rule.metrics.net_px: out of range", "$.rule.fired: required"} <= set(got[0])


def test_suppression_in_rounds_keeps_what_the_fold_keeps(spark):
    rng = np.random.default_rng(2)
    places = rng.integers(0, 60, (900, 2)).astype(float)
    rows = [(None if k % 7 == 0 else int(k % 3), int(k // 2), float(s) / 50, *p.tolist(), float(p[0] + w), float(p[1] + 20), bool(k % 2)) for k, (p, s, w) in enumerate(zip(places, rng.integers(0, 50, 900), rng.integers(0, 30, 900), strict=True))]
    boxes = spark.createDataFrame(rows, "image long, id long, score double, x1 double, y1 double, x2 double, y2 double, windowed boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = [tuple(r) for r in stateful.nms(boxes, ["image"], 0.3, 9, ["windowed"]).select("image", "id", "score", "x1", "windowed").collect()]
        grid = {tuple(r[:4]): list(r["limits"]) for r in stateful.nms_grid(boxes, ["image"], (0.3, 0.6), 9).select("image", "id", "score", "x1", "limits").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for limit in (0.3, 0.6):
        want = []
        for image in (None, 0, 1, 2):
            fold = stateful.Suppress(limit, 9)
            for r in sorted((r for r in rows if r[0] == image), key=lambda r: (-r[2], r[1], *r[3:7])):
                want += [(image, r[1], r[2], r[3], r[7]) for _ in fold.step((r[1], *r[3:7], r[2]))]
        assert limit > 0.3 or sorted(map(str, got)) == sorted(map(str, want))
        assert {w[:4] for w in want} == {k for k, held in grid.items() if limit in held}


def test_a_crowd_of_boxes_takes_as_many_rounds_as_it_keeps():
    n = 400_000  # box by box, each compared with all kept ones, this took more than ten seconds
    x = np.random.default_rng(1).integers(0, 400, n) * 1.0
    box = np.stack((x, x * 0, x + 20.0, x * 0 + 20.0, x * 0 + 400.0))
    began = time.perf_counter()
    kept = stateful.kept_boxes(np.zeros(n, int), box, 0.3, 300, np.zeros(0, int))
    assert time.perf_counter() - began < 5 and 15 < len(kept) < 40


def test_rows_beyond_a_task_are_dealt_to_more(spark, monkeypatch, capsys):
    rng = np.random.default_rng(6)
    rows = [(int(i // 6), "ab"[int(c)], int(i), float(v) / 20, float(x), 0.0, float(x) + 20.0, 20.0) for i, (c, v, x) in enumerate(zip(rng.integers(0, 2, 600), rng.integers(0, 20, 600), rng.integers(0, 20, 600), strict=True))]
    pred = spark.createDataFrame(rows, "image long, cls string, pred_id long, conf double, x1 double, y1 double, x2 double, y2 double")
    gt = pred.filter("pred_id % 2 = 0").withColumnRenamed("pred_id", "gt_id").drop("conf")
    made = lambda: (evaluation.match(gt, pred), evaluation.curve(pred.withColumn("gt_id", F.when(F.col("pred_id") % 3 > 0, 1)), gt))
    usual = [sorted(map(str, df.collect())) for df in made()]
    monkeypatch.setattr(store, "ROWS_AT_ONCE", 60)  # ten tasks, where the session has four
    for df, want in zip(made(), usual, strict=True):
        df.explain()
        assert ", 10), REPARTITION_BY_NUM" in capsys.readouterr().out and sorted(map(str, df.collect())) == want


def test_shingles_of_a_batch_are_not_held_at_once():
    text = " ".join(f"word{i}" for i in range(4000))
    tracemalloc.start()
    hashes = search.majorities(search._shingled(f"{text} {k}") for k in range(150))  # 600,000 shingles
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(hashes) == 150 and peak < 40e6


def _scene(seed, frames=150, most=6):
    """Frames of a crowded view: t, whether detected, and the detections' cls, score and box."""
    rng = np.random.default_rng(seed)
    for k in range(frames):
        at = rng.uniform(0, 150, (int(rng.integers(0, most)), 2)).round()
        yield k * 0.5, bool(rng.integers(0, 5)), [(str(rng.choice(["car", "truck", "person"])), float(rng.integers(0, 100) / 100), [x, y, x + 60, y + 60]) for x, y in at.tolist()]


def test_tracks_cut_into_parts_equal_their_frames_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(tracker, "DETECTIONS_AT_ONCE", 20)
    rows, frames, want = [], [], []
    for camera in range(6):
        fold = tracker.Tracks(tracker.Settings(buffer=5.0))
        for t, detected, found in _scene(camera):
            ids = [len(rows) + k for k in range(len(found))]
            rows += [(camera, t, k, cls, score, *box) for k, (cls, score, box) in zip(ids, found, strict=True)]
            frames.append((camera, t, detected))
            want += [(camera, *r) for r in fold.step((t, detected, ids, [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]))]
    kind = "camera long, t double, seq long, cls string, score double, x1 double, y1 double, x2 double, y2 double"
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = tracker.track_boxes(spark.createDataFrame(rows, kind), spark.createDataFrame(frames, "camera long, t double, detected boolean"), ["camera"], tracker.Settings(buffer=5.0))
        assert got.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert {r["state"] for r in got.select("state").distinct().collect()} == {"tentative", "confirmed", "lost"}
        assert sorted(map(tuple, got.collect()), key=lambda r: r[:3]) == sorted(want, key=lambda r: r[:3])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)


def test_a_track_moves_as_a_filter_of_eight_values():
    ahead, fold, mean = np.eye(8) + np.eye(8, k=4), tracker.Tracks(), None
    rng = np.random.default_rng(8)
    for k in range(60):
        box = np.array([5 * k, 40, 5 * k + 40, 120]) + rng.normal(0, 1.5, 4)
        seen = k % 3 != 2
        (row,) = fold.step((k * 0.05, seen, [k] * seen, ["person"] * seen, [0.9] * seen, [box.tolist()] * seen))
        z = np.array([box[[0, 2]].mean(), box[[1, 3]].mean(), (box[2] - box[0]) / (box[3] - box[1]), box[3] - box[1]])
        sizes = lambda h, place, aspect, velocity, turn: np.diag(np.array([place * h, place * h, aspect, place * h, velocity * h, velocity * h, turn, velocity * h]) ** 2)
        if mean is None:
            mean, cov = np.concatenate((z, np.zeros(4))), sizes(z[3], 2 / 20, 1e-2, 10 / 160, 1e-5)
        else:
            cov = ahead @ cov @ ahead.T + sizes(mean[3], 1 / 20, 1e-2, 1 / 160, 1e-5)
            mean = ahead @ mean
            if seen:
                both = cov[:4, :4] + sizes(mean[3], 1 / 20, 1e-1, 0, 0)[:4, :4]
                gain = cov[:, :4] @ np.linalg.inv(both)
                mean, cov = mean + gain @ (z - mean[:4]), cov - gain @ both @ gain.T
        x, y, aspect, height = mean[:4]
        np.testing.assert_allclose(row[6:], [x - aspect * height / 2, y - height / 2, x + aspect * height / 2, y + height / 2], rtol=1e-9, atol=1e-9)


def test_many_live_tracks_are_moved_together(spark):
    n, frames = 1000, 3000  # three million rows; track by track, this took 23 s
    far = F.col("id") * 100.0
    rows = spark.range(n).select(F.lit(1).alias("camera"), F.lit(0.0).alias("t"), F.col("id").alias("seq"), F.lit("car").alias("cls"), F.lit(0.9).alias("score"), far.alias("x1"), F.lit(0.0).alias("y1"), (far + 60).alias("x2"), F.lit(60.0).alias("y2"))
    times = spark.range(frames).select(F.lit(1).alias("camera"), F.col("id").cast("double").alias("t"), (F.col("id") == 0).alias("detected"))
    began = time.perf_counter()
    got = tracker.track_boxes(rows, times, ["camera"], tracker.Settings(buffer=1e9)).agg(F.count(F.lit(1)), F.count("seq"), F.sum("x1")).first()
    took = time.perf_counter() - began
    assert got[:2] == (n * frames, n) and abs(got[2] - 100.0 * frames * n * (n - 1) / 2) < 1e3
    assert took < 10
