"""Streams against their batch twins, across restarts; growing files; guards."""

import json
import os
from datetime import timedelta
from functools import partial

import pytest
from perimetra.operators import serving, stateful
from perimetra.sources import live
from perimetra.streaming import folds
from pyspark.sql import functions as F

EPOCH = 1_700_000_000


def run(made, checkpoint):
    """Rows of all that is there now, by trigger; a later run with the same checkpoint goes on."""
    out = []
    query = made.writeStream.foreachBatch(lambda df, n: out.append([tuple(r) for r in df.collect()])).outputMode("update").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return [r for batch in out for r in batch]


class Feed:
    """A folder of parquet files that grows."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.rows = spark, str(folder), schema, []

    def add(self, rows):
        self.rows += rows
        self.frame(rows).coalesce(1).write.mode("append").parquet(self.folder)

    def frame(self, rows=None):
        df = self.spark.createDataFrame(self.rows if rows is None else rows, self.schema)
        return df.withColumn("ts", F.timestamp_seconds(F.col("t") + EPOCH))

    def live(self):
        return self.spark.readStream.schema(self.frame([]).schema).parquet(self.folder)


OFFERS = "site string, t double, seq long, camera_id long, track_id long, rule string"


def test_throttle_as_a_stream_equals_batch_across_a_restart(spark, tmp_path):
    rows = [(f"s{i % 2}", i * 900.0, i, i % 5, i % 23 % 4, "fence" if i % 3 else "loiter") for i in range(240)]
    feed = Feed(spark, tmp_path / "in", OFFERS)
    made = []
    for part in (rows[:90], rows[90:91], rows[91:]):
        feed.add(part)
        made += run(folds.stream(feed.live(), ["site"], stateful.Throttle, ttl=timedelta(days=3)), tmp_path / "cp")
    want = [tuple(r) for r in stateful.batch(feed.frame(), ["site"], stateful.Throttle).collect()]
    assert sorted(made) == sorted(want) and {r[6] for r in want} == {"repeat", "admitted", "dropped"}


class Changed(stateful.Hysteresis):
    """The same names and types of state in other code, as after a release."""

    def __init__(self):
        super().__init__()
        self.added_since = True


@pytest.mark.parametrize("make", [stateful.Hysteresis, stateful.Fusion, partial(stateful.Sampler, 0.5), stateful.DueSchedule])
def test_folds_go_on_where_they_stopped(spark, tmp_path, make):
    schema = "camera_id long, t double, seq long, hit boolean, agree boolean, fused double, frame long, before double"
    rows = [(k, float(i), i * 10 + k, bool((i + k) % 9 < 5), bool((i + k) % 7), i / 100, i, i - 1.0 if i else None) for k in range(3) for i in range(60)]
    feed = Feed(spark, tmp_path / "in", schema)
    made = []
    for low, high in ((0, 17), (17, 18), (18, 60)):
        feed.add([r for r in rows if low <= r[1] < high])
        later = Changed if make is stateful.Hysteresis and low else make
        made += run(folds.stream(feed.live(), ["camera_id"], later), tmp_path / "cp")
    want = [tuple(r) for r in stateful.batch(feed.frame(), ["camera_id"], make).collect()]
    assert sorted(made) == sorted(want) and want


EVENTS = "camera_id long, track_id long, t double, seq long, event_id string, stage string, evidence_id string, rules array<string>, reason string, reason_source string, confidence double"


def alert_events(count):
    stages = ("provisional", "confirmed", "sealed", "provisional")
    return [(i % 2, i % 6, float(i), i, f"e{i}", stages[(i // 6) % 4], f"ev{i}" if i % 5 == 0 else None, ["fence", "loiter", "group"][i % 3 : i % 3 + 2], f"r{i}", "model" if i % 7 == 0 else "template", i / 10) for i in range(count)]


def test_live_alerts_equal_the_merge_of_all_events(spark, tmp_path):
    rows = alert_events(90)
    feed = Feed(spark, tmp_path / "in", EVENTS)
    last = {}
    for part in (rows[40:70], rows[:40], rows[70:]):  # late events too
        feed.add(part)
        for r in run(folds.stream(feed.live(), ["camera_id", "track_id"], stateful.LiveAlert, delay="1 hour"), tmp_path / "cp"):
            last[r[:2]] = r
    merged = serving.merge_alerts(feed.frame(), ["camera_id", "track_id"], ["t", "seq"])
    want = merged.select("camera_id", "track_id", "event_id", "events", "stage", "rule_fired", "reason", "evidence_id", "confidence").collect()
    assert sorted(last.values()) == sorted(map(tuple, want)) and len(want) == 6


def test_a_silent_key_is_forgotten_by_a_timer(spark, tmp_path):
    event = lambda k, t: (1, k, t, int(t), f"e{int(t)}", "provisional", None, ["fence"], None, "template", 0.5)
    feed = Feed(spark, tmp_path / "in", EVENTS)
    made = []
    for part in ([event(1, 0.0), event(1, 1.0)], [event(2, 7200.0)], [event(2, 7300.0), event(1, 7300.0)]):
        feed.add(part)
        made += run(folds.stream(feed.live(), ["camera_id", "track_id"], stateful.LiveAlert, ttl=timedelta(hours=1)), tmp_path / "cp")
    assert [(r[1], r[2], r[3]) for r in sorted(made, key=lambda r: (r[1], r[2], r[3]))] == [(1, "e0", 2), (1, "e7300", 1), (2, "e7200", 1), (2, "e7200", 2)]


def test_a_fold_without_named_state_is_refused(spark, tmp_path):
    class Plain:
        columns, output = ("t", "seq"), "seq long"

    feed = Feed(spark, tmp_path / "in", "k long, t double, seq long")
    feed.add([(1, 1.0, 1)])
    with pytest.raises(TypeError):
        folds.stream(feed.live(), ["k"], Plain)


def test_guards_let_each_nonce_in_once_and_count_by_the_minute(spark, tmp_path):
    schema = "sender string, nonce string, sent double, received double, t double, seq long"
    rows = [("a", f"{i % 40:016x}", float(i), float(i) + (500 if i == 3 else 1), float(i), i) for i in range(60)] + [("a", "short", 1.0, 1.0, 1.0, 99)]
    feed = Feed(spark, tmp_path / "in", schema)
    made = []
    for part in (rows[:30], rows[30:]):
        feed.add(part)
        made += run(folds.guarded(feed.live(), ["sender"], 20), tmp_path / "cp")
    seen = [i for i in range(40) if i != 3] + [43]  # nonce 3 was refused for its skew, so its second use is the first
    assert sorted(r[1] for r in made) == sorted(seen)
    allowed = [r[1] for r in made if r[3]]
    assert len(allowed) == 20 and max(allowed) < 22


# growing files


def lines(*times):
    return "".join(json.dumps({"t": t, "n": i}) + "\n" for i, t in enumerate(times))


def growing(spark, folder, **options):
    live.register(spark)
    return spark.read.format(live.NAME).options(path=str(folder), **options).load()


def test_growing_files_lose_and_repeat_nothing(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    live.register(spark)
    stream = spark.readStream.format(live.NAME).options(path=str(folder), splitBytes=40).load()
    made = []

    def go():
        made.extend(run(stream, tmp_path / "cp"))

    (folder / "cam1.jsonl").write_text(lines(0.0, 0.5, 3.0) + '{"t": 3.5, "n": "to')
    go()
    assert [(r[0], r[2], r[3]) for r in sorted(made)] == [("cam1", 0.0, None), ("cam1", 0.5, None), ("cam1", 3.0, 2.5)]
    with open(folder / "cam1.jsonl", "a") as file:
        file.write('rn"}\nno json\n\n' + lines(4.0, 9.0))
    (folder / "cam2.jsonl").write_text(lines(*range(0, 60, 3)))
    (folder / "other.txt").write_text("not asked for\n")
    go()
    go()  # nothing new
    with open(folder / "cam2.jsonl", "a") as file:
        file.write(lines(57.5, 70.0))
    go()
    batch = [tuple(r) for r in growing(spark, folder, splitBytes=64).collect()]
    assert sorted(made) == sorted(batch) and len(batch) == 3 + 4 + 20 + 2
    own = sorted(r for r in batch if r[0] == "cam1")
    assert [(r[2], r[3]) for r in own[3:]] == [(3.5, None), (None, None), (4.0, None), (9.0, 5.0)]
    assert [r[3] for r in sorted(r for r in batch if r[0] == "cam2")][-3:] == [3.0, None, 12.5]
    assert sorted(map(tuple, growing(spark, folder).collect())) == sorted(batch)


def test_a_batch_that_failed_is_read_again(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    live.register(spark)
    (folder / "a.jsonl").write_text(lines(*range(10)))
    stream = spark.readStream.format(live.NAME).options(path=str(folder)).load()

    def fail(df, n):
        df.count()
        raise RuntimeError("lost")

    query = stream.writeStream.foreachBatch(fail).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination(120)
    with open(folder / "a.jsonl", "a") as file:
        file.write(lines(*range(10, 15)))
    made = run(stream, tmp_path / "cp")
    assert sorted(r[2] for r in made) == [float(i) for i in range(10)]  # the failed batch again, as it was
    made += run(stream, tmp_path / "cp")
    assert sorted(r[2] for r in made) == [float(i) for i in range(15)]


def test_files_that_shrink_or_go_and_folders_that_are_away_are_errors(spark, tmp_path):
    folder = live._Folder({"path": str(tmp_path), "tries": "3", "backoff": "0.01"})
    (tmp_path / "a.jsonl").write_text(lines(1.0, 2.0))
    start = folder.offsets()
    (tmp_path / "a.jsonl").write_text(lines(1.0))
    with pytest.raises(ValueError, match="shrunk"):
        folder.spans(start, folder.offsets())
    os.remove(tmp_path / "a.jsonl")
    with pytest.raises(ValueError, match="gone"):
        folder.spans(start, folder.offsets())
    with pytest.raises(OSError):
        live._Folder({"path": str(tmp_path / "nowhere"), "tries": "3", "backoff": "0.01"}).offsets()
    with pytest.raises(ValueError):
        live._Folder({})


def test_lines_far_longer_than_a_step_back(tmp_path):
    path = tmp_path / "long.jsonl"
    long = json.dumps({"t": 5.0, "x": "y" * 200_000}) + "\n"
    path.write_text(lines(1.0) + long + "bad\n" * 30_000 + lines(9.0) + "torn" * 40_000)
    end = live.whole_lines(str(path))
    rows = list(live.read_span(live.Span(str(path), 0, end, True), 2.0))
    assert end == os.path.getsize(path) - 160_000 and len(rows) == 30_003 and rows[-1][2:4] == (9.0, 4.0)
    parts = [r for low in range(0, end, 50_000) for r in live.read_span(live.Span(str(path), low, min(end, low + 50_000), low == 0), 2.0)]
    assert parts == rows
