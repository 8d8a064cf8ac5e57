"""Typed state, refused events, buckets, versions and formats of our own."""

import datetime
import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from scholia.sources import pages as S
from scholia.sources import readers, versions
from scholia.streaming import keyed, sinks
from scholia.streaming import protocols as P

START = datetime.datetime(2024, 1, 1)
SCHEMA = "recording string, at long, index int, duration_ms int, checksum string, ts timestamp"


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def run_all(spark, tmp_path, stream):
    sinks.split(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(180)
    accepted, refused = (sinks.side(spark, str(tmp_path / "out"), n).collect() for n in ("accepted", "refused"))
    return accepted, refused


def test_chunks_in_typed_state(spark, tmp_path):
    rng = random.Random(5)
    events, at = [], 0
    for r in ("a", "b"):
        for _ in range(25):
            at += 1
            events.append((r, at, rng.choice([0, 0, 1, 1, 2, 3, 4, 720]), rng.choice([10_000, 10_000, 10_000, 500]), rng.choice("xy"), START + datetime.timedelta(minutes=at)))
    feed(spark, tmp_path / "in", events[:20], SCHEMA)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    out = lambda: keyed.outcomes(stream(), keyed.Chunks("recording", ["at"], "ts"))
    run_all(spark, tmp_path, out())
    # the query starts anew from its checkpoint
    feed(spark, tmp_path / "in", events[20:], SCHEMA)
    accepted, refused = run_all(spark, tmp_path, out())
    want, states = {}, {}
    for r, t, index, ms, checksum, _ in events:
        states[r], said = P.chunk(states.get(r, {}), {"index": index, "duration_ms": ms, "checksum": checksum})
        want[r, t] = (said["accepted"], said["reason"], said.get("start_ms"))
    assert {(x.recording, x["at"]): (x.accepted, x.reason, x.start_ms) for x in accepted + refused} == want
    assert all(x.accepted for x in accepted) and not any(x.accepted for x in refused) and len(accepted) + len(refused) == len(events)


def test_state_is_let_go_after_thirty_days_and_late_events_are_refused(spark, tmp_path):
    day = lambda d, h=0: START + datetime.timedelta(days=d, hours=h)
    batches = [
        [("a", 1, 0, 10_000, "x", day(0)), ("a", 2, 1, 10_000, "x", day(2)), ("a", 3, 2, 10_000, "x", day(0, 1))],
        [("b", 4, 0, 10_000, "x", day(70))],
        [("b", 5, 1, 10_000, "x", day(71))],
        [("a", 6, 0, 10_000, "z", day(72)), ("b", 7, 2, 10_000, "x", day(100))],
    ]
    for rows in batches:
        feed(spark, tmp_path / "in", rows, SCHEMA)
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        accepted, refused = run_all(spark, tmp_path, keyed.outcomes(stream, keyed.Chunks("recording", ["at"], "ts", delay_ms=keyed.DAY_MS)))
    # without the timer the sixth event would be expired, or in conflict with the first
    assert {x["at"] for x in accepted} == {1, 2, 4, 5, 6} and {x["at"]: x.reason for x in refused} == {3: "late", 7: "expired"}


def test_a_repeated_batch_leaves_refused_events_once(spark, tmp_path):
    rows = [("a", 1, True, "ok"), ("a", 2, False, "late")]
    batch = spark.createDataFrame(rows, "recording string, at long, accepted boolean, reason string")
    side = F.when(F.col("accepted"), "accepted").otherwise("refused")
    for _ in range(2):
        batch.withColumn("side", side).write.mode("overwrite").partitionBy("side").parquet(str(tmp_path / "out/batch=0"))
    assert [r["at"] for r in sinks.side(spark, str(tmp_path / "out"), "refused").collect()] == [2]


@pytest.mark.parametrize("name", ["snapshots", "sentences", "deltas", "encounters"])
def test_other_protocols_equal_their_folds(spark, tmp_path, name):
    from scholia.streaming import encounters as E

    ts = lambda n: START + datetime.timedelta(minutes=n)
    if name == "snapshots":
        schema, fold, processor = "k string, at long, sequence long, closed boolean, body string, ts timestamp", P.snapshot, keyed.Snapshots
        rows = [("a", n, s, c, b, ts(n)) for n, (s, c, b) in enumerate([(1, False, "x"), (1, False, "x"), (3, False, "y"), (2, False, "y"), (4, True, "z"), (5, False, "z"), (4, True, "z"), (4, True, "w")])]
    elif name == "sentences":
        schema, fold, processor = "k string, at long, index int, text string, final boolean, ts timestamp", P.sentence, keyed.Sentences
        rows = [("a", n, i, t, f, ts(n)) for n, (i, t, f) in enumerate([(0, "a" * 4001, True), *((i, "a" * 4000, True) for i in range(13)), (12, "b" * 2000, True), (0, "a" * 4000, True), (0, "b", False), (1, "c", True)])]
    elif name == "deltas":
        schema, fold, processor = "k string, at long, text string, usage int, ts timestamp", P.delta, keyed.Deltas
        rows = [("a", 0, "he", None, ts(0)), ("a", 1, "llo", None, ts(1)), ("a", 2, None, 12, ts(2)), ("a", 3, "!", None, ts(3)), ("b", 4, "x", 1, ts(4))]
    else:
        schema, fold, processor = "k string, at long, version long, action string, data string, ts timestamp", E.act, keyed.Encounters
        steps = [(0, "confirm_intake", {"text": "t", "reviewed": True}), (1, "analyze", {"result": {"c": 1}}), (1, "confirm_analysis", {}), (2, "confirm_analysis", {}), (3, "save_record", {"text": "r"})]
        rows = [("a", n, v, a, json.dumps(d), ts(n)) for n, (v, a, d) in enumerate(steps)]
    feed(spark, tmp_path / "in", rows, schema)
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    accepted, refused = run_all(spark, tmp_path, keyed.outcomes(stream, processor("k", ["at"], "ts")))
    names, states, want, texts = [c.split()[0] for c in schema.split(", ")], {}, {}, {}
    for row in rows:
        event = dict(zip(names, row))
        states[event["k"]], said = fold(states.get(event["k"], {}), event)
        want[event["at"]] = (said["accepted"], said["reason"])
        texts[event["at"]] = said.get("text") if said["accepted"] else None
    assert {x["at"]: (x.accepted, x.reason) for x in accepted + refused} == want
    if name == "deltas":
        assert {x["at"]: x.text for x in accepted} == {2: "hello", 4: "x"}


def test_previews_show_the_latest_text_whatever_the_order(spark, tmp_path):
    schema = "k string, at long, text string"
    feed(spark, tmp_path / "in", [("a", 3, "third"), ("a", 1, "first"), ("a", 2, "second")], schema)
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = keyed.previews(stream, "k", "text", wait_ms=500).writeStream.format("memory").queryName("typed_previews").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    import time

    for _ in range(60):
        time.sleep(1)
        if spark.table("typed_previews").count():
            break
    run.stop()
    assert [(r.k, r.preview) for r in spark.table("typed_previews").collect()] == [("a", "third")]


def test_lookups_read_one_batch_of_a_bucket(spark, tmp_path):
    path, schema = str(tmp_path / "table"), "k int, v string, at int"
    for n in range(6):
        sinks.merge_batch(spark.createDataFrame([(k, f"{n}", n) for k in range(n, 40)], schema), n, path, ["k"], "at", 4)
    sinks.merge_batch(spark.createDataFrame([(k, "5", 5) for k in range(5, 40)], schema), 5, path, ["k"], "at", 4)  # again
    sinks.merge_batch(spark.createDataFrame([(7, "late", 1), (99, "new", 9)], schema), 6, path, ["k"], "at", 4)
    rows = {r.k: r.v for r in sinks.whole_table(spark, path).collect()}
    assert rows == {k: str(min(k, 5)) for k in range(40)} | {99: "new"}
    found = sinks.looked_up(spark.createDataFrame([(3,), (7,)], "k int"), path, ["k"], 4)
    assert {r.k: r.v for r in found.collect()} == {3: "3", 7: "5"} and len({f.split("/bucket=")[1].split("/")[0] for f in found.inputFiles()}) == len(found.inputFiles())


def test_outputs_change_all_at_once(spark, tmp_path):
    path, df = str(tmp_path / "out"), spark.range(3)
    versions.publish(spark, path, {"a": df, "b": lambda done: done["a"].filter("id > 0")})
    with pytest.raises(ZeroDivisionError):
        versions.publish(spark, path, {"a": spark.range(9), "b": lambda done: 1 / 0})
    assert versions.read(spark, path, "a").count() == 3 and versions.read(spark, path, "b").count() == 2
    assert len(versions.cleared(spark, path)) == 1
    versions.publish(spark, path, {"a": spark.range(5)})
    assert versions.read(spark, path, "a").count() == 5 and len(versions.cleared(spark, path)) == 1
    with pytest.raises(FileNotFoundError):
        versions.read(spark, str(tmp_path / "none"), "a")


def test_formats(spark, tmp_path):
    readers.register(spark)
    page = lambda n: {"pdf_page": n, "volume": 1, "book_page": None, "layout": "one_column", "regions": [{"name": "body", "crop": [0.0], "lines": [{"text": f"第{n}页", "confidence": 0.9, "box": [[0.0, 1.0]]}]}]}
    assert len(readers.write_archive(map(page, range(1, 101)), str(tmp_path / "packed"), 16)) == 7
    whole = spark.read.format("packed_pages").option("path", str(tmp_path / "packed")).load()
    assert whole.count() == 100 and whole.schema == spark.createDataFrame([], S.PAGE).schema
    some = spark.read.format("packed_pages").option("first", 30).option("last", 33).option("path", str(tmp_path / "packed")).load()
    assert sorted((r.pdf_page, r.regions[0].lines[0].text) for r in some.collect()) == [(n, f"第{n}页") for n in range(30, 34)] and some.rdd.getNumPartitions() == 2
    # any gzip reader expands the archive
    assert S.read_pages(spark, str(tmp_path / "packed/pages.jsonl.gz")).count() == 100
    with pytest.raises(ValueError):
        readers.write_archive(map(page, [2, 1]), str(tmp_path / "bad"))

    (tmp_path / "deltas").mkdir()
    file = tmp_path / "deltas" / "r1"
    out = lambda: spark.readStream.format("framed_deltas").option("path", str(tmp_path / "deltas")).load().writeStream.format("parquet").option("path", str(tmp_path / "frames")).option("checkpointLocation", str(tmp_path / "fcp")).trigger(once=True).start().awaitTermination(120)
    file.write_text('{"a": 1}endendend{"a": 2}enden')
    out()
    with file.open("a") as more:
        more.write('dend  endendend{"甲": 3}endendend{"half"')
    out()
    frames = sorted((r.file, r["at"], r.body) for r in spark.read.parquet(str(tmp_path / "frames")).collect())
    assert [f[2] for f in frames] == ['{"a": 1}', '{"a": 2}', '{"甲": 3}'] and frames[1][1] == 17

    with sqlite3.connect(tmp_path / "db") as db:
        db.execute("create table visits (id integer, name text)")
        db.executemany("insert into visits values (?, ?)", [(i, f"n{i}") for i in range(-5, 100)] + [(None, "no key")])
    table = lambda **more: spark.read.format("ranged_table").options(driver="sqlite3", url=str(tmp_path / "db"), table="visits", key="id", low="0", high="90", parts="5", schema="id long, name string", **more).load()
    assert table().count() == 106 and table().rdd.getNumPartitions() == 5 and table().filter("id is null").count() == 1
