"""Protocols as folds, and as streams over files."""

import datetime
import json

from pyspark.sql import functions as F

from scholia.streaming import encounters as E
from scholia.streaming import protocols as P


def folded(fold, events):
    state, out = {}, []
    for e in events:
        state, said = fold(state, e)
        out.append(said["reason"])
    return out


def test_snapshot_fold():
    s = lambda n, closed=False, body="x": {"sequence": n, "closed": closed, "body": body}
    assert folded(P.snapshot, [s(1), s(1), s(3), s(2), s(4, True), s(5), s(4, True), s(4, True, "y")]) == ["ok", "stale", "ok", "stale", "ok", "closed", "retry", "closed"]


def test_chunk_fold():
    c = lambda i, sum_="a", ms=10_000: {"index": i, "checksum": sum_, "duration_ms": ms}
    assert folded(P.chunk, [c(0), c(0), c(0, "b"), c(2), c(1, ms=500), c(2)]) == ["ok", "repeat", "conflict", "gap", "ok", "after_short"]


def test_sentence_and_delta_folds():
    s = lambda i, t, f: {"index": i, "text": t, "final": f}
    assert folded(P.sentence, [s(0, "a", False), s(0, "ab", True), s(0, "ab", True), s(0, "a", False)]) == ["partial", "final", "partial", "already_final"]
    state = {}
    for text, usage in (("he", None), ("llo", None), (None, 12)):
        state, said = P.delta(state, {"text": text, "usage": usage})
    assert said == {"accepted": True, "reason": "ended", "text": "hello"}


def test_stream_keeps_state_between_batches(spark, tmp_path):
    schema = "recording string, at long, sequence long, closed boolean, body string"
    for n, rows in enumerate([[("r", 1, 1, False, "a"), ("q", 1, 7, False, "b")], [("r", 2, 1, False, "a"), ("r", 3, 2, True, "c"), ("r", 4, 3, False, "d")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = P.stateful(stream, "recording", P.snapshot, ["at", "sequence"], ["accepted", "reason"])
    run = out.writeStream.format("memory").queryName("snapshots").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r.recording, r["at"]): r.accepted for r in spark.table("snapshots").collect()}
    assert len(got) == 5 and got["r", 1] and got["q", 1] and got["r", 3] and not got["r", 4]


def test_upserts_by_batch(spark, tmp_path):
    schema = "k int, v string, at int"
    for rows in ([(1, "a", 1), (1, "b", 2), (2, "c", 1)], [(2, "d", 2), (1, "late", 1), (3, "e", 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    P.upsert_batches(stream, str(tmp_path / "out"), ["k"], "at", str(tmp_path / "cp")).awaitTermination(120)
    want = {(1, "b"), (2, "d"), (3, "e")}
    assert {(r.k, r.v) for r in P.upserted(spark, str(tmp_path / "out"), ["k"], "at").collect()} == want
    assert {(r.k, r.v) for r in P.compacted(spark, str(tmp_path / "out"), ["k"], "at", str(tmp_path / "merged")).collect()} == want


def test_recovery_and_expiry():
    s = lambda n, closed=False, body="x", **more: {"sequence": n, "closed": closed, "body": body, **more}
    assert folded(P.snapshot, [s(1), s(0, recover=True), s(2), s(1, True)]) == ["ok", "recovered", "closed", "retry"]
    day = 86_400_000
    c = lambda i, at: {"index": i, "checksum": "a", "duration_ms": 10_000, "at": at}
    assert folded(P.until_expiry(P.chunk), [c(0, day), c(1, 30 * day), c(2, 31 * day), c(720, 2 * day)]) == ["ok", "ok", "expired", "bad_index"]


def test_previews_keep_their_timer():
    held, shown = ("", "", 0), []
    for now, text in [(0, "a"), (1000, "ab"), (2000, "abc"), (4000, None), (5000, "abc"), (6000, "abcd"), (9000, "abcde"), (10_000, None), (20_000, None)]:
        held, due = P.previewed(held, text, now, 4000)
        shown.append(due)
    assert shown == [None, None, None, "abc", None, None, None, "abcde", None] and held == ("abcde", "abcde", 0)


def test_long_texts_and_repeats_of_sentences():
    s = lambda i, t, f=True: {"index": i, "text": t, "final": f}
    events = [s(0, "a" * 4001), *(s(i, "a" * 4000) for i in range(13)), s(12, "b" * 2000), s(0, "a" * 4000)]
    assert folded(P.sentence, events) == ["too_long", *["final"] * 12, "too_long", "final", "partial"]


def steps(*events):
    state, said = {}, []
    for action, data in events:
        state, out = E.act(state, {"version": state.get("version", 0), "action": action, "data": json.dumps(data)})
        said.append(out["reason"])
    return state, said


WHOLE = [
    ("confirm_intake", {"patient": {"name": "n"}, "text": "t", "inspection": "i", "reviewed": True}),
    ("analyze", {"result": {"cause": "c"}}),
    ("confirm_analysis", {}),
    ("retrieve", {"result": [{"id": "1", "name": "甲", "fields": {"组成": "药一两", "用法": "水煎"}}, {"id": "2", "name": "乙", "fields": {}}]}),
    ("select_formulas", {"ids": ["1"]}),
    ("confirm_prescription", {"reviewed": True}),
    ("generate_record", {"result": "whole"}),
    ("confirm_record", {"reviewed": True}),
]


def test_an_encounter_runs_through_its_stages():
    state, said = steps(*WHOLE)
    document = state["document"]
    assert said == ["ok"] * len(WHOLE) and document["confirmed"] == [True] * 5 and state["version"] == 8
    assert document["prescription"]["text"] == "【甲 · 原方参考】\n药一两\n\n水煎"
    # equal saves change nothing, others clear what follows
    same, _ = E.act(state, {"version": 8, "action": "save_analysis", "data": json.dumps({"value": {"cause": "c"}})})
    assert same["document"]["confirmed"] == [True] * 5 and same["version"] == 9
    other, _ = E.act(state, {"version": 8, "action": "save_analysis", "data": json.dumps({"value": {"cause": "d"}})})
    assert other["document"]["confirmed"] == [True, True, False, False, False] and other["document"]["candidates"] == [] and other["document"]["record"] == ""
    fresh, out = E.act(state, {"version": 8, "action": "save_patient", "data": json.dumps({"patient": {"name": "m"}})})
    assert fresh["document"]["confirmed"] == [False] * 5 and fresh["document"]["examinations"] is None and json.loads(out["patient"]) == {"name": "m"}
    assert E.act(state, {"version": 7, "action": "save_record", "data": "{}"})[1]["reason"] == "conflict"


def test_actions_have_preconditions():
    assert steps(("analyze", {"result": {}}), ("organize", {"result": {}}), ("save_record", {"text": "x"}), ("fly", {}), ("confirm_intake", {"text": "t", "reviewed": False}))[1] == ["examinations_open", "no_transcript", "no_record", "unknown_action", "not_reviewed"]
    state, said = steps(*WHOLE[:4], ("select_formulas", {"ids": ["9"]}), ("select_formulas", {"ids": ["1", "1"]}), ("confirm_prescription", {}), ("select_formula", {"id": "2"}), ("confirm_prescription", {"reviewed": True}), ("save_prescription", {"value": {"text": "甲（剂量待核）"}}), ("confirm_prescription", {"reviewed": True}))
    assert said[4:] == ["unknown_candidate", "bad_choice", "no_prescription", "ok", "ok", "ok", "dose_unsettled"] and state["document"]["confirmed"][3] is False
    assert len(E.ACTIONS) == 19


def test_voice_is_summed_up_once():
    segments = [{"id": "a", "index": 1, "text": "x"}, {"id": "b", "index": 2, "text": "y"}]
    result = {"summary": "s", "symptoms": [{"label": "l", "source_ids": ["a"]}]}
    state, said = steps(("finalize_voice", {"segments": segments, "result": result}), ("save_transcript", {"text": "mended"}), ("finalize_voice", {"segments": segments[::-1], "result": {"summary": "other"}}), ("finalize_voice", {"segments": segments[:1], "result": {**result, "symptoms": [{"label": "l", "source_ids": ["b"]}]}}))
    assert said == ["ok", "ok", "ok", "unknown_source"] and state["document"]["transcript"] == "mended" and state["document"]["original"] == "x\ny"


def test_encounter_stream_leaves_revisions(spark, tmp_path):
    rows = [("p", i, i, a, json.dumps(d), datetime.datetime(2024, 1, 1, 0, i)) for i, (a, d) in enumerate(WHOLE)] + [("p", 99, 3, "save_record", "{}", datetime.datetime(2024, 1, 1, 1))]
    schema = "encounter string, at long, version long, action string, data string, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = P.stateful(stream, "encounter", E.act, ["at", "action"], E.OUTCOME, time="ts")
    run = out.writeStream.format("memory").queryName("encounters").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    said = spark.table("encounters")
    assert said.filter("reason = 'conflict'").count() == 1
    kept = E.revisions(said).orderBy("version").collect()
    assert [r.version for r in kept] == list(range(1, 9)) and kept[-1].confirmed == [True] * 5 and json.loads(kept[-1].revision)["record"] == "whole"
    assert [r.version for r in E.patient_details(said, "encounter").collect()] == [1]


def test_closing_clamps_segments(spark):
    segments = spark.createDataFrame([("r", 0, 0, 900, "a"), ("r", 1, 900, 2000, "b"), ("r", 2, 1600, 1700, "c")], "recording string, index int, start_ms int, end_ms int, text string")
    got = P.clamp_segments(segments, spark.createDataFrame([("r", 1500)], "recording string, duration_ms int")).orderBy("index").collect()
    assert [(r.end_ms, r.refused) for r in got] == [(900, False), (1500, False), (1500, True)]
    assert P.fingerprint(segments).first().fingerprint == P.fingerprint(segments.orderBy(F.desc("index"))).first().fingerprint
