"""Ordered, at-least-once protocols as stateful streams.

Each protocol is a small fold (state, event) -> (state, outcome) over one key's
events; ``stateful`` runs a fold under ``applyInPandasWithState``.  Rows of a key
that arrive in one batch are folded in order of their ``at`` column.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Fold = Callable[[dict, dict], tuple[dict, dict]]


#: Chunks of a recording at most (two hours of ten seconds), sentences of a
#: recording, characters of a sentence and of all, days that a recording is kept.
CHUNKS, SENTENCES, SENTENCE, ALL_TEXT, DAYS = 720, 1000, 4000, 50_000, 30


def snapshot(state: dict, event: dict) -> tuple[dict, dict]:
    """The latest sequence wins; a closed recording takes only an equal closing retry.  An
    event with ``recover`` closes what there is and adds nothing."""
    if event.get("recover"):
        return {"sequence": -1, "digest": None, **state, "closed": True}, {"accepted": True, "reason": "recovered"}
    same = _digest(event.get("body"))
    if state.get("closed"):
        retry = bool(event["closed"]) and same == state["digest"]
        return state, {"accepted": retry, "reason": "retry" if retry else "closed"}
    if event["sequence"] <= state.get("sequence", -1):
        return state, {"accepted": False, "reason": "stale"}
    return {"sequence": event["sequence"], "closed": bool(event["closed"]), "digest": same}, {"accepted": True, "reason": "ok"}


def _digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value).encode()).hexdigest()


def chunk(state: dict, event: dict, full_ms: int = 10_000) -> tuple[dict, dict]:
    """A chunk follows the ones there; an equal repeat is no-op, another checksum a
    conflict; nothing follows a short chunk.  A recording has CHUNKS of them at most, so
    the checksums that are held have a bound."""
    held = list(state.get("chunks", []))
    index = event["index"]
    if not 0 <= index < CHUNKS:
        return state, {"accepted": False, "reason": "bad_index"}
    if index < len(held):
        same = held[index] == event["checksum"]
        return state, {"accepted": False, "reason": "repeat" if same else "conflict"}
    if index > len(held):
        return state, {"accepted": False, "reason": "gap"}
    if state.get("short"):
        return state, {"accepted": False, "reason": "after_short"}
    return {**state, "chunks": [*held, event["checksum"]], "short": event["duration_ms"] < full_ms}, {"accepted": True, "reason": "ok", "start_ms": index * full_ms}


def until_expiry(fold: Fold, at: str = "at", days: int = DAYS) -> Fold:
    """``fold`` that refuses what comes ``days`` after a key's first event or later
    (``at`` in milliseconds)."""

    def limited(state: dict, event: dict) -> tuple[dict, dict]:
        ends = state.get("expires", event[at] + days * 86_400_000)
        if event[at] >= ends:
            return state, {"accepted": False, "reason": "expired"}
        held, said = fold({k: v for k, v in state.items() if k != "expires"}, event)
        return {**held, "expires": ends}, said

    return limited


def sentence(state: dict, event: dict) -> tuple[dict, dict]:
    """Partial results replace each other by sentence; only a changed final one counts.
    A sentence is held as its length, a digest and whether it is final."""
    held = dict(state.get("held", {}))
    index, text, final = str(event["index"]), event["text"] or "", bool(event["final"])
    before = held.get(index)
    if before and before[2] and not final:
        return state, {"accepted": False, "reason": "already_final"}
    now = [len(text), _digest(text), final]
    others = sum(n for i, (n, _, _) in held.items() if i != index)
    if len(text) > SENTENCE or others + len(text) > ALL_TEXT or (before is None and len(held) >= SENTENCES):
        return state, {"accepted": False, "reason": "too_long"}
    changed = final and before != now
    return {"held": {**held, index: now}}, {"accepted": changed, "reason": "final" if changed else "partial"}


def delta(state: dict, event: dict) -> tuple[dict, dict]:
    """Pieces add up; the last piece carries the usage and ends the record."""
    if state.get("ended"):
        return state, {"accepted": False, "reason": "ended", "text": state["text"]}
    state = {"text": state.get("text", "") + (event["text"] or ""), "ended": event["usage"] is not None}
    return state, {"accepted": state["ended"], "reason": "ended" if state["ended"] else "piece", "text": state["text"]}


_OUTCOMES = {
    "accepted": "boolean", "reason": "string", "version": "long", "confirmed": "array<boolean>", "text": "string", "start_ms": "long", "revision": "string", "patient": "string",
}


def stateful(stream: DataFrame, key: str, fold: Fold, carry: list[str], outcome: list[str], at: str = "at", time: str | None = None, days: int = DAYS) -> DataFrame:
    """Every event's outcome beside the ``carry`` columns of the event.

    With a ``time`` column state is let go ``days`` after a key's latest event, by the
    watermark; without one it is held for good."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = ", ".join([f"`{key}` {kinds[key]}", *(f"`{c}` {kinds[c]}" for c in carry), *(f"{o} {_OUTCOMES[o]}" for o in outcome)])
    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else {}
        rows = []
        events = pd.concat(list(frames)).sort_values(at, kind="stable")
        for event in events.astype(object).where(events.notna(), None).to_dict("records"):
            held, said = fold(held, event)
            rows.append({key: group[0], **{c: event[c] for c in carry}, **{o: said.get(o) for o in outcome}})
        if time:
            latest = max(held.get("latest", 0), int(events[time].max().timestamp() * 1000))
            held = {**held, "latest": latest}
            state.setTimeoutTimestamp(max(latest + days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        state.update((json.dumps(held),))
        yield pd.DataFrame(rows, columns=[key, *carry, *outcome])

    watched = stream.withWatermark(time, f"{days} days") if time else stream
    return watched.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", timeout)


def previewed(held: tuple[str, str, int], arrived: str | None, now: int, wait_ms: int) -> tuple[tuple[str, str, int], str | None]:
    """(what was shown, what waits, when it is due; 0: no timer) after a text arrived or the
    time passed, and the preview to show if it is due.

    The first change starts a timer which later changes do not move, so that a steady
    stream shows a preview every ``wait_ms``."""
    shown, waiting, due = held
    if arrived is not None:
        waiting = arrived
        due = due or (now + wait_ms if waiting != shown else 0)
    if due and now >= due:
        return (waiting, waiting, 0), (waiting if waiting != shown else None)
    return (shown, waiting, due), None


def previews(stream: DataFrame, key: str, text: str, wait_ms: int = 4000, at: str = "at") -> DataFrame:
    """Previews of a key's text, one every ``wait_ms`` of processing time at most, and only
    if the text has changed since the one before.  The text is that of the largest ``at``
    so far, whatever the order in which rows arrive."""
    kind = dict(stream.dtypes)[key]

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *held, newest = state.get if state.exists else ("", "", 0, -(1 << 63))
        now, arrived = state.getCurrentProcessingTimeMs(), None
        if not state.hasTimedOut:
            for frame in frames:
                if len(frame) and frame[at].max() > newest:
                    last = frame.loc[frame[at].idxmax()]
                    newest, arrived = int(last[at]), last[text]
        held, due = previewed(tuple(held), arrived, now, wait_ms)
        state.update((*held, newest))
        if held[2]:
            state.setTimeoutDuration(max(1, held[2] - now))
        if due is not None:
            yield pd.DataFrame({key: [group[0]], "preview": [due]})

    return stream.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, preview string", "shown string, waiting string, due long, newest long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def slots(stream: DataFrame, ts: str, seconds: int = 10, delay: str = "30 days") -> DataFrame:
    """Events counted in tumbling slots; what comes later than ``delay`` is dropped."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, f"{seconds} seconds").alias("slot")).agg(F.count("*").alias("n"))


def clamp_segments(segments: DataFrame, durations: DataFrame, key: str = "recording") -> DataFrame:
    """At closing time segments end with the audio; one that starts beyond it is refused."""
    joined = segments.join(durations, key)
    return joined.withColumn("refused", F.col("start_ms") >= F.col("duration_ms")).withColumn("end_ms", F.least("end_ms", "duration_ms"))


def fingerprint(segments: DataFrame, key: str = "recording") -> DataFrame:
    """A digest of a recording's segments that their order of arrival does not change."""
    ordered = F.array_sort(F.collect_list(F.struct("index", "start_ms", "end_ms", "text")))
    return segments.groupBy(key).agg(F.sha2(F.to_json(ordered), 256).alias("fingerprint"))


def upsert_batches(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str):
    """A started query that adds each micro-batch's latest row per key below ``path``.

    A batch writes what it holds and no more, in a folder of its own number, so that a
    repeated batch replaces itself; ``upserted`` reads the table, ``compacted`` merges it."""
    from ..operators.records import latest

    def add(batch: DataFrame, number: int) -> None:
        latest(batch, keys, [F.desc(order)]).drop("place").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key over all batches."""
    from ..operators.records import latest

    return latest(spark.read.parquet(path), keys, [F.desc(order), F.desc("batch")]).drop("place", "batch")


def compacted(spark: SparkSession, path: str, keys: list[str], order: str, folder: str) -> DataFrame:
    """The same as one batch in a new folder, from which a stream may go on."""
    upserted(spark, path, keys, order).write.mode("overwrite").parquet(f"{folder}/batch=-1")
    return spark.read.parquet(folder)
