"""Protocols over typed state: values, maps and timers instead of one document per key.

A processor declares what it keeps of a key, and each event reads and writes only the
entries it concerns, so a recording of hundreds of chunks costs as much per event as a new
one.  A key's state is let go ``days`` after its first event, by an event-time timer; events
that come after that, or more than ``delay_ms`` behind the latest of their key, are refused
with a reason.  The state lives in RocksDB (``use_typed_state``) and survives restarts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .encounters import act
from .protocols import ALL_TEXT, CHUNKS, DAYS, SENTENCE, SENTENCES, _digest

DAY_MS = 86_400_000


def use_typed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Keyed(StatefulProcessor):
    """Folds a key's events in order of ``at``; ``one`` returns (accepted, reason, more)."""

    #: Further columns of an outcome and their types.
    MORE: dict[str, str] = {}

    def __init__(self, key: str, carry: list[str], time: str, days: int = DAYS, delay_ms: int = DAYS * DAY_MS):
        self.key, self.carry, self.time, self.span, self.delay = key, carry, time, days * DAY_MS, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "ends long, latest long")
        self.kept = self.declare(handle)

    def declare(self, handle: StatefulProcessorHandle) -> list:
        """Sets the states up and lists them."""
        raise NotImplementedError

    def one(self, event: dict) -> tuple[bool, str, tuple]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("at", kind="stable")
        out = []
        for event in events.astype(object).where(events.notna(), None).to_dict("records"):
            now = int(pd.Timestamp(event[self.time]).timestamp() * 1000)
            ends, latest = self.life.get() if self.life.exists() else (None, now)
            if ends is None:
                ends = now + self.span
                self.handle.registerTimer(ends)
            if now >= ends:
                said = (False, "expired", ())
            elif now < latest - self.delay:
                said = (False, "late", ())
            else:
                said = self.one(event)
            self.life.update((ends, max(latest, now)))
            accepted, reason, more = said
            out.append((key[0], *(event[c] for c in self.carry), accepted, reason, *(more or [None] * len(self.MORE))))
        yield pd.DataFrame(out, columns=self.columns())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.life, *self.kept):
            state.clear()
        return iter([])

    def columns(self) -> list[str]:
        return [self.key, *self.carry, "accepted", "reason", *self.MORE]


class Snapshots(Keyed):
    """The latest sequence wins; a closed recording takes only an equal closing retry."""

    def declare(self, handle):
        self.held = handle.getValueState("held", "sequence long, closed boolean, digest string")
        return [self.held]

    def one(self, event):
        sequence, closed, digest = self.held.get() if self.held.exists() else (-1, False, None)
        if event.get("recover"):
            self.held.update((sequence, True, digest))
            return True, "recovered", ()
        body = _digest(event.get("body"))
        if closed:
            retry = bool(event["closed"]) and body == digest
            return retry, "retry" if retry else "closed", ()
        if event["sequence"] <= sequence:
            return False, "stale", ()
        self.held.update((int(event["sequence"]), bool(event["closed"]), body))
        return True, "ok", ()


class Chunks(Keyed):
    """Chunks of a recording, each in an entry of its own."""

    MORE = {"start_ms": "long"}
    FULL_MS = 10_000

    def declare(self, handle):
        self.tail = handle.getValueState("tail", "chunks int, short boolean")
        self.checksums = handle.getMapState("checksums", "index int", "checksum string")
        return [self.tail, self.checksums]

    def one(self, event):
        chunks, short = self.tail.get() if self.tail.exists() else (0, False)
        index = int(event["index"])
        if not 0 <= index < CHUNKS:
            return False, "bad_index", ()
        if index < chunks:
            same = self.checksums.getValue((index,))[0] == event["checksum"]
            return False, "repeat" if same else "conflict", ()
        if index > chunks or short:
            return False, "gap" if index > chunks else "after_short", ()
        self.checksums.updateValue((index,), (event["checksum"],))
        self.tail.update((index + 1, bool(event["duration_ms"] < self.FULL_MS)))
        return True, "ok", (index * self.FULL_MS,)


class Sentences(Keyed):
    """Partial results replace each other by sentence; only a changed final one counts."""

    def declare(self, handle):
        self.sizes = handle.getValueState("sizes", "sentences int, characters long")
        self.held = handle.getMapState("held", "index int", "characters int, digest string, final boolean")
        return [self.sizes, self.held]

    def one(self, event):
        index, text, final = int(event["index"]), event["text"] or "", bool(event["final"])
        sentences, characters = self.sizes.get() if self.sizes.exists() else (0, 0)
        before = self.held.getValue((index,)) if self.held.containsKey((index,)) else None
        if before and before[2] and not final:
            return False, "already_final", ()
        others = characters - (before[0] if before else 0)
        if len(text) > SENTENCE or others + len(text) > ALL_TEXT or (before is None and sentences >= SENTENCES):
            return False, "too_long", ()
        now = (len(text), _digest(text), final)
        self.held.updateValue((index,), now)
        self.sizes.update((sentences + (before is None), others + len(text)))
        changed = final and (before is None or tuple(before) != now)
        return changed, "final" if changed else "partial", ()


class Deltas(Keyed):
    """Pieces are appended to a list and read once, when the last one brings the usage."""

    MORE = {"text": "string"}

    def declare(self, handle):
        self.pieces = handle.getListState("pieces", "text string")
        self.ended = handle.getValueState("ended", "ended boolean")
        return [self.pieces, self.ended]

    def one(self, event):
        if self.ended.exists():
            return False, "ended", ()
        self.pieces.appendValue((event["text"] or "",))
        if event["usage"] is None:
            return False, "piece", ()
        self.ended.update((True,))
        return True, "ended", ("".join(p[0] for p in self.pieces.get()),)


class Encounters(Keyed):
    """Versioned actions; the document is read and written once an action."""

    MORE = {"version": "long", "confirmed": "array<boolean>", "revision": "string", "patient": "string"}

    def declare(self, handle):
        self.document = handle.getValueState("document", "version long, document string")
        return [self.document]

    def one(self, event):
        version, document = self.document.get() if self.document.exists() else (0, None)
        state, said = act({"version": version, "document": json.loads(document)} if document else {}, event)
        if said["accepted"]:
            self.document.update((state["version"], said["revision"]))
        return said["accepted"], said["reason"], (said["version"], said["confirmed"], said.get("revision"), said.get("patient"))


class Previews(StatefulProcessor):
    """The latest text of a key by ``at``, shown by a timer ``wait_ms`` after it changed; rows
    of a batch may come in any order."""

    def __init__(self, key: str, text: str, wait_ms: int):
        self.key, self.text, self.wait = key, text, wait_ms

    def init(self, handle):
        self.handle = handle
        self.held = handle.getValueState("held", "at long, waiting string, shown string, due long")

    def handleInputRows(self, key, rows, timerValues):
        at, waiting, shown, due = self.held.get() if self.held.exists() else (None, "", "", 0)
        for frame in rows:
            newest = frame.loc[frame["at"].idxmax()]
            if at is None or newest["at"] > at:
                at, waiting = int(newest["at"]), newest[self.text] or ""
        if waiting != shown and not due:
            due = timerValues.getCurrentProcessingTimeInMs() + self.wait
            self.handle.registerTimer(due)
        self.held.update((at, waiting, shown, due))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at, waiting, shown, _ = self.held.get()
        self.held.update((at, waiting, waiting, 0))
        if waiting != shown:
            yield pd.DataFrame({self.key: [key[0]], "preview": [waiting]})


def outcomes(stream: DataFrame, processor: Keyed) -> DataFrame:
    """The outcome of every event, beside its carried columns."""
    use_typed_state(stream.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (processor.key, *processor.carry)), "accepted boolean", "reason string", *(f"{c} {kind}" for c, kind in processor.MORE.items())])
    watched = stream.withWatermark(processor.time, f"{processor.span // DAY_MS} days")
    return watched.groupBy(processor.key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def previews(stream: DataFrame, key: str, text: str, wait_ms: int = 4000) -> DataFrame:
    use_typed_state(stream.sparkSession)
    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).transformWithStateInPandas(Previews(key, text, wait_ms), f"`{key}` {kind}, preview string", "Append", "ProcessingTime")
