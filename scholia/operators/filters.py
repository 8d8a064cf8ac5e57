"""Predicates over rows: keyword search, strict date ranges, validation with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matches_all(words: str, columns: list[Column]) -> Column:
    """Every blank-separated word occurs in some column, whatever its case."""
    out = F.lit(True)
    for word in words.lower().split():
        some = F.lit(False)
        for column in columns:
            some = some | F.coalesce(F.contains(F.lower(column), F.lit(word)), F.lit(False))
        out = out & some
    return out


def matches_none(words: str, columns: list[Column]) -> Column:
    return ~matches_all(words, columns)


def within_days(column: Column, first: str, last: str) -> Column:
    """Strictly after the first day's midnight and strictly before the last day's final
    second."""
    return (column > F.lit(f"{first} 00:00:00").cast("timestamp")) & (column < F.lit(f"{last} 23:59:59").cast("timestamp"))


def owned_by(props: Column, key: str, owner: str | int) -> Column:
    """Whether a JSON document names this owner."""
    return F.get_json_object(props, f"$.{key}") == F.lit(str(owner))


def with_reason(df: DataFrame, rules: list[tuple[str, Column]], out: str = "reason") -> DataFrame:
    """``df`` with the name of the first broken rule, or 'ok'.  A rule that is null for
    a row counts as broken."""
    reason = F.lit("ok")
    for name, holds in reversed(rules):
        reason = F.when(F.coalesce(holds, F.lit(False)), reason).otherwise(F.lit(name))
    return df.withColumn(out, reason)


#: Phrases of a channel, characters of a phrase and of free text, entries
#: asked for; a recording's length, characters of a segment and of all segments; titles of
#: answers that say nothing has changed.
CHANNEL, PHRASE, FREE_TEXT, MOST_WANTED = 20, 240, 1000, 20
RECORDING_MS, SEGMENT, ALL_SEGMENTS = 7_200_000, 4000, 50_000
UNCHANGED = ("没有变化", "没有以上症状，感觉正常", "没有加重或出现", "没有口腔溃疡")


def query_rules(channels: list[str], free_text: str = "free_text", top_k: str = "top_k") -> list[tuple[str, Column]]:
    """Rules of a search query for with_reason(): ``channels`` are columns of phrases."""
    given = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    each = lambda holds: _all(holds(given(c)) for c in channels)
    free = F.coalesce(F.col(free_text), F.lit(""))
    some = F.lit(False)
    for c in channels:
        some = some | F.exists(given(c), lambda p: F.trim(p) != "")
    return [
        ("too_many_phrases", each(lambda c: F.size(c) <= CHANNEL)),
        ("phrase_too_long", each(lambda c: F.forall(c, lambda p: F.length(p) <= PHRASE))),
        ("text_too_long", F.length(free) <= FREE_TEXT),
        ("bad_top_k", F.col(top_k).between(1, MOST_WANTED)),
        ("empty", some | (F.trim(free) != "")),
    ]


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def segment_rules(group: list[str], index: str = "index", start: str = "start_ms", stop: str = "end_ms", text: str = "text") -> list[tuple[str, Column]]:
    """Rules of a recording's segments: numbers positive and unique, times in order and
    inside two hours, texts of a bounded length each and together."""
    times = F.count("*").over(Window.partitionBy(*group, index))
    total = F.sum(F.length(text)).over(Window.partitionBy(*group))
    return [
        ("bad_index", (F.col(index) > 0) & (times == 1)),
        ("bad_times", (F.col(start) >= 0) & (F.col(start) < F.col(stop)) & (F.col(stop) <= RECORDING_MS)),
        ("bad_text", F.length(text).between(1, SEGMENT)),
        ("total_too_long", total <= ALL_SEGMENTS),
    ]


def given_answers(answers: DataFrame, bank: DataFrame, key: str = "q_id", value: str = "value", title: str = "title", mode: str = "mode") -> DataFrame:
    """Answers that say something: true ones, to options that are known, are no headings
    (mode -1) and do not say that nothing has changed."""
    true = ~F.lower(F.coalesce(F.col(value), F.lit(""))).isin("", "0", "false", "none")
    known = bank.filter((F.col(mode) != -1) & ~F.trim(title).isin(*UNCHANGED))
    return answers.filter(true).join(known, key)


def in_configured_range(entries: DataFrame, volumes: DataFrame, key: str = "id") -> DataFrame:
    """Entries whose number lies in their volume's range (volume, first_entry_id,
    last_entry_id); the volumes are a table of a few rows."""
    joined = entries.join(F.broadcast(volumes.select("volume", "first_entry_id", "last_entry_id")), "volume")
    number = F.try_to_number(F.col(key).cast("string"), F.lit("9999999999")).cast("long")
    return joined.withColumn("in_range", F.coalesce(number.between(F.col("first_entry_id"), F.col("last_entry_id")), F.lit(False)))
