"""Doses out of composition text: herbs of a vocabulary, quantities, units, conversion.

A composition is read as a whole or not at all.  Each text turns into its items: a pattern cuts the text into tokens, one for each herb with what follows it, and a
fold from the last token to the first hands doses back over the herbs before them.  Joins
and decimals in Spark do the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from decimal import Decimal
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Chinese digits and powers of ten, units, those of weight that need a
#: confirmed factor, those that do not, and what may stand between herbs.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
TENS = {"十": 10, "百": 100, "千": 1000}
UNITS = ("毫克", "mg", "克", "g", "钱匕", "两", "钱", "分", "厘", "斤", "铢", "枚", "个", "片", "升", "合", "盏")
OLD_WEIGHTS = ("两", "钱", "分", "厘", "斤", "铢")
METRIC = {"g": Decimal(1), "克": Decimal(1), "mg": Decimal("0.001"), "毫克": Decimal("0.001")}
BETWEEN = " \t\r\n、，,；;。"

#: Texts of more characters than this do not read: fixed value.
LONGEST = 20_000

_DIGIT, _TEN = "".join(DIGITS), "".join(TENS)
#: A quantity: a number, a unit, and half a unit unless that begins the name of the herb 半夏.
_QUANTITY = rf"(?i:(\d+(?:\.\d+)?|[{_DIGIT}{_TEN}半]+)\s*({'|'.join(UNITS)})(半(?!夏))?)"
_QUANTITIES = re.compile(_QUANTITY)
_NUMERAL, _PLACE = re.compile(rf"(?:[{_DIGIT}]?[{_TEN}])*[{_DIGIT}]?"), re.compile(rf"([{_DIGIT}]?)([{_TEN}]|$)")

_ARROW = pa.struct(
    [("place", pa.int32()), ("herb", pa.string()), ("dose", pa.string()), ("quantities", pa.list_(pa.struct([("amount", pa.decimal128(20, 6)), ("unit", pa.string())]))), ("note", pa.string())]
)
_ITEM = "place int, herb string, dose string, quantities array<struct<amount:decimal(20,6),unit:string>>, note string"
Dose = tuple[str, list[tuple[Decimal, str]]]


class Token(NamedTuple):
    """A herb with its note, whether 各 or 等分 stand before its dose, and the dose."""

    herb: str
    note: str
    shared: bool
    equal: bool
    dose: Dose


class Unreadable(Exception):
    """Some part of a composition does not read."""


def numeral(text: str) -> Decimal | None:
    """The value of digits or of a Chinese numeral; None where it is not clear: 一二 may be
    twelve or a slip, and 两 of 三两二钱 a digit or a unit."""
    if text[0].isascii():
        return Decimal(text)
    if text == "半":
        return Decimal("0.5")
    if not _NUMERAL.fullmatch(text):
        return None
    return Decimal(sum((DIGITS.get(digit) or 1) * TENS[ten] if ten else DIGITS.get(digit, 0) for digit, ten in _PLACE.findall(text)))


def amounts(dose: str) -> list[tuple[Decimal, str]]:
    found = []
    for number, unit, half in _QUANTITIES.findall(dose):
        value = numeral(number)
        value = value if value is None else value + (Decimal("0.5") if half else 0)
        if value is None or value <= 0:
            raise Unreadable(dose)
        found.append((value, unit.lower()))
    return found


class Lexer:
    """Cuts compositions into tokens with the herbs of a vocabulary, the longest name first."""

    def __init__(self, herbs: Iterable[str]):
        names = "|".join(map(re.escape, sorted(set(herbs), key=lambda h: (-len(h), h))))
        gap = f"[{BETWEEN}]*"
        plain = re.sub(r"\((?!\?)", "(?:", _QUANTITY)
        self.token = re.compile(rf"{gap}(?P<herb>{names}){gap}(?P<note>\([^)]*\)|（[^）]*）)?{gap}(?P<shared>各{gap})?(?P<dose>(?P<equal>等分)?(?:{plain})*){gap}")
        self.gap = re.compile(gap)

    def tokens(self, text: str) -> Iterator[Token]:
        at = self.gap.match(text).end()
        while at < len(text):
            found = self.token.match(text, at)
            if found is None or (found["shared"] and not found["dose"]):
                raise Unreadable(text[at:])
            yield Token(found["herb"], found["note"] or "", bool(found["shared"]), bool(found["equal"]), (found["dose"], amounts(found["dose"])))
            at = found.end()


def handed_back(tokens: list[Token]) -> list[Dose]:
    """The dose of each token.  Herbs without one take what the next dose after them hands
    back: a shared dose itself, equal parts their name, any other nothing."""
    none, equal = ("", []), ("等分", [])
    doses, back = [], none
    for token in reversed(tokens):
        if token.dose[0]:
            back = token.dose if token.shared else equal if token.equal else none
            doses.append(equal if token.equal and not token.shared else token.dose)
        else:
            doses.append(back)
    return doses[::-1]


def read(lexer: Lexer, text: str | None) -> list[tuple[Token, Dose]]:
    """Tokens with their doses; none if any part of the text does not read."""
    if not text or len(text) > LONGEST:
        return []
    try:
        tokens = list(lexer.tokens(text))
    except Unreadable:
        return []
    return list(zip(tokens, handed_back(tokens)))


#: Texts that a worker remembers.
KNOWN = 100_000


@lru_cache(4)
def _reader(herbs: tuple[str, ...]):
    lexer = Lexer(herbs)

    @lru_cache(KNOWN)
    def items(text: str | None) -> list[dict]:
        """The items of a text, or one with place 0 if it does not read."""
        found = read(lexer, text)
        rows = [
            {"place": place, "herb": token.herb, "dose": dose, "quantities": [{"amount": a.quantize(Decimal("0.000001")), "unit": u} for a, u in quantities], "note": token.note}
            for place, (token, (dose, quantities)) in enumerate(found, 1)
        ]
        return rows or [{"place": 0, "herb": None, "dose": None, "quantities": None, "note": None}]

    return items


def extract(df: DataFrame, id_col: str, text_col: str, herbs: Iterable[str]) -> DataFrame:
    """(id, place, herb, dose, quantities, note) of every entry that reads in full; an
    entry that does not gives one row with place 0 and no herb."""
    herbs = tuple(herbs)

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _reader(herbs)
        for batch in batches:
            # each different text of a batch is read once, and its items are dealt out to its rows
            texts = batch.column(1).dictionary_encode(null_encoding="encode")
            found = [own(t) for t in texts.dictionary.to_pylist()]
            table = pa.array([item for of in found for item in of], _ARROW)
            sizes = np.array([len(of) for of in found], np.int64)
            starts, codes = np.cumsum(sizes) - sizes, texts.indices.to_numpy()
            n = sizes[codes]
            rows = np.repeat(np.arange(len(codes)), n)
            at = np.repeat(starts[codes] - (np.cumsum(n) - n), n) + np.arange(len(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *table.take(pa.array(at)).flatten()], [id_col, *_ARROW.names])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(items, f"`{id_col}` {kind}, {_ITEM}")


def to_grams(items: DataFrame, factors: DataFrame, id_col: str) -> DataFrame:
    """``items`` with grams (six digits, half up, null unless every quantity of the item
    has a factor), the entry's units of old weight and whether its factors were refused.

    Metric units convert of themselves.  Old weights need factors confirmed for the entry
    (``factors``: id, unit, factor), one for each of its units and none besides."""
    confirmed = factors.filter(F.col("unit").isin(*OLD_WEIGHTS) & (F.col("factor") > 0))
    given = confirmed.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("unit", F.col("factor").cast("decimal(20,9)")))).alias("__given"))
    own = F.transform(F.coalesce("quantities", F.array().cast("array<struct<amount:decimal(20,6),unit:string>>")), lambda q: q["unit"])
    # a window over an entry's items: these are not made twice, and do not move twice
    used = F.filter(F.flatten(F.collect_list(own).over(Window.partitionBy(id_col))), lambda u: u.isin(*OLD_WEIGHTS))
    joined = items.withColumn("units", F.array_sort(F.array_distinct(used))).join(given, id_col, "left")
    fits = F.array_sort(F.map_keys("__given")) == F.col("units")
    metric = F.create_map(*(F.lit(x) for kv in METRIC.items() for x in kv)).cast("map<string,decimal(20,9)>")
    known = F.when(fits, F.map_concat(metric, "__given")).otherwise(metric)
    grams = F.transform("quantities", lambda q: q["amount"] * F.element_at("__known", q["unit"]))
    total = F.aggregate("__grams", F.lit(0).cast("decimal(38,15)"), lambda a, g: (a + g).cast("decimal(38,15)"))
    rows = joined.withColumn("__known", known).withColumn("__grams", grams)
    whole = (F.size("quantities") > 0) & ~F.exists("__grams", lambda g: g.isNull())
    rounded = F.round(F.when(whole, total), 6).cast("decimal(30,6)")
    return rows.withColumn("grams", rounded).withColumn("refused", F.col("__given").isNotNull() & ~fits).drop("__given", "__known", "__grams")


def plain(number: Column) -> Column:
    """A decimal without trailing zeros."""
    return F.regexp_replace(number.cast("string"), r"\.?0+$", "")


def references(texts: DataFrame, items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, warnings): each composition as it is shown, an item's grams or its own
    dose behind its name, and what a reader must check.  ``items`` come from to_grams()."""
    dose = F.coalesce(F.concat(plain(F.col("grams")), F.lit("g")), F.nullif("dose", F.lit("")), F.lit("（剂量待核）"))
    unit_kinds = F.transform("quantities", lambda q: q["unit"])
    counted = F.exists(unit_kinds, lambda u: ~u.isin(*OLD_WEIGHTS, *METRIC))
    shown = items.filter("herb is not null").withColumn("display", F.concat("herb", dose, "note"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "display")))
    per_entry = shown.groupBy(id_col).agg(
        F.array_join(F.transform(ordered, lambda x: x["display"]), "、").alias("shown"),
        F.max(F.col("dose") == "").alias("undosed"),
        F.max(F.size("units") > 0).alias("old"),
        F.max(counted).alias("counted"),
    )
    raw = F.trim(F.coalesce(text_col, F.lit("")))
    whole = texts.select(F.col(id_col), raw.alias("raw")).join(per_entry, id_col, "left")
    warnings = F.array_compact(
        F.array(
            F.when((F.col("raw") != "") & F.col("shown").isNull(), "not_separated"),
            F.when(F.coalesce("undosed", F.lit(False)) | (F.col("raw") == ""), "dose_missing"),
            F.when(F.col("old"), "old_weights"),
            F.when(F.col("counted"), "counts_kept"),
        )
    )
    return whole.select(id_col, F.coalesce("shown", "raw").alias("text"), warnings.alias("warnings"))
