"""Text functions as column expressions; Python only where Spark has no equivalent."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: CJK range of the search tokenizer, white space, and separators of phrases.
CJK = "㐀-鿿"
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SEPARATORS = f"[{WHITE},，、;；。.!！?？:：/|]+"

#: Letters that OCR confuses with digits, for entry ids and for index ids.
ID_REPAIR = ("OoIl", "0011")
INDEX_REPAIR = ("OoIlQBS", "0011085")


@cache
def unsettled(form: str) -> str:
    """A regular expression for characters that a normal form may change: those that it
    changes alone, and those that may join the one before them."""
    ranges: list[list[int]] = []
    for code in range(0xA0, 0x110000):
        c = chr(code)
        if not 0xD800 <= code < 0xE000 and (unicodedata.combining(c) or 0x1160 <= code < 0x1200 or not unicodedata.is_normalized(form, c)):
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    listed = lambda some: "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in some) + "]"
    latin, rest = [r for r in ranges if r[1] < 0x250] or [[0xFFFF, 0xFFFF]], [r for r in ranges if r[1] >= 0x250]
    # most characters are ASCII, Latin or CJK: they are passed over before the long list is tried
    return f"(?=[^\\x00-\\x9f])(?:{listed(latin)}|(?=[^\\x00-\\x{{24f}}{CJK}]){listed(rest)})"


def _composed(form: str):
    @F.pandas_udf(T.StringType())
    def compose(values: pd.Series) -> pd.Series:
        return values.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")

    return compose


nfkc, nfc = _composed("NFKC"), _composed("NFC")


def composed(text: Column, form: str) -> Column:
    """The text in a normal form; only texts that may change reach Python."""
    return F.coalesce((nfkc if form == "NFKC" else nfc)(F.when(F.rlike(text, F.lit(unsettled(form))), text)), text)


@F.pandas_udf(T.DoubleType())
def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two short strings; a pair that comes again is not compared again."""
    from difflib import SequenceMatcher

    pairs = list(zip(left, right))
    of = {(a, b): None if a is None or b is None else 1.0 if a == b else SequenceMatcher(None, a, b).ratio() for a, b in set(pairs)}
    return pd.Series([of[pair] for pair in pairs], dtype="float64")


def plain(text: Column) -> Column:
    """Lower case without white space at either end, null as ''."""
    return F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(WHITE))


def normalize(text: Column) -> Column:
    """Compatibility forms folded, lower case, no white space at either end; null as ''."""
    return plain(composed(text, "NFKC"))


def normalize_space(text: Column) -> Column:
    """Composed; wide blanks to blanks, no byte-order mark, runs of blanks as one."""
    return F.trim(F.regexp_replace(F.translate(composed(text, "NFC"), "　\ufeff", " "), r"[ \t]+", " "))


def split_phrases(text: Column) -> Column:
    """The normalised text's parts between separators, each once, in order of appearance."""
    return F.array_distinct(F.filter(F.split(normalize(text), SEPARATORS), lambda p: p != ""))


def runs_of(text: Column, n: int) -> Column:
    """All runs of ``n`` characters, in order; none of a shorter text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def bigrams(run: Column) -> Column:
    return F.when(F.length(run) <= 1, F.array(run)).otherwise(runs_of(run, 2))


def tokens_of(text: Column) -> Column:
    """Search tokens of a text that is normalised already."""
    runs = F.regexp_extract_all(text, F.lit(f"[a-z0-9]+|[{CJK}]+"), F.lit(0))
    paired = F.flatten(F.transform(runs, lambda r: F.when(F.rlike(r, F.lit("^[a-z0-9]")), F.array(r)).otherwise(bigrams(r))))
    # most texts have no CJK run, and then the runs are the tokens
    return F.when(F.rlike(text, F.lit(f"[{CJK}]")), paired).otherwise(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)))


def search_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 whole, CJK runs as overlapping pairs."""
    return tokens_of(normalize(text))


def phrase_grams(phrase: Column) -> Column:
    """The different search tokens of a normalised phrase."""
    return F.array_distinct(tokens_of(phrase))


def phrase_similarity(phrase: Column, text: Column, grams: Column | None = None) -> Column:
    """1.0 where the text holds the phrase, else the share of its search tokens that the
    text holds, 0.0 without any; both are normalised.  ``grams`` are phrase_grams() where
    those are at hand."""
    grams = phrase_grams(phrase) if grams is None else grams
    hits = F.size(F.filter(grams, lambda g: F.contains(text, g)))
    share = hits / F.greatest(F.size(grams), F.lit(1))
    return F.when((phrase == "") | (text == ""), F.lit(0.0)).when(F.contains(text, phrase), F.lit(1.0)).otherwise(share)


def repair_id(raw: Column, table: tuple[str, str] = ID_REPAIR) -> Column:
    return F.translate(raw, *table)


def digit_repairs(digits: Column) -> Column:
    """All five-digit ids one digit away: one replaced (5), one missing (4) or one too
    many (6 digits)."""
    ten = F.sequence(F.lit(0), F.lit(9))
    n = F.length(digits)
    replaced = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.transform(ten, lambda d: F.concat(F.substring(digits, F.lit(1), i - 1), d.cast("string"), F.substring(digits, i + 1, F.lit(5))))))
    added = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.transform(ten, lambda d: F.concat(F.substring(digits, F.lit(1), i), d.cast("string"), F.substring(digits, i + 1, F.lit(5))))))
    dropped = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(F.substring(digits, F.lit(1), i - 1), F.substring(digits, i + 1, F.lit(6))))
    return F.array_distinct(F.when(n == 5, replaced).when(n == 4, added).when(n == 6, dropped).otherwise(F.array().cast("array<string>")))


def compact_name(text: Column) -> Column:
    """Without blanks, dots, ellipses and stars."""
    return F.regexp_replace(text, r"[\s.·…*＊]+", "")


def clean_term(text: Column) -> Column:
    """Without punctuation at either edge."""
    return F.regexp_replace(text, r"^[\s,.;:，。；：、]+|[\s,.;:，。；：、]+$", "")


def join_wrapped(lines: Column) -> Column:
    """Lines as one string: a blank only between two ASCII word characters, none after
    a hyphen that ends a line."""

    def step(text: Column, line: Column) -> Column:
        apart = F.rlike(F.right(text, F.lit(1)), F.lit("[A-Za-z0-9]")) & F.rlike(F.left(line, F.lit(1)), F.lit("[A-Za-z0-9]"))
        return F.when(text == "", line).when(apart, F.concat(text, F.lit(" "), line)).otherwise(F.concat(text, line))

    return F.aggregate(F.transform(lines, lambda x: F.trim(x)), F.lit(""), step)


def chunks(text: Column, size: int = 240) -> Column:
    """The text in pieces of ``size`` characters; none of an empty text."""
    n = F.ceil(F.length(text) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def truncated(text: Column, limit: int, mark: str = "……") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit)), F.lit(mark))).otherwise(text)


def outline_level(line: Column) -> Column:
    """0 for 一、 headings, 1 for 1.1, 2 for 1.1.1, 3 for 1.1.1.1, else null."""
    dots = F.regexp_extract(line, r"^\s*(\d+(?:\.\d+)+)", 1)
    level = F.length(dots) - F.length(F.replace(dots, F.lit("."), F.lit("")))
    return F.when(F.rlike(line, F.lit("^\\s*[一二三四五六七八九十]+、")), F.lit(0)).when(level > 0, level)


def annotations(text: Column) -> Column:
    """(dimension, level, kind) of every mark of the text, several to a bracket as in
    （焦虑4级之一，抑郁2级）; a mark without a number has level 0, one without 之一 is 定性."""
    inside = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[(（]([\d焦虑抑郁症定性题级之一、，, ]*?)[)）]"), F.lit(1))
    marks = F.flatten(F.transform(inside, lambda x: F.split(x, "[ ，,、]")))
    named = F.filter(marks, lambda m: F.rlike(m, F.lit("抑郁|焦虑")))
    return F.transform(
        named,
        lambda m: F.struct(
            F.when(F.contains(m, F.lit("抑郁")), "抑郁").otherwise("焦虑").alias("dimension"),
            F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(m, r"(\d+)", 1), F.lit("")), F.lit("999999")).cast("int"), F.lit(0)).alias("level"),
            F.when(F.contains(m, F.lit("之一")), "之一").otherwise("定性").alias("kind"),
        ),
    )


def options(line: Column) -> Column:
    """Answer options of a line, those before an empty pair of brackets."""
    return F.transform(F.regexp_extract_all(line, F.lit(r"([^()（）\s]+)\s*[(（]\s*[)）]"), F.lit(1)), lambda x: F.trim(x))


#: Fixed value: what a line on an entry's meaning begins with.
MEANING = r"^(方论(?:选录)?|方解|方义|方剂解|方药解)[:：]\s*(.+)$"


def first_meaning(text: Column, limit: int = 1000) -> Column:
    """What follows the prefix in the first line on the entry's meaning, '' without one;
    cut to ``limit`` with an ellipsis."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: F.rlike(x, F.lit(MEANING)))
    return truncated(F.trim(F.coalesce(F.regexp_extract(F.get(lines, F.lit(0)), MEANING, 2), F.lit(""))), limit)
