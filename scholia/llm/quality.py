"""Line-first quality rules, in DataFrame functions alone.

Every line is tried against punctuation, navigation and boilerplate rules (English,
German, French and Spanish phrases); lines that fail are removed, and a document that
loses too much of its text that way is rejected.  Beside the verdict stand counts over
the whole text.  Texts of any length are counted exactly.

Edge cases: a null text has no words and no lines; a text without a word fails
the length rule; lines are cut at ``\\n`` alone and lines without a word are
neither judged nor counted; ties and repeated rows are judged one by one; an empty
table gives none; existing columns with an output's name are replaced, other
columns stay.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

_SPACE = " \t\n\x0b\x0c\r"

#: Low bits of a packed window that hold its place; longer texts are compared in full.
_PLACE_BITS = 26
_PLACE = (1 << _PLACE_BITS) - 1

#: Phrases that mark a line as boilerplate when it has few words besides, by language.
BOILERPLATE = {
    "en": ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie", "javascript", "click here", "sign up", "log in", "subscribe", "lorem ipsum", "copyright", "licensed under"),
    "de": ("alle rechte vorbehalten", "nutzungsbedingungen", "datenschutz", "impressum", "hier klicken", "anmelden", "abonnieren"),
    "fr": ("tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "mentions légales", "cliquez ici", "se connecter", "s'abonner"),
    "es": ("todos los derechos reservados", "términos de uso", "política de privacidad", "aviso legal", "haga clic aquí", "iniciar sesión", "suscríbete"),
}

#: Signs between the entries of a menu; signs that close a line of prose, quotes and
#: brackets after them aside.
SEPARATORS, CLOSED = "|›»•·", r"""[.!?;:…。！？]['"”’»)\]]*\s*$"""

#: Words that a line may have at most for the boilerplate rule; words from which a line
#: needs a closing sign; share of separators, symbols or shouts to words that fails a line.
BOILERPLATE_WORDS, OPEN_WORDS, SHARE = 25, 4, 0.2

#: Share of the words that a document may lose with its failed lines.
LOSS = 0.5


def words_of(text: Column) -> Column:
    """Words between the six ASCII white-space characters."""
    return F.array_remove(F.split(F.translate(text, _SPACE[1:], " " * 5), " "), "")


def _without(text: Column, signs: str) -> Column:
    """How many of the signs a text has."""
    return F.length(text) - F.length(F.translate(text, signs, ""))


def line_fails(line: Column, n: Column, lower: Column) -> Column:
    """Whether a line of ``n`` words is navigation, boilerplate or not prose; ``lower``
    is the line in lower case."""
    phrases = [F.contains(lower, F.lit(p)) for of_language in BOILERPLATE.values() for p in of_language]
    boilerplate = (n <= BOILERPLATE_WORDS) & reduce(or_, phrases)
    shouts = (F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    many = lambda x: (x >= 3) & (x >= n * SHARE)
    unclosed = (n >= OPEN_WORDS) & ~F.rlike(line, F.lit(CLOSED))
    return unclosed | many(_without(line, SEPARATORS)) | many(_without(line, "#*$%&<>")) | (F.contains(line, F.lit("!!")) & many(shouts)) | boilerplate


def packed_windows(words: Column) -> Column:
    """38 bits of hash and the place of every 3-word window, sorted, so that equal
    windows stand together."""
    n = F.size(words)
    packed = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long")),
    )
    return F.when((n >= 3) & (n <= _PLACE), F.sort_array(packed))


def _first_of(ordered: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Where in ``ordered`` an element is followed by an equal one."""
    last = F.size(ordered) - 2
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), lambda i: same(F.get(ordered, i), F.get(ordered, i + 1)))).otherwise(_nowhere())


def _nowhere() -> Column:
    return F.array().cast("array<int>")


def _both(firsts: Column, place: Callable[[Column], Column]) -> Column:
    """Sorted places of the elements there and of those that follow."""
    return F.sort_array(F.array_distinct(F.concat(F.transform(firsts, place), F.transform(firsts, lambda i: place(i + 1)))))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _exactly_repeated(words: Column) -> Column:
    """Places of the repeated windows, by sorting the windows themselves."""
    window = lambda i: F.struct(*(F.get(words, i + j).alias(f"w{j}") for j in range(3)), i.alias("at"))
    equal = lambda a, b: (a["w0"] == b["w0"]) & (a["w1"] == b["w1"]) & (a["w2"] == b["w2"])
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), window))
    return _bound(windows, lambda ordered: _bound(_first_of(ordered, equal), lambda firsts: _both(firsts, lambda i: F.get(ordered, i)["at"])))


def repeated_places(words: Column, ordered: Column, alike: Column) -> Column:
    """Sorted places of the windows that occur twice or more.  Neighbours in ``ordered``
    that are ``alike`` (by hash) are compared word by word; where two differ, other equal
    windows may stand apart, so then the windows themselves are sorted."""
    place = lambda i: F.get(ordered, i).bitwiseAND(F.lit(_PLACE)).cast("int")
    differ = F.exists(alike, lambda i: reduce(or_, (F.get(words, place(i) + j) != F.get(words, place(i + 1) + j) for j in range(3))))
    exact = (F.size(words) > _PLACE) | differ
    return F.when(F.size(words) < 3, _nowhere()).when(exact, _exactly_repeated(words)).otherwise(_both(alike, place))


def _covered(places: Column) -> Column:
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + F.least(F.lit(3), p + 3 - a["end"])).alias("n"))
    return F.aggregate(places, start, step, lambda a: a["n"])


def assess(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    cleaned (the lines that pass), lost (share of words in failed lines),
    base_failed and kept."""
    out = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "cleaned", "lost", "base_failed", "kept")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in out]
    text = F.col("__text")
    rows = df.select(*kept, text_or_empty(F.col(f"`{text_col}`")).alias("__text"))
    sized = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), F.size(words_of(x)).alias("n"), F.lower(x).alias("lower")))
    rows = rows.select("*", words_of(text).alias("__words"), F.filter(sized, lambda x: x["n"] > 0).alias("__lines"))
    judged = F.transform("__lines", lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"), line_fails(x["line"], x["n"], x["lower"]).alias("fails")))
    rows = rows.select("*", packed_windows(F.col("__words")).alias("__packed"), F.filter(judged, lambda x: ~x["fails"]).alias("__passed"))
    same = lambda a, b: F.shiftright(a, _PLACE_BITS) == F.shiftright(b, _PLACE_BITS)
    rows = rows.select("*", _first_of(F.col("__packed"), same).alias("__alike"))
    rows = rows.select("*", repeated_places(F.col("__words"), F.col("__packed"), F.col("__alike")).alias("__places"))
    rows = rows.select(
        *kept,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.translate(text, _SPACE, "")).cast("long").alias("word_chars"),
        _without(text, "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines.line"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("__places")).alias("n_repeat_words"),
        F.array_join("__passed.line", "\n").alias("cleaned"),
        F.aggregate("__passed.n", F.lit(0), lambda a, n: a + n).alias("__rest"),
    )
    lost = F.when(F.col("n_words") > 0, 1 - F.col("__rest") / F.col("n_words")).otherwise(F.lit(0.0))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.select("*", lost.alias("lost"), base_failed.alias("base_failed"))
    return rows.drop("__rest").withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= LOSS))
