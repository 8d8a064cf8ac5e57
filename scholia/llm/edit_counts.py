"""Token counts that follow edits without encoding a document again.

A document's text is cut into leaves of about LEAF characters, always before a
blank between two visible characters, where a pre-token always begins.  A segment
tree over the leaves sums characters and tokens.  An edit finds its leaves by
descending the character sums, re-encodes them together with one leaf of context on
either side, puts the new counts in their place and updates the sums above.

Edge cases: null texts are empty, null edits none; an edit's place and length are
clipped to the text, a null insertion inserts nothing; edits apply in array order,
each to the text that the one before it left; texts without a safe blank are one
leaf; repeated rows are counted independently; an empty table gives none; existing
columns with an output's name are replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoder
from .common import in_chunks, text_or_empty

#: Characters of a leaf, about.
LEAF = 256


def leaves_of(text: str, size: int = LEAF) -> list[str]:
    """The text in parts that each begin at its start or before a safe blank."""
    out, start, n = [], 0, len(text)
    while n - start > size:
        at = text.find(" ", start + size)
        while 0 <= at < n - 1 and (text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if not 0 <= at < n - 1:
            break
        out.append(text[start:at])
        start = at
    return [*out, text[start:]]


class CountTree:
    """Sums of characters and tokens over a fixed row of leaves."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.leaves = len(chars)
        self.base = 1 << max(0, (self.leaves - 1).bit_length())
        pad = [0] * (self.base - self.leaves)
        self.chars, self.tokens = [0] * self.base + chars + pad, [0] * self.base + tokens + pad
        for i in range(self.base - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place`` (the last one at the end) and
        the place where it begins."""
        place = min(place, max(0, self.chars[1] - 1))
        i, begin = 1, 0
        while i < self.base:
            i *= 2
            if place - begin >= self.chars[i]:
                begin += self.chars[i]
                i += 1
        return i - self.base, begin

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.base
        self.chars[i], self.tokens[i] = chars, tokens
        while i > 1:
            i //= 2
            self._sum(i)

    def plan(self, text: str, place: int, delete: int, insert: str) -> tuple[str, int, int, list[str]]:
        """The edited text, the leaves low..high that it touches (with one of context on
        either side), and the parts that replace them."""
        place = max(0, min(place, len(text)))
        stop = max(place, min(place + delete, len(text)))
        low, begin = self.find(max(0, place - 1))
        high, end = self.find(stop)
        end += self.chars[high + self.base]
        if low:
            low, begin = self.find(max(0, begin - 1))
        if end < len(text):
            high, end = self.find(end)
            end += self.chars[high + self.base]
        region = text[begin:place] + insert + text[stop:end]
        parts = leaves_of(region)
        room = high - low + 1
        if len(parts) > room:
            parts = [*parts[: room - 1], "".join(parts[room - 1 :])]
        return text[:begin] + region + text[end:], low, high, parts

    def replace(self, low: int, high: int, parts: list[str], counts: list[int]) -> None:
        for i in range(high - low + 1):
            self.set(low + i, len(parts[i]) if i < len(parts) else 0, counts[i] if i < len(parts) else 0)

    def edit(self, text: str, place: int, delete: int, insert: str, count: Callable[[list[str]], list[int]]) -> tuple[str, int]:
        """The edited text, and how many of its characters were encoded again."""
        text, low, high, parts = self.plan(text, place, delete, insert)
        self.replace(low, high, parts, count(parts))
        return text, sum(map(len, parts))


EDITS = T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("delete", T.IntegerType()), T.StructField("insert", T.StringType())]))


def count_edits(df: DataFrame, tokenizer_path: str, text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """``df`` without text and edits, with n_tokens (before), edited_tokens (after all
    edits), edited_chars and encoded_chars (characters encoded again)."""
    out = ("n_tokens", "edited_tokens", "edited_chars", "encoded_chars")
    kept = [c for c in df.columns if c not in (*out, text_col, edits_col)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        count = lambda parts: [len(x) // 4 for x in coder.encode(parts)]
        for batch in in_chunks(batches, "__text"):
            texts = batch.column("__text").to_pylist()
            cut = [leaves_of(t) for t in texts]
            counted = iter(count([p for parts in cut for p in parts]))
            trees = [CountTree([len(p) for p in parts], [next(counted) for _ in parts]) for parts in cut]
            before, again = [t.total for t in trees], [0] * len(trees)
            edits = [[e for e in es or [] if e is not None] for es in batch.column("__edits").to_pylist()]
            # the first edits of all documents are encoded together, then the second, ...
            for turn in range(max(map(len, edits), default=0)):
                touched = [i for i, es in enumerate(edits) if turn < len(es)]
                plans = []
                for i in touched:
                    e = edits[i][turn]
                    plans.append(trees[i].plan(texts[i], e["place"] or 0, e["delete"] or 0, e["insert"] or ""))
                counted = iter(count([p for plan in plans for p in plan[3]]))
                for i, (text, low, high, parts) in zip(touched, plans):
                    trees[i].replace(low, high, parts, [next(counted) for _ in parts])
                    texts[i] = text
                    again[i] += sum(map(len, parts))
            rows = [(b, t.total, len(x), n) for b, t, x, n in zip(before, trees, texts, again)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(c, pa.int64()) for c in zip(*rows))], [*kept, *out])

    source = df.select(*(F.col(f"`{c}`") for c in kept), text_or_empty(F.col(f"`{text_col}`")).alias("__text"), F.col(f"`{edits_col}`").cast(EDITS).alias("__edits"))
    return source.mapInArrow(run, schema)
