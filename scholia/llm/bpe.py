"""Byte-level BPE encoding and decoding by speculation and verification.

A pre-token ("word") is first cut greedily into the longest vocabulary entries.
That guess is the BPE result exactly when every adjacent pair of its tokens is
stable, which is tested for all pairs of a batch at once in numpy by undoing
merges along the seam.  Words with an unstable pair, and only those, are merged
exactly.

Edge cases: a null text encodes as an empty one (no ids); a null id list decodes
to an empty text; ids outside the vocabulary and null ones raise; other columns pass through
untouched, whatever their names, except that an existing column with the output
name is replaced; repeated rows are encoded independently; an empty table gives
an empty table.  Words of any length take O(n log n) merging steps.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK_BYTES, in_chunks, text_or_empty

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies of this family.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words of more bytes than this are merged with a heap, shorter ones in a batch.
LONG_WORD = 64

#: Multiplier and word size of the rolling hash over vocabulary prefixes.
_STEP, _MASK = 0x9DDFEA08EB382D69, (1 << 64) - 1

#: Cached words in a Python worker; beyond it those met only once are forgotten.
CACHE_WORDS = 300_000

#: ASCII signs, none of which belongs to the letters before it.
_SIGNS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")

#: White space, a blank, then white space or the end: there a blank need not start a word.
_RUN_OF_SPACE = re.compile(r"\s (?:\s|\Z)")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable
    Latin-1 stands for itself, all other bytes take the code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class HashTable:
    """Maps 64-bit keys to non-negative values, looked up by the array."""

    def __init__(self, items: list[tuple[int, int]]):
        bits = max(4, (4 * len(items)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.int64)
        self.values = np.full(1 << bits, -1, np.int64)
        keys = np.array([k for k, _ in items], np.int64)
        for slot, (key, value) in zip(self._slot(keys).tolist(), items):
            while self.values[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.values[slot] = key, value

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        x = keys.view(np.uint64)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        slot = self._slot(keys)
        out = self.values[slot]
        live = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(live):
            slot[live] = (slot[live] + 1) & self.mask
            at = slot[live]
            out[live] = self.values[at]
            live = live[(out[live] >= 0) & (self.keys[at] != keys[live])]
        return out


class BpeModel:
    """A byte-level vocabulary with its merges, ready for batches of words."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            if all(c in back for c in token):
                self.bytes_of[i] = bytes(back[c] for c in token)
            else:
                self.bytes_of[i] = token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = [vocab[c] for c in alphabet]
        self.rank = np.zeros(size, np.int64)  # 0: a single byte
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs, 1):
            a, b, whole = vocab[a], vocab[b], vocab[a + b]
            self.merge[a, b] = rank, whole
            if not self.rank[whole]:
                self.rank[whole], self.left[whole], self.right[whole] = rank, a, b
        self.pairs = HashTable([(a << 32 | b, rank << 32 | whole) for (a, b), (rank, whole) in self.merge.items()])
        whole = np.flatnonzero(self.rank)
        stable = np.zeros(size, bool)
        stable[self.byte_id] = True
        own = dict(zip(whole.tolist(), self.compatible(self.left[whole], self.right[whole], self.rank[whole]).tolist()))
        for t in whole[np.argsort(self.rank[whole])].tolist():
            stable[t] = own[t] and stable[self.left[t]] and stable[self.right[t]]
        #: Only entries that BPE itself reaches may be proposed.  prefixes: the
        #: hash of every prefix of an entry gives the entry that ends there, or 0.
        ends: dict[int, int] = {}
        for t in np.flatnonzero(stable).tolist():
            h = 0
            for byte in self.bytes_of[t]:
                h = (h * _STEP + byte + 1) & _MASK
                ends.setdefault(h, 0)
            ends[h] = t + 1
        self.prefixes = HashTable([(h - (1 << 64) if h >> 63 else h, t) for h, t in ends.items()])
        self.byte_ids = np.array(self.byte_id, np.int64)
        self.pattern = regex.compile(PRETOKEN)
        self.splitter = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each i whether BPE leaves a seam between tokens a[i] and b[i].

        The merges that made the two tokens are undone, the latest first.  A merge
        across the seam that ranks before the one just undone (or, to the left of
        it, as early) would have come first, so the seam would not exist.
        """
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max) if limit is None else limit.copy()
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            found = self.pairs.get(x << 32 | y)
            across = (found >= 0) & (found >> 32 < limit[live])
            good[live[across]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_left = rx > ry
            limit[live] = np.where(undo_left, rx, ry + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            live = live[~across & (np.maximum(rx, ry) > 0)]
        return good

    def propose(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words at once: tokens and their words."""
        stop = np.repeat(ends, ends - starts)
        best, reach = self.byte_ids[flat], np.ones(len(flat), np.int64)
        live, h, n = np.arange(len(flat)), np.zeros(len(flat), np.uint64), 0
        while len(live):
            h = h * np.uint64(_STEP) + flat[live + n].astype(np.uint64) + np.uint64(1)
            n += 1
            found = self.prefixes.get(h.view(np.int64))
            token = live[found > 0]
            best[token], reach[token] = found[found > 0] - 1, n
            more = (found >= 0) & (live + n < stop[live])
            live, h = live[more], h[more]
        at, owner = starts.copy(), np.arange(len(starts))
        tokens, owners, places = [], [], []
        at, owner = at[starts < ends], owner[starts < ends]
        while len(at):
            tokens.append(best[at])
            owners.append(owner)
            places.append(at)
            at = at + reach[at]
            more = at < ends[owner]
            at, owner = at[more], owner[more]
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(np.concatenate(places), kind="stable")
        return np.concatenate(tokens)[order], np.concatenate(owners)[order]

    def merged(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many short words: in each round the lowest-ranked pair
        of each word, the leftmost of equals, becomes one token."""
        done_ids, done_owner = [], []
        while len(ids):
            found = np.full(len(ids), -1, np.int64)
            same = owner[1:] == owner[:-1]
            found[:-1][same] = self.pairs.get((ids[:-1] << 32 | ids[1:])[same])
            start = np.flatnonzero(np.concatenate([[True], ~same]))
            size = np.diff(np.append(start, len(ids)))
            key = np.where(found >= 0, found >> 32, np.iinfo(np.int64).max)
            least = np.repeat(np.minimum.reduceat(key, start), size)
            going = least < np.iinfo(np.int64).max
            hit = np.flatnonzero(going & (key == least))
            first = hit[np.concatenate([[True], owner[hit][1:] != owner[hit][:-1]])] if len(hit) else hit
            ids[first] = found[first] & 0xFFFFFFFF
            keep = np.ones(len(ids), bool)
            keep[first + 1] = False
            done_ids.append(ids[~going])
            done_owner.append(owner[~going])
            keep &= going
            ids, owner = ids[keep], owner[keep]
        if not done_ids:
            return ids, owner
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], owner[order]

    def exact(self, word: bytes) -> list[int]:
        """Merges in rank order, leftmost first, with a heap over the linked tokens."""
        ids = [self.byte_id[x] for x in word]
        n, merge = len(ids), self.merge
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, whole = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = whole, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merge.get((whole, ids[k])):
                    heapq.heappush(heap, (m[0], i, whole, ids[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merge.get((ids[h], whole))):
                heapq.heappush(heap, (m[0], h, ids[h], whole, m[1]))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers."""
        raw = [w.encode() for w in words]
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        starts = ends - np.fromiter(map(len, raw), np.int64, len(raw))
        tokens, owner = self.propose(flat, starts, ends)
        seam = np.flatnonzero(owner[1:] == owner[:-1])
        wrong = np.zeros(len(raw), bool)
        wrong[owner[seam[~self.compatible(tokens[seam], tokens[seam + 1])]]] = True
        long = wrong & (ends - starts > LONG_WORD)
        short = wrong & ~long
        again = np.repeat(short, ends - starts)
        exact, exact_owner = self.merged(self.byte_ids[flat[again]], np.repeat(np.arange(len(raw)), ends - starts)[again])
        kept = ~wrong[owner]
        out = [b""] * len(raw)
        for ids, of in ((tokens[kept], owner[kept]), (exact, exact_owner)):
            if len(ids):
                data = ids.astype("<i4").tobytes()
                cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])).tolist()
                for w, i, j in zip(of[cut[:-1]].tolist(), cut, cut[1:]):
                    out[w] = data[4 * i : 4 * j]
        for w in np.flatnonzero(long).tolist():
            out[w] = np.array(self.exact(raw[w]), "<i4").tobytes()
        return out

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text, special tokens as pieces of their own."""
        if self.splitter is None:
            return self.pattern.findall(text)
        out: list[str] = []
        for part in self.splitter.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += self.pattern.findall(part)
        return out


@lru_cache(maxsize=4)
def model(path: str) -> BpeModel:
    return BpeModel(path)


class CachedEncoder:
    """Encodes texts through a bounded cache of blank-separated words.

    A blank starts a new pre-token unless it stands inside a run of white space,
    so a text splits at its blanks into parts that encode independently.  Texts
    with such runs, or with special tokens, are handled whole.

    ``encode_parts(list of parts) -> list of id bytes`` encodes unseen parts and
    ``encode_whole(text) -> id bytes`` a whole text.
    """

    def __init__(self, encode_parts: Callable, encode_whole: Callable, special: tuple[str, ...], size: int = CACHE_WORDS):
        self.encode_parts, self.encode_whole, self.special, self.size = encode_parts, encode_whole, special, size
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.again: set[str] = set()  # of later, those met again

    def encode(self, texts: list[str]) -> list[bytes]:
        split: list[list[str] | None] = []
        for text in texts:
            whole = _RUN_OF_SPACE.search(text) or any(s in text for s in self.special)
            split.append(None if whole else text.split(" "))
        if len(self.first) + len(self.later) > self.size:
            found = self.again if len(self.again) <= self.size // 2 else ()
            self.first, self.later, self.again = {}, {w: self.later[w] for w in found}, set()
        first, later = self.first, self.later
        new_first = list({p[0] for p in split if p} - first.keys())
        seen = set().union(*(p[1:] for p in split if p))
        new_later = list(seen - later.keys())
        self.again |= seen & later.keys()
        parts = [*new_first, *(" " + p for p in new_later)]
        if parts:
            coded = self.encode_parts(parts)
            first.update(zip(new_first, coded))
            later.update(zip(new_later, coded[len(new_first) :]))
        return [
            self.encode_whole(text) if p is None else first[p[0]] + b"".join(map(later.__getitem__, p[1:]))
            for text, p in zip(texts, split)
        ]


class _Words:
    """Parts to ids by the model above, with a second cache of pre-tokens."""

    def __init__(self, path: str):
        self.model = model(path)
        self.cache: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        if new := [w for w in words if w not in self.cache]:
            self.cache.update(zip(new, self.model.encode_words(new)))

    def parts(self, parts: list[str]) -> list[bytes]:
        find = self.model.pattern.findall
        # a blank and letters are one pre-token, a sign that ends them another
        cut = [[p] if p[1:].isalpha() and p[0] == " " else [p[:-1], p[-1]] if p[1:-1].isalpha() and p[0] == " " and p[-1] in _SIGNS else find(p) for p in parts]
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        self.learn(set().union(*cut))
        cache = self.cache
        return [cache[c[0]] if len(c) == 1 else b"".join(map(cache.__getitem__, c)) for c in cut]

    def whole(self, text: str) -> bytes:
        special = self.model.special
        pieces = self.model.pieces(text)
        self.learn({p for p in pieces if p not in special})
        return b"".join(special[p].to_bytes(4, "little") if p in special else self.cache[p] for p in pieces)


@lru_cache(maxsize=4)
def encoder(path: str) -> CachedEncoder:
    words = _Words(path)
    return CachedEncoder(words.parts, words.whole, tuple(words.model.special))


@lru_cache(maxsize=4)
def library_encoder(path: str) -> CachedEncoder:
    """The same over the tokenizers library, for unseen words and awkward texts."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as file:
        special = tuple(t["content"] for t in json.load(file)["added_tokens"])

    def parts(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<i4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    return CachedEncoder(parts, lambda text: parts([text])[0], special)


def id_lists(coded: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(coded) + 1, np.int64)
    np.cumsum([len(c) // 4 for c in coded], out=offsets[1:])
    values = np.frombuffer(b"".join(coded), "<i4")
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", library: bool = False) -> DataFrame:
    """``df`` with the token ids of ``text_col`` in ``ids_col`` (array of int)."""
    kept = [c for c in df.columns if c != ids_col]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(ids_col, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = (library_encoder if library else encoder)(tokenizer_path)
        for batch in in_chunks(batches, "__text"):
            coded = coder.encode(batch.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), id_lists(coded)], [*kept, ids_col])

    return df.select(*(F.col(f"`{c}`") for c in kept), text_or_empty(F.col(f"`{text_col}`")).alias("__text")).mapInArrow(run, schema)


def _decoded(bytes_of: list[bytes], ids: list[int]) -> str:
    return b"".join(map(bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _id_bounds(ids: pa.Array, size: int) -> None:
    """Ids outside the vocabulary, null ones among them, are an error."""
    values = ids.flatten()
    if values.null_count or len(values) and not 0 <= values.to_numpy().min() <= values.to_numpy().max() < size:
        raise ValueError("an id is null or outside the vocabulary")


def round_trip(df: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``df`` with the ids of ``text_col`` and the text that those ids decode to, by the
    same rules as encode() and decode(), in one pass of one worker."""
    kept = [c for c in df.columns if c not in (ids_col, decoded_col)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(decoded_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, bytes_of = encoder(tokenizer_path), model(tokenizer_path).bytes_of
        for batch in in_chunks(batches, "__text", CHUNK_BYTES // 2):
            coded = coder.encode(batch.column("__text").to_pylist())
            decoded = pa.array([_decoded(bytes_of, np.frombuffer(c, "<i4").tolist()) for c in coded], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), id_lists(coded), decoded], [*kept, ids_col, decoded_col])

    return df.select(*(F.col(f"`{c}`") for c in kept), text_or_empty(F.col(f"`{text_col}`")).alias("__text")).mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of the token ids in ``ids_col``, special tokens kept."""
    kept = [c for c in df.columns if c != text_col]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = model(tokenizer_path).bytes_of
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids = batch.column(ids_col)
                _id_bounds(ids, len(bytes_of))
                values = ids.flatten().to_pylist()
                lengths = np.asarray(ids.value_lengths().fill_null(0))
                texts, start = [], 0
                for n in lengths.tolist():
                    texts.append(_decoded(bytes_of, values[start : start + n]))
                    start += n
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, text_col])

    return df.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)
