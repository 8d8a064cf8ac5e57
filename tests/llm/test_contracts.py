"""Every registered query of the subpackage against its contract, over whole small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_operators import brute_kept, brute_print, brute_quality
from tokenizers import Tokenizer

from scholia.llm import queries

SF = "/root/testdata/sf0.001"
sha = lambda x: hashlib.sha256(x).hexdigest()


@pytest.fixture(scope="module")
def docs():
    return {i: t or "" for i, t in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()}


@pytest.fixture(scope="module")
def ids(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in docs.items()}


def rows(spark, name, columns):
    """The query's rows by id; its first columns are those of the contract, in any order."""
    df = queries.queries()[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {c: kinds[c] for c in columns} == columns
    got = df.collect()
    assert len({r.doc_id for r in got}) == len(got)
    return {r.doc_id: r for r in got}


def test_op1(spark, docs, ids):
    got = rows(spark, "op1_bpe_encode_decode", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})
    want = {i: (len(x), sha(",".join(map(str, x)).encode()), sha(docs[i].encode())) for i, x in ids.items()}
    assert {i: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for i, r in got.items()} == want


def test_op2(spark, docs):
    got = rows(spark, "op2_toxicity", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_op3(spark, docs):
    got = rows(spark, "op3_simhash_components", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})
    prints = {i: brute_print(t, 3) % (1 << 64) for i, t in docs.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    root = {i: i for i in docs}
    for i, p in prints.items():
        for j, q in prints.items():
            if j < i and (p ^ q).bit_count() <= 3 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    assert {i: r.component_id for i, r in got.items()} == root


def test_op4(spark, docs):
    got = rows(spark, "op4_sketch_fingerprints", {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"})
    down = sorted(docs, reverse=True)
    seen = {}
    for i, after in zip(down, [*down[1:], down[0]]):
        text, half = docs[i], len(docs[i]) // 2
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == sha((text[: len(text) - half] + docs[after][:half]).encode())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert seen.setdefault(text, got[i].fingerprint) == got[i].fingerprint
        if docs[after] == text:
            assert got[i].near_next == 1


def test_op5(spark, ids):
    got = rows(spark, "op5_token_files", {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"})
    start = 0
    for i in sorted(ids):
        whole = np.array([*ids[i], 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(whole), zlib.crc32(whole.tobytes()))
        start += len(whole)


def test_op6(spark, docs):
    got = rows(spark, "op6_line_quality", {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"})
    for i, r in got.items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(docs[i])
        assert r.kept == brute_kept(docs[i])
    assert set(got) == set(docs)


@pytest.mark.parametrize("name", ["op7_edit_aware_counts", "op8_soft_mixing"])
def test_op7_and_op8_keep_every_row(spark, docs, name):
    assert set(rows(spark, name, {"doc_id": "bigint"})) == set(docs)


def test_op9(spark, docs):
    got = rows(spark, "op9_repeated_bytes", {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"})
    raw = {i: t.encode() for i, t in docs.items()}
    windows = Counter(hashlib.blake2b(x[a : a + 200], digest_size=12).digest() for x in raw.values() for a in range(len(x) - 199))
    for i, x in raw.items():
        cut = np.zeros(len(x) + 1, bool)
        for a in range(len(x) - 199):
            if windows[hashlib.blake2b(x[a : a + 200], digest_size=12).digest()] > 1:
                cut[a : a + 200] = True
        spans = int((cut[1:] & ~cut[:-1]).sum() + cut[0])
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(x), int(cut.sum()), spans)
        assert got[i].kept_sha256 == sha(bytes(b for b, c in zip(x, cut) if not c))


def test_op10(spark, docs):
    got = rows(spark, "op10_log_frequency_bloom", {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"})
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) and r.score < 0
