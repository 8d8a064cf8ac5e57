"""Encoding, decoding and token files against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scholia.llm import bpe, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [*" \n\t\x0b\x1c\x85\xa0　ab'sE1.<é漢", "<|endoftext|>", "  ", "   ", "'re", "THE", "ing"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _texts():
    rng = random.Random(7)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 16))) for _ in range(600)]
    return [*made, "", "a" * 5000, "ab" * 400, " " * 300 + "x", "=-" * 200, "word " * 3000, "thonreen " * 3]


def test_encoder_equals_library(library):
    coder = bpe.encoder(PATH)
    for text, got in zip(_texts(), coder.encode(_texts())):
        assert np.frombuffer(got, "<i4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_exact_merging_agrees_with_batch_merging():
    model = bpe.model(PATH)
    words = [" thonreen", "reerthion", "ouauxment", "aaaaaaaaa", " !!!???"]
    flat = np.frombuffer("".join(words).encode(), np.uint8)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    ids, of = model.merged(model.byte_ids[flat], owner)
    for i, word in enumerate(words):
        assert ids[of == i].tolist() == model.exact(word.encode())


def test_round_trip_and_edge_rows(spark, library):
    rows = [(i, t, i) for i, t in enumerate(_texts())] + [(None, None, 1), (3, "same", 2), (3, "same", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded long")
    got = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.decoded == (r.text or "")
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
    assert bpe.encode(df.limit(0), PATH).count() == 0 and bpe.round_trip(df.limit(0), PATH).count() == 0
    key = lambda r: (str(r.doc_id), str(r.text), r.ids, r.decoded)
    assert sorted(map(key, bpe.round_trip(df, PATH).collect())) == sorted(map(key, got))


@pytest.mark.parametrize("ids", [[-1], [10**6], [1, None]])
def test_foreign_ids_are_an_error(spark, ids):
    df = spark.createDataFrame([(1, ids)], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(df, PATH).collect()


def test_files_hold_the_stream(spark, library):
    texts = _texts()
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    files = token_files.write(df, PATH, length=64, partitions=3)
    got = sorted(token_files.read_documents(files).collect(), key=lambda r: r.start)
    start = 0
    for r, (doc_id, text) in zip(got, [(None, None), *rows[:-1]], strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    reader = token_files.open_sequences(files.orderBy("part").first().path)
    first = reader.get_batch(0)
    assert len(first.column("ids")[0]) == 64 and first.column("mask")[0].as_py() == [True] * 64


def test_empty_table_gives_no_files(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    files = token_files.write(df, PATH)
    assert files.count() == 0 and token_files.read_documents(files).count() == 0
