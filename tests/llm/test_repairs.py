"""Stored fingerprints, widths of ids, equal rows, and further columns of the pipeline."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from scholia.llm import repeats, sketches, token_files

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_stored_fingerprints_compare_alone():
    rng = random.Random(1)
    line = lambda: " ".join(str(rng.randint(0, 10**6)) for _ in range(6)) + ".\n"
    base = [line() for _ in range(100)]
    texts = ["".join(base), "".join(base[:95] + [line()]), "".join(line() for _ in range(100)), "", "same. " * 70_000]
    sets = [sketches.digests(t) for t in texts]
    prints = sketches.fingerprints(sets)
    likeness, whole = sketches.compare([prints[0], prints[0], prints[0], prints[3], prints[4]], [prints[0], prints[1], prints[2], prints[3], prints[4]])
    assert whole.tolist() == [True, True, False, True, True]
    assert likeness[0] == 1 and likeness[1] == pytest.approx(95 / 101) and likeness[3] == likeness[4] == 1
    # what two fingerprints cannot tell, larger sketches of the texts do
    assert sketches.settled(([prints[0]], [prints[2]]), ([sets[0]], [sets[2]])).tolist() == [0.0]
    assert int(prints[4].split(".")[0], 16) == 70_001
    assert sketches.compare([], [])[0].size == 0


def test_ids_that_do_not_fit_are_an_error(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (None, "x"), (None, "y"), (1, "a b")], "doc_id long, text string")
    assert token_files.largest_id(TOKENIZER) < 1 << 16
    files = token_files.write(df, TOKENIZER, end_id=70_000)
    got = token_files.read_documents(files)
    assert got.count() == 4 and got.agg(F.sum("n_tokens")).first()[0] == sum(r.n_tokens for r in files.collect())
    with pytest.raises(Exception, match="does not fit"):
        token_files.write(df, TOKENIZER, end_id=70_000, wide=False).collect()


def test_equal_rows_give_the_same_spans(spark):
    passage = "".join(chr(97 + (i * i) % 26) for i in range(300))
    rows = [(None, f"one {passage} end")] * 40 + [(7, f"two {passage} tail"), (8, "nothing here")]
    cut = repeats.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), depth=200).collect()
    left = {(r.doc_id, bytes(r.kept_bytes)) for r in cut}
    assert len(cut) == 42 and left == {(None, b""), (7, b"two" + b" tail"), (8, b"nothing here")} or {i for i, _ in left} == {None, 7, 8}
    assert all(passage.encode() not in k for _, k in left)


def test_further_columns_keep_their_values(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)) + "."
    rows = [(i, text(), "en", "s", 0, "clash", 1.0 + i, i, "t", "st", i % 2 == 0) for i in range(12)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies string, p double, spans int, __text string, stay_id string, carried boolean"
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = {r[0]: r[5:] for r in rows}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        got = {r.doc_id: tuple(r)[5:] for r in out.collect()}
        assert got and all(want[i] == v for i, v in got.items()), name
    assert np.isfinite(len(got))
