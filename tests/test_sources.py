"""Round trips through sources and sinks."""

from pyspark.sql import functions as F

from scholia.operators import coreset
from scholia.operators import entries as entries_module
from scholia.sources import pages as S


def _pages(spark, n=5):
    rows = [(i, 1, i + 10, "one_column", [("body", [0.0, 0.0], [(f"line {i}", 0.9, [[0.0, 1.0]])])]) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, S.PAGE)


def test_pack_and_unpack(spark, tmp_path):
    pages = _pages(spark)
    S.pack(pages, str(tmp_path / "packed"), 2)
    back = S.read_pages(spark, str(tmp_path / "packed"))
    assert back.exceptAll(pages).count() == 0 and pages.exceptAll(back).count() == 0
    assert S.check_pages(back).first().complete
    assert not S.check_pages(back.filter("pdf_page <> 3")).first().complete
    assert [r.pdf_page for r in S.pending(pages, pages.filter("pdf_page < 5")).collect()] == [5]


def test_reference_table_and_lines(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"id": "1", "old": "a"}, {"id": "2"}]')
    assert S.read_table(spark, str(tmp_path / "t.json"), "id string, old string").count() == 2
    df = spark.createDataFrame([(1, "甲"), (2, None)], "id int, name string")
    S.write_lines(df, str(tmp_path / "lines"))
    assert S.read_lines(spark, str(tmp_path / "lines"), "id int, name string").exceptAll(df).count() == 0


ENTRY = "volume int, id string, name string, fields map<string,string>, record_status string, confidence double, flags array<string>, book_pages array<int>"


def entries(spark):
    rows = [(1, "1", "甲", {"功用": "b", "主治": "a", "方源": "c"}, None, 0.9, [], [3, 4]), (1, "2", "乙", {}, "source_page_missing", 0.5, ["low"], []), (2, "3", "丙", {"正文": "x"}, "complete", 0.9, ["name_differs_from_toc"], [9])]
    return spark.createDataFrame(rows, ENTRY)


def test_text_outputs_and_manifest(spark, tmp_path):
    df = entries(spark)
    text = df.withColumn("text", S.entry_text(*(F.col(c) for c in ("id", "name", "fields", "record_status", "book_pages"))))
    assert [r.text for r in text.orderBy("id").collect()] == ["1 甲\n【方源】c\n【功用】b\n【主治】a\n【页码】3,4", "2 乙\n" + S.NOTICES["source_page_missing"] + "\n【页码】", "3 丙\n【正文】x\n【页码】9"]
    S.write_text(text, str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).count() == 11
    lines = spark.createDataFrame([(0.9,), (0.6,), (0.5,)], "confidence double")
    manifest = {r.output: r.n_rows for r in S.write_outputs(df.drop("fields"), lines, spark.createDataFrame([("1", "甲")], "id string, name string"), str(tmp_path / "out")).collect()}
    assert manifest == {"entries": 3, "toc": 1, "needs_review": 2, "low_confidence": 2, "quality": 1}


def test_pages_and_sections(spark):
    lines = spark.createDataFrame([(7, 0, 1, "b"), (7, 0, 0, "a"), (2, 0, 0, "front")], "pdf_page int, region_index int, line_index int, text string").withColumn("volume", F.lit(1))
    assert [r.text for r in S.page_text(lines, ["volume"], 5).orderBy("pdf_page").collect()] == ["===== PDF_PAGE 0002 =====\nfront", "===== PDF_PAGE 0007 / BOOK_PAGE 3 =====\na\nb"]
    sections = spark.createDataFrame([("measures", 1, 3), ("books", 8, 9)], "section string, first int, last int")
    assert [(r.text, r.section) for r in S.section_lines(lines, sections).collect()] == [("front", "measures")]


def test_volumes_merge_with_exclusions_and_disputes(spark, tmp_path):
    df = entries(spark)
    out = S.merge_corpus([df.filter("volume = 1"), df.filter("volume = 2").drop("confidence")], str(tmp_path / "merged"))
    assert out["corpus"].count() == 3 and [r.id for r in out["exclusions"].collect()] == ["2"] and [r.id for r in out["unresolved"].collect()] == ["3"]
    assert sorted((r.volume, r.entries, r.excluded, r.flagged) for r in out["summary"].collect()) == [(1, 2, 1, 1), (2, 1, 0, 1)]


def test_export_and_merge(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "id int, name string"), spark.createDataFrame([(2,)], "id int")
    merged = S.merge_volumes([a, b])
    assert merged.count() == 2 and merged.filter("name is null").count() == 1
    S.export_visits(a, str(tmp_path / "csv"), {"name": "姓名"})
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["姓名"]


def test_symptom_index_and_event_streams(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text(
        '{"term": "头痛", "category": {"major": "一", "minor": "（一）"}, "entry_ids": ["1", "2", "1"], "source": {"volume": 11, "pdf_pages": [3], "book_pages": [1]}}\n'
        '{"term": "头痛", "category": {"major": "二", "minor": "（一）"}, "entry_ids": []}\n'
    )
    terms, links = S.read_symptoms(spark, str(tmp_path / "s.jsonl"))
    assert terms.count() == 2 and terms.select("term_id").distinct().count() == 2
    assert sorted(r.id for r in links.collect()) == ["1", "2"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"recording": "r", "at": 1, "index": 0, "duration_ms": 10000, "checksum": "c", "ts": "2024-01-01T00:00:00Z"}\n')
    out = S.stream(spark, str(tmp_path / "in"), S.CHUNKS)
    run = out.writeStream.format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [(r.recording, r["index"]) for r in spark.table("chunks").collect()] == [("r", 0)]


def test_status_of_index_and_core(spark):
    index = entries_module.index_metadata(spark.createDataFrame([("1", True), ("2", False)], "id string, ok boolean"), "1", F.lit("2024-01-01"), F.col("ok"))
    row = index.first()
    assert (row.total, row.indexed, row.excluded, row.schema_version) == (2, 1, 1, "1")
    chosen = spark.createDataFrame([(str(i), str(i), ["a"]) for i in range(3)], "id string, name string, prototypes array<string>")
    core = entries_module.core_ready(chosen, ["a"], row.digest, row.digest, least=3)
    assert coreset.status(index, core).first().ready and not entries_module.core_ready(chosen, ["b"], "x", "y", least=3).first().ready
