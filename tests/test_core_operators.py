"""Operators that SQL cannot state, against small models."""

import random
import re
from difflib import SequenceMatcher

import datetime

from pyspark.sql import functions as F

from scholia.operators import appendix, assembly, digests, doses, fuzzy, joins, quality, questions, records, search, survey, topk


def test_rows_cluster_by_running_mean(spark):
    boxes = [(1, 0.0, 10.0, "b", 0.9), (1, 5.0, 0.0, "c", 0.8), (1, -5.0, 12.0, "a", 0.7), (1, 0.0, 60.0, "d", 0.6)]
    rows = assembly.cluster_rows(spark.createDataFrame(boxes, "page int, x double, y double, text string, confidence double"), ["page"]).orderBy("row").collect()
    assert [(r.text, r.confidence, r.n_boxes) for r in rows] == [("a b c", 0.7, 3), ("d", 0.6, 1)]


def test_ids_are_repaired_in_sequence(spark):
    heads = [(1, 1, "00001", "桂枝汤", "桂枝汤"), (1, 2, "00082", "麻黄汤", "麻黄汤"), (1, 3, "00003", "x", "y"), (1, 4, "00094", "甲", "乙丙")]
    df = spark.createDataFrame(heads, "volume int, place int, raw_id string, name string, toc_name string")
    got = [r.id for r in assembly.repair_sequence(df, ["volume"], ["place"]).orderBy("place").collect()]
    assert got == ["00001", "00002", "00003", "00094"]


def test_pages_flatten_and_lose_headers(spark):
    page = [(7, 1, None, "two_column", [("body", [0.0, 50.0], [("总论 12", 0.9, [[0.0, 51.0]]), ("00012 桂枝汤", 0.8, [[0.0, 51.0]]), ("正文", 0.7, [[0.0, 90.0]])])])]
    schema = "pdf_page int, volume int, book_page int, layout string, regions array<struct<name:string,crop:array<double>,lines:array<struct<text:string,confidence:double,box:array<array<double>>>>>>"
    lines = assembly.lines_of(spark.createDataFrame(page, schema), 1, 9)
    assert lines.count() == 3 and assembly.lines_of(spark.createDataFrame(page, schema), 8).count() == 0
    assert [r.text for r in assembly.drop_running_headers(lines).orderBy("line_index").collect()] == ["00012 桂枝汤", "正文"]


def test_listing_precedence(spark):
    rows = [("1", 0, 1, None, 0.9, "a"), ("1", 0, 2, None, 0.5, "b"), ("1", 1, 1, 12, 0.4, "c"), ("1", 1, 2, None, 0.8, "d"), ("2", 1, 1, None, 0.3, "e")]
    df = spark.createDataFrame(rows, "id string, pass int, place int, page int, confidence double, name string")
    assert {r.id: r.name for r in assembly.best_listing(df).collect()} == {"1": "d", "2": "e"}


def test_corrections_apply_in_order(spark):
    entries = spark.createDataFrame([("1", "aXbX"), ("2", "q")], "id string, text string")
    fixes = spark.createDataFrame([("1", 1, "X", "Y"), ("1", 2, "X", "Z"), ("1", 3, "X", "!")], "id string, seq int, old string, new string")
    got = {r.id: (r.text, r.n_missed) for r in assembly.corrected(entries, fixes).collect()}
    assert got == {"1": ("aYbZ", 1), "2": ("q", 0)}


def plain_candidates(raw, name, canonical):
    digits = re.sub(r"\D", "", raw.translate(str.maketrans("OoIlQBS", "0011085")))
    n = len(digits)
    ids = {digits.zfill(5)} if n <= 5 else set()
    for i in range(6):
        for d in "0123456789":
            ids |= {digits[:i] + d + digits[i:]} if n == 4 and i < 5 else {digits[:i] + d + digits[i + 1 :]} if n == 5 and i < 5 else set()
        ids |= {digits[:i] + digits[i + 1 :]} if n == 6 else set()

    def edits(a, b):
        row = list(range(len(b) + 1))
        for x in range(1, len(a) + 1):
            row, old = [x], row
            for y in range(1, len(b) + 1):
                row.append(min(old[y] + 1, row[-1] + 1, old[y - 1] + (a[x - 1] != b[y - 1])))
        return row[-1]

    far = lambda i: min(edits(digits, i), edits(digits.zfill(5), i) if n < 5 else 99)
    ids |= {i for i, other in canonical.items() if other == name and far(i) <= 3}
    return [(SequenceMatcher(None, name, canonical[i]).ratio(), far(i), i) for i in ids if i in canonical]


def test_doubles_move_to_free_entries_in_turn(spark):
    rng = random.Random(4)
    names = ["甲乙丙丁", "甲乙丙戊", "己庚辛壬", "子丑", "寅卯辰"]
    canonical = {f"{100 + i:05d}": rng.choice(names) for i in range(60)}
    held = sorted(canonical)[:20]
    rows = []
    for seq in range(80):
        i = rng.choice(held)
        rows.append((seq, i.replace("0", "O", 1), rng.choice(names), i, round(rng.random(), 3), round(rng.random(), 3)))
    df = spark.createDataFrame(rows, "seq long, raw_id string, name string, id string, similarity double, confidence double")
    entries = spark.createDataFrame(list(canonical.items()), "id string, name string")
    got = {r.seq: (r.id, r.moved_from) for r in appendix.reassigned(df, entries).collect()}
    by_id = {}
    for r in rows:
        by_id.setdefault(r[3], []).append(r)
    free, want = set(canonical) - set(by_id), {}
    for i, group in by_id.items():
        for place, r in enumerate(sorted(group, key=lambda r: (-r[4], -r[5], r[0]))):
            want[r[0]] = (i, None)
            if place:
                scored = sorted((-s, d, c) for s, d, c in plain_candidates(r[1], r[2], canonical) if c in free)
                if scored and -scored[0][0] >= 0.65 and scored[0][:2] not in [x[:2] for x in scored[1:2]]:
                    want[r[0]] = (scored[0][2], i)
                    free.remove(scored[0][2])
    assert got == want and sum(m is not None for _, m in want.values()) > 5


def test_index_rows_find_their_entries(spark):
    canonical = spark.createDataFrame([("00012", "桂枝汤"), ("00013", "麻黄汤"), ("00112", "桂枝汤"), ("00500", "四物汤")], "id string, name string")
    rows = [(1, "OOOI2", "桂枝汤", 0.9), (2, "0012", "桂枝汤", 0.9), (3, "00500", "四 物汤", 0.8), (4, "00500", "四物物", 0.9), (5, "77777", "不明", 0.9), (6, "00019", "麻黄汤", 0.9), (7, "00013", "桂枝汤", 0.9)]
    df = spark.createDataFrame(rows, "seq long, raw_id string, name string, confidence double")
    good, bad = appendix.matched(df, canonical)
    assert {r.seq: r.id for r in good.collect()} == {1: "00012", 2: "00012", 3: "00500", 4: "00500", 6: "00013", 7: "00012"}
    assert [(r.seq, r.reason) for r in bad.collect()] == [(5, "invalid_id_or_name")]
    index, review = appendix.build_index(df, canonical)
    assert sorted(r.id for r in index.collect()) == ["00012", "00013", "00112", "00500"] or sorted(r.id for r in index.collect()) == ["00012", "00013", "00500"]
    assert {r.reason for r in review.collect()} >= {"duplicate_id", "invalid_id_or_name"}


def test_terms_are_merged_in_order(spark):
    rows = spark.createDataFrame([("a", 2, ["3", "1"], [5]), ("a", 1, ["2", "1"], [4, 5]), ("b", 1, [], [])], "term string, seq int, ids array<string>, pages array<int>")
    merged = appendix.merged_terms(rows, ["term"], "seq", "ids", "pages")
    assert {r.term: (r.ids, r.pages, r.n_ids) for r in merged.collect()} == {"a": (["2", "1", "3"], [4, 5], 3), "b": ([], [], 0)}
    report = appendix.terms_report(merged, spark.createDataFrame([("1",), ("2",)], "id string"), "ids").first()
    assert (report.terms, report.relations, report.invalid, report.entries) == (2, 3, 1, 2)


def test_overlaps_appear_once(spark):
    left = spark.createDataFrame([(1, 0, 25), (1, 30, 31), (2, 0, 5)], "k int, l_start long, l_stop long")
    right = spark.createDataFrame([(1, 5, 45), (2, 5, 9)], "k int, r_start long, r_stop long")
    assert sorted(r.l_start for r in joins.overlaps(left, right, ["k"], 10).collect()) == [0, 30]


def test_digest_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([(i, str(i % 7)) for i in range(50)], "a int, b string")
    same = quality.digest(df.repartition(5).orderBy(F.desc("a"))).first()
    assert quality.digest(df).first() == same and same.n_rows == 50
    assert quality.digest(df.withColumn("b", F.lit("x"))).first().digest != same.digest


def test_scores_of_one_person(spark):
    rows = [("p", "first", 2, "defining"), ("p", "first", 2, "one_of"), ("p", "first", 2, "one_of"), ("p", "first", 0, "defining"), ("p", "second", 1, "one_of"), ("p", "second", 0, "one_of")]
    got = survey.scores(spark.createDataFrame(rows, "person string, dimension string, level int, kind string")).first()
    # level 2: max(6, 4 + 1) = 6, reference 6, so 6 / 6 * 6, and 0.3 at level 0
    assert (got.first, got.second, got.first_level, got.second_level) == (6.3, round(1 / 3, 6), 3, 1)


def test_outline(spark):
    lines = [("d", 1, "一、情绪"), ("d", 2, "1.1 心慌（焦虑4级之一）"), ("d", 3, "说明"), ("d", 4, "1.1.1 夜间 是（ ）"), ("d", 5, "1.2 乏力")]
    rows = survey.outline_rows(spark.createDataFrame(lines, "doc_id string, line_no int, text string")).orderBy("line_no").collect()
    assert [(r.line_no, r.level, r.parent) for r in rows] == [(1, 0, None), (2, 1, 1), (4, 2, 2), (5, 1, 1)]
    assert rows[1].title == "心慌" and rows[1].marks[0].level == 4


def test_retention_and_upsert(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 1),), (datetime.datetime(2024, 1, 20),)], "ts timestamp")
    assert [r.x for r in df.select(records.expired(F.col("ts"), datetime.datetime(2024, 2, 1)).alias("x")).collect()] == [True, False]
    a = spark.createDataFrame([(1, "old", 9), (2, "kept", 1)], "k int, v string, at int")
    b = spark.createDataFrame([(1, "new", 1)], "k int, v string, at int")
    assert {r.k: r.v for r in records.upsert(a, b, ["k"], "at").collect()} == {1: "new", 2: "kept"}


def test_frames(spark):
    df = spark.createDataFrame([('{"a":1}endendend{"a":2}endendend',)], "value string")
    assert [r.body for r in records.framed(df).orderBy("frame").collect()] == ['{"a":1}', '{"a":2}']


def test_grams_need_a_factor_for_every_unit_of_the_entry(spark):
    raw = ["人参一两甘草二钱", "人参一两甘草二钱", "人参一两甘草二钱", "人参500mg甘草1.5克", "大枣三枚甘草", "未知药6g"]
    texts = spark.createDataFrame(list(enumerate(raw)), "id int, text string")
    factors = spark.createDataFrame([(1, "两", 30.0), (1, "钱", 3.0), (2, "两", 30.0), (4, "枚", 5.0)], "id int, unit string, factor double")
    items = doses.to_grams(doses.extract(texts, "id", "text", ["人参", "甘草", "大枣"]), factors, "id")
    got = {}
    for r in items.orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.herb, None if r.grams is None else float(r.grams), r.refused))
    none = [("人参", None, False), ("甘草", None, False)]
    assert got[0] == none and got[1] == [("人参", 30, False), ("甘草", 6, False)]
    assert got[2] == [("人参", None, True), ("甘草", None, True)] and got[3] == [("人参", 0.5, False), ("甘草", 1.5, False)]
    assert got[4] == [("大枣", None, False), ("甘草", None, False)] and got[5] == [(None, None, False)]
    shown = {r.id: (r.text, r.warnings) for r in doses.references(texts, items, "id", "text").collect()}
    assert shown[0] == ("人参一两、甘草二钱", ["old_weights"]) and shown[1][0] == "人参30g、甘草6g" and shown[3] == ("人参0.5g、甘草1.5g", [])
    assert shown[4] == ("大枣三枚、甘草（剂量待核）", ["dose_missing", "counts_kept"]) and shown[5] == ("未知药6g", ["not_separated"])


def test_cover_represents_every_prototype(spark):
    rows = [(i, ["a"] if i < 8 else ["b", "c"] if i == 8 else ["c"], float(i % 5)) for i in range(12)]
    got = search.cover(spark.createDataFrame(rows, "id long, prototypes array<string>, quality double"), 3, 5).collect()
    chosen = {r.id for r in got}
    assert len(chosen) == 5 and {p for i, ps, _ in rows if i in chosen for p in ps} == {"a", "b", "c"}


def test_trees_of_any_depth(spark):
    chain = [(i, i - 1 if i else None, f"n{i}") for i in range(1000)]
    extra = [(2000, 2001, "x"), (2001, 2002, "y"), (2002, 2000, "z"), (2003, 2000, "below a ring"), (3000, 9999, "lost"), (3001, 3000, "under it"), (4000, 4000, "own parent")]
    got = {r.id: r for r in joins.ancestors(spark.createDataFrame(chain + extra, "id long, parent long, name string")).collect()}
    assert len(got) == 1007 and all(got[i].level == i and got[i].state == "whole" for i in range(1000))
    assert got[999].path == [f"n{i}" for i in range(1000)]
    assert {i for i in got if got[i].state == "cycle"} == {2000, 2001, 2002, 2003, 4000} and got[2000].path is None
    assert [(got[i].path, got[i].state) for i in (3000, 3001)] == [(["lost"], "orphan"), (["lost", "under it"], "orphan")]
    assert joins.ancestors(spark.createDataFrame([], "id long, parent long, name string")).count() == 0


def test_options_of_any_depth(spark):
    # 1 - 2 - ... - 300 are headings, 301 an option below, 302 hangs below the option 301
    nodes = [(i, i - 1 if i > 1 else None, 1, -1) for i in range(1, 301)] + [(301, 300, 2, 0), (302, 301, 1, 0), (303, 300, 1, 1), (400, 401, 1, -1), (401, 400, 1, -1)]
    df = spark.createDataFrame(nodes, "id long, parent_id long, ord int, mode int")
    got = questions.walk(df, spark.createDataFrame([(1,), (299,), (301,), (400,)], "root long")).collect()
    of = lambda root: [r.id for r in sorted(got, key=lambda r: r.place) if r.root == root]
    assert of(1) == [*range(2, 301), 303, 301] and of(299) == [300, 303, 301] and of(301) == [302] and of(400) == []
    assert {r.id: r.has_children for r in got if r.root == 299} == {300: True, 303: False, 301: True}


def test_sequence_repair_is_the_same_on_any_cut(spark):
    rng = random.Random(8)
    rows = []
    for volume in (1, 2, 3):
        n = 100 * volume
        for place in range(70 if volume < 3 else 3):
            n += 1
            raw = f"{n:05d}"
            if rng.random() < 0.5:
                at = rng.randrange(5)
                raw = raw[:at] + rng.choice("0123456789") + raw[at + 1 :]
            rows.append((volume, place, rng.choice([raw, raw, raw, None, "x"]) if rng.random() < 0.2 else raw, "桂枝汤", rng.choice(["桂枝汤", "桂枝汤", "四逆散"])))
    df = spark.createDataFrame(rows, "volume int, place int, raw_id string, name string, toc_name string")

    def plain():
        out, last, at = {}, None, None
        for volume, place, raw, name, toc in rows:
            last, at = (last if volume == at else None), volume
            found = assembly._accepted(raw, last, SequenceMatcher(None, name, toc).ratio())
            out[volume, place] = (found, found is not None and found != raw)
            last = found if found is not None and found.isdigit() else last
        return out

    want = plain()
    assert sum(r for _, r in want.values()) > 20
    for parts in (1, 3, 17):
        got = {(r.volume, r.place): (r.id, r.repaired) for r in assembly.repair_sequence(df, ["volume"], ["place"], parts=parts).collect()}
        assert got == want


def test_values_carry_over_buckets(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", None]), i, rng.choice([None, None, None, i])) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, at int, v int")
    whole = {(r.g, r["at"]): r.last for r in assembly.carry_forward(df, ["g"], ["at"], F.col("v"), "last").collect()}
    for width in (1, 7, 1000):
        cut = assembly.carry_forward(df, ["g"], ["at"], F.col("v"), "last", F.floor(F.col("at") / width))
        assert cut.columns == ["g", "at", "v", "last"] and {(r.g, r["at"]): r.last for r in cut.collect()} == whole


def test_pairs_within_edits_equal_all_pairs(spark):
    rng = random.Random(10)
    names = sorted({"".join(rng.choice("abc头") for _ in range(rng.randint(0, 9))) for _ in range(120)})
    df = spark.createDataFrame([("hot" if i % 4 else "x", n) for i, n in enumerate(names)], "block string, name string")
    other = df.withColumnRenamed("name", "other")
    pairs = df.join(other, "block").withColumn("distance", F.levenshtein("name", "other"))
    for edits in (1, 2, 3):
        got = fuzzy.within(df, other, ["block"], "name", "other", edits)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.filter(F.col("distance") <= edits).select("block", "name", "other", "distance").collect()))
    far = spark.createDataFrame([("hot", "".join(rng.choice("abcdefghijklmnop") for _ in range(24))) for _ in range(500)], "block string, name string")
    assert fuzzy.candidates(far, far.withColumnRenamed("name", "other"), ["block"], "name", "other", 2).count() < 2000


def test_a_changed_row_names_its_range(spark):
    df = spark.createDataFrame([(i, f"t{i}", None if i % 3 else "x") for i in range(1000)] + [(None, "no key", "y")], "id long, text string, extra string")
    before = digests.tree(df, "id", 10)
    assert digests.changed(before, digests.tree(df.select("extra", "id", "text").orderBy(F.desc("text")).repartition(3), "id", 10), 10).count() == 0
    now = df.filter("id is null or id <> 777").withColumn("text", F.when(F.col("id") == 123, "new").otherwise(F.col("text"))).union(spark.createDataFrame([(99_999, "far", "z")], "id long, text string, extra string"))
    got = digests.changed(before, digests.tree(now, "id", 10), 10).collect()
    assert sorted(map(tuple, got)) == [(120, 130, 10, 10), (770, 780, 10, 9), (99_990, 100_000, 0, 1)]
    assert [r.low for r in digests.changed(before, digests.tree(df.filter("id is not null"), "id", 10), 10).collect()] == [None]


def test_pruned_top_k_equals_scoring_everything(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    texts = [(i, " ".join(rng.choices(words, weights, k=rng.choice([4, 20, 100, 400])))) for i in range(2400)]
    folder = search.build_index(spark.createDataFrame(texts, "id long, body string"), "id", {"body": F.col("body")})
    index, lengths = search.open_index(spark, folder)
    tokens = spark.createDataFrame([(q, t) for q in range(12) for t in rng.sample(words, 3)] + [(99, "absent")], "query int, token string")
    exact = search.bm25(index, lengths, tokens, {"body": 1.0})
    want = search.best_ranked(exact, ["query"], [F.desc(F.round("score", 6)), F.col("id")], 10)
    top, report = topk.best(*topk.impact_blocks(index, lengths, {"body": 1.0}, 4), tokens, 10)
    show = lambda df: sorted((r.query, r["rank"], r.id, round(r.score, 6)) for r in df.collect())
    assert show(top) == show(want) and len(show(top)) >= 100
    row = report.first()
    assert 0 < row.read < 0.9 * row.matched
