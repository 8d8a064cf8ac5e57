"""Layered search on a small ontology."""

from pyspark.sql import functions as F

from scholia.operators import layered as L

PROTOTYPES = [
    ("p1", ["益气", "补气"], ["气虚"], "neutral"),
    ("p2", ["清热", "泻火"], ["热盛"], "cooling"),
    ("p3", ["温阳散寒"], ["阳虚"], "warming"),
]


def prototypes(spark):
    return spark.createDataFrame(PROTOTYPES, "prototype string, treatment_terms array<string>, mechanism_terms array<string>, direction string")


def test_profiles_are_routed_by_best_terms(spark):
    profiles = spark.createDataFrame([(1, ["益气", "补气健脾"], ["气虚"]), (2, ["清热"], []), (3, [], [])], "query int, treatments array<string>, mechanisms array<string>")
    got = {(r.query, r.prototype): (r.position, r.matched_treatments, r.matched_mechanisms) for r in L.route(profiles, prototypes(spark)).collect()}
    assert got[1, "p1"] == (0, ["益气", "补气"], ["气虚"]) and got[2, "p2"] == (0, ["清热"], [])
    assert not [k for k in got if k[0] == 3]


def test_conflicts_of_direction(spark):
    df = spark.createDataFrame([("寒", ["cooling"], ""), ("寒热", ["cooling"], ""), ("热", ["neutral"], "温阳"), ("寒", [], "清热温中")], "nature string, directions array<string>, action string")
    got = df.select(L.profile_conflicts(F.col("nature"), F.col("directions")).alias("a"), L.candidate_conflicts(F.col("nature"), F.col("directions"), F.col("action")).alias("b")).collect()
    assert [r.a for r in got] == [["cold_routed_cooling"], [], [], []]
    assert [r.b for r in got] == [["cold_but_cooling"], [], ["heat_but_warming"], []]


def candidate(**changes):
    base = {
        "query": 1, "id": "00001", "name": "甲方", "layer": "core", "rank": 0, "flags": [], "unrouted": [], "directions": ["neutral"], "routed_terms": [],
        "fields": {"方源": "书", "组成": "药", "功用": "益气健脾", "主治": "气虚乏力"}, "nature": ["虚"], "primary_treatment": ["益气"], "secondary_treatment": [],
        "adjunct_treatment": [], "primary_pathogenesis": ["气虚"], "secondary_pathogenesis": [], "concurrent_pathogenesis": [], "clinical": ["乏力"],
    }
    return {**base, **changes}


SCHEMA = (
    "query int, id string, name string, layer string, rank int, flags array<string>, unrouted array<string>, directions array<string>, routed_terms array<string>, "
    "fields map<string,string>, nature array<string>, primary_treatment array<string>, secondary_treatment array<string>, adjunct_treatment array<string>, "
    "primary_pathogenesis array<string>, secondary_pathogenesis array<string>, concurrent_pathogenesis array<string>, clinical array<string>"
)


def test_grades_scores_and_gate(spark):
    rows = [
        candidate(),
        candidate(id="2", rank=3, layer="archive", fields={"方源": "书", "组成": "药", "功用": "补虚", "主治": "气虚"}, routed_terms=["益气"]),
        candidate(id="3", name="乙方", fields={"方源": "书", "组成": "", "功用": "益气", "主治": "气虚"}),
        candidate(id="4", name="丙方", unrouted=["攻下"]),
        candidate(query=2, id="5", name="丁方", fields={"方源": "书", "组成": "药", "功用": "泻下", "主治": "便秘"}),
    ]
    df = L.annotate(spark.createDataFrame(rows, SCHEMA))
    got = {r.id: r for r in df.collect()}
    assert [got[i].consistency for i in ("00001", "2", "3", "4", "5")] == [L.HIGH, L.HIGH, L.LOW, L.REVIEW, L.LOW]
    assert got["00001"].selection_score == 100 + 28 + 14 + 12 and got["00001"].cautions == []
    assert got["2"].treatment_coverage == 1.0 and got["3"].missing == ["组成"] and got["3"].cautions == ["facts_missing"]
    top, refused = L.gate_and_finish(df, "name", 5)
    assert sorted(r.id for r in top.collect()) == ["00001", "4"]
    assert {r.query: r.n_refused for r in refused.collect()} == {1: 1, 2: 1}
    queries = spark.createDataFrame([(1,), (2,)], "query int")
    assert [r.query for r in L.still_open(df, queries).collect()] == [2]


def test_core_records_take_their_best_route(spark):
    records = spark.createDataFrame([("a", ["p1", "p2"]), ("b", ["p9"])], "id string, prototypes array<string>")
    routes = spark.createDataFrame([(1, "p2", 0), (1, "p1", 2)], "query int, prototype string, position int")
    got = L.core_records(records, routes).withColumn("boost", L.core_boost(F.col("position"), F.lit(True), F.lit(False))).collect()
    assert [(r.id, r.position, r.boost) for r in got] == [("a", 0, 60.0)]
