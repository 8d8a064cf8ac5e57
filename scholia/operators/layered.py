"""Layered search: routing of profiles to prototypes, coverage, grades and scores.

All of it is column expressions over rows of (query, candidate); prototypes are an
ontology of fixed size (40 to 100 rows) and the only table that is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .search import capped

#: Markers of warming and of cooling action; grades; facts of an entry.
WARMING = ("温中", "温阳", "回阳", "助阳", "补阳", "散寒", "祛寒")
COOLING = ("清热", "泻火", "凉血", "清营", "清暑", "退热")
HIGH, REVIEW, LOW = "较高", "需复核", "不足"
FACTS = ("方源", "组成", "功用", "主治")

#: Weights of primary, secondary and adjunct treatments, and of primary,
#: secondary and concurrent pathogenesis.
TREATMENT_WEIGHTS, PATHOGENESIS_WEIGHTS = (0.6, 0.25, 0.15), (0.65, 0.2, 0.15)

#: Similarity from which a prototype's term counts as hit, and a term as covered.
HIT, COVERED = 0.65, 0.5

#: Prototypes that a profile is routed to, at most.
ROUTES = 3


def _mean(scores: Column) -> Column:
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(scores) > 0, total / F.size(scores)).otherwise(F.lit(1.0))


def coverage(terms: Column, text: Column) -> Column:
    """Mean similarity of the terms to the text; 1.0 without terms."""
    return _mean(F.transform(terms, lambda t: X.phrase_similarity(t, text)))


def covered(terms: Column, text: Column) -> Column:
    return F.filter(terms, lambda t: X.phrase_similarity(t, text) >= COVERED)


def weighted(groups: list[tuple[Column, float]], score) -> Column:
    """Weighted mean of ``score(terms)`` over the groups that have terms; 1.0 if none has."""
    weight = sum((F.when(F.size(t) > 0, F.lit(w)).otherwise(0.0) for t, w in groups), F.lit(0.0))
    total = sum((F.when(F.size(t) > 0, score(t) * w).otherwise(0.0) for t, w in groups), F.lit(0.0))
    return F.when(weight > 0, total / weight).otherwise(F.lit(1.0))


def weighted_coverage(groups: list[tuple[Column, float]], text: Column) -> Column:
    return weighted(groups, lambda terms: coverage(terms, text))


def nearest(term: Column, ontology: Column) -> Column:
    """Best similarity of a term to any term of an ontology; 0 for an empty one."""
    return F.coalesce(F.array_max(F.transform(ontology, lambda o: X.phrase_similarity(term, o))), F.lit(0.0))


def ontology_coverage(groups: list[tuple[Column, float]], ontology: Column) -> Column:
    return weighted(groups, lambda terms: _mean(F.transform(terms, lambda t: nearest(t, ontology))))


def route(profiles: DataFrame, prototypes: DataFrame, treatments: str = "treatments", mechanisms: str = "mechanisms") -> DataFrame:
    """(query, prototype, position, matched_treatments, matched_mechanisms) of the ROUTES
    prototypes that score best for each profile: their best treatment term, three points
    for every treatment of the profile that they answer, and their best mechanism term."""
    pairs = profiles.join(F.broadcast(prototypes.select("prototype", "treatment_terms", "mechanism_terms")))
    said = F.array_join(treatments, "；"), F.array_join(mechanisms, "；")
    hits = lambda terms, text: F.filter(terms, lambda t: X.phrase_similarity(t, text) >= HIT)

    def points(terms: Column, text: Column, most: int, per: int, more: int) -> Column:
        worth = F.transform(hits(terms, text), lambda t: X.phrase_similarity(t, text) * F.least(F.lit(most), F.length(t) * per + more))
        return F.coalesce(F.array_max(worth), F.lit(0.0))

    answered = F.size(F.filter(treatments, lambda t: nearest(t, F.col("treatment_terms")) >= COVERED))
    score = points(F.col("treatment_terms"), said[0], 14, 2, 0) + 3 * answered + points(F.col("mechanism_terms"), said[1], 8, 1, 2)
    scored = pairs.select(
        "query", "prototype", score.alias("score"), hits(F.col("treatment_terms"), said[0]).alias("matched_treatments"), hits(F.col("mechanism_terms"), said[1]).alias("matched_mechanisms")
    ).filter("score > 0")
    best = capped(scored, ["query"], [F.desc("score"), F.col("prototype")], ROUTES)
    return best.withColumn("position", F.expr("row_number() over (partition by query order by score desc, prototype) - 1")).drop("score")


def _one_sided(nature: Column, this: str, other: str) -> Column:
    return F.contains(nature, F.lit(this)) & ~F.contains(nature, F.lit(other))


def profile_conflicts(nature: Column, directions: Column) -> Column:
    """Names of conflicts between a profile's nature and the directions it was routed to."""
    cold = F.when(_one_sided(nature, "寒", "热") & F.array_contains(directions, "cooling"), F.lit("cold_routed_cooling"))
    heat = F.when(_one_sided(nature, "热", "寒") & F.array_contains(directions, "warming"), F.lit("heat_routed_warming"))
    return F.array_compact(F.array(cold, heat))


def candidate_conflicts(nature: Column, directions: Column, action: Column) -> Column:
    """The same for a candidate, whose action text may tell its direction too."""
    marked = lambda markers: F.rlike(action, F.lit("|".join(markers)))
    warms = F.array_contains(directions, "warming") | marked(WARMING)
    cools = F.array_contains(directions, "cooling") | marked(COOLING)
    cold = F.when(_one_sided(nature, "寒", "热") & cools & ~warms, F.lit("cold_but_cooling"))
    heat = F.when(_one_sided(nature, "热", "寒") & warms & ~cools, F.lit("heat_but_warming"))
    return F.array_compact(F.array(cold, heat))


def missing_facts(fields: Column) -> Column:
    blank = lambda f: F.trim(F.coalesce(F.element_at(fields, F.lit(f)), F.lit(""))) == ""
    return F.array_compact(F.array(*(F.when(blank(f), F.lit(f)) for f in FACTS)))


def core_records(records: DataFrame, routes: DataFrame) -> DataFrame:
    """(query, id, position): core records that share a routed prototype, at their best."""
    exploded = records.select("id", F.explode("prototypes").alias("prototype"))
    return exploded.join(routes.select("query", "prototype", "position"), "prototype").groupBy("query", "id").agg(F.min("position").alias("position"))


def core_boost(position: Column, parent: Column, official: Column) -> Column:
    return 42.0 - 8.0 * position + F.when(parent, 18.0).otherwise(0.0) + F.when(official, 5.0).otherwise(0.0)


def grade(treatment: Column, pathogenesis: Column, clinical: Column, missing: Column, flags: Column, conflicts: Column, unrouted: Column) -> Column:
    """How well an entry answers a profile when read backwards."""
    whole = (F.size(missing) == 0) & (F.size(flags) == 0)
    calm = F.size(conflicts) == 0
    path = (pathogenesis >= 0.2) | (clinical >= 0.35)
    return F.when(whole & (treatment >= 0.5) & path & calm & (F.size(unrouted) == 0), HIGH).when(whole & (treatment >= 0.3) & calm, REVIEW).otherwise(LOW)


def selection_score(layer: Column, rank: Column, treatment: Column, pathogenesis: Column, clinical: Column, missing: Column, flags: Column, conflicts: Column, unrouted: Column) -> Column:
    gained = F.when(layer == "core", 100).otherwise(82) - 2 * rank + 28 * treatment + 14 * pathogenesis + 12 * clinical
    return gained - 45 * F.size(conflicts) - 12 * F.size(missing) - F.when(F.size(flags) > 0, 16).otherwise(0) - 28 * F.size(unrouted)


def annotate(candidates: DataFrame) -> DataFrame:
    """Candidates with their coverages, conflicts, grade and selection score.

    ``candidates`` has query, id, layer, rank, fields (map, in normal form), flags, unrouted (names of
    attacking prototypes that were not routed), directions and routed_terms (of the
    candidate's routed prototypes), and the profile: nature, primary_/secondary_/
    adjunct_treatment, primary_/secondary_/concurrent_pathogenesis, clinical."""
    field = lambda f: X.plain(F.element_at("fields", F.lit(f)))
    treatments = [(F.col(f"{n}_treatment"), w) for n, w in zip(("primary", "secondary", "adjunct"), TREATMENT_WEIGHTS)]
    paths = [(F.col(f"{n}_pathogenesis"), w) for n, w in zip(("primary", "secondary", "concurrent"), PATHOGENESIS_WEIGHTS)]
    action, indication = field("功用"), field("主治")
    nature = X.plain(F.concat_ws("；", "nature", *(t for t, _ in paths)))
    rows = candidates.select(
        "*",
        F.greatest(weighted_coverage(treatments, action), ontology_coverage(treatments, F.col("routed_terms"))).alias("treatment_coverage"),
        weighted_coverage(paths, F.concat_ws("；", indication, action)).alias("pathogenesis_coverage"),
        coverage(F.col("clinical"), indication).alias("clinical_coverage"),
        missing_facts(F.col("fields")).alias("missing"),
        candidate_conflicts(nature, F.col("directions"), action).alias("conflicts"),
        X.first_meaning(F.coalesce(F.element_at("fields", F.lit("正文及其他")), F.lit(""))).alias("meaning"),
    )
    shared = [F.col(c) for c in ("treatment_coverage", "pathogenesis_coverage", "clinical_coverage", "missing", "flags", "conflicts", "unrouted")]
    every = F.concat(*(t for t, _ in treatments))
    unsupported = F.filter(every, lambda t: (X.phrase_similarity(t, action) < COVERED) & (nearest(t, F.col("routed_terms")) < COVERED))
    note = lambda name, when: F.when(when, F.lit(name))
    cautions = F.array_compact(
        F.concat(
            F.array(note("treatment_not_covered", F.size(unsupported) > 0), note("facts_missing", F.size("missing") > 0)),
            F.col("conflicts"),
            F.array(note("attacking_not_routed", F.size("unrouted") > 0), note("flagged", F.size("flags") > 0)),
        )
    )
    return rows.select("*", grade(*shared).alias("consistency"), selection_score(F.col("layer"), F.col("rank"), *shared).alias("selection_score"), cautions.alias("cautions"))


def gate_and_finish(annotated: DataFrame, name: str, top_k: int) -> tuple[DataFrame, DataFrame]:
    """The best ``top_k`` of each query, one per name, without those graded low; and how
    many of each query were refused."""
    refused = annotated.groupBy("query").agg(F.count_if(F.col("consistency") == LOW).alias("n_refused"))
    order = [F.desc(F.round("selection_score", 6)), F.col("id")]
    single = capped(annotated.filter(F.col("consistency") != LOW), ["query", name], order, 1)
    return capped(single, ["query"], order, top_k), refused


def still_open(core: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries whose core candidates hold no high grade: these go to the archive."""
    answered = core.filter(F.col("consistency") == HIGH).select("query").distinct()
    return queries.join(answered, "query", "left_anti")
