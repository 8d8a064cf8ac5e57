"""Filter audit, conversation repair and subword quality against plain models."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.llm import conversation_repair as C
from scholia.llm import filter_audit as A
from scholia.llm import quality_classifier as Q
from scholia.llm import queries

SF = "/root/testdata/sf0.001"


def brute_audit(rows, labels, letters, fails):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {p or "" for p, *_ in rows}:
        mine = [r for r in rows if (r[0] or "") == part]
        lost = Counter()
        for order in itertools.permutations(letters):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if fails(f, r)]
                removed_before = [r for r in mine if all(r is not x for x in left)]
                left = [r for r in left if not fails(f, r)]
                lost[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(fails(f, r) for r in removed_before), sum(fails(f, r) and not any(fails(g, r) for g in letters if g != f) for r in mine),
                    sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone),
                ]
        for order in itertools.permutations(letters):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(lost[f])
    return out


def test_audit_equals_running_every_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["x", "y", None, ""]), rng.choice([*range(40), None]), rng.choice(["", None, "abc", "long text", "t%d" % rng.randint(0, 3)]), rng.choice([0, 1, None])) for _ in range(150)]
    rows += [("hot", i, "same", 1) for i in range(60)] + [("hot", 0, "same", 1)] * 3 + [("x", 5, "long " * 20_000, 0)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(30)] + [(3, 1, 1), (None, 1, 1)]
    first = {}
    for _, i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))

    def fails(f, r):
        return bool({"A": (r[3] or 0) > 0, "B": len(r[2] or "") > 3, "E": r[1] is not None and r[1] > first[r[2] or ""]}[f])

    filters = {"A": F.col("a") > 0, "B": F.length(F.coalesce("text", F.lit(""))) > 3}
    # columns that share names with the operator's own are not read
    df = spark.createDataFrame([(*r, "m", 1, True) for r in rows], "source string, doc_id long, text string, a int, mask string, good int, digest boolean")
    got = A.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), filters, "E").collect()
    want = brute_audit(rows, labels, "ABE", fails)
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == want and len(got) == len(want)
    assert A.audit(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), filters, "E").count() == 0
    with pytest.raises(ValueError):
        A.audit(df, df, {c: F.lit(True) for c in "ABCDEFG"}, "H")


def test_op12_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    want = con.sql(queries.oracle_sql()["op12_filter_audit"])
    got = queries.queries()["op12_filter_audit"](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def edits_of(rows):
    """The cheapest, least audit by dynamic programming over whole strings."""
    after = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    onward = {0: 2, 1: 2, 2: 3, 3: 2}

    def inserted(states):
        best = dict(states)
        for _ in range(2):
            for s, (c, t) in list(best.items()):
                new = (c + 3, t + "I")
                if onward[s] not in best or new < best[onward[s]]:
                    best[onward[s]] = new
        return best

    states = {0: (0, "")}
    for initial, refused, cut in rows:
        new = {}
        for s, (c, t) in inserted(states).items():
            options = [(4, "D", s)]
            if not refused:
                fine = 3 if cut else 0
                options += [(3 + fine, "R", onward[s])] + ([(fine, "K", after[initial][s])] if s in after.get(initial, {}) else [])
            for cost, letter, to in options:
                if to not in new or (c + cost, t + letter) < new[to]:
                    new[to] = (c + cost, t + letter)
        states = new
    return min(v for s, v in inserted(states).items() if s in (0, 3))


def exhaustive(rows):
    """The same by trying every edit."""
    best = None
    fills = ["", "u", "a", "ua", "au"]
    kinds = [("D",)] + [("K",), ("R", "u"), ("R", "a")]
    for gaps in itertools.product(fills, repeat=len(rows) + 1):
        for ops in itertools.product(kinds, repeat=len(rows)):
            cost, audit, out = 3 * len("".join(gaps)), "I" * len(gaps[0]), gaps[0]
            for (initial, refused, cut), op, gap in zip(rows, ops, gaps[1:]):
                if refused and op[0] != "D":
                    break
                cost += {"D": 4, "K": 0, "R": 3}[op[0]] + (3 if cut and op[0] != "D" else 0)
                out += {"D": "", "K": initial}.get(op[0], op[-1]) + gap
                audit += op[0] + "I" * len(gap)
            else:
                if re.fullmatch("(s?(ua)+)?", out) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def brute_repair(rows):
    """rows: (turn, role, text) of a conversation, in order."""
    turns = [t for t, _, _ in rows if t is not None]
    seen, kinds = set(), []
    n = Counter()
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else ""
        seen.add((role, text))
        n[fault] += 1
        kinds.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = edits_of(kinds)
    out, left = [], iter(rows)
    length = sum(x != "D" for x in audit)
    for x in audit:
        place = len(out) - length % 2  # what is odd begins with a system row
        said = "assistant" if place % 2 else "user"
        if x == "I":
            out.append(f"{said}:")
            continue
        _, role, text = next(left)
        if x != "D":
            out.append(f"{role if x == 'K' else said}:{text}")
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def test_program_equals_trying_everything():
    rng = random.Random(2)
    for _ in range(12):
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 3))]
        want = exhaustive(rows)
        assert edits_of(rows) == want
    for _ in range(400):
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 12))]
        program = C.Program()
        kinds = [C.REFUSED if refused else "suax".index(i) + (C.TRUNCATED if cut else 0) for i, refused, cut in rows]
        path, costs, ranks = program.run(kinds)
        cost, state, last = C.ending(costs, ranks)
        steps, start = C.traced([program.back[t] for t in path], 0, state)
        audit = "".join(e for e, _, _ in C.edited(steps, [("", "")] * len(rows), 0, last))
        assert start == 0 and (cost, audit) == edits_of(rows)


def conversations(rng):
    said = ["Yes.", "No!", "Why?", "", " \t", "cut off", "so. ", "…", None, "è.\n"]
    rows = []
    for c in [*range(40), None]:
        for _ in range(rng.randint(1, 14)):
            rows.append((c, rng.choice([*range(6), None]), rng.choice(["system", "user", "assistant", "tool", None, ""]), rng.choice(said) if rng.random() < 0.7 else f"{rng.random()}."))
    rows += [(77, t, "user" if t % 2 == 0 else "assistant", rng.choice(["a.", "b.", "same.", f"{t}."])) for t in range(300)] + [(78, 1, "user", "twin.")] * 50 + [(79, 0, "user", "long " * 50_000)]
    return rows


@pytest.mark.parametrize("giant", [10**9, 20])
def test_repair_equals_plain_model(spark, monkeypatch, giant):
    monkeypatch.setattr(C, "BLOCK_ROWS", 7)
    rows = conversations(random.Random(3))
    df = spark.createDataFrame([(*r, i % 9 != 0, "x") for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, here boolean, th string")
    by = {c: [] for c, *_ in rows}
    for i, (c, t, r, x) in enumerate(rows):
        if i % 9:
            by[c].append((t, " " if r is None else r, " " if x is None else x))
    hashes = {r.text: r.h for r in spark.createDataFrame([(x,) for x in {x for v in by.values() for _, _, x in v}], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    want = {c: brute_repair(sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashes[r[2]]))) for c, v in by.items()}
    got = C.repair(df, present=F.col("here"), giant_rows=giant).collect()
    assert len(got) == len(want) and {r.conv_id: tuple(r)[1:] for r in got} == want
    listed = C.repaired_rows(df, present=F.col("here"), giant_rows=giant).orderBy("conv_id", "block", "pos").collect()
    for c in (77, 78, 5):
        mine = [r for r in listed if r.conv_id == c]
        assert "".join(r.edit for r in mine) == want[c][6]
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine if r.edit != "D").encode()).hexdigest() == want[c][7]
    assert C.repair(df.limit(0)).count() == 0


def test_op13_equals_plain_model(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    by = {c: [] for c, *_ in rows}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        fate = zlib.crc32(f"{c}:{t}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        by[c] += [(t, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    df = queries.queries()["op13_conversation_repair"](spark, SF)
    assert dict(df.dtypes) == dict(conv_id="bigint", audit="string", repaired_sha256="string", **dict.fromkeys(C.COUNTS, "bigint"))
    got = df.collect()
    assert len(got) == len(by) and {r.conv_id: tuple(r)[1:] for r in got} == {c: brute_repair(v) for c, v in by.items()}
    assert brute_repair([])[-1] == hashlib.sha256(b"").hexdigest()


def plain_buckets(text):
    """Features one by one."""
    m = 1 << 64
    mix = lambda h, n: ((h + n) * 0x9E3779B97F4A7C15 % m >> 40) & (Q.BUCKETS - 1)
    out, before = [], None
    for word in re.findall(r"[^\x20\x09-\x0D]+", text):
        if word == before:
            out.append(Q.AGAIN)
            continue
        before = word
        codes = [0, *map(ord, word), 0]
        h, power = 0, 1
        for c in codes[1:-1]:
            h, power = (h + c * power) % m, power * (2 * 0x100000001B3 + 1) % m
        out.append(mix(h, 0))
        for n in Q.GRAMS:
            for i in range(len(codes) - n + 1):
                h = 0
                for c in codes[i : i + n]:
                    h = (h * 0x100000001B3 + c) % m
                out.append(mix(h, n))
    return out


def test_features_equal_plain_ones(monkeypatch):
    rng = random.Random(4)
    for _ in range(100):
        text = "".join(rng.choice("ab é头😀.  \n\t") for _ in range(rng.randint(0, 60)))
        assert Counter(Q.buckets_of(text).tolist()) == Counter(plain_buckets(text)), repr(text)
    monkeypatch.setattr(Q, "BLOCK", 10)
    blocks = list(Q.blocks_of("aa bb cc dd ee " + "x" * 25 + " y"))
    assert "".join(blocks) == "aa bb cc dd ee " + "x" * 25 + " y" and max(map(len, blocks)) <= 10


def test_quality_is_learned(spark):
    rng = random.Random(6)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(40)) + "."
    bad = lambda: rng.choice([lambda: good().upper() + "!!", lambda: " ".join(["Of"] * 40), lambda: " ".join(w + "$$" for w in good().split())])()
    texts = [(i, good() if i % 3 else bad()) for i in range(900)]
    df = spark.createDataFrame([*texts, (None, "x y"), (5000, None), (5001, ""), (5002, "word " * 300_000), (7, texts[7][1])], "doc_id long, text string").withColumn("label", F.lit("clash")).withColumn("id", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(900)] + [(3, None), (None, 0)], "doc_id long, quality int")
    trains = F.col("doc_id") % 2 == 0
    model = Q.fit(df, labels, trains)
    scored = Q.score(df, model).collect()
    assert len(scored) == 905 and all(0 <= r.score <= 1 and r.label == "clash" for r in scored)
    wrong = sum((r.score >= 0.5) != (r.doc_id % 3 > 0) for r in scored if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 2)
    assert wrong <= 5
    assert len({r.score for r in scored if r.doc_id == 7}) == 1 and len({r.score for r in scored if r.doc_id in (5000, 5001)}) == 1
    # a score is the logistic of the mean gain of the features
    for r in scored[:20]:
        found = [*plain_buckets(r.text or ""), Q.END]
        assert abs(r.score - 1 / (1 + np.exp(-(model.bias + model.gain[found].mean(dtype=np.float64))))) < 1e-9
    again = Q.fit(df.repartition(5), labels, trains)
    assert np.allclose(again.gain, model.gain) and again.bias == pytest.approx(model.bias)
    one_kind = Q.fit(df, labels.filter("quality = 1"), trains)
    assert {round(r.score, 6) for r in Q.score(df, one_kind).collect()} == {1.0}
    none = Q.fit(df, labels.limit(0), trains)
    assert {r.score for r in Q.score(df, none).collect()} == {0.5} and Q.score(df.limit(0), none).count() == 0


def test_op11_keeps_its_contract_and_holds_out(spark):
    df = queries.queries()["op11_subword_quality"](spark, "/root/testdata/sf0.01")
    assert dict(df.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    got = {r.doc_id: r for r in df.collect()}
    docs = {i for (i,) in duckdb.sql("select doc_id from '/root/testdata/sf0.01/documents.parquet'").fetchall()}
    labels = dict(duckdb.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    assert set(got) == docs and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    held = [(labels[i], r.predicted) for i, r in got.items() if r.held_out and i in labels]
    assert sum(a == b for a, b in held) >= 0.93 * len(held) and len(held) > 50
