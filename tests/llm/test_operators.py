"""Operators of the subpackage against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scholia.llm import components, edit_counts, mixing, near_copies, ngram_lm, quality, repeats, simhash, sketches, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, score double, fp string, spans string"
SPACE = " \t\n\x0b\x0c\r"


def documents(spark, texts, extra=()):
    rows = [(i, t, 1.0, "clash", "clash") for i, t in enumerate(texts)] + [(i, t, 1.0, None, None) for i, t in extra]
    return spark.createDataFrame(rows, SCHEMA)


def random_texts(n, seed, words=12):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, words))) for _ in range(n)]


# --- SimHash -------------------------------------------------------------------


def brute_print(text, words):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    counts = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    value = sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))
    return value - (1 << 64) if value >> 63 else value


def test_fingerprints_equal_brute_force(spark):
    texts = [*random_texts(40, 1), "", None, "One", "two words", "É\tA\x0bB  c", "x " * 5000]
    got = simhash.with_fingerprint(documents(spark, texts), words=3, out="print").collect()
    assert all(r["print"] == brute_print(r.text or "", 3) for r in got) and len(got) == len(texts)


@pytest.mark.parametrize("radius", [0, 3, 6])
def test_components_equal_brute_force(spark, radius, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 8)
    monkeypatch.setattr(simhash, "MOST", 12)
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(25)]
    values = [0, 0]
    for c in centres:
        for _ in range(rng.randrange(1, 12)):
            values.append(c)
            for _ in range(rng.randrange(0, radius + 2)):
                c ^= 1 << rng.randrange(64)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([*((i, v) for i, v in enumerate(signed)), (None, 0)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.components(prints, radius).collect()}
    parent = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    assert {i: parent[i] for i in range(len(values))} | {None: 0} == got


def test_two_views_link_by_both(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(60):
        a, b = rng.getrandbits(63), rng.getrandbits(63)
        rows.append((a, b))
        for _ in range(3):
            flip = lambda x, n: x ^ sum(1 << i for i in rng.sample(range(63), n))
            rows.append((flip(a, rng.randrange(9)), flip(b, rng.randrange(14))))
    prints = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, fp long, fp1 long")
    got = {r.doc_id: r.component_id for r in simhash.components(prints, 7, views=2, limit=16).collect()}
    parent = list(range(len(rows)))
    for i, x in enumerate(rows):
        for j, y in enumerate(rows[:i]):
            d = [(p ^ q).bit_count() for p, q in zip(x, y)]
            if min(d) <= 7 and sum(d) <= 16:
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    assert got == dict(enumerate(parent))


def test_trees_keep_every_pair_together():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    values = np.concatenate([values, values ^ np.uint64(0b101), values ^ np.uint64(1 << 40)])
    for mask in simhash.bit_blocks(3):
        nodes = simhash.grow(values, mask, 1, 10)
        homes = {}
        for leaf, at in simhash.route(values, nodes, mask, 1):
            for i in at.tolist():
                homes.setdefault(i, set()).add(leaf)
        near = np.bitwise_count((values[:, None] ^ values[None]) & np.uint64(mask)) <= 1
        assert len(set().union(*homes.values())) > 10
        assert all(homes[i] & homes[j] for i, j in zip(*np.nonzero(near)))


def test_components_of_chains_loops_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 6), (None, 3), (200, 150)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 150, 150: 150}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table_has_no_components(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("most, sample", [(2000, 16), (3, 1)])
def test_near_copies_equal_brute_force(spark, most, sample, monkeypatch):
    monkeypatch.setattr(near_copies, "MOST", most)
    monkeypatch.setattr(near_copies, "SAMPLE", sample)
    rng = random.Random(most)
    texts = ["", None, "two words", "Two  WORDS", "other words"]
    line = " ".join(f"common{i}" for i in range(40))
    for b in range(24):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([6, 40, 150]))] + (line.split() if b % 3 else [])
        texts.append(" ".join(base))
        for edits in range(1, 9):  # each substituted word breaks up to five shingles
            copy = list(base)
            for at in rng.sample(range(len(copy)), min(len(copy), edits * len(base) // 150 + edits % 2)):
                copy[at] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(copy))
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = [shingles((t or "").lower().split()) for t in texts]
    parent, seen = list(range(len(texts))), Counter()
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            index = len(x & y) / len(x | y) if x | y else 1.0
            seen[int(index * 20)] += 1
            if 5 * len(x & y) >= 4 * len(x | y):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    assert all(seen[k] for k in range(14, 19))  # 0.70 to 0.95
    got = {r.doc_id: r.near for r in near_copies.groups(documents(spark, texts), 5, 2, 7, 26).collect()}
    least = {}
    for i in range(len(texts)):
        least.setdefault(got[i], i)
    assert [least[got[i]] for i in range(len(texts))] == parent
    assert near_copies.groups(documents(spark, []), 5, 2, 7, 26).count() == 0


# --- repeated passages -------------------------------------------------------------


def brute_cut(texts, depth):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + depth] for d in data for i in range(len(d) - depth + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - depth + 1):
            if seen[d[i : i + depth]] > 1:
                gone[i : i + depth] = [True] * depth
        out.append((sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), bytes(c for c, g in zip(d, gone) if not g)))
    return out


@pytest.mark.parametrize("most", [2000, 2])
def test_repeats_equal_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(repeats, "MOST", most)
    rng = random.Random(5)
    shared = random_texts(6, 9, 40)
    texts = [x + rng.choice(shared) + y + rng.choice(shared)[:50] for x, y in zip(random_texts(60, 10), random_texts(60, 11))]
    texts += ["a" * 300, "ab" * 100, "a" * 20, "", None, texts[0], texts[0], "é漢" * 40]
    for depth in (20, 33):
        df = documents(spark, texts, [(None, texts[3]), (None, "x" * 50), (None, "x" * 50), (4, texts[4])])
        every = [*texts, texts[3], "x" * 50, "x" * 50, texts[4]]
        want = sorted((n, s, kept) for n, s, kept in brute_cut(every, depth))
        got = repeats.cut_repeats(df, depth).collect()
        assert sorted((sum(x.end - x.start for x in r.spans), len(r.spans), bytes(r.kept_bytes)) for r in got) == want
        assert "text" not in repeats.cut_repeats(df, depth).columns


def test_rows_without_id_keep_their_own_ranges(spark):
    rng = random.Random(4)
    passage, alone = "".join(rng.choices("abcdefgh ", k=260)), "".join(rng.choices("ijklmnop ", k=300))
    low = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) % (1 << 31)
    ends = {low(f"{passage}{i}"): f"{passage}{i}" for i in range(150_000)}
    other = next(t for i in range(10**6) if low(t := f"{alone}{i}") in ends)  # its hash agrees in 31 bits
    df = documents(spark, [f"{passage} once more"], [(None, ends[low(other)]), (None, other)])
    got = {r.n_bytes: (bytes(r.kept_bytes), r.spans) for r in repeats.cut_repeats(df, depth=200).collect()}
    assert got[len(other)] == (other.encode(), []) and len(got[len(ends[low(other)])][1]) == 1


def test_characters_stay_whole(spark):
    texts = ["漢" + "abcdefghijklmnopqrst" + "é", "字" + "abcdefghijklmnopqrst" + "è"]
    got = repeats.cut_repeats(documents(spark, texts), 20, characters=True).collect()
    assert sorted(bytes(r.kept_bytes).decode() for r in got) == ["字è", "漢é"]
    assert repeats.cut_repeats(documents(spark, []), 20).count() == 0


def test_sliding_minimum_takes_the_leftmost():
    rng = np.random.default_rng(0)
    for n, width in ((50, 7), (64, 8), (9, 9), (30, 1)):
        h = rng.integers(0, 6, n).astype(np.uint64)
        want = [i + int(np.argmin(h[i : i + width])) for i in range(n - width + 1)]
        assert repeats._sliding_argmin(h, width).tolist() == want


# --- quality -------------------------------------------------------------------


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), failed


def brute_kept(text):
    """The rules once more, line by line, in plain Python."""
    phrases = [p for of_language in quality.BOILERPLATE.values() for p in of_language]
    total = rest = 0
    for line in (text or "").split("\n"):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", line))
        many = lambda x: x >= 3 and x >= n * quality.SHARE
        closing = re.sub(r"[ \t\x0b\x0c\r]+$", "", line).rstrip("'\"”’»)]")
        fails = n >= quality.OPEN_WORDS and closing[-1:] not in tuple(".!?;:…。！？")
        fails |= many(sum(c in "|›»•·" for c in line)) or many(sum(c in "#*$%&<>" for c in line)) or many(line.count("!!"))
        fails |= n <= quality.BOILERPLATE_WORDS and any(p in line.lower() for p in phrases)
        total += n
        rest += 0 if fails else n
    return not brute_quality(text)[-1] and (total - rest) / total <= quality.LOSS


@pytest.mark.parametrize("place_bits", [26, 60, 5])
def test_quality_equals_brute_force(spark, place_bits, monkeypatch):
    # 60: windows share four bits of hash; 5: most texts are too long to be packed
    monkeypatch.setattr(quality, "_PLACE_BITS", place_bits)
    monkeypatch.setattr(quality, "_PLACE", (1 << place_bits) - 1)
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b", "cé", " ", " ", "\n", "\t", "#", "|", "\x0b"]) for _ in range(rng.randrange(0, 200))) for _ in range(100)]
    texts += [None, "", "   ", "a b c " * 300, "one two", "a b c", "x y x y x y", "\n\n", " a\na \na"]
    marks = [*["."] * 9, "!", "", ",", '."', " |", " ###", "!!", " › • |", "。", ") "]
    lines = lambda n: [" ".join(f"w{rng.randrange(300)}{rng.choice([*[''] * 30, '|', '%'])}" for _ in range(rng.randrange(1, 30))) + rng.choice(marks) for _ in range(n)]
    said = ["Alle Rechte vorbehalten.", "Cliquez ici !", "Sign up, log in. SUBSCRIBE!!", "Aviso legal »", "w1 w2 w3"]
    for _ in range(60):
        made = lines(rng.randrange(4, 14)) + rng.sample(said, 2)
        rng.shuffle(made)
        texts.append("\n".join(made))
    got = {r.doc_id: r for r in quality.assess(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t), t
        assert r.kept == brute_kept(t), t
    assert 20 < sum(r.kept for r in got.values()) < 60
    assert quality.assess(documents(spark, [])).count() == 0


def test_lines_are_cleaned_before_the_verdict(spark):
    prose = "\n".join(" ".join(f"w{i}x{j}" for j in range(9)) + "." for i in range(12))
    noise = "\n".join(" ".join(f"w{i}{j}###" for j in range(14)) for i in range(12))
    bars = " | ".join(f"item{i}" for i in range(80))
    got = {r.doc_id: r for r in quality.assess(documents(spark, [prose, noise, bars, prose + "\nAll rights reserved."])).collect()}
    assert got[0].kept and not got[1].kept and not got[2].kept
    assert got[3].kept and got[3].cleaned == prose


# --- sketches --------------------------------------------------------------------


def jaccard(a, b):
    a, b = set(a.tolist()), set(b.tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sketch_comparison_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [". ".join(random_texts(rng.randrange(0, 40), i)) for i in range(60)] + ["", None, "é. " * 500]
    got = {r.doc_id: r for r in sketches.compare_with_edit(documents(spark, texts).repartition(4)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, after = t or "", texts[i - 1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(jaccard(sketches.digests(t), sketches.digests(edited)))
        assert r.near_next == pytest.approx(jaccard(sketches.digests(t), sketches.digests(after)))
    assert got[60].fingerprint == got[61].fingerprint


def test_successors_with_ties_and_gaps(spark):
    rows = [(5, "a"), (5, "a"), (None, "n"), (9, "z"), (-3, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sketches.compare_with_edit(df).count() == 5
    assert sketches.compare_with_edit(df.limit(0)).count() == 0
    alone = sketches.compare_with_edit(df.filter("doc_id = 9")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


# --- edit-aware counts -------------------------------------------------------------


def test_counts_follow_edits(spark):
    library = Tokenizer.from_file(PATH)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rng = random.Random(6)
    texts = [" ".join(random_texts(1, i, 600)) for i in range(12)] + ["", None, "a" * 3000, "  x  \n\n " * 200, "<|endoftext|> a  <|endoftext|>"]
    rows, want = [], {}
    for i, t in enumerate(texts):
        edits, now = [], t or ""
        for _ in range(6):
            place, delete = rng.randrange(-2, len(now) + 5), rng.choice([0, 1, 30, 5000])
            insert = rng.choice(["", " ", "  ", "word ", "\n\n", " two words", None, "é" * 700, "x y " * 300])
            edits.append((place, delete, insert))
            at = max(0, min(place, len(now)))
            now = now[:at] + (insert or "") + now[max(at, min(place + delete, len(now))) :]
        rows.append((i, t, edits))
        want[i] = (count(t or ""), count(now), len(now))
    rows.append((99, "no edits", None))
    want[99] = (2, 2, 8)
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<place:int,delete:int,insert:string>>")
    got = {r.doc_id: (r.n_tokens, r.edited_tokens, r.edited_chars) for r in edit_counts.count_edits(df, PATH).collect()}
    assert got == want
    assert edit_counts.count_edits(df.limit(0), PATH).count() == 0


def test_small_edits_touch_few_characters():
    coder = lambda parts: [len(p) for p in parts]
    text = " ".join(["word"] * 20_000)
    leaves = edit_counts.leaves_of(text)
    tree = edit_counts.CountTree([len(x) for x in leaves], coder(leaves))
    changed, again = tree.edit(text, 50_000, 4, "changed", coder)
    assert tree.total == len(changed) and again < 2000


# --- language model ----------------------------------------------------------------


@pytest.mark.parametrize("chunk, ranges", [(10**6, 10**6), (300, 100)])
def test_scores_equal_brute_force(spark, monkeypatch, chunk, ranges):
    monkeypatch.setattr(ngram_lm, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(ngram_lm, "RANGE_TOKENS", ranges)
    texts = [*random_texts(80, 8, 60), "", None, "New Words\tONLY here", "ÉA éa", "again and again"]
    df = documents(spark, texts).drop("score").withColumn("n_tokens", F.lit("clash"))
    held = F.pmod("doc_id", F.lit(5)) == 0
    # a filter so roomy that no probe is wrong
    got = {r.doc_id: r for r in ngram_lm.score(df, held, bits_each=1000).collect()}
    tokens = [[*(t or "").encode().lower().split(), "end"] for t in texts]
    taught = [ws for i, ws in enumerate(tokens) if i % 5]
    counts = Counter(w for ws in taught for w in ws)
    pairs = Counter(p for ws in taught for p in zip(ws, ws[1:]))
    n, v = sum(counts.values()), len(counts)

    def seen(c):  # the middle of [2**k, 2**(k + 1))
        low = 1 << (c.bit_length() - 1) if c else 0
        return (low + max(low, 2 * low - 1)) / 2 if c else 0

    assert len(got) == len(texts)
    for i, ws in enumerate(tokens):
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        want = 0
        for before, w in zip([None, *ws], ws):
            p = (seen(counts[w]) + 0.1) / (n + 0.1 * (v + 1))
            if before is not None and counts[before]:
                p = 0.4 * min(1, seen(pairs[before, w]) / seen(counts[before])) + 0.6 * p
            want += math.log10(min(p, 1))
        assert got[i].score == pytest.approx(want)
        assert got[i].fp == "clash"


def test_scores_without_training_or_rows(spark):
    df = documents(spark, ["a b", None, "a b"]).drop("score")
    assert ngram_lm.score(df.limit(0), F.lit(False)).count() == 0
    untrained = ngram_lm.score(df, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in untrained) and len(untrained) == 3
    assert [r.n_known for r in ngram_lm.score(df, F.lit(None).cast("boolean")).orderBy("n_tokens").collect()] == [1, 3, 3]


def test_a_segment_never_loses_a_count():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 1 << 62, 5000).astype(np.uint64) * np.uint64(2)
    counts = np.concatenate([np.ones(3000, np.int64), rng.integers(2, 5000, 1000), np.zeros(1000, np.int64)])
    levels = ngram_lm.Segment(keys, counts).levels(keys)
    truth = ngram_lm.level(counts)
    assert (levels >= truth).all() and (levels > truth).mean() < 0.03
    assert truth.tolist() == [int(c).bit_length() for c in counts]


def test_seen_pairs_score_above_unseen_ones(spark):
    texts = [f"left{i} right{i}" for i in range(300)] + [f"left{i} right{(i + 1) % 300}" for i in range(300)]
    scores = {r.doc_id: r.score for r in ngram_lm.score(documents(spark, texts).drop("score"), F.col("doc_id") >= 300).collect()}
    assert sum(scores[i] > scores[300 + i] + 0.1 for i in range(300)) > 280


# --- toxicity --------------------------------------------------------------------


def test_toxic_words_are_learned_from_positives_alone(spark):
    rng = random.Random(1)
    texts = []
    for i in range(600):
        words = random_texts(1, i, 60)[0].split()
        if i % 3 == 0:
            words[len(words) // 2 : len(words) // 2] = rng.sample(["Vileword,", "nastyling", "nastyness", "(vileword)"], 2)
        texts.append(" ".join(words))
    df = documents(spark, texts, [(None, "vileword nastyness"), (0, texts[0])]).drop("score")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 600, 2)] + [(None, 1), (3, None), (4, 0), (4, 0)], "doc_id long, toxic int")
    trains = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    model = toxicity.fit(df, labels, trains)
    got = toxicity.score(df, model).toPandas()
    assert len(got) == 602 and got.score.between(0, 1).all()
    assert got[got.doc_id.isna()].score.iloc[0] > 0.7
    known = got.dropna(subset=["doc_id"])
    toxic = known.doc_id % 3 == 0
    held = known.doc_id.map(lambda i: zlib.crc32(str(int(i)).encode()) % 3 == 1)
    assert (known[held & toxic].score >= 0.7).mean() > 0.9 and (known[held & ~toxic].score >= 0.7).mean() < 0.05


def test_fit_lowers_the_non_negative_risk():
    rng = np.random.default_rng(8)
    x = (rng.random((240, 6)) < 0.3).astype(np.float32)
    positive = np.arange(240) < 60
    x[positive, 0] = rng.random(60) < 0.9
    prior = 0.2

    def risk(theta):
        """The non-negative estimator, sample by sample."""
        loss = lambda row, sign: math.log1p(math.exp(-sign * (row @ theta[:-1] + theta[-1])))
        right = prior * np.mean([loss(r, 1) for r in x[positive]])
        wrong = np.mean([loss(r, -1) for r in x[~positive]]) - prior * np.mean([loss(r, -1) for r in x[positive]])
        return right + max(0.0, wrong)

    weights, bias = toxicity.fit_nnpu(x, positive, prior, steps=600, rate=0.05, ridge=0.0)
    least = risk(np.append(weights, bias))
    assert least < risk(np.zeros(7)) - 0.05 and weights[0] > max(weights[1:])
    nearby = [least - risk(np.append(weights, bias) + step) for step in rng.normal(0, 0.05, (60, 7))]
    assert max(nearby) < 2e-3  # no step around leads further down


def test_toxicity_without_positives_or_rows(spark):
    df = documents(spark, ["a", "", None])
    none = toxicity.fit(df, spark.createDataFrame([(0, 0)], "doc_id long, toxic int"), F.lit(True))
    assert [r.tox < 1e-9 for r in toxicity.score(df, none, out="tox").collect()] == [True] * 3
    assert toxicity.score(df.limit(0), none).count() == 0


# --- mixing ----------------------------------------------------------------------


def test_mixture_meets_its_targets(spark):
    texts = ["A plain sentence, with words and stops. " * (5 + i % 9) if i % 3 else "w### x*** y$$$ z%%% " * (5 + i % 9) for i in range(400)]
    df = documents(spark, [*texts, None, ""]).drop("score")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 400, 2)] + [(1, None), (None, 1), (9999, 1)], "doc_id long, quality int")
    got = mixing.mix(df, labels, {"0": 0.1, "1": 0.9}).toPandas()
    assert len(got) == 402 and got.rate.between(0, 1).all()
    share = np.stack(got.p)
    totals = [(got.rate * got.tokens * share[:, k]).sum() for k in (0, 1)]
    assert totals[0] / sum(totals) == pytest.approx(0.1, abs=0.002)
    clean = got[(got.doc_id < 400) & (got.doc_id % 3 > 0)]
    assert (clean.copies == 1).all()
    noisy = got[(got.doc_id < 400) & (got.doc_id % 3 == 0)]
    assert 0 < noisy.copies.mean() < 0.7


def test_scarce_domains_stay_whole(spark):
    texts = ["A plain sentence, with words and stops. " * 9] * 95 + ["w### x*** y$$$ z%%% " * 2] * 5
    labels = spark.createDataFrame([(i, int(i < 95)) for i in range(100)], "doc_id long, quality int")
    got = mixing.mix(documents(spark, texts), labels, {"0": 0.2, "1": 0.8}).collect()
    assert all(r.rate > 0.999 and r.copies == 1 for r in got)


def test_mixture_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert len(mixing.mix(documents(spark, ["a b", None]), labels, {"0": 0.5, "1": 0.5}).collect()) == 2
    assert mixing.mix(documents(spark, []), labels, {"0": 0.5, "1": 0.5}).count() == 0


@pytest.mark.parametrize("domains, blur", [(2, 0.4), (3, 1.0), (5, 50.0)])
def test_overlapping_domains_settle_at_the_least_squares(spark, domains, blur):
    rng = np.random.default_rng(domains)
    p = rng.dirichlet(np.full(domains, blur), 300)
    tokens = rng.integers(0, 2000, 300)
    wanted = np.arange(1, domains + 1) / sum(range(1, domains + 1))
    members = spark.createDataFrame([(int(t), [float(x) for x in row]) for t, row in zip(tokens, p)], "tokens long, p array<double>")
    mixture = mixing.Mixture([str(k) for k in range(domains)], {}, 1.0)
    mixing.settle(mixture, members, list(wanted))
    full = F.lit(1.0)
    rate = np.array([r[0] for r in members.select(mixture.taken(mixture.steps, full, full)["now"]).collect()])
    whole = tokens @ p
    target = np.minimum(whole, wanted * whole[-1] / wanted[-1])
    objective = lambda r: sum(((r * tokens) @ p - target) ** 2 / whole) / whole.sum()
    brute = np.ones(300)
    for _ in range(20_000):
        brute = np.clip(brute - p @ (((brute * tokens) @ p - target) / whole), 0, 1)
    assert ((rate >= 0) & (rate <= 1)).all()
    assert objective(rate) <= objective(brute) + 2 * mixing.GAP
    assert np.allclose(mixture.excess, ((rate * tokens) @ p - target) / whole, atol=1e-6)


def test_a_fit_without_an_end_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 1)
    members = spark.createDataFrame([(10, [0.9, 0.1]), (10, [0.4, 0.6])], "tokens long, p array<double>")
    with pytest.raises(RuntimeError, match="no mixture"):
        mixing.settle(mixing.Mixture(["0", "1"], {}, 1.0), members, [0.3, 0.7])


# --- pipeline --------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    prose = [". ".join(x.capitalize() for x in random_texts(30, 100 + i, 14)) + "." for i in range(60)]
    passage = " ".join(f"shared{i} passage" for i in range(60))
    rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate(prose)]
    rows += [(100 + i, prose[3], "en", "src1", len(prose[3])) for i in range(5)] + [(3, prose[3], "en", "src0", len(prose[3]))]
    rows += [(200 + i, f"{prose[40 + i]} {passage} tail{i} {prose[50 + i]}", "en", "src2", 0) for i in range(3)]
    rows += [(300 + i, f"{prose[20 + i]} vileword nastyword {prose[10 + i]}", "en", "src3", 0) for i in range(10)]
    rows += [(None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(40)] + [(300 + i, 1, 1) for i in range(10)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = P.documents(spark, str(tmp_path))
    stages = dict(P.STAGES)
    copies = stages["simhash_near_dedup"](spark, docs, str(tmp_path))
    kept = [r.doc_id for r in copies.collect()]
    assert copies.columns == docs.columns and kept.count(3) == 1 and not {100, 101, 102} & set(kept)
    cut = stages["suffix_array_dedup"](spark, copies, str(tmp_path)).collect()
    assert all("shared30 passage" not in (r.text or "") for r in cut) and len(cut) == len(kept)
    out = P.run(spark, str(tmp_path)).toPandas()
    assert out.round_trip.all() and not set(range(300, 310)) & set(out.doc_id.dropna()) and {0, 1, 2, 3} <= set(out.doc_id.dropna())
    # an extra column passes through four stages; an empty table through all five
    extra = docs.limit(5).withColumn("copies", F.lit("clash")).withColumn("p", F.lit(1.0))
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, extra, str(tmp_path)).columns == extra.columns, name
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert isinstance(out, pd.DataFrame) and out.n_tokens.map(lambda n: n >= 0).all()
