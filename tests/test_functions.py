"""Text functions against plain vectors."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from scholia.functions import text as X
from scholia.operators import doses, search


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_tokens_of_mixed_text(spark):
    assert one(spark, X.search_tokens(F.col("t")), t="桂枝汤 ABC-12 é 术") == ["桂枝", "枝汤", "abc", "12", "术"]
    assert one(spark, X.search_tokens(F.col("t")), t="") == []


def test_normalising(spark):
    assert one(spark, X.normalize(F.col("t")), t=" ＡＢ１ ") == "ab1"
    assert one(spark, X.normalize_space(F.col("t")), t="\ufeffa\u3000 b\t\tc ") == "a b c"
    assert one(spark, X.normalize_space(F.col("t")), t="cafe\u0301") == "caf\u00e9"


#: Normal form, phrases and search tokens of mixed texts, worked out by hand.
CASES = [
    ("", "", [], []),
    ("abc xyz", "abc xyz", ["abc", "xyz"], ["abc", "xyz"]),
    ("头痛，发热; 头痛\n咳嗽", "头痛,发热; 头痛\n咳嗽", ["头痛", "发热", "咳嗽"], ["头痛", "发热", "头痛", "咳嗽"]),
    ("ＦＥＶＥＲ！头痛？", "fever!头痛?", ["fever", "头痛"], ["fever", "头痛"]),
    ("脉：弦/数|滑", "脉:弦/数|滑", ["脉", "弦", "数", "滑"], ["脉", "弦", "数", "滑"]),
    ("食少便溏", "食少便溏", ["食少便溏"], ["食少", "少便", "便溏"]),
    ("术", "术", ["术"], ["术"]),
    ("ABC-12", "abc-12", ["abc-12"], ["abc", "12"]),
    ("  外　寒\t内热  ", "外 寒\t内热", ["外", "寒", "内热"], ["外", "寒", "内热"]),
    ("①证。②证", "1证。2证", ["1证", "2证"], ["1", "证", "2", "证"]),
    ("ﬁne", "fine", ["fine"], ["fine"]),
    ("Ⅳ期", "iv期", ["iv期"], ["iv", "期"]),
    ("ｶﾞ", "ガ", ["ガ"], []),
    ("café", "café", ["café"], ["caf"]),
    ("cafe\u0301", "café", ["café"], ["caf"]),
    ("a、b、a", "a、b、a", ["a", "b"], ["a", "b", "a"]),
    ("１２３４５", "12345", ["12345"], ["12345"]),
    ("气；血；；津", "气;血;;津", ["气", "血", "津"], ["气", "血", "津"]),
    ("。。。", "。。。", [], []),
    ("\u00a0x\u2003y\u00a0", "x y", ["x", "y"], ["x", "y"]),
    ("头痛fever头痛", "头痛fever头痛", ["头痛fever头痛"], ["头痛", "fever", "头痛"]),
    ("㎎", "mg", ["mg"], ["mg"]),
    ("A.B", "a.b", ["a", "b"], ["a", "b"]),
    ("½", "1⁄2", ["1⁄2"], ["1", "2"]),
    ("Ｑ：何证？", "q:何证?", ["q", "何证"], ["q", "何证"]),
]


def test_normal_form_phrases_and_tokens(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    t = F.col("t")
    got = {r.i: (r.n, r.p, r.k) for r in df.select("i", X.normalize(t).alias("n"), X.split_phrases(t).alias("p"), X.search_tokens(t).alias("k")).collect()}
    assert got == {i: tuple(c[1:]) for i, c in enumerate(CASES)}
    assert spark.sql("select cast(null as string) t").select(X.normalize(t).alias("n"), X.split_phrases(t).alias("p"), X.search_tokens(t).alias("k")).first() == ("", [], [])


def test_similarity(spark):
    vectors = [
        ("桂枝汤", "用桂枝汤主之", 1.0), ("桂枝汤", "桂枝", 0.5), ("", "x", 0.0), ("x", "", 0.0), ("头痛 fever", "头痛", 0.5), ("头痛fever", "发热fever", 0.5), ("...", "a", 0.0),
        ("é", "café", 1.0), ("abc def", "def abc", 1.0), ("食少便溏", "少便", 1 / 3), ("术", "白术", 1.0), ("ab ab cd", "xcdx", 0.5),
    ]
    df = spark.createDataFrame(vectors, "p string, t string, want double")
    got = df.select("p", "t", "want", X.phrase_similarity(F.col("p"), F.col("t")).alias("s")).collect()
    assert [(r.p, r.t, r.s) for r in got if abs(r.s - r.want) > 1e-12] == []
    # the same by way of what phrases and texts share
    texts = df.select(F.col("t").alias("id"), F.col("t").alias("text")).distinct()
    found = {(r.phrase, r.id): r.similarity for r in search.similarities(texts, df.select(F.col("p").alias("phrase"))).collect()}
    assert all(abs(found.get((p, t), 0.0) - want) < 1e-12 for p, t, want in vectors)


def test_holding_equals_contains(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab头痛 😀") for _ in range(n))
    texts = [(i, word(rng.randint(0, 30))) for i in range(60)] + [(60, "a" * 50), (61, "a" * 50)]
    phrases = sorted({word(rng.randint(1, 5)) for _ in range(60)} | {"a" * 40, "", "zz"})
    got = search.holding(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string")).collect()
    assert sorted((r.phrase, r.id) for r in got) == sorted((p, i) for p in phrases for i, t in texts if p and p in t)
    empty = search.holding(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([("",)], "phrase string"))
    assert empty.count() == 0


def test_digit_repairs(spark):
    found = one(spark, X.digit_repairs(F.col("t")), t="1234")
    assert "01234" in found and "12345" in found and all(len(x) == 5 for x in found)
    assert "12345" in one(spark, X.digit_repairs(F.col("t")), t="123456")
    assert one(spark, X.digit_repairs(F.col("t")), t="12") == []
    assert one(spark, X.repair_id(F.col("t"), X.INDEX_REPAIR), t="OoIlQBS") == "0011085"


def test_wrapped_lines(spark):
    lines = F.array(F.lit("well"), F.lit("known"), F.lit("桂枝"), F.lit("semi-"), F.lit("colon"))
    assert one(spark, X.join_wrapped(lines)) == "well known桂枝semi-colon"


def test_chunks_lose_nothing(spark):
    pieces = one(spark, X.chunks(F.col("t"), 4), t="abcdefghij")
    assert pieces == ["abcd", "efgh", "ij"]
    assert one(spark, X.chunks(F.col("t"), 4), t="") == []


def test_outline_marks(spark):
    marks = one(spark, X.annotations(F.col("t")), t="1.1 心慌（焦虑4级之一）(抑郁2级定性)")
    assert [tuple(m) for m in marks] == [("焦虑", 4, "之一"), ("抑郁", 2, "定性")]
    assert [one(spark, X.outline_level(F.col("t")), t=t) for t in ("一、总则", "1.1 a", "1.1.1 b", "正文")] == [0, 1, 2, None]
    assert one(spark, X.options(F.col("t")), t="是（ ） 否( )") == ["是", "否"]


def test_ratio(spark):
    df = spark.createDataFrame([("桂枝汤", "桂技汤"), (None, "x")], "a string, b string")
    assert [r.x for r in df.select(X.ratio("a", "b").alias("x")).collect()] == [2 / 3, None]


HERBS = ["桂枝", "芍药", "甘草", "麻黄", "杏仁", "黄芩", "黄连", "半夏", "生地", "生地黄", "当归", "陈皮", "茯苓", "人参", "白茯苓", "白术", "大枣", "生姜"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("桂枝三两，芍药三两，甘草二两", [("桂枝", "三两"), ("芍药", "三两"), ("甘草", "二两")]),
        ("麻黄、杏仁各十五克", [("麻黄", "十五克"), ("杏仁", "十五克")]),
        ("黄芩，黄连等分", [("黄芩", "等分"), ("黄连", "等分")]),
        ("人参（切去顶）白茯苓（去皮）白术甘草等分", [("人参", "等分"), ("白茯苓", "等分"), ("白术", "等分"), ("甘草", "等分")]),
        ("半夏半升（洗）", []),
        ("半夏（洗）半升", [("半夏", "半升")]),
        ("桂枝三两半夏半升", [("桂枝", "三两"), ("半夏", "半升")]),
        ("陈皮一钱半夏一钱五分茯苓一钱", [("陈皮", "一钱"), ("半夏", "一钱五分"), ("茯苓", "一钱")]),
        ("桂枝一两半", [("桂枝", "一两半")]),
        ("甘草，生地黄三钱二分，当归各二两", [("甘草", ""), ("生地黄", "三钱二分"), ("当归", "二两")]),
        ("桂枝三两二钱", []),
        ("生地当归", [("生地", ""), ("当归", "")]),
        ("大枣三枚生姜二片", [("大枣", "三枚"), ("生姜", "二片")]),
        ("杏仁三铢", [("杏仁", "三铢")]),
        ("桂枝一二两", []),
        ("随便什么文字", []),
        ("桂枝零两", []),
        ("桂枝各", []),
        ("桂枝（去皮", []),
        ("", []),
        (None, []),
    ],
)
def test_doses(text, want):
    assert [(token.herb, dose) for token, (dose, _) in doses.read(doses.Lexer(HERBS), text)] == want


def test_dose_amounts():
    read = lambda t: [(str(a), u) for _, (_, quantities) in doses.read(doses.Lexer(HERBS), t) for a, u in quantities]
    assert read("桂枝一两半") == [("1.5", "两")] and read("桂枝500MG") == [("500", "mg")] and read("桂枝三钱二分") == [("3", "钱"), ("2", "分")]
    assert doses.numeral("二十五") == 25 and doses.numeral("一百") == 100 and doses.numeral("千二百") == 1200 and doses.numeral("半") == Decimal("0.5")
