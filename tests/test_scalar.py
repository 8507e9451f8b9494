from pyspark.sql import functions as F

from opinara.functions import scalar as s
from opinara.operators import places


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


def test_clip_keeps_null(spark):
    assert [one(spark, s.clip, v, "double") for v in (None, -5.0, 0.3, 9.0)] == [None, -2.0, 0.3, 2.0]


def test_likert(spark):
    assert [one(spark, s.likert, v, "int") for v in (1, 2, 3, 10, -1, -2, 4, None)] == [1, 1, 2, 5, None, None, 2, None]
    assert one(spark, lambda c: s.likert(c, reverse=True), 10, "int") == 1
    assert one(spark, lambda c: s.recode(c, {1: 1, 2: 5, 3: 3}), 2, "int") == 5
    assert [one(spark, s.half_up, v, "double") for v in (1.5, 2.49, 2.5)] == [2, 2, 3]


def test_answers(spark):
    got = [one(spark, s.label_answer, v) for v in ("-2", "label: -2\nbecause", "Skip this", "2.", "none")]
    assert got == [-2, -2, -99, 2, None]
    chinese = {"无关": -99, "无关内容": -99, "答案:1": 1, "1": 1, "态度是-2": -2, "中立": 0, "我选“２”": 2, "答案为１": 1, "没有": None, "选择：不知道": None, "": None}
    assert {v: one(spark, s.label_answer_zh, v) for v in chinese} == chinese
    assert one(spark, s.label_answer_zh, None) is None
    stances = {"无关": (-99, -99), "非常支持": (1, 2), "非常不支持": (-1, -2), "支持": (1, 1), "不支持": (-1, -1), "中立": (0, 0)}
    assert {v: (one(spark, s.support_answer, v), one(spark, lambda c: s.support_answer(c, five=True), v)) for v in stances} == stances
    assert [one(spark, s.place_answer, v) for v in ("0", "class 1.", "It is 2", "10 or 20")] == [0, 1, 2, None]
    iso = lambda c: s.iso_answer(c, ["GB", "FR"])
    assert [one(spark, iso, v) for v in ("UK", "fr", "zz", "?")] == ["GB", "FR", "unknown", "unknown"]


def test_names_and_paths(spark):
    named = lambda c: s.lookup(c, {"a": "first", "b": "second"})
    assert [one(spark, named, v) for v in ("a", "b", "c", None)] == ["first", "second", None, None]
    assert one(spark, lambda c: s.lookup(c, {}), "a") is None
    dated = lambda c: s.dated_path(c, F.to_date(F.lit("2020-01-02")))
    assert [one(spark, dated, v) for v in ("a/b.csv", "b.csv", "/x/y/b", None)] == ["a/20200102_b.csv", "20200102_b.csv", "/x/y/20200102_b", None]


def test_place_cascades(spark):
    cases = [
        ("Springfield, TX", "us", "non_eu", "unknown"), ("Paris", "non_us", "eu", "FR"), ("lol nowhere", "not_sure", "non_eu", "unknown"), ("Madrid ES", "undecided", "eu", "ES"), ("Berlin town", "non_us", "eu", "DE"),
        ("🇫🇷", "non_us", "undecided", "FR"), ("", "undecided", "undecided", "unknown"), ("Texas", "us", "non_eu", "unknown"), ("London UK", "non_us", "undecided", "GB"), (None, "undecided", "undecided", "unknown"),
    ]
    x = F.col("place")
    home = places.home_or_abroad(x, ["lol"], ["texas", "michigan"], ["springfield"], ["paris", "berlin", "london"], ["🇫🇷"], ["TX"])
    union = places.union_or_not(x, ["lol"], ["paris", "berlin"], ["ES", "FR"], ["texas", "michigan", "springfield"])
    country = places.country_of(x, {"🇫🇷": "FR"}, {"uk": "GB"}, {"paris": "FR", "berlin": "DE"}, ["ES", "DE"])
    got = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, place string").select("i", "place", home, union, country).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == cases


def test_texts(spark):
    assert one(spark, s.own_words, "mine//@x: theirs") == "mine"
    assert one(spark, s.clean_post, '"RT Hello. see https://a.b/c"') == "Hello see"
    assert one(spark, s.normalize_place, " New-York,  NY 10001 ") == "new york ny"
    assert one(spark, lambda c: s.has_any_word(c, ["ig"]), "Michigan") is False
    assert one(spark, lambda c: s.ngrams(F.split(c, " "), 2), "a b c") == ["a b", "b c"]
    assert one(spark, lambda c: s.fragment_of_longer(c, F.array(F.lit("climate change"), F.lit("tax"))), "climate") is True


def test_vectors_and_intervals(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], 0.5, 28), ([0.0, 0.0], [1.0, 1.0], 1.0, 3)], "a array<double>, b array<double>, r double, n int")
    lo, hi = s.fisher_interval(F.col("r"), F.col("n"))
    rows = df.select(F.round(s.cosine(F.col("a"), F.col("b")), 6).alias("c"), F.round(lo, 3).alias("lo"), F.round(hi, 3).alias("hi")).collect()
    assert [tuple(r) for r in rows] == [(0.707107, 0.156, 0.736), (None, None, None)]
