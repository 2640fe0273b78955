"""Column functions on literal rows, one test per semantic trap."""

from pyspark.sql import functions as F

from postlens.functions import emoji as E
from postlens.functions import text as T
from postlens.functions.calendar import CALENDAR_WEEKEND_DAYS, is_weekend
from postlens.functions.flags import clean_bool_string, normalise_flag
from postlens.functions.lexicons import NEGATIVE_SYMBOLS, POSITIVE_SYMBOLS, STOP_WORDS_EN
from postlens.operators.cleaning import band_by_quantiles, binary_by_threshold
from postlens.operators.sentiment import overall_sentiment, sentiment_label


def col_values(spark, rows, schema, expr):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr.alias("o")).collect()]


def test_fixed_tables(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert list(STOP_WORDS_EN) == StopWordsRemover.loadDefaultStopWords("english")
    assert len(POSITIVE_SYMBOLS) == 141 and len(set(POSITIVE_SYMBOLS)) == 140
    assert len(NEGATIVE_SYMBOLS) == 38
    assert "((:d:" in POSITIVE_SYMBOLS and ":-)" not in POSITIVE_SYMBOLS


def test_normalise_flag(spark):  # Q1: string-only comparison, unknown -> null
    vals = ["True", "1.0", "False", "0.0", "Not found", None, "x", "1"]
    got = col_values(spark, [(v,) for v in vals], "v string", normalise_flag("v"))
    assert got == [1, 1, 0, 0, 0, 0, None, 1]


def test_clean_bool_string(spark):
    got = col_values(spark, [("True\r",), ("False\r",), ("True",), (None,)], "v string",
                     clean_bool_string("v"))
    assert got == [1, 0, 1, None]


def test_weekend_days(spark):  # Q2: default weekend is Friday + Saturday
    rows = [(d,) for d in range(1, 8)] + [(None,)]
    assert col_values(spark, rows, "d int", is_weekend("d")) == [0.0] * 5 + [1.0, 1.0, None]
    cal = col_values(spark, rows, "d int", is_weekend("d", CALENDAR_WEEKEND_DAYS))
    assert cal == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, None]


def test_null_text(spark):  # Q8
    df = spark.createDataFrame([(None,)], "t string")
    r = df.select(T.count_mentions("t").alias("m"), T.tokenize("t").alias("tok"),
                  T.has_hashtag("t").alias("h"), E.emoji_sentiment("t").alias("s")).first()
    assert (r.m, r.tok, r.h, r.s) == (0, [], 0, 0)


def test_emoji_extract_counts_first(spark):  # M4-M6, Q3-Q5
    text = "a😍❤😍 it's | b"
    df = spark.createDataFrame([(text,), ("😍❤😍❤",), ("none",)], "t string")
    out = df.select(E.extract_emojis("t").alias("e")).select(
        "e", E.emoji_count_map("e").alias("m"), E.first_emoji("e").alias("f")).collect()
    assert out[0].e == ["😍", "❤", "😍"] and out[0].m == {"😍": 2, "❤": 1} and out[0].f == "😍"
    assert out[1].m == {"😍": 2, "❤": 2}  # counts are per key
    assert out[2].e == [] and out[2].f is None


def test_emoji_sentiment_substring_and_token(spark):  # Q6
    texts = ["10:30", "https://a.b", ":-)", "<3", "expect", "😭 but ❤", "so sad 😭"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    sub = [r[0] for r in df.select(E.emoji_sentiment("t")).collect()]
    assert sub == [1, -1, 0, 1, 1, 1, -1]
    tok = [r[0] for r in df.select(E.emoji_sentiment("t", mode="token")).collect()]
    assert tok == [0, 0, 0, 1, 0, 1, -1]


def test_sentiment_label_and_overall(spark):  # Q7
    got = col_values(spark, [(0.1,), (-0.1,), (None,), (0.2,), (-0.2,)], "p double", sentiment_label("p"))
    assert got == [0, 0, 0, 1, -1]
    df = spark.createDataFrame([(1, -1), (-1, 1), (0, 1), (0, -1), (0, 0)], "e int, l int")
    assert [r[0] for r in df.select(overall_sentiment("e", "l")).collect()] == [1, -1, 1, -1, 0]


def test_tokenize_and_stopwords(spark):  # Q18, Q19
    df = spark.createDataFrame([("Dont café The é naïve I im",)], "t string")
    r = df.select(T.tokenize("t").alias("a")).select("a", T.remove_stopwords("a").alias("b")).first()
    assert r.a == ["dont", "caf", "the", "na", "ve", "i", "im"]
    assert r.b == ["dont", "caf", "na", "ve", "im"]
    u = df.select(T.tokenize("t", unicode=True)).first()[0]
    assert u == ["dont", "café", "the", "é", "naïve", "i", "im"]


def test_strip_punct_digits_mentions(spark):
    df = spark.createDataFrame([("don't 42 stop… é 😍", "a@b.com @x #tag")], "t string, m string")
    r = df.select(T.clean_text("t").alias("c"), T.count_mentions("m").alias("n"),
                  T.has_hashtag("m").alias("h")).first()
    assert r.c == "dont  stop… é 😍" and r.n == 2 and r.h == 1


def test_lemmatise_and_stems(spark):
    df = spark.createDataFrame([(["was", "went", "th", "going", "dance", "was", "rd"],)], "w array<string>")
    assert df.select(T.lemmatise("w")).first()[0] == ["be", "dance", "go"]
    s = spark.createDataFrame([(["caresses", "ponies", "cats", "agreed", "playing", "happy", "at", "sing"],)],
                              "w array<string>")
    assert s.select(T.stem_tokens("w")).first()[0] == ["caress", "poni", "cat", "agree", "play", "happi", "sing"]


def test_bands_and_binary(spark):  # C4, C5, Q10
    rows = [(1,), (5,), (9,), (None,)]
    assert col_values(spark, rows, "x int", band_by_quantiles("x", [3, 7])) == ["low", "medium", "high", None]
    got = col_values(spark, [(0.5,), (0.1,), (None,)], "x double", binary_by_threshold("x", 0.2))
    assert got == ["high", "low", "low"]
    kept = col_values(spark, [(0.5,), (0.1,), (None,)], "x double", binary_by_threshold("x", 0.2, null_as=None))
    assert kept == ["high", "low", None]


def test_emoji_regex_same_in_duckdb():
    import duckdb
    from postlens.plans import sqlgen as S
    r = duckdb.connect().execute(f"SELECT {S.emojis(S.q('a😍❤😍 it''s 🤩 | b'))}").fetchone()[0]
    assert r == ["😍", "❤", "😍"]  # U+1F929 is outside the ranges
