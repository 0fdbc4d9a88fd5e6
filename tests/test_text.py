import html
import re
import time
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from revlake.functions import clean, coerce, codec, sentiment, tokens


def apply(spark, expr, values, kind="string"):
    """Results of a column expression over the values, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r.r for r in df.select("i", expr(F.col("v")).alias("r")).orderBy("i").collect()]


def test_coerce(spark):
    got = apply(spark, coerce.coerce_int, ["5", " 5 ", "5.0", "x", "", None, "-3", "99999999999"])
    assert got == [5, 5, None, None, None, None, -3, None]
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    values = ["2024-02-14 10:11:23", "2024-2-4 1:2:3", "2024-02-14 10:11", "2024-02-30 10:11:12", "bad", "", None]
    seconds = apply(spark, lambda c: show(coerce.parse_seconds_time(c)), values)
    assert seconds == ["2024-02-14 10:11:23", "2024-02-04 01:02:03", None, None, None, None, None]
    minutes = apply(spark, lambda c: show(coerce.parse_minutes_time(c)), values)
    assert minutes[2] == "2024-02-14 10:11:00" and minutes[:2] == seconds[:2]
    assert apply(spark, coerce.strip_text, ["　 a b\t\n", None, "\x1cx\x1f"]) == ["a b", "", "x"]


def test_times_do_not_depend_on_the_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:  # this local time does not exist there
        got = apply(
            spark, lambda c: coerce.parse_seconds_time(c).cast("string"), ["2024-03-10 02:30:00"]
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["2024-03-10 02:30:00"]


def test_clean_goldens(spark):
    cases = {
        "<p>手机<br>非常好 https://example.com   很满意！！！！！</p>": "手机 非常好 很满意!!",
        "": "",
        None: "",
        "a &amp;lt;b&gt; &copy 3": "a <b> © 3",
        "<a title='x>y' data-x=1>k</a><SCRIPT>var t='</p>';</SCRIPT>z<!-- <b>q</b> --> ｆ　ｏ": "k z f o",
        "5 < 6 and 7 > 2": "5 < 6 and 7 > 2",
        "看http://a.cn/好 吧": "看 吧",
    }
    assert apply(spark, clean.clean_review_text, list(cases)) == list(cases.values())
    got = apply(spark, clean.normalize, ["a!!!!b。。。c d??", "！？，；：。"])
    assert got == ["a!!b。。c d??", "!?,;:。"]


def plain_normalize(text):
    text = unicodedata.normalize("NFKC", text)
    text = re.sub(r"https?://\S+", "", text)
    text = re.sub(r"([!?。！？])\1{2,}", r"\1\1", text)
    return re.sub(r"\s+", " ", text).strip()


TEXT = st.text(
    alphabet=st.sampled_from("ab好!?。！？ \t\n　  ｆ１①ﬁ<>&;:/.https\x1c"), max_size=40
)


@settings(max_examples=5, deadline=None)
@given(st.lists(TEXT, min_size=60, max_size=60))
def test_normalize_equals_plain_python(spark, texts):
    assert apply(spark, clean.normalize, texts) == [plain_normalize(t) for t in texts]


@settings(max_examples=3, deadline=None)
@given(st.lists(TEXT, min_size=60, max_size=60))
def test_clean_is_idempotent_without_markup(spark, texts):
    bare = [re.sub("[<>&]", "", t) for t in texts]
    once = apply(spark, clean.clean_review_text, bare)
    stable = [t for t in once if plain_normalize(t) == t]
    assert apply(spark, clean.clean_review_text, stable) == stable


def test_entities_equal_the_standard_library(spark):
    texts = [f"x&{name}y" for name in sorted(html.entities.html5)[:400]] + ["&#20320;&#x597d;", "&amp;amp;"]
    texts = [t for t in texts if "<" not in html.unescape(t)]
    want = [html.unescape(html.unescape(t)) for t in texts]
    assert apply(spark, clean.strip_html, texts) == want


def test_tokenize(spark):
    words = ("手机", "屏幕", "非常", "非常好")
    got = apply(spark, lambda c: tokens.tokenize(c, terms=words), ["这个 手机的屏幕,非常好 abc1 3.5", "", None])
    assert got == [
        ["这", "个", "手机", "的", "屏幕", ",", "非常好", "abc1", "3", ".", "5"], [], [],
    ]
    kept = apply(
        spark, lambda c: tokens.tokenize(c, terms=words, stopwords=["的", "abc1"]), ["手机的手机abc1 ABC1"]
    )
    assert kept == [["手机", "手机", "ABC1"]]


def test_term_counts_and_positions(spark):
    value = ["b", "a", "b", "c", "b", "a"]
    counts, spots, empty = apply(
        spark, tokens.term_counts, [value, [], ["x"]], "array<string>"
    )[0], apply(spark, tokens.term_positions, [value], "array<string>")[0], apply(
        spark, tokens.term_counts, [[]], "array<string>"
    )[0]
    assert [tuple(x) for x in counts] == [("a", 2), ("b", 3), ("c", 1)]
    assert [(x.term, x["at"]) for x in spots] == [("a", [1, 5]), ("b", [0, 2, 4]), ("c", [3])]
    assert empty == []


def test_term_counts_take_a_missing_token_as_a_term(spark):
    lists = [[None, "b", None, "a", "b"], None, [], ["é", "z", "é"]]
    counted = apply(spark, tokens.term_counts, lists, "array<string>")
    assert [None if c is None else sorted((x.term or "", x.n) for x in c) for c in counted] == [
        [("", 2), ("a", 1), ("b", 2)], None, [], [("z", 1), ("é", 2)],
    ]


def test_list_codec(spark):
    df = spark.createDataFrame([(["好", 'a"b\\'], ["k"])], "tokens array<string>, keywords array<string>")
    coded = codec.encode_lists(df)
    assert coded.first().tokens == '["好","a\\"b\\\\"]'
    assert codec.decode_lists(coded).first() == df.first()
    assert apply(spark, codec.decode_list, ["", None]) == [[], []]


# -- sentiment ----------------------------------------------------------------


def plain_score(text, rating, lexicon=sentiment.SHIPPED):
    hits = sum(text.count(t) for t in lexicon.positive) - sum(text.count(t) for t in lexicon.negative)
    if any(t in text for t in lexicon.negation):
        hits *= 0.5
    score = hits / max(len(text) / 20, 1.0)
    if rating is not None:
        score = 0.5 * score + 0.5 * (rating - 3) / 2
    return max(-1.0, min(1.0, score))


def scored(spark, cases, lexicon=sentiment.SHIPPED):
    rows = [(i, t, r) for i, (t, r) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, t string, r int")
    out = df.select("i", sentiment.rule_sentiment(F.col("t"), F.col("r"), lexicon).alias("s"))
    return [(r.s.label, r.s.score) for r in out.orderBy("i").collect()]


def test_sentiment_goldens(spark):
    cases = [
        (("手机非常好，屏幕清晰，推荐购买！", 5), ("positive", 1.0)),
        (("质量很差，完全是垃圾，后悔购买", 1), ("negative", -1.0)),
        (("还行吧，没什么特别的", 3), ("neutral", 0.0)),
        (("", 5), ("positive", 0.5)),
        (("", 0), ("negative", -0.75)),
        (("", None), ("neutral", 0.0)),
        (("不好", None), ("neutral", 0.0)),
    ]
    assert scored(spark, [c for c, _ in cases]) == [w for _, w in cases]


@settings(max_examples=3, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.text(alphabet="好很不错差太非常满意退货没a，", max_size=60),
            st.one_of(st.none(), st.integers(0, 6)),
        ),
        min_size=50, max_size=50,
    )
)
def test_sentiment_equals_plain_python(spark, cases):
    for (label, score), (text, rating) in zip(scored(spark, cases), cases):
        assert score == pytest.approx(plain_score(text, rating), abs=1e-12)
        assert -1 <= score <= 1
        assert label == ("positive" if score > 0.15 else "negative" if score < -0.15 else "neutral")


def test_overlapping_terms_count_like_str_count(spark):
    lexicon = sentiment.Lexicon(positive=("aa", "aba", "a"), negative=("b",), negation=())
    texts = ["aaaaa", "ababa", "b", ""]
    got = apply(spark, lambda c: sentiment.lexicon_hits(c, lexicon), texts)
    assert got == [t.count("aa") + t.count("aba") + t.count("a") - t.count("b") for t in texts]


def test_model_output_mapping(spark):
    rows = [
        ("ok", "LABEL_1", 0.9), ("ok", "positive", 0.9), ("ok", "POS", 0.7), ("ok", "1", 0.6),
        ("ok", "0", 0.8), ("ok", "Negative", 0.5), (" 　", "positive", 0.9), (None, "1", 0.9),
    ]
    df = spark.createDataFrame(rows, "t string, l string, p double")
    out = df.select(sentiment.map_model_output(F.col("t"), F.col("l"), F.col("p")).alias("s"))
    assert [(r.s.label, r.s.score) for r in out.collect()] == [
        ("neutral", 0.0), ("positive", 0.9), ("positive", 0.7), ("positive", 0.6),
        ("negative", -0.8), ("negative", -0.5), ("neutral", 0.0), ("neutral", 0.0),
    ]


def test_cleaning_is_linear_and_lets_filters_pass(spark, tmp_path):
    for scrap in ("<!--", "<script>", "<a ", '<a href="', "</a "):
        long = spark.createDataFrame([(scrap * 100_000,)], "t string")
        start = time.monotonic()
        long.select(clean.clean_review_text(F.col("t")).alias("c")).collect()
        assert time.monotonic() - start < 20  # minutes, were it quadratic
    spark.range(10).select("id", F.lit("<b>x</b> &amp; ｙ").alias("t")).write.parquet(str(tmp_path / "t"))
    cleaned = spark.read.parquet(str(tmp_path / "t")).select("id", clean.clean_review_text(F.col("t")).alias("c")).filter("id = 3")
    assert [tuple(r) for r in cleaned.collect()] == [(3, "x & y")]
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Filter")


def test_texts_cross_to_python_a_few_at_a_time(spark):
    """Of an Arrow batch only a slice is held as Python strings; order and nulls stay."""
    held = []

    def change(text):
        held.append(text)
        return text.upper()

    texts = pa.array([None if i % 5 == 0 else f"t{i}" for i in range(3 * clean.SLICE + 7)])
    out = clean._text_udf(change).func(texts)
    assert out.to_pylist() == [t and t.upper() for t in texts.to_pylist()]
    assert len(held) == len(texts) - texts.null_count
    assert clean._text_udf(change).func(pa.array([], pa.string())).to_pylist() == []
