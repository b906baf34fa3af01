import datetime
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.functions import fingerprint, meta, score
from sparkloom.functions import text as T
from sparkloom.operators import postings as post

TEXTS = ["", "a", "Hello  World\nFoo", "  x ", "the the the", "été à  la　plage", "ΣΑΣ 日本語テキスト", "a\x85b\xa0c d", "one two", "a b c d e f g", "ab" * 40]
FOX = "the quick brown fox jumps over the lazy dog and runs through the green forest every day"


def model_norm(t):
    return " ".join(T.split_words(t.lower()))


def model_trigrams(t):
    b = t.encode()
    return [b[i : i + 3] for i in range(len(b) - 2)]


def model_simhash(t):
    w = T.split_words(t.lower())
    shingles = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)] if len(w) >= 3 else w
    hashes = [xxhash.xxh64_intdigest(s.encode()) for s in shingles]
    out = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))
    return out - (1 << 64) * (out >> 63)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    more = ["".join(rng.choice("abcé ß日\n\t.") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS + more)], "i int, t string").cache()


def of(frame, **columns):
    return {r["t"]: r for r in frame.select("t", *[c.alias(n) for n, c in columns.items()]).collect()}


def test_normalise_words_trigrams(texts):
    found = of(texts, norm=T.normalize(F.col("t")), w=T.words(F.col("t")), g=T.trigrams(T.utf8(F.col("t"))), d=T.distinct_trigrams(T.utf8(F.col("t"))))
    for t, r in found.items():
        assert r["norm"] == model_norm(t)
        assert r["w"] == T.split_words(t.lower())
        assert [bytes(x) for x in r["g"]] == model_trigrams(t)
        assert [bytes(x) for x in r["d"]] == list(dict.fromkeys(model_trigrams(t)))


def test_xxh64_has_seed_zero(texts):
    for t, r in of(texts, h=fingerprint.xxh64(F.col("t"))).items():
        assert r["h"] % (1 << 64) == xxhash.xxh64_intdigest(t.encode())


def test_simhash_equals_an_independent_model(texts):
    for t, r in of(texts, h=fingerprint.simhash(F.col("t"))).items():
        assert r["h"] == model_simhash(t)


def test_simhash_distances(spark):
    near, far = FOX.replace("jumps", "leaps"), "quarterly earnings rose by ten percent as revenue grew in all regions despite higher costs"
    rows = spark.createDataFrame([(FOX, near, far)], "a string, b string, c string").select(*[fingerprint.simhash(F.col(c)).alias(c) for c in "abc"])
    r = rows.select(fingerprint.hamming(F.col("a"), F.col("a")).alias("self"), fingerprint.hamming(F.col("a"), F.col("b")).alias("near"), fingerprint.hamming(F.col("a"), F.col("c")).alias("far")).first()
    assert r["self"] == 0 and r["near"] < r["far"] and r["far"] > 15


def test_bands(spark):
    h = -0x123456789ABCDEF
    for n in (2, 3, 4, 8, 64):
        got = spark.createDataFrame([(h,)], "h long").select(fingerprint.bands(F.col("h"), n).alias("b")).first()["b"]
        width = 64 // n
        assert [(b["band"], b["value"]) for b in got] == [(i, (h % (1 << 64)) >> (i * width) & ((1 << width) - 1)) for i in range(n)]
    for n in (0, 1, 65):
        with pytest.raises(ValueError):
            fingerprint.bands(F.col("h"), n)


def test_overlap(spark):
    q, d = T.distinct_trigrams(F.encode(F.lit("helo"), "UTF-8")), T.distinct_trigrams(F.encode(F.lit("hello world"), "UTF-8"))
    assert spark.range(1).select(T.overlap(q, d).alias("o")).first()["o"] == 0.5


@pytest.mark.parametrize(
    "name, text, kind",
    [("contract.pdf", "", "contract"), ("release.txt", "", "lease"), ("calendar.md", "", "nda"), ("a.txt", "THIS AGREEMENT", "contract"), ("a.txt", "amount due", "invoice"), ("a.txt", "plain", None), ("Report.txt", "this agreement", "report"), ("a.txt", "executive summary of this agreement", "contract")],
)
def test_doc_type(spark, name, text, kind):
    assert spark.createDataFrame([(f"/x/{name}", text)], "p string, t string").select(meta.doc_type(F.col("t"), F.col("p")).alias("k")).first()["k"] == kind


@pytest.mark.parametrize(
    "text, dates",
    [
        ("2024-01-15 and 12/31/2024", ["2024-01-15", "2024-12-31"]), ("31/03/2024", []), ("January 5, 2024", ["2024-05-01"]), ("January 15, 2024", ["2024-01-15"]), ("15 January 2024", ["2024-01-15"]), ("Sept 5 2024", []),
        ("2024-02-30", []), ("2024-01-15 2024-01-15", ["2024-01-15"]), ("none", []),
    ],
)
def test_dates(spark, text, dates):
    assert [str(d) for d in spark.createDataFrame([(text,)], "t string").select(meta.dates(F.col("t")).alias("d")).first()["d"]] == dates


@pytest.mark.parametrize("text, amounts", [("$2.5 million", [2.0]), ("$50,000", [50000.0]), ("$2500000", [250.0]), ("$1,000 by", [1e12]), ("$5 men", [5e6]), ("$ 3.50K", [3500.0]), ("$1.00 $1.00", [1.0]), ("5 dollars", [])])
def test_amounts(spark, text, amounts):
    assert spark.createDataFrame([(text,)], "t string").select(meta.amounts(F.col("t")).alias("a")).first()["a"] == amounts


def test_emails_and_entities(spark):
    text = "Write A.b@Acme.com or a.B@acme.COM, Jane Smith\nand Net Profit Margin of Acme; single Word"
    r = spark.createDataFrame([(text,)], "t string").select(meta.emails(F.col("t")).alias("e"), meta.entities(F.col("t")).alias("n")).first()
    assert r["e"] == ["a.b@acme.com"]
    assert r["n"] == ["Jane Smith", "Net Profit Margin"]
    many = " x ".join(f"Aa{chr(97 + i // 26)}{chr(97 + i % 26)} Bb" for i in range(60))
    assert len(spark.createDataFrame([(many,)], "t string").select(meta.entities(F.col("t")).alias("n")).first()["n"]) == 50


@pytest.mark.parametrize(
    "text, query, n, out",
    [
        ("one two three four five", "three", 5, "...two three..."), ("three four", "three", 50, "three four"), ("abc\ndef ghi", "zz def", 4, "abc def..."), ("nothing here", "word", 9, "FALL"), ("a bb ccc", "bb", 9, "FALL"), ("b second first", "first second", 3, "...nd fir..."),
    ],
)
def test_contextual_snippet(spark, text, query, n, out):
    assert spark.createDataFrame([(text,)], "t string").select(T.contextual_snippet(F.col("t"), query, F.lit("FALL"), n).alias("s")).first()["s"] == out


@pytest.mark.parametrize("text, limit, out", [("short", 10, "short"), ("aaaa bbbb cccc", 11, "aaaa bbbb..."), ("éééééé", 5, "éé..."), ("日本語", 4, "日..."), ("😀😀", 6, "😀..."), ("abcdefgh", 3, "abc...")])
def test_full_content(spark, text, limit, out):
    assert spark.createDataFrame([(text,)], "t string").select(T.full_content(F.col("t"), limit).alias("s")).first()["s"] == out


def test_paths(spark):
    r = spark.createDataFrame([("/a/b/x.tar.GZ",), ("/a/bc/.hidden",)], "p string").select(T.file_name(F.col("p")).alias("n"), T.file_stem(F.col("p")).alias("s"), T.extension(F.col("p")).alias("e"), T.under(F.col("p"), "/a/b/").alias("u")).collect()
    assert [tuple(x) for x in r] == [("x.tar.GZ", "x.tar", "gz", True), (".hidden", ".hidden", "", False)]


def test_scores(spark):
    row = spark.createDataFrame([(0.5, 3, 7, datetime.datetime(2024, 1, 1), "My Title")], "c double, p int, s int, m timestamp, t string")
    r = row.select(
        score.trigram_score(F.col("c"), F.col("p")).alias("g"), score.trigram_score(F.col("c"), F.lit(0)).alias("g0"), score.proximity_score(F.lit(None).cast("int")).alias("p0"), score.proximity_score(F.lit(0)).alias("p1"),
        score.proximity_score(F.col("s")).alias("p2"), score.recency_score(F.col("m"), F.col("m")).alias("r1"), score.recency_score(F.col("m"), F.col("m") + F.expr("interval 180 days")).alias("r2"),
        score.recency_score(F.col("m"), F.col("m") - F.expr("interval 9 days")).alias("r3"), score.title_boost(F.col("t"), "x titl").alias("t1"), score.title_boost(F.lit(None).cast("string"), "x").alias("t0"),
    ).first()
    from math import exp, log

    boost = (1 + log(3)) / (2 + log(3))
    assert r["g"] == pytest.approx(0.35 + 0.3 * boost) and r["g0"] == pytest.approx(0.35)
    assert (r["p0"], r["p1"]) == (0, 1) and r["p2"] == pytest.approx(1 / (1 + log(7)))
    assert r["r1"] == r["r3"] == 1 and r["r2"] == pytest.approx(exp(-1))
    assert (r["t1"], r["t0"]) == (1, 0)


@pytest.mark.parametrize("lists, span", [([[5, 20, 50]], 0), ([[10, 100], [13, 200]], 3), ([[10], []], None), ([[1, 9], [4], [12]], 8), ([[5], [5]], 0)])
def test_min_span(spark, lists, span):
    cols = [F.array(*[F.lit(x) for x in own]).cast("array<int>") for own in lists]
    assert spark.range(1).select(post.span_of(cols).alias("s")).first()["s"] == span


def test_min_span_of_a_text(spark):
    frame = spark.createDataFrame([("alpha beta gamma alpha",)], "t string")
    assert frame.select(post.min_span(F.col("t"), ["alpha", "gamma"]).alias("s")).first()["s"] == 6
    assert frame.select(post.min_span(F.col("t"), ["alpha", "delta"]).alias("s")).first()["s"] is None
    assert frame.select(post.min_span(F.col("t"), []).alias("s")).first()["s"] is None
