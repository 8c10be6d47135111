import pytest
from pyspark.sql import functions as F

from docweave.functions import columns as c
from docweave.functions.viet import is_syllable
from docweave.operators import lines


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_ordinals(spark):
    rows = [(x,) for x in ("IV", "mcmxc", "IIII", "10A", "3Đ", "a", "đ", "i", "1.2.3", "", None, " ２. ", "MMMCMXCIX")]
    got = values(spark, rows, "s string", c.roman_key(F.col("s")), c.number_key(F.col("s")), c.letter_key(F.col("s")), c.decimal_key(F.col("s")))
    assert got == [("4", None, None, None), ("1990", None, None, None), (None, None, None, None), (None, "10a", None, None), (None, "3đ", None, None), (None, None, "a", None), (None, None, "đ", None), ("1", None, "i", None), (None, None, None, "1.2.3"), (None, None, None, None), (None, None, None, None), (None, "2", None, "2"), ("3999", None, None, None)]


def test_every_roman_numeral(spark):
    def roman(n):
        out = ""
        for v, s in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
            out, n = out + s * (n // v), n % v
        return out

    df = spark.createDataFrame([(n, roman(n)) for n in range(1, 4000)], "n int, s string")
    assert df.where(c.roman_key(F.col("s")) != F.col("n").cast("string")).count() == 0


def test_agreement(spark):
    rows = [("a", "a"), ("a", "b"), (None, " a "), (None, None), ("", " ")]
    got = values(spark, rows, "x string, y string", c.agreement([F.col("x"), F.col("y")]))
    assert [tuple(g[0]) for g in got] == [("a", False), (None, True), ("a", False), (None, False), (None, False)]


def test_boxes(spark):
    got = values(spark, [(30.0, 10.0, 200.0), (10.0 - 1e-10, 10.0, 200.0), (5.0, 10.0, 200.0), (5.0, 10.0, 0.0), (None, 1.0, 1.0)], "v double, o double, e double", c.projected(F.col("v"), F.col("o"), F.col("e")))
    assert [g[0] for g in got] == [100.0, 0.0, None, None, None]
    boxes = [(0.0, 0.0, 10.0, 10.0, 5.0, 0.0, 15.0, 10.0), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 1.0, 1.0, 2.0, 2.0, 3.0, 3.0)]
    got = values(spark, boxes, ", ".join(f"c{k} double" for k in range(8)), c.iou([F.col(f"c{k}") for k in range(4)], [F.col(f"c{k}") for k in range(4, 8)]))
    assert [round(g[0], 6) for g in got] == [round(50 / 150, 6), 0.0, 0.0]


def test_assets_and_paths(spark):
    rows = [("a/b.png",), ("/a",), ("a/../b",), ("a\\b",), ("C:x",), ("",), ("a//b",), (None,), ("./a",)]
    assert [g[0] for g in values(spark, rows, "p string", c.safe_path(F.col("p")))] == [True] + [False] * 8
    rows = [("iVBORw0KGgo=",), ("iVBORw0KGgo",), ("iVBO Rw0KGgo=",), ("",), (None,), ("/9j/",)]
    assert [g[0] for g in values(spark, rows, "b string", c.image_type(c.strict_base64(F.col("b"))))] == ["image/png", None, None, None, None, "image/jpeg"]
    assert [g[0] for g in values(spark, [("https://a.b/c",), ("http://a",), ("https:///x",), (None,)], "u string", c.https_url(F.col("u")))] == [True, False, False, False]


def test_line_events(spark):
    texts = ["a\nb", "a\n\nb\n", "", None, "\n", "đ😀\nx", "no end", "x\r\ny", "dòng\n" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("line", F.lit("clash"))
    events = lines.line_events(df, ["k"], "text").cache()
    for k, t in enumerate(texts):
        rows = events.where(f"k = {k}").orderBy("line_order").collect()
        want = [p for p in (t or "").splitlines(keepends=True)] if "\r" not in (t or "") else ["x\r\n", "y"]
        assert [r["line"] for r in rows] == want
        assert [(r["char_start"], r["char_end"]) for r in rows] == [(sum(map(len, want[:i])), sum(map(len, want[: i + 1]))) for i in range(len(want))]
    assert lines.partition_summary(events, ["k"]).where("not gapless").count() == 0
    back = {r["k"]: r["text"] for r in lines.reconstruct(events, ["k"]).collect()}
    assert back == {k: t for k, t in enumerate(texts) if t}
    assert lines.line_events(df.limit(0), ["k"], "text").count() == 0


@pytest.mark.parametrize(("word", "yes"), [("nghiêng", True), ("QUYẾT", True), ("giếng", True), ("môc", False), ("straße", False), ("", False), ("a" * 100, False), ("đ", False), ("ý", True)])
def test_syllables(word, yes):
    assert is_syllable(word) is yes
