import random
import re

import duckdb
from pyspark.sql import functions as F

from loomspan.functions import markup
from loomspan.functions import text as T
from loomspan.plans import queries


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("r")).first().r


def greedy(text, most):
    out = []
    while len(text) > most:
        cut = text.rfind(" ", 0, most)
        cut = cut + 1 if cut > 0 else most
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text] if text else out


def test_split_is_greedy(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab  \né") for _ in range(rng.randrange(0, 90))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.split_text(F.col("t"), 10).alias("s")).collect()
    for r in rows:
        assert "".join(r.s) == texts[r.i] and r.s == greedy(texts[r.i], 10)


def test_mask_and_unmask(spark):
    text = "Více na https://a.cz/x nebo a.b@c.cz, SKU: AB-12, průměr 63 mm a 50 % i 46 cm"
    masked = one(spark, text, T.mask)
    assert list(masked.kept) == ["https://a.cz/x", "a.b@c.cz", "SKU: AB-12", "63 mm", "46 cm"]
    assert re.findall(r"__KEEP_(\d)__", masked.text) == ["0", "1", "2", "3", "4"] and "50 %" in masked.text
    back = spark.createDataFrame([(masked.text, masked.kept)], "t string, k array<string>").select(T.unmask(F.col("t"), F.col("k")).alias("r")).first().r
    assert back == text


def test_predicates(spark):
    assert one(spark, "  \t", T.is_blank) and not one(spark, " a", T.is_blank)
    assert not one(spark, "__KEEP_0__ 12", T.has_words) and one(spark, "ž", T.has_words) and not one(spark, "привет", T.has_words)
    assert one(spark, "  A  b\n", T.normalize) == "a b"
    assert one(spark, "```json\n[1]\n```", T.strip_fence) == "[1]"


def test_markup(spark):
    html = "<p class='x'>Ahoj <b>světe</b></p><!-- a --><script>var a = '<i>';</script><a href=\"u\">x</a><A HREF='v'>y</A>"
    parts = one(spark, html, markup.pieces)
    assert "".join(p.text for p in parts) == html
    assert [p.text for p in parts if p.is_text] == ["Ahoj ", "světe", "x", "y"]
    assert list(one(spark, html, markup.hrefs)) == ["u", "v"]
    assert "p class x" in one(spark, html, markup.attributes)
    assert one(spark, html, lambda h: markup.same_structure(h, F.replace(h, F.lit("<b>"), F.lit("<i>")))) is False


def test_quoted_values_may_hold_anything(spark):
    html = """<a title="x>y" href='/p?a="b">c'>one</a> <A data-t='<b>' HREF = /q/r class>two</A><br/><img alt="a=b c" src=i.png/><p "odd>x</p>< 1 <b"""
    parts = one(spark, html, markup.pieces)
    assert "".join(p.text for p in parts) == html
    assert [p.text for p in parts if p.is_text] == ["one", " ", "two", "x", "<", " 1 ", "<", "b"]
    assert list(one(spark, html, markup.hrefs)) == ['/p?a="b">c', "/q/r"]
    assert list(one(spark, html, markup.tags)) == ["a", "a", "br", "img", "p"]
    assert list(one(spark, html, markup.attributes)) == sorted(["a title x>y", 'a href /p?a="b">c', "a data-t <b>", "a href /q/r", "a class ", "img alt a=b c", "img src i.png/", 'p "odd '])
    assert one(spark, html, lambda h: markup.same_structure(h, F.replace(h, F.lit("x>y"), F.lit("x>z")))) is False


def test_raw_text_elements_and_long_markup(spark):
    html = "<script a='</script>'>if (a<b) '<p>'</script><scripts>t</scripts><STYLE>p > a {}</style >x<!-- <a href=q> --><!doctype html>"
    assert list(one(spark, html, markup.tags)) == ["script", "scripts", "style"] and list(one(spark, html, markup.hrefs)) == []
    assert [p.text for p in one(spark, html, markup.pieces) if p.is_text] == ["t", "x"]
    many = "<a " + " ".join(f"k{i}='>'" for i in range(20000)) + ">" + "w " * 200000 + "<a href='" + "x" * 100000
    parts = one(spark, many, markup.pieces)
    assert "".join(p.text for p in parts) == many and len(one(spark, many, markup.attributes)) == 20000


def test_mask_counts_through_all_kinds(spark):
    rows = [("a b@c.de 5 mm https://x.y/z SKU: AB-12 6 kg",), (None,), ("",)]
    found = spark.createDataFrame(rows, "t string").select(T.mask(F.col("t")).alias("m")).select("m.*").collect()
    assert [tuple(r) for r in found] == [("a __KEEP_1__ __KEEP_3__ __KEEP_0__ __KEEP_2__ __KEEP_4__", ["https://x.y/z", "b@c.de", "SKU: AB-12", "5 mm", "6 kg"]), (None, None), ("", [])]


def test_masked_spans_are_searched_once(spark):
    plan = spark.range(1).select(T.mask(F.lit("a").cast("string")).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == len(T.PROTECTED)


def test_texts_without_a_word_are_assembled(spark, tmp_path):
    """The query gives what its SQL gives for texts without a letter, or of white space only."""
    rows = [(0, "a b " * 300), (1, "12 34, 56."), (2, " \n "), (3, ""), (4, None), (5, "привет 7"), (6, "1 " * 500), (7, "__KEEP_0__ 1")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = queries.assemble_cells(spark, str(tmp_path)).select("doc_id", "rendered").collect()
    assert sorted(map(tuple, found)) == sorted(con.execute(queries.ORACLE_SQL["assemble_cells"]).fetchall())
    assert len(found) == 6
