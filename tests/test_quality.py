import pytest
from pyspark.sql import functions as F

from loomspan.functions import quality
from loomspan.functions import text as T

CASES = [
    ("Toto je dlouhý text produktu", "Toto je dlouhý text produktu", "strict", "unchanged_text"),
    ("Ahoj", "", "strict", "empty_translation"),
    ("který produkt", "ktorý produkt", "strict", "ok"),
    ("něco jiného tady", "který produkt je pouze", "strict", "czech_wording"),
    ("něco jiného tady", "něco úplne", "strict", "ok"),
    ("abc def", "něco tuřů", "strict", "czech_diacritics"),
    ("zpětný ventil", "zpětný ventil nový", "fast", "czech_lexeme_residual"),
    ("zpětný ventil", "spätný ventil", "strict", "ok"),
    ("https://a.cz/produkt", "https://a.cz/produkt", "strict", "ok"),
    ("adaptér", "adaptér", "strict", "ok"),
    ("Bosch Professional", "Bosch Professional", "strict", "ok"),
    ("pouze", "pouze", "strict", "czech_wording"),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, s string, t string, tier string")
    return {r.i: r.q for r in rows.select("i", quality.assess(F.col("s"), F.col("t"), F.col("tier")).alias("q")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_verdict(verdicts, i):
    assert verdicts[i].code == CASES[i][3]
    assert verdicts[i].ok == (CASES[i][3] == "ok")


def test_other_pair(spark):
    q = spark.range(1).select(quality.assess(F.lit("abcdefghi"), F.lit("abcdefghi"), F.lit("strict"), "en", "de").alias("q")).first().q
    assert q.ok and "CS" in q.message


def test_long_texts_are_not_read_to_their_end_for_a_label(spark):
    """Counts of letters stop where enough is seen, and words of a long text are not listed."""
    rows = spark.createDataFrame([("a1b",), ("  \n--x y",), ("",), (None,), ("... " * 9 + "abc",)], "s string")
    assert [r.n for r in rows.select(T.has_letters(F.col("s"), 2).alias("n")).collect()] == [True, True, False, None, True]
    assert [r.n for r in rows.select(T.letters(F.col("s")).alias("n")).collect()] == [2, 2, 0, None, 3]


def test_same_normal_forms(spark):
    """First words tell texts apart only where normal forms differ, too."""
    texts = ["", " ", "ΣΑΣ x", "σας  X", "a b", " A\tb ", "a\u00a0b", "ab", "a", "İ", "x " * 40, "X " * 39 + "x", None]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    a, b = F.col("a"), F.col("b")
    assert pairs.where(~T.same_normalized(a, b).eqNullSafe(T.normalize(a) == T.normalize(b))).count() == 0
