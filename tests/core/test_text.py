from __future__ import annotations

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary import config
from granary.functions import text as X

quiet = settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@quiet
@given(st.lists(st.text(" \t\n 　ab.", max_size=12), min_size=1, max_size=30))
def test_word_count_equals_python(spark, texts):
    white = "\t-\r \x85\xa0  -     　"
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.word_count(F.col("t")).alias("n"), X.collapsed(F.col("t")).alias("c")).collect()
    for r in rows:
        words = re.findall(f"[^{white}]+", r["t"])
        assert r["n"] == len(words) and r["c"] == " ".join(words)


def test_null_and_empty(spark):
    assert one(spark, X.word_count(F.lit(None).cast("string"))) is None and one(spark, X.word_count(F.lit(""))) == 0
    assert one(spark, X.label_key(F.lit("  Leaf \t BLAST "))) == "leaf blast" and one(spark, X.label_key(F.lit(" "))) == "(none)" == one(spark, X.label_key(F.lit(None).cast("string")))
    assert one(spark, X.filled(F.lit(""), F.lit(None).cast("string"), F.lit("z"))) == "z"


def test_slug_cuts_and_trims(spark):
    assert one(spark, X.slug(F.lit("Blast -- Management (2nd).PDF"))) == "blast-management-2nd-pdf"
    assert one(spark, X.slug(F.lit("a" * 39 + "-bcd"))) == "a" * 39


def test_typographic_forms(spark):
    assert one(spark, X.typographic(X.composed(F.lit("A˚  ‘x’ “y” a–b so­ft ﬁ")))) == "Å 'x' \"y\" a-b soft fi"
    assert one(spark, X.for_checking(X.decomposed(F.lit(" 2–3 L’eau ﬁ")))) == "2-3 l'eau fi"


def test_ordered_containment(spark):
    def held(value, source):
        return one(spark, X.contains_in_order(F.lit(value), F.lit(source)))

    assert held("a b", "x a b y") and held("tri + pro", "tri +\nmore pro") and not held("b a", "a then b") and held("", "x")
    assert held("a z", "a" + "." * 119 + "z") and not held("a z", "a" + "." * 200 + "z")


def test_shingles(spark):
    assert one(spark, F.size(X.shingle_hashes(F.lit("a b c d, A B C D"), 3))) == 4
    assert one(spark, F.size(X.shingle_hashes(F.lit("a b"), 3))) == 0


def test_secrets(spark):
    line = "key AIzaAAAAAAAAAAAAAAAAAAAAAAAA, Bearer abcdefgh1 password: xyz ok"
    assert one(spark, X.without_secrets(F.lit(line))) == "key [REDACTED], Bearer [REDACTED] password: [REDACTED] ok"
    assert one(spark, X.without_secrets(F.lit("clean line"))) == "clean line"


def test_list_lines(spark):
    reply = "# Head\n- **Apply** it\n2. Drain the field\n| a | b |\n```\nok\n* x\n\n"
    assert one(spark, X.list_lines(F.lit(reply))) == ["Apply** it", "Drain the field"]
    assert one(spark, X.list_lines(F.lit("# only\n"))) is None


def test_triggers_never_hide_a_match(spark):
    texts = ["Bacterial blight BB Table", "xanthomonas oryzae pv oryzae", "NBL spots", "S-RBSDV black streaked dwarf", "narrow brown leaf spot", "nothing here", "KERNEL SMUT and Grain Discoloration", None, ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for lexicon in (config.CHUNK_LEXICON, config.OTHER_LEXICON, config.COVERAGE_LEXICON):
        for pattern in lexicon.values():
            assert X.triggers(pattern)
            assert frame.filter(X.hits(F.col("t"), pattern) != X.quick_hits(F.col("t"), F.lower("t"), pattern)).count() == 0
