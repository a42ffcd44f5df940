"""Literal cases that the test tables don't hold."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import structure as S
from corpusloom.operators import transcript as C


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("value, want", [("one\rtwo\r\nthree\n", "one\ntwo\nthree\n"), ("a\r\r\nb", "a\n\nb"), (None, None)])
def test_newlines(spark, value, want):
    assert one(spark, value, T.newlines) == want


@pytest.mark.parametrize("value, want", [("A Letter.docx", "A Letter"), ("3rd-note.txt", "3Rd Note"), ("__.pdf", "Document"), ("x.tar.gz", "X Tar")])
def test_title(spark, value, want):
    assert one(spark, value, T.title_from_name) == want


@pytest.mark.parametrize("value, want", [("# a b", ["a", "b"]), ("- x\n> y", ["x", "y"]), ("a b c", ["a", "b", "c"]), ("####### seven", ["#######", "seven"]), ("", [])])
def test_words(spark, value, want):
    assert one(spark, value, T.words) == want


def test_inline_words(spark):
    assert one(spark, "**a** [b](http://x) | --- | `c`", lambda x: T.words(x, True)) == ["a", "b", "c"]


def test_sentences_keep_disagreements(spark):
    assert one(spark, "Is it {a. | b}? Yes. Then so", T.sentences) == ["Is it {a. | b}?", "Yes.", "Then so"] or one(spark, "Is it {a. | b} now? Yes. Then so", T.sentences) == ["Is it {a. | b} now?", "Yes.", "Then so"]


@pytest.mark.parametrize("value, want", [("a```b", "````"), ("plain", "```"), ("`", "```")])
def test_fence(spark, value, want):
    assert one(spark, value, T.fence) == want


@pytest.mark.parametrize("ns, want", [(1_234_567_890, "1.234s"), (60_000_000_000, "1m 0s"), (7_385_000_000_000, "2h 3m 5s")])
def test_elapsed(spark, ns, want):
    assert spark.range(1).select(T.elapsed(F.lit(ns))).first()[0] == want


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 300_000))
def test_columns_round_trip(spark, n):
    assert spark.range(1).select(T.column_index(T.column_letter(F.lit(n)))).first()[0] == n


def test_gate_refuses_changed_words(spark):
    df = spark.createDataFrame([("a b", "# a b"), ("a b", "a c"), ("", "x"), ("a", None)], "t string, g string")
    got = [tuple(r[0]) for r in df.select(S.gated(F.col("t"), F.col("g"))).collect()]
    assert got == [("# a b", None), ("a b", "words-changed"), ("", None), ("a", "unusable-annotations")]


def test_list_items_join(spark):
    got = spark.range(1).select(S.applied(F.array(F.lit("- a"), F.lit("- b"), F.lit("p"), F.lit("- c")))).first()[0]
    assert got == "- a\n- b\n\np\n\n- c"


def test_windows_are_greedy(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([5, 5, 20, 1, 9, 10])], "k int, t int, n int")
    got = {r.t: r.window for r in C.windows(df, "k", "t", "n", 10).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 3, 4: 3, 5: 4}


def test_similarity(spark):
    df = spark.createDataFrame([("abcd", "abcd"), ("abcd", "bcde"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(C.similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.75, None]


def test_boundaries_and_spellings(spark):
    got = spark.range(1).select(C.boundary_refused(F.lit(13), F.lit(50), F.lit("a"), F.lit("b")), C.boundary_refused(F.lit(2), F.lit(50), F.lit("a"), F.lit("a")), C.boundary_refused(F.lit(2), F.lit(50), F.lit("a"), F.lit("b")), C.spelling_refused(F.lit("x"), F.lit("y|"), F.lit("a x"))).first()
    assert list(got) == ["too-many-words", "same-speaker", None, "characters"]
