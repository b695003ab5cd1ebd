import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dumpsieve.functions import regex, text
from dumpsieve.functions.regex import check_re2, java_equivalent, re2_search
from dumpsieve.specs import FilterSpec

EQUAL = ["sſ", "kK", "σς", "µμ", "ßẞ", "éÉ", "Ꭰꭰ", "𐐀𐐨", "ǅǆ", "ᾀᾈ"]
DIFFERENT = [("i", "İ"), ("ı", "I"), ("ß", "SS"), ("i̇", "İ"), ("ab", "abc")]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("pair", EQUAL)
def test_fold_pairs_are_equal(spark, pair):
    a, b = pair
    assert one(spark, text.equals_fold(F.lit(a), b)) and one(spark, text.equals_fold(F.lit(b), a))
    assert one(spark, text.fold(F.lit(a)) == text.fold(F.lit(b)))


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_fold_pairs_are_different(spark, a, b):
    assert not one(spark, text.equals_fold(F.lit(a), b))
    assert not one(spark, text.equals_fold(F.lit(b), a))


LETTERS = st.text(st.sampled_from("aAsSſkKKiIİıßẞσςΣéÉ xZ0_𐐀𐐨"), min_size=1, max_size=6)


@settings(max_examples=3, deadline=None)
@given(st.lists(LETTERS, min_size=40, max_size=40, unique=True), st.lists(LETTERS, min_size=8, max_size=8))
def test_matching_against_code_points(spark, values, needles):
    table = spark.createDataFrame([(v,) for v in values], "v string")
    columns = []
    for i, n in enumerate(needles):
        columns += [text.equals_fold(F.col("v"), n).alias(f"e{i}"), text.contains_lower(F.col("v"), n).alias(f"c{i}")]
    for row in table.select("v", *columns).collect():
        for i, n in enumerate(needles):
            assert row[f"e{i}"] == (text.fold_literal(row.v) == text.fold_literal(n))
            assert row[f"c{i}"] == (text.lower_literal(n) in text.lower_literal(row.v))


def test_partial_is_lower_case_not_folding(spark):
    assert one(spark, text.contains_lower(F.lit("ΟΔΟΣ"), "σ"))
    assert one(spark, text.contains_lower(F.lit("İx"), "ix"))
    assert not one(spark, text.contains_lower(F.lit("ſ"), "s"))
    assert one(spark, text.contains_any_lower(F.lit("ABC"), ["x", "Bc"]))


def test_names(spark):
    assert one(spark, text.sanitize_filename(F.lit('a<b>c:d"e/f\\g|h?i*j\x01k'))) == "a_b_c_d_e_f_g_h_i_j_k"
    assert one(spark, text.output_name(F.lit("sub/RS_2023-01.zst"), F.lit("a/b"))) == "sub/RS_2023-01_a_b.zst"
    assert one(spark, text.base_name(F.lit("a/b.c/d"))) == "d"
    assert one(spark, text.file_ext(F.lit("a/b.c/d"))) == ""
    assert one(spark, text.file_ext(F.lit("a/d.tar.zst"))) == ".zst"
    assert [one(spark, text.first_letter(F.lit(x))) for x in ("Éa", "9", "/x", "")] == ["é", "9", "_", "_"]


def test_config_hash(spark):
    want = hashlib.sha256(b"author:ab:false:true:RS_.*").hexdigest()
    assert FilterSpec("author", "ab", partial=True, file_filter="RS_.*").config_hash() == want
    got = text.config_hash(F.lit("author"), F.lit("ab"), F.lit(False), F.lit(True), F.lit("RS_.*"))
    assert one(spark, got) == want


TEXTS = ["", "a", "ab", "a\nb", "a\rb", "a\n", "x.y", "src12", "SRC1", "Kelvin K", "foo bar", "ünder_score",
         "a b", "a\u0085b", "aab", "\x0b", "foo\nbar\n", "1e5", "(x)", "é", "a+b", "tab\t"]
PATTERNS = ["a", "^a", "a$", "^a.b$", "a.b", "b.*", "^src1[0-9]", "src|foo", "(src|foo)1?", r"x\.y", r"\bfoo\b",
            "(?i)k$", "(?i)SRC", r"\s", r"^\S+$", "(?m)^bar$", "(?s)a.b", "[[:alpha:]]+$", r"\d+", r"\pL", "a{2}",
            "(?P<n>a)b", r"\(x\)", "a*?b", "[^a-z]", "", r"a\+b", "^$", r"\x{e9}", "(?U)a+b", ".", r"foo\nbar"]


def test_regex_agrees_with_re2(spark):
    """DuckDB's engine is RE2 too."""
    table = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = table.select("t", *[re2_search(F.col("t"), p).alias(f"p{i}") for i, p in enumerate(PATTERNS)]).collect()
    for row in got:
        for i, p in enumerate(PATTERNS):
            want = duckdb.execute("SELECT regexp_matches(?, ?)", [row.t, p]).fetchone()[0]
            assert row[f"p{i}"] == want, (row.t, p)
    assert sum(java_equivalent(p) is not None for p in PATTERNS) >= 10


@pytest.mark.parametrize("bad", ["(", "a(?=b)", r"(a)\1", "a++", "(?<!x)a", r"a\Z", "a{1001}", "[b", r"\C", "*a"])
def test_regex_refuses_what_re2_refuses(bad):
    with pytest.raises(ValueError):
        check_re2(bad)


def test_no_repetition_runs_in_the_backtracking_engine():
    for pattern in ["(a+)+$", "(a|b)*c", ".*foo", "a+b", r"\w+x", "x{3}"]:
        assert java_equivalent(pattern) is None


def test_null_does_not_match(spark):
    null = F.lit(None).cast("string")
    for column in (text.equals_fold(null, "a"), text.contains_lower(null, "a"), regex.re2_search(null, "a*b")):
        assert one(spark, column) is None
