"""Long lists of regular expressions."""

import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from dumpsieve.operators import patterns
from dumpsieve.operators import value_list as lists
from dumpsieve.operators.contained import MATCH, MATCH_AS_IS, flag_contained
from dumpsieve.operators.patterns import flag_patterns, plain_text, required_texts
from dumpsieve.operators.predicates import tag_matches
from dumpsieve.specs import FilterSpec
from pyspark.sql import functions as F


@pytest.mark.parametrize("pattern, want", [
    ("hello", ["hello"]), ("^hello$", ["hello"]), ("hello world+", ["hello world"]), ("hellos?", ["hello"]),
    ("abc*defg", ["defg"]), ("abcd{0,3}ef", ["abc"]), ("abcd{2}ef", ["abcd"]), ("abcd{0}", ["abc"]),
    ("ab|cdef", []), ("abc|cdef", ["abc", "cdef"]), ("(abc|cdef)x", ["abc", "cdef"]), ("(abcd)?xyz", ["xyz"]),
    ("(abcd)*", []), ("(?:abcd){0,2}xyz", ["xyz"]), ("(?P<n>abcd)+", ["abcd"]), ("(?i)abcd", ["abcd"]),
    ("(?i:abcd)x", ["abcd"]), ("[abcd]+xyz", ["xyz"]), ("[]abc]xyz", ["xyz"]), ("[[:alpha:]]xyz", ["xyz"]),
    (r"[\]abcd]xyz", ["xyz"]), (r"\x{1F600}abc", ["abc"]), (r"\x4142abc", ["42abc"]), (r"\p{Greek}abc", ["abc"]),
    (r"\pLabc", ["abc"]), (r"\101abc", ["abc"]), (r"\bword\b", ["word"]), (r"a\.b\.c", ["a.b.c"]),
    (r"\Qa.b.c\E", []), (r"\d+ of it", [" of it"]), (".*", []), ("ab", []), ("a||b", []), ("abcd|", []),
    ("((abcd|efgh)x|ijkl)y*", ["abcd", "efgh", "ijkl"]), ("abc{x}def", ["abc{x}def"]), ("abc??def", ["def"]),
])
def test_required_texts(pattern, want):
    assert required_texts(pattern) == want


@pytest.mark.parametrize("pattern, want", [
    ("one +two +three", ["one two three"]), ("one {2}two", ["one two"]), ("one {1,}two", ["one two"]),
    (r"one\ +?two", ["one two"]), ("one *twos", ["twos"]), ("one {0,2}twos", ["twos"]), ("one +two|six +ten", ["one two", "six ten"]),
    ("(one +two)? +three", [" three"]), ("one  +two", ["one  two"]), ("one[ ]+twos", ["twos"]), ("one +tw+o", ["one tw"]),
])
def test_required_texts_with_any_spaces(pattern, want):
    assert required_texts(pattern, spaced=True) == want


@pytest.mark.parametrize("pattern, want", [
    ("hello", ("hello", MATCH)), ("one +two", ("one two", MATCH)), ("one two", ("one two", MATCH_AS_IS)), (" +ab", (" ab", MATCH)),
    (r"a\.b\-c +d", ("a.b-c d", MATCH)), (r"a\\b", (r"a\b", MATCH)), (r"one \+two", ("one +two", MATCH_AS_IS)), ("é 😀 K", ("é 😀 K", MATCH_AS_IS)),
    *[(p, None) for p in ("one +two three", "one  +two", " + +ab", "one  two", "ab c +?", "one ++", "one *two", r"a\_bc", r"a\dbc", "abc\\", "abc]",
                          "ab{2}", "(?i)abc", "^abc", "abc$", "a|bcd", "ab", r"\Qabc\E", "x" * (1 << 18))],
])
def test_patterns_of_text_alone(pattern, want):
    assert plain_text(pattern) == want
    for filler in ("x", "\U0001f600", " +x"):
        longest = pattern + filler * (patterns.PLAIN_BYTES // 4 // len(filler) - len(pattern))
        assert plain_text(longest) is None or pc.match_substring_regex(pa.array([""]), longest)[0].as_py() is False


def test_re2_compiles_no_pattern_of_text_alone(monkeypatch):
    def refuse(pattern):
        raise AssertionError(pattern)

    monkeypatch.setattr(patterns, "check_re2", refuse)
    lines = [r"The +line\. +\(one\)", "plain", "two words"]
    (filed,) = patterns._file_patterns([pa.RecordBatch.from_arrays([pa.array(lines)], names=["item"])])
    assert filed["pattern"].to_pylist() == ["The line. (one)", "plain", "two words"]
    assert filed["kind"].to_pylist() == [MATCH, MATCH, MATCH_AS_IS]


def test_text_alone_like_brute_force(spark):
    # Case, runs of spaces, characters that fold to others, text across two of them, next to patterns that are searched.
    draw = random.Random(5)
    text = lambda n: "".join(draw.choices("aAkK\u212as\u017féÉ  .", k=n))
    texts = [text(draw.randrange(2, 40)) for _ in range(400)] + [None, "", "one  two", "One two", "one two"]
    lines = {text(draw.randrange(3, 6)).replace(".", r"\.") for _ in range(60)} | {"one two", "one  two"}
    lines |= {" +".join(line.split()) for line in lines} | {"One +two", "on[e] +two$"}
    lines = sorted(line for line in lines if plain_text(line) or required_texts(line))
    assert {k and k[1] for k in map(plain_text, lines)} == {None, MATCH, MATCH_AS_IS}
    for some in (lines, ["one  +two"], ["one two"], ["One +two"]):
        want = [t is not None and any(pc.match_substring_regex(pa.array([t]), p)[0].as_py() for p in some) for t in texts]
        assert any(want) and not all(want)
        assert flags(spark, texts, some) == want


def test_the_list_is_not_exchanged(spark, tmp_path):
    # Values of 2,000 characters go into the index as numbers; the rows are staged as they are, and once.
    draw = random.Random(6)
    lines = ["".join(draw.choices("abcdefghij", k=2000)) for _ in range(300)]
    rows = spark.createDataFrame([(i, "x " + line) for i, line in enumerate(lines)], "n int, x string")
    for flag, items in ((flag_contained, lines), (flag_patterns, lines)):
        folder = str(tmp_path / flag.__name__)
        assert flag(rows, F.col("x"), spark.createDataFrame([(v,) for v in items], "item string"), folder).where("matched").count() == 300
        index = spark.read.parquet(folder + "/index")
        assert index.count() == 300 and "string" not in {t for _, t in index.dtypes}
        assert [t for _, t in spark.read.parquet(folder + "/tested").dtypes].count("string") == 1


def test_spaces_in_patterns(spark):
    texts = ["ONE   two three", "one two  three", "onetwo three", "one two", " one\ttwo three", "one  two three "]
    lines = ["one +two +three", "one {2}two", "(?i)one {3}two", "one +tw[o] *three$"]
    want = [any(pc.match_substring_regex(pa.array([t]), p)[0].as_py() for p in lines) for t in texts]
    assert want == [True, True, False, False, False, True]
    assert flags(spark, texts, lines) == want


def test_patterns_that_share_their_longest_word(spark, monkeypatch):
    # Each line holds the longest word of all patterns, but the text of one: what is looked for tells them apart.
    asked, search = [], patterns.occurrences

    def counted(texts, lows, folder):
        asked.append(lows.count())
        return search(texts, lows, folder)

    monkeypatch.setattr(patterns, "occurrences", counted)
    texts = [f"so{i}x  many  extraordinary x{i}" for i in range(50)]
    assert flags(spark, texts, [f"so{i}x +many +extraordinary +x{i}$" for i in range(50)]) == [True] * 50
    assert asked == [50]


def flags(spark, texts, patterns):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, x string")
    items = spark.createDataFrame([(p,) for p in patterns], "item string")
    got = flag_patterns(rows, F.col("x"), items).collect()
    assert sorted(r.n for r in got) == list(range(len(texts)))
    return [bool(r.matched) for r in sorted(got)]


@pytest.mark.parametrize("seed, free", [(1, False), (2, True)])
def test_like_brute_force(spark, seed, free):
    draw = random.Random(seed)
    text = lambda n, chars="abcK\u212as\u017f é\n": "".join(draw.choices(chars, k=n))

    def piece():
        return draw.choice([
            lambda: text(draw.randrange(1, 5), "abcKsé "), lambda: f"[{text(3, 'abck')}]", lambda: text(3, "abc") + draw.choice("?*+"),
            lambda: f"({text(3, 'abck')}|{text(4, 'abcs')})" + draw.choice(["", "?", "{2}", "{0,1}"]), lambda: r"\s", lambda: ".",
        ])()

    patterns = {draw.choice(["", "(?i)", "^", "(?s)"]) + "".join(piece() for _ in range(4)) for _ in range(120)}
    patterns = sorted(p for p in patterns if bool(free) or required_texts(p))[:80]
    texts = [text(draw.randrange(2, 30)) for _ in range(250)] + [None, ""]
    want = [False] * len(texts)
    for pattern in patterns:
        want = [w or bool(h) for w, h in zip(want, pc.match_substring_regex(pa.array(texts), pattern).to_pylist())]
    assert any(want) and not all(want)
    assert flags(spark, texts, patterns) == want


def test_odd_lists(spark):
    assert flags(spark, ["x", "", None], []) == [False, False, False]
    assert flags(spark, ["x", "", None], ["", None]) == [False, False, False]
    assert flags(spark, ["x", "", None], ["^$", "^$"]) == [False, True, False]
    assert flags(spark, ["KELVIN", "\u212aelvin", "elvin"], ["(?i)kelvin"]) == [True, True, False]
    long = "word " * 300_000 + "at the  end"
    assert flags(spark, [long, "at the"], [r"at the\s+end", "nowhere"]) == [True, False]
    with pytest.raises(ValueError, match="no RE2 pattern"):
        flags(spark, ["x"], ["abcd", "(?=abcd)"])


def test_plan_does_not_grow_with_the_list(spark, tmp_path):
    table = spark.createDataFrame([('{"author":"x value12 end"}',), ('{"author":"value12345678"}',), ('{"author":null}',)], "value string")

    def tagged(n):
        path = tmp_path / f"{n}.txt"
        path.write_text("".join(f"value{i} +end|valu[e]{i}$\n" for i in range(10, n)))
        values = lists.value_list_source(spark, str(path))
        spec = FilterSpec("author", value_list=str(path), regex=True)
        assert lists.moves_lines(values, spec)
        return tag_matches(table, spec, values)

    few, many = tagged(3_000), tagged(10_000)
    assert [bool(r.matched) for r in many.orderBy("value").collect()] == [False, True, False]
    size = [len(d._jdf.queryExecution().optimizedPlan().toString()) for d in (few, many)]
    assert abs(size[0] - size[1]) < 200
