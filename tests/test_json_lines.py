import pytest
from pyspark.sql import functions as F

from dumpsieve.functions.json_lines import parse_ndjson
from dumpsieve.functions.values import default_text, json_type
from dumpsieve.operators.predicates import filter_lines, tag_matches
from dumpsieve.operators.projections import project_comment, project_submission
from dumpsieve.specs import FilterSpec

GOOD = [
    '{"author":"AB"}', '{"author":"xaby"}', '{"author":7}', '{"author":null}', "{}", "null", " null\t",
    ' {"author":"ab"} \t', '{"author":"x","author":"ab"}', '{"Author":"ab"}', '{"a":{"b":[1,{"c":null}]}}',
    '{"_end":"x","author":"ab"}', '{"_both":1}', '{"author":{"x":1,"x":2}}', '{"a":1e308}', '{"s":"1e999"}',
    '{"s":"he said \\"1e999\\" \\\\","n":1}', '{"":1}', '{"a":-0.5E-10}', '{"a":"\\u0041\\/"}',
]
BAD = [
    "[1]", '"s"', "1", "true", '""', "{bad", '{"author":"ab"} x', "{'author':'ab'}", '{"author":"ab"', '{"author":"ab}',
    '{"author":"ab",}', '{"a":01}', '{"a":NaN}', '{"a":+1}', '{"a":.5}', '{"a":1.}', '{"a":"\t"}', '{"a":1}{"b":2}',
    '{"a":1},{"b":2}', '{"a":1}] [{', '{"a":1},{"_end":"1"}]', "nul", "null null", "null,", '﻿{"a":1}', '{"a":"\\x"}',
    '{"a":"', '{"a":[1}', '{"a" 1}', "{,}", '{"a":1,,"b":2}', '{a:1}', '{"a":tru}', '//x\n{}', '{"a":"\\',
]
ABSENT = object()


def parsed(spark, lines, keys, **options):
    table = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    return parse_ndjson(table, keys, **options).orderBy("i")


def test_good_and_bad_lines(spark):
    flags = [r.is_bad for r in parsed(spark, GOOD + BAD, ["author"]).collect()]
    wrong = [x for x, flag, want in zip(GOOD + BAD, flags, [False] * len(GOOD) + [True] * len(BAD)) if flag != want]
    assert wrong == []


def test_blank_lines_are_neither(spark):
    assert [r.is_bad for r in parsed(spark, ["", None], []).collect()] == [None, None]


def test_types_and_presence(spark):
    lines = ['{"k":"s"}', '{"k":7}', '{"k":1.5}', '{"k":true}', '{"k":null}', '{"k":[1]}', '{"k":{"a":1}}', "{}", "null"]
    got = [r.t for r in parsed(spark, lines, ["k"]).select(json_type(F.col("k")).alias("t")).collect()]
    assert [g and g.split("(")[0].split("<")[0] for g in got] == [
        "STRING", "BIGINT", "DECIMAL", "BOOLEAN", "VOID", "ARRAY", "OBJECT", None, None]


def test_numbers_out_of_range(spark):
    lines = ['{"a":1e400}', '{"b":-1e400}', '{"b":[1,{"c":2E+999}]}', '{"b":' + "9" * 400 + "}", '{"b":1e-400}', '{"s":"1e400"}']
    assert [r.is_bad for r in parsed(spark, lines, ["a"], all_numbers=False).collect()] == [True] + [False] * 5
    assert [r.is_bad for r in parsed(spark, lines, ["a"]).collect()] == [True] * 4 + [False] * 2
    assert [r.is_bad for r in parsed(spark, ['{"b":' + "7" * 250 + "e99}"], ["a"]).collect()] == [True]


def test_deep_and_long_values(spark):
    lines = ['{"a":"x","b":%s%s}' % ("[" * d, "]" * d) for d in (2000, 9999, 10000)] + ['{"a":"x","b":0.%s}' % ("1" * 5000)]
    got = parsed(spark, lines, ["a"]).collect()
    assert [r.is_bad for r in got] == [False, False, True, False]


def test_surrogate_escapes(spark):
    lines = ['{"k":"\\ud83d\\ude00"}', '{"k":"\\uD83D"}', '{"k":"\\ude00x"}', '{"k":"\\ud800\\ud83d\\ude00\\udc00"}',
             '{"k":"\\\\ud800"}', '{"k":"\\\\\\ud800"}', '{"k":"\\u00e9\\\\ud83d\\ude00"}']
    got = [r.k for r in parsed(spark, lines, ["k"]).select(F.col("k").cast("string").alias("k")).collect()]
    assert got == ["😀", "�", "�x", "�😀�", "\\ud800", "\\�", "é\\ud83d�"]


def test_invalid_bytes_become_replacement_characters_but_lines_stay(spark):
    raw = b'{"k":"a\xffb"}'
    table = spark.createDataFrame([(bytearray(raw),)], "b binary").select(F.col("b").cast("string").alias("value"))
    row = parse_ndjson(table, ["k"]).select(F.col("k").cast("string").alias("k"), F.col("value").cast("binary").alias("b")).first()
    assert row.k == "a�b" and bytes(row.b) == raw


@pytest.mark.parametrize("spec,want", [
    (FilterSpec("author", "ab"), ['{"author":"AB"}', ' {"author":"ab"} \t', '{"author":"x","author":"ab"}', '{"_end":"x","author":"ab"}']),
    (FilterSpec("author", "AB", partial=True), ['{"author":"AB"}', '{"author":"xaby"}', ' {"author":"ab"} \t', '{"author":"x","author":"ab"}', '{"_end":"x","author":"ab"}']),
    (FilterSpec("author", "^A.$", regex=True), ['{"author":"AB"}']),
    (FilterSpec("author", "^x+a", regex=True), ['{"author":"xaby"}']),
])
def test_filter_edge_lines(spark, spec, want):
    table = spark.createDataFrame([(x,) for x in GOOD + BAD], "value string")
    got = [r.value for r in filter_lines(table, spec).collect()]
    assert sorted(got) == sorted(want)
    assert sorted(r.value for r in filter_lines(filter_lines(table, spec), spec).collect()) == sorted(want)


def test_tagging_counts_bad_lines(spark):
    table = spark.createDataFrame([(x,) for x in GOOD + BAD + ["", ""]], "value string")
    tagged = tag_matches(table, FilterSpec("author", "ab"))
    assert tagged.where("is_bad").count() == len(BAD)
    assert tagged.where("matched").count() == 4
    assert tagged.count() == len(GOOD) + len(BAD) + 2


SITE = "https://www.reddit.com"
ROWS = [
    ('{"author":"AB"}', dict(author="u/AB", created="None", link=SITE + "/r//comments//_//", text="", title="")),
    ("null", dict(author="", created="None", link=SITE + "/r//comments//_//", score="")),
    ('{"author":7,"selftext":7,"url":7}', dict(author="", text="", url="")),
    ('{"created_utc":1700000000}', dict(created="2023-11-14 22:13")),
    ('{"created_utc":"1700000000"}', dict(created="2023-11-14 22:13")),
    ('{"created_utc":1700000000.9}', dict(created="2023-11-14 22:13")),
    ('{"created_utc":-0.5}', dict(created="1970-01-01 00:00")),
    ('{"created_utc":"abc"}', dict(created="1970-01-01 00:00")),
    ('{"created_utc":"12.5"}', dict(created="1970-01-01 00:00")),
    ('{"created_utc":null}', dict(created="1970-01-01 00:00")),
    ('{"created_utc":true}', dict(created="1970-01-01 00:00")),
    ('{"created_utc":"99999999999999999999"}', dict(created="1970-01-01 00:00")),
    ('{"permalink":""}', dict(link=SITE)),
    ('{"permalink":"/r/a/"}', dict(link=SITE + "/r/a/")),
    ('{"permalink":null,"subreddit":"s","link_id":"t3_q","id":"z"}', dict(link=SITE + "/r/s/comments/q/_/z/")),
    ('{"subreddit":"s","link_id":"t3_t3_q","id":5}', dict(link=SITE + "/r/s/comments/t3_q/_//")),
    ('{"score":1234567,"title":null}', dict(score="1.234567e+06", title="<nil>")),
    ('{"score":12.50,"title":true}', dict(score="12.5", title="true")),
    ('{"title":[1,"a b",{"k":null,"a":1e6}]}', dict(title="[1 a b map[a:1e+06 k:<nil>]]")),
    ('{"title":{}}', dict(title="map[]")), ('{"title":[]}', dict(title="[]")),
    ('{"title":["q\\"\\n\\\\",[[]]]}', dict(title='[q"\n\\ [[]]]')),
]


def test_projected_columns(spark):
    table = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(ROWS)], "i int, value string")
    got = {r.i: r.asDict() for r in project_submission(table, keep=("i",)).collect()}
    for i, (line, want) in enumerate(ROWS):
        assert {k: got[i][k] for k in want} == want, line


def test_comment_columns(spark):
    table = spark.createDataFrame([('{"author":"a","body":"b","score":-3}',)], "value string")
    row = project_comment(table).first()
    assert row.asDict() == dict(author="u/a", score="-3", created="None", link=SITE + "/r//comments//_//", body="b")


def test_plain_numbers(spark):
    table = parsed(spark, ['{"k":1234567}', '{"k":12}'], ["k"])
    assert [r.t for r in table.select(default_text(F.col("k"), "plain").alias("t")).collect()] == ["1234567", "12"]


def test_zeros_keep_their_sign(spark):
    cases = {
        '{"a":-0}': "-0", '{"a":-0.0}': "-0", '{"a":-0e5}': "-0", '{"a":-0.00E-7}': "-0", '{"a": -0 }': "-0",
        '{"a":0}': "0", '{"a":-0.5}': "-0.5", '{"a":1e-0}': "1", '{"a":10e-01}': "1", '{"a":-0.0e0,"a":7}': "7",
        '{"a":[-0,0,"-0"]}': "[-0 0 -0]", '{"a":{"k":-0,"l":":-0,"}}': "map[k:-0 l::-0,]",
        '{"a":"say \\"-0\\", -0 \\\\","b":-0}': 'say "-0", -0 \\', '{"a":-00}': None, '{"a":--0}': None, '{"a":1-0}': None,
        '{"a":-0.}': None, '{"a":-0e}': None, '{"a":"-0': None, '{"a":-0} \\"': None,
    }
    rows = parsed(spark, list(cases), ["a"]).select("value", "is_bad", default_text(F.col("a")).alias("t")).collect()
    assert {r.value: None if r.is_bad else r.t for r in rows} == cases


def test_long_digit_runs_that_fit_are_good(spark):
    lines = ['{"a":' + "0." + "1" * 400 + "}", '{"a":' + "1" * 308 + "}", '{"a":' + "1" * 310 + "}", '{"a":1' + "0" * 250 + "e60}"]
    assert [r.is_bad for r in parsed(spark, lines, []).collect()] == [False, False, True, True]
