import csv
import io
from datetime import datetime, timedelta, timezone

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dumpsieve.functions import values
from dumpsieve.plans.csv_run import csv_lines


def general(x: float) -> str:
    """Shortest digits of a double; an exponent below 1e-4 and from 1e6 up."""
    if x == 0:
        return "0"
    mantissa, exponent = f"{abs(x):.17e}".split("e")
    for precision in range(17):
        mantissa, exponent = f"{abs(x):.{precision}e}".split("e")
        if float(f"{mantissa}e{exponent}") == abs(x):
            break
    digits, exponent = mantissa.replace(".", "").rstrip("0") or "0", int(exponent)
    sign = "-" if x < 0 else ""
    if exponent < -4 or exponent >= 6:
        tail = "." + digits[1:] if len(digits) > 1 else ""
        return f"{sign}{digits[0]}{tail}e{'-' if exponent < 0 else '+'}{abs(exponent):02d}"
    if exponent < 0:
        return sign + "0." + "0" * (-exponent - 1) + digits
    if len(digits) <= exponent + 1:
        return sign + digits.ljust(exponent + 1, "0")
    return sign + digits[: exponent + 1] + "." + digits[exponent + 1 :]


NUMBERS = st.one_of(
    st.integers(-(10**15), 10**15), st.integers(-2_000_000, 2_000_000),
    st.decimals(-(10**7), 10**7, places=4, allow_nan=False).map(float),
    st.sampled_from([1e-5, 0.0001, 1e5, 1e6, 999999, 1e21, 1.5e300, 123456789012345678, 0.1, -7]),
)


@settings(max_examples=3, deadline=None)
@given(st.lists(NUMBERS, min_size=200, max_size=200))
def test_number_text(spark, numbers):
    table = spark.createDataFrame([(repr(n), float(n)) for n in numbers], "j string, x double")
    got = table.select("j", "x", values.default_text(F.parse_json("j")).alias("t")).collect()
    assert [(r.j, r.t) for r in got] == [(r.j, general(r.x)) for r in got]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.integers(-62_135_596_800, 253_402_300_799), min_size=200, max_size=200))
def test_time_text(spark, seconds):
    table = spark.createDataFrame([(s,) for s in seconds], "s bigint")
    for row in table.select("s", values.format_created(F.col("s")).alias("t")).collect():
        moment = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=row.s)
        assert row.t == f"{moment.year:04d}-{moment:%m-%d %H:%M}"


def test_times_out_of_four_digits(spark):
    cases = {253402300800: "10000-01-01 00:00", -62135596801: "0000-12-31 23:59", -62167219201: "-0001-12-31 23:59",
             1700000000000: "55840-11-29 16:53", 0: "1970-01-01 00:00", -1: "1969-12-31 23:59"}
    table = spark.createDataFrame([(s,) for s in cases], "s bigint")
    got = {r.s: r.t for r in table.select("s", values.format_created(F.col("s")).alias("t")).collect()}
    assert {s: got[s] for s in cases if s != 1700000000000} == {s: t for s, t in cases.items() if s != 1700000000000}
    assert got[1700000000000].startswith("55840-")


FIELDS = {"a,b": '"a,b"', "x": "x", " x": '" x"', " x": '" x"', "\\.": '"\\."', "x\\.": "x\\.", 'a"b': '"a""b"',
          "": "", "\u0085z": '"\u0085z"', "a\nb": '"a\nb"', "a\rb": '"a\rb"', "a b": "a b", "​z": "​z", "'": "'"}


def test_csv_quoting(spark):
    table = spark.createDataFrame([(f,) for f in FIELDS], "f string")
    assert {r.f: r.q for r in table.select("f", values.csv_quote(F.col("f")).alias("q")).collect()} == FIELDS


def test_csv_lines_read_back(spark):
    rows = [(a, b) for a in FIELDS for b in FIELDS]
    table = spark.createDataFrame(rows, "a string, b string")
    text = "\n".join(r.value for r in csv_lines(table).collect())
    # The reader drops rows that are one empty line; there are none with two columns.
    assert [tuple(r) for r in csv.reader(io.StringIO(text, newline=""))] == rows
