"""Text checks agree with Python's strptime and float parsing, as the console client used them."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from medledger.functions.columns import parse_amount, parse_date, parse_time_sec, strip

DIGITS = st.text(alphabet="0123456789", min_size=0, max_size=5)
SEPS = st.sampled_from(["-", ":", " ", "/", ""])


def _py_date(s):
    try:
        return dt.datetime.strptime(s.strip(), "%Y-%m-%d").date()
    except ValueError:
        return None


def _py_time(s):
    try:
        t = dt.datetime.strptime(s.strip(), "%H:%M:%S")
        return t.hour * 3600 + t.minute * 60 + t.second
    except ValueError:
        return None


dates = st.one_of(
    st.builds(lambda y, a, m, b, d: f"{y}{a}{m}{b}{d}", DIGITS, SEPS, DIGITS, SEPS, DIGITS),
    st.dates(min_value=dt.date(1000, 1, 1)).map(lambda d: f"{d.year}-{d.month}-{d.day}"),
    st.dates(min_value=dt.date(1000, 1, 1)).map(lambda d: d.isoformat()),
    st.sampled_from(["2025-6-5", "2025-02-30", "25-06-05", " 2025-06-05 ", "2025-06- 5", "2024-02-29", "2025-13-01",
                     "2025-00-10", "2025-1-0", "\t2025-01-01\n"]),
)
times = st.one_of(
    st.builds(lambda h, a, m, b, s: f"{h}{a}{m}{b}{s}", DIGITS, SEPS, DIGITS, SEPS, DIGITS),
    st.sampled_from(["9:5:3", "10:00:60", "24:00:00", "23:59:59", "00:00:00", "7:07:7", " 10:00:00 ", "10:0:61"]),
)


@settings(max_examples=150, deadline=None)
@given(st.lists(dates, min_size=1, max_size=40), st.lists(times, min_size=1, max_size=40))
def test_date_and_time_match_strptime(spark, ds, ts):
    got_d = [r[0] for r in spark.createDataFrame([(d,) for d in ds], "s string")
             .select(parse_date("s")).collect()]
    assert got_d == [_py_date(d) for d in ds]
    got_t = [r[0] for r in spark.createDataFrame([(t,) for t in ts], "s string")
             .select(parse_time_sec("s")).collect()]
    assert got_t == [_py_time(t) for t in ts]


def test_strip_and_amounts(spark):
    rows = [(" \t a b \n",), ("　x ",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(strip("s")).collect()]
    assert got == ["a b", "x", "", None]
    amounts = ["100", "100.005", "abc", "0", "-5", "NaN", " 12.5 ", "1e3", "123456789.00"]
    got = [r[0] for r in spark.createDataFrame([(a,) for a in amounts], "s string")
           .select(parse_amount("s")).collect()]
    assert [str(x) if x is not None else None for x in got] == \
        ["100.00", "100.01", None, "0.00", "-5.00", None, "12.50", "1000.00", None]
    assert F is not None
