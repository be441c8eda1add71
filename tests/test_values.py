import datetime as dt

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Row, functions as F, types as T

from logtide.functions.values import comparable, describe, normal_type, normalize, render_row, row_size, same

L, D, S, B = T.LongType(), T.DoubleType(), T.StringType(), T.BinaryType()
NAN = float("nan")
CASES = [
    (None, L, None, L, True), (None, L, 0, L, False), ("", S, None, S, False), (5, L, 5, L, True), (5, L, 6, L, False),
    (5, L, 5.0, D, True), (5, L, 5.5, D, False), (NAN, D, NAN, D, True), (0.0, D, -0.0, D, True),
    (0.1, D, 0.10000000149011612, D, False), (b"\1\2", B, b"\1\2", B, True), (b"\1\2", B, b"\1\3", B, False),
    ("名前🙂", S, "名前🙂".encode(), B, True), ("名前🙂".encode(), B, "名前🙂", S, True), ("5", S, 5, L, False),
    (2**63 - 1, L, 2**63 - 1, L, True), (2**63 - 1, L, float(2**63 - 1), D, False),
    (9007199254740993, L, 9007199254740992.0, D, False), (-2**63, L, -(2.0**63), D, True), (0, L, NAN, D, False),
    (0, L, -0.0, D, True), (1, L, float("inf"), D, False), (None, S, None, B, True), ("", S, b"", B, True), (None, L, None, S, True),
]


@pytest.fixture(scope="module")
def matrix(spark):
    """Every case in one row, judged by `same` and by `comparable` text."""
    schema, values, out = [], [], []
    for i, (a, a_type, b, b_type, _) in enumerate(CASES):
        schema += [T.StructField(f"a{i}", a_type), T.StructField(f"b{i}", b_type)]
        values += [a, b]
        ca, cb = F.col(f"a{i}"), F.col(f"b{i}")
        out += [same(ca, cb, a_type, b_type).alias(f"same{i}"),
                (comparable(ca, a_type) == comparable(cb, b_type)).alias(f"text{i}")]
    return spark.createDataFrame([values], T.StructType(schema)).select(*out).first()


@pytest.mark.parametrize("at", range(len(CASES)))
def test_same(matrix, at):
    assert matrix[f"same{at}"] is CASES[at][4]
    assert matrix[f"text{at}"] is CASES[at][4]


@given(st.lists(st.tuples(st.integers(-2**63, 2**63 - 1), st.floats()), min_size=1, max_size=40))
@settings(max_examples=5, deadline=None)
def test_long_double_equality_is_exact(spark, pairs):
    def exact(whole, number):
        return number == number and abs(number) != float("inf") and number == int(number) and int(number) == whole

    pairs = pairs + [(w, float(w)) for w, _ in pairs]
    rows = spark.createDataFrame(pairs, "w bigint, d double")
    got = rows.select(same(F.col("w"), F.col("d"), L, D)).collect()
    assert [r[0] for r in got] == [exact(w, d) for w, d in pairs]


def test_normalize(spark):
    df = spark.sql("""SELECT 7 AS i, CAST(7 AS SMALLINT) AS s, CAST(-7 AS TINYINT) AS b, true AS t, CAST(12 AS DECIMAL(20,0)) AS n,
        CAST(1.5 AS DECIMAL(10,2)) AS d, CAST(0.1 AS FLOAT) AS f, 'text' AS x, X'01' AS y, CAST(NULL AS INT) AS z""")
    assert normalize(df).first() == Row(i=7, s=7, b=-7, t=1, n=12, d=1.5, f=0.10000000149011612, x="text", y=bytearray(b"\1"), z=None)


def test_refuses_other_types_and_numbers_that_do_not_fit(spark):
    for refused in (T.TimestampType(), T.DateType(), T.ArrayType(L), T.StructType()):
        with pytest.raises(TypeError):
            normal_type(refused)
    with pytest.raises(Exception, match="OVERFLOW|CAST|out of range"):
        normalize(spark.sql("SELECT CAST('18446744073709551616' AS DECIMAL(38,0)) AS n")).collect()


def test_describe_and_render(spark):
    df = spark.createDataFrame([(1, "x" * 50, bytes(3), None, 2.5)], "id bigint, t string, b binary, n bigint, d double")
    types = {f.name: f.dataType for f in df.schema.fields}
    assert list(df.select(*[describe(F.col(c), types[c]) for c in "tbnd"]).first()) == [
        "'" + "x" * 40 + "…'", "3 bytes", "NULL", "2.5"]
    assert df.select(render_row(df, "id")).first()[0] == "1|b=x000000|d=2.5|n=NULL|t='" + "x" * 50 + "'\n"


def test_row_size(spark):
    df = spark.createDataFrame([(1, "ab🙂", bytes(3), None)], "id bigint, t string, b binary, n string")
    assert df.select(row_size(df)).first()[0] == 16 + 16 + (2 * 4 + 40) + (3 + 16) + 16


def test_timestamps_are_seconds(spark):
    from logtide.functions.times import expired, kept, seconds_of
    at = dt.datetime(2024, 1, 16)
    df = spark.createDataFrame([(at,), (dt.datetime(1969, 1, 1),), (None,)], "t timestamp_ntz")
    assert [r[0] for r in df.select(seconds_of(df, "t")).collect()] == [1705363200, -31536000, None]
    for cutoff, gone in ((1705363200, 0), (1705363201, 1)):
        assert df.filter(expired(df, "t", cutoff)).count() == gone
        assert df.filter(kept(df, "t", cutoff)).count() == 3 - gone


def test_latest_state_by_numbers(spark):
    from logtide.operators.changelog import latest_state
    rows = [("a", 1, "x", 5, {"k": 1}), ("a", 2, None, 6, None), ("a", 3, "y", None, None), ("b", 9, None, None, None), (None, 1, "n", None, {"z": 0}), (None, 2, None, 8, None)]
    df = spark.createDataFrame(rows, "key string, seq bigint, `v.1` string, n int, m map<string,int>")
    got = {r[0]: tuple(r)[1:] for r in latest_state(df, "key", "seq").collect()}
    assert got == {"a": ("y", 6, {"k": 1}), "b": (None, None, None), None: ("n", 8, {"z": 0})}
    shown = latest_state(df, "key", "seq", shown_with="v.1")
    assert {r[0] for r in shown.collect()} == {"a", None}
    assert "SortAggregate" not in shown._jdf.queryExecution().executedPlan().toString()
