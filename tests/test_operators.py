"""Signal and table operators on small cases."""

import datetime
import random

from pyspark.sql import functions as F

from sigloom.functions.dates import parse_date
from sigloom.operators import signals as S
from sigloom.operators import tables as O
from sigloom.sources import tables as T

DAY = datetime.date(2024, 1, 1)


def states(spark, values, key="k"):
    return spark.createDataFrame([(key, DAY + datetime.timedelta(i), v) for i, v in enumerate(values)], "key string, dt date, state int")


def test_holding_invariants(spark):
    r = random.Random(1)
    values = [r.choice([None, -1, 0, 0, 1]) for _ in range(200)]
    rows = sorted(S.holding_positions(states(spark, values), 4).collect(), key=lambda x: x.dt)
    assert len(rows) == 200
    held = 0
    for state, row in zip(values, rows):
        assert 0 <= row.age <= 4
        if row.age > 1:
            assert row.position == held and held != 0
        elif row.age == 1:
            assert row.position == state != 0
        else:
            assert row.position == 0 and not state
        held = row.position


def test_segments_and_zero_reversals(spark):
    df = states(spark, [1, 1, 0, 0, -1, 0, -1, None, None, 1])
    segs = sorted(S.segments(df).collect(), key=lambda x: x.seg)
    assert [(s.state, s.n_days) for s in segs] == [(1, 2), (0, 2), (-1, 1), (0, 1), (-1, 1), (None, 2), (1, 1)]
    assert [(z.before, z.after, z.n_days) for z in S.zero_segment_reversals(df).collect()] == [(1, -1, 2)]


def test_null_return_is_no_state(spark):
    df = spark.createDataFrame([(None,), (0.2,), (-0.2,), (0.0,)], "r double")
    assert [x.s for x in df.select(S.three_state(F.col("r"), -0.1, 0.1).alias("s")).collect()] == [None, 1, -1, 0]


def test_parity_reports_each_kind(spark):
    a = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 3.0, "c"), (4, 4.0, "d"), (5, 5.0, "e"), (5, 5.0, "e")], "id int, v double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-9, "a"), (2, 2.0, "b"), (3, 3.0, "x"), (6, 6.0, "f"), (5, 5.0, "e")], "id int, v double, s string")
    got = {(r.id, r.copy): r.difference for r in O.parity(a, b, ["id"], 1e-6).collect()}
    assert got == {(2, 1): "v", (3, 1): "s", (4, 1): "missing_right", (6, 1): "missing_left", (5, 2): "missing_right"}
    assert (1, 1) in {(r.id, r.copy) for r in O.parity(a, b, ["id"]).collect()}


def test_as_of_ties(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 5, 3)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 5, 10), ("a", 5, 11), ("a", 9, 12), ("a", 2, 9)], "k string, t int, v int")
    assert {r.id: r.asof_v for r in O.as_of(left, right, "k", "t", "t", ["v"]).collect()} == {1: 11, 2: None, 3: None}


def test_dates(spark):
    df = spark.createDataFrame([("2024-02-29",), ("20240229",), ("2024-02-30",), (None,)], "s string")
    got = [r.d for r in df.select(parse_date(F.col("s"), ("yyyy-MM-dd", "yyyyMMdd")).alias("d")).collect()]
    assert got == [datetime.date(2024, 2, 29), datetime.date(2024, 2, 29), None, None]


def test_results_are_written_once(spark, tmp_path):
    df = spark.range(3)
    T.write_result(df, str(tmp_path), "run1", "t")
    assert T.read_result(spark, str(tmp_path), "run1", "t").count() == 3
    try:
        T.write_result(df, str(tmp_path), "run1", "t")
    except Exception as e:
        assert "exist" in str(e).lower()
    else:
        raise AssertionError("an existing run was overwritten")


def test_file_formats_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 1.5), (2, None, None)], "id long, s string, x double")
    for fmt in ("parquet", "orc", "json", "csv", "xml"):
        options = {"header": "true", "rowTag": "row"}
        df.write.format(fmt).options(**options).save(f"{tmp_path}/{fmt}")
        back = spark.read.format(fmt).schema(df.schema).options(**options).load(f"{tmp_path}/{fmt}")
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect())), fmt


def test_plans_prune_and_push(spark):
    from sigloom.plans import catalog

    plan = catalog.queries()["filter_project"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "o_orderdate" not in plan


def test_long_fold_equals_short_fold(spark):
    r = random.Random(2)
    df = states(spark, [r.choice([None, -1, 0, 1]) for _ in range(300)])
    assert S.holding_positions(df, 3).exceptAll(S.holding_positions_long(df, 3)).isEmpty()


def test_package_runs_in_order_and_is_checked(spark, tmp_path, sf):
    from sigloom.plans import catalog, package

    q, seen = catalog.queries(), []
    steps = [(n, lambda s, d, n=n: seen.append(n) or q[n](s, d)) for n in ("daily_panel", "three_state")]
    package.run_package(spark, sf, str(tmp_path), "golden", steps)
    package.run_package(spark, sf, str(tmp_path), "today", steps)
    assert seen == ["daily_panel", "three_state"] * 2
    report = package.check_package(spark, str(tmp_path), "today", "golden", {n: ["key", "dt"] for n in ("daily_panel", "three_state")})
    assert {(r["table"], r["differences"], r["verdict"]) for r in report.collect()} == {("daily_panel", 0, "PASS"), ("three_state", 0, "PASS")}


def test_slices_equal_plain_windows(spark):
    from pyspark.sql import Window

    from sigloom.operators import slices

    r = random.Random(3)
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, r.choice(["a", "b", None]), t0 + datetime.timedelta(minutes=37 * i) if i % 50 else None, r.choice([None, r.random()])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp_ntz, v double")
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = df.select("id", F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("top"), (F.row_number().over(w) - 1).alias("no"), F.sum("v").over(w.rowsBetween(-6, 0)).alias("s"))
    got = slices.running_max(df, "k", "ts", ["ts", "id"], "v", "top", 7200)
    got = slices.numbered(got, "k", "ts", ["ts", "id"], "no", 7200)
    got = slices.rolling_rows(got, "k", "ts", ["ts", "id"], 7, F.sum("v"), "s", 7200, chunk=10)
    near = lambda rows: sorted((x.id, x.top, x.no, x.s and round(x.s, 9)) for x in rows)
    assert near(got.collect()) == near(want.collect())


def test_sliced_fold_and_null_keys(spark):
    """Short slices change nothing, and a null key is a key."""
    r = random.Random(8)
    df = states(spark, [r.choice([None, -1, 0, 1]) for _ in range(300)]).union(states(spark, [1, 0, 0, 0, -1], None))
    for hold in (1, 4):
        short = sorted(map(str, S.holding_positions(df, hold, slice_days=5).collect()))
        assert short == sorted(map(str, S.holding_positions_long(df, hold).collect())) and len(short) == 305


def test_parity_with_names_of_its_own(spark):
    a = spark.createDataFrame([(1, 2, "x", None), (None, 2, "y", 1)], "copy int, in_l int, difference string, l_copy int")
    b = spark.createDataFrame([(1, 3, "x", None), (None, 2, "y", 1)], "copy int, in_l int, difference string, l_copy int")
    out = O.parity(a, b, ["copy"])
    assert out.columns == ["copy", "copy_", "difference"] and [tuple(r) for r in out.collect()] == [(1, 1, "in_l")]


def test_merge_and_as_of_with_null_keys(spark):
    a = spark.createDataFrame([(None, 1), (2, 5)], "k int, v int")
    b = spark.createDataFrame([(None, 7), (3, 6)], "k int, v int")
    assert sorted(map(str, O.merge_signals({"x": a, "y": b, "z": b}, ["k"], "v").collect())) == sorted(["Row(k=None, x=1, y=7, z=7)", "Row(k=2, x=5, y=None, z=None)", "Row(k=3, x=None, y=6, z=6)"])
    left = spark.createDataFrame([(None, 5, 1), (1, 10**7, 2), (1, None, 3)], "k int, t int, id int")
    right = spark.createDataFrame([(None, 1, 8), (1, 4, 9), (1, 10**7 + 1, 7)], "k int, t int, v int")
    assert {r.id: r.asof_v for r in O.as_of(left, right, "k", "t", "t", ["v"]).collect()} == {1: None, 2: 9, 3: None}


def test_layouts_refuse_other_tables(spark):
    from sigloom.operators.layouts import COMPACT, conform

    df = spark.createDataFrame([("a", 1)], "key string, state long")
    try:
        conform(df, COMPACT)
    except ValueError as e:
        assert "state: bigint, not int" in str(e) and "dt: missing" in str(e)
    else:
        raise AssertionError("a table without the layout's columns was taken")


def test_report_is_one_page(spark, tmp_path):
    from sigloom.plans import reports

    df = spark.createDataFrame([("b|<", 2), ("a", 1)], "name string, n int")
    page = reports.read_report(spark, reports.write_report(reports.html_lines(df, ["name"], "T & t"), f"{tmp_path}/html"))
    assert page.index("<td>a</td>") < page.index("<td>b|&lt;</td>") < page.index("</table>") and "T &amp; t" in page
    assert [r.line for r in reports.markdown_lines(df, ["name"]).orderBy("line_no").collect()] == ["| name | n |", "|-|-|", "| a | 1 |", "| b\\|< | 2 |"]
