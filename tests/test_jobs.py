"""Arithmetic, comparison, keyed files, queues and skewed input."""

from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from zonedeck.functions import clock, text
from zonedeck.functions.money import rounded, store, whole_power
from zonedeck.operators import audit as A
from zonedeck.operators import batch as B
from zonedeck.operators import keyed as K
from zonedeck.operators import queues as Q
from zonedeck.operators import reconcile as R
from zonedeck.operators.lookup import lookup_join
from zonedeck.operators.ordering import position, running_total
from zonedeck.plans import carriers as C


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def dec(value, kind="decimal(11,2)"):
    return F.lit(value).cast(kind)


@pytest.mark.parametrize("value,mode,result", [
    ("1221.875", "half_up", "1221.88"), ("-1221.875", "half_up", "-1221.88"),
    ("1221.875", "truncate", "1221.87"), ("-1221.875", "truncate", "-1221.87")])
def test_rounding(spark, value, mode, result):
    assert one(spark, rounded(dec(value, "decimal(10,3)"), 2, mode)) == Decimal(result)


def test_size_error_is_null(spark):
    assert one(spark, store(dec("12345.00"), 6, 2)) is None


def test_powers_keep_28_digits(spark):
    from decimal import getcontext
    getcontext().prec = 50
    base = Decimal("1.004375")
    got = one(spark, whole_power(dec("1.004375", "decimal(7,6)"), F.lit(120)))
    assert abs(got - base ** 120) < Decimal("1e-25")
    assert one(spark, whole_power(dec("1.02", "decimal(3,2)"), F.lit(0))) == 1
    assert abs(one(spark, whole_power(dec("1.5", "decimal(3,1)"), F.lit(40))) - Decimal("1.5") ** 40) < Decimal("1e-6")
    assert one(spark, whole_power(dec("9.0", "decimal(3,1)"), F.lit(360))) is None


def test_samples(spark):
    compound = B.compound_interest(dec("10000.00"), dec("5.25", "decimal(5,2)"), F.lit(12), F.lit(10))
    assert one(spark, compound) == Decimal("16885.24")
    assert one(spark, B.loan_payment(dec("250000.00"), dec("6.50", "decimal(5,2)"), F.lit(30))) == Decimal("1580.17")
    assert one(spark, B.loan_payment(dec("250000.00"), dec("0.00", "decimal(5,2)"), F.lit(30))) is None


@pytest.mark.parametrize("mode,result", [("half_up", ("1221.88", "268.81", "953.07")), ("truncate", ("1221.87", "268.81", "953.06"))])
def test_payroll_sample(spark, mode, result):
    df = spark.range(1).select(dec("42.50", "decimal(5,2)").alias("h"), dec("28.75", "decimal(7,2)").alias("r"),
                               dec("22.00", "decimal(5,2)").alias("t"))
    row = B.payroll(df, "h", "r", "t", rounding=mode).first()
    assert (row.gross_pay, row.tax_amount, row.net_pay) == tuple(map(Decimal, result))


def test_dates(spark):
    day = lambda s: F.to_date(F.lit(s))
    assert one(spark, clock.integer_of_date(day("1601-01-01"))) == 1
    assert one(spark, clock.integer_of_date(day("2024-01-15"))) == 154512
    assert one(spark, clock.abstime(F.lit("2024-01-15").cast("timestamp"))) == 3914265600000
    assert one(spark, clock.date_of_yyyymmdd(F.lit(20240231))) is None


def test_edited_pictures(spark):
    assert one(spark, text.edited_amount(dec("1234.50"), 9)) == "      1234.50"
    assert one(spark, text.edited_count(F.lit(0), 9)) == " " * 9
    assert one(spark, text.edited_count(F.lit(42), 9)) == "       42"


# Expected, actual, tolerance, verdict.
PAIRS = [
    ("Maturity Amount:  16885.24", "Maturity Amount: 16885.24", "0.0001", "pass"),
    ("16885.24", "16885.2399", "0.0001", "pass"),
    ("16885.24", "16885.2300", "0.0001", "value_mismatch"),
    ("1234.5678", "1234.4999", "0.0001", "value_mismatch"),
    ("Gross: 100.00 Net: 80.00", "Gross: 100.00", "0.0001", "count_mismatch"),
    ("Gross Pay  :  1221.88\nTax Amount :   268.81", "Gross Pay  : 1221.88\nTax Amount : 268.81", "0.0001", "pass"),
    ("1.00000", "1.00001", "0.00001", "pass"),
    ("1.00000", "1.00002", "0.00001", "value_mismatch"),
    ("Gross Pay: 100.00", "Net Pay: 100.00", "0.0001", "label_mismatch"),
    ("0.3", "0.30000000000000004", "0.0001", "pass"),
    ("1.0", "1.00010000001", "0.0001", "value_mismatch"),
    ("x 123456789012345678901234567890", "x 123456789012345678901234567891", "0.0001", "value_mismatch"),
    ("x 123456789012345678901234567890", "X  123456789012345678901234567890", "0.0001", "pass"),
    ("no numbers", "No   Numbers", "0.0001", "pass"),
    (None, "1", "0.0001", "skipped"),
]


@pytest.mark.parametrize("expected,actual,tolerance,verdict", PAIRS)
def test_comparison(spark, expected, actual, tolerance, verdict):
    df = spark.createDataFrame([(expected, actual)], "expected string, actual string")
    assert R.check_equivalence(df, tolerance=tolerance).first().verdict == verdict


def test_numeric_tokens(spark):
    from zonedeck.functions.compare import numeric_tokens
    got = one(spark, numeric_tokens(F.lit("a 1,234.56 2024-01-15 .5 +7.0 1e5")))
    assert got == ["1", "234.56", "2024", "-01", "-15", "5", "7.0", "1", "5"]


def test_reconcile_reports_sides_and_repeats(spark):
    e = spark.createDataFrame([(1, "a 1"), (2, "b 2"), (3, "c 3"), (3, "c 3")], "k int, text string")
    a = spark.createDataFrame([(1, "A 1.00001"), (3, "c 3"), (4, "d")], "k int, text string")
    assert {r.k: r.verdict for r in R.reconcile(e, a, "k").collect()} == {
        1: "pass", 2: "missing_actual", 3: "duplicate_key", 4: "missing_expected"}


def test_diff_rows(spark):
    df = spark.createDataFrame([(1, "a 1.00 b 2.00", "a 1.00 b 2.01")], "k int, expected string, actual string")
    row = R.diff_rows(R.check_equivalence(df), ["k"]).first()
    assert (row.token, row.message) == (2, "Token 2: expected=2.00 actual=2.01 diff=0.0100")


# ---------------------------------------------------------------- skew

@pytest.fixture(scope="module")
def hot(spark):
    """Half of all rows carry key 0."""
    return spark.range(4000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 97).alias("k"), F.col("id").alias("n"))


def test_salted_lookup_equals_a_plain_join(spark, hot):
    file = spark.range(90).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    plain = hot.join(file, "k", "left")
    salted = lookup_join(hot, file, ["k"], small=False, rows_per_task=100)
    assert salted.count() == 4000 and salted.exceptAll(plain).count() == 0
    with_null = hot.unionByName(spark.createDataFrame([(None, -1)], "k bigint, n bigint"))
    assert lookup_join(with_null, file, ["k"], small=False, rows_per_task=100).count() == 4001


def test_salting_spreads_the_hot_key(spark, hot):
    """The key with half of the rows ends up in more than one join partition."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        file = spark.range(90).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
        joined = lookup_join(hot, file, ["k"], small=False, rows_per_task=100).where("k = 0")
        assert joined.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_left_side_stands_once(spark):
    """Neither a scan nor a computed left side is in the plan more than once, with or without heavy keys."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
        orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").withColumnRenamed("o_orderkey", "l_orderkey")
        made = lines.groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
        plain = made.join(orders, "l_orderkey", "left")
        for left in (lines, made):
            for rows in (5, 10 ** 6):
                plan = lookup_join(left, orders, ["l_orderkey"], rows_per_task=rows)._jdf.queryExecution().executedPlan().toString()
                assert plan.count("orders.parquet") == 1 and plan.count("Aggregate") == 0
                assert plan.count("Scan parquet") == 2
        assert lookup_join(made, orders, ["l_orderkey"], rows_per_task=5).select(plain.columns).exceptAll(plain).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_broadcast_needs_a_measured_size(spark):
    """Texts a plan makes up are measured, because the estimate takes every text for 20 bytes."""
    from zonedeck.session import scans_only, fits_broadcast, plan_bytes
    stored = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    assert scans_only(stored.select("c_name", (F.col("c_custkey") + 1).alias("n"))) and fits_broadcast(stored)
    long = stored.select("c_custkey", F.repeat(F.col("c_name"), 10000).alias("t"))
    assert plan_bytes(long) < 1 << 20 and not scans_only(long) and not fits_broadcast(long)
    rows = stored.select(F.explode(F.sequence(F.lit(1), F.lit(20000))).alias("i"), "c_name")
    assert not scans_only(rows) and not fits_broadcast(rows)


def test_salting_spreads_equal_copies(spark):
    """All rows the same: the copies still end up in more than one join partition."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        copies = spark.range(0, 4000, 1, 8).select(F.lit(1).cast("bigint").alias("k"), F.lit("same").alias("t"))
        file = spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("v"))
        joined = lookup_join(copies, file, ["k"], small=False, rows_per_task=100)
        parts = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(parts) > 1 and sum(r["count"] for r in parts) == 4000 and joined.where("v = 1").count() == 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("descending", [False, True])
def test_running_total_equals_a_window(spark, hot, descending):
    """Values with a third of all rows at one point of the order, cut along the second column."""
    df = hot.withColumn("t", F.when(F.col("n") % 3 == 0, 500).otherwise(F.col("n")))
    way = F.desc if descending else F.asc
    w = Window.partitionBy("k").orderBy(way("t"), way("n")).rowsBetween(Window.unboundedPreceding, 0)
    expected = df.withColumn("s", F.sum("n").over(w))
    got = running_total(df, ["k"], ["t", "n"], F.col("n"), "s", buckets=16, descending=descending)
    assert got.exceptAll(expected).count() == 0 and got.count() == 4000


def test_hot_value_is_cut_into_ranges(spark, hot):
    from zonedeck.operators.ordering import with_ranges
    placed = with_ranges(hot.withColumn("t", F.when(F.col("n") % 3 == 0, 500).otherwise(F.col("n"))), ["t", "n"], 16, ["k"])
    assert placed.where("t = 500").select("_b").distinct().count() >= 5
    assert placed.groupBy("_b").count().agg(F.max("count")).first()[0] < 800


@pytest.mark.parametrize("stray", [None, "Z", "", "key-000000"])
def test_positions_over_strings_with_a_common_prefix(spark, stray):
    """Whatever the first characters are, and with a key far from all others, the rows spread over all ranges."""
    from zonedeck.operators.ordering import with_ranges
    df = spark.range(3000).select(F.concat(F.lit("ABCkey-000000"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("s"))
    if stray is not None:
        df = df.unionByName(spark.createDataFrame([(stray,)], "s string"))
    expected = df.withColumn("p", F.row_number().over(Window.orderBy("s")).cast("bigint"))
    assert position(df, [], ["s"], "p", buckets=20).exceptAll(expected).count() == 0
    sizes = [r["count"] for r in with_ranges(df, ["s"], 20).groupBy("_b").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 3 * 3000 / 20


def test_ranges_of_any_type(spark):
    from decimal import Decimal

    from zonedeck.operators.ordering import with_ranges
    df = spark.range(900).select((F.col("id") * 7 % 900).alias("n"), (F.col("id") * 7 % 900 * Decimal("0.01")).cast("decimal(9,2)").alias("d"),
                                 F.timestamp_millis(F.col("id") * 7 % 900 * 1000).alias("t"), F.encode(F.lpad(F.hex(
                                     F.col("id") * 7 % 900), 5, "0"), "UTF-8").alias("b"))
    df = df.withColumn("y", F.col("t").cast("date"))
    for c in "ndtb":
        placed = with_ranges(df, [c], 9)
        ends = placed.groupBy("_b").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("n")).orderBy("_b").collect()
        assert len(ends) == 9 and all(a.high < b.low for a, b in zip(ends, ends[1:]))
        assert position(df, [], [c], "p", buckets=9).where("p <> n + 1").count() == 0
    assert position(df.select("n", "y"), [], ["y", "n"], "p", buckets=9).where("p <> n + 1").count() == 0
    assert position(df.limit(0), [], ["n"], "p", buckets=9).count() == 0


def test_browse_orders_the_file_once(spark):
    from zonedeck.operators.keyed import browse_many
    file = spark.range(0, 4000, 2).select(F.col("id").alias("k"), (F.col("id") + 1).alias("v"))
    requests = spark.range(50).select(F.col("id").alias("r"), (F.col("id") * 91).alias("start"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = browse_many(requests, file, "k", "start", 3)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_positions_with_null_keys(spark):
    df = spark.createDataFrame([(None, i) for i in range(50)] + [("a", i) for i in range(50)], "k string, n int")
    got = position(df, ["k"], ["n"], "p", buckets=4)
    assert got.where(F.col("p") != F.col("n") + 1).count() == 0 and got.count() == 100


# ---------------------------------------------------------------- keyed files

@pytest.fixture(scope="module")
def file(spark):
    return spark.createDataFrame([("A", 10), ("B", 20), ("C", 30)], "k string, v int")


def test_insert_first_wins(spark, file):
    rows = spark.createDataFrame([("D", 1, 2), ("D", 2, 1), ("A", 3, 3)], "k string, v int, seq int")
    changed = K.insert_keyed(file, rows, "k", "seq")
    assert {(r.k, r.v) for r in changed.file.collect()} == {("A", 10), ("B", 20), ("C", 30), ("D", 2)}
    assert {(r.k, r.seq): r.resp for r in changed.responses.collect()} == {("D", 2): 14, ("D", 1): 0, ("A", 3): 14}


def test_delete_twice(spark, file):
    requests = spark.createDataFrame([("A", 1), ("A", 2), ("Z", 3)], "k string, seq int")
    changed = K.delete_keyed(file, requests, "k", "seq")
    assert {r.k for r in changed.file.collect()} == {"B", "C"}
    assert {(r.k, r.seq): r.resp for r in changed.responses.collect()} == {("A", 1): 0, ("A", 2): 13, ("Z", 3): 13}


def test_rewrite_reports_missing_keys(spark):
    accounts = spark.createDataFrame([("A", Decimal("1.00"))], "k string, b decimal(9,2)")
    deposits = spark.createDataFrame([("A", Decimal("2.50")), ("A", Decimal("0.25")), ("X", Decimal("9.00"))], "k string, d decimal(9,2)")
    changed = K.rewrite_keyed(accounts, deposits, "k", "d", "b")
    assert [(r.k, r.b) for r in changed.file.collect()] == [("A", Decimal("3.75"))]
    assert {r.k: (r.updates, r.resp) for r in changed.responses.collect()} == {"A": (2, 0), "X": (1, 13)}


def test_browse_reaches_both_ends(spark, file):
    asked = spark.createDataFrame([(1, "B"), (2, "B"), (3, "Z"), (4, "")], "r int, s string")
    rows = K.browse_many(asked, file, "k", "s", 3)
    got = {}
    for r in rows.orderBy("r", "read_no").collect():
        got.setdefault(r.r, []).append(r.k if r.resp == 0 else r.resp)
    assert got == {1: ["B", "C", 19], 2: ["B", "C", 19], 3: [19, 19, 19], 4: ["A", "B", "C"]}
    back = K.browse_many(asked, file, "k", "s", 2, reverse=True)
    got = {}
    for r in back.orderBy("r", "read_no").collect():
        got.setdefault(r.r, []).append(r.k if r.resp == 0 else r.resp)
    assert got == {1: ["B", "A"], 2: ["B", "A"], 3: ["C", "B"], 4: [19, 19]}


def test_browse_totals_modes(spark):
    orders = spark.createDataFrame([("AB%1", Decimal(1)), ("AB%2", Decimal(2)), ("ABC1", Decimal(4)), ("AC01", Decimal(8))],
                                   "k string, a decimal(9,2)")
    assert K.browse_total(orders, "k", "a", "AB%").first().total == 3  # no wildcard
    assert K.browse_total(orders, "k", "a", "ABC", mode="to_end").first().total == 12
    assert K.browse_total(orders, "k", "a", "ZZ").first().total == 0


def test_prefix_browse_reaches_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    plan = K.browse_total(orders, "c_name", "c_acctbal", "Customer#00")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(c_name,Customer#00)" in plan


def test_queue_continues_and_trims(spark):
    held = spark.createDataFrame([("Q", 1, "x"), ("Q", 2, "y")], "queue string, item bigint, data string")
    writes = spark.createDataFrame([("Q  ", "abcdef", 3, 1), ("Q", "zz", 9, 2), ("R", "r", 1, 3)],
                                   "queue string, data string, length int, seq int")
    got = Q.assign_queue_items(writes, ["seq"], held)
    assert {(r.queue, r.item): r.data for r in got.collect()} == {("Q", 3): "abc", ("Q", 4): "zz", ("R", 1): "r"}


def test_responses_are_thirty():
    assert len(K.RESPONSES) == 30 and K.RESPONSES["QIDERR"] == 44


def test_envelope(spark):
    rows = [("{}", "missing:python_code"), ('{"python_code": 1}', "missing:pytest_code"),
            ('{"python_code": 1, "pytest_code": null, "more": 2}', "ok"), ("[1]", "missing:python_code"), ("{", "invalid_json"), (None, "invalid_json")]
    df = spark.createDataFrame(rows, "response string, want string")
    assert A.check_envelope(df).where("verdict <> want").count() == 0


def test_bare_floats(spark):
    rows = [("x = 1.5", True), ("x = Decimal('1.5')", False), ("x = 2.0", False), ('x = Decimal("0.25")', False), ("no", False)]
    df = spark.createDataFrame(rows, "output string, want boolean")
    assert df.where(A.bare_float(F.col("output")) != F.col("want")).count() == 0


def test_control_totals_on_nothing(spark):
    empty = C.SALES.df(spark, "/root/testdata/sf0.001").where("sale_worth < 0")
    assert tuple(B.control_totals(empty, "sale_state", "sale_worth").first()) == (0, Decimal("0.00"), 0)


def test_null_status_is_an_error(spark):
    df = spark.createDataFrame([("A", Decimal("1.00")), (None, Decimal("2.00"))], "s string, a decimal(9,2)")
    assert tuple(B.control_totals(df, "s", "a").first()) == (1, Decimal("1.00"), 1)
