"""Queries over exact decimals, dates, texts and report lines, and output reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonedeck.functions import clock, text
from zonedeck.operators import batch as B
from zonedeck.operators import reconcile as R
from zonedeck.plans import carriers as C
from zonedeck.plans.records import recoded
from zonedeck.plans.registry import query
from zonedeck.session import spread

_NUM = r"-?\d+(?:\.\d+)?"


def _label(column):
    return f"trim(regexp_replace(lower(regexp_replace({column}, '{_NUM}', '', 'g')), '\\s+', ' ', 'g'))"


def _verdict(pairs):
    gap = "abs(CAST(z[1] AS DECIMAL(28,10)) - CAST(z[2] AS DECIMAL(28,10))) > 0.0001"
    return f"""
    (SELECT *, CASE WHEN len(exp_n) <> len(act_n) THEN 'count_mismatch'
                    WHEN len(list_filter(list_zip(exp_n, act_n), lambda z: {gap})) > 0 THEN 'value_mismatch'
                    WHEN {_label('expected')} <> {_label('actual')} THEN 'label_mismatch' ELSE 'pass' END AS verdict,
            CASE WHEN len(exp_n) = len(act_n) THEN list_filter(list_zip(exp_n, act_n, range(1, len(exp_n) + 1)), lambda z: {gap}) ELSE [] END AS gaps
     FROM (SELECT *, regexp_extract_all(expected, '{_NUM}') AS exp_n, regexp_extract_all(actual, '{_NUM}') AS act_n FROM {pairs}))"""


_PAIRS = _verdict(C.REPORT_PAIRS.sql)


def checked(spark, sf_dir):
    return R.check_equivalence(C.REPORT_PAIRS.df(spark, sf_dir))


@query("check_equivalence", f"""
    SELECT l_orderkey, l_partkey, verdict, CAST(len(exp_n) AS INTEGER) AS tokens, CAST(len(gaps) AS INTEGER) AS differing FROM {_PAIRS}""")
def check_equivalence(spark, sf_dir):
    return checked(spark, sf_dir).select("l_orderkey", "l_partkey", "verdict", "tokens",
                                         F.coalesce(F.size("diffs"), F.lit(0)).alias("differing"))


@query("equivalence_diffs", f"""
    SELECT l_orderkey, l_partkey, CAST(g[3] AS INTEGER) AS token, g[1] AS expected, g[2] AS actual,
           CAST(abs(CAST(g[1] AS DECIMAL(28,10)) - CAST(g[2] AS DECIMAL(28,10))) AS DECIMAL(12,4)) AS diff
    FROM (SELECT l_orderkey, l_partkey, unnest(gaps) AS g FROM {_PAIRS})""")
def equivalence_diffs(spark, sf_dir):
    rows = R.diff_rows(checked(spark, sf_dir), ["l_orderkey", "l_partkey"])
    return rows.select("l_orderkey", "l_partkey", "token", "expected", "actual", F.col("diff").cast("decimal(12,4)").alias("diff"))


@query("reconcile", f"""
    WITH met AS (SELECT coalesce(e.key, a.key) AS key, e.text AS expected, a.text AS actual
                 FROM {C.EXPECTED_LINES.sql} e FULL JOIN {C.ACTUAL_LINES.sql} a ON a.key = e.key)
    SELECT key, verdict FROM {_verdict("(SELECT * FROM met WHERE expected IS NOT NULL AND actual IS NOT NULL)")}
    UNION ALL SELECT key, CASE WHEN expected IS NULL THEN 'missing_expected' ELSE 'missing_actual' END
    FROM met WHERE expected IS NULL OR actual IS NULL""")
def reconcile(spark, sf_dir):
    return R.reconcile(C.EXPECTED_LINES.df(spark, sf_dir), C.ACTUAL_LINES.df(spark, sf_dir), "key").select("key", "verdict")


def lines(spark, sf_dir):
    return spread(C.table(spark, sf_dir, "lineitem")).select(
        "l_orderkey", "l_partkey", F.col("l_extendedprice").cast("decimal(11,2)").alias("price"),
        F.col("l_quantity").cast("decimal(7,2)").alias("quantity"), F.col("l_discount").cast("decimal(4,2)").alias("discount"))


_LINES = """(SELECT l_orderkey, l_partkey, CAST(round(l_extendedprice * 100) AS HUGEINT) AS p,
                    CAST(round(l_quantity * 100) AS HUGEINT) AS q, CAST(round(l_discount * 100) AS HUGEINT) AS d FROM lineitem)"""


def _money(cents):
    return f"CAST(CAST({cents} AS DECIMAL(38,0)) / 100 AS DECIMAL(11,2))"


def _posted(rounding):
    # In hundredths: p*q has four decimals, p*(1-d) has four, the quotient is cut to two.
    half = "+ 50" if rounding == "half_up" else ""
    return {
        "line_total": f"((p * q {half}) // 100)",
        "net_price": f"((p * (100 - d) {half}) // 100)",
        "discount_amount": f"(p - (p * (100 - d) {half}) // 100)",
        "price_plus": "(p + q)",
        "unit_price": "(p * 100 // q)",
    }


def _posted_sql(rounding):
    cells = ", ".join(f"{_money(e)} AS {n}" for n, e in _posted(rounding).items())
    rest = "CAST(CAST(p * 100 - (p * 100 // q) * q AS DECIMAL(38,0)) / 10000 AS DECIMAL(11,4)) AS unit_remainder"
    return f"SELECT l_orderkey, l_partkey, {cells}, {rest} FROM {_LINES}"


@query("post_amounts", _posted_sql("half_up"))
def post_amounts(spark, sf_dir):
    return B.post_amounts(lines(spark, sf_dir), "price", "quantity", "discount").good.drop("price", "quantity", "discount")


@query("post_amounts_truncated", _posted_sql("truncate"))
def post_amounts_truncated(spark, sf_dir):
    posted = B.post_amounts(lines(spark, sf_dir), "price", "quantity", "discount", rounding="truncate")
    return posted.good.drop("price", "quantity", "discount")


@query("post_amounts_rejects", f"""
    SELECT l_orderkey, l_partkey FROM {_LINES}
    WHERE (p * q + 50) // 100 >= 100000000 OR p + q >= 100000000 OR p * 100 // q >= 100000000""")
def post_amounts_rejects(spark, sf_dir):
    """Size errors: results that do not fit six integer digits."""
    posted = B.post_amounts(lines(spark, sf_dir), "price", "quantity", "discount", digits=8, scale=2)
    return posted.rejects.select("l_orderkey", "l_partkey")


_LOANS = """(SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(11,2)) AS amount,
             CAST(1 + (o_custkey % 40) * CAST(0.25 AS DECIMAL(3,2)) AS DECIMAL(5,2)) AS rate,
             CAST(CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 12 END AS INT) AS freq,
             CAST(1 + o_orderkey % 30 AS INT) AS years FROM {orders})"""


def loans(spark, sf_dir):
    orders = spread(C.table(spark, sf_dir, "orders"))
    return orders.selectExpr(
        "o_orderkey", "CAST(o_totalprice AS DECIMAL(11,2)) AS amount",
        "CAST(1 + (o_custkey % 40) * CAST(0.25 AS DECIMAL(3,2)) AS DECIMAL(5,2)) AS rate",
        "CAST(CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 12 END AS INT) AS freq",
        "CAST(1 + o_orderkey % 30 AS INT) AS years")


_L = _LOANS.format(orders="orders")


@query("interest", f"""
    SELECT o_orderkey,
           CAST(round(CAST(amount AS DOUBLE) * pow(1 + CAST(rate AS DOUBLE) / 100 / freq, freq * years), 2) AS DECIMAL(14,2)) AS compound,
           CAST(round(CAST(amount * rate * years AS DECIMAL(24,6)) * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(14,2)) AS simple
    FROM {_L}""")
def interest(spark, sf_dir):
    return loans(spark, sf_dir).select(
        "o_orderkey", B.compound_interest(F.col("amount"), F.col("rate"), F.col("freq"), F.col("years")).alias("compound"),
        B.simple_interest(F.col("amount"), F.col("rate"), F.col("years")).alias("simple"))


@query("loan_payment", f"""
    SELECT o_orderkey, CAST(round(amount * m / (1 - pow(1 + m, -12 * years)), 2) AS DECIMAL(11,2)) AS payment
    FROM (SELECT o_orderkey, years, CAST(amount AS DOUBLE) AS amount, round(CAST(rate AS DOUBLE) / 1200, 8) AS m FROM {_L})""")
def loan_payment(spark, sf_dir):
    return loans(spark, sf_dir).select(
        "o_orderkey", B.loan_payment(F.col("amount"), F.col("rate"), F.col("years")).alias("payment"))


def _payroll_sql(rounding, overtime):
    half = "+ 50" if rounding == "half_up" else ""
    earned = "CASE WHEN h > 4000 THEN (8000 * r + 3 * (h - 4000) * r) // 2 ELSE h * r END" if overtime else "h * r"
    gross = f"(({earned} {half}) // 100)"
    tax = f"(({gross} * t {'+ 5000' if half else ''}) // 10000)"
    cell = "CAST(CAST({} AS DECIMAL(38,0)) / 100 AS DECIMAL(11,2))".format
    return f"""
    SELECT l_orderkey, l_partkey, {cell(gross)} AS gross_pay, {cell(tax)} AS tax_amount, {cell(f'{gross} - {tax}')} AS net_pay
    FROM (SELECT l_orderkey, l_partkey, CAST(hours * 100 AS HUGEINT) AS h, CAST(rate * 100 AS HUGEINT) AS r,
                 CAST(tax_rate * 100 AS HUGEINT) AS t FROM {C.HOURS.sql})"""


def paid(spark, sf_dir, **options):
    return B.payroll(C.HOURS.df(spark, sf_dir), "hours", "rate", "tax_rate", **options).drop("hours", "rate", "tax_rate")


@query("payroll", _payroll_sql("half_up", False))
def payroll(spark, sf_dir):
    return paid(spark, sf_dir)


@query("payroll_overtime_truncated", _payroll_sql("truncate", True))
def payroll_overtime_truncated(spark, sf_dir):
    return paid(spark, sf_dir, overtime=True, rounding="truncate")


@query("cleanse_text", """
    SELECT p_partkey, upper(p_name) AS upper_name, lower(p_type) AS lower_type, length(p_name) AS name_length,
           split_part(p_name, ' ', 1) AS first_part,
           CASE WHEN strpos(p_name, ' ') > 0 THEN substr(p_name, strpos(p_name, ' ') + 1) END AS second_part,
           concat(rtrim(p_name), rtrim(p_brand)) AS joined, concat(split_part(p_name, ' ', 1), split_part(p_brand, '#', 1), '#') AS first_words,
           replace(p_name, 'ring', 'RING') AS replaced, translate(p_name, 'abc', 'xyz') AS converted,
           rpad(p_name, 8, ' ') AS moved, length(p_name) - length(replace(p_name, 'l', '')) AS l_count,
           CAST(p_retailprice AS DECIMAL(18,2)) AS price, CAST(NULL AS DECIMAL(18,2)) AS no_price
    FROM part""")
def cleanse_text(spark, sf_dir):
    name, brand = F.col("p_name"), F.col("p_brand")
    head, tail = text.unstring(name, " ")
    padded = F.concat(F.lit(" \t"), F.col("p_retailprice").cast("decimal(18,2)").cast("string"), F.lit("\n "))
    return C.table(spark, sf_dir, "part").select(
        "p_partkey", F.upper(name).alias("upper_name"), F.lower("p_type").alias("lower_type"),
        F.length(text.trim(F.concat(F.lit(" \n"), name, F.lit("\t")))).cast("bigint").alias("name_length"),
        head.alias("first_part"), tail.alias("second_part"),
        text.string_by_space(F.concat(name, F.lit("   ")), brand).alias("joined"),
        text.string_by_space(name, F.concat(F.substring_index(brand, "#", 1), F.lit("# x")), first_word=True).alias("first_words"),
        text.inspect_replacing(name, "ring", "RING").alias("replaced"),
        text.inspect_converting(name, "abc", "xyz").alias("converted"), text.move_text(name, 8).alias("moved"),
        text.tally(name, "l").alias("l_count"), text.numval(padded).alias("price"), text.numval(brand).alias("no_price"))


@query("number_functions", """
    SELECT c_custkey, greatest(bal, c_nationkey, 100) AS most, least(bal, c_nationkey, 100) AS fewest, abs(bal) AS size,
           CASE WHEN bal % 7 < 0 THEN bal % 7 + 7 ELSE bal % 7 END AS rest,
           CASE WHEN bal % -7 > 0 THEN bal % -7 - 7 ELSE bal % -7 END AS rest_below, CAST(NULL AS BIGINT) AS no_rest
    FROM (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(floor(c_acctbal) AS BIGINT) AS bal FROM customer)""")
def number_functions(spark, sf_dir):
    rows = spread(C.table(spark, sf_dir, "customer")).select(
        "c_custkey", F.col("c_nationkey").cast("bigint").alias("nation"), F.floor("c_acctbal").cast("bigint").alias("bal"))
    whole = lambda n: F.lit(n).cast("bigint")
    bal, nation = F.col("bal"), F.col("nation")
    return rows.select(
        "c_custkey", text.largest(bal, nation, whole(100)).alias("most"), text.smallest(bal, nation, whole(100)).alias("fewest"),
        text.absolute(bal).alias("size"), text.modulo(bal, whole(7)).alias("rest"),
        text.modulo(bal, whole(-7)).alias("rest_below"), text.modulo(bal, whole(0)).alias("no_rest"))


@query("calendar", """
    SELECT event_id, CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS INTEGER) AS yyyymmdd,
           CAST((year(ts) * 10000 + month(ts) * 100 + day(ts)) % 1000000 AS INTEGER) AS yymmdd,
           CAST(CAST(ts AS DATE) - DATE '1600-12-31' AS INTEGER) AS day_number,
           epoch_us(ts) // 1000 + 2208988800000 AS abstime, CAST(ts AS DATE) AS day_back, CAST(ts AS DATE) AS date_back,
           strftime(ts, '%H:%M:%S') AS clock_time FROM events""")
def calendar(spark, sf_dir):
    return B.calendar(C.table(spark, sf_dir, "events").select("event_id", "ts"), "ts").drop("ts")


@query("calendar_days", """
    SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS INTEGER) AS days_after,
           strftime(o_orderdate, '%Y%m%d%H%M%S') || '00+0000' AS date_text FROM orders""")
def calendar_days(spark, sf_dir):
    day = F.to_date("o_orderdate")
    start = F.to_date(F.lit("1995-01-01"))
    return C.table(spark, sf_dir, "orders").select(
        "o_orderkey", (clock.integer_of_date(day) - clock.integer_of_date(start)).alias("days_after"),
        clock.current_date_text(F.col("o_orderdate")).alias("date_text"))


@query("report_lines", """
    SELECT sale_rank, CASE WHEN a = 0 THEN '         ' ELSE lpad(CAST(a AS VARCHAR), greatest(9, length(CAST(a AS VARCHAR)))::INT, ' ') END || ' / '
           || CASE WHEN e = 0 THEN '         ' ELSE lpad(CAST(e AS VARCHAR), greatest(9, length(CAST(e AS VARCHAR)))::INT, ' ') END || ' TOTAL: $'
           || lpad(CAST(t AS VARCHAR), greatest(13, length(CAST(t AS VARCHAR)))::INT, ' ') AS line
    FROM (SELECT o_orderpriority AS sale_rank, count(*) FILTER (o_orderstatus = 'F') AS a,
                 count(*) FILTER (o_orderstatus <> 'F') AS e,
                 CAST(sum(CAST(o_totalprice AS DECIMAL(11,2))) FILTER (o_orderstatus = 'F') AS DECIMAL(38,2)) AS t
          FROM orders GROUP BY 1)""")
def report_lines(spark, sf_dir):
    records = recoded(spark, sf_dir, C.SALES, C.SALE_LAYOUT)
    return B.report_lines(B.control_totals(
        records, "sale_state", "sale_worth", by=["sale_rank"], accepted="F")).select("sale_rank", "line")
