"""Queries over keyed files and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonedeck.operators import keyed as K
from zonedeck.operators import queues as Q
from zonedeck.plans import carriers as C
from zonedeck.plans.registry import query


def customers(spark, sf_dir):
    return C.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust_no"), "c_name")


_ASKED = C.DEPOSITS.sql
_READ = f"""
    SELECT r.order_no, r.cust_no, c.c_name, CASE WHEN c.c_custkey IS NULL THEN 13 ELSE 0 END AS resp
    FROM {_ASKED} r LEFT JOIN customer c ON c.c_custkey = r.cust_no"""


def reads(spark, sf_dir):
    requests = C.DEPOSITS.df(spark, sf_dir).select("order_no", "cust_no")
    return K.read_keyed(requests, customers(spark, sf_dir), "cust_no")


@query("read_keyed", _READ)
def read_keyed(spark, sf_dir):
    return reads(spark, sf_dir)


@query("read_partial_key", """
    SELECT l_orderkey, p_name, CASE WHEN p_partkey IS NULL THEN 13 ELSE 0 END AS resp
    FROM lineitem LEFT JOIN part ON p_partkey = l_partkey + l_linenumber % 2""")
def read_partial_key(spark, sf_dir):
    """Request keys carry a suffix beyond the key length; some point past the last part."""
    code = lambda number: F.lpad(number.cast("string"), 12, "0")
    wanted = F.col("l_partkey") + F.col("l_linenumber") % 2
    requests = C.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.concat(code(wanted), F.lit("-"), F.col("l_returnflag")).alias("prod_code"))
    parts = C.table(spark, sf_dir, "part").select(code(F.col("p_partkey")).alias("prod_code"), "p_name")
    return K.read_partial_key(requests, parts, "prod_code", 12).drop("prod_code")


_SUMMED = f"(SELECT cust_no, sum(amount) AS total, count(*) AS updates FROM {_ASKED} GROUP BY cust_no)"


@query("rewrite_keyed", f"""
    SELECT a.cust_no, a.name, CAST(a.balance + coalesce(s.total, 0) AS DECIMAL(18,2)) AS balance
    FROM {C.ACCOUNTS.sql} a LEFT JOIN {_SUMMED} s ON s.cust_no = a.cust_no""")
def rewrite_keyed(spark, sf_dir):
    return K.rewrite_keyed(C.ACCOUNTS.df(spark, sf_dir), C.DEPOSITS.df(spark, sf_dir), "cust_no", "amount", "balance").file


@query("rewrite_keyed_responses", f"""
    SELECT s.cust_no, CAST(s.total AS DECIMAL(21,2)) AS amount, s.updates,
           CASE WHEN a.cust_no IS NULL THEN 13 ELSE 0 END AS resp
    FROM {_SUMMED} s LEFT JOIN {C.ACCOUNTS.sql} a ON a.cust_no = s.cust_no""")
def rewrite_keyed_responses(spark, sf_dir):
    changed = K.rewrite_keyed(C.ACCOUNTS.df(spark, sf_dir), C.DEPOSITS.df(spark, sf_dir), "cust_no", "amount", "balance")
    return changed.responses


@query("replace_keyed", """
    WITH last AS (SELECT user_id * 3 AS cust_no, max_by(concat(event_type, '-', CAST(event_id AS VARCHAR)), event_id) AS c_name
                  FROM events GROUP BY 1)
    SELECT c.c_custkey AS cust_no, coalesce(l.c_name, c.c_name) AS c_name
    FROM customer c LEFT JOIN last l ON l.cust_no = c.c_custkey""")
def replace_keyed(spark, sf_dir):
    updates = C.table(spark, sf_dir, "events").select(
        (F.col("user_id") * 3).alias("cust_no"), "event_id",
        F.concat("event_type", F.lit("-"), F.col("event_id").cast("string")).alias("c_name"))
    return K.replace_keyed(customers(spark, sf_dir), updates, "cust_no", "event_id").file


_BATCH = "(SELECT user_id * 20 AS cust_no, event_id, event_type AS c_name FROM events)"
_JUDGED = f"""
    (SELECT b.*, CASE WHEN c.c_custkey IS NOT NULL THEN 14
                      WHEN row_number() OVER (PARTITION BY b.cust_no ORDER BY b.event_id) > 1 THEN 14 ELSE 0 END AS resp
     FROM {_BATCH} b LEFT JOIN customer c ON c.c_custkey = b.cust_no)"""


def inserted(spark, sf_dir):
    batch = C.table(spark, sf_dir, "events").select(
        (F.col("user_id") * 20).alias("cust_no"), "event_id", F.col("event_type").alias("c_name"))
    return K.insert_keyed(customers(spark, sf_dir), batch, "cust_no", "event_id")


@query("insert_keyed", f"""
    SELECT c_custkey AS cust_no, c_name FROM customer
    UNION ALL SELECT cust_no, c_name FROM {_JUDGED} WHERE resp = 0""")
def insert_keyed(spark, sf_dir):
    return inserted(spark, sf_dir).file


@query("insert_keyed_responses", f"SELECT cust_no, event_id, resp FROM {_JUDGED}")
def insert_keyed_responses(spark, sf_dir):
    return inserted(spark, sf_dir).responses.select("cust_no", "event_id", "resp")


@query("bulk_append", """
    SELECT c_custkey AS cust_no, c_name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier""")
def bulk_append(spark, sf_dir):
    rows = C.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cust_no"), F.col("s_name").alias("c_name"))
    return K.bulk_append(customers(spark, sf_dir), rows)


def deleted(spark, sf_dir):
    requests = C.table(spark, sf_dir, "events").select((F.col("user_id") * 20).alias("cust_no"), "event_id")
    return K.delete_keyed(customers(spark, sf_dir), requests, "cust_no", "event_id")


@query("delete_keyed", """
    SELECT c_custkey AS cust_no, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id * 20 FROM events)""")
def delete_keyed(spark, sf_dir):
    return deleted(spark, sf_dir).file


@query("delete_keyed_responses", f"""
    SELECT b.cust_no, b.event_id,
           CASE WHEN c.c_custkey IS NOT NULL AND row_number() OVER (PARTITION BY b.cust_no ORDER BY b.event_id) = 1
                THEN 0 ELSE 13 END AS resp
    FROM {_BATCH} b LEFT JOIN customer c ON c.c_custkey = b.cust_no""")
def delete_keyed_responses(spark, sf_dir):
    return deleted(spark, sf_dir).responses


@query("name_responses", f"""
    SELECT CASE resp WHEN 0 THEN 'NORMAL' ELSE 'NOTFND' END AS resp_name, count(*) AS requests
    FROM ({_READ}) GROUP BY 1""")
def name_responses(spark, sf_dir):
    counted = reads(spark, sf_dir).groupBy("resp").agg(F.count(F.lit(1)).alias("requests"))
    return K.name_responses(counted).select("resp_name", "requests")


@query("route_response", f"""
    SELECT order_no, CASE resp WHEN 0 THEN 'normal' WHEN 13 THEN 'not_found' WHEN 14 THEN 'duplicate' ELSE 'other' END AS route,
           CASE resp WHEN 13 THEN 'N' WHEN 14 THEN 'D' END AS found_flag
    FROM (SELECT order_no, resp FROM ({_READ}) UNION ALL SELECT event_id, resp FROM {_JUDGED})""")
def route_response(spark, sf_dir):
    read = reads(spark, sf_dir).select("order_no", "resp")
    wrote = inserted(spark, sf_dir).responses.select(F.col("event_id").alias("order_no"), "resp")
    return K.route_response(read.unionByName(wrote)).select("order_no", "route", "found_flag")


@query("move_corresponding", """
    SELECT c_custkey AS id, coalesce(s_name, c_name) AS name, coalesce(s_nationkey, c_nationkey) AS nation, c_mktsegment AS segment
    FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def move_corresponding(spark, sf_dir):
    src = C.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"),
        F.col("s_acctbal").alias("other"))
    dst = C.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"))
    return K.move_corresponding(src, dst, "id")


@query("browse", """
    SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(11,2)) AS amount FROM orders
    WHERE o_orderkey >= 700 ORDER BY o_orderkey LIMIT 25""")
def browse(spark, sf_dir):
    file = C.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(11,2)").alias("amount"))
    return K.browse(file, "o_orderkey", 700, 25)


def _browse_sql(reverse):
    low, high = ("count(*) FILTER (o.k <= r.k)", "n.rn = r.pos - s.i + 1") if reverse else (
        "count(*) FILTER (o.k < r.k)", "n.rn = r.pos + s.i")
    return f"""
    WITH o AS (SELECT o_orderkey * 3 AS k, o_orderstatus FROM orders),
         n AS (SELECT *, row_number() OVER (ORDER BY k) AS rn FROM o),
         starts AS (SELECT DISTINCT c_custkey * 31 AS k FROM customer),
         r AS (SELECT r.k, {low} AS pos FROM starts r, o GROUP BY r.k),
         s AS (SELECT unnest([1, 2, 3]) AS i)
    SELECT r.k // 31 AS cust_no, CAST(s.i AS INTEGER) AS read_no, n.k AS order_key, n.o_orderstatus AS status,
           CASE WHEN n.k IS NULL THEN 19 ELSE 0 END AS resp
    FROM r CROSS JOIN s LEFT JOIN n ON {high}"""


def browsed(spark, sf_dir, reverse):
    file = C.table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 3).alias("order_key"), F.col("o_orderstatus").alias("status"))
    requests = C.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust_no"), (F.col("c_custkey") * 31).alias("start"))
    return K.browse_many(requests, file, "order_key", "start", 3, reverse).drop("start")


@query("browse_many", _browse_sql(False))
def browse_many(spark, sf_dir):
    return browsed(spark, sf_dir, False)


@query("browse_many_back", _browse_sql(True))
def browse_many_back(spark, sf_dir):
    return browsed(spark, sf_dir, True)


@query("browse_total", f"""
    SELECT CAST(sum(order_amt) AS DECIMAL(38,2)) AS total FROM {C.ORDER_KEYS.sql} WHERE order_key >= '0000000000000000100'""")
def browse_total(spark, sf_dir):
    return K.browse_total(C.ORDER_KEYS.df(spark, sf_dir), "order_key", "order_amt", "0000000000000000100", mode="to_end").select(
        F.col("total").cast("decimal(38,2)").alias("total"))


def browse_sums(spark, sf_dir, mode):
    requests = C.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("cust_no"), F.lpad(F.col("c_custkey").cast("string"), 19, "0").alias("start"))
    return K.browse_totals(requests, C.ORDER_KEYS.df(spark, sf_dir), "order_key", "order_amt", "cust_no", "start", 19, mode)


@query("browse_totals_prefix", f"""
    SELECT c_custkey AS cust_no, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(11,2))), 0) AS DECIMAL(38,2)) AS total
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def browse_totals_prefix(spark, sf_dir):
    return browse_sums(spark, sf_dir, "prefix")


@query("browse_totals_to_end", f"""
    WITH sums AS (SELECT c_custkey AS cust_no, coalesce(sum(CAST(o_totalprice AS DECIMAL(11,2))), 0) AS one
                  FROM customer FULL JOIN orders ON o_custkey = c_custkey GROUP BY 1)
    SELECT cust_no, CAST(sum(one) OVER (ORDER BY cust_no DESC) AS DECIMAL(38,2)) AS total FROM sums""")
def browse_totals_to_end(spark, sf_dir):
    return browse_sums(spark, sf_dir, "to_end")


def queue_writes(spark, sf_dir):
    return C.table(spark, sf_dir, "events").select(
        F.concat("event_type", F.lit("  ")).alias("queue"), "ts", "event_id",
        F.concat(F.lit("event "), F.col("props")).alias("data"), F.lit(10).alias("length"))


_ITEMS = """(SELECT event_type AS queue, event_id, left('event ' || props, 10) AS data,
                    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS item FROM events)"""


def items(spark, sf_dir):
    return Q.assign_queue_items(queue_writes(spark, sf_dir), ["ts", "event_id"])


@query("assign_queue_items", f"SELECT queue, item, event_id, data FROM {_ITEMS}")
def assign_queue_items(spark, sf_dir):
    return items(spark, sf_dir).select("queue", "item", "event_id", "data")


@query("read_queue_item", f"""
    SELECT r.queue, r.item, q.data, CAST(length(q.data) AS INTEGER) AS length, CASE WHEN q.item IS NULL THEN 26 ELSE 0 END AS resp
    FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'view' WHEN 'O' THEN 'click' ELSE 'nowhere' END AS queue,
                 o_orderkey % 4001 AS item FROM orders) r
    LEFT JOIN {_ITEMS} q ON q.queue = r.queue AND q.item = r.item""")
def read_queue_item(spark, sf_dir):
    status = F.col("o_orderstatus")
    requests = C.table(spark, sf_dir, "orders").select(
        F.when(status == "F", "view ").when(status == "O", "click").otherwise("nowhere").alias("queue"),
        (F.col("o_orderkey") % 4001).alias("item"))
    return Q.read_queue_item(items(spark, sf_dir), requests)


def dropped(spark, sf_dir):
    names = C.table(spark, sf_dir, "events").select(
        F.when(F.col("value") < 5, F.col("event_type")).otherwise(F.concat(F.lit("no-"), "event_type")).alias("queue"))
    names = names.where(F.col("queue").rlike("click|view|no-"))
    return Q.delete_queue(items(spark, sf_dir).select("queue", "item", "data"), names)


_NAMES = """(SELECT DISTINCT CASE WHEN value < 5 THEN event_type ELSE 'no-' || event_type END AS queue FROM events)"""


@query("delete_queue", f"""
    SELECT queue, item, data FROM {_ITEMS}
    WHERE queue NOT IN (SELECT queue FROM {_NAMES} WHERE regexp_matches(queue, 'click|view|no-'))""")
def delete_queue(spark, sf_dir):
    return dropped(spark, sf_dir).file


@query("delete_queue_responses", f"""
    SELECT queue, CASE WHEN starts_with(queue, 'no-') THEN 44 ELSE 0 END AS resp
    FROM {_NAMES} WHERE regexp_matches(queue, 'click|view|no-')""")
def delete_queue_responses(spark, sf_dir):
    return dropped(spark, sf_dir).responses
