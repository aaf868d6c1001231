"""Queries over binary records: load, look up, decode by field kind, encode, write, convert."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonedeck.operators.batch import control_totals
from zonedeck.plans import carriers as C
from zonedeck.plans.registry import query
from zonedeck.session import shared_dir
from zonedeck.sources import extracts as X
from zonedeck.sources.fixedbin import list_files


def stored_sales(spark, sf_dir, ordered=False):
    """The transaction extract as files in the shared folder."""
    rows = C.SALES.df(spark, sf_dir)
    path = shared_dir(spark, "sales")
    X.write_fixed(rows.orderBy("sale_no") if ordered else rows, C.SALE_LAYOUT, path)
    return path


def recoded(spark, sf_dir, carrier, layout):
    """Rows encoded to records and decoded again."""
    return X.decode_records(X.encode_fixed(carrier.df(spark, sf_dir), layout).select("rec"), layout)


@query("load_fixed", f"SELECT sale_no, sale_day, sale_worth, sale_rank, sale_state, sale_buyer FROM {C.SALES.sql}")
def load_fixed(spark, sf_dir):
    loaded = X.load_fixed(spark, stored_sales(spark, sf_dir), C.SALE_LAYOUT)
    return loaded.select("sale_no", "sale_day", "sale_worth", "sale_rank", "sale_state", "sale_buyer")


_DAMAGE = """CASE WHEN o_orderkey % 97 = 0 THEN 'sale_worth' WHEN o_orderkey % 89 = 0 THEN 'sale_day' ELSE 'good' END"""


@query("load_fixed_permissive", f"""
    SELECT {_DAMAGE} AS outcome, count(*) AS records,
           CAST(sum(CASE WHEN {_DAMAGE} = 'good' THEN CAST(o_totalprice AS DECIMAL(13,2)) ELSE 0 END) AS DECIMAL(23,2)) AS amount
    FROM orders GROUP BY 1""")
def load_fixed_permissive(spark, sf_dir):
    """Every 97th record gets a bad digit in its amount, every 89th a bad sign in its date."""
    number = F.col("sale_no").cast("bigint")
    rec = F.col("rec")
    whole = X.encode_fixed(C.SALES.df(spark, sf_dir), C.SALE_LAYOUT)
    at = {f.name: place for f, place in C.SALE_LAYOUT.placed()}

    def with_byte(place, value):
        return F.concat(F.substring(rec, 1, place), F.unhex(F.lit(value)), F.substring(rec, place + 2, C.SALE_LAYOUT.width))

    amount, date = with_byte(at["sale_worth"] + 1, "FA"), with_byte(at["sale_day"] + 4, "0B")
    damaged = whole.select(F.when(number % 97 == 0, amount).when(number % 89 == 0, date).otherwise(rec).alias("rec"))
    path = shared_dir(spark, "damaged")
    X.write_records(damaged, C.SALE_LAYOUT.width, path)
    good, bad = X.load_fixed(spark, path, C.SALE_LAYOUT, mode="permissive")
    zero = F.lit(0).cast("decimal(13,2)")
    both = good.select(F.lit("good").alias("outcome"), "sale_worth").unionByName(
        bad.select(F.col("reason").alias("outcome"), zero.alias("sale_worth")))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("records"), F.sum("sale_worth").alias("amount"))


@query("lookup_rrn", f"""
    WITH numbered AS (SELECT row_number() OVER (ORDER BY sale_no) AS rrn, * FROM {C.SALES.sql}),
         wanted AS (SELECT l_partkey * 10 + 1 AS rrn FROM lineitem)
    SELECT w.rrn, n.sale_no, n.sale_worth FROM wanted w LEFT JOIN numbered n ON w.rrn = n.rrn""")
def lookup_rrn(spark, sf_dir):
    records = X.read_records(spark, stored_sales(spark, sf_dir, ordered=True), C.SALE_LAYOUT.width)
    wanted = C.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 10 + 1).alias("rrn"))
    found = X.lookup_rrn(records, wanted)
    return X.decode_records(found, C.SALE_LAYOUT, checked=False).select("rrn", "sale_no", "sale_worth")


@query("field_text", f"SELECT buyer_no, buyer_name, buyer_branch FROM {C.BUYERS.sql}")
def field_text(spark, sf_dir):
    return recoded(spark, sf_dir, C.BUYERS, C.BUYER_LAYOUT).select("buyer_no", "buyer_name", "buyer_branch")


@query("field_zoned", f"SELECT vendor_no, vendor_land, vendor_name, vendor_funds FROM {C.VENDORS.sql}")
def field_zoned(spark, sf_dir):
    return recoded(spark, sf_dir, C.VENDORS, C.VENDOR_LAYOUT)


@query("field_zoned_signed", f"SELECT over_punched, sign_first, sign_last FROM {C.SIGNED.sql}")
def field_zoned_signed(spark, sf_dir):
    return recoded(spark, sf_dir, C.SIGNED, C.SIGNED_LAYOUT)


@query("field_packed", f"SELECT sale_no, sale_day, sale_worth FROM {C.SALES.sql}")
def field_packed(spark, sf_dir):
    return recoded(spark, sf_dir, C.SALES, C.SALE_LAYOUT).select("sale_no", "sale_day", "sale_worth")


@query("field_binary", f"SELECT stock_no, stock_gap, stock_size, stock_key, stock_shift, stock_far FROM {C.STOCKS.sql}")
def field_binary(spark, sf_dir):
    return recoded(spark, sf_dir, C.STOCKS, C.STOCK_LAYOUT)


_LINES = """
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
                                                                  l_extendedprice, l_quantity) AS line
    FROM lineitem"""
_ROWS = 4


def baskets(spark, sf_dir):
    """One record for each four lines of an order, every line kept: an order's fifth line starts its next record."""
    from zonedeck.operators.ordering import position

    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]
    lines = C.table(spark, sf_dir, "lineitem").select("l_orderkey", *order)
    placed = position(lines, ["l_orderkey"], order, "line")
    entry = F.struct("line", F.lpad(F.col("l_partkey").cast("string"), 19, "0").alias("row_part"),
                     F.col("l_quantity").cast("int").alias("row_units"),
                     F.col("l_extendedprice").cast("decimal(10,2)").alias("row_price"))
    pages = placed.groupBy("l_orderkey", F.floor((F.col("line") - 1) / _ROWS).alias("page")).agg(
        F.array_sort(F.collect_list(entry)).alias("e"))
    head = F.struct(F.col("l_orderkey").cast("decimal(19,0)").alias("basket_no"), F.size("e").alias("basket_lines"))
    cells = F.transform("e", lambda x: F.struct(*[x[c].alias(c) for c in ("row_part", "row_units", "row_price")]))
    return pages.select("page", head.alias("basket_head"), cells.alias("basket_row"))


@query("field_occurs", f"""
    SELECT CAST(l_orderkey AS DECIMAL(19,0)) AS basket_no, CAST((line - 1) % {_ROWS} + 1 AS INT) AS entry,
           lpad(CAST(l_partkey AS VARCHAR), 19, '0') AS row_part, CAST(l_quantity AS INT) AS row_units,
           CAST(l_extendedprice AS DECIMAL(10,2)) AS row_price
    FROM ({_LINES})""")
def field_occurs(spark, sf_dir):
    path = shared_dir(spark, "baskets")
    X.write_fixed(baskets(spark, sf_dir), C.BASKET_LAYOUT, path)
    decoded = X.load_fixed(spark, path, C.BASKET_LAYOUT)
    return X.explode_occurs(decoded.select("basket_head.basket_no", "basket_row"), "basket_row")


@query("field_occurs_depending", f"""
    SELECT l_orderkey AS order_no, (line - 1) // {_ROWS} AS page, count(*) AS lines, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS units,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(10,2))) AS DECIMAL(20,2)) AS price,
           repeat('40', CAST(27 * ({_ROWS} - count(*)) AS INTEGER)) AS unused
    FROM ({_LINES}) GROUP BY 1, 2""")
def field_occurs_depending(spark, sf_dir):
    """The count stands in a group before the array; entries beyond it are blanks, which are no numbers."""
    rec = X.encode_fixed(baskets(spark, sf_dir), C.BASKET_LAYOUT)
    decoded = X.decode_records(rec.select("rec", "page", F.hex(F.substring("rec", 23, 200)).alias("rows")), C.BASKET_LAYOUT)
    lines = F.col("basket_head.basket_lines")
    total = lambda c, kind: F.aggregate("basket_row", F.lit(0).cast(kind), lambda s, r: (s + r[c]).cast(kind))
    return decoded.select(
        F.col("basket_head.basket_no").cast("bigint").alias("order_no"), "page", F.size("basket_row").cast("bigint").alias("lines"),
        total("row_units", "bigint").alias("units"), total("row_price", "decimal(20,2)").alias("price"),
        F.substring("rows", lines * 54 + 1, F.lit(400)).alias("unused"))


@query("field_redefines", f"""
    SELECT slip_key, CAST(slip_key // 100000000 AS INT) AS slip_serial, CAST(slip_key // 100 % 1000000 AS INT) AS slip_month,
           CAST(slip_key % 100 AS INT) AS slip_day
    FROM {C.SLIPS.sql}""")
def field_redefines(spark, sf_dir):
    return recoded(spark, sf_dir, C.SLIPS, C.SLIP_LAYOUT).select("slip_key", "slip_parts.*")


@query("field_conditions", f"""
    SELECT sale_no, sale_state = 'F' AS sale_done, sale_state IN ('O', 'P') AS sale_open,
           sale_day BETWEEN 19920101 AND 19951231 AS sale_early, sale_worth >= 100000 AS sale_large FROM {C.SALES.sql}""")
def field_conditions(spark, sf_dir):
    return recoded(spark, sf_dir, C.SALES, C.SALE_LAYOUT).select("sale_no", "sale_done", "sale_open", "sale_early", "sale_large")


@query("encode_fixed", f"""
    SELECT buyer_no, hex(encode(rpad(buyer_name, 44, ' '))) AS name_ascii,
           lpad(CAST(CAST(abs(buyer_credit) * 100 AS BIGINT) AS VARCHAR), 13, '0') AS digits,
           CASE WHEN buyer_credit < 0 THEN 'D' ELSE 'C' END AS zone, 86 AS bytes
    FROM {C.BUYERS.sql}""")
def encode_fixed(spark, sf_dir):
    """Bytes checked piece by piece: text back to ASCII, the balance's digits, the zone of its last byte."""
    rec = X.encode_fixed(C.BUYERS.df(spark, sf_dir), C.BUYER_LAYOUT)
    from zonedeck.functions.codec import decode_text

    nibbles = F.hex(F.substring("rec", 30, 13))
    return rec.select(
        "buyer_no", F.hex(F.encode(decode_text(F.substring("rec", 43, 44), "none"), "US-ASCII")).alias("name_ascii"),
        F.regexp_replace(nibbles, ".(.)", "$1").alias("digits"), F.substring(nibbles, 25, 1).alias("zone"),
        F.length("rec").alias("bytes"))


@query("encode_fixed_numbers", f"""
    SELECT sale_no, concat(lpad(CAST(sale_day AS VARCHAR), 9, '0'), 'F') AS day, lpad(hex(sale_buyer), 16, '0') AS buyer,
           concat(lpad(CAST(CAST(abs(sale_worth) * 100 AS BIGINT) AS VARCHAR), 13, '0'), CASE WHEN sale_worth < 0 THEN 'D' ELSE 'C' END) AS worth
    FROM {C.SALES.sql}""")
def encode_fixed_numbers(spark, sf_dir):
    """The bytes of packed and binary fields, read off without decoding."""
    sales = C.SALES.df(spark, sf_dir)
    rec = X.encode_fixed(sales, C.SALE_LAYOUT)
    return rec.select("sale_no", F.hex(F.substring("rec", 36, 5)).alias("day"), F.hex(F.substring("rec", 41, 8)).alias("buyer"),
                      F.hex(F.substring("rec", 49, 7)).alias("worth"))


@query("write_fixed", f"SELECT count(*) * {C.SALE_LAYOUT.width} AS bytes, count(*) AS records, 0 AS remainder FROM orders")
def write_fixed(spark, sf_dir):
    path = stored_sales(spark, sf_dir)
    size = sum(n for _, n in list_files(path))
    records = X.read_records(spark, path, C.SALE_LAYOUT.width, mode="permissive")
    return records.agg(F.sum(F.length("rec")).alias("bytes"), F.count(F.lit(1)).alias("records")).withColumn(
        "remainder", (F.lit(size) - F.col("bytes")).cast("int"))


@query("convert_extract", f"SELECT vendor_no, vendor_land, vendor_name, vendor_funds FROM {C.VENDORS.sql}")
def convert_extract(spark, sf_dir):
    path, out = shared_dir(spark, "vendors"), shared_dir(spark, "vendors-csv")
    X.write_fixed(C.VENDORS.df(spark, sf_dir), C.VENDOR_LAYOUT, path)
    X.convert_extract(spark, path, C.VENDOR_LAYOUT, out)
    return (spark.read.option("header", True)
            .schema("vendor_land int, vendor_name string, vendor_no string, vendor_funds decimal(10,2)").csv(out))


_TOTALS = """
    SELECT count(*) FILTER (o_orderstatus = 'F') AS record_count,
           CAST(sum(CAST(o_totalprice AS DECIMAL(13,2))) FILTER (o_orderstatus = 'F') AS DECIMAL(23,2)) AS total_amount,
           count(*) FILTER (o_orderstatus <> 'F') AS error_count"""


@query("control_totals", _TOTALS + " FROM orders")
def totals(spark, sf_dir):
    """Flagship: encode to records, decode, total."""
    return control_totals(recoded(spark, sf_dir, C.SALES, C.SALE_LAYOUT), "sale_state", "sale_worth", accepted="F")


@query("control_totals_by_type", "SELECT o_orderpriority AS sale_rank,"
       + _TOTALS.replace("SELECT", "", 1) + " FROM orders GROUP BY 1")
def totals_by_type(spark, sf_dir):
    loaded = X.load_fixed(spark, stored_sales(spark, sf_dir), C.SALE_LAYOUT)
    return control_totals(loaded, "sale_state", "sale_worth", by=["sale_rank"], accepted="F")
