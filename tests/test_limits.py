"""Values beyond the widths that fields, pictures and tokens usually have."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from zonedeck.functions import money, text
from zonedeck.functions.codec import _LATIN, _TEXT
from zonedeck.layout import Layout
from zonedeck.operators import batch as B
from zonedeck.operators import keyed as K
from zonedeck.operators import reconcile as R
from zonedeck.plans import carriers as C
from zonedeck.sources import extracts as X
from zonedeck.sources import fixedbin


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_report_numbers_are_never_cut(spark):
    row = one(spark, text.edited_count(F.lit(5_000_000_000), 9), text.edited_amount(F.lit("1234567890123.45").cast("decimal(20,2)"), 9),
              text.edited_count(F.lit(7), 9), text.edited_amount(F.lit("7.5").cast("decimal(20,2)"), 9))
    assert tuple(row) == ("5000000000", "1234567890123.45", " " * 8 + "7", " " * 9 + "7.50")


def test_daily_compounding_over_45_years(spark):
    base = F.lit("1.0001").cast(money.FINE)
    assert abs(float(one(spark, money.whole_power(base, F.lit(365 * 45)))[0]) - 1.0001 ** (365 * 45)) < 1e-9
    assert one(spark, money.whole_power(F.lit(1).cast(money.FINE), F.lit(2 ** 31 - 1)))[0] == 1


@pytest.mark.parametrize("carrier, key", [(C.SALES, "o_orderkey"), (C.BUYERS, "c_custkey"), (C.VENDORS, "s_suppkey"),
                                          (C.STOCKS, "p_partkey")])
def test_keys_of_twelve_digits_stay_apart(spark, carrier, key):
    first = next(iter(carrier.columns.values()))
    rows = spark.createDataFrame([(123_456_789_012,), (123_456_789_013,), (123_456_789,),
                                  (9_223_372_036_854_775_806,), (9_223_372_036_854_775_807,)], f"{key} bigint")
    assert rows.select(F.expr(first).alias("k")).distinct().count() == 5


def verdicts(spark, *pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, expected string, actual string")
    return [r.verdict for r in R.check_equivalence(df).orderBy("id").collect()]


def test_tokens_of_any_length(spark):
    long = "1234567890" * 5
    assert verdicts(
        spark, (long, long + ".0"), (long, long[:-1] + "1"), (long, "1" + long), (f"0.{long}", f"0.{long}1"),
        (f"-{long}", long), ("00" + long, long), (f"0.1{long}", f"0.2{long}"), (f"{long}.00001", long), (f"{long}.5", long),
    ) == ["pass", "value_mismatch", "value_mismatch", "pass", "value_mismatch", "pass", "value_mismatch", "pass", "value_mismatch"]


def test_unicode_blanks_in_labels(spark):
    assert verdicts(spark, ("Net Pay 1", "Net Pay  1")) == ["pass"]


def test_divisors_of_any_size(spark):
    def divided(a, b, digits=11, scale=2):
        row = one(spark, *B.divide_remainder(F.lit(a).cast("decimal(11,2)"), F.lit(b).cast("decimal(20,8)"), digits, scale))
        return tuple(None if x is None else Decimal(x).normalize() for x in row)

    assert divided("100.00", "2000000") == (0, 100)
    assert divided("0.01", "0.00004") == (250, 0)
    assert divided("10.00", "3") == (Decimal("3.33"), Decimal("0.01"))
    assert divided("-10.00", "3") == (Decimal("-3.33"), Decimal("-0.01"))
    assert divided("1.00", "0")[0] is None
    fine = one(spark, *B.divide_remainder(F.lit("2").cast("decimal(3,2)"), F.lit("0.00000000001").cast("decimal(20,11)"), 14, 2))
    assert [Decimal(x) for x in fine] == [200_000_000_000, 0]
    fine = one(spark, *B.divide_remainder(F.lit("1").cast("decimal(3,2)"), F.lit("3.000000000000003").cast("decimal(20,15)"), 9, 6))
    assert Decimal(fine[0]) == Decimal("0.333333") and Decimal(fine[1]) == 1 - Decimal("0.333333") * Decimal("3.000000000000003")


def test_insert_without_a_key(spark):
    file = spark.createDataFrame([(1, "a")], "k int, v string")
    rows = spark.createDataFrame([(None, "b", 1), (None, "c", 2), (2, "d", 3)], "k int, v string, ord int")
    done = K.insert_keyed(file, rows, "k", "ord")
    assert {(r.v, r.resp) for r in done.responses.collect()} == {("b", 0), ("c", 14), ("d", 0)}


ORDERS = Layout.from_copybook("""
       01 ORDERS.
          05 FILLER       PIC X(2).
          05 CODE         PIC 9(3).
             88 SMALL     VALUE 1 THRU 99.
             88 EXACT     VALUES 100 250.
          05 BODY.
             10 N         PIC 9(1).
             10 QTY OCCURS 1 TO 3 TIMES DEPENDING ON N PIC 9(2).
             10 FLAG      PIC X.
                88 FLAG-ON VALUE 'Y'.
          05 FILLER       PIC X(1).
""")


def test_conditions_and_unused_entries(spark):
    width = ORDERS.width
    assert [f.name for f in ORDERS.fields] == ["filler", "code", "body", "filler_2"] and width == 14
    rows = spark.createDataFrame([(" " * 2 + "050" + "1" + "12" + " " * 4 + "Y" + " ",), ("  250" + "2" + "1234" + "  " + "N" + " ",)], "t string")
    rows = rows.select(F.encode(F.translate("t", _TEXT, _LATIN), "ISO-8859-1").alias("rec"))
    shown = [r.asDict(recursive=True) for r in X.decode_records(rows, ORDERS).collect()]
    assert [(r["small"], r["exact"], r["flag_on"], r["body"]["qty"]) for r in shown] == [
        (True, False, True, [12]), (False, True, False, [12, 34])]


def test_folders_are_read_at_any_depth(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "1.bin").write_bytes(b"abcd")
    (tmp_path / "a" / "b" / "2.bin").write_bytes(b"efgh" * 2)
    (tmp_path / "_hidden" / "3.bin").write_bytes(b"xxxx")
    assert X.read_records(spark, str(tmp_path), 4).count() == 3
    assert [n for _, n in fixedbin.list_files(str(tmp_path))] == [4, 8]
    assert "part-0000099999-" < "part-0000100000-"


def test_neighbours_do_not_hang_on_the_size_switch(spark):
    from zonedeck.operators import retrieve

    vectors = spark.createDataFrame([(i, [float(i * 7 % 11) - 5, float(i % 5), 1.0]) for i in range(60)],
                                    "id bigint, vector array<double>")
    asked = vectors.where("id < 6").selectExpr("id % 3 AS query_id", "vector")
    lists = lambda **o: sorted((r.query_id, tuple(n.id for n in r.neighbours)) for r in retrieve.nearest_lists(
        asked, vectors, 3, **o).collect())
    assert lists() == lists(matrix_bytes=256)


@pytest.mark.parametrize("vector", ["array(1D, 2D)", "array(1D, NULL, 2D)", "NULL"])
def test_uneven_vectors_are_refused(spark, vector):
    from zonedeck.operators import retrieve

    vectors = spark.range(3).selectExpr("id", "array(1D, 2D, 3D) AS vector")
    odd = spark.range(1).selectExpr("id + 9 AS id", f"CAST({vector} AS array<double>) AS vector")
    with pytest.raises(ValueError, match="one length"):
        retrieve.nearest(vectors.withColumnRenamed("id", "query_id"), vectors.unionByName(odd), 2)


def test_large_and_small_keys_are_numbered_alike(spark, monkeypatch):
    from zonedeck.operators import ordering

    monkeypatch.setattr(ordering, "KEY_ROWS", 50)
    df = spark.range(300).selectExpr("CASE WHEN id < 120 THEN 1 WHEN id < 200 THEN NULL ELSE id % 40 END AS k", "id * 7 % 300 AS n")
    rows = [(r.k, r.n, r.p) for r in ordering.position(df, ["k"], ["n"], "p").collect()]
    keys = {}
    for k, n, p in rows:
        keys.setdefault(k, []).append((n, p))
    assert len(rows) == 300 and all([p for _, p in sorted(v)] == list(range(1, len(v) + 1)) for v in keys.values())
