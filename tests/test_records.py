"""Byte codecs, layouts, and the record source with whole, short and damaged files."""

import glob
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from zonedeck.functions import codec
from zonedeck.layout import Field, Layout
from zonedeck.plans import carriers as C
from zonedeck.sources import extracts as X
from zonedeck.sources import fixedbin

MONEY = Field("m", "packed", digits=9, scale=2, signed=True)
DATE = Field("d", "packed", digits=8)

DECODED = [
    ("001000000C", MONEY, Decimal("10000.00")),
    ("001000000D", MONEY, Decimal("-10000.00")),
    ("000000000C", MONEY, Decimal("0.00")),
    ("001000000F", MONEY, Decimal("10000.00")),
    ("00A000000C", MONEY, None),
    ("00E100000C", MONEY, None),  # must not read as an exponent
    ("001000000B", MONEY, None),
    ("0010000001", MONEY, None),
    ("00000123456D", Field("m", "packed", digits=11, scale=2, signed=True), Decimal("-1234.56")),
    ("020240115F", DATE, 20240115),
    ("120240115F", DATE, None),  # a digit in the pad nibble
    ("12345F", Field("n", "packed", digits=5), 12345),
    ("F1F2F3F4D5", Field("z", "zoned", digits=5, signed=True), -12345),
    ("F1F2F3F4C5", Field("z", "zoned", digits=5, signed=True), 12345),
    ("F1F2F3F4F5", Field("z", "zoned", digits=5, signed=True), 12345),
    ("F1F2F3F4E5", Field("z", "zoned", digits=5, signed=True), None),
    ("F0F0F1F2F3F4F5F6F7", Field("z", "zoned", digits=9, scale=2), Decimal("12345.67")),
    ("F1F2F300", Field("z", "zoned", digits=4), None),  # a NUL is no blank
    ("F1F2C3", Field("z", "zoned", digits=3), None),
    ("F1F2F3F4F5F6F7F8F9F0F1F2F3F4F5F6F7F8F9F0", Field("z", "zoned", digits=20, scale=2), Decimal("123456789012345678.90")),
    ("60F1F2F3", Field("z", "zoned", digits=3, signed=True, sign="leading"), -123),
    ("F1F2F34E", Field("z", "zoned", digits=3, signed=True, sign="trailing"), 123),
    ("FFFE", Field("b", "binary", digits=4), 65534),
    ("FFFE", Field("b", "binary", digits=4, signed=True), -2),
    ("FFFFFFFF", Field("b", "binary", digits=9), 4294967295),
    ("FFFFFFFE", Field("b", "binary", digits=9, signed=True), -2),
    ("FFFFFFFFFFFFFFFE", Field("b", "binary", digits=18, signed=True), -2),
    ("FFFFFFFFFFFFFFFF", Field("b", "binary", digits=18), Decimal("18446744073709551615")),
    ("4040C1C2F140", Field("t", "text", length=6), "AB1"),
]


@pytest.mark.parametrize("hexed,item,value", DECODED)
def test_decode(spark, hexed, item, value):
    row = spark.createDataFrame([(hexed,)], "h string").select(codec.decode_item(F.unhex("h"), item).alias("v")).first()
    assert row.v == value


ENCODED = [
    ("-9876.54", MONEY, "000987654D"),
    ("12345.67", MONEY, "001234567C"),
    ("0.005", MONEY, "000000001C"),
    ("9999999.995", MONEY, None),  # rounds out of its picture
    ("20240115", DATE, "020240115F"),
    ("-1", DATE, None),
    ("-12345", Field("z", "zoned", digits=5, signed=True), "F1F2F3F4D5"),
    ("-123", Field("z", "zoned", digits=3, signed=True, sign="leading"), "60F1F2F3"),
    ("-2", Field("b", "binary", digits=4, signed=True), "FFFE"),
    ("7", Field("b", "binary", digits=18), "0000000000000007"),
]


@pytest.mark.parametrize("value,item,hexed", ENCODED)
def test_encode(spark, value, item, hexed):
    df = spark.createDataFrame([(Decimal(value),)], "v decimal(38,10)")
    assert df.select(F.hex(codec.encode_item(F.col("v"), item)).alias("h")).first().h == hexed


def test_truncating_encode(spark):
    df = spark.createDataFrame([(Decimal("-1.009"),)], "v decimal(10,3)")
    assert df.select(F.hex(codec.encode_item(F.col("v"), MONEY, "truncate")).alias("h")).first().h == "000000100D"


def test_all_256_bytes_of_text(spark):
    one = Field("t", "text", length=1)
    raw = spark.range(256).select("id", F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("raw"))
    text = raw.withColumn("t", codec.decode_text(F.col("raw"), "none"))
    rows = text.withColumn("back", codec.encode_item(F.col("t"), one)).collect()
    assert all(r.t == bytes([r.id]).decode("cp037") and bytes(r.back) == bytes([r.id]) for r in rows)


def test_text_that_does_not_fit_is_not_cut(spark):
    df = spark.createDataFrame([("abc",), ("日",)], "t string")
    assert [r[0] for r in df.select(codec.encode_item(F.col("t"), Field("t", "text", length=2))).collect()] == [None, None]


def test_copybook_layout():
    layout = Layout.from_copybook("""
       01 REC.
          05 A         PIC X(9).
          05 B         PIC S9(7)V99 COMP-3.
          05 N         PIC 9(2).
          05 ROWS OCCURS 1 TO 3 TIMES DEPENDING ON N.
             10 C      PIC X(4).
             10 D      PIC 9(9) COMP.
          05 DATE-NUM  PIC 9(8).
          05 PARTS REDEFINES DATE-NUM.
             10 YY     PIC 9(4).
             10 REST   PIC X(4).
          05 STATUS-C  PIC X.
             88 IS-OK  VALUES 'A' 'B'.
          05 AMT       PIC S9(3)V9 SIGN LEADING SEPARATE.
    """)
    assert layout.width == 9 + 5 + 2 + 24 + 8 + 1 + 5
    assert [(f.name, at) for f, at in layout.placed()] == [
        ("a", 0), ("b", 9), ("n", 14), ("rows", 16), ("date_num", 40), ("parts", 40), ("status_c", 48), ("amt", 49)]
    by_name = {f.name: f for f in layout.fields}
    assert by_name["rows"].depending_on == "n" and by_name["rows"].children[1].kind == "binary"
    assert by_name["status_c"].conditions == (("is_ok", ("A", "B")),)


WIDTH = C.SALE_LAYOUT.width


@pytest.fixture(scope="module")
def txn(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("txn") / "records")
    X.write_fixed(C.SALES.df(spark, "/root/testdata/sf0.001").orderBy("sale_no").repartitionByRange(3, "sale_no"), C.SALE_LAYOUT, path)
    return path


def test_write_commits_whole_files(spark, txn):
    files = fixedbin.list_files(txn)
    assert len(files) == 3 and sum(n for _, n in files) == WIDTH * 1500
    assert glob.glob(f"{txn}/_SUCCESS") and not glob.glob(f"{txn}/_temporary/*")


def test_overwrite_replaces_files(spark, tmp_path):
    rec = spark.range(10).select(F.encode(F.lpad(F.col("id").cast("string"), 4, "0"), "US-ASCII").alias("rec"))
    X.write_records(rec, 4, str(tmp_path / "o"))
    X.write_records(rec.limit(3), 4, str(tmp_path / "o"), mode="overwrite")
    assert X.read_records(spark, str(tmp_path / "o"), 4).count() == 3


def test_only_listed_files_are_read(spark, tmp_path):
    """Files of a job without a manifest, or that its manifest leaves out, do not count; files from elsewhere do."""
    rec = lambda n: spark.range(0, n, 1, 2).select(F.encode(F.lpad(F.col("id").cast("string"), 4, "0"), "US-ASCII").alias("rec"))
    path = str(tmp_path / "o")
    X.write_records(rec(10), 4, path)
    job = "a" * 32
    (tmp_path / "o" / f"part-0000000000-{job}-{'b' * 32}.bin").write_bytes(b"lost")
    assert X.read_records(spark, path, 4).count() == 10
    (tmp_path / "o" / "other.bin").write_bytes(b"more")
    X.write_records(rec(5), 4, path, mode="append")
    assert X.read_records(spark, path, 4).count() == 16
    assert X.read_records(spark, path + "/part*.bin", 4).count() == 15
    X.write_records(rec(3), 4, path, mode="overwrite")
    assert X.read_records(spark, path, 4).count() == 3
    assert len(glob.glob(f"{path}/_manifest-*.json")) == 1 and not glob.glob(f"{path}/other.bin")


def test_a_replaced_job_stops_counting_before_its_files_go(spark, tmp_path):
    import json

    path = tmp_path / "r"
    path.mkdir()
    for job, text, replaces in (("a" * 32, b"old1", []), ("c" * 32, b"new1", ["a" * 32])):
        name = f"part-0000000000-{job}-{'b' * 32}.bin"
        (path / name).write_bytes(text)
        (path / f"_manifest-{job}.json").write_text(json.dumps({"files": [name], "replaces": replaces}))
    assert [bytes(r.rec) for r in X.read_records(spark, str(path), 4).collect()] == [b"new1"]


def test_wrong_length_is_refused(spark, tmp_path):
    rec = spark.range(3).select(F.encode(F.lit("abc"), "US-ASCII").alias("rec"))
    with pytest.raises(Exception, match="must have 4 bytes"):
        X.write_records(rec, 4, str(tmp_path / "w"))
    assert not glob.glob(f"{tmp_path}/w/*.bin")


def test_record_numbers_run_through_files_and_splits(spark, txn):
    whole = X.read_records(spark, txn, WIDTH)
    cut = X.read_records(spark, txn, WIDTH, split_bytes=WIDTH * 100)
    assert cut.rdd.getNumPartitions() >= 15
    numbered = X.decode_records(cut, C.SALE_LAYOUT).select("rrn", F.col("sale_no").cast("bigint").alias("id"))
    assert numbered.where(F.col("rrn") != F.col("id") + 1).count() == 0
    assert whole.exceptAll(cut).count() == 0 and cut.count() == 1500


def test_record_filters_narrow_the_ranges(txn):
    options = {"path": txn, "reclen": str(WIDTH), "splitbytes": str(WIDTH * 100)}
    read = lambda *filters: (lambda r: (list(r.pushFilters(list(filters))), r.partitions())[1])(fixedbin.FixedReader(options))
    everything = read()
    assert len(read(EqualTo(("rrn",), 1499))) == 1
    assert len(read(In(("rrn",), (1, 2, 1500)))) == 2
    assert sum(p.stop - p.start for p in read(GreaterThanOrEqual(("rrn",), 1490), LessThan(("rrn",), 1500))) == WIDTH * 10
    assert len(everything) > 10


def test_pushed_filter_gives_the_same_rows(spark, txn):
    records = X.read_records(spark, txn, WIDTH, split_bytes=WIDTH * 100)
    assert [r.rrn for r in records.where("rrn in (3, 700, 1500, 1501)").orderBy("rrn").collect()] == [3, 700, 1500]
    assert records.where("rrn > 1495").count() == 5


@pytest.fixture
def damaged(spark, txn, tmp_path):
    path = tmp_path / "damaged.bin"
    data = bytearray(b"".join(open(f, "rb").read() for f, _ in fixedbin.list_files(txn)))
    data[WIDTH * 4 + 50] = 0xAB
    path.write_bytes(bytes(data) + b"tail")
    return str(path)


def test_failfast_refuses_a_short_tail(spark, damaged):
    with pytest.raises(Exception, match="incomplete record"):
        X.load_fixed(spark, damaged, C.SALE_LAYOUT).count()


def test_failfast_refuses_damaged_bytes_it_reads(spark, damaged, tmp_path):
    cut = tmp_path / "cut.bin"
    cut.write_bytes(open(damaged, "rb").read()[:-4])
    loaded = X.load_fixed(spark, str(cut), C.SALE_LAYOUT)
    assert loaded.select("sale_no").collect()[4].sale_no == "0" * 18 + "4"
    with pytest.raises(Exception, match="bad sale_worth"):
        loaded.select("sale_worth").collect()


def test_permissive_sets_bad_records_aside(spark, damaged):
    good, bad = X.load_fixed(spark, damaged, C.SALE_LAYOUT, mode="permissive")
    assert good.count() == 1499
    assert [(r.rrn, r.reason) for r in bad.orderBy("rrn").collect()] == [(5, "sale_worth"), (1501, "length")]


def test_lookup_rejects_numbers_below_one(spark, txn):
    records = X.read_records(spark, txn, WIDTH)
    wanted = spark.createDataFrame([(0,), (1,)], "rrn bigint")
    with pytest.raises(Exception, match="start at 1"):
        X.lookup_rrn(records, wanted).collect()
    found = X.lookup_rrn(records, spark.createDataFrame([(1,), (1500,), (1501,), (1,)], "rrn bigint")).collect()
    assert sorted((r.rrn, r.rec is None) for r in found) == [(1, False), (1, False), (1500, False), (1501, True)]


def test_count_field_outside_its_array_is_damage(spark):
    layout = Layout.from_copybook("""
       01 R.
          05 N PIC 9(1).
          05 V OCCURS 1 TO 3 TIMES DEPENDING ON N PIC 9(2).
    """)
    df = spark.createDataFrame([("F2F1F1F2F2F3F3",), ("F0F1F1F2F2F3F3",), ("F9F1F1F2F2F3F3",)], "h string").select(F.unhex("h").alias("rec"))
    good, bad = X.split_records(df, layout)
    assert sorted(r.v for r in good.collect()) == [[], [11, 22]]
    assert [r.reason for r in bad.collect()] == ["v"]


def test_short_lists_and_counts_in_groups(spark):
    layout = Layout.from_copybook("""
       01 R.
          05 HEAD.
             10 MORE.
                15 N PIC 9(1).
          05 V OCCURS 1 TO 3 TIMES DEPENDING ON N PIC 9(2).
          05 LAST PIC X(1).
    """)
    df = spark.sql("""SELECT named_struct('more', named_struct('n', n)) AS head, v, 'x' AS last FROM VALUES
        (2, array(11, 22)), (3, array(1, 2, 3)), (0, array()), (1, array(5, 6, 7)), (2, array(9)), (4, array(1, 2, 3, 4)) AS t(n, v)""")
    rec = X.encode_fixed(df, layout, mode="permissive").select(F.col("head.more.n").alias("n"), "v", "rec")
    got = {(r.n, tuple(r.v)): r.rec and bytes(r.rec).hex().upper() for r in rec.collect()}
    assert got[(2, (11, 22))] == "F2F1F1F2F24040A7" and got[(0, ())] == "F0404040404040A7"
    assert got[(1, (5, 6, 7))] == "F1F0F5F0F6F0F7A7" and got[(2, (9,))] is None and got[(4, (1, 2, 3, 4))] is None
    back = X.decode_records(rec.where("rec IS NOT NULL").select("rec"), layout).collect()
    assert sorted((r.head.more.n, r.v) for r in back) == [(0, []), (1, [5]), (2, [11, 22]), (3, [1, 2, 3])]


def test_convert_returns_the_count(spark, tmp_path):
    path = str(tmp_path / "emp")
    X.write_fixed(C.VENDORS.df(spark, "/root/testdata/sf0.01"), C.VENDOR_LAYOUT, path)
    assert X.convert_extract(spark, path, C.VENDOR_LAYOUT, str(tmp_path / "csv")) == 100
    first = open(sorted(glob.glob(f"{tmp_path}/csv/part-*"))[0]).readline().strip()
    assert first == "vendor_land,vendor_name,vendor_no,vendor_funds"


def test_unread_fields_are_not_decoded(spark, txn):
    loaded = X.load_fixed(spark, txn, C.SALE_LAYOUT).select("sale_state")
    plan = loaded._jdf.queryExecution().executedPlan().toString()
    assert "hex" not in plan.lower() and "ArrowEvalPython" not in plan
