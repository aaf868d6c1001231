"""Differences of long numbers whose leading digits borrow."""

from pyspark.sql import functions as F

from zonedeck.functions import compare


def test_long_borrow(spark):
    rows = [(str(10 ** n), str(10 ** n - d), d) for n in (39, 40, 60) for d in (1, 7, 1000)]
    rows += [(str(5 * 10 ** 45 - 2), str(5 * 10 ** 45 + 3), 5), ("-" + str(10 ** 39), "-" + "9" * 39, 1), ("3" * 50, "3" * 49 + "1", 2)]
    df = spark.createDataFrame(rows, "e string, a string, d bigint").repartition(1)
    got = df.select("d", F.get(compare.token_pairs(F.array("e"), F.array("a")), F.lit(0))["diff"].alias("diff")).collect()
    assert [(r.diff == r.d) for r in got] == [True] * len(rows), got
