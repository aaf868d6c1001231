"""Shards by balanced label propagation.

Documents start in the shard that a hash of their id gives.  Documents with equal texts are linked.  In every round each
linked document looks at the shards of its group and asks to move to the one where most of the group is, among the
shards that have room.  Requests are granted in a fixed order of priorities up to each shard's quota, in such a way that
members of one group are granted together as far as possible.  The rounds end when nobody moves.  Then counts are made
even: documents beyond a shard's quota, those without links first, go to shards below theirs.  A group larger than a quota
fills one shard after the other.

What the driver sees is bounded: counts by shard, shard asked for and one of ``PRIORITIES`` priorities.  Groups may be of
any size; their counts by shard are pre-aggregated, and the joins on the group are between stored tables, so that
adaptive execution splits a hot group.

A null text has size 1 and counts as equal to other nulls and to the empty text.  Repeated rows and ids are rows of
their own, and null ids are placed like others.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonedeck.llm.frames import staged

SHARDS, ROUNDS = 8, 10
#: Priorities of requests: groups fall into the first number of classes, rows of a group into the second.
PRIORITIES = (32, 64)
#: Rows numbered together.
CELL_ROWS = 20_000


def _rows(docs: DataFrame, id_col: str, text_col: str, shards: int) -> DataFrame:
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("text_hash"),
                       F.xxhash64(F.monotonically_increasing_id()).alias("row_hash"),
                       F.pmod(F.xxhash64(F.col(id_col).cast("bigint")), F.lit(shards)).cast("int").alias("shard"))


def _loads(rows: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()}
    return [found.get(s, 0) for s in range(shards)]


def _granted(asked: list, loads: list[int], quota: int) -> list[int]:
    """For each shard, the priority below which requests to it are granted, so that no quota is exceeded.

    ``asked`` has source, target, priority and count.  A request may use room that a granted one makes.
    """
    top = PRIORITIES[0] * PRIORITIES[1]
    cuts = [top] * len(loads)
    while True:
        after = list(loads)
        for source, target, priority, count in asked:
            if priority < cuts[target]:
                after[source] -= count
                after[target] += count
        over = [s for s in range(len(loads)) if after[s] > max(quota, loads[s]) and cuts[s] > 0]
        if not over:
            return cuts
        for s in over:
            excess = after[s] - max(quota, loads[s])
            for p, count in sorted(((p, n) for _, t, p, n in asked if t == s and p < cuts[s]), reverse=True):
                if excess <= 0:
                    break
                excess -= count
                cuts[s] = p


def _by_shard(values: list[int], key: str = "shard") -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("bigint") for v in values]), F.col(key) + 1)


def propagate(rows: DataFrame, shards: int, quota: int, rounds: int = ROUNDS) -> DataFrame:
    """Move linked rows (equal ``text_hash``) towards each other's shards; no shard gets more of them than the quota.

    Rows without links need no quota here: they can make room anywhere later without cutting a link.
    """
    groups = staged(rows.groupBy("text_hash").count().where("count > 1").select("text_hash"), "shards-groups")
    linked = F.lit(True).alias("linked")
    rows = staged(rows.join(groups.select("text_hash", linked), "text_hash", "left").withColumn(
        "linked", F.coalesce("linked", F.lit(False))), "shards-rows")
    closed: set[int] = set()
    for _ in range(rounds):
        loads = _loads(rows.where("linked"), shards)
        open_ = [s for s in range(shards) if loads[s] < quota and s not in closed]
        counts = rows.where("linked").groupBy("text_hash", "shard").count()
        best = F.array_max(F.filter("of_shard", lambda x: x["shard"].isin(open_) if open_ else F.lit(False)))
        wanted = staged(counts.groupBy("text_hash").agg(
            F.collect_list(F.struct("count", (-F.col("shard")).alias("order"), "shard")).alias("of_shard"))
            .where(F.size("of_shard") > 1)
            .select("text_hash", F.map_from_arrays("of_shard.shard", "of_shard.count").alias("counts"),
                    best.alias("best")).where("best is not null"), "shards-wanted")
        # Ties go to the lesser shard, so that two halves of a group do not change places.
        here = F.element_at("counts", F.col("shard"))
        moves = (F.col("best.count") > here) | ((F.col("best.count") == here) & (F.col("best.shard") < F.col("shard")))
        rows_asked = rows.where("linked").join(wanted, "text_hash").where(moves & (F.col("best.shard") != F.col("shard")))
        priority = (F.pmod(F.xxhash64("text_hash"), F.lit(PRIORITIES[0])) * PRIORITIES[1]
                    + F.pmod("row_hash", F.lit(PRIORITIES[1]))).cast("int")
        rows_asked = staged(rows_asked.select("row_hash", "text_hash", F.col("shard"), F.col("best.shard").alias("target"),
                                              priority.alias("priority")), "shards-asked")
        asked = [(r["shard"], r["target"], r["priority"], r["count"])
                 for r in rows_asked.groupBy("shard", "target", "priority").count().collect()]
        cuts = _granted(asked, loads, quota)
        # A shard that had to turn requests down is as good as full from now on.
        full = {t for _, t, p, _ in asked if p >= cuts[t]}
        if not asked or not full - closed and not any(p < cuts[t] for _, t, p, _ in asked):
            break
        closed |= full
        moved = rows_asked.where(F.col("priority") < _by_shard(cuts, "target")).select("row_hash", "target")
        rows = staged(rows.join(moved, "row_hash", "left").withColumn("shard", F.coalesce("target", "shard"))
                      .drop("target"), "shards-rows")
    return rows


def numbered(rows: DataFrame, shards: int) -> DataFrame:
    """Add ``slot``, gapless from 0 in each shard, linked rows first; no task numbers more than a few cells."""
    total = rows.count()
    cells = max(1, total // (shards * CELL_ROWS))
    placed = rows.withColumn("late", (~F.col("linked")).cast("int")).withColumn(
        "cell", F.pmod("row_hash", F.lit(cells)).cast("int"))
    place = ["shard", "late", "cell"]
    before = Window.partitionBy("shard").orderBy("late", "cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(placed.groupBy(*place).count().select(
        *place, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")), "shards-offsets")
    inside = F.row_number().over(Window.partitionBy(*place).orderBy("text_hash", "doc_id", "row_hash")) - 1
    return placed.withColumn("inside", inside).join(offsets, place).withColumn(
        "slot", (F.col("inside") + F.col("offset")).cast("bigint")).drop("late", "cell", "inside", "offset")


def evened(rows: DataFrame, shards: int) -> DataFrame:
    """Move rows beyond each shard's even share to shards below theirs; counts then differ by one at most."""
    loads = _loads(rows, shards)
    total = sum(loads)
    share = [total // shards + (s < total % shards) for s in range(shards)]
    # Rows over the share, in order of shard, fill the gaps, in order of shard.
    over, gaps, a, b = [], [], 0, 0
    for s in range(shards):
        over.append(a)
        gaps.append(b)
        a += max(0, loads[s] - share[s])
        b += max(0, share[s] - loads[s])
    place = F.col("slot") - _by_shard(share) + _by_shard(over)
    target, slot = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    for s in range(shards):
        if share[s] > loads[s]:
            fits = (place >= gaps[s]) & (place < gaps[s] + share[s] - loads[s])
            target = F.when(fits, F.lit(s)).otherwise(target)
            slot = F.when(fits, place - gaps[s] + loads[s]).otherwise(slot)
    goes = F.col("slot") >= _by_shard(share)
    return rows.select(*[c for c in rows.columns if c not in ("shard", "slot")],
                       F.when(goes, target).otherwise(F.col("shard")).alias("shard"),
                       F.when(goes, slot).otherwise(F.col("slot")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
                    rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, text_hash, shard, slot`` for every row; shards hold equal counts, give or take one."""
    rows = staged(_rows(docs, id_col, text_col, shards), "shards-rows")
    quota = -(-rows.count() // shards)
    placed = staged(numbered(propagate(rows, shards, quota, rounds), shards), "shards-numbered")
    return evened(placed, shards).select("doc_id", "size", "text_crc32", "text_hash", "shard", "slot")
