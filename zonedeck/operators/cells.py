"""Exact nearest vectors over two levels of cells, for vector tables that no task can hold.

Cells.  A bounded sample of the vectors, about twice the square root of their number, serves as pivots; the square root
of those are outer pivots, and every pivot belongs to the outer one next to it.  A vector's cell is the nearest pivot of
its nearest outer pivot.  Only the pivots and a few numbers for each cell leave the executors.

Search.  A query first looks at the cells next to it that hold k vectors, which gives a distance that its k nearest ones
cannot exceed.  With this bound it visits the other cells that may still matter: a cell is left out if it lies wholly
beyond the bound, either because its radius does not reach that far, or because the plane half-way between its pivot
and the pivot next to the query lies further off.  Both tests are made for outer cells first and for cells inside
those that are left.  Vectors without a direction have a cell of their own.

Where a trial of some queries shows that the bounds rule out too little, so that a query would be sent to many cells, all
vectors are compared instead: queries and vectors are stored as packed blocks, every task reads some of either from the
shared folder, and only the best of each query and task are shuffled.

A crowded cell is cut into blocks by id hash, and the queries of a cell that is much asked for by their own hash, so no
task holds more than two matrices of the stated size, however unevenly vectors and queries lie.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonedeck.session import staged

# Workers get this module with the task, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Distances computed at a time in a task.
SLICE_BYTES = 64 << 20
#: Queries that show whether cells are worth it, and cells besides the first ones a query may be sent to on average.
TRIAL, MOST_CELLS = 512, 8
#: Bytes of a packed block, whatever the limit of a matrix, and pairs of blocks that go to Python at a time.
BLOCK_BYTES, PAIRS = 2 << 20, "4"
#: Products of two blocks that are looked at together.
CACHE_BYTES = 2 << 20
#: Distances that agree to this many decimals are ties and go by id.
TIE_DECIMALS = 9


def unit_rows(column) -> np.ndarray:
    """Arrow list column of equal lengths to a matrix of unit rows; rows of zeros stay."""
    import pyarrow.compute as pc

    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    rows = len(column)
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype("float64")
    matrix = flat.reshape(rows, -1) if rows else np.zeros((0, 0))
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def closest(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and cosine distances of the k nearest; ``vectors`` must be in id order for ties."""
    distance = 1.0 - queries @ vectors.T
    order = np.argsort(np.round(distance, TIE_DECIMALS), axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(distance, order, axis=1)


def _gaps(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances on the unit sphere, straight through it."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (unit @ pivots.T)))


def _planes(gaps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """How far the plane between each pivot and the one nearest to the query is from the query."""
    near = gaps.argmin(axis=1)
    apart = _gaps(pivots, pivots)[near]
    square = gaps ** 2 - np.take_along_axis(gaps, near[:, None], axis=1) ** 2
    return np.divide(square, 2 * apart, out=np.zeros_like(gaps), where=apart > 1e-6)


def reach_of(distance: np.ndarray) -> np.ndarray:
    """A cosine distance as one on the unit sphere, with room for ties and rounding."""
    return np.sqrt(2 * np.maximum(0.0, distance + 2 * 10.0 ** -TIE_DECIMALS)) + 1e-6


class Cells:
    """Pivots in the order of their outer ones, and what is known of each cell."""

    def __init__(self, sample: np.ndarray):
        dim = sample.shape[1] if sample.size else 1
        pivots = np.unique(sample[(sample * sample).sum(axis=1) > 0], axis=0)
        if not len(pivots):
            pivots = np.eye(1, dim)
        pivots = np.random.default_rng(0).permutation(pivots)
        self.outer = pivots[: math.isqrt(len(pivots))]
        parent = _gaps(pivots, self.outer).argmin(axis=1)
        order = np.argsort(parent, kind="stable")
        self.pivots = pivots[order]
        self.starts = np.searchsorted(parent[order], np.arange(len(self.outer) + 1))
        #: The cell of vectors without a direction.
        self.nowhere = len(pivots)
        self.counts = np.zeros(len(pivots) + 1, "int64")
        self.radius, self.outer_radius = np.zeros(len(pivots) + 1), np.zeros(len(self.outer))

    def inside(self, outer: int) -> slice:
        return slice(self.starts[outer], self.starts[outer + 1])

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each vector, its distance to the pivot and to the outer pivot."""
        gaps = _gaps(unit, self.outer) if len(unit) else np.zeros((0, len(self.outer)))
        own = gaps.argmin(axis=1) if len(unit) else np.zeros(0, int)
        cell, reach = np.zeros(len(unit), int), np.zeros(len(unit))
        for outer in np.unique(own):
            rows, part = np.flatnonzero(own == outer), self.inside(outer)
            inner = _gaps(unit[rows], self.pivots[part])
            cell[rows] = inner.argmin(axis=1) + part.start
            reach[rows] = inner.min(axis=1)
        zero = (unit * unit).sum(axis=1) == 0
        cell[zero], reach[zero] = self.nowhere, 0.0
        return cell, reach, np.where(zero, 0.0, gaps.min(axis=1) if len(unit) else 0.0)

    def learn(self, stats: list) -> None:
        """Take over ``cell, n, reach, outer`` of the cells that hold vectors."""
        for s in stats:
            self.counts[s["_cell"]], self.radius[s["_cell"]] = s["n"], s["reach"]
            if s["_cell"] != self.nowhere:
                outer = np.searchsorted(self.starts, s["_cell"], side="right") - 1
                self.outer_radius[outer] = max(self.outer_radius[outer], s["outer"])

    def first(self, unit: np.ndarray, k: int) -> list[list[int]]:
        """For each query cells next to it that hold k vectors together, or all."""
        cells = self.place(unit)[0]
        homes = [[int(c)] for c in cells]
        for row in np.flatnonzero(self.counts[cells] < k):
            gaps = np.append(_gaps(unit[row:row + 1], self.pivots)[0], math.sqrt(2.0))
            order = np.argsort(gaps, kind="stable")
            order = order[self.counts[order] > 0]
            enough = int(np.searchsorted(np.cumsum(self.counts[order]), k)) + 1
            homes[row] = order[:enough].tolist()
        return homes

    def further(self, unit: np.ndarray, bound: np.ndarray, homes: list[list[int]]) -> list[list[int]]:
        """For each query the other cells that can hold a vector within its bound."""
        zero = (unit * unit).sum(axis=1) == 0
        gaps = _gaps(unit, self.outer)
        low = np.maximum(gaps - self.outer_radius, _planes(gaps, self.outer))
        low[zero] = 0.0
        rows, cells = [np.flatnonzero((bound >= math.sqrt(2.0) - 1e-6) | zero)], []
        cells.append(np.full(len(rows[0]), self.nowhere))
        for outer in range(len(self.outer)):
            asked, part = np.flatnonzero(low[:, outer] <= bound), self.inside(outer)
            if not len(asked) or part.start == part.stop:
                continue
            inner = _gaps(unit[asked], self.pivots[part])
            least = np.maximum(inner - self.radius[part], _planes(inner, self.pivots[part]))
            least[zero[asked]] = 0.0
            r, c = np.nonzero(least <= bound[asked, None])
            rows.append(asked[r])
            cells.append(c + part.start)
        rows, cells = np.concatenate(rows), np.concatenate(cells)
        held = self.counts[cells] > 0
        found: list[list[int]] = [[] for _ in range(len(unit))]
        for r, c in zip(rows[held].tolist(), cells[held].tolist()):
            found[r].append(c)
        return [[c for c in own if c not in home] for own, home in zip(found, map(set, homes))]


def _int_lists(lists: list[list[int]]) -> pa.Array:
    return pa.array(lists, pa.list_(pa.int32()))


_INTS = T.ArrayType(T.IntegerType())


def build(vectors: DataFrame, vector: str, vec_id: str, total: int, dim: int, most_bytes: int) -> tuple[Cells, DataFrame]:
    """The cells of a table, and the table's ``_vid, _vec, _cell``.  The pivots take ``most_bytes`` at most."""
    wanted = max(1, min(most_bytes // (8 * dim), 2 * math.isqrt(total) + 1))
    sample = vectors.orderBy(F.xxhash64(vec_id), vec_id).select(vector).limit(wanted).toArrow()
    cells = Cells(unit_rows(sample.column(0)))
    plain = vectors.select(F.col(vec_id).alias("_vid"), F.col(vector).alias("_vec"))

    def work(batches):
        for batch in batches:
            cell, reach, outer = cells.place(unit_rows(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype("int32")), pa.array(reach), pa.array(outer)],
                names=[*batch.schema.names, "_cell", "_reach", "_outer"])

    schema = T.StructType([*plain.schema.fields, T.StructField("_cell", T.IntegerType()),
                           T.StructField("_reach", T.DoubleType()), T.StructField("_outer", T.DoubleType())])
    placed = plain.mapInArrow(work, schema)
    cells.learn(placed.groupBy("_cell").agg(F.count("*").alias("n"), F.max("_reach").alias("reach"),
                                            F.max("_outer").alias("outer")).collect())
    return cells, placed.select("_vid", "_vec", "_cell")


def _search(asked: DataFrame, kept: DataFrame, cells: Cells, k: int, rows: int) -> DataFrame:
    """``_qid, _vid, _distance``: the k nearest vectors of each cell, or block of one, that a query asks for.

    ``asked`` is a stored table of ``_qid, _vec, _cells``.
    """
    spark = asked.sparkSession
    wanted = asked.select("_qid", "_vec", F.explode("_cells").alias("_cell"))
    # One number for each cell that is asked for by many or crowded; there are never more than the cells.
    queries = {r["_cell"]: r["n"] for r in wanted.groupBy("_cell").agg(F.count("*").alias("n")).where(F.col("n") > rows).collect()}
    crowded = sorted({*queries, *np.flatnonzero(cells.counts > rows).tolist()})
    sizes = spark.createDataFrame([(c, max(1, -(-int(cells.counts[c]) // rows)), max(1, -(-queries.get(c, 0) // rows)))
                                   for c in crowded], "_cell int, _blocks int, _salts int")
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    sized = lambda df: df.join(F.broadcast(sizes), "_cell", "left")
    right = (sized(kept).withColumn("_block", F.pmod(F.xxhash64("_vid"), one("_blocks")).cast("int"))
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), one("_salts") - 1))).drop("_blocks", "_salts"))
    left = (sized(wanted).withColumn("_salt", F.pmod(F.xxhash64("_qid"), one("_salts")).cast("int"))
            .withColumn("_block", F.explode(F.sequence(F.lit(0), one("_blocks") - 1))).drop("_blocks", "_salts"))
    out = T.StructType([T.StructField("_qid", asked.schema["_qid"].dataType),
                        T.StructField("_vid", kept.schema["_vid"].dataType), T.StructField("_distance", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(out)

    def work(key, left, right):
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        right = right.sort_by("_vid")
        matrix = unit_rows(right.column("_vec"))
        step, parts = max(1, SLICE_BYTES // (8 * right.num_rows)), []
        for start in range(0, left.num_rows, step):
            part = left.slice(start, step)
            order, distance = closest(unit_rows(part.column("_vec")), matrix, k)
            parts.append(pa.table({
                "_qid": part.column("_qid").take(pa.array(np.repeat(np.arange(part.num_rows), order.shape[1]))),
                "_vid": right.column("_vid").take(pa.array(order.ravel())),
                "_distance": pa.array(distance.ravel()),
            }).cast(schema))
        return pa.concat_tables(parts)

    place = ["_cell", "_block", "_salt"]
    return left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(work, out)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("_qid").orderBy(F.round("_distance", TIE_DECIMALS), "_vid")
    return found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)


def _with_lists(queries: DataFrame, lists) -> DataFrame:
    """Add ``_cells``, worked out batch by batch from unit rows and the batch."""
    def work(batches):
        for batch in batches:
            found = lists(unit_rows(batch.column(1)), batch) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, _int_lists(found)], names=[*batch.schema.names, "_cells"])

    return queries.mapInArrow(work, T.StructType([*queries.schema.fields, T.StructField("_cells", _INTS)]))


def _packed(rows: DataFrame, key: str, name: str, most: int) -> DataFrame:
    """``<name>_ids, <name>_unit``: up to ``most`` rows (id, vector) as one, in order of the id, with unit rows as bytes."""
    def work(batches):
        def packed(held):
            part = pa.Table.from_batches(held)
            if name == "v":
                part = part.sort_by(key)
            ids = part.column(0).combine_chunks()
            unit = np.ascontiguousarray(unit_rows(part.column(1)))
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([unit.tobytes()], pa.binary())],
                names=[f"{name}_ids", f"{name}_unit"])

        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - n)
                held.append(part)
                n, batch = n + part.num_rows, batch.slice(part.num_rows)
                if n == most:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    out = T.StructType([T.StructField(f"{name}_ids", T.ArrayType(rows.schema[key].dataType)),
                        T.StructField(f"{name}_unit", T.BinaryType())])
    return rows.select(key, "_vec").mapInArrow(work, out)


def _nearer(queries: np.ndarray, vectors: np.ndarray, narrow: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Row, column, distance and rounded distance of up to k vectors for each query that lie within its bound.

    ``narrow`` are the vectors at half the precision, turned; what may be near enough by them is compared in full.
    """
    # Twice what the sum of so many rounded products can be off by, and room for ties.
    slack = (len(narrow) + 8) * 1.2e-7 + 2 * 10.0 ** -TIE_DECIMALS
    alike = queries.astype("float32") @ narrow
    least = 1.0 - bound - slack
    loose = np.isinf(bound) & (k < len(vectors))
    if loose.any():
        # No more than the k nearest of this block.
        least[loose] = np.partition(alike[loose], len(vectors) - k, axis=1)[:, len(vectors) - k] - 2 * slack
    row, column = np.nonzero(alike >= least[:, None].astype("float32"))
    if 8 * len(row) > alike.size:
        distance = 1.0 - (queries @ vectors.T)[row, column]
    else:
        distance = 1.0 - np.einsum("ij,ij->i", queries[row], vectors[column])
    rounded = np.round(distance, TIE_DECIMALS)
    order = np.lexsort((column, rounded, row))
    row, column, distance, rounded = row[order], column[order], distance[order], rounded[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept = place < k
    return row[kept], column[kept], distance[kept], rounded[kept]


def scan(queries: DataFrame, vectors: DataFrame, k: int, dim: int) -> DataFrame:
    """``_qid, _vid, _distance, _rank`` of the k nearest of all vectors ``_vid, _vec`` for each query ``_qid, _vec``.

    Blocks are read by the tasks, not shuffled; a task ends with at most k rows for each of its queries.
    """
    spark = queries.sparkSession
    most = max(1, BLOCK_BYTES // (8 * dim))
    left = staged(_packed(queries, "_qid", "q", most), "nearest-queries")
    right = staged(_packed(vectors, "_vid", "v", most), "nearest-vectors")
    qid, vid = queries.schema["_qid"].dataType, vectors.schema["_vid"].dataType
    out = T.StructType([T.StructField("_qid", qid), T.StructField("_vid", vid), T.StructField("_distance", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(out)

    def best(ids, found):
        if not found:
            return
        table = pa.concat_tables(found).sort_by([("row", "ascending"), ("rounded", "ascending"), ("id", "ascending")])
        row = table.column("row").to_numpy()
        table = table.filter(pa.array(np.arange(len(row)) - np.searchsorted(row, row) < k))
        columns = [ids.take(table.column("row").combine_chunks()), table.column("id"), table.column("distance")]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        yield from pa.table(columns, names=schema.names).cast(schema).to_batches(max_chunksize=1 << 16)

    def work(batches):
        ids, unit, bound, found = None, None, None, []
        for batch in batches:
            for i in range(batch.num_rows):
                # The pairs of a block of queries follow one another.
                asked = batch.column(0)[i].values
                if ids is None or not asked.equals(ids):
                    yield from best(ids, found)
                    ids, found = asked, []
                    unit = np.frombuffer(batch.column(1)[i].as_buffer(), "float64").reshape(len(ids), -1)
                    bound = np.full(len(ids), np.inf)
                others = batch.column(2)[i].values
                matrix = np.frombuffer(batch.column(3)[i].as_buffer(), "float64").reshape(len(others), -1)
                narrow = np.ascontiguousarray(matrix.T.astype("float32"))
                step = max(1, CACHE_BYTES // (4 * len(others)))
                for start in range(0, len(ids), step):
                    part = slice(start, start + step)
                    row, column, distance, rounded = _nearer(unit[part], matrix, narrow, bound[part], k)
                    if not len(row):
                        continue
                    found.append(pa.table({"row": pa.array(row + start), "rounded": rounded, "distance": distance,
                                           "id": others.take(pa.array(column))}))
                    # The k-th distance of these vectors bounds what can still matter.
                    last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == k - 1)
                    at = row[last] + start
                    bound[at] = np.minimum(bound[at], rounded[last])
        yield from best(ids, found)

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, PAIRS)
    try:
        near = staged(left.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(work, out), "nearest-scan")
    finally:
        spark.conf.set(name, before)
    return _best(near, k)


def search_plan(queries: DataFrame, vectors: DataFrame, k: int, total: int, dim: int, vector: str, vec_id: str,
                most_bytes: int) -> tuple[DataFrame, DataFrame, Cells]:
    """``_qid, _vid, _distance, _rank`` of the k nearest vectors of each query ``_qid, _vec``, and the cells that were
    asked for besides the first ones, as a stored table ``_qid, _vec, _cells``."""
    cells, kept = build(vectors, vector, vec_id, total, dim, most_bytes)
    rows = max(1, most_bytes // (8 * dim))
    k = min(k, total)

    def looked(asked):
        """The finds of the first cells, and the further cells, of some queries."""
        homes = staged(_with_lists(asked, lambda unit, batch: cells.first(unit, k)), "nearest-homes")
        near = staged(_best(_search(homes, kept, cells, k, rows), k), "nearest-first")
        bounds = near.where(F.col("_rank") == k).select("_qid", F.col("_distance").alias("_bound"))
        known = homes.withColumnRenamed("_cells", "_homes").join(bounds, "_qid")
        more = _with_lists(known.select("_qid", "_vec", "_homes", "_bound"), lambda unit, batch: cells.further(
            unit, reach_of(batch.column(3).to_numpy(zero_copy_only=False)), batch.column(2).to_pylist()))
        return near, staged(more.select("_qid", "_vec", "_cells"), "nearest-further")

    trial = queries.orderBy(F.xxhash64("_qid"), "_qid").limit(TRIAL)
    _, more = looked(trial)
    if (more.agg(F.avg(F.size("_cells"))).first()[0] or 0) > MOST_CELLS:
        plain = vectors.select(F.col(vec_id).alias("_vid"), F.col(vector).alias("_vec"))
        return scan(queries, plain, k, dim), more, cells
    near, more = looked(queries)
    further = _search(more, kept, cells, k, rows)
    return _best(near.drop("_rank").unionByName(further), k), more, cells
