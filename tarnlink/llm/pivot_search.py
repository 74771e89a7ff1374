"""Exact top-k by inner product with a pivot table: bounds on distances order blocks and candidates and end each search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors of a task, about, and queries of a task; rows the pivots are chosen from.
CANDIDATES, QUERIES, SAMPLE = 8192, 2048, 4096
#: Rings about a pivot at most, and vectors of a ring before there is another.
RINGS, RING = 16, 1024
#: Candidates evaluated between two looks at the stopping rule, and pivots that bound a single candidate.
STEP, CLOSE = 512, 8
_FOUND = "query_id long, vec_id long, score long, evaluated long"


def whole(scale: int = 64, name: str = "embedding"):
    """The vector as floor(scale * x) of its components, null unless all are finite numbers."""
    fine = F.col(name).isNotNull() & F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(fine, F.transform(name, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((v * v).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * v @ pivots.T, 0))


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Each pivot is the row of the sample farthest from those before it; rows at no distance from one add nothing."""
    at, near = [0], distances(sample, sample[:1])[:, 0]
    while len(at) < min(count, len(sample)) and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, distances(sample, sample[at[-1:]])[:, 0])
    return sample[at]


class Blocks:
    """For each block of vectors its greatest squared length, and its least and greatest distance to each pivot."""

    def __init__(self, size: int, pivots: int):
        self.count, self.square = np.zeros(size, np.int64), np.zeros(size)
        self.low, self.high = np.full((size, pivots), np.inf), np.full((size, pivots), -np.inf)

    def bounds(self, norm: float, far: np.ndarray, of: np.ndarray) -> np.ndarray:
        """No inner product of a query of that squared length, at distances far, with a vector of the blocks is above.

        Inner product is (|q|^2 + |x|^2 - distance^2) / 2, and no distance is below the difference of two distances to a
        pivot.
        """
        below = np.maximum(np.maximum(self.low[of] - far, far - self.high[of]).max(1), 0)
        return _bound(norm, self.square[of], below)

    def tasks(self) -> tuple[np.ndarray, np.ndarray]:
        """For each block its task, and the parts that task is dealt to: small blocks share one, large ones are in parts."""
        task, parts, now, size = np.zeros(len(self.count), np.int64), np.ones(len(self.count), np.int64), 0, 0
        for b, n in enumerate(self.count.tolist()):
            if size and size + n > CANDIDATES:
                now, size = now + 1, 0
            task[b], size = now, size + n
            parts[b] = max(1, -(-n // CANDIDATES))
        return task, parts


def _bound(norm: float, square: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Rounding never makes a bound too sharp."""
    below = np.maximum(below - 1e-6 * (1 + below) - 1e-7 * np.sqrt(norm + square), 0)
    return (norm + square - below * below) / 2 * (1 + 1e-9) + 1e-6


def search_block(ids, vectors, table, block, blocks: Blocks, query_ids, queries, query_table, floors, k: int, exact: bool = False):
    """The k best (query, id, score: by score desc, id asc) of these candidates for each query, as far as they reach its
    floor, and how many candidates were evaluated for each query.

    First the block of greatest bound, then the others that still reach; of each the STEP candidates of greatest bound, then
    those that reach what these have found. No bound below the floor or the k-th score found is followed.
    """
    order = np.lexsort((ids, block))
    ids, vectors, table, block = ids[order], vectors[order], np.ascontiguousarray(table[order].T), block[order]
    own, starts, lengths = np.unique(block, return_index=True, return_counts=True)
    square = (vectors * vectors).sum(1)
    values = vectors.astype(np.int64) if exact else vectors
    low, high, most = blocks.low[own], blocks.high[own], blocks.square[own]
    out, seen = [], []
    for q, query, far, floor in zip(query_ids, queries, query_table, floors, strict=True):
        norm, asked = float(query @ query), query.astype(np.int64) if exact else query
        bounds = _bound(norm, most, np.maximum(np.maximum(low - far, far - high).max(1), 0))
        close = np.argpartition(far, min(CLOSE, len(far) - 1))[:CLOSE]
        bound = _bound(norm, square, np.abs(table[close] - far[close, None]).max(0))
        bound[ids == q] = -np.inf
        best, names, count, least = np.empty(0, values.dtype), np.empty(0, np.int64), 0, floor

        def look(rows, scores):
            nonlocal best, names, least
            good = np.flatnonzero((scores >= least) & (bound[rows] > -np.inf))  # noqa: B023
            best, names = np.concatenate((best, scores[good])), np.concatenate((names, ids[rows][good]))
            top = np.lexsort((names, -best))[:k]
            best, names = best[top], names[top]
            if len(best) >= k:
                least = max(least, best[-1])

        home = int(bounds.argmax())
        for turn in (0, 1):
            reach = np.zeros(len(own), bool)
            reach[home] = True
            if turn:
                reach = ~reach & (bounds >= least)
            rest = np.flatnonzero((bound >= least) & (bound > -np.inf) & np.repeat(reach, lengths))
            if len(rest) > STEP:
                cut = np.argpartition(-bound[rest], STEP)
                now, rest = rest[cut[:STEP]], np.sort(rest[cut[STEP:]])
                count += len(now)
                look(now, values[now] @ asked)
                rest = rest[bound[rest] >= least]
            if len(rest):
                span = slice(int(rest[0]), int(rest[-1]) + 1)
                count += len(rest)
                # nearly all of a stretch: its product at once spares the copy
                look(rest, (values[span] @ asked)[rest - span.start] if 2 * len(rest) > span.stop - span.start else values[rest] @ asked)
        out.append((np.full(len(best), q), names, best))
        seen.append(count)
    return [np.concatenate(x) for x in zip(*out, strict=True)], seen


def _table(rows: DataFrame, width: int, pivots: np.ndarray) -> DataFrame:
    """rows (vec_id, v) with t, the distances to all pivots, the nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = distances(_matrix(b.column(1), width), pivots)
            table = pa.ListArray.from_arrays(pa.array(np.arange(0, far.size + 1, len(pivots), dtype=np.int32)), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), table, pa.array(far.argmin(1).astype(np.int32)), pa.array(far.min(1))], ["vec_id", "v", "t", "cell", "d"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, t array<double>, cell int, d double")


def _summary(rows: DataFrame, width: int, pivots: int, size: int) -> Blocks:
    """Blocks of rows (block, v, t): each partition sends one row a block and pivot, the driver gets size * (pivots + 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Blocks(size, pivots)
        for b in batches:
            block, v, t = b.column(0).to_numpy(), _matrix(b.column(1), width), _matrix(b.column(2), pivots)
            np.add.at(own.count, block, 1)
            np.maximum.at(own.square, block, (v * v).sum(1))
            np.minimum.at(own.low, block, t)
            np.maximum.at(own.high, block, t)
        used = np.flatnonzero(own.count)
        pivot = np.tile(np.arange(pivots), len(used))
        one = [np.repeat(used, pivots), pivot, own.low[used].ravel(), own.high[used].ravel(), np.zeros(len(pivot), np.int64)]
        two = [used, np.full(len(used), -1), np.zeros(len(used)), own.square[used], own.count[used]]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(one, two, strict=True)], ["block", "p", "low", "high", "n"])

    found = rows.select("block", "v", "t").mapInArrow(run, "block long, p long, low double, high double, n long")
    out = Blocks(size, pivots)
    for r in found.groupBy("block", "p").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect():
        if r.p < 0:
            out.square[r.block], out.count[r.block] = r.high, r.n
        else:
            out.low[r.block, r.p], out.high[r.block, r.p] = r.low, r.high
    return out


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, pivots: int = 64, scale: int = 64, counted: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries with vec_id divisible by every, against all other rows.

    vectors (vec_id, embedding) become whole numbers floor(scale * x); scores are exact inner products, ties to the smaller
    vec_id; fewer than k candidates give fewer rows. Rows that are null, of null vec_id or with null or non-finite
    components take no part; vectors shorter than the longest are padded with 0; rows that repeat a vec_id count once, the
    greatest vector standing. An empty table gives no rows; inner products that may pass 64 bits raise an error. counted
    adds evaluated, the candidates evaluated for the query in all.

    Vectors are dealt into blocks, rings about their nearest pivot, of which the driver holds RINGS * pivots bounds at
    most. A query first searches the block of greatest bound; its k-th score there then goes along to those other blocks
    whose bound reaches it. A task holds at most about CANDIDATES vectors and QUERIES queries.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole(scale).alias("v")).where("vec_id is not null and v is not null")
    rows = materialize(rows.groupBy("vec_id").agg(F.max("v").alias("v")), "pivot-vectors")
    n, width, most = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not width:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long" + ", evaluated long" * counted)
    if width * most * most >= 2.0**63:
        raise ValueError("inner products of these vectors may pass 64 bits")
    exact = width * most * most >= 2.0**53  # beyond what doubles add up exactly
    padded = F.when(F.size("v") == width, F.col("v")).otherwise(F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))))
    chosen = rows.select("vec_id", padded.alias("v")).orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(SAMPLE).collect()
    points = spread_pivots(np.array([r.v for r in chosen], np.float64), pivots)
    pivots, rings = len(points), int(min(RINGS, max(1, n // (pivots * RING))))
    table = _table(rows.select("vec_id", padded.alias("v")), width, points)
    if rings > 1:
        cuts = table.groupBy("cell").agg(F.percentile_approx("d", [i / rings for i in range(1, rings)]).alias("cuts"))
        table = table.join(F.broadcast(cuts), "cell").withColumn("ring", F.size(F.filter("cuts", lambda x: x < F.col("d"))))
    else:
        table = table.withColumn("ring", F.lit(0))
    table = table.select("vec_id", "v", "t", (F.col("cell") * rings + F.col("ring")).cast("long").alias("block"))
    table = materialize(table, "pivot-table", done=(rows,))
    blocks = _summary(table, width, pivots, pivots * rings)
    task, parts = blocks.tasks()
    known = np.flatnonzero(blocks.count)
    layout = vectors.sparkSession.createDataFrame([(int(b), int(task[b]), int(parts[b])) for b in known], "block long, task long, parts long")
    part = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("parts"))
    placed = table.join(F.broadcast(layout), "block").select("vec_id", "v", "t", "block", "task", part.alias("part"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where each query (vec_id, v, t, floor, done) goes: the task of greatest bound, then all others that reach."""
        for b in batches:
            out = []
            cols = b.column(0).to_pylist(), _matrix(b.column(1), width), _matrix(b.column(2), pivots), b.column(3).to_pylist(), b.column(4).to_pylist()
            for i, (_, query, far, floor, done) in enumerate(zip(*cols, strict=True)):
                bounds = blocks.bounds(float(query @ query), far, known)
                if done is None:
                    out.append((i, int(task[known[bounds.argmax()]]), 0))
                    continue
                near = known if floor is None else known[bounds >= floor]
                for own in np.unique(task[near]).tolist():
                    out += [(i, own, j) for j in range(int(parts[task == own].max())) if (own, j) != (done, 0)]
            some = b.take(pa.array([x[0] for x in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(4)), *(pa.array([x[i] for x in out], pa.int64()) for i in (1, 2))], ["vec_id", "v", "t", "floor", "task", "part"])

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return pa.Table.from_pylist([], pa.schema([(x.split()[0], pa.int64()) for x in _FOUND.split(", ")]))
        left = a["vec_id"].to_numpy(), _matrix(a["v"], width), _matrix(a["t"], pivots), a["block"].to_numpy()
        floors = [-np.inf if x is None else x for x in b["floor"].to_pylist()]
        asked = b["vec_id"].to_numpy()
        (q, x, s), seen = search_block(*left, blocks, asked, _matrix(b["v"], width), _matrix(b["t"], pivots), floors, k, exact)
        none = np.zeros(len(asked), np.int64)  # a row without vec_id says how many were evaluated
        cols = [np.concatenate((q, asked)), np.concatenate((x, none)), np.concatenate((s, none)), np.concatenate((np.zeros(len(q)), seen))]
        cols = [pa.array(c.astype(np.int64)) for c in cols]
        cols[1] = pa.array([*x.tolist(), *[None] * len(asked)], pa.int64())
        return pa.table(dict(zip(("query_id", "vec_id", "score", "evaluated"), cols, strict=True)))

    def searched(queries: DataFrame, label: str) -> DataFrame:
        asked = materialize(queries.mapInArrow(places, "vec_id long, v array<double>, t array<double>, floor long, task long, part long"), f"{label}-asked")
        chunks = asked.groupBy("task", "part").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("chunks"))
        right = asked.join(F.broadcast(chunks) if parts.sum() <= 4 * RINGS * 64 else chunks, ["task", "part"])
        right = right.withColumn("chunk", F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.col("chunks")))
        left = placed.join(chunks, ["task", "part"]).withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1L)")))
        keys = ["task", "part", "chunk"]
        found = left.drop("chunks").groupBy(*keys).cogroup(right.drop("chunks").groupBy(*keys)).applyInArrow(search, _FOUND)
        return materialize(found, label, done=(asked,))

    none = F.lit(None).cast("long")
    queries = table.where(F.col("vec_id") % every == 0).select("vec_id", "v", "t")
    first = searched(queries.select("*", none.alias("floor"), none.alias("done")), "pivot-first")
    floors = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("vec_id") >= k, F.min(F.when(F.col("vec_id").isNotNull(), F.col("score")))).alias("floor"))
    best = table.where(F.col("vec_id") % every == 0).select("vec_id", "v", "t").join(floors, "vec_id")
    where = best.mapInArrow(_home(blocks, task, known, width, pivots), "vec_id long, v array<double>, t array<double>, floor long, done long")
    found = first.unionByName(searched(where, "pivot-rest"))
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.where("vec_id is not null").withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    if counted:
        ranked = ranked.drop("evaluated").join(found.groupBy("query_id").agg(F.sum("evaluated").alias("evaluated")), "query_id")
        return ranked.select("query_id", "rank", "vec_id", "score", "evaluated")
    return ranked.select("query_id", "rank", "vec_id", "score")


def _home(blocks: Blocks, task: np.ndarray, known: np.ndarray, width: int, pivots: int):
    """Adds done, the task that a query (vec_id, v, t, floor) has searched first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, t = _matrix(b.column(1), width), _matrix(b.column(2), pivots)
            done = [int(task[known[blocks.bounds(float(query @ query), far, known).argmax()]]) for query, far in zip(v, t, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(done, pa.int64())], ["vec_id", "v", "t", "floor", "done"])

    return run


QUERY_SQL = """
WITH v AS (SELECT vec_id, [floor(CAST(x AS DOUBLE) * 64) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
