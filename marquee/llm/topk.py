"""Operator 2: exact top-k inner products by a pivot-distance index.

Vectors become whole numbers floor(scale x).  With one more component, sqrt(M - |x|^2) for
rows (M: the largest squared norm) and 0 for queries, the largest inner product is the
smallest distance: |q - x|^2 = |q|^2 + M - 2 q x.  Every row is keyed by its nearest pivot
and its distance to it; rows sorted by that key are cut into blocks, each an annulus of
one pivot with its smallest and largest distance.  By the triangle inequality no row of
an annulus is nearer to a query than the gap between the query's pivot distance and
the annulus; a query visits a run's annuli in the order of that bound and stops once
the bound can't beat (or tie) its k-th best.  Bounds are computed in floating point and
widened by a margin; scores are exact whole numbers.

Pivots are a bounded sample (PIVOTS rows by hash); every row is indexed.  The range
partitioning of the index has vec_id as its last key, so a vector that a third of all
rows share spreads over tasks and annuli.  Queries are a table too: cut into blocks of
bounded bytes, they go to every range of the index, where a task meets them with the
range's runs of annuli (of bounded bytes) one pair at a time and carries each block's best from run
to run, so that later runs are pruned by earlier ones; a task returns k rows a query at most.

Null vectors, vectors with null or non-finite components, and rows without a vec_id take no part; of
rows with one vec_id the one with the smallest vector does, in whatever order they come.  Only
vectors of equal length meet; those of length 0 have no products.  Scores beyond a long count as the
largest (or smallest) long.  Ties go to the smaller vec_id.  Fewer rows than k give all of
them; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import arrow_schema, columns_as, materialize, over, release, ship, small_batches
from marquee.llm.vectors import HIGH, LOW, best_of, matrix, packed, products, usable

PIVOTS = 64
ROWS = 1024  # rows of an annulus at most
BYTES = 1 << 21  # of vectors in a run of annuli, or in a block of queries
HELD = 1 << 18  # queries whose best a task carries at once


def lift(x: np.ndarray, most: float) -> np.ndarray:
    """The rows with the component that makes all norms equal."""
    return np.hstack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(1)))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)))


def _key(pivots: np.ndarray, most: float):
    """(vec_id, row) -> the same with the nearest pivot and the distance to it."""
    def task(batch):
        x = matrix(batch.column(1), pivots.shape[1] - 1)
        d = distances(lift(x, most), pivots)
        near = d.argmin(1)
        yield [*batch.columns, near.astype(np.int32), d[np.arange(len(x)), near]]

    return task


RUN = "part int, rows binary, ids array<long>, pivots array<int>, nears array<double>, fars array<double>, sizes array<int>"


def _cut(schema: pa.Schema, width: int):
    """Sorted rows (vec_id, row, pivot, dist) -> runs of at most BYTES: annuli of at most ROWS rows of one pivot, end to end."""
    most = max(1, BYTES // (8 * width))

    def run(batches):
        from pyspark import TaskContext

        part, held, size = TaskContext.get().partitionId(), [], 0

        def flush():
            nonlocal held, size
            table = pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
            for a in range(0, len(table), most):
                t = table.slice(a, most)
                pivot, dist = t.column(2).to_numpy(), t.column(3).to_numpy()
                cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(pivot)) + 1, np.arange(0, len(pivot), ROWS), [len(pivot)]]))
                s, e = cuts[:-1], cuts[1:]
                cols = [[part], [b"".join(t.column(1).to_pylist())], [t.column(0).to_pylist()], [pivot[s].tolist()], [dist[s].tolist()], [dist[e - 1].tolist()], [(e - s).tolist()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= most:
                yield from flush()
        if size:
            yield from flush()

    return run


def search(q_ids: np.ndarray, q: np.ndarray, to_pivots: np.ndarray, most: float, blocks: list[tuple], k: int, best=None, who=None):
    """The best k (score, id) per query among the annuli (pivot, near, far, ids, rows), and those found before."""
    n = len(q)
    best = np.full((n, k), LOW) if best is None else best
    who = np.full((n, k), HIGH) if who is None else who
    norm = (q.astype(np.float64) ** 2).sum(1)
    own = np.stack([to_pivots[:, b[0]] for b in blocks], 1)
    near, far = np.array([b[1] for b in blocks]), np.array([b[2] for b in blocks])
    margin = 1e-6 * (1 + np.sqrt(most) + np.sqrt(norm))[:, None]
    gap = np.maximum(0.0, np.maximum(own - far, near - own) - margin)
    bound = (norm[:, None] + most - gap ** 2) / 2 + 1 + 1e-9 * (norm[:, None] + most)  # no inner product of the annulus is larger
    order = np.argsort(-bound, axis=1, kind="stable")
    active = np.arange(n)
    for turn in range(len(blocks)):
        block = order[active, turn]
        active = active[bound[active, block] >= best[active, -1]]
        if not len(active):
            break
        block = order[active, turn]
        for b in np.unique(block).tolist():
            rows = active[block == b]
            _, _, _, ids, x = blocks[b]
            score = products(q[rows].astype(np.float64), x.astype(np.float64))
            same = ids[None] == q_ids[rows][:, None]
            best[rows], who[rows] = best_of(np.hstack([best[rows], np.where(same, LOW, score)]),
                                            np.hstack([who[rows], np.where(same, HIGH, np.broadcast_to(ids, score.shape))]), k)
    return best, who


FOUND = "query_id long, vec_id long, score long"


def _search(schema: pa.Schema, pivots: np.ndarray, most: float, k: int):
    """Pairs of a run and a block of queries -> the best of the block's queries among this task's runs."""
    width = pivots.shape[1] - 1

    def run(batches):
        held: dict[int, tuple] = {}

        def flush():
            while held:
                q_ids, _, _, best, who = held.popitem()[1]
                at = np.nonzero(who < HIGH)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((q_ids[at[0]], who[at], best[at]), schema)], schema=schema)

        try:
            for batch in batches:
                for r in range(batch.num_rows):
                    rows, ids, pivot, near, far, sizes, name, q_ids, q_rows = (c[r] for c in batch.columns)
                    x, ids = np.frombuffer(rows.as_buffer(), "<f8").reshape(-1, width), ids.values.to_numpy()
                    ends = np.cumsum(sizes.as_py())
                    blocks = [(p, n, f, ids[e - s:e], x[e - s:e]) for p, n, f, s, e in zip(pivot.as_py(), near.as_py(), far.as_py(), sizes.as_py(), ends.tolist())]
                    if name.as_py() not in held:
                        if sum(len(h[0]) for h in held.values()) > HELD:
                            yield from flush()
                        q = np.frombuffer(q_rows.as_buffer(), "<f8").reshape(-1, width)
                        held[name.as_py()] = (q_ids.values.to_numpy(), q, distances(np.hstack([q, np.zeros((len(q), 1))]), pivots), None, None)
                    q_id, q, to_pivots, best, who = held[name.as_py()]
                    held[name.as_py()] = (q_id, q, to_pivots, *search(q_id, q, to_pivots, most, blocks, k, best, who))
            yield from flush()
        finally:
            release()

    return run


def _blocks(schema: pa.Schema, width: int):
    """(vec_id, row) -> blocks of queries of at most BYTES."""
    most = max(1, BYTES // (8 * width))

    def run(batches):
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                name += 1
                part = batch.slice(a, most)
                cols = [[name], [part.column(0).to_pylist()], [b"".join(part.column(1).to_pylist())]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def top_products(vectors: DataFrame, is_query: str, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row with ``is_query`` (SQL on vec_id) its k best others among all rows."""
    spark = vectors.sparkSession
    ship(spark)
    small_batches(spark)
    rows = usable(columns_as(vectors, vec_id=id_col, v=vector_col), scale)
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows = materialize(packed(rows.select("vec_id", norm.alias("norm"), "v"), "vec_id long, norm double"), "topk-rows")
    found = spark.createDataFrame([], FOUND)
    norms = rows.groupBy("width").agg(F.max("norm").alias("m"))
    for width, most in sorted(map(tuple, norms.collect())):  # one row per vector length
        if width == 0:
            continue
        mine = rows.where(F.col("width") == width).select("vec_id", "row")
        sample = mine.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("row").collect()
        pivots = np.unique(lift(np.stack([np.frombuffer(r.row, "<f8") for r in sample]), most), axis=0)
        keyed = over(mine, _key(pivots, most), "vec_id long, row binary, pivot int, dist double")
        dealt = keyed.repartitionByRange("pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")
        index = materialize(dealt.mapInArrow(_cut(arrow_schema(spark, RUN), width), RUN), "topk-index")
        ranges = index.agg(F.max("part")).first()[0] + 1
        block = "block long, q_ids array<long>, q_rows binary"
        queries = materialize(mine.where(is_query).coalesce(ranges).mapInArrow(_blocks(arrow_schema(spark, block), width), block), "topk-queries")
        everywhere = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))))  # a number of ranges, not of rows
        pairs = index.join(everywhere, "part").select("rows", "ids", "pivots", "nears", "fars", "sizes", "block", "q_ids", "q_rows")
        found = found.unionByName(pairs.mapInArrow(_search(arrow_schema(spark, FOUND), pivots, most, k), FOUND))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
