"""Operator 12: hard negatives from anchor-clustered shared lists (as in MAXIMUS).

Anchors are clustered by direction around a few centres.  For a cluster with centre c whose members
lie within the angle t of it, and a candidate x at the angle p from c, no member a has an inner
product above |a| |x| cos(max(0, p - t)).  So the candidates are sorted once per cluster by
|x| cos(max(0, p - t)), and every member walks that one list from its top until the bound of what is
left can't beat (or tie) what it still needs; from then on its result is certified.

Two passes over the same slices of candidates:

1. positives: the k best others of the anchor's own label;
2. negatives: for each positive (score s) the n best rows of other labels whose score is at least
   low / 100 of s and at most high / 100 of s; a walk ends below the least score that is still needed.

Candidates are cut into slices of bounded bytes, dealt over ranges; anchors, cut into blocks
of bounded bytes, go to every range, where a task meets the blocks with the range's slices one
pair at a time and carries each block's best on from slice to slice.  Nothing is collected but a
bounded sample of anchors (SAMPLE) for the centres, which only steer the order of the walk.

Rows without id, label or vector, or with a component that is null or not finite, take no part;
of rows with one id the one with the smallest label, then vector, does.  Vectors of different
lengths don't meet.  Ties go to the smaller id; fewer rows than asked give all of them.
An empty table, or anchors alone in their label, give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import arrow_schema, columns_as, over, release, ship, small_batches, written
from marquee.llm.vectors import HIGH, LOW, best_of, matrix, packed, products, usable

SAMPLE = 2048  # anchors that the centres are drawn from
CENTRES = 32
SLICE = 1 << 21  # bytes of vectors in a slice or block
STEP = 256  # candidates that a walk scores at a time
HELD = 1 << 18  # anchors whose best a task carries at once


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((x * x).sum(1))
    return x / np.where(norm > 0, norm, 1)[:, None], norm


def angles(directions: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(directions @ centre, -1, 1))


def cluster_centres(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from the first rows of the sample."""
    x, norm = units(sample)
    x = np.unique(x[norm > 0], axis=0)
    if not len(x):
        return np.zeros((1, sample.shape[1]))
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        of = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        direction, size = units(sums)
        centres = np.where(size[:, None] > 0, direction, centres)
    return centres


def _near(centres: np.ndarray):
    """(id, label, row) -> the same with the nearest centre and the angle to it."""
    def task(batch):
        x, _ = units(matrix(batch.column(2), centres.shape[1]))
        cos = x @ centres.T
        near = cos.argmax(1)
        yield [*batch.columns, near.astype(np.int32), np.arccos(np.clip(cos[np.arange(len(x)), near], -1, 1))]

    return task


def _cut(schema: pa.Schema, width: int):
    """Sorted rows (id, label, row, centre, ...) -> slices of at most SLICE bytes: lists, joined vectors."""
    most = max(1, SLICE // (8 * width))

    def run(batches):
        from pyspark import TaskContext

        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal made, held, size
            table = pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
            for a in range(0, len(table), most):
                cut = table.slice(a, most)
                made += 1
                lists = [pa.array([cut.column(k).to_pylist()], f.type) for k, f in zip((0, 1, 3, *range(4, cut.num_columns)), list(schema)[3:])]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([part << 32 | made], pa.int64()), pa.array([b"".join(cut.column(2).to_pylist())], pa.binary()), *lists], schema=schema)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= most:
                yield from flush()
        if size:
            yield from flush()

    return run


def walk(members: np.ndarray, norms: np.ndarray, x: np.ndarray, bound: np.ndarray, order: np.ndarray, need, take) -> None:
    """Every member walks the list ``order`` (bounds descending) until its bound is below ``need(members)``;
    ``take(members, candidates, scores)`` gets what is scored."""
    active = np.arange(len(members))
    scale = np.sqrt((x * x).sum(1)).max(initial=0.0)
    for a in range(0, len(order), STEP):
        reach = norms[active] * bound[order[a]] + 1e-6 * norms[active] * scale + 1
        active = active[reach >= need(active)]
        if not len(active):
            return
        part = order[a:a + STEP]
        take(active, part, products(members[active], x[part]))


class Best:
    """Of each anchor in a block the k best positives, or of each (anchor, positive) the k best negatives."""

    def __init__(self, block: dict, k: int, low: int | None, high: int):
        self.ids, self.labels, self.x, self.centre = block["ids"], block["labels"], block["x"], block["centre"]
        self.direction, self.norms = units(self.x)
        self.of = np.repeat(np.arange(len(self.ids)), [len(p) for p in block["scores"]]) if low is not None else None
        n = len(self.ids)
        if self.of is not None:
            self.positives = np.array([p for own in block["positives"] for p in own], np.int64)
            self.scores = np.array([s for own in block["scores"] for s in own], np.int64)
            self.least = np.array([-(-low * s // 100) for own in block["scores"] for s in own], object)
            self.most = np.array([high * s // 100 for own in block["scores"] for s in own], object)
            self.open = self.least <= self.most
            self.least, self.most = (np.clip(v, LOW, HIGH).astype(np.int64) for v in (self.least, self.most))
            n = len(self.of)
        self.best = np.full((n, k), LOW)
        self.who = np.full((n, k), HIGH)

    def meet(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, centres: np.ndarray) -> None:
        direction, size = units(x)
        for c in np.unique(self.centre).tolist():
            mine = np.flatnonzero(self.centre == c)
            spread = float(np.where(self.norms[mine] > 0, angles(self.direction[mine], centres[c]), 0).max())
            bound = size * np.cos(np.maximum(0, angles(direction, centres[c]) - spread))
            order = np.argsort(-bound, kind="stable")  # the cluster's list
            if self.of is None:
                for label in np.unique(self.labels[mine]).tolist():
                    self._positives(mine[self.labels[mine] == label], ids, x, bound, order[labels[order] == label])
            else:
                self._negatives(mine, ids, labels, x, bound, order)

    def _merge(self, rows, scores, ids):
        top = best_of(np.hstack([self.best[rows], scores]), np.hstack([self.who[rows], ids]), self.best.shape[1])
        self.best[rows], self.who[rows] = top

    def _positives(self, mine, ids, x, bound, order):
        def take(active, part, scores):
            rows = mine[active]
            same = ids[part][None] == self.ids[rows][:, None]
            self._merge(rows, np.where(same, LOW, scores), np.where(same, HIGH, np.broadcast_to(ids[part], scores.shape)))

        def need(active):
            rows = mine[active]
            return np.where(self.who[rows, -1] < HIGH, self.best[rows, -1].astype(np.float64), -np.inf)

        walk(self.x[mine], self.norms[mine], x, bound, order, need, take)

    def _negatives(self, mine, ids, labels, x, bound, order):
        place = np.full(len(self.ids), -1)
        place[mine] = np.arange(len(mine))
        pairs = np.flatnonzero((place[self.of] >= 0) & self.open)

        def need(active):
            wants = np.maximum(self.least[pairs], np.where(self.who[pairs, -1] < HIGH, self.best[pairs, -1], LOW)).astype(np.float64)
            least = np.full(len(mine), np.inf)
            np.minimum.at(least, place[self.of[pairs]], wants)
            return least[active]

        def take(active, part, scores):
            at = np.full(len(mine), -1)
            at[active] = np.arange(len(active))
            rows = pairs[at[place[self.of[pairs]]] >= 0]
            own = scores[at[place[self.of[rows]]]]
            fits = (labels[part][None] != self.labels[self.of[rows]][:, None]) & (own >= self.least[rows][:, None]) & (own <= self.most[rows][:, None])
            some = fits.any(1)
            rows, own, fits = rows[some], own[some], fits[some]
            if len(rows):
                self._merge(rows, np.where(fits, own, LOW), np.where(fits, np.broadcast_to(ids[part], own.shape), HIGH))

        walk(self.x[mine], self.norms[mine], x, bound, order, need, take)

    def found(self):
        row, col = np.nonzero(self.who < HIGH)
        if self.of is None:
            zero = np.zeros(len(row), np.int64)
            return [self.ids[row], zero, zero, self.who[row, col], self.best[row, col]]
        return [self.ids[self.of[row]], self.positives[row], self.scores[row], self.who[row, col], self.best[row, col]]


FOUND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def _search(schema: pa.Schema, centres: np.ndarray, k: int, low: int | None, high: int):
    """Pairs of a slice and a block -> what the block's anchors found in the slices of this task."""
    width = centres.shape[1]

    def run(batches):
        held: dict[int, Best] = {}

        def flush():
            while held:
                cols = held.popitem()[1].found()
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        try:
            for batch in batches:
                for r in range(batch.num_rows):
                    ids, labels, rows, block, a_ids, a_labels, a_rows, a_centre, positives, scores = (c[r] for c in batch.columns)
                    name = block.as_py()
                    if name not in held:
                        if sum(len(b.ids) for b in held.values()) > HELD:
                            yield from flush()
                        a = {"ids": a_ids.values.to_numpy(), "labels": a_labels.values.to_numpy(), "centre": a_centre.values.to_numpy(),
                             "x": np.frombuffer(a_rows.as_buffer(), "<f8").reshape(-1, width), "positives": positives.as_py(), "scores": scores.as_py()}
                        held[name] = Best(a, k, low, high)
                    held[name].meet(ids.values.to_numpy(), labels.values.to_numpy(), np.frombuffer(rows.as_buffer(), "<f8").reshape(-1, width), centres)
            yield from flush()
        finally:
            release()

    return run


def _found(index: DataFrame, ranges: int, anchors: DataFrame, centres: np.ndarray, k: int, low: int | None = None, high: int = 0) -> DataFrame:
    """anchors: (id, label, row, centre, positives, scores) -> what they find in the index; k rows an anchor (or pair) and task at most."""
    spark = index.sparkSession
    cut = "part int, block long, a_rows binary, a_ids array<long>, a_labels array<long>, a_centre array<int>, positives array<array<long>>, scores array<array<long>>"
    dealt = anchors.repartitionByRange("centre", "id").sortWithinPartitions("centre", "id")
    blocks = written(dealt.mapInArrow(_cut(arrow_schema(spark, cut), centres.shape[1]), cut), "negatives-blocks")
    everywhere = blocks.drop("part").withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))))  # a number of ranges, not of rows
    pairs = index.withColumnRenamed("part", "range").join(everywhere, "range")
    pairs = pairs.select("ids", "labels", "rows", "block", "a_ids", "a_labels", "a_rows", "a_centre", "positives", "scores")
    return pairs.mapInArrow(_search(arrow_schema(spark, FOUND), centres, k, low, high), FOUND)


def _ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
                   id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``is_anchor``: SQL on vec_id.

    low and high (percent, not negative) bound a negative's score by the positive's."""
    spark = vectors.sparkSession
    ship(spark)
    small_batches(spark)
    rows = columns_as(vectors, vec_id=id_col, label=label_col, v=vector_col).where("label is not null").select("vec_id", F.col("label").cast("long").alias("label"), "v")
    rows = written(packed(usable(rows, scale, "vec_id", ("label",)), "vec_id long, label long"), "negatives-rows")
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for (width,) in sorted(map(tuple, rows.select("width").distinct().collect())):  # one row per vector length
        if width == 0:
            continue
        mine = rows.where(F.col("width") == width).select("vec_id", "label", "row")
        chosen = mine.where(is_anchor)
        sample = chosen.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("row").collect()
        if not sample:
            continue
        centres = cluster_centres(np.stack([np.frombuffer(r.row, "<f8") for r in sample]), CENTRES)
        near = over(mine, _near(centres), "id long, label long, row binary, centre int, angle double")
        cut = "part int, slice long, rows binary, ids array<long>, labels array<long>, centres array<int>, angles array<double>"
        dealt = near.repartitionByRange("label", "centre", "angle", "id").sortWithinPartitions("label", "centre", "angle", "id")
        index = written(dealt.mapInArrow(_cut(arrow_schema(spark, cut), width), cut).select("part", "rows", "ids", "labels"), "negatives-index")
        ranges = index.agg(F.max("part")).first()[0] + 1
        anchors = written(over(chosen, _near(centres), "id long, label long, row binary, centre int, angle double").drop("angle"), "negatives-anchors")
        nothing = F.lit(None).cast("array<long>")
        first = _ranked(_found(index, ranges, anchors.withColumns({"positives": nothing, "scores": nothing}), centres, positives), positives, "anchor_id")
        lists = first.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))  # ``positives`` of them
        told = written(anchors.join(lists, F.col("id") == F.col("anchor_id")).select("id", "label", "row", "centre", F.col("p.vec_id").alias("positives"), F.col("p.score").alias("scores")), "negatives-positives")
        second = _ranked(_found(index, ranges, told, centres, negatives, low, high), negatives, "anchor_id", "positive_id")
        out = out.unionByName(second.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    return out
