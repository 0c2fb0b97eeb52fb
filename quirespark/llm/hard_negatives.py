"""Hard negatives by a full sort of every anchor's integer scores.

Anchors are a stated query set and are searched against all rows in blocks. A
block of anchors goes to all tasks; each task reads its rows piece by piece,
scores a piece as a matrix product, sorts every anchor's scores of the piece by
(score, id), finds each positive's upper limit in that order by binary search and
reads on down to the lower limit. What a piece gives are sorted runs, of which the
first entries are merged, in the task and then by Spark, to those of the full sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.llm.common import new_folder, small_batches, written

#: Rows of a piece, and anchors scored against it at once: a score matrix of 8 MB.
PIECE, TILE = 4096, 256
#: Scores beyond this count as it, so that their hundredfold fits 64 bits.
MOST = 2**56
_BEST = "anchor long, id long, row long, score long"
_FOUND = "anchor long, nth int, negative_id long, row long, negative_score long"
_DDL = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def quantised(vectors: list, scale: int) -> np.ndarray:
    """floor(scale * x) of each component as a matrix of doubles; shorter vectors end in zeros."""
    wide = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), wide))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(scale * out)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products over the components that both have.

    Doubles hold them exactly up to 2**53; beyond that they are taken in 64 bits,
    and where these or the limits' hundredfold could overflow, as Python's integers, cut at ``MOST``.
    """
    d = min(anchors.shape[1], rows.shape[1])
    a, r = anchors[:, :d], rows[:, :d]
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(r).max(initial=0)) * max(d, 1)
    if bound < 2**53:
        return (a @ r.T).astype(np.int64)
    if bound < MOST / 2:
        return a.astype(np.int64) @ r.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(r).T, -MOST, MOST).astype(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, rows, labels, matrix) of ``PIECE`` rows at a time, ordered by id and row."""
    held: list[pa.RecordBatch] = []

    def ready(batch):
        ids, row, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "row", "label"))
        order = np.lexsort((row, ids))
        return ids[order], row[order], label[order], quantised(batch.column("vector").to_pylist(), scale)[order]

    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            held.append(batch.slice(at, PIECE))
            if sum(b.num_rows for b in held) >= PIECE:
                yield ready(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []
    if sum(b.num_rows for b in held):
        yield ready(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _first(keys: tuple[np.ndarray, ...], score: np.ndarray, ids: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` entries of each group by (score descending, id, row), in that order."""
    order = np.lexsort((row, ids, -score, *reversed(keys)))
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.any([key[order][1:] != key[order][:-1] for key in keys], axis=0)
    starts = np.flatnonzero(new)
    nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[nth < k]


def _merged(parts: list[tuple[np.ndarray, ...]], n_keys: int, k: int) -> list[tuple[np.ndarray, ...]]:
    if not parts:
        return []
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
    keep = _first(tuple(cols[:n_keys]), cols[-1], cols[n_keys], cols[n_keys + 1], k)
    return [tuple(c[keep] for c in cols)]


def _tiles(anchors: dict, label: int) -> Iterator[np.ndarray]:
    own = np.flatnonzero(anchors["label"] == label)
    for at in range(0, len(own), TILE):
        yield own[at : at + TILE]


def _best_same(shared, k: int, scale: int):
    """The first ``k`` other rows of the anchor's label in each task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0
        for ids, row, labels, matrix in _pieces(batches, scale):
            for label in np.unique(anchors["label"]):
                same = np.flatnonzero(labels == label)
                for tile in _tiles(anchors, label) if len(same) else ():
                    s = scores(anchors["matrix"][tile], matrix[same])
                    order = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]  # columns stand in id order; one more for the anchor itself
                    who, col = np.repeat(tile, order.shape[1]), same[order.ravel()]
                    other = anchors["row"][who] != row[col]
                    parts.append((anchors["row"][who[other]], ids[col[other]], row[col[other]], np.take_along_axis(s, order, 1).ravel()[other]))
                    held += int(other.sum())
            if held > 1_000_000:
                parts, held = _merged(parts, 1, k), 0
        for anchor, other_id, other_row, score in _merged(parts, 1, k):
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(other_id), pa.array(other_row), pa.array(score)], ["anchor", "id", "row", "score"])

    return run


def _negatives(shared, k: int, low: int, high: int, scale: int):
    """The first ``k`` rows of other labels between each positive's limits in each task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0
        for ids, row, labels, matrix in _pieces(batches, scale):
            for label in np.unique(anchors["label"]):
                other = np.flatnonzero(labels != label)
                for tile in _tiles(anchors, label) if len(other) else ():
                    s = scores(anchors["matrix"][tile], matrix[other])
                    order = np.argsort(-s, axis=1, kind="stable")  # the full sort by score and id: columns stand in id order
                    for i, a in enumerate(tile):
                        falling = s[i, order[i]]
                        rising = -falling
                        for nth, positive in enumerate(anchors["positives"][a]):
                            start = np.searchsorted(rising, -(high * positive // 100), "left")
                            end = min(start + k, np.searchsorted(rising, low * -positive // 100, "right"))
                            if start < end:
                                col = other[order[i, start:end]]
                                n = end - start
                                parts.append((np.full(n, anchors["row"][a]), np.full(n, nth, np.int32), ids[col], row[col], falling[start:end]))
                                held += n
            if held > 1_000_000:
                parts, held = _merged(parts, 2, k), 0
        for anchor, nth, other_id, other_row, score in _merged(parts, 2, k):
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(nth, pa.int32()), pa.array(other_id), pa.array(other_row), pa.array(score)],
                ["anchor", "nth", "negative_id", "row", "negative_score"],
            )

    return run


def hard_negatives(
    table: DataFrame,
    anchor: Column,
    label: Column | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    positives: int = 5,
    k: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    block: int = 16_384,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of components ``floor(scale * x)``, exact. Anchors
    are the rows for which ``anchor`` holds; the positives of one are its first
    ``positives`` other rows of its label by (score descending, id); the negatives
    of a positive are the first ``k`` rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``.

    ``block`` anchors are searched at a time: they, their positives and the runs
    a task holds are all that is gathered in one place, whatever the table's
    size; the rows themselves never move. Each block reads the table twice.

    Rows with a null label, id or vector, or a null or non-finite component, take no
    part. Rows that repeat an id are rows of their own, after the first by row
    number: each is an anchor, a positive and a negative. Vectors of different
    length are compared over the components that both have (an empty one scores
    0). Scores beyond 2**56 either way count as that.
    Empty tables and tables without an anchor give no rows. Other columns of the
    table play no part.
    """
    spark = table.sparkSession
    small_batches(spark)
    label = F.col("label") if label is None else label
    taken = table.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = written(taken.where("id is not null and label is not null and vector is not null").where(finite).withColumn("row", F.monotonically_increasing_id()), "vectors")
    data = rows.drop("anchor")
    blocks = -(-rows.where("anchor").count() // block)
    to = new_folder(spark, "negatives")
    spark.createDataFrame([], _DDL).write.parquet(to)
    for b in range(blocks):
        own = rows.where("anchor").where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "id", "label", "vector").collect()
        anchors = {
            "row": np.array([r.row for r in own], np.int64),
            "label": np.array([r.label for r in own], np.int64),
            "matrix": quantised([r.vector for r in own], scale),
        }
        sent = spark.sparkContext.broadcast(anchors)
        nearest = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id", "row")
        best = data.mapInArrow(_best_same(sent, positives, scale), _BEST).withColumn("nth", F.row_number().over(nearest) - 1).where(F.col("nth") < positives)
        found = best.orderBy("anchor", "nth").collect()
        sent.destroy()
        place = {r: i for i, r in enumerate(anchors["row"].tolist())}
        anchors["positives"] = [[] for _ in own]
        for r in found:
            anchors["positives"][place[r.anchor]].append(r.score)
        sent = spark.sparkContext.broadcast(anchors)
        order = Window.partitionBy("anchor", "nth").orderBy(F.col("negative_score").desc(), "negative_id", "row")
        pairs = data.mapInArrow(_negatives(sent, k, low, high, scale), _FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        named = spark.createDataFrame(
            [(r.anchor, own[place[r.anchor]].id, r.nth, r.id, r.score) for r in found], "anchor long, anchor_id long, nth int, positive_id long, positive_score long"
        )
        pairs.join(named, ["anchor", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(to)
        sent.destroy()
    return spark.read.schema(_DDL).parquet(to)
