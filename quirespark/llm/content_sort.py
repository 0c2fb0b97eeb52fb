"""Exact deduplication by content sort.

Spark samples splitters and range-partitions the rows by their bytes, an
external sort within each range places equal texts side by side, and full
comparisons of neighbours cut the order into runs. Ranges and the sort within
them have one order: the first bytes, then a digest in place of the other bytes, then the
row identifier. So only a range's first and last run can go on in a neighbouring range,
and a run of any size may span ranges: pieces that touch the edge
of a range are joined again by their text, of which each range has two at most. A
run of more than ``MOST`` rows is given in pieces that are joined in the same way,
so that no row and no task holds all of a large group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import small_batches, written

#: Identifiers of one piece, but for those of one more batch.
MOST = 4096
_RUNS = "text_sha256 string, ids array<long>, edge string"


def _runs(batches: Iterator[pa.RecordBatch], most: int = MOST) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours in one sorted range: identifiers in order; the text where the run touches an edge.

    The open run's text is compared in full with each next batch; memory is a batch and the identifiers of one piece.
    """
    text, sha, ids, first, cut = None, None, [], True, False

    def emit(rows):
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.string()),
                pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                pa.array([r[2] for r in rows], pa.string()),
            ],
            ["text_sha256", "ids", "edge"],
        )

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        texts, shas, keys = batch.column("content"), batch.column("text_sha256"), batch.column("id").to_pylist()
        new = np.ones(n, dtype=bool)
        if n > 1:
            new[1:] = ~pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = text is None or texts[0].as_py() != text
        starts = np.flatnonzero(new)
        rows = []
        head = starts[0] if len(starts) else n
        if head:
            ids += keys[:head]
            if len(ids) >= most:
                rows.append((sha, ids, text))
                ids, cut = [], True
        for k, s in enumerate(starts):
            if sha is not None:
                if ids:
                    rows.append((sha, ids, text if first or cut else None))
                first = cut = False
            e = starts[k + 1] if k + 1 < len(starts) else n
            text, sha, ids = (texts[int(s)].as_py() if k + 1 == len(starts) or first else None), shas[int(s)].as_py(), keys[s:e]
        if rows:
            yield emit(rows)
    if ids:
        yield emit([(sha, ids, text)])


def content_sort_dedup(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None, keep: str = "smallest") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row for each input row.

    ``text`` is the normalised content (default: the text column, null as empty).
    ``keep`` says whether the smallest or the largest identifier of equal texts
    stays. Rows that repeat an identifier and a text stay separate rows; all of
    them that carry the kept identifier have ``kept``. A null identifier sorts
    last and is kept only where no other row has the text. Other columns of
    ``docs`` are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text"), F.lit("")) if text is None else text
    order = F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last()
    # A splitter is a prefix and a digest, so that the sample stays small whatever the texts' lengths.
    by = F.substring("content", 1, 24), F.col("text_sha256"), order
    ranged = (
        docs.select(F.col(id_col).cast("long").alias("id"), text.alias("content"))
        .select("id", "content", F.sha2("content", 256).alias("text_sha256"))
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
    )
    runs = written(ranged.mapInArrow(_runs, _RUNS), "runs")
    first = F.col("ids")[0]
    best = (F.max if keep == "largest" else F.min)("k")
    edges = runs.where("edge is not null")
    whole = (
        edges.select("edge", first.alias("k"), F.size("ids").cast("long").alias("n"))
        .groupBy("edge")
        .agg(best.alias("keep_id"), F.sum("n").alias("group_size"))
    )
    inner = runs.where("edge is null").select("text_sha256", "ids", first.alias("keep_id"), F.size("ids").cast("long").alias("group_size"))
    outer = edges.join(whole, "edge").select("text_sha256", "ids", "keep_id", "group_size")
    return (
        inner.unionAll(outer)
        .select("text_sha256", "keep_id", "group_size", F.explode("ids").alias(id_col))
        .select(id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )
