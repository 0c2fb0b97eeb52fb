"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of consecutive benchmark words. Patterns of one length m
share a shift table over blocks of two words: the last block of the current
position says how many positions can be skipped at least. Where it says none,
the block's suffix bucket selects patterns, the first word filters them, and a
direct word-by-word comparison confirms an occurrence.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import small_batches, written

#: UTF-8 bytes: A-Z to lower case; digits, a-z and all bytes of non-ASCII characters stay; the rest ends a word.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_HITS = "id long, text_hash long, n_words long, spans array<struct<s:int,e:int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class WuManber:
    """Search tables for patterns of ``m`` words each; ``patterns`` maps a word tuple to its items."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.m, self.block = m, min(2, m)
        self.far = m - self.block + 1
        self.items = patterns
        self.shift: dict = {}
        self.bucket: dict = defaultdict(lambda: defaultdict(list))
        for p in patterns:
            for end in range(self.block, m + 1):
                key = p[end - self.block : end] if self.block > 1 else p[end - 1]
                self.shift[key] = min(self.shift.get(key, self.far), m - end)
            key = p[m - self.block :] if self.block > 1 else p[m - 1]
            self.bucket[key][p[0]].append(p)
        self.bucket = {k: dict(v) for k, v in self.bucket.items()}

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(start, pattern) of each occurrence."""
        m, far, shift, n = self.m, self.far, self.shift.get, len(words)
        at = m - 1
        two = self.block > 1
        while at < n:
            key = (words[at - 1], words[at]) if two else words[at]
            step = shift(key, far)
            if step:
                at += step
                continue
            start = at - m + 1
            for p in self.bucket[key].get(words[start], ()):
                if tuple(words[start : at + 1]) == p:
                    yield start, p
            at += 1


def windows(items: list[tuple[str, str | None]], size: int) -> list[WuManber]:
    """One search table for each pattern length: ``size`` words, or all of an item with fewer."""
    by_length: dict = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        w = words_of(text)
        if w:
            m = min(size, len(w))
            for p in {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}:
                by_length[m][p].append(item)
    return [WuManber(m, dict(ps)) for m, ps in sorted(by_length.items())]


def hits(text: str | None, tables: list[WuManber]) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Words of the text, merged half-open spans of hit words, and items that occur."""
    words, spans, items = words_of(text), [], set()
    for table in tables:
        for start, p in table.search(words):
            items.update(table.items[p])
            spans.append((start, start + table.m))
    merged: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return len(words), merged, items


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block_chars: int = 2_000_000,
) -> DataFrame:
    """(id, text_hash, n_words, n_hit, spans, items): what of each text lies in occurrences of benchmark windows.

    ``text_hash`` is the text's xxhash64, which tells rows with one id apart.
    Whole texts are searched. The benchmark is measured first; up to about
    ``block_chars`` characters of it, or one item if that is longer, make one set of tables that is sent to all
    tasks (tables of 2,000,000 characters take about 300 MB in a Python worker),
    and a larger one is searched in several such blocks, whose spans are then
    united for each document. Null texts have no words; null item texts no
    windows. Items with equal windows all count. Repeated ids stay separate rows
    when the benchmark fits one block, and are told apart by row number within
    their file partition otherwise. Only the named columns are read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    total = benchmark.agg(F.sum(F.length(item_text))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    found = None
    # a row number that stays the same in each pass over the documents
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    if blocks > 1:
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    for b in range(blocks):
        part = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text"))
        if blocks > 1:
            part = part.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        tables = spark.sparkContext.broadcast([(r.item, r.text) for r in part.collect()])

        def run(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            ready = windows(tables.value, size)
            for batch in batches:
                out = [hits(t, ready) for t in batch.column("text").to_pylist()]
                cols = [
                    batch.column("id"),
                    batch.column("text_hash"),
                    pa.array([o[0] for o in out], pa.int64()),
                    pa.array([[{"s": s, "e": e} for s, e in o[1]] for o in out], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
                    pa.array([sorted(o[2]) for o in out], pa.list_(pa.string())),
                ]
                names = ["id", "text_hash", "n_words", "spans", "items"]
                if "row" in batch.schema.names:
                    cols.append(batch.column("row"))
                    names.append("row")
                yield pa.RecordBatch.from_arrays(cols, names)

        one = rows.mapInArrow(run, _HITS + (", row long" if blocks > 1 else ""))
        found = one if found is None else found.unionAll(one)
    if blocks > 1:  # as many rows of a document meet as there are blocks
        found = (
            found.groupBy("row", "id", "text_hash")
            .agg(
                F.max("n_words").alias("n_words"),
                F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            )
            .withColumn("spans", F.expr(_MERGE))
            .drop("row")
        )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + (x["e"] - x["s"]))
    return found.select(F.col("id").alias(id_col), "text_hash", "n_words", n_hit.alias("n_hit"), "spans", "items")


#: Sorted spans united: each is cut to begin where the spans before it end.
_MERGE = """filter(aggregate(spans, struct(cast(array() AS array<struct<s:int,e:int>>) AS done, 0 AS upto),
  (acc, x) -> struct(concat(acc.done, array(struct(greatest(x.s, acc.upto) AS s, greatest(x.e, acc.upto) AS e))) AS done,
                     greatest(acc.upto, x.e) AS upto)).done, x -> x.e > x.s)"""
