"""Substring deduplication by level-wise doubling.

A window of words is removed where it also starts in a document with a smaller
identifier. Every window of ``base`` words is a candidate at first. At each level
all copies of a candidate's key meet in one bucket, which answers whether the window
is repeated; windows repeated at one length alone are extended to twice that
length (``window`` words at most), until that is reached or no candidate survives. A
longer window's key is made of the keys of its two halves.

Texts do not move: they are cut into blocks, written as a table that is bucketed by
block, and each level sends a block's distinct keys, packed, to the buckets and
the buckets' answers, one bit a key, back to the block. The levels below the last
only rule out, so 32 bits beside the bucket do for them; the last compares 128
bits and the identifiers.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm.common import new_folder, small_batches, written

#: UTF-8 bytes of the texts of a block, but for those of one text; keys that a bucket gets, about.
BLOCK, BUCKET = 8_000_000, 2_000_000
_SENT = "bucket long, block long, keys binary, more binary, ids binary, counts binary"
_ANSWER = "block long, bucket long, level int, bits binary, n int"
_OUT = "id long, n_words long, n_removed long, text string, removed array<struct<start:int,end:int>>"
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9)]


class _Words(dict):
    """Words numbered as they come, with the 128-bit digest of each."""

    def __init__(self):
        self.digests = bytearray()

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.digests += hashlib.blake2b(word, digest_size=16).digest()
        return n


def _mixed(a: np.ndarray, b: np.ndarray, m: np.uint64, k: np.uint64) -> np.ndarray:
    x = a * m + b * k
    x ^= x >> np.uint64(29)
    x *= _M[3]
    x ^= x >> np.uint64(32)
    return x


class _Block:
    """The texts of one block in order of their identifiers, and the candidates among their windows."""

    def __init__(self, table: pa.Table, base: int, window: int):
        row, ids, null = table.column("row").to_numpy(), table.column("id"), table.column("id").is_null().to_numpy()
        ids = ids.fill_null(0).to_numpy()
        order = np.lexsort((row, ids, null))
        self.ids, self.null = ids[order], null[order]
        texts = table.column("text")
        self.words: list[bytes] = []
        ends = [0]
        for i in order:
            self.words += (texts[int(i)].as_py() or "").encode("utf-8", "surrogatepass").split()
            ends.append(len(self.words))
        self.starts, self.ends = np.array(ends[:-1]), np.array(ends[1:])
        self.lengths = self.ends - self.starts
        self.doc = np.repeat(np.arange(len(order)), self.lengths)
        known = _Words()
        number = np.fromiter(map(known.__getitem__, self.words), np.int64, len(self.words))
        digests = np.frombuffer(bytes(known.digests), np.uint64).reshape(-1, 2)
        self.key = [digests[number, 0], digests[number, 1]] if len(number) else [np.empty(0, np.uint64)] * 2
        self.length, self.window = 1, window
        self.alive = np.arange(len(self.words))
        self._extend(base)

    def _extend(self, length: int) -> None:
        """Keys of longer windows out of those of their two halves, which may overlap."""
        while self.length < length:
            step = min(self.length, length - self.length)
            self.key = [_mixed(k[: max(0, len(k) - step)], k[step:], m, n) for k, m, n in zip(self.key, (_M[0], _M[2]), (_M[1], _M[0]), strict=True)]
            self.length += step
        left = self.ends[self.doc] if len(self.doc) else np.empty(0, np.int64)
        p = self.alive
        self.alive = p[(p + length <= left[p]) & ~self.null[self.doc[p]]]

    def ask(self, buckets: int) -> list[tuple]:
        """(bucket, keys, more, ids, counts) of the distinct keys among the candidates."""
        self._group(buckets)
        out = []
        cuts = np.searchsorted(self.bucket, np.arange(buckets + 1))
        last = self.length == self.window
        for b in np.flatnonzero(np.diff(cuts)):
            at = self.firsts[cuts[b] : cuts[b + 1]]
            low = self.key[1][at]
            if last:
                doc = self.doc[at]
                new = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                ids, counts = self.ids[doc[new]], np.diff(np.append(new, len(doc))).astype(np.int32)
                out.append((int(b), low.tobytes(), self.key[0][at].tobytes(), ids.tobytes(), counts.tobytes()))
            else:
                out.append((int(b), low.astype(np.uint32).tobytes(), b"", b"", b""))
        return out

    def _group(self, buckets: int) -> None:
        """Candidates with one key: the first stands for all; groups go by bucket, at the last level then by position."""
        p, last = self.alive, self.length == self.window
        high, low = self.key[0][p], self.key[1][p]
        bucket = ((high >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        if last:
            order = np.lexsort((low, high))
            new = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        else:
            joint = (bucket << np.uint64(32)) | (low & np.uint64(0xFFFFFFFF))
            order = np.argsort(joint, kind="stable")
            new = joint[order][1:] != joint[order][:-1]
        starts = np.flatnonzero(np.append(True, new)) if len(p) else np.empty(0, np.int64)
        ends = np.append(starts[1:], len(p)) if len(p) else starts
        firsts = p[order[starts]]
        group = np.repeat(np.arange(len(starts)), ends - starts)
        self.several = self.doc[firsts] != self.doc[p[order[ends - 1]]] if len(p) else np.empty(0, bool)
        by = np.lexsort((firsts, bucket[order[starts]])) if last else np.arange(len(starts))
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.firsts, self.bucket, self.several = firsts[by], bucket[order[starts]][by].astype(np.int64), self.several[by]
        self.of = np.empty(len(p), np.int64)
        self.of[order] = place[group]

    def hear(self, buckets: int, answers: dict[int, tuple[bytes, int]]) -> None:
        """Takes the buckets' answers: candidates without a repetition go; at the last level those stay that are to be removed."""
        self._group(buckets)
        told = np.zeros(len(self.firsts), bool)
        cuts = np.searchsorted(self.bucket, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            bits, n = answers[int(b)]
            told[cuts[b] : cuts[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
        if self.length == self.window:
            here = self.ids[self.doc[self.alive]] > self.ids[self.doc[self.firsts]][self.of] if len(self.alive) else np.empty(0, bool)
            self.alive = self.alive[here | told[self.of]]
            return
        self.alive = self.alive[(told | self.several)[self.of]]
        step = min(self.length, self.window - self.length)
        both = np.zeros(len(self.words) + step + 1, bool)
        both[self.alive] = True
        self.alive = self.alive[both[self.alive + step]]
        self._extend(self.length + step)


def lengths(base: int, window: int) -> list[int]:
    """The levels: each twice the one before, the last ``window``."""
    out = [min(base, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows numbered, and cut into blocks of about ``BLOCK`` bytes, within one task."""
    task = TaskContext.get().partitionId() << 40
    row = size = 0
    for batch in batches:
        long = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
        ends = size + np.cumsum(long, dtype=np.int64)
        size = int(ends[-1]) if len(ends) else size
        number = pa.array(task + row + np.arange(batch.num_rows))
        row += batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), number, pa.array(task + ends // BLOCK), pa.array(long.astype(np.int64))], ["id", "text", "row", "block", "bytes"])


def _heard(block: _Block, buckets: int, answers: pa.Table, levels: int) -> None:
    by: list[dict] = [{} for _ in range(levels)]
    for level, bucket, bits, n in zip(*(answers.column(c).to_pylist() for c in ("level", "bucket", "bits", "n")), strict=True):
        by[level][bucket] = bits, n
    for found in by:
        block.hear(buckets, found)


def _asks(base: int, window: int, buckets: int, levels: int):
    """The questions of one block after ``levels`` answered levels."""

    def asked(texts: pa.Table, answers: pa.Table | None) -> pa.Table:
        rows: list[tuple] = []
        if texts.num_rows:
            block = _Block(texts, base, window)
            if answers is not None:
                _heard(block, buckets, answers, levels)
            at = texts.column("block")[0].as_py()
            rows = [(b, at, *rest) for b, *rest in block.ask(buckets)]
        cols = list(zip(*rows, strict=True)) or [()] * 6
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 2 + [pa.binary()] * 4, strict=True)], ["bucket", "block", "keys", "more", "ids", "counts"])

    def first(texts: pa.Table) -> pa.Table:
        return asked(texts, None)

    def later(texts: pa.Table, answers: pa.Table) -> pa.Table:
        return asked(texts, answers)

    return later if levels else first


def _answers(level: int, last: bool):
    """One bit for each key of each block: is it in another block too, at the last level with a smaller identifier?"""

    def run(asked: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint64 if last else np.uint32) for k in asked.column("keys").to_pylist()]
        n = [len(k) for k in keys]
        low = np.concatenate(keys)
        if last:
            high = np.concatenate([np.frombuffer(k, np.uint64) for k in asked.column("more").to_pylist()])
            ids = np.concatenate([np.repeat(np.frombuffer(i, np.int64), np.frombuffer(c, np.int32)) for i, c in zip(asked.column("ids").to_pylist(), asked.column("counts").to_pylist(), strict=True)])
            order = np.lexsort((low, high))
            new = np.append(True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]))
            starts = np.flatnonzero(new)
            least = np.minimum.reduceat(ids[order], starts)
            yes = np.empty(len(low), bool)
            yes[order] = ids[order] > np.repeat(least, np.diff(np.append(starts, len(low))))
        else:
            order = np.argsort(low, kind="stable")
            same = low[order][1:] == low[order][:-1]
            yes = np.empty(len(low), bool)
            yes[order] = np.append(False, same) | np.append(same, False)
        bits = [np.packbits(x).tobytes() for x in np.split(yes, np.cumsum(n)[:-1])]
        m = asked.num_rows
        return pa.Table.from_arrays(
            [asked.column("block"), asked.column("bucket"), pa.array([level] * m, pa.int32()), pa.array(bits, pa.binary()), pa.array(n, pa.int32())], ["block", "bucket", "level", "bits", "n"]
        )

    return run


def _finished(base: int, window: int, buckets: int, levels: int):
    """The texts of one block without the words that removed windows cover."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if texts.num_rows:
            block = _Block(texts, base, window)
            gone = np.zeros(len(block.words) + 1, np.int64)
            if levels:
                _heard(block, buckets, answers, levels)
                np.add.at(gone, block.alive, 1)
                np.add.at(gone, block.alive + window, -1)
            gone = np.cumsum(gone)[:-1] > 0
            for i, (s, e) in enumerate(zip(block.starts.tolist(), block.ends.tolist(), strict=True)):
                cut = gone[s:e]
                edges = np.flatnonzero(np.diff(np.concatenate(([False], cut, [False])).astype(np.int8)))
                spans = [{"start": a, "end": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
                words = block.words[s:e]
                if spans:
                    words = [words[j] for j in np.flatnonzero(~cut).tolist()]
                rows.append((None if block.null[i] else int(block.ids[i]), e - s, int(cut.sum()), b" ".join(words).decode("utf-8", "replace"), spans))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        types = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["id", "n_words", "n_removed", "text", "removed"])

    return run


def _bucketed(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """``texts`` written in files by block, without a shuffle; grouping it by block needs none either."""
    name = f"quire_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts.write.bucketBy(n, "block").sortBy("block").option("path", new_folder(spark, "texts")).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay until the application ends; the name is no longer needed
    return table


def dedup_substrings(docs: DataFrame, window: int = 13, base: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, text, removed), one row for each input row.

    Words are what stands between ASCII white space. A word goes if it is covered
    by a window of ``window`` consecutive words whose sequence also starts in a
    document with a smaller identifier; windows are judged on the input. ``text``
    holds the words that stay, joined by one space; ``removed`` the spans
    that went, in word numbers. The levels are ``base`` words and then twice as
    many each time, ``window`` at last.

    Null and empty texts have no words and an empty text. Rows without an
    identifier keep all words and take none from others. Rows that repeat an
    identifier take nothing from one another. An empty table gives no
    rows. Other columns play no part. A task holds one block of about ``BLOCK`` bytes, or
    one text if that is longer (some 150 bytes a word), or the keys of one bucket, of
    which each block sends any key once: a passage in a third of all documents comes
    as often as there are blocks.
    """
    spark, base = docs.sparkSession, min(base, window)
    small_batches(spark)
    texts = _bucketed(spark, docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_blocks, "id long, text string, row long, block long, bytes long"))
    words = (texts.agg(F.sum("bytes")).first()[0] or 0) // 6
    buckets = max(64, -(-words // BUCKET))
    answers = None
    done = 0
    for level, length in enumerate(steps := lengths(base, window)):
        ask = _asks(base, window, buckets, level)
        asked = texts.groupBy("block").applyInArrow(ask, _SENT) if answers is None else texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask, _SENT)
        told = written(asked.groupBy("bucket").applyInArrow(_answers(level, length == steps[-1]), _ANSWER), f"level{level}")
        answers = told if answers is None else answers.unionAll(told)
        done = level + 1
        if told.isEmpty():  # no candidate survives
            break
    found = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_finished(base, window, buckets, done), _OUT)
    return found.withColumnRenamed("id", id_col)
