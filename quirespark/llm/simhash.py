"""SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is cut into six blocks. Two fingerprints that differ in at
most three bits agree on three whole blocks, so each distinct fingerprint is
keyed by every choice of three blocks (20 keys) and near ones meet under a key.
Within a key the Hamming distance is verified and a spanning forest of the
links is kept instead of all pairs. A key with more than 4096 fingerprints is
keyed again by five of eight sub-blocks of its other 32 bits, after which 12
bits are left free and 4096 is a proven bound.

Texts whose shingle sets are similar by 0.8 differ in ten of 64 bits, which is too
many for blocks of bits. ``near_duplicates`` takes what these find and, for the rest,
cuts the fingerprint before its majority is taken: shingles are dealt by their hash into as many blocks as
such texts may have differing shingles, a block is the sum of its hashes, and the
pigeonhole holds for shingles. Candidates that share a block are verified by
Hamming distance, and all by the similarity of their shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import small_batches, written
from quirespark.llm.graph import connected_components

#: Bits of each block, and members of a key up to which it is searched at once.
BLOCKS = (11, 11, 11, 11, 10, 10)
BOUND = 4096


def shingle_hashes(text: str | None, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of all words where they are fewer than a shingle has."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        grams, n = [b" ".join(words)], 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 where there are none."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # a very long text takes no more memory than this
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The majority of the shingles' hashes."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of each whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def _masks(widths: tuple[int, ...], choose: int, bits: list[int]) -> list[int]:
    """Signed 64-bit masks of every choice of blocks, each block some of ``bits``."""
    blocks, at = [], 0
    for w in widths:
        blocks.append(sum(1 << b for b in bits[at : at + w]))
        at += w
    masks = (reduce(int.__or__, chosen) for chosen in combinations(blocks, choose))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


_FIRST = _masks(BLOCKS, 3, list(range(64)))
_LINKS = "a long, b long, fp long, rep long, mask long"


def _forest(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    if len(fps) == 2:
        return [(0, 1)] if int(fps[0] ^ fps[1]).bit_count() <= most else []
    edges, left = [], np.arange(len(fps))
    while len(left) > 1:
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            p = stack.pop()
            near = np.bitwise_count(fps[left] ^ fps[p]) <= most
            found = left[near]
            if len(found):
                edges += zip(repeat(p), found)
                stack += list(found)
                left = left[~near]
    return edges


def _search(most: int, split: bool):
    """Links under each key of a sorted partition; members of too large keys come back to be keyed again."""

    def out(a, b, fp=None, rep=None, mask=None):
        n = len(a) if a is not None else len(fp)
        null = pa.nulls(n, pa.int64())
        cols = [null if x is None else pa.array(x, pa.int64()) for x in (a, b, fp, rep, mask)]
        return pa.RecordBatch.from_arrays(cols, ["a", "b", "fp", "rep", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 4), np.int64)  # the open key's members
        over = None  # a key that is too large
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            rows = np.concatenate([rest, rows])
            if not len(rows):
                continue
            starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
            ends = np.r_[starts[1:], len(rows)]
            a, b = [], []
            for s, e in zip(starts, ends, strict=True):
                last, key = e == len(rows), tuple(rows[s, :2])
                if over == key or (split and e - s > BOUND):
                    over = key
                    yield out(None, None, rows[s:e, 2], rows[s:e, 3], rows[s:e, 0])
                    if last:
                        e = s = len(rows)
                elif not last and e - s > 1:
                    for i, j in _forest(rows[s:e, 2].view(np.uint64), most):
                        a.append(rows[s + i, 3])
                        b.append(rows[s + j, 3])
                if last:
                    rest = rows[s:e].copy()
            if a:
                yield out(a, b)
        if len(rest) > 1:
            found = _forest(rest[:, 2].copy().view(np.uint64), most)
            if found:
                yield out([rest[i, 3] for i, _ in found], [rest[j, 3] for _, j in found])

    return run


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    keys = F.explode(F.array(*(F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for m in masks)))
    return fps.select(keys.alias("k"), "fp", "rep").select("k.mask", "k.key", "fp", "rep")


def _meet(keyed: DataFrame, most: int, split: bool) -> DataFrame:
    return keyed.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(_search(most, split), _LINKS)


def simhash_links(classes: DataFrame, most: int = 3) -> DataFrame:
    """(a, b) links between class representatives, enough of them to connect all that are linked.

    ``classes`` has one row (fp, rep) for each distinct fingerprint.
    """
    if not 0 <= most <= 3:
        raise ValueError("blocks are laid out for at most 3 differing bits")
    spark = classes.sparkSession
    small_batches(spark)
    found = written(_meet(_keyed(classes, _FIRST), most, True), "links")
    big = found.where("fp is not null").select("fp", "rep", F.col("mask").alias("held"))
    again = None
    for m in _FIRST:  # the free bits differ by mask
        free = [b for b in range(64) if not (m >> b) & 1]
        w, extra = divmod(len(free), 8)
        subs = [s | m for s in _masks(tuple(w + (i < extra) for i in range(8)), 5, free)]
        part = F.array(*(F.lit(s) for s in subs))
        again = F.when(F.col("held") == m, part) if again is None else again.when(F.col("held") == m, part)
    finer = big.select(F.explode(again).alias("mask"), "fp", "rep").select(
        "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "rep"
    )
    return found.where("a is not null").select("a", "b").unionAll(_meet(finer.distinct(), most, False).select("a", "b"))


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3, seed: int = 42
) -> DataFrame:
    """(id, fingerprint, component_id) for each row; the component is the smallest id reachable over links.

    Equal fingerprints are one class, so copies are never paired. Null and empty
    texts have fingerprint zero, linked like any other. Rows that repeat an id
    stay separate rows. A null id has no class of its own: it takes the component
    of its fingerprint, null if no other row has it. Other columns are not read.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle, seed), "fps")
    classes = written(fps.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    found = connected_components(simhash_links(classes, most), "a", "b")
    comp = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return fps.join(comp, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


#: Growth of a size class, blocks of a text that are keys, differing bits beyond which a candidate is dropped (of similar texts 2 in 10,000).
CLASS, KEYS, BITS = 1.5, 16, 20
_SKETCH = "id long, text_hash long, set_hash long, n int, fp long, shingles array<int>, keys array<long>"


def block_keys(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """Keys of a set of shingle hashes; of sets that are ``similarity`` alike almost all share one.

    Sets of one size class are dealt into as many blocks as their differing
    shingles can be, and one more; a set that can meet smaller ones of the class
    below has the keys of both. The first ``KEYS`` blocks with a shingle are keys:
    each is whole with a chance of 0.37 at least, so that 0.1 % are lost at most.
    """
    n, out = len(hashes), []
    of = lambda m: int(math.log(max(1.0, m)) / math.log(CLASS) + 1e-9)
    for c in sorted({of(n), of(n * similarity)}) if n else ():
        m = int(CLASS ** (c + 1) * (1 / similarity - 1)) + 1
        block = (hashes >> np.uint64(20)) % np.uint64(m)
        low = block < KEYS
        kept, block = hashes[low], block[low]
        if len(kept):
            order = np.argsort(block, kind="stable")
            kept, block = kept[order], block[order]
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            sums = np.add.reduceat(kept, starts)  # modulo 2^64
            salt = (np.uint64(c) << np.uint64(8)) + block[starts]
            out.append((sums ^ salt * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for text in batch.column(2).to_pylist():
                hashes = np.unique(shingle_hashes(text, shingle))
                short = np.unique(hashes.astype(np.uint32)).view(np.int32)
                whole = np.array([xxhash.xxh64_intdigest(hashes.tobytes())], np.uint64).view(np.int64)[0]
                fp = np.array([majority(hashes)], np.uint64).view(np.int64)[0]
                got.append((whole, len(short), fp, short, block_keys(hashes, similarity).view(np.int64)))
            cols = list(zip(*got, strict=True)) if got else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(cols[0], pa.int64()),
                    pa.array(cols[1], pa.int32()),
                    pa.array(cols[2], pa.int64()),
                    pa.array(cols[3], pa.list_(pa.int32())),
                    pa.array(cols[4], pa.list_(pa.int64())),
                ],
                ["id", "text_hash", "set_hash", "n", "fp", "shingles", "keys"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).mapInArrow(run, _SKETCH)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, text_hash, group_id, kept) of each row: groups of texts linked by a shingle similarity of ``similarity`` or more.

    Equal shingle sets are one class, so copies are never paired, and the empty
    texts are one group. Candidates are the classes whose fingerprints differ in at
    most three bits, by the search of :func:`simhash_links`, and those that share a
    block. Under a block each class is compared with one other first;
    classes that this leaves in different groups are compared with a second one,
    and those still apart with one another. ``text_hash`` is Spark's xxhash64 of the
    text and tells rows apart that repeat an id; rows that repeat both are alike.
    The row with the smallest id of a group is kept, nulls last. Only the named
    columns are read.
    """
    rows = written(_sketches(docs, id_col, text_col, shingle, similarity), "sketches")
    members = rows.select(F.explode("keys").alias("k"), F.col("set_hash").alias("a"), "fp", "n")
    shared = members.groupBy("k").agg(F.min("a").alias("x"), F.max("a").alias("y")).where("x < y").select("k")
    met = written(members.join(written(shared, "shared"), "k", "left_semi").distinct(), "met")

    def like(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, fp, n, b, fp_b, n_b) whose fingerprints and sizes are alike, as (a, b)."""
        alike = (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_b"))) <= BITS) & (F.least("n", "n_b") >= F.greatest("n", "n_b") * similarity)
        return pairs.where(alike).select("a", "b")

    def links(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are similar."""
        pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        ends = pairs.select(F.col("a").alias("set_hash")).unionAll(pairs.select("b")).distinct()
        sets = rows.select("set_hash", "shingles").join(ends, "set_hash", "left_semi").dropDuplicates(["set_hash"])
        both = pairs.join(sets.select(F.col("set_hash").alias("a"), F.col("shingles").alias("x")), "a")
        both = both.join(sets.select(F.col("set_hash").alias("b"), F.col("shingles").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        return written(both.where(common >= (F.size("x") + F.size("y") - common) * similarity).select("a", "b"), "links")

    def other(of: DataFrame) -> DataFrame:
        return of.select("k", F.col("a").alias("b"), F.col("fp").alias("fp_b"), F.col("n").alias("n_b"), *([F.col("g").alias("g_b")] if "g" in of.columns else []))

    def leaders(of: DataFrame, order) -> DataFrame:
        return other(of.groupBy("k").agg(F.min(F.struct(order.alias("o"), *(c for c in of.columns if c != "k"))).alias("s")).select("k", "s.*"))

    def apart(found: DataFrame) -> DataFrame:
        """Members of the blocks that hold more than one group, with their group g."""
        groups = connected_components(found, "a", "b").select(F.col("node").alias("a"), F.col("component").alias("g"))
        grouped = met.join(groups, "a", "left").withColumn("g", F.coalesce("g", "a"))
        several = grouped.groupBy("k").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x < y").select("k")
        return written(grouped.join(several, "k", "left_semi"), "apart")

    sets = written(rows.select("fp", "set_hash").distinct(), "sets")
    prints = written(sets.groupBy("fp").agg(F.min("set_hash").alias("rep")), "prints")
    close = sets.join(prints, "fp").where("set_hash <> rep").select(F.col("set_hash").alias("a"), F.col("rep").alias("b")).unionAll(simhash_links(prints))
    found = links(close.unionAll(like(met.join(leaders(met, F.col("a")), "k").where("a <> b"))))
    left = apart(found)
    found = found.unionAll(links(like(left.join(leaders(left, F.xxhash64("a", "k")), "k").where("g <> g_b"))))
    left = apart(found)
    found = found.unionAll(links(like(left.join(other(left), "k").where("g < g_b"))))
    groups = connected_components(found, "a", "b").select(F.col("node").alias("set_hash"), F.col("component").alias("group"))
    grouped = rows.select("id", "text_hash", "set_hash").join(groups, "set_hash", "left").withColumn("group", F.coalesce("group", "set_hash"))
    grouped = written(grouped, "grouped")
    first = grouped.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "text_hash")).alias("first"))
    same = F.col("id").eqNullSafe(F.col("first.id")) & F.col("text_hash").eqNullSafe(F.col("first.text_hash"))
    return grouped.join(first, "group").select(F.col("id").alias(id_col), "text_hash", F.col("first.id").alias("group_id"), same.alias("kept"))
