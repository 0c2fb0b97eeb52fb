"""Source divergence audit: how far each source's words are from the others of its language.

Texts become counts of (language, source, term), added up in each task before
the shuffle. The kept terms of a language are dealt into blocks; one task holds the
dense int64 matrix of one block, groups by terms, computes all pairs of groups at
once by broadcasting and gives partial sums of the pairs and each group's foremost
terms of the block. Spark adds up the partial pair matrices and merges the heaps.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirespark.llm.common import small_batches, written

#: A-Z to lower case; a-z and all bytes of non-ASCII characters stay; the rest ends a term.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Distinct terms that a task holds before it passes its counts on; bytes of a text that are cut into terms at once.
HELD, CUT = 400_000, 1_000_000
#: The whole of a probability.
UNIT = 1_000_000_000
#: Cells of one term block's matrix, and of the array of all pairs that is made at once.
CELLS, PAIRS = 1_000_000, 1_000_000
_COUNTS = "lang string, source string, term string, n long, docs long"
_PART = "lang string, source string, part string, item string, value long"


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    data = text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + CUT)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (language, source, term), added up over many texts; a null term names a group."""
    n: dict = defaultdict(Counter)
    docs: dict = defaultdict(Counter)

    def given():
        for (lang, source), terms in n.items():
            own = docs[lang, source]
            names = [None, *(t.decode("utf-8", "replace") for t in terms)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(names), pa.string()),
                    pa.array([source] * len(names), pa.string()),
                    pa.array(names, pa.string()),
                    pa.array([0, *terms.values()], pa.int64()),
                    pa.array([0, *(own[t] for t in terms)], pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )
        n.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            counts, seen = n[lang, source], set()
            for words in terms_of(text):
                counts.update(words)
                seen.update(words)
            docs[lang, source].update(seen)
        if sum(map(len, n.values())) > HELD:
            yield from given()
    yield from given()


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * count / whole) for 0 <= count <= whole: long division by thousands, exact for ``whole`` below 9e15."""
    out, rest = np.divmod(count, np.maximum(whole, 1))
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, np.maximum(whole, 1))
        out = out * 1000 + digit
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q))."""
    d = p - q
    return d * d // (p + q)


def _block(top: int):
    """One language's block of terms: partial sums of all pairs of its groups, and each group's foremost terms.

    Cells are (source, term, n, of_lang); a null term brings a group and the
    denominators of the group and the language.
    """

    def run(table: pa.Table) -> pa.Table:
        lang, first = table.column("lang")[0].as_py(), table.column("block")[0].as_py() == 0
        source, term = table.column("source").to_pylist(), table.column("term").to_pylist()
        n, of_lang = table.column("n").to_numpy(), table.column("of_lang").to_numpy()
        heads = [i for i, t in enumerate(term) if t is None]
        groups = {source[i]: g for g, i in enumerate(heads)}
        names = sorted({t for t in term if t is not None}, key=str.encode)
        column = {t: j for j, t in enumerate(names)}
        cells = [i for i, t in enumerate(term) if t is not None]
        at = np.array([groups[source[i]] for i in cells], np.int64), np.array([column[term[i]] for i in cells], np.int64)
        count = np.zeros((len(groups), len(names)), np.int64)
        count[at] = n[cells]
        whole = np.zeros(len(names), np.int64)
        whole[at[1]] = of_lang[cells]
        p = shares(count + 2, n[heads][:, None])
        q = shares(whole + 2, of_lang[heads[:1]])
        rows: list[tuple] = []
        order = list(groups)
        if first or names:  # a language without terms has its pairs from block 0
            step = max(1, PAIRS // max(1, len(groups) * len(names)))
            for g in range(0, len(groups), step):
                sums = distance(p[g : g + step, None, :], p[None, :, :]).sum(axis=2)
                rows += [(order[g + i], "pair", order[j], int(v)) for i, line in enumerate(sums) for j, v in enumerate(line) if g + i != j]
        for g, own in enumerate(order):
            found = np.flatnonzero((count[g] > 0) & (p[g] > q))
            value = distance(p[g, found], q[found])
            best = heapq.nsmallest(top, zip((-value).tolist(), found.tolist(), strict=True))  # columns stand in the terms' order
            rows += [(own, "term", names[j], -v) for v, j in best]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.Table.from_arrays(
            [pa.array([lang] * len(rows), pa.string()), *(pa.array(c, pa.string()) for c in cols[:3]), pa.array(cols[3], pa.int64())],
            ["lang", "source", "part", "item", "value"],
        )

    return run


def audit(docs: DataFrame, least: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources of the language, and the terms that set a source apart.

    A term is a run of ASCII letters and non-ASCII characters, A-Z in lower case;
    a language keeps the terms found in at least ``least`` of its documents. A
    group's share of a term is ``p = 1 + floor(1e9 * (n + 2) / (N + 2 * V))``;
    the distance of two shares is ``floor((p - q)**2 / (p + q))``. ``part`` pair
    sums it over all kept terms for every other source; ``part`` term gives the
    ``top`` terms with a share above the language's. Ranks go by value, ties by the item's bytes.

    Null texts, languages and sources count as empty ones. A group without kept
    terms has its pairs all the same; in a language without any, all values are 0.
    A language with one source has no pairs. Repeated rows count each. An empty
    table gives no rows. Other columns play no part. One block's matrix has
    about ``CELLS`` cells: terms are dealt by hash into as many blocks as that
    takes, so a task's memory depends neither on the texts nor on the vocabulary, only on
    the sources of one language, whose pairs are the result.
    """
    small_batches(docs.sparkSession)
    empty = F.lit("")
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"), F.coalesce(F.col(source_col).cast("string"), empty).alias("source"), F.coalesce(F.col(text_col), empty).alias("text")
    )
    counts = written(texts.mapInArrow(_counted, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    by_term = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("of_docs")).where(F.col("of_docs") >= least).drop("of_docs")
    kept = written(counts.where("term is not null").drop("docs").join(by_term, ["lang", "term"]), "kept")

    sizes = by_term.groupBy("lang").agg(F.count("*").alias("V"), F.sum("of_lang").alias("N"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = counts.where("term is null").select("lang", "source").join(own, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["own", "V", "N"])
    groups = written(groups, "groups")
    most = groups.groupBy("lang").agg(F.count("*").alias("S"), F.max("V").alias("V")).agg(F.max("S").alias("S"), F.max("V").alias("V")).first()
    width = max(16, min(256, CELLS // max(most.S or 1, 1)))
    blocks = max(1, -(-(most.V or 0) // width))

    heads = groups.select(
        "lang",
        "source",
        F.lit(None).cast("string").alias("term"),
        (F.col("own") + 2 * F.col("V")).alias("n"),
        (F.col("N") + 2 * F.col("V")).alias("of_lang"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    cells = kept.select("lang", "source", "term", "n", "of_lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"))
    parts = written(cells.unionByName(heads).groupBy("lang", "block").applyInArrow(_block(top), _PART), "parts")

    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
