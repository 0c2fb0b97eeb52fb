"""Languages by character trigrams: profiles counted from labelled texts, scores against every profile, candidates in order."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Trigrams of a profile; languages that a set of profiles may have; distinct trigrams that a task counts before it passes them on.
SIZE, LANGUAGES, HELD = 300, 400, 200_000


def folded(text: Column) -> Column:
    """Words in lower case between single blanks."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))


def trigrams(text: str) -> Counter:
    """Trigrams of a folded text; those that reach over a whole word of one letter count too."""
    return Counter(map("".join, zip(text, text[1:], text[2:], strict=False)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = defaultdict(Counter)

    def given():
        for lang, grams in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(list(grams)), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held[lang].update(trigrams(text))
        if sum(map(len, held.values())) > HELD:
            yield from given()
    yield from given()


def profiles(docs: DataFrame, lang: str = "lang", text: str = "text", size: int = SIZE) -> DataFrame:
    """(lang, gram, place): the ``size`` most frequent trigrams of each language over all its texts, ties by the trigram.

    Null and empty languages have no profile. Trigrams are added up in each task before the shuffle.
    """
    rows = docs.where(F.coalesce(F.col(lang), F.lit("")) != "").select(F.col(lang).alias("lang"), folded(F.col(text)).alias("text"))
    counts = rows.mapInArrow(_counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size).select("lang", "gram", "place")


def ranked(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """(id, lang, rank, distance, score): all profiles' languages for each text, the likeliest first.

    The distance adds up, over the text's ``size`` most frequent trigrams, how far a
    trigram's place is from that in the profile, ``size`` where it has none. The
    score is 1 for the likeliest and falls to 0 for a language without any of the
    text's trigrams. A text without letters has no rows. Profiles go to all tasks: ``size`` trigrams
    of at most ``LANGUAGES`` languages.
    """
    spark = docs.sparkSession
    rows = known.collect() if only is None else known.where(F.col("lang").isin(*only)).collect()
    places: dict[str, dict[str, int]] = defaultdict(dict)
    for r in rows:
        places[r.lang][r.gram] = r.place
    if len(places) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages have profiles")
    sent = spark.sparkContext.broadcast(dict(sorted(places.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = sent.value
        for batch in batches:
            ids, langs, ranks, distances, scores = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                grams = [g for g, _ in sorted(trigrams(text).items(), key=lambda x: (-x[1], x[0]))[:size]] if text.strip() else []
                found = sorted((sum(abs(p - own) if (own := place.get(g)) else size for p, g in enumerate(grams, 1)), lang) for lang, place in by.items()) if grams else []
                for rank, (distance, lang) in enumerate(found, 1):
                    least, most = found[0][0], size * len(grams)
                    ids.append(i), langs.append(lang), ranks.append(rank), distances.append(distance)
                    scores.append(1.0 if most == least else 1 - (distance - least) / (most - least))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(ids, pa.int64())), pa.array(langs, pa.string()), pa.array(ranks, pa.int32()), pa.array(distances, pa.int64()), pa.array(scores, pa.float64())], ["id", "lang", "rank", "distance", "score"])

    kind = dict(docs.dtypes)[id_col]
    found = docs.select(F.col(id_col).alias("id"), folded(F.col(text_col)).alias("text")).mapInArrow(run, f"id {kind}, lang string, rank int, distance long, score double")
    return found.withColumnRenamed("id", id_col)


def detected(docs: DataFrame, known: DataFrame, declared: Column, id_col: str = "doc_id", text_col: str = "text", least: int = 200) -> DataFrame:
    """(id, language): the likeliest language of texts of ``least`` characters or more, for others what is declared; a declared pt-PT stands where Portuguese is found."""
    first = ranked(docs.where(F.length(text_col) >= least), known, id_col, text_col).where("rank = 1").select(F.col(id_col).alias("found_id"), F.col("lang").alias("found"))
    own = docs.select(F.col(id_col), declared.alias("declared"))
    joined = own.join(first, F.col(id_col) == F.col("found_id"), "left")
    portugal = F.col("found").startswith("pt") & (F.lower("declared") == "pt-pt")
    return joined.select(id_col, F.when(portugal, "pt-PT").otherwise(F.coalesce("found", "declared")).alias("language"))


def in_language(scored: DataFrame, language: Column, id_col: str = "doc_id", least: float = 0.9) -> DataFrame:
    """(id, is_source, other) from :func:`ranked` rows: whether ``language`` scores ``least`` or more, and the likeliest other one where it doesn't."""
    own = F.max(F.when(F.col("lang") == language, F.col("score")))
    top = F.min_by("lang", "rank")
    judged = scored.groupBy(id_col).agg(F.coalesce(own >= least, F.lit(False)).alias("is_source"), top.alias("top"))
    return judged.select(id_col, "is_source", F.when(~F.col("is_source"), F.col("top")).alias("other"))
