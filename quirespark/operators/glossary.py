"""Glossary terms in texts: containment join, top entries, merge and upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirespark.functions.text import folded_term

#: What may follow a mentioned term.
SUFFIX = "(?:s|es|'s|s')?"


def mentions(text: Column, term: Column, folded: bool = False) -> Column:
    """The term as a whole word, whatever its case, also in the plural or possessive."""
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), folded_term(term), F.lit(rf"\E{SUFFIX}(?![\p{{L}}\p{{N}}])"))
    return (folded_term(term) != "") & F.regexp_like(text if folded else folded_term(text), quoted)


def occurs(text: Column, term: Column) -> Column:
    """The term as a whole word in its own case."""
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), term, F.lit(r"\E(?![\p{L}\p{N}])"))
    return (term != "") & F.regexp_like(text, quoted)


#: Words of names and titles that alone name nobody.
STOP = "the and of de da do das dos la le les el los las von van der den mister miss lady lord king queen saint san santa".split()


def part_names(term: Column) -> Column:
    """A term's own names: words of four letters or more with a capital, titles and particles left out."""
    return F.filter(F.split(term, r"[\s\-–]+"), lambda w: (F.length(w) >= 4) & w.rlike(r"^\p{Lu}") & ~F.lower(w).isin(*STOP))


def matches(texts: DataFrame, terms: DataFrame, text_id: str, text: str = "text") -> DataFrame:
    """(text_id, term, pos, origin, score): terms that a text mentions, 3 for the whole term, 2 for one of its names in its own case, 1 more if a user wrote it.

    A mentioned term begins with a whole word of the text, so the texts' distinct
    words are joined to first words by equality, and its distinct neighbours to terms
    of two words. That decides these terms, whose plural forms are keys too; only
    longer terms are then looked for by a pattern, in the texts that have their first word. Names of a term are joined to
    words in the same way. No text meets every term.
    """
    run = r"[\p{L}\p{N}]+"
    folded = folded_term(F.col("term"))
    first = F.regexp_extract(folded, run, 0)
    single = folded.rlike(rf"^{run}$")
    plural = lambda w: F.array(w, F.concat(w, F.lit("s")), F.concat(w, F.lit("es")))
    double, known = folded.rlike(rf"^{run} {run}$"), terms.where(first != "")
    forms = F.when(single, plural(first)).otherwise(F.array(first))
    keyed = known.where(~double).select("term", "pos", "origin", single.alias("single"), F.explode(forms).alias("word"))
    doubly = known.where(double).select("term", "pos", "origin", F.lit(True).alias("single"), F.explode(plural(folded)).alias("two"))
    words = texts.select(text_id, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(run), F.lit(0)))).alias("word"))
    # a run keeps its blank where the next one follows it
    runs = texts.select(text_id, F.regexp_extract_all(folded_term(F.col(text)), F.lit(rf"{run}(?: (?=[\p{{L}}\p{{N}}]))?"), F.lit(0)).alias("_runs"))
    # joined as strings, which are told apart by their hash
    follows = lambda a, b: F.when(F.endswith(a, F.lit(" ")), F.concat(a, F.rtrim(b)))
    beside = runs.select(text_id, F.explode(F.array_distinct(F.zip_with("_runs", F.slice("_runs", 2, F.size("_runs")), follows))).alias("two"))
    pairs = words.join(keyed, "word").drop("word").unionByName(beside.join(doubly, "two").drop("two")).distinct()
    bodies = texts.select(text_id, F.col(text).alias("_text"), folded_term(F.col(text)).alias("_folded"))
    # a plain search comes first, as a pattern has to be made for each pair
    own_case = F.contains("_text", "term") & occurs(F.col("_text"), F.col("term"))
    any_case = F.contains(F.col("_folded"), folded_term(F.col("term"))) & mentions(F.col("_folded"), F.col("term"), folded=True)
    longer = pairs.where("not single").join(bodies, text_id).where(own_case | any_case)
    found = pairs.where("single").unionByName(longer.select(*pairs.columns))
    named = terms.select("term", "pos", "origin", F.explode(part_names(F.col("term"))).alias("name")).withColumn("word", F.regexp_extract("name", run, 0))
    own = texts.select(text_id, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(run), F.lit(0)))).alias("word"))
    part = own.join(named, "word")
    odd = part.where("word <> name").join(texts.select(text_id, F.col(text).alias("_text")), text_id).where(occurs(F.col("_text"), F.col("name")))
    parts = part.where("word = name").select(text_id, "term", "pos", "origin").unionByName(odd.select(text_id, "term", "pos", "origin"))
    scored = found.select(text_id, "term", "pos", "origin", F.lit(3).alias("s")).unionByName(parts.withColumn("s", F.lit(2)))
    best = scored.groupBy(text_id, "term", "pos", "origin").agg(F.max("s").alias("s"))
    return best.select(text_id, "term", "pos", "origin", (F.col("s") + (F.col("origin") == "user").cast("int")).cast("long").alias("score"))


def top_entries(found: DataFrame, text_id: str, most: int = 60) -> DataFrame:
    """The best entries of each text: by score, then list order."""
    w = Window.partitionBy(text_id).orderBy(F.desc("score"), "pos")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)


def merge_candidates(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (term, translation, pos) that no entry has yet; of equal ones the first."""
    key = folded_term(F.col("term"))
    new = candidates.withColumn("key", key).where("key <> ''").join(entries.select(key.alias("key")), "key", "left_anti")
    return new.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("pos"))).where("r = 1").drop("r")


def upsert(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """(key, term, translation, origin): entries with changes merged in by folded term; a change makes the origin user."""
    key = folded_term(F.col("term")).alias("key")
    old = entries.select(key, F.struct("term", "translation", "origin").alias("o"))
    new = changes.select(key, F.struct("term", "translation").alias("n"))
    return old.join(new, "key", "full_outer").select(
        "key",
        F.coalesce("o.term", "n.term").alias("term"),
        F.coalesce("n.translation", "o.translation").alias("translation"),
        F.when(F.col("n").isNotNull(), "user").otherwise(F.col("o.origin")).alias("origin"),
    )
