"""The translation of pending segments (D1, D2, D3, J17, O11, X6, X14, X15): batches, requests, replies, and what goes out again.

A round is one set of joins and windows over all requests of all books at once: the
requests go through a pluggable function of a DataFrame, the replies are taken apart,
judged row by row, and what did not come back well is put into new requests:
halves where the answers are out of order, were cut or refused, else once more
with the reasons. A request bounds its rows, so nothing grows with a book. Rounds are
written to a folder, and there are at most :data:`ROUNDS`, as each kind of repetition is counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions import labels as lb
from quirespark.functions import markup as mk
from quirespark.functions import quality as qa
from quirespark.functions import text as tx
from quirespark.operators.folds import greedy_batches

KEYS = ["book", "chapter", "i"]
#: Rows and characters of a request where a service states none, splits of cut and of refused requests.
SEGMENTS, CHARS, CUTS, REFUSALS = 120, 24_000, 4, 2
#: Cut and refused requests, one realignment and a last try, each with the round before it.
ROUNDS = CUTS + REFUSALS + 3
#: What a request that goes out again says about the last answer, by reason.
INSTRUCTIONS = {
    "missing": "Some segments had no translation: answer every segment.",
    "empty": "Some translations were empty.",
    "tags": "Keep every numbered tag of a segment exactly once.",
    "misaligned": "Different segments had the same translation: keep each under its own id.",
    "echo": "Some segments came back untranslated.",
    "partial-echo": "Parts of some segments came back untranslated.",
    "wrong-language": "Write in the target language only.",
    "commentary": "Write the translation alone, without remarks.",
    "leak": "Leave out the request's own tags.",
    "stray-tag": "Use no HTML tags or asterisks that the source hasn't.",
    "foreign-script": "Use the letters of the target language.",
    "length": "Translate the whole segment and add nothing.",
}

Translate = Callable[[DataFrame], DataFrame]


def demo(requests: DataFrame) -> DataFrame:
    """A service that gives every segment back as it is."""
    return requests.select("request", F.col("prompt").alias("reply"), F.lit("end").alias("stop_reason"))


def judged(src: Column, out: Column, target: str = "pt-BR") -> Column:
    """The verdict of a real service's output, null if nothing is wrong."""
    return qa.verdict(src, out, F.lit(target))


def pending(segments: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Segments (book, chapter, i, src, out, failed) without an output or failure, in [start, end) where given."""
    open_ = segments.where(F.col("out").isNull() & ~F.coalesce("failed", F.lit(False)))
    open_ = open_ if start is None else open_.where(F.col("i") >= start)
    return (open_ if end is None else open_.where(F.col("i") < end)).select(*KEYS, "src")


def requests_of(open_: DataFrame, chars: int | None = None, segments: int | None = None) -> DataFrame:
    """(book, chapter, i, src, request, id, first): segments in requests of a book, in order, numbered from 1 in each.

    ``first`` is the id of the first row of the request with the same text: only that one goes out. A text without words doesn't go out at all and has first 0.
    """
    at = F.shiftleft(F.col("chapter").cast("long"), 32) + F.col("i")
    rows = open_.withColumn("at", at).withColumn("size", F.length("src").cast("long"))
    # a column of the book alone decides, so that books are folded apart
    batch = greedy_batches(rows, "book", "at", "size", CHARS if chars is None else chars, SEGMENTS if segments is None else segments)
    own = rows.join(batch, ["book", "at"]).withColumn("request", F.concat_ws("/", F.col("book").cast("string"), F.col("batch").cast("string")))
    own = own.withColumn("id", F.row_number().over(Window.partitionBy("request").orderBy("at")).cast("long"))
    first = F.min("id").over(Window.partitionBy("request", "src"))
    return own.select(*KEYS, "src", "request", "id", F.when(tx.has_words(tx.strip_markup(F.col("src"))), first).otherwise(0).alias("first"))


def prompts(sent: DataFrame) -> DataFrame:
    """(request, prompt): the segments of each request in order, below what was wrong before."""
    said = F.create_map(*(F.lit(x) for pair in INSTRUCTIONS.items() for x in pair))
    reasons = F.array_sort(F.array_compact(F.collect_set(F.when(F.col("strict"), F.try_element_at(said, F.col("reason"))))))
    parts = F.array_sort(F.collect_list(F.struct("id", F.concat(F.lit('<seg id="'), F.col("id").cast("string"), F.lit('">'), "src", F.lit("</seg>")).alias("s"))))
    g = sent.groupBy("request").agg(reasons.alias("reasons"), parts.alias("parts"))
    return g.select("request", F.array_join(F.concat(F.col("reasons"), F.transform("parts", lambda p: p["s"])), "\n").alias("prompt"))


def answered(sent: DataFrame, replies: DataFrame, judge: Callable[[Column, Column], Column] | None) -> DataFrame:
    """``sent`` with stop_reason, out, problem (null if the output is good), back (it was in the reply) and same (its output is another text's too)."""
    last = F.posexplode_outer(mk.reply_segments(F.col("reply"))).alias("place", "s")
    bodies = replies.select("request", last).where("s is not null").groupBy("request", F.col("s.id").alias("id")).agg(F.max_by("s.body", "place").alias("body"))
    joined = sent.join(replies.select("request", "stop_reason"), "request", "left").join(bodies, ["request", "id"], "left").withColumn("fixed", mk.repair("body", "src"))
    fold = lambda c: F.trim(F.regexp_replace(F.lower(tx.strip_markup(c)), r"\s+", " "))
    words = F.trim(F.regexp_replace(F.lower(tx.strip_markup(F.col("src"))), r"[^\p{L}\p{N}]+", " "))
    alike = joined.withColumn("folded", F.when(F.length(fold(F.col("body"))) >= 20, fold(F.col("body")))).withColumn("words", words)
    group = Window.partitionBy("request", "folded")
    same = F.col("folded").isNotNull() & (F.size(F.collect_set("words").over(group)) >= 2)
    markup, body = F.col("fixed.markup"), F.col("body")
    stripped = lb.without_stray_markup(markup)
    hard = judge(F.col("src"), markup) if judge else F.lit(None).cast("string")
    # what is left of a last try's stray marks is taken out
    again = judge(F.col("src"), stripped) if judge else F.lit(None).cast("string")
    stray = F.col("strict") & (hard == "stray-tag")
    problem = (
        F.when(body.isNull(), "missing")
        .when((F.trim(body) == "") & (F.trim("src") != ""), "empty")
        .when((F.size("fixed.missing") > 0) & ~F.col("strict"), "tags")
        .when(stray, again)
        .otherwise(hard)
    )
    return alike.withColumn("same", same).select(
        *sent.columns,
        "stop_reason",
        F.when(stray, stripped).otherwise(markup).alias("out"),
        F.when(F.col("same") & ~F.col("strict"), "misaligned").otherwise(problem).alias("problem"),
        body.isNotNull().alias("back"),
        "same",
        "folded",
    )


def decided(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`answered` with what becomes of each: ``state`` done, failed or again, and the request in which it goes out again."""
    whole = Window.partitionBy("request")
    order = whole.orderBy("id")
    group = Window.partitionBy("request", "folded").orderBy("id")
    r = rows.withColumn("pos", F.row_number().over(order)).withColumn("n", F.count("*").over(whole))
    # a group of equal outputs counts its rows but the first
    r = r.withColumn("case", (F.col("same") & (F.row_number().over(group) > 1)).cast("int"))
    bad = F.col("problem").isNotNull()
    r = r.withColumn("cases", F.sum("case").over(whole)).withColumn("rest", F.sum(bad.cast("int")).over(whole)).withColumn("nth", F.sum(bad.cast("int")).over(order))
    r = r.withColumn("last", F.coalesce(F.max(F.when(F.col("back"), F.col("pos"))).over(whole), F.lit(0)))
    r = r.withColumn("culprit", F.max(F.when((F.col("pos") == F.col("last") + 1) & (F.col("last") > 0), F.col("chapter"))).over(whole))
    beyond = bad & (F.col("pos") > F.col("last")) & F.col("culprit").isNotNull() & (F.col("chapter") != F.col("culprit"))
    r = r.withColumn("next", F.min(F.when(beyond, F.col("nth"))).over(whole))
    half = lambda c: F.ceil(F.col(c) / 2).cast("int")
    misaligned = ~F.col("strict") & ~F.col("realigned") & (F.col("cases") >= 2) & (F.col("cases") * 10 >= F.col("n")) & (F.col("n") > 1)
    cut = (F.col("stop_reason") == "max_tokens") & (F.col("n") > 1) & (F.col("depth") < CUTS)
    few = (F.col("rest") < F.col("n")) & (F.col("rest") <= half("n"))
    refused = (F.col("stop_reason") == "refusal") & (F.col("last") < F.col("n")) & (F.col("rest") > 1) & (F.col("refusals") < REFUSALS)
    middle = F.when(F.col("next") > 1, F.col("next") - 1).otherwise(half("rest"))
    side = (
        F.when(misaligned, F.when(F.col("pos") > half("n"), "b").otherwise("a"))
        .when(cut & few, "r")
        .when(cut, F.when(F.col("nth") > half("rest"), "b").otherwise("a"))
        .when(refused, F.when(F.col("nth") > middle, "b").otherwise("a"))
        .otherwise("s")
    )
    kind = F.when(misaligned, "misaligned").when(cut, "cut").when(refused, "refused").otherwise("last")
    state = F.when(misaligned, "again").when(~bad, "done").when((kind == "last") & F.col("strict"), "failed").otherwise("again")
    kept = [c for c in rows.columns if c not in ("stop_reason", "back", "same", "folded", "problem", "request", "strict", "realigned", "depth", "refusals", "reason", "out")]
    return r.select(
        *kept,
        "request",
        F.when(state == "done", F.col("out")).alias("out"),
        state.alias("state"),
        F.when(misaligned & F.col("problem").isNull(), F.when(F.col("same"), "misaligned")).otherwise(F.col("problem")).alias("reason"),
        F.concat_ws(".", "request", side).alias("again"),
        F.when(kind == "last", True).otherwise(F.col("strict")).alias("strict"),
        (F.col("realigned") | misaligned).alias("realigned"),
        (F.col("depth") + 1).alias("depth"),
        (F.col("refusals") + ((kind == "refused") & bad).cast("int")).alias("refusals"),
    )


def begun(rows: DataFrame) -> DataFrame:
    """Rows of :func:`requests_of` that go out, before the first round."""
    return rows.where("first = id").select(
        *KEYS, "src", "id", F.col("request").alias("origin"), "request", F.lit(False).alias("strict"), F.lit(False).alias("realigned"), F.lit(0).alias("depth"), F.lit(0).alias("refusals"), F.lit(None).cast("string").alias("reason")
    )


def one_round(sent: DataFrame, translate: Translate, judge: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """What becomes of each row of one round of requests."""
    return decided(answered(sent, translate(prompts(sent)), judge))


def with_copies(rows: DataFrame, settled: DataFrame, engine: str) -> DataFrame:
    """(book, chapter, i, out, failed, by, warn) for all rows of :func:`requests_of`: copies take what the first has, texts without words stay."""
    s = settled.select(F.col("origin").alias("request"), F.col("id").alias("first"), F.struct("out", "state", "reason").alias("s"))
    joined = rows.join(s, ["request", "first"], "left")
    bare = F.col("first") == 0
    out = F.when(bare, F.col("src")).otherwise(F.col("s.out"))
    failed = ~bare & (F.col("s.state") == "failed")
    return joined.where(bare | F.col("s").isNotNull()).select(
        *KEYS, out.alias("out"), failed.alias("failed"), F.when(~bare & ~failed, engine).alias("by"), F.when(failed & F.col("s.reason").isNotNull(), F.array("s.reason")).alias("warn")
    )


def run(rows: DataFrame, translate: Translate, folder: str, judge: Callable[[Column, Column], Column] | None = None, engine: str = "demo") -> DataFrame:
    """Results for all rows of :func:`requests_of`, as :meth:`quirespark.sources.chapters.ChapterTable.save` takes them.

    Each round is a table under ``folder``, a folder of the job that all executors
    reach; a service is asked once for each request of a round. A job that is
    started again with its folder goes on behind the last round that was written whole.
    """
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    system = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    sent, settled = begun(rows), None
    for n in range(ROUNDS):
        path = f"{folder.rstrip('/')}/round={n}"
        if not system.exists(hadoop(f"{path}/_SUCCESS")):
            one_round(sent, translate, judge).write.mode("overwrite").parquet(path)
        made = spark.read.parquet(path)
        over = made.where("state <> 'again'").select("origin", "id", "out", "state", "reason")
        settled = over if settled is None else settled.unionByName(over)
        left = made.where("state = 'again'")
        if left.isEmpty():
            break
        sent = left.select(*KEYS, "src", "id", "origin", F.col("again").alias("request"), "strict", "realigned", "depth", "refusals", "reason")
    return with_copies(rows, settled, engine)
