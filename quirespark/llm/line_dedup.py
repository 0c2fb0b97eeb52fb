"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

Two lines are near if at most one word in 20 of the longer one, but at least one
word and at most 50, is inserted, deleted or replaced.

Lines of up to 39 words have a bound of one. Every candidate line emits its
variants with one word deleted as hashed keys, beside the hash of itself: lines
that differ by a replaced word share a variant at the same place, lines that
differ by an inserted word share a variant and a whole line. Keys are joined by
grouping, the earliest line under a key is the match, and the word edit distance
is verified on the lines.

Only candidates are enlarged: within one edit either the first or the second
half of the shorter line is intact, so a line whose half keys meet no other
line's has no near line and emits nothing, and one that meets others by a first
half only has its edits in the second and emits those variants.

From 40 words on the bound k is two or more, and all variants with k words
deleted would be too many. There the words (in lines of few different ones, from
the fifth on, each occurrence for itself) are dealt by their hash into 2k + 1 buckets, and a variant keeps one bucket and deletes the others: k edits change at
most 2k buckets, so near lines share a variant. Each line is verified against the
earliest line under its variants; where that is too far, the lines that share a
variant are compared if they share one of their k + 2 rarest words, as near lines
do; lines of crowds under one variant are joined on these words. No
pair within the bound is lost, and neither a very common half nor a very common
passage makes all pairs of its lines. One relation holds for lines of every length.
Pairs of neighbouring words that lines lose to one another tell most far ones
before, and equal places most near ones of very many words; the edit distance, whose
work is quadratic there, decides the others.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirespark.llm.common import scratch, written

#: Words for each allowed edit, the most edits, the shortest line that can meet one of two edits, growth of a length class.
PER_EDIT, MOST, LONG, GROWTH = 20, 50, 38, 1.25
#: Longs of marks by which candidates are told to be far.
MARKS = 4
#: Lines under a variant beyond which they are joined on their rare words as well, and first variants of a line by which a pair is told once; neither changes the result.
CROWD, TOLD = 512, 4
#: Different words for each bucket from which a word is dealt once; doesn't change the result.
DIFFERENT = 3
#: Words from which lost pairs of neighbouring words are counted before the edits, and those from which equal places are; neither changes the result.
PAIRS, PLACES = 500, 2000
#: Thai and Lao, Myanmar, Khmer, kana and Han, as ranges (a test by script name takes ten times as long): no blanks between words, each letter is one.
UNSPACED = r"[฀-໿က-႟ក-៿ぁ-ヿ㐀-䶿一-鿿豈-﫿\x{20000}-\x{3FFFF}]"
#: Letters that all of these scripts and no Latin, Greek or Cyrillic pass.
FAR = r"[\x{0E00}-\x{17FF}\x{3040}-\x{3FFFF}]"
PLACE = ("doc", "text_hash", "line_no")


def split_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text_hash, line_no, line): the lines of each text; null texts have none.

    The hash of the whole text keeps rows apart that repeat an id.
    """
    # hashed before the texts are exploded, else it would be done for each line
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.split(text_col, "\n", -1).alias("lines"))
    # an inner explode is preceded by a filter on its array, for which that is made twice more
    return texts.select("doc", "text_hash", F.posexplode_outer("lines").alias("line_no", "line")).where("line_no is not null")


def normal_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text_hash, line_no, line, n) of every line with a word: its words with one blank between them, and their number.

    Most lines need no change, which plain searches tell.
    """
    line = F.col("line")
    word = ~F.substring(line, 1, 1).isin("", *" \t\r\f") | line.rlike(r"[^ \t\r\f]")  # most lines begin with one
    lines = split_lines(docs, id_col, text_col).where(F.col("doc").isNotNull() & word)
    spaced = F.trim(F.regexp_replace(F.regexp_replace(line, UNSPACED, " $0 "), r"[ \t\r\f]+", " "))
    # plain searches for what a line that isn't words with one blank between them holds; a pattern only where a letter takes several bytes
    blanks = reduce(Column.__or__, (F.contains(line, F.lit(c)) for c in ("\t", "\r", "\f", "  ")))
    odd = blanks | line.startswith(" ") | line.endswith(" ") | ((F.octet_length(line) > F.length(line)) & line.rlike(FAR))
    normal = lines.select(*PLACE, F.when(odd, spaced).otherwise(line).alias("line"))
    n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    return normal.select(*PLACE, "line", n.alias("n"))


def _first(line: Column, k: Column) -> Column:
    return F.call_function("substring_index", line, F.lit(" "), k)


def _last(line: Column, k: Column) -> Column:
    return F.call_function("substring_index", line, F.lit(" "), -k)


def _near(x: Column, y: Column) -> Column:
    """Word edit distance at most 1: what common start and common end leave uncovered."""
    a, b = F.split(x, " "), F.split(y, " ")

    def common(x: Column, y: Column) -> Column:
        at = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
        return F.when(at == 0, F.least(F.size(x), F.size(y))).otherwise(at - 1)

    most, least = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))
    return (most - least <= 1) & (common(a, b) + common(F.reverse(a), F.reverse(b)) >= most - 1)


def _bound(n: Column) -> Column:
    """Word edits allowed where the longer line has n words."""
    return F.least(F.greatest(F.lit(1), F.floor(n / PER_EDIT)), F.lit(MOST)).cast("int")


def _pairs(line: Column) -> Column:
    """Hashes of the pairs of neighbouring words."""
    words = F.array(F.split(line, " "))  # bound to a variable, so that the line is split once
    return F.transform(words, lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.hash(F.get(w, i - 1), F.get(w, i)))))[0]


def _spelt(line: Column) -> Column:
    """Each word as one of 2^20 letters, so that the edit distance of letters is that of words but for a collision in a million."""
    codes = F.transform(F.split(line, " "), lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(1 << 20)) + 0x10000), 8, "0"))
    return F.decode(F.unhex(F.array_join(codes, "")), "UTF-32")


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, max_edits: int = 1) -> DataFrame:
    """(doc, text_hash, line_no, first_doc, first_hash, first_line): lines with an earlier line within the edit bound, and the earliest such line.

    Order is by document id, hash of the text, line number; a line is its words, so
    white space does not count, and a letter of a script without blanks is a word.
    Lines of fewer than ``min_words`` words are duplicates of equal ones only, and
    lines without a word are left out. The relation is to any earlier line, itself
    dropped or not, so the result does not depend on the order of work. The bound is
    one word edit in 20 words of the longer line, at least 1 and at most 50; with
    ``max_edits`` 0 only equal lines count. Rows with a null id are left out. Rows
    that repeat an id with other texts have lines of their own; rows that repeat both
    are one document.
    """
    if max_edits not in (0, 1):
        raise ValueError("the edit bound is 0 or 1")
    lines = normal_lines(docs, id_col, text_col)
    place, n, line = F.struct(*PLACE), F.col("n"), F.col("line")
    half, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    short = n.between(min_words, 2 * PER_EDIT - 1) if max_edits else F.lit(False)
    front = lambda k: F.xxhash64(F.lit(1), _first(line, k))
    back = lambda k: F.xxhash64(F.lit(2), _last(line, k))
    keyed = lines.select(
        F.monotonically_increasing_id().alias("row"),  # the same in each pass over the written table
        *PLACE,
        "line",
        "n",
        F.xxhash64("line").alias("a"),
        F.xxhash64(F.lit(7), "line", "n").alias("b"),
        # halves of the line as the shorter of a pair and, where they are others, as the longer one
        F.when(short, front(half)).alias("f1"),
        F.when(short & (half != less), front(less)).alias("f2"),
        F.when(short, back(n - half)).alias("b1"),
        F.when(short & (half == less), back(n - less - 1)).alias("b2"),
    )
    # most of its time would be the compression's, and no column repeats its values much
    keyed = written(keyed, "keyed", {"parquet.compression.codec.zstd.level": "1", "parquet.enable.dictionary": "false"})
    lines = keyed.select("row", *PLACE, "line", "n")
    halves = ("f1", "f2", "b1", "b2")
    classes = keyed.groupBy("a", "b").agg(F.min(F.struct(*PLACE, "row")).alias("first"), F.count(F.lit(1)).alias("copies"), *(F.any_value(c).alias(c) for c in halves))
    if max_edits:
        classes = written(classes, "lines")
        keys = F.array(*(F.struct(F.col(c).alias("k"), F.lit(1 if c[0] == "f" else 2).alias("side")) for c in halves))
        sides = classes.where("f1 is not null").select("first.row", F.explode(keys).alias("s")).select("row", "s.k", "s.side").where("k is not null")
        # counted apart and joined, so that a half shared by very many lines is summed before the shuffle and split in the join
        shared = written(sides.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("k"), "halves")
        candidates = sides.join(shared, "k", "left_semi").groupBy("row").agg(F.bit_or("side").alias("sides"))
        firsts = classes.select("first.row")
        long_keys = _long_keys(_only(lines.where(n >= max(LONG, min_words)), firsts, "row"))
        long_keys = written(long_keys.join(firsts, "row"), "long")
        wanted = candidates.unionAll(long_keys.select("row", F.lit(0).alias("sides")).distinct()).groupBy("row").agg(F.bit_or("sides").alias("sides"))
        wanted = written(wanted, "wanted")
        picked = _only(lines, wanted, "row").join(wanted, "row")
        picked = written(picked.select("row", place.alias("place"), "sides", "line", "n"), "candidates")
        near = _nearest(picked.where("sides > 0")).unionAll(_nearest_long(picked, long_keys))
        near = written(near.groupBy("place").agg(F.min("other").alias("other")), "near")
        classes = classes.select("a", "b", "copies", F.struct(*(f"first.{c}" for c in PLACE)).alias("first"))
        # lines that have neither copies nor near ones need no join
        classes = _only(classes, near.select(F.col("place").alias("first")), "first", F.col("copies") > 1)
        classes = classes.join(near, F.col("first") == F.col("place"), "left").withColumn("match", F.least("first", "other"))
    else:
        first = F.struct(*(f"first.{c}" for c in PLACE))
        classes = classes.withColumn("first", first).withColumn("match", F.col("first"))
    matched = written(classes.where("copies > 1 or match < first").select("a", "b", "match"), "matched")
    found = _only(keyed.select(*PLACE, "a", "b"), matched, "a").join(matched, ["a", "b"]).where(place > F.col("match"))
    return found.select(
        *PLACE, F.col("match.doc").alias("first_doc"), F.col("match.text_hash").alias("first_hash"), F.col("match.line_no").alias("first_line")
    ).distinct()


def _nearest(lines: DataFrame) -> DataFrame:
    """(place, other): for each candidate (place, sides, line, n) the earliest other line one edit away, if that is earlier.

    ``sides`` says which halves it shares with another line: 1 the first, 2 the second.
    """
    n, line = F.col("n"), F.col("line")
    less = F.floor((n - 1) / 2).cast("int")
    frm = F.when(F.col("sides") == 1, less + 1).otherwise(F.lit(1))
    upto = F.when(F.col("sides") == 2, less + 1).otherwise(n)
    spots = lines.select("place", "line", "n", F.explode_outer(F.concat(F.array(F.lit(0)), F.sequence(frm, upto))).alias("i"))
    i = F.col("i")
    before, after = _first(line, i - 1), _last(line, n - i)
    gap = F.when((i > 1) & (i < n), " ").otherwise("")
    variant = F.when(i == 0, F.xxhash64(n, line)).otherwise(F.xxhash64(n - 1, F.concat(before, gap, after)))
    keys = written(spots.select("place", "i", variant.alias("v")), "variants")
    # i = 0 is a whole line: it pairs with deletions at any place, a deletion with those at its own place and with the whole line
    under = keys.groupBy("v", "i").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("m"))
    over_v = Window.partitionBy("v")
    best = (
        under.select(
            "v",
            "i",
            "least",
            "m",
            F.min(F.when(i == 0, F.col("least"))).over(over_v).alias("whole"),
            F.min(F.when(i > 0, F.col("least"))).over(over_v).alias("part"),
        )
        .select("v", "i", F.when(i == 0, F.col("part")).otherwise(F.least("least", "whole")).alias("other"), "m", "least")
        .where("other is not null and (m > 1 or other < least)")
        .select("v", "i", "other")
    )
    pairs = keys.join(written(best, "best"), ["v", "i"]).where("other < place").groupBy("place").agg(F.min("other").alias("other"))
    return (
        pairs.join(lines.select("place", "line"), "place")
        .join(lines.select(F.col("place").alias("other"), F.col("line").alias("other_line")), "other")
        .where(_near(F.col("line"), F.col("other_line")))
        .select("place", "other")
    )


def _only(rows: DataFrame, wanted: DataFrame, by: str, besides: Column | None = None) -> DataFrame:
    """``rows`` without most of those whose ``by`` is not in ``wanted``, so that they aren't shuffled for a join; ``besides`` stay as well.

    The numbers' hashes of 26 bits are set in 2,048 bitmaps of 4 kB, a bound of 8 MB,
    which are sent to the rows. A join on the number itself must follow.
    """
    found = _flagged(rows, wanted, by)
    return found.where(F.col("flag") if besides is None else F.col("flag") | besides).select(*rows.columns)


def _flagged(rows: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """``rows`` with a ``flag``, which is false only where ``by`` is not in ``wanted``."""
    place = F.xxhash64(by).bitwiseAND((1 << 26) - 1)
    one = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(63).cast("int"))
    some = wanted.select(F.shiftright(place, 6).alias("i"), one(place).alias("b"))
    every = wanted.sparkSession.range(1 << 20).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("b"))
    longs = some.unionAll(every).groupBy("i").agg(F.bit_or("b").alias("b"))
    sorted_ = F.array_sort(F.collect_list(F.struct(F.col("i"), F.col("b"))))
    bits = longs.groupBy(F.shiftright("i", 9).alias("bucket")).agg(F.transform(sorted_, lambda x: x["b"]).alias("bits"))
    found = rows.withColumn("bucket", F.shiftright(place, 15)).join(F.broadcast(written(bits, "bitmaps")), "bucket")
    bit = F.get("bits", F.shiftright(place, 6).bitwiseAND(511).cast("int")).bitwiseAND(one(place))
    return found.select(*rows.columns, (bit != 0).alias("flag"))


def _marks(words: Column) -> list[Column]:
    """64 * MARKS bits, of which each different word's hash sets one."""
    hashes = F.transform(words, lambda w: F.pmod(w, F.lit(64 * MARKS)).cast("int"))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h % 64)
    part = lambda i: F.filter(hashes, lambda h: F.floor(h / 64) == i)
    return [F.aggregate(part(i), F.lit(0).cast("long"), lambda bits, h: bits.bitwiseOR(bit(h))) for i in range(MARKS)]


def _odd(h: Column) -> Column:
    return F.call_function("shiftrightunsigned", h, F.lit(2)).bitwiseOR(F.lit(1).cast("long"))


def _elements(line: Column) -> Column:
    """Hashes of the words, sorted by word; from the fifth one on, each occurrence of a word is an element of its own.

    So a word that stands there very often is not in one bucket, and an edit still adds and takes one element.
    """
    hashes = F.sort_array(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)))
    starts = lambda hs: F.array_compact(F.transform(hs, lambda h, i: F.when((i == 0) | (F.get(hs, i - 1) != h), i)))
    run = lambda h, upto: F.transform(F.sequence(F.lit(0), upto), lambda o: F.when(o > 3, F.xxhash64(h, o)).otherwise(F.coalesce(h, F.lit(0).cast("long"))))
    runs = lambda hs, at: F.flatten(F.transform(at, lambda i, r: run(F.get(hs, i), F.coalesce(F.get(at, r + 1), F.size(hs)) - i - 1)))
    # bound to variables, so that each is made once
    return F.transform(F.array(hashes), lambda hs: F.transform(F.array(starts(hs)), lambda at: runs(hs, at))[0])[0]


def _cut(merged: Column) -> Column:
    """The buckets of odd elements sorted among even bounds."""
    places = F.array_compact(F.transform(merged, lambda e, i: F.when(e.bitwiseAND(1) == 0, i)))
    cut = lambda ps: F.transform(F.sequence(F.lit(1), F.size(ps) - 1), lambda j: F.slice(merged, F.get(ps, j - 1) + 2, F.get(ps, j) - F.get(ps, j - 1) - 1))
    return F.transform(F.array(places), cut)[0]


def _long_keys(lines: DataFrame) -> DataFrame:
    """(row, k): bucket variants that long ``lines`` share; few of them should be equal.

    Lines of one length class have one number of buckets; one that can meet shorter
    lines of the class below has the variants of both. Empty buckets count. Very many
    lines have the same bucket of one word or none, so such a bucket makes a variant
    with each bucket of a second dealing, of which near lines share one as well.

    Where a line has enough different words for its buckets, each is dealt once, which
    is far less work; lines of few words deal their occurrences. The numbers of different words
    of near lines differ by their bound at most, so a line within that of the limit is
    dealt in both ways.
    """
    of = lambda m: F.greatest(F.lit(0), F.floor(F.log(m.cast("double") / LONG) / log(GROWTH)).cast("int"))
    n = F.col("n")
    different = F.array_distinct(F.transform(F.split("line", " "), lambda w: F.xxhash64(w)))
    sized = lines.select("row", "line", different.alias("hs"), F.array_distinct(F.array(of(n), of(n - _bound(n)))).alias("cs"))
    sized = sized.select("row", "line", "hs", F.size("hs").alias("words"), F.explode_outer("cs").alias("c"))
    # the longest line with variants of the class is a bound longer than the class; edits and so buckets of each class, up to the first of those with the most
    edits = [1]
    while edits[-1] < MOST:
        edits.append(min(MOST, int(GROWTH ** len(edits) * LONG * 1.06 / PER_EDIT)))
    edits = edits[1:]
    of_class = lambda values: F.get(F.array(*values), F.least("c", F.lit(len(edits) - 1)))
    few_words = lambda more: F.when(F.col("words") < of_class([F.lit(DIFFERENT * (2 * k + 1) + more * k) for k in edits]), 1).otherwise(0)
    sized = sized.select("row", "line", "hs", "c", F.explode_outer(F.sequence(few_words(0), few_words(1))).alias("way"))
    # bounds of equal ranges of hashes, with both ends; a cast to array<long> would let them be null, and sorting takes ten times as long where an element may be
    bounds = of_class([F.array(*(F.lit(min(j * ((1 << 64) // (2 * k + 1)) - (1 << 63), (1 << 63) - 1)).cast("long") for j in range(2 * k + 2))) for k in edits])
    sized = sized.select("row", "c", "way", F.when(F.col("way") == 0, F.col("hs")).otherwise(_elements(F.col("line"))).alias("es"), bounds.alias("bounds"))
    # the bounds are found again by plain searches, a row for each bucket: all compiled, as functions of each element aren't
    sized = sized.select("row", "c", "way", "es", "bounds", F.sort_array(F.concat("es", "bounds")).alias("merged"))
    # the generator names what is sorted, else that would be sorted for each bucket
    last = F.size("merged") - F.size("es") - 2
    dealt = sized.select("row", "c", "way", "es", "bounds", "merged", F.explode_outer(F.sequence(F.lit(0), last)).alias("j"))
    at = lambda j: F.array_position("merged", F.get("bounds", j)).cast("int")
    dealt = dealt.select("row", "c", "way", "es", "bounds", "merged", "j", at(F.col("j")).alias("p"), at(F.col("j") + 1).alias("q"))
    few = (F.col("q") - F.col("p") < 2) | (F.get("merged", F.col("p")) == F.get("merged", F.col("q") - 2))
    dealt = dealt.select("row", "c", "way", "es", "j", few.alias("few"), F.slice("merged", F.col("p") + 1, F.col("q") - F.col("p") - 1).alias("b"))
    # rows of enough words carry a hash only
    again_es, again_b = (F.when(F.col("few"), F.col(c)).alias(c) for c in ("es", "b"))
    dealt = dealt.select("row", "c", "way", "j", "few", again_es, again_b, F.when(~F.col("few"), F.xxhash64(F.lit(1), "c", "way", "j", "b")).alias("plain"))
    # odd elements among even bounds; bound to a variable, so that it is sorted once
    even = of_class([F.array(*(F.lit(2 * j * ((1 << 61) // (2 * k + 1))).cast("long") for j in range(2 * k + 2))) for k in edits])
    again = F.transform(F.array(F.sort_array(F.concat(F.transform("es", lambda e: _odd(F.xxhash64(e))), even))), _cut)[0]
    pairs = F.transform(again, lambda o, i: F.xxhash64(F.lit(2), "c", "way", "j", i, "b", o))
    keyed = dealt.select("row", F.explode_outer(F.when(F.col("few"), pairs).otherwise(F.array("plain"))).alias("k"))
    keys_ = written(keyed, "buckets")
    shared = written(keys_.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("k"), "shared")
    return _only(keys_, shared, "k").join(shared, "k")  # a semi-join would be pushed below the bitmaps


def _laid(of: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows (k, row, place, crowd) of variants with the ``marks`` of the lines; for all crowds that a line is in together one for each of its rare words."""
    none = F.lit(0).cast("long")
    rows = of.select("row", "place", "crowd", F.when(F.col("crowd"), none).otherwise(F.col("k")).alias("k")).distinct()
    w = F.when(F.col("crowd"), F.col("ws")).otherwise(F.array(none))
    return rows.join(marks, "row").select("k", F.explode_outer(w).alias("w"), "crowd", "row", "place", "n", "ks", "ws", *(f"m{i}" for i in range(MARKS)))


def _nearest_long(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """(place, other): for each line with ``keys`` (row, k) the earliest earlier line within the bound.

    The earliest line that shares a variant is tried first. Only where it is too far
    the others that share one are tried, joined on rare words.
    """
    n = F.col("n")
    of = lines.join(keys.select("row").distinct(), "row")
    spelt = written(of.select("row", "place", "n", F.when(n > PAIRS, _pairs(F.col("line"))).alias("g"), _spelt(F.col("line")).alias("l")), "spelt")
    keys = written(keys.join(spelt.select("row", "place"), "row"), "placed")
    least = keys.groupBy("k").agg(F.min(F.struct("place", "row")).alias("least"), F.count(F.lit(1)).alias("members"))
    keys = written(keys.join(least, "k").select("k", "row", "place", "least", (F.col("members") > CROWD).alias("crowd"), (F.col("members") > 2).alias("more")), "met")
    tried = keys.where("least.place < place").groupBy("row").agg(F.min("least").alias("least")).select("row", F.col("least.row").alias("other"))

    def judged(pairs: DataFrame) -> DataFrame:
        others = spelt.select(F.col("row").alias("other"), F.col("place").alias("other_place"), F.col("n").alias("m"), F.col("g").alias("og"), F.col("l").alias("ol"))
        found = pairs.join(spelt, "row").join(others, "other")
        most = _bound(F.greatest("n", "m"))
        # an edit takes away two pairs of neighbours at most
        lost = lambda x, y: F.coalesce(F.size(F.array_except(x, y)) > 2 * most, F.lit(False))
        replaced = F.size(F.filter(F.zip_with(F.split("l", ""), F.split("ol", ""), lambda p, q: p != q), lambda other: other))
        alike = (F.col("n") > PLACES) & (F.col("n") == F.col("m")) & (replaced <= most)  # only replaced words: within the bound for certain
        within = alike | (F.call_function("levenshtein", F.col("l"), F.col("ol"), most) >= 0)
        near = F.when(F.abs(F.col("n") - F.col("m")) > most, False).when(lost("g", "og"), False).when(lost("og", "g"), False).otherwise(within)
        return found.select("row", "place", "other", "other_place", near.alias("near"))

    first = written(judged(tried), "tried")
    far = first.where("not near").select("row", F.col("other").alias("tried"))
    # not the variants of two lines of which the earlier one has been tried, nor those of no earlier line
    open_ = keys.join(far, "row").where("least.place < place and (more or least.row != tried)").select("k", "row", "place", "crowd")
    open_ = written(open_, "open")
    met = written(keys.select("k", "row", "place", "crowd").join(open_.select("k").distinct(), "k", "left_semi"), "met")
    told = met.groupBy("row").agg(F.slice(F.array_sort(F.collect_list("k")), 1, TOLD).alias("ks"))
    hashes = F.array_distinct(F.transform(F.split("l", ""), lambda w: F.xxhash64(w)))
    held = written(spelt.select("row", "n", "l").join(told, "row").select("row", "n", "ks", hashes.alias("hs")), "held")
    # one word more than the bound of the longer line; a line of few different words keeps them all
    keep = _bound(n) + 2
    words = held.select("row", F.when(F.size("hs") <= 2 * keep, F.size("hs")).otherwise(keep).alias("keep"), F.explode_outer("hs").alias("w"))
    words = written(words, "words")
    seen = words.groupBy("w").agg(F.count(F.lit(1)).cast("int").alias("seen"))
    rank = F.row_number().over(Window.partitionBy("row").orderBy("seen", "w"))
    rare = words.join(seen, "w").withColumn("r", rank).where("r <= keep and seen > 1")  # a word of one line meets none
    rare = written(rare.groupBy("row").agg(F.array_sort(F.collect_list("w")).alias("ws")), "rare")
    marks = written(held.select("row", "n", "ks", *(m.alias(f"m{i}") for i, m in enumerate(_marks(F.col("hs"))))).join(rare, "row"), "marks")

    ours, others = _laid(open_, marks), _laid(met, marks).drop("crowd")
    names = {"row": "other", "place": "other_place", "n": "m", "ks": "oks", "ws": "ows"} | {f"m{i}": f"o{i}" for i in range(MARKS)}
    others = others.select("k", "w", *(F.col(c).alias(d) for c, d in names.items()))
    # an edit adds one word at most and so one mark
    most = _bound(F.greatest("n", "m"))
    added = lambda x, y: reduce(Column.__add__, (F.bit_count(F.col(f"{x}{i}").bitwiseAND(F.bitwise_not(f"{y}{i}"))) for i in range(MARKS)))
    like = (F.abs(F.col("n") - F.col("m")) <= most) & (added("m", "o") <= most) & (added("o", "m") <= most)

    # of the rare words that both have in a crowd, else of the variants, the least tells the pair; where no variant is among the first ones of both, any does
    variants, shared = F.array_intersect("ks", "oks"), F.array_intersect("ws", "ows")
    least_k = (F.size(variants) == 0) | (ours["k"] == F.array_min(variants))
    once = F.when(F.col("crowd"), ours["w"] == F.array_min(shared)).otherwise(least_k & (F.size(shared) > 0))
    meet = (ours["k"] == others["k"]) & (ours["w"] == others["w"]) & (F.col("other_place") < F.col("place"))
    pairs = ours.join(others, meet & like & once).select("row", "other").distinct()
    rest = judged(pairs).where("near").groupBy("place").agg(F.min("other_place").alias("other"))
    return first.where("near").select("place", F.col("other_place").alias("other")).unionAll(rest)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, max_edits: int = 1) -> DataFrame:
    """``docs`` with duplicate lines cut out of the text, plus n_lines and n_dropped.

    All columns and rows of ``docs`` are kept, but columns of the added names are
    replaced. Null and empty texts and rows with a null id stay as they are; a text
    all of whose lines are duplicates becomes empty. Rows that repeat an id and a
    text are cut alike.
    """
    docs = docs.drop("n_lines", "n_dropped")
    with scratch(docs.sparkSession):
        gone = duplicate_lines(docs, id_col, text_col, min_words, max_edits)
        gone = written(gone.groupBy("doc", "text_hash").agg(F.collect_set("line_no").alias("gone")), "gone")
    # an input row is one struct beside the helpers, so that none of its columns can clash with them
    held = docs.select(F.struct(*(docs[c].alias(c) for c in docs.columns)).alias("row"))
    fields = {c: F.col("row").getField(c) for c in docs.columns}
    # texts without such a line aren't shuffled for the join
    held = held.select("row", F.struct(fields[id_col].cast("long").alias("doc"), F.xxhash64(fields[text_col]).alias("text_hash")).alias("key"))
    held = _flagged(held, gone.select(F.struct("doc", "text_hash").alias("key")), "key")
    joined = held.where("flag").join(gone, (F.col("key.doc") == F.col("doc")) & (F.col("key.text_hash") == F.col("text_hash")), "left").select("row", "gone")
    joined = joined.unionAll(held.where(~F.col("flag")).select("row", F.lit(None).cast("array<int>").alias("gone")))
    lines = F.split(fields[text_col], "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    # bound to a variable, so that the text is split once
    cut = F.transform(F.array(lines), lambda ls: F.array_join(F.transform(left, lambda i: F.get(ls, i)), "\n"))[0]
    text = F.when(F.col("gone").isNull(), fields[text_col]).otherwise(cut)
    return joined.select(
        *((text if c == text_col else field).alias(c) for c, field in fields.items()),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
