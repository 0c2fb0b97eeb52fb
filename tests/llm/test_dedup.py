"""Content sort, SimHash, line dedup and components against brute force, with odd rows."""

import random
from collections import defaultdict
from functools import partial

import pytest
import xxhash
from pyspark.sql import functions as F

from quirespark.llm import content_sort, graph, line_dedup, registry, simhash

DOCS = "doc_id long, text string, id long, hash string, content string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def make(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 7, "x", "y") for i, t in rows], DOCS)


def rows(seed=3, n=60):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 30))) for _ in range(n // 2)]
    out = [(i, rng.choice(texts)) for i in range(n)]
    return [*out, (100, None), (101, ""), (102, "x" * 100_000), (103, "x" * 100_000), (5, "alpha"), (5, "alpha"), (None, "alpha")]


@pytest.mark.parametrize("most", [4096, 2])
@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_content_sort(spark, keep, most, monkeypatch):
    """Groups of more rows than a piece holds are joined again."""
    monkeypatch.setattr(content_sort, "_runs", partial(content_sort._runs, most=most))
    data = rows()
    groups = defaultdict(list)
    for i, t in data:
        groups[t or ""].append(i)
    want = []
    for i, t in data:
        ids = [x for x in groups[t or ""] if x is not None]
        k = (min if keep == "smallest" else max)(ids) if ids else None
        want.append((i, k, len(groups[t or ""]), i == k))
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in content_sort.content_sort_dedup(make(spark, data), keep=keep).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_content_sort_over_many_ranges(spark, adaptive):
    """Texts with one beginning, whose groups straddle ranges: none is split."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    rng = random.Random(8)
    data = [(i, "the same beginning of every text, " + f"{rng.randrange(200):03d}" * rng.choice([1, 40])) for i in range(6000)]
    want = defaultdict(list)
    for i, t in data:
        want[t].append(i)
    try:
        for k, v in zip(was, (adaptive, "16", "false"), strict=True):
            spark.conf.set(k, v)
        found = content_sort.content_sort_dedup(make(spark, data).repartition(4)).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in found} == {i: (min(want[t]), len(want[t]), i == min(want[t])) for i, t in data}
    assert len(found) == len(data)


def test_empty_tables(spark):
    none = make(spark, [])
    assert content_sort.content_sort_dedup(none).count() == 0
    assert simhash.simhash_components(none).count() == 0
    assert line_dedup.duplicate_lines(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0


def plain_fingerprint(text):
    w = (text or "").lower().split()
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(keys, linked):
    group = {k: k for k in keys}

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in keys:
        for b in keys:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_simhash(spark):
    rng = random.Random(5)
    data = rows(n=40)
    base = [rng.choice(WORDS) for _ in range(200)]
    for i in range(200, 240):  # near copies
        base[rng.randrange(200)] = rng.choice(WORDS)
        data.append((i, " ".join(base)))
    fps = [plain_fingerprint(t) for _, t in data]
    comp = components(sorted(set(fps)), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (i, _), f in zip(data, fps):
        if i is not None:
            least[comp[f]] = min(least.get(comp[f], i), i)
    want = [(i, f"{f:016x}", least[comp[f]]) for (i, _), f in zip(data, fps)]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(make(spark, data)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_simhash_large_key(spark, monkeypatch):
    """Keys beyond the bound are keyed again and lose no link."""
    monkeypatch.setattr(simhash, "BOUND", 8)
    rng = random.Random(1)
    fps = sorted({sum(1 << rng.randrange(30) for _ in range(3)) for _ in range(150)})
    classes = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long")
    links = simhash.simhash_links(classes).collect()
    assert all((fps[r.a] ^ fps[r.b]).bit_count() <= 3 for r in links)
    want = components(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    pairs = {(min(r.a, r.b), max(r.a, r.b)) for r in links}
    assert components(range(len(fps)), lambda a, b: (a, b) in pairs) == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 260)] + [(None, 3), (4, None), (9, 9)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    kept = {(min(e), max(e)) for e in edges if None not in e and e[0] != e[1]}
    nodes = sorted({x for e in kept for x in e})
    assert got == components(nodes, lambda a, b: (a, b) in kept)
    assert graph.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def edit_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


@pytest.mark.parametrize("edits", [0, 1])
def test_line_dedup(spark, edits):
    rng = random.Random(8)
    data, lines = [], []
    for i in range(25):
        text = []
        for _ in range(rng.randint(0, 5)):
            line = [rng.choice(WORDS) for _ in range(rng.randint(1, 9))]
            if lines and rng.random() < 0.6:
                line = list(rng.choice(lines))
                at = rng.randrange(len(line))
                rng.choice([lambda: line.pop(at), lambda: line.insert(at, "new"), lambda: line.__setitem__(at, "other"), lambda: None])()
            lines.append(line or ["x"])
            text.append(rng.choice([" ", "  ", "\t"]).join(line))
        data.append((i, "\n".join(text)))
    data += [(50, None), (51, ""), (None, "alpha beta gamma delta epsilon")]
    order = sorted((i, n, x.split()) for i, t in data if i is not None for n, x in enumerate((t or "").split("\n")))
    order = [o for o in order if o[2]]
    want = {}
    for k, (i, n, w) in enumerate(order):
        for j, m, v in order[:k]:
            if edit_distance(w, v) <= (edits if min(len(w), len(v)) >= 5 else 0):
                want[i, n] = (j, m)
                break
    got = {(r.doc, r.line_no): (r.first_doc, r.first_line) for r in line_dedup.duplicate_lines(make(spark, data), max_edits=edits).collect()}
    assert got == want
    cut = {r.doc_id: r for r in line_dedup.dedup_lines(make(spark, data), max_edits=edits).collect()}
    assert len(cut) == len(data) and cut[50].text is None and cut[51].text == ""
    for i, t in data:
        if i is not None and t:
            assert cut[i].text == "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in want)


def test_line_dedup_shared_halves(spark):
    """Very many lines with one first half, of which few are near."""
    head = "licensed under the terms of the public"
    data = [(i, f"{head} licence number {i} of year {i * 7} only") for i in range(300)]
    data += [(1000, f"{head} licence number 17 of year 119 only"), (1001, f"{head} licence number 18 of year x only"), (1002, f"{head} licence of year 133 only")]
    got = {(r.doc, r.first_doc) for r in line_dedup.duplicate_lines(make(spark, data)).collect()}
    assert got == {(1000, 17), (1001, 18)}


def test_line_dedup_bound_grows(spark):
    """Long lines may differ by a word in 20, wherever the edits are; brute force over all pairs."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    lines = []
    for n in (37, 38, 39, 40, 41, 59, 60, 61, 80, 119, 120, 300):
        base = [rng.choice(vocabulary) for _ in range(n)]
        lines.append(base)
        for edits in range(1, n // 20 + 3):
            line, step = list(base), n / (edits + 1)
            for e in range(edits, 0, -1):  # spread evenly, which leaves the shortest common runs
                at = int(e * step)
                rng.choice([lambda: line.pop(at), lambda: line.insert(at, "new"), lambda: line.__setitem__(at, "other")])()
            lines.append(line)
    passage = [rng.choice(vocabulary) for _ in range(30)]
    lines += [[rng.choice(vocabulary) for _ in range(25)] + passage + [rng.choice(vocabulary) for _ in range(5)] for _ in range(20)]
    near = list(lines[-3])
    near[2], near[58] = "x", "y"
    lines.append(near)  # the lines before it with the passage are not near
    rng.shuffle(lines)
    want = {}
    for k, w in enumerate(lines):
        for j, v in enumerate(lines[:k]):
            most = max(len(w), len(v))
            if edit_distance(w, v) <= max(1, most // 20):
                want[k] = j
                break
    got = {r.doc: r.first_doc for r in line_dedup.duplicate_lines(make(spark, [(i, " ".join(w)) for i, w in enumerate(lines)])).collect()}
    assert got == want and len(want) > 30


def test_line_dedup_short_lines(spark):
    """Equal lines of every length are found, near ones only from 5 words on; letters of unspaced scripts are words."""
    texts = ["Share this", "Share  this\n\n", "Share that", "版权所有不得转载", "版权所有不得转載", "版权", "版权", "one two three four five", "one two three four six", ""]
    docs = make(spark, list(enumerate(texts)))
    got = {(r.doc, r.line_no, r.first_doc) for r in line_dedup.duplicate_lines(docs).collect()}
    assert got == {(1, 0, 0), (4, 0, 3), (6, 0, 5), (8, 0, 7)}
    cut = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert cut[1] == "\n" and cut[2] == "Share that" and cut[6] == ""
    query = registry.op9_line_dedup(spark, "/root/testdata/sf0.001")
    lines = line_dedup.split_lines(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    words = [(r.doc, r.line_no, tuple(r.line.split())) for r in lines.collect() if r.line.isascii()]
    first = {}
    for i, n, w in sorted(words):
        first.setdefault(w, (i, n))
    short = {(i, n) for i, n, w in words if 0 < len(w) < 5 and first[w] < (i, n)}
    assert short and short <= {(r[0], r[1]) for r in query.collect()}


def test_line_dedup_repeated_ids(spark):
    """Rows that repeat an id keep the lines that occur nowhere else."""
    data = [(1, "a b c d e"), (2, "a b c d e\nk l m n o"), (2, "unique line of row two\nsome further words stand alone here"), (2, "a b c d e\nk l m n o")]
    cut = sorted((r.doc_id, r.text, r.n_dropped) for r in line_dedup.dedup_lines(make(spark, data)).collect())
    assert cut == sorted([(1, "a b c d e", 0), (2, "k l m n o", 1), (2, "unique line of row two\nsome further words stand alone here", 0), (2, "k l m n o", 1)])


def test_line_dedup_very_long_lines(spark):
    """A line of very many words is linear work."""
    words = [f"w{i % 997}x{i % 1009}" for i in range(200_000)]
    other = list(words)
    for at in range(100, 200_000, 5000):
        other[at] = "changed"
    got = line_dedup.duplicate_lines(make(spark, [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(reversed(words)))])).collect()
    assert [(r.doc, r.first_doc) for r in got] == [(2, 1)]


def test_line_dedup_near_line_that_shares_other_variants_than_an_earlier_far_one(spark):
    bucket = lambda w: (xxhash.xxh64_intdigest(w, 42) + 2**63) % 2**64 - 2**63  # noqa: E731  signed, as Spark's
    lines = []
    for t in range(20):
        words = [f"t{t}w{i}" for i in range(60)]
        other = [*words[:30], f"t{t}x", *words[31:]]
        # of seven buckets it has the one that the new word is in
        far = [w if bucket(w) % 7 == bucket(f"t{t}x") % 7 else next(z for z in (f"t{t}z{i}n{k}" for k in range(99)) if bucket(z) % 7 != bucket(f"t{t}x") % 7) for i, w in enumerate(other)]
        lines += [far, words, other]
    got = {r.doc: r.first_doc for r in line_dedup.duplicate_lines(make(spark, [(i, " ".join(w)) for i, w in enumerate(lines)])).collect()}
    assert got == {3 * t + 2: 3 * t + 1 for t in range(20)}


def test_line_dedup_lines_of_few_words_share_no_variants(spark):
    texts = [" ".join(f"r{r}w{i}" for i in range(10) for _ in range(30)) for r in range(200)]
    near = [texts[0] + " more", texts[1].replace("r1w5 ", "", 3)]
    df = spark.createDataFrame([(i, t, len(t.split())) for i, t in enumerate(texts + near)], ["row", "line", "n"])
    shared = {r.row for r in line_dedup._long_keys(df).collect()}
    assert shared == {0, 1, 200, 201}


def test_line_dedup_one_relation_for_all_lengths(spark):
    """A line of more than 2,000 words a part of which has moved is as far as a shorter one."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(2400)]
    edited = list(words)
    for at in range(2300, 0, -100):
        rng.choice([lambda: edited.pop(at), lambda: edited.insert(at, "new"), lambda: edited.__setitem__(at, "other")])()
    moved = words[300:] + words[:300]
    got = line_dedup.duplicate_lines(make(spark, [(i, " ".join(w)) for i, w in enumerate([words, moved, edited, moved[1:]])])).collect()
    assert {(r.doc, r.first_doc) for r in got} == {(2, 0), (3, 1)}


def test_line_dedup_deals_words_in_compiled_columns(spark, monkeypatch):
    """Sorting takes ten times as long where an element may be null; functions of each element are for buckets of one word or none."""
    text = " ".join(f"w{i}" for i in range(60))
    few = " ".join(f"w{i % 3}" for i in range(60))
    lines = spark.createDataFrame([(1, text, 60), (2, text + " more", 61), (3, few, 60)], "row long, line string, n int")
    assert not lines.select(line_dedup._elements(F.col("line")).alias("es")).schema["es"].dataType.containsNull
    made, written = {}, line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, tag, options=None: made.setdefault(tag, df) and written(df, tag, options))
    shared = line_dedup._long_keys(lines).select("row", "k").distinct()
    steps = made["buckets"]._jdf.queryExecution().executedPlan().toString().splitlines()
    for compiled in ("AS merged", "array_position", "AS plain"):
        found = [step for step in steps if compiled in step]
        assert found and all("*(" in step.split("Project")[0] for step in found), compiled
    assert {r["row"] for r in shared.collect()} == {1, 2}
    assert made["buckets"].where("row = 1").select("k").distinct().count() >= 2 * 3 + 1


def test_line_dedup_lays_a_line_of_many_crowds_out_once(spark):
    """Rows don't grow with the crowds that a line is in, but for one for each rare word."""
    marks = spark.range(2).selectExpr("id row", "60 n", "array(7L) ks", "array(1L, 2L, 3L) ws", *(f"0L m{i}" for i in range(line_dedup.MARKS)))
    of = spark.range(10).selectExpr("id k", "id % 2 row", "id % 2 place", "id < 8 crowd")
    got = sorted((r.row, r.k, r.w) for r in line_dedup._laid(of, marks).collect())
    assert got == sorted([(i, 0, w) for i in (0, 1) for w in (1, 2, 3)] + [(0, 8, 0), (1, 9, 0)])


def test_line_dedup_crowds_against_all_pairs(spark, monkeypatch):
    """Lines under crowded variants, most of them far from the earliest one."""
    monkeypatch.setattr(line_dedup, "CROWD", 3)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    lines = []
    for _ in range(40):
        line = list(rng.choice(lines)) if lines and rng.random() < 0.5 else list(base)
        for at in rng.sample(range(60), rng.choice([1, 3, 5])):
            line[at] = f"x{rng.randrange(25)}"
        lines.append(line)
    lines += [["a", "b", "c"] * 20, ["a", "b", "c"] * 20 + ["d", "e"], [f"v{i % 22}" for i in range(60)], [f"v{i % 22}" for i in range(59)] + ["new"]]  # few different words, and at the limit
    want = {}
    for k, w in enumerate(lines):
        first = next((j for j, v in enumerate(lines[:k]) if edit_distance(w, v) <= max(len(w), len(v)) // 20), None)
        if first is not None:
            want[k] = first
    got = {r.doc: r.first_doc for r in line_dedup.duplicate_lines(make(spark, [(i, " ".join(w)) for i, w in enumerate(lines)])).collect()}
    assert got == want and len(want) > 10 and {41, 43} <= set(want)


def test_line_dedup_does_not_shuffle_texts_without_duplicates(spark, monkeypatch):
    """The cut alone, with the duplicate lines given: bitmaps of some MB are moved, texts of 48 MB are not."""
    gone = spark.createDataFrame([(101, "a line of two texts\ny")], "doc long, text string").select("doc", F.xxhash64("text").alias("text_hash"), F.lit(0).alias("line_no"))
    monkeypatch.setattr(line_dedup, "duplicate_lines", lambda *a: gone)
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(150_000)), lambda i: F.lpad(F.hex(F.xxhash64("id", i)), 16, "0")), "")
    docs = spark.range(20).select(F.col("id").alias("doc_id"), text.alias("text"))
    docs = docs.unionAll(spark.createDataFrame([(100, "a line of two texts\nx"), (101, "a line of two texts\ny")], "doc_id long, text string"))
    executors = lambda: spark._jsc.sc().statusStore().executorList(False)
    shuffled = lambda: sum(x.apply(i).totalShuffleWrite() for x in [executors()] for i in range(x.size()))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        before = shuffled()
        cut = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.substring("text", 1, 50).alias("text")).collect()}
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        moved = shuffled() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert len(cut) == 22 and cut[100] == ("a line of two texts\nx", 2, 0) and cut[101] == ("y", 2, 1)
    assert all(len(cut[i][0]) == 50 and cut[i][1:] == (1, 0) for i in range(20))
    assert 0 < moved < 24_000_000


def test_near_duplicates(spark):
    """Groups of texts with a five-word shingle similarity of 0.8 or more, against all pairs."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for n in (5, 9, 14, 30, 60, 120, 300, 800):
        for _ in range(3):
            base = [rng.choice(vocabulary) for _ in range(n)]
            if rng.random() < 0.5:
                base[n // 2 : n // 2] = passage
            texts.append(base)
            for _ in range(4):
                other = list(base)
                for _ in range(rng.randint(0, max(1, len(base) // 30))):
                    at = rng.randrange(len(other))
                    rng.choice([lambda: other.pop(at), lambda: other.insert(at, "new"), lambda: other.__setitem__(at, "other")])()
                texts.append(other)
    texts += [texts[10], texts[20], [], [], ["a"], ["A"]]
    rng.shuffle(texts)
    data = [*enumerate(" ".join(t) for t in texts), (5000, None), (None, "alone in the world"), (5000, " ".join(texts[3])), (None, " ".join(texts[4]))]

    def shingles(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in data]
    like = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    comp = components(range(len(data)), lambda a, b: like(sets[a], sets[b]))
    group = defaultdict(list)
    for k, (i, _) in enumerate(data):
        group[comp[k]].append((i is None, i))
    want = sorted(str((i, min(group[comp[k]])[1])) for k, (i, _) in enumerate(data))
    found = simhash.near_duplicates(make(spark, data)).collect()
    assert sorted(str((r.doc_id, r.group_id)) for r in found) == want
    assert sum(r.kept for r in found) == len(group)
    assert simhash.near_duplicates(make(spark, [])).count() == 0


def test_near_duplicates_by_fingerprints(spark, monkeypatch):
    """Texts within three bits are found by their fingerprints, without any block of shingles."""
    sketches = simhash._sketches
    monkeypatch.setattr(simhash, "_sketches", lambda *a: sketches(*a).withColumn("keys", F.array().cast("array<long>")))
    rng = random.Random(5)
    words = [f"w{rng.randrange(2000)}" for _ in range(3000)]
    data = [(3, " ".join(words)), (4, " ".join([*words[:-1], "other"])), (5, " ".join(reversed(words)))]
    found = simhash.near_duplicates(make(spark, data)).collect()
    assert {(r.doc_id, r.group_id) for r in found} == {(3, 3), (4, 3), (5, 5)}


def test_line_dedup_keeps_columns_named_like_its_helpers(spark):
    rows = [(1, "one line that is long enough\nx"), (2, "one line that is long enough\ny"), (None, "one line that is long enough")]
    df = spark.createDataFrame([(i, t, *"abcdef") for i, t in rows], "doc_id long, text string, _gone string, _doc string, _hash string, gone string, doc string, text_hash string")
    found = line_dedup.dedup_lines(df).collect()
    assert {r.doc_id: r.text for r in found} == {1: rows[0][1], 2: "y", None: rows[2][1]}
    assert all((r._gone, r._doc, r._hash, r.gone, r.doc, r.text_hash) == tuple("abcdef") for r in found)


def test_work_tables_go_but_for_the_last(spark):
    from quirespark.llm import common

    def there(df):
        path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0])
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    outside = common.written(spark.range(3), "t")
    with common.scratch(spark):
        a = common.written(spark.range(3), "t")
        with common.scratch(spark):
            b = common.written(spark.range(3), "t")
            c = common.written(b, "t")
        assert not there(b) and there(c) and there(a)
        d = common.written(c.unionAll(a), "t")
    assert there(outside) and not there(a) and not there(c) and d.count() == 6
