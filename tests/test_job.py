"""The translation job against a plain recursion, with services that skip, cut, refuse and lose their order."""

import math
import random
import re
import sys
import tempfile
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.cloudpickle import register_pickle_by_value

from quirespark.operators import job
from quirespark.sources import chapters

SEG = re.compile(r'<seg id="(\d+)">(.*?)</seg>', re.S)


def service(prompt):
    """(segments by id, stop reason): words of the text say what goes wrong; a request that says so is in its last try."""
    last = not prompt.startswith("<seg")
    said, stop = {}, "end"
    segs = SEG.findall(prompt)
    for k, s in segs:
        if "CUT" in s and len(segs) > 2:
            stop = "max_tokens"
            break
        if "NO" in s.split():
            stop = "refusal"
            break
        if "SKIP" in s and not last or "NEVER" in s:
            continue
        turned = s.swapcase().replace("<B_1>", "<b_1>").replace("</B_1>", "</b_1>")
        if "TAG" in s and not last:
            turned = turned.replace("<b_1>", "").replace("</b_1>", "")
        said[int(k)] = "the same translation for all" if "SAME" in s and not last and len(segs) > 3 else turned
    return said, stop


register_pickle_by_value(sys.modules[__name__])


def translate(requests):
    def speak(batches):
        for batch in batches:
            said = [service(p) for p in batch.column("prompt").to_pylist()]
            replies = ["\n".join(f'<seg id="{k}">{s}</seg>' for k, s in found.items()) for found, _ in said]
            yield pa.RecordBatch.from_arrays([batch.column("request"), pa.array(replies, pa.string()), pa.array([stop for _, stop in said], pa.string())], ["request", "reply", "stop_reason"])

    return requests.mapInArrow(speak, "request string, reply string, stop_reason string")


def by_recursion(items):
    """items: (id, chapter, src) of one request that go out; {id: out or reason}."""
    results, failed, reasons = {}, {}, {}

    def attempt(its, strict, depth, refusals=0, realigned=False):
        told = "\n".join([*sorted({job.INSTRUCTIONS[reasons[k]] for k, _, _ in its if strict and reasons.get(k) in job.INSTRUCTIONS}), *(f'<seg id="{k}">{s}</seg>' for k, _, s in its)])
        said, stop = service(told)
        fold = lambda s: " ".join(re.sub(r"</?\w+_\d+/?>", "", s).lower().split())
        words = lambda s: re.sub(r"[^\w]+", " ", re.sub(r"</?\w+_\d+/?>", "", s).lower()).strip()
        groups = defaultdict(list)
        for k, _, s in its:
            if k in said and len(fold(said[k])) >= 20:
                groups[fold(said[k])].append((k, words(s)))
        groups = [g for g in groups.values() if len({w for _, w in g}) >= 2]
        same, cases = {k for g in groups for k, _ in g}, sum(len(g) - 1 for g in groups)

        def take(k, s):
            if not strict and k in same:
                reasons[k] = "misaligned"
            elif k not in said:
                reasons[k] = "missing"
            elif not said[k].strip():
                reasons[k] = "empty"
            elif "<b_1>" in s.lower() and "_1>" not in said[k] and not strict:
                reasons[k] = "tags"
            else:
                results[k] = said[k]
                return True
            return False

        if not strict and not realigned and cases >= 2 and cases * 10 >= len(its) and len(its) > 1:
            for k in same:
                reasons[k] = "misaligned"
            mid = math.ceil(len(its) / 2)
            attempt(its[:mid], False, depth + 1, refusals, True)
            attempt(its[mid:], False, depth + 1, refusals, True)
            return
        rest = [it for it in its if not take(it[0], it[2])]
        if not rest:
            return
        if stop == "max_tokens" and len(its) > 1 and depth < job.CUTS:
            if len(rest) < len(its) and len(rest) <= math.ceil(len(its) / 2):
                attempt(rest, strict, depth + 1, refusals, realigned)
                return
            mid = math.ceil(len(rest) / 2)
            attempt(rest[:mid], strict, depth + 1, refusals, realigned)
            attempt(rest[mid:], strict, depth + 1, refusals, realigned)
            return
        last = max((n for n, it in enumerate(its) if it[0] in said), default=-1)
        if stop == "refusal" and last < len(its) - 1 and len(rest) > 1 and refusals < job.REFUSALS:
            culprit = its[last + 1][1] if last >= 0 else None
            after = {it[0] for it in its[last + 1 :]}
            at = next((n for n, it in enumerate(rest) if culprit is not None and it[0] in after and it[1] != culprit), -1)
            mid = at if at > 0 else math.ceil(len(rest) / 2)
            attempt(rest[:mid], strict, depth + 1, refusals + 1, realigned)
            attempt(rest[mid:], strict, depth + 1, refusals + 1, realigned)
            return
        if strict:
            failed.update((k, reasons[k]) for k, _, _ in rest)
        else:
            attempt(rest, True, depth + 1, refusals, realigned)

    attempt(items, False, 0)
    return {k: (results.get(k), failed.get(k)) for k, _, _ in items}


@pytest.mark.parametrize("seed", [1, 2])
def test_job_equals_the_recursion(spark, seed):
    rng = random.Random(seed)
    kinds = ["a b {}", "plain {} text", "SKIP {}", "CUT {}", "NO {}", "NEVER {}", "SAME one {}", "<b_1>TAG</b_1> {}", "* * *", "copy"]
    weights = [rng.choice([1, 3]), 5, 1, rng.choice([0, 1]), rng.choice([0, 1]), 1, rng.choice([1, 4]), 1, 1, 1]
    rows = [(b, i // 5, i, rng.choices(kinds, weights)[0].format(f"{'xyz'[i % 3]}{i}")) for b in range(12) for i in range(rng.randrange(1, 30))]
    open_ = spark.createDataFrame(rows, "book long, chapter long, i long, src string")
    laid = job.requests_of(open_, chars=150, segments=9)
    found = laid.collect()
    groups = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.request, r.id)):
        groups[r.request].append(r)
    assert all(len(g) <= 9 and [r.id for r in g] == list(range(1, len(g) + 1)) for g in groups.values())
    want = {}
    for g in groups.values():
        sent = by_recursion([(r.id, r.chapter, r.src) for r in g if r.first == r.id])
        for r in g:
            want[r.book, r.i] = (r.src, None, None) if r.first == 0 else (*sent[r.first], "demo" if sent[r.first][0] is not None else None)
    folder = tempfile.mkdtemp(prefix="spark-")
    done = job.run(laid, translate, folder)
    got = {(r.book, r.i): (r.out, r.warn[0] if r.warn else None, r.by) for r in done.collect()}
    assert got == want
    assert {r.failed for r in done.collect()} == {True, False}
    # begun again with its folder, no service is asked any more
    assert {(r.book, r.i): r.out for r in job.run(laid, None, folder).collect()} == {k: v[0] for k, v in want.items()}


def test_job_saves_into_the_chapter_table(spark):
    rows = [(1, 0, i, 2, None, False, i == 1, None, None) for i in range(6)]
    book = chapters.ChapterTable(spark, tempfile.mkdtemp(prefix="spark-") + "/t", parts=2)
    book.create(spark.createDataFrame(rows, chapters.SEGMENTS))
    src = spark.createDataFrame([(1, 0, i, f"text {i}") for i in range(6)], "book long, chapter long, i long, src string")
    open_ = job.pending(book.segments().join(src, job.KEYS), start=0, end=4)
    results = job.run(job.requests_of(open_), job.demo, tempfile.mkdtemp(prefix="spark-"))
    delta = book.save(0, results).collect()
    assert [(r.words, r.segments, r.failed) for r in delta] == [(6, 3, 0)]
    assert {r.i: r.out for r in book.segments().collect()} == {0: "text 0", 1: None, 2: "text 2", 3: "text 3", 4: None, 5: None}


def test_verdicts_send_rows_out_again(spark):
    src = "The train left the old station and the tall man with the lamp was alone on the platform."
    laid = job.requests_of(spark.createDataFrame([(1, 0, 0, src), (1, 0, 1, "* * *")], "book long, chapter long, i long, src string"))
    done = {r.i: (r.out, r.failed, r.warn) for r in job.run(laid, job.demo, tempfile.mkdtemp(prefix="spark-"), job.judged).collect()}
    assert done == {0: (None, True, ["echo"]), 1: ("* * *", False, None)}
    none = job.requests_of(laid.select(*job.KEYS, "src").limit(0))
    assert job.run(none, job.demo, tempfile.mkdtemp(prefix="spark-")).count() == 0
