"""Order-dependent folds: each key's rows in order through a small state.

Rows are dealt out by key, sorted within partitions and streamed, so a fold
holds one state however long a key's rows are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: Callable[[], Any], step: Callable, out: dict[str, str]) -> DataFrame:
    """``keys`` and ``order`` columns with the fold's outputs for each row.

    ``step(state, row values)`` returns the new state and a tuple of outputs;
    ``out`` maps their names to types.
    """
    cols = list(dict.fromkeys([*keys, *order, *inputs]))
    kept = list(dict.fromkeys([*keys, *order]))
    schema = df.select(*kept).schema
    for name, kind in out.items():
        schema = schema.add(name, kind)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, first = None, None, True
        for batch in batches:
            data = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            made = []
            for k, values in zip(zip(*(data[c] for c in keys), strict=True), zip(*(data[c] for c in inputs), strict=True), strict=True):
                if first or k != key:
                    key, state, first = k, start(), False
                state, result = step(state, *values)
                made.append(result)
            columns = [batch.column(c).cast(arrow.field(c).type) for c in kept]
            columns += [pa.array([m[i] for m in made], arrow.field(n).type) for i, n in enumerate(out)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.select(*cols).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def ordered_merge(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: Callable[[], Any], step: Callable, end: Callable, out: dict[str, str]) -> DataFrame:
    """``keys`` with the rows that a fold gives, which may be fewer than it reads.

    ``step(state, row values)`` returns the new state and a list of output tuples;
    ``end(state)`` the outputs left when a key's rows are over. One state is held at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([*df.select(*keys).schema.fields, *StructType.fromDDL(", ".join(f"{n} {kind}" for n, kind in out.items())).fields])
    arrow = to_arrow_schema(schema)
    cols = list(dict.fromkeys([*keys, *order, *inputs]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, first = None, None, True
        made: list[tuple] = []

        def given():
            columns = list(zip(*made, strict=True)) or [()] * len(arrow.names)
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            data = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            for k, values in zip(zip(*(data[c] for c in keys), strict=True), zip(*(data[c] for c in inputs), strict=True), strict=True):
                if first or k != key:
                    if not first:
                        made += [(*key, *o) for o in end(state)]
                    key, state, first = k, start(), False
                state, results = step(state, *values)
                made += [(*k, *o) for o in results]
            if made:
                yield given()
        if not first:
            made += [(*key, *o) for o in end(state)]
            yield given()

    return df.select(*cols).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def appended(runs: list[list] | None, line: list[list]) -> list[list]:
    """A paragraph's runs [text, italic, bold] with one more line: a hyphen at a line's end goes where a small letter follows, runs of one style are one."""
    line = [list(r) for r in line]
    line[0][0] = line[0][0].lstrip()
    if not runs:
        return line
    last = runs[-1][0].rstrip()
    split = len(last) > 1 and last[-1] == "-" and last[-2].isalpha() and line[0][0][:1].islower()
    runs = [*runs[:-1], [last[:-1] if split else last + " ", *runs[-1][1:]]]
    for run in line:
        if runs[-1][1:] == run[1:]:
            runs[-1] = [runs[-1][0] + run[0], *run[1:]]
        else:
            runs.append(run)
    return runs


def merged_lines(df: DataFrame, key: str, order: str, runs: str, begins: str) -> DataFrame:
    """(key, para, runs): paragraphs of the lines of each key; ``runs`` is an array of (text, italic, bold), a line for which ``begins`` holds begins a paragraph.

    Lines without runs are left out.
    """

    def step(state, line, new):
        para, held = state
        if not line:
            return state, []
        line = [[r["text"] or "", bool(r["italic"]), bool(r["bold"])] for r in line]
        if held and new:
            return (para + 1, appended(None, line)), done(state)
        return (para, appended(held, line)), []

    def done(state):
        return [(state[0], [{"text": t, "italic": i, "bold": b} for t, i, b in state[1]])] if state[1] else []

    return ordered_merge(df, [key], [order], [runs, begins], lambda: (0, None), step, done, {"para": "long", "runs": "array<struct<text:string,italic:boolean,bold:boolean>>"})


def greedy_batches(df: DataFrame, key: str, order: str, size: str, most_size: int, most_rows: int = 120) -> DataFrame:
    """(key, order, batch): rows fill a batch until size or count would pass the limit; a larger row is a batch of its own."""

    def step(state, n):
        batch, held, rows = state
        if rows and (held + n > most_size or rows >= most_rows):
            batch, held, rows = batch + 1, 0, 0
        return (batch, held + n, rows + 1), (batch,)

    return ordered_fold(df, [key], [order], [size], lambda: (0, 0, 0), step, {"batch": "long"})


def chapter_groups(df: DataFrame, key: str, order: str, chars: str, segments: str, most_chars: int, most_segments: int, most: int = 40) -> DataFrame:
    """(key, order, group): consecutive small chapters that fit one request together."""

    def step(state, c, s):
        group, held_c, held_s, n = state
        if n and (held_c + c > most_chars or held_s + s > most_segments or n >= most):
            group, held_c, held_s, n = group + 1, 0, 0, 0
        return (group, held_c + c, held_s + s, n + 1), (group,)

    return ordered_fold(df, [key], [order], [chars, segments], lambda: (0, 0, 0, 0), step, {"group": "long"})


#: Bindings and their colour families.
BINDINGS = [
    ("azul-tinta", "azul"), ("verde-garrafa", "verde"), ("vinho", "vermelho"), ("linho", "claro"), ("grafite", "neutro"),
    ("ardósia", "azul"), ("couro", "terra"), ("terracota", "vermelho"), ("sálvia", "verde"),
]


def assign_bindings(df: DataFrame, key: str, order: list[str], hash_col: str, covered: str) -> DataFrame:
    """A binding for each book, never of the family of the last two uncovered books of its shelf."""

    def step(recent, h, has_cover):
        n = len(BINDINGS)
        at, stride = h % n, 1 + (h >> 8) % (n - 1)
        for _ in range(n):
            if BINDINGS[at][1] not in recent:
                break
            at = (at + stride) % n
        name, family = BINDINGS[at]
        return (recent if has_cover else (family, *recent[:1])), (name, family)

    return ordered_fold(df, [key], order, [hash_col, covered], tuple, step, {"binding": "string", "family": "string"})


def wallet(df: DataFrame, key: str, order: list[str], action: str, amount: str) -> DataFrame:
    """(key, order, balance, free, moved): credits of each wallet after each event.

    Actions are grant, reserve (what is free up to the amount; nothing while a
    reservation is open), capture (up to what is left of the reservation) and
    release (closes it; ``moved`` is what had been captured). Others change nothing.
    """

    def step(state, what, n):
        balance, held, taken = state
        n, moved = max(n or 0, 0), 0
        if what == "grant":
            balance, moved = balance + n, n
        elif what == "reserve" and not held:
            held = moved = min(balance, n)
        elif what == "capture":
            moved = min(n, held - taken)
            taken, balance = taken + moved, balance - moved
        elif what == "release":
            moved, held, taken = taken, 0, 0
        return (balance, held, taken), (balance, balance - (held - taken), moved)

    return ordered_fold(df, [key], order, [action, amount], lambda: (0, 0, 0), step, {"balance": "long", "free": "long", "moved": "long"})


def wallet_lots(df: DataFrame, key: str, order: list[str], period: str, action: str, amount: str, welcome: tuple[int, int], regular: tuple[int, int], keep: int) -> DataFrame:
    """(key, order, balance, free, moved, expired, granted): wallets whose credits lie in lots that expire, after each event.

    At every event lots whose last period is over go first; then a wallet's first
    event brings the welcome lot and each new period the regular one (both as
    (credits, periods that they last beyond this)). Actions are those of :func:`wallet`; what is
    captured comes from the lots that expire first; ``restart`` closes a reservation that is still open, as its run is gone.
    """

    def step(state, now, what, n):
        lots, held, taken, last = state
        expired, lots = sum(m for e, m in lots.items() if e < now), {e: m for e, m in lots.items() if e >= now}
        granted = 0
        for credits, lasts in ([welcome] if last is None else []) + ([regular] if last != now else []):
            lots[now + lasts] = lots.get(now + lasts, 0) + credits
            granted += credits
        n, moved = max(n or 0, 0), 0
        if what == "grant":
            lots[now + keep] = lots.get(now + keep, 0) + n
            moved = n
        elif what == "reserve" and not held:
            held = moved = min(sum(lots.values()), n)
        elif what == "capture":
            moved = left = min(n, held - taken)
            taken += moved
            for e in sorted(lots):
                lots[e], left = max(lots[e] - left, 0), max(left - lots[e], 0)
        elif what in ("release", "restart"):
            moved, held, taken = taken, 0, 0
        balance = sum(lots.values())
        return (lots, held, taken, now), (balance, max(0, balance - (held - taken)), moved, expired, granted)

    out = dict.fromkeys(("balance", "free", "moved", "expired", "granted"), "long")
    return ordered_fold(df, [key], order, [period, action, amount], lambda: ({}, 0, 0, None), step, out)


def word_cuts(df: DataFrame, key: str, order: str, words: str, least: int = 3500) -> DataFrame:
    """(key, order, part): a new part begins after a row at which the part has ``least`` words or more."""

    def step(state, w):
        part, held = state
        held += w
        return ((part + 1, 0) if held >= least else (part, held)), (part,)

    return ordered_fold(df, [key], [order], [words], lambda: (0, 0), step, {"part": "long"})


def page_lines(df: DataFrame, key: str, order: list[str], y: str, size: str) -> DataFrame:
    """(key, order, line): items of a page from top to bottom; a line ends where y leaves its first item's by max(2, 0.45 size)."""

    def step(state, at, height):
        line, first = state
        if first is None or abs(at - first) > max(2.0, 0.45 * height):
            line, first = line + 1, at
        return (line, first), (line,)

    return ordered_fold(df, [key], order, [y, size], lambda: (-1, None), step, {"line": "long"})


def settled(df: DataFrame) -> DataFrame:
    """Result columns as longs and strings, for comparison with another engine."""
    return df.select(*(F.col(c).cast("long") if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))
