"""Event-line readers (S28, S29): files of ``data:`` lines as a batch or streaming source, and the replies that their increments make.

A file holds the events of one stream and grows while its service speaks. An
offset is, for each file, the byte after its last whole line, so a half line waits
until the rest of it has come, and a restarted query reads on where its checkpoint ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes read at once, and bytes of a file that one task reads.
CHUNK, SPLIT = 1 << 20, 32 << 20
SCHEMA = "stream string, at long, data string"


@dataclass
class Span(InputPartition):
    """Lines of a file that begin in [start, end); ``first`` is where a line is known to begin, ``open_end`` whether the file's end ends a line."""

    path: str
    first: int
    start: int
    end: int
    open_end: bool


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> tuple[fs.FileSystem, str, dict[str, int]]:
    """The file system, the folder, and the size of each file in it by name; names that begin with a dot or underscore are left out."""
    system, root = _open(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    shown = lambda f: not any(p.startswith((".", "_")) for p in f.path[len(root) :].strip("/").split("/"))
    return system, root, {f.path[len(root) :].strip("/"): f.size for f in found if f.is_file and shown(f)}


def last_line_end(system: fs.FileSystem, path: str, since: int, size: int) -> int:
    """The byte after the last line end in [since, size), ``since`` if there is none; looked for from the end."""
    with system.open_input_file(path) as f:
        end = size
        while end > since:
            at = max(since, end - CHUNK)
            f.seek(at)
            found = f.read(end - at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            end = at
    return since


def _spans(ranges: dict[str, tuple[int, int]], open_end: bool) -> list[Span]:
    return [Span(name, first, at, min(at + SPLIT, end), open_end) for name, (first, end) in sorted(ranges.items()) for at in range(first, end, SPLIT)]


def read_span(path: str, span: Span) -> Iterator[pa.RecordBatch]:
    """Events of the lines that begin in the span; a line may end behind it."""
    system, root = _open(path)
    names, ats, datas = [], [], []

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ats, pa.int64()), pa.array(datas, pa.string())], ["stream", "at", "data"])
        names.clear(), ats.clear(), datas.clear()
        return made

    def take(line: bytes, at: int) -> None:
        text = line.decode("utf-8", "replace").strip()
        if text.startswith("data:"):
            names.append(span.path), ats.append(at), datas.append(text[5:].strip())

    with system.open_input_file(f"{root}/{span.path}") as f:
        # the line that a span's first byte is in belongs to the span before, unless it begins there
        at = max(span.first, span.start - 1)
        skip = span.start > span.first
        f.seek(at)
        held = b""
        while True:
            data = f.read(CHUNK)
            lines = (held + data).split(b"\n")
            held = lines.pop()
            for line in lines:
                if not skip and at >= span.end:
                    break
                if not skip:
                    take(line, at)
                skip, at = False, at + len(line) + 1
            if len(datas) >= 10_000:
                yield batch()
            if at >= span.end or not data:
                break
        if span.open_end and held and not skip and at < span.end:
            take(held, at)
    if datas:
        yield batch()


class _Batch(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Span]:
        return _spans({name: (0, size) for name, size in _files(self.path)[2].items()}, True)

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # as it is where there are no files
            yield from read_span(self.path, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path
        self.ends: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, root, sizes = _files(self.path)
        self.ends = {name: last_line_end(system, f"{root}/{name}", min(self.ends.get(name, 0), size), size) for name, size in sizes.items()}
        return dict(self.ends)

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return _spans({name: (start.get(name, 0), upto) for name, upto in end.items() if upto > start.get(name, 0)}, False)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        yield from read_span(self.path, partition)


class EventLines(DataSource):
    """``format("event_lines")``: (stream, at, data) of each ``data:`` line below ``path``; ``at`` is its byte in the file named ``stream``.

    A batch read takes a file's end for the end of its last line; a streaming
    read waits for the line's own. Lines of any length and files of any size are
    read in pieces; large files are split over tasks. Bytes that are no UTF-8 become
    U+FFFD. An offset names every file below ``path``: move away those whose streams have long ended.
    """

    @classmethod
    def name(cls) -> str:
        return "event_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"])


def lines_of(bodies: DataFrame, stream: str, body: str) -> DataFrame:
    """The same events of whole bodies in a column, in plain columns."""
    lines = bodies.select(F.col(stream).cast("string").alias("stream"), F.posexplode(F.split(body, "\n", -1)).alias("at", "line"))
    return lines.where(F.trim("line").startswith("data:")).select("stream", F.col("at").cast("long").alias("at"), F.trim(F.substring(F.trim("line"), 6, 2**31 - 1)).alias("data"))


#: The two layouts of an event.
_USAGE = "usage:struct<prompt_tokens:long,completion_tokens:long>"
EVENT = (
    "candidates array<struct<content:struct<parts:array<struct<text:string,thought:boolean>>>,finishReason:string>>, promptFeedback struct<blockReason:string>,"
    "usageMetadata struct<promptTokenCount:long,candidatesTokenCount:long,thoughtsTokenCount:long>,"
    f"choices array<struct<delta:struct<content:string>,finish_reason:string>>, {_USAGE.replace('usage:', 'usage ', 1)}, x_groq struct<{_USAGE}>, error struct<message:string>"
)
#: Ends that mean a refusal.
REFUSED = "(?i)SAFETY|PROHIBITED|BLOCKLIST|RECITATION|SPII"


def _said(e: Column) -> Column:
    parts = F.filter(F.coalesce(F.get(e["candidates"], F.lit(0))["content"]["parts"], F.array()), lambda p: ~F.coalesce(p["thought"], F.lit(False)))
    return F.coalesce(F.get(e["choices"], F.lit(0))["delta"]["content"], F.nullif(F.array_join(F.transform(parts, lambda p: p["text"]), ""), F.lit("")))


def increments(events: DataFrame) -> DataFrame:
    """(stream, at, chat, said, finish, blocked, input, output, error) of each event; data that is no JSON says nothing."""
    e = F.from_json("data", EVENT)
    parsed = events.select("stream", "at", e.alias("e"))
    e = F.col("e")
    use, gem = F.coalesce(e["usage"], e["x_groq"]["usage"]), e["usageMetadata"]
    count = lambda *xs: F.when(use.isNotNull() | gem.isNotNull(), sum((F.coalesce(x, F.lit(0)) for x in xs[1:]), F.coalesce(xs[0], F.lit(0))))
    return parsed.select(
        "stream",
        "at",
        e["choices"].isNotNull().alias("chat"),
        _said(e).alias("said"),
        F.nullif(F.coalesce(F.get(e["choices"], F.lit(0))["finish_reason"], F.get(e["candidates"], F.lit(0))["finishReason"]), F.lit("")).alias("finish"),
        e["promptFeedback"]["blockReason"].alias("blocked"),
        count(F.coalesce(use["prompt_tokens"], gem["promptTokenCount"])).alias("input"),
        count(F.coalesce(use["completion_tokens"], gem["candidatesTokenCount"]), gem["thoughtsTokenCount"]).alias("output"),
        e["error"]["message"].alias("error"),
    )


def replies(events: DataFrame) -> DataFrame:
    """(stream, text, stop_reason, input_tokens, output_tokens, error): each stream's increments put together in order.

    The last stated finish and usage count, the first error. Reasoning between think
    tags of a chat goes. Also over a stream, in update or complete mode; a stream's
    increments are held until it is read, so a reply has to fit a row.
    """
    i = increments(events)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("at", "said")))), lambda x: x["said"]), "")
    one = i.groupBy("stream").agg(
        F.max("chat").alias("chat"),
        said.alias("said"),
        last("finish").alias("finish"),
        F.max("blocked").alias("blocked"),
        last("input").alias("input"),
        last("output").alias("output"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("at"))).alias("error"),
    )
    chat, finish = F.col("chat"), F.coalesce("finish", F.lit(""))
    reason = (
        F.when(chat, F.when(finish == "length", "max_tokens").when(finish == "content_filter", "refusal").when(finish.isin("stop", ""), "end").otherwise("other"))
        .when(F.col("blocked").isNotNull() | finish.rlike(REFUSED), "refusal")
        .when(finish == "MAX_TOKENS", "max_tokens")
        .otherwise("end")
    )
    text = F.when(chat, F.regexp_replace("said", r"(?s)<think>.*?</think>", "")).otherwise(F.col("said"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return one.select("stream", text.alias("text"), reason.alias("stop_reason"), zero("input").alias("input_tokens"), zero("output").alias("output_tokens"), "error")
