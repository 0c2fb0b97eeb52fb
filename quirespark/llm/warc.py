"""WARC archives as a chunked record table.

Payloads move as rows (record, chunk number, bytes), so neither the writer nor
the reader ever holds a whole record: the writer streams sorted chunk rows into
gzip members, the reader streams the archive and returns chunk rows that carry
the SHA-1 of the payload so far. Duplicate payloads become revisit records.
Archives are written under a temporary name and then moved, so that a repeated
task leaves one complete file.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import small_batches, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "record_id long, chunk_no int, record_type string, refers_to long, data binary, upto long, sha1_upto string, payload_bytes long, payload_digest string, last boolean"


def numbered(pages: DataFrame) -> DataFrame:
    """``pages`` with a row number, so that rows that repeat an id stay apart.

    It is the same in each pass over files; write a table that isn't read from files first.
    """
    return pages.withColumn("row", F.monotonically_increasing_id())


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000) -> DataFrame:
    """(row, record_id, url, bytes, sha1, record_type, refers_to, refers_row) of each row of ``numbered`` pages.

    Of records with equal payloads of at least ``least_bytes`` the one with the
    largest id is the response and the others revisit it. Equal means equal
    SHA-256, SHA-1 and length. Null payloads and urls are empty; a null id comes
    before all others; rows that repeat the kept id and its payload are all
    responses. Row numbers make the archives' record ids unique.
    """
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    meta = pages.select(
        "row",
        F.col(id_col).cast("long").alias("record_id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.octet_length(body).cast("long").alias("bytes"),
        F.sha1(body).alias("sha1"),
        F.sha2(body, 256).alias("sha2"),
    )
    keep = meta.where(F.col("bytes") >= least_bytes).groupBy("sha2", "sha1", "bytes").agg(F.max(F.struct("record_id", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
    found = meta.join(keep.where("n > 1").drop("n"), ["sha2", "sha1", "bytes"], "left")
    revisit = F.col("keep").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("keep.record_id"))
    return found.select(
        "row",
        "record_id",
        "url",
        "bytes",
        "sha1",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("keep.record_id")).alias("refers_to"),
        F.when(revisit, F.col("keep.row")).alias("refers_row"),
    )


def chunked(pages: DataFrame, payload_col: str = "html", chunk_bytes: int = 1 << 20) -> DataFrame:
    """(row, chunk_no, data): each payload's UTF-8 bytes cut into rows; an empty payload is one empty row."""
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    last = F.greatest(F.ceil(F.octet_length(body) / F.lit(chunk_bytes)).cast("int") - 1, F.lit(0))
    return pages.select("row", body.alias("body"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_no")).select(
        "row", "chunk_no", F.substring("body", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("data")
    )


def _b32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _urn(record_id, row) -> str:
    return f"<urn:page:{'' if record_id is None else record_id}:{row}>"


def _head(record_id, row, url, size, sha1, kind, refers_to, refers_row) -> bytes:
    """WARC header and HTTP header of a record, up to where its payload begins."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _urn(record_id, row)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join(c for c in url if c >= " ")),
        ("WARC-Payload-Digest", f"sha1:{_b32(sha1)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if kind == "revisit":
        fields += [("WARC-Refers-To", _urn(refers_to, refers_row)), ("WARC-Profile", PROFILE)]
    fields.append(("Content-Length", str(len(http) + (size if kind == "response" else 0))))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode("utf-8", "surrogatepass") + http


def _place(folder: str, name: str):
    system, path = fs.FileSystem.from_uri(folder)
    return system, f"{path.rstrip('/')}/{name}"


def write_archives(records: DataFrame, chunks: DataFrame, folder: str) -> DataFrame:
    """Writes one archive for each partition of ``records`` and returns (file, n_records, archive_bytes).

    A record's chunks arrive in order beside its header fields; revisits carry
    no payload, so their chunks are dropped before the shuffle ends.
    """
    spark = records.sparkSession
    small_batches(spark)
    ordered = (
        records.join(chunks, "row")
        .withColumn("data", F.when(F.col("record_type") == "response", F.col("data")))
        .where((F.col("record_type") == "response") | (F.col("chunk_no") == 0))
        .sortWithinPartitions("row", "chunk_no")
        .select("record_id", "row", "chunk_no", "url", "bytes", "sha1", "record_type", "refers_to", "refers_row", "data")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.warc.gz"
        system, final = _place(folder, name)
        _, temp = _place(folder, f".{name}.{task.taskAttemptId()}")
        out, gz, n, size = None, None, 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    system.create_dir(final.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(temp, compression=None)
                if r["chunk_no"] == 0:
                    if gz:
                        size += out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                    gz = zlib.compressobj(4, zlib.DEFLATED, 31)
                    n += 1
                    size += out.write(gz.compress(_head(*(r[c] for c in ("record_id", "row", "url", "bytes", "sha1", "record_type", "refers_to", "refers_row")))))
                if r["data"]:
                    size += out.write(gz.compress(r["data"]))
        if out is not None:
            size += out.write(gz.compress(b"\r\n\r\n") + gz.flush())
            out.close()
            if system.get_file_info(final).type != fs.FileType.NotFound:  # of an attempt that had ended
                system.delete_file(final)
            system.move(temp, final)
            yield pa.RecordBatch.from_pylist(
                [{"file": name, "n_records": n, "archive_bytes": size}],
                pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("archive_bytes", pa.int64())]),
            )

    return written(ordered.mapInArrow(run, "file string, n_records long, archive_bytes long"), "manifest")


class _Stream:
    """Inflated bytes of concatenated gzip members, a piece at a time."""

    def __init__(self, raw, piece: int = 1 << 18):
        self.raw, self.piece, self.gz, self.buffer, self.tail = raw, piece, zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        while True:
            data = self.gz.unconsumed_tail or self.tail or self.raw.read(self.piece)
            self.tail = b""
            if not data:
                return False
            got = self.gz.decompress(data, self.piece)
            if self.gz.eof:
                self.tail, self.gz = self.gz.unused_data, zlib.decompressobj(31)
            if got:
                self.buffer += got
                return True

    def upto(self, end: bytes) -> bytes | None:
        at, seen = self.buffer.find(end), 0
        while at < 0:
            seen = max(0, len(self.buffer) - len(end))
            if not self.more():
                return None
            at = self.buffer.find(end, seen)
        head, self.buffer = self.buffer[:at], self.buffer[at + len(end) :]
        return head

    def take(self, most: int) -> bytes:
        while len(self.buffer) < most and self.more():
            pass
        got, self.buffer = self.buffer[:most], self.buffer[most:]
        return got


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in line)


def _number(urn: str | None) -> int | None:
    number = urn[10:-1].partition(":")[0] if urn else ""
    return int(number) if number else None


def read_archives(manifest: DataFrame, folder: str, chunk_bytes: int = 1 << 20, with_data: bool = True) -> DataFrame:
    """Chunk rows of every record in the archives that ``manifest`` (file) names.

    ``upto`` and ``sha1_upto`` are length and SHA-1 of the payload up to and with
    this chunk. The last row has ``payload_bytes`` and ``payload_digest`` of the
    full payload; a revisit has one row, whose figures are those of the payload it
    refers to. A digest that does not match its header raises an error.
    """
    spark = manifest.sparkSession
    small_batches(spark)
    names = ["record_id", "chunk_no", "record_type", "refers_to", "data", "upto", "sha1_upto", "payload_bytes", "payload_digest", "last"]
    types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def rows(stream: _Stream):
        while (head := stream.upto(b"\r\n\r\n")) is not None:
            warc = _fields(head.lstrip(b"\r\n"))
            http_head = stream.upto(b"\r\n\r\n") or b""
            http = _fields(http_head)
            left = int(warc["Content-Length"]) - len(http_head) - 4
            size, kind = int(http["Content-Length"]), warc["WARC-Type"]
            stated = base64.b32decode(warc["WARC-Payload-Digest"].partition(":")[2]).hex()
            record, other = _number(warc["WARC-Record-ID"]), _number(warc.get("WARC-Refers-To"))
            if kind == "revisit":
                yield record, 0, kind, other, None, 0, None, size, stated, True
            else:
                digest, upto, no = hashlib.sha1(), 0, 0
                while no == 0 or left:
                    data = stream.take(min(left, chunk_bytes))
                    if left and not data:
                        raise ValueError(f"record {record} is cut short")
                    left -= len(data)
                    digest.update(data)
                    upto += len(data)
                    sha = digest.copy().hexdigest()
                    if not left and (sha != stated or upto != size):
                        raise ValueError(f"record {record}: payload does not match its header")
                    yield record, no, kind, None, data if with_data else None, upto, sha, None if left else size, None if left else sha, not left
                    no += 1
            stream.upto(b"\r\n\r\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, path = _place(folder, name)
                with system.open_input_stream(path, compression=None) as raw:
                    held, weight = [], 0
                    for row in rows(_Stream(raw)):
                        held.append(row)
                        weight += 200 + len(row[4] or b"")
                        if weight > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], schema=schema)
                            held, weight = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], schema=schema)

    files = manifest.select("file").repartitionByRange(max(1, manifest.count()), "file")
    return files.mapInArrow(run, CHUNKS)
