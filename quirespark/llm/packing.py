"""Packing by power-of-two decomposition.

Each tokenised document is cut into as many whole sequences as fit and the
binary digits of the rest; a sequence holds one piece, sequences of equal
length share a bucket, and none crosses documents or needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import small_batches

_CACHES: dict = {}
#: Characters from which a part is encoded anew each time, so that a cache's entries bound its bytes.
LONG = 64
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class _Known(dict):
    """Parts and their ids; what was used lately survives when ``most`` are held, and long parts are not held."""

    def __init__(self, find, most: int):
        super().__init__()
        self.find, self.most, self.old = find, most, {}

    def __missing__(self, part):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(part) > LONG:
            return self.find(part)
        ids = self.old.get(part)
        self[part] = ids = self.find(part) if ids is None else ids
        return ids


class WordCache:
    """Token ids, as little-endian bytes, of texts cut at spaces and line feeds.

    A tokenizer with the stages ``LAYOUT`` drops white space and never merges across
    it, so the ids of a text are those of its parts, each of which is encoded once
    for many uses; any other tokenizer gets whole texts. A
    part of letters with punctuation behind it has the ids of both; a word of
    letters in lower case goes to the merges at once, as none of the tokenizer's
    normalisers changes it further. Anything else takes the whole tokenizer.
    """

    #: ASCII punctuation but the apostrophe, with which contractions begin.
    LAYOUT = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    }
    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str, most: int = 300_000):
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the bytes' stand-ins in the vocabulary, as the tokenizer's own first stage gives them
        stage = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        signs = {c: stage.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and c == c.lower()}
        self.signs = str.maketrans(signs)
        self.plain = set("abcdefghijklmnopqrstuvwxyz") | set(signs)
        with open(path) as f:
            stated = json.load(f)
        self.by_word = {k: stated.get(k) for k in self.LAYOUT} == self.LAYOUT
        self.parts = _Known(self._part, most)
        self.words = _Known(self._word, most)

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if word and self.plain.issuperset(word):
            return np.array([t.id for t in self.tokenizer.model.tokenize(word.translate(self.signs))], "<u4").tobytes()
        return self._encode(word) if word else b""

    def _part(self, part: str) -> bytes:
        core = part.rstrip(self.MARKS)
        if core.isalpha():
            low = core.lower()
            if self.plain.issuperset(low):
                return self.words[low] + self.words[part[len(core) :]]
        return self._encode(part) if part else b""

    def encode(self, text: str | None) -> bytes:
        if not self.by_word:
            return self._encode(text or "")
        return b"".join(map(self.parts.__getitem__, (text or "").replace("\n", " ").split(" ")))


def decompose(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: whole sequences, then powers of two from the largest."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(
    docs: DataFrame,
    tokenizer: str,
    longest: int = 4096,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    ``tokenizer`` is the path of a tokenizers file, ``longest`` a power of two.
    Every document ends with ``end_id``; null and empty texts are that id alone.
    Each sequence is one piece of power-of-two length, so ``offset`` is 0 and
    nothing is padded; ``length`` is the bucket. Rows that repeat an id are
    packed separately. Only the named columns are read. No shuffle is needed.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _CACHES.get(tokenizer) or _CACHES.setdefault(tokenizer, WordCache(tokenizer))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, pieces = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = cache.encode(text) + end
                n, at = len(ids) // 4, 0
                for length in decompose(n, longest):
                    piece = ids[4 * at : 4 * (at + length)]
                    rows.append((doc_id, at, length, zlib.crc32(piece), n))
                    if with_ids:
                        pieces.append(np.frombuffer(piece, "<u4").astype(np.int32))
                    at += length
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            cols = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)]
            if with_ids:
                offsets = np.r_[0, np.cumsum([len(p) for p in pieces])].astype(np.int32)
                flat = np.concatenate(pieces) if pieces else np.zeros(0, np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    found = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, _PIECES + (", ids array<int>" if with_ids else ""))
    return found.withColumnRenamed("doc_id", id_col).withColumns(
        {"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Pieces as training input: one folder for each sequence length."""
    pieces.write.partitionBy("length").parquet(path)
