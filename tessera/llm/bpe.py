"""Byte-level BPE encoding and decoding with overlapping chunks.

Long texts are cut into chunks that overlap. Each chunk is pre-tokenised on its own, in
parallel. A chunk that begins within a pre-token cuts wrongly at first, but the pattern
looks only forward, so from the first boundary that it shares with the chunk before it
all its boundaries are right: there the two are stitched. The pre-tokens are then merged
by the ranks, piece by piece, and decoding concatenates the raw bytes of the ids.

Texts of at most one chunk take the same steps with a single chunk, without a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import ship

CHUNK = 65_536
OVERLAP = 2_048
#: Pieces kept with their ids, a worker; when full, the cache starts anew.
CACHE = 400_000



def newer_characters() -> frozenset[str]:
    """Characters that the pattern engine here knows and Python's older Unicode tables do
    not. The library's own engine may class these otherwise, so texts that hold one are
    given to the library whole."""
    unknown = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")
    return frozenset("".join(regex.findall(r"\P{Cn}+", unknown)))


_CODECS: dict[tuple[str, str], "Codec"] = {}


class Codec:
    """Ranks of a vocabulary file (lines of base64 and rank) and a pattern."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.merge = self.encoding._core_bpe.encode_single_piece
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.cache: dict[str, bytes] = {}
        self.newer = newer_characters()

    @classmethod
    def get(cls, path: str, pattern: str) -> "Codec":
        if (path, pattern) not in _CODECS:
            _CODECS[path, pattern] = cls(path, pattern)
        return _CODECS[path, pattern]

    def whole(self, text: str) -> bytes:
        """Ids of a text as the library itself encodes it."""
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def has_newer(self, text: str) -> bool:
        if text.isascii():
            return False
        try:
            text.encode("latin-1")
            return False
        except UnicodeEncodeError:
            return not self.newer.isdisjoint(text)

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def ids(self, pieces: list[str]) -> bytes:
        """Ids of the pieces as little-endian unsigned 32-bit integers."""
        cache = self.cache
        try:
            return b"".join(map(cache.__getitem__, pieces))
        except KeyError:
            pass
        if len(cache) > CACHE:
            cache.clear()
        for p in pieces:
            if p not in cache:
                cache[p] = np.array(self.merge(p.encode("utf-8")), "<u4").tobytes()
        return b"".join(map(cache.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def cut_text(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Overlapping chunks: each has ``overlap`` more characters than its step."""
    return [text[i : i + chunk + overlap] for i in range(0, max(len(text), 1), chunk)]


def boundaries(codec: Codec, chunk: str) -> np.ndarray:
    """Offsets in the chunk at which its pre-tokens begin, and its end."""
    lengths = [len(p) for p in codec.pieces(chunk)]
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]) if lengths else np.zeros(1, np.int64)


def stitch(starts: list[int], marks: list[np.ndarray], last: int) -> list[tuple[int, int, int]]:
    """(chunk, from, to) in offsets of the text: which chunk's pre-tokens hold where.

    starts: where the chunks begin; marks: their boundaries in offsets of the text.
    A chunk's final pre-token can be cut off by its end, so its last boundary counts
    only at the end of the text. Where two chunks share no boundary in their overlap (one
    pre-token spans it all), the part is given as chunk -1: it has to be cut anew."""
    out: list[tuple[int, int, int]] = []
    at, c = 0, 0
    while c < len(starts):
        if c + 1 == len(starts):
            out.append((c, at, last))
            break
        mine = marks[c][:-2] if len(marks[c]) > 1 else marks[c][:0]  # not the cut-off token, nor one whose lookahead it may change
        both = np.intersect1d(mine, marks[c + 1][1:] if starts[c + 1] else marks[c + 1])
        both = both[both >= max(at, starts[c + 1])]
        if len(both):
            out.append((c, at, int(both[0])))
            at, c = int(both[0]), c + 1
        else:
            out.append((-1, at, last))
            break
    return out


def encode_text(codec: Codec, text: str | None, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
    """Ids of one text by chunks, stitched; as 32-bit integers in bytes."""
    text = text or ""
    if codec.has_newer(text):
        return codec.whole(text)
    if len(text) <= chunk:
        return codec.ids(codec.pieces(text))
    parts = cut_text(text, chunk, overlap)
    starts = [i * chunk for i in range(len(parts))]
    marks = [boundaries(codec, p) + s for p, s in zip(parts, starts)]
    out = []
    for c, a, b in stitch(starts, marks, len(text)):
        out.append(codec.ids(codec.pieces(text[a:b]) if c < 0 else _between(parts[c], starts[c], marks[c], a, b)))
    return b"".join(out)


def _between(part: str, start: int, marks: np.ndarray, a: int, b: int) -> list[str]:
    inside = marks[(marks >= a) & (marks <= b)] - start
    return [part[i:j] for i, j in zip(inside[:-1].tolist(), inside[1:].tolist())]


SCHEMA = "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"


def _row(codec: Codec, doc_id: int | None, ids: bytes, keep_ids: bool) -> tuple:
    return doc_id, len(ids) // 4, ids if keep_ids else None, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 5
    types = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, keep_ids: bool = True
) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit; null if not kept),
    ids_sha256 and decoded_sha256 (of the bytes that the ids decode to).

    Texts longer than ``chunk`` characters are dealt out by chunk: their chunks are
    pre-tokenised and encoded by different tasks and stitched by document. Null and
    empty texts have no ids. Each row gives a row, repeated ones and null ids too;
    other columns are ignored, whatever their names; an empty table gives no rows."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = F.coalesce(F.length("text"), F.lit(0))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.get(path, pattern)
        for b in batches:
            rows, size = [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                rows.append(_row(codec, i, encode_text(codec, t.as_py(), chunk, overlap), keep_ids))
                size += 4 * rows[-1][1]
                if size > 1 << 24:
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)

    def by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a chunk: its boundaries and the ids of its pre-tokens."""
        codec = Codec.get(path, pattern)
        for b in batches:
            for row in b.to_pylist():
                pieces = codec.pieces(row["part"])
                lengths = np.array([len(p) for p in pieces], np.int64)
                ids = codec.ids(pieces)
                counts = [len(codec.cache.get(p) or codec.ids([p])) for p in pieces]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["key"]]), pa.array([row["doc_id"]], pa.int64()), pa.array([row["at"]], pa.int64()), pa.array([row["part"]]), pa.array([np.cumsum(lengths).astype("<i8").tobytes()]), pa.array([np.cumsum(counts).astype("<i8").tobytes()]), pa.array([ids], pa.binary())],
                    ["key", "doc_id", "at", "part", "marks", "cuts", "ids"],
                )

    def join_chunks(pdf):
        import pandas as pd

        codec = Codec.get(path, pattern)
        pdf = pdf.sort_values("at")
        starts = pdf["at"].tolist()
        marks = [np.concatenate([[0], np.frombuffer(m, "<i8")]) + s for m, s in zip(pdf["marks"], starts)]
        cuts = [np.concatenate([[0], np.frombuffer(m, "<i8")]) for m in pdf["cuts"]]
        parts, ids = pdf["part"].tolist(), pdf["ids"].tolist()
        out, spans = [], stitch(starts, marks, starts[-1] + len(parts[-1]))
        text = "".join([*(p[:chunk] for p in parts[:-1]), parts[-1]])
        if codec.has_newer(text):
            out, spans = [codec.whole(text)], []
        for c, a, b in spans:
            if c < 0:  # one pre-token spans an overlap: the rest is cut as one text
                out.append(codec.ids(codec.pieces(text[a:b])))
            else:
                i, j = np.searchsorted(marks[c], [a, b])
                out.append(ids[c][cuts[c][i] : cuts[c][j]])
        return pd.DataFrame([_row(codec, None if pd.isna(pdf["doc_id"].iloc[0]) else int(pdf["doc_id"].iloc[0]), b"".join(out), keep_ids)], columns=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    few = src.where(n <= chunk).mapInArrow(short, SCHEMA)
    steps = F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))
    part = F.explode(F.transform(steps, lambda i: F.struct((i * chunk).cast("long").alias("at"), F.substring(F.col("text"), i * chunk + 1, F.lit(chunk + overlap)).alias("part"))))
    many = (
        src.where(n > chunk)
        .select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
        .select("key", "doc_id", part.alias("c"))
        .select("key", "doc_id", "c.at", "c.part")
        .repartition("key", "at")
        .mapInArrow(by_chunk, "key long, doc_id long, at long, part string, marks binary, cuts binary, ids binary")
        .groupBy("key")
        .applyInPandas(join_chunks, SCHEMA)
    )
    return few.unionByName(many)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); bytes that are no UTF-8 become U+FFFD, a null
    stays null."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.get(path, pattern)
        for b in batches:
            texts = [None if x is None else codec.decode(x).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
