"""Content-addressed store of token ids.

Each document's ids, ended by an end id, are cut into chunks where a rolling hash of the
last ids says so, so that equal passages give equal chunks. A chunk is named by its
SHA-256 and stored once. A document is a recipe, the list of its chunks' names; the
recipes, the store's form of the id stream, are written in ascending order of document
ids and give each document's place in it. Merkle roots over chunks (documents), recipes (shards) and shards (the manifest)
verify what is read back.

The packs that hold the chunks follow the partitions of the input, so encoding needs no
shuffle of texts or ids. Only names are shuffled: the first pack that has a chunk keeps
it, the others are rewritten without it and refer to that pack.

Files below the store's folder: packs/*.pack (zstd frames of chunks, then a compressed
index of names and places and a footer), recipes/ and manifest/ (Parquet).
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._common import filesystem, ship

SPAN, LEAST, MEAN_BITS, MOST = 16, 64, 8, 2_048
FRAME_BYTES = 1 << 18
#: Words and pre-tokens that a worker keeps; then it starts anew.
CACHE = 800_000
#: Recipes of a shard, as expected number: what one task sorts and hashes.
SHARD_ROWS = 250_000
_MAGIC = b"TKPK0001"

#: Characters for which lower-casing and splitting at white space in Python is what the
#: tokenizer's normaliser and pre-tokeniser do; other texts are given to it whole.
_PLAIN = re.compile(r"[\t-\r -~\xa0-ɏ]*")
# The pre-token pattern of the tokenizer file, and how byte-level models
# show bytes as letters (printable ones as themselves, the others from U+0100 on).
_PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: chr(b) if b in _PRINTABLE else chr(256 + b - sum(x < b for x in _PRINTABLE)) for b in range(256)}
_ONE = struct.Struct("<I").pack
_ENCODERS: dict[str, "Encoder"] = {}


class _Words(dict):
    """Word to its ids, made when first asked for: its pre-tokens, each merged once."""

    def __init__(self, tokenizer):
        super().__init__()
        self.merge = tokenizer.model.tokenize

    def __missing__(self, word: str) -> bytes:
        if word.isalpha() and word.isascii():  # one pre-token
            out = self._merged(word)
        else:
            get, out = self.get, b""
            for p in _PRE_TOKEN.findall(word):
                ids = get(p)  # a pre-token is a word that has no other
                if ids is None:
                    ids = self[p] = self._merged(p if p.isascii() else "".join(map(_BYTE_LETTERS.__getitem__, p.encode("utf-8"))))
                out += ids
        self[word] = out
        return out

    def _merged(self, shown: str) -> bytes:
        t = self.merge(shown)
        return _ONE(t[0].id) if len(t) == 1 else struct.pack(f"<{len(t)}I", *[x.id for x in t])


class Encoder:
    """Ids by a tokenizer file. Where it lower-cases, splits by _PRE_TOKEN and works on
    bytes shown as letters, its library merges each distinct pre-token once and texts are
    put together from words; for any other file the library gets the texts whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what is parallel
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = _Words(self.tokenizer)
        self.known = self._as_assumed(json.loads(self.tokenizer.to_str()))

    @staticmethod
    def _as_assumed(spec: dict) -> bool:
        """Whether the file's normaliser and pre-tokeniser are those that encode() stands
        in for, and its model has no dropout; else the library gets every text whole."""

        def steps(part: dict | None, key: str) -> list[dict]:
            return [] if part is None else [s for p in part[key] for s in steps(p, key)] if part.get("type") == "Sequence" else [part]

        normal, cut = steps(spec.get("normalizer"), "normalizers"), steps(spec.get("pre_tokenizer"), "pretokenizers")
        patterns = [s.get("pattern", {}).get("Regex") for s in cut if s["type"] == "Split"]
        return (
            sorted({s["type"] for s in normal} - {"NFC", "Replace"}) == ["Lowercase"]
            and all(s.get("pattern", {}).get("Regex") == r"\s+" and s.get("content") == " " for s in normal if s["type"] == "Replace")
            and patterns == [_PRE_TOKEN.pattern]
            and [s["type"] for s in cut] in (["Split", "ByteLevel"], ["Split"])
            and not any(s.get("add_prefix_space") or s.get("use_regex") for s in cut if s["type"] == "ByteLevel")
            and all(s.get("behavior") == "Removed" and s.get("invert") for s in cut if s["type"] == "Split")
            and all("<|" in t["content"] for t in spec.get("added_tokens") or [])
            and not spec.get("truncation")
            and spec["model"]["type"] == "BPE"
            and not spec["model"].get("dropout")
            and not spec["model"].get("continuing_subword_prefix")
        )

    @classmethod
    def get(cls, path: str) -> "Encoder":
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.words) > CACHE:
            self.words = _Words(self.tokenizer)
        get = self.words.__getitem__
        out = []
        for t in texts:
            t = t or ""
            if self.known and "<|" not in t and _PLAIN.fullmatch(t):
                out.append(b"".join(map(get, t.lower().split())))
            else:
                ids = self.tokenizer.encode(t, add_special_tokens=False).ids
                out.append(np.array(ids, "<u4").tobytes())
        return out


_MIX = np.random.default_rng(64).integers(0, 2**64, 4096, np.uint64)
_A = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        m = max(n, 2 * len(_POWERS["up"]), 4096)
        for name, a in (("up", _A), ("down", pow(_A, -1, 2**64))):
            x = np.full(m, a, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of a stream of ids. A chunk ends after a position whose rolling
    polynomial hash over the last SPAN ids starts with MEAN_BITS zeros, with at least
    LEAST and at most MOST ids in it (the last one can be shorter)."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    up, down = _powers(n)
    v = ids.astype(np.uint64)
    v = _MIX[v & np.uint64(4095)] ^ (v * np.uint64(0xC2B2AE3D27D4EB4F))
    total = np.cumsum(v * up, dtype=np.uint64)
    total[SPAN:] -= total[:-SPAN].copy()
    marks = np.flatnonzero((total * down) >> np.uint64(64 - MEAN_BITS) == 0) + 1
    out, at = [], 0
    for m in marks.tolist():
        if m - at < LEAST:
            continue
        while m - at > MOST:
            at += MOST
            out.append(at)
        if m - at >= LEAST:
            out.append(m)
            at = m
    while n - at > MOST:
        at += MOST
        out.append(at)
    if at < n:
        out.append(n)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of SHA-256; of no leaves, the hash of nothing. An odd last
    node goes up as it is."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    level = leaves
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _names(joined: bytes) -> list[bytes]:
    joined = bytes(joined)
    return [joined[i : i + 32] for i in range(0, len(joined), 32)]


class PackWriter:
    """Chunks in frames, then the index; under a temporary name until it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp)
        self.zstd = zstandard.ZstdCompressor(level=1)
        self.buffer, self.names, self.places, self.frames = bytearray(), [], [], []

    def add(self, name: bytes, ids: bytes) -> None:
        self.names.append(name)
        self.places.append((len(self.frames), len(self.buffer), len(ids)))
        self.buffer += ids
        if len(self.buffer) >= FRAME_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.buffer:
            raw = np.frombuffer(bytes(self.buffer), "<u4")
            narrow = not len(raw) or int(raw.max()) < 1 << 16
            z = self.zstd.compress(raw.astype("<u2").tobytes() if narrow else raw.tobytes())
            self.out.write(z)
            self.frames.append((len(z), len(self.buffer), 2 if narrow else 4))
            self.buffer = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(self.names) + np.array(self.places, "<u4").tobytes() + np.array(self.frames, "<u4").tobytes()
        z = self.zstd.compress(index)
        self.out.write(z + struct.pack("<QQQQ", len(z), len(index), len(self.names), len(self.frames)) + _MAGIC)
        self.out.close()
        # another attempt of the task may have been first; what it made is the same
        if self.fs.get_file_info(self.path).type.name == "NotFound":
            self.fs.move(self.temp, self.path)
        else:
            self.fs.delete_file(self.temp)


class PackReader:
    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 40)
        z, full, n, k = struct.unpack("<QQQQ", self.file.read(32))
        if self.file.read(8) != _MAGIC:
            raise ValueError(f"{uri} is no pack")
        self.file.seek(size - 40 - z)
        raw = zstandard.ZstdDecompressor().decompress(self.file.read(z), max_output_size=max(full, 1))
        names = raw[: 32 * n]
        self.places = np.frombuffer(raw, "<u4", 3 * n, 32 * n).reshape(-1, 3)
        self.frames = np.frombuffer(raw, "<u4", 3 * k, 32 * n + 12 * n).reshape(-1, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        self.at = {names[32 * i : 32 * i + 32]: i for i in range(n)}
        self.held: OrderedDict[int, bytes] = OrderedDict()

    def frame(self, i: int) -> bytes:
        if i not in self.held:
            z, full, width = (int(x) for x in self.frames[i])
            self.file.seek(int(self.starts[i]))
            raw = zstandard.ZstdDecompressor().decompress(self.file.read(z), max_output_size=max(full * width // 4, 1))
            self.held[i] = raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
            if len(self.held) > 8:
                self.held.popitem(last=False)
        return self.held[i]

    def chunk(self, name: bytes) -> bytes:
        f, at, n = (int(x) for x in self.places[self.at[name]])
        ids = self.frame(f)[at : at + n]
        if hashlib.sha256(ids).digest() != name:
            raise ValueError("a chunk is not what its name says")
        return ids

    def close(self) -> None:
        self.file.close()


def _encode_packs(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """(doc_id, n_tokens, pack, names, fresh): a pack a partition, with its own chunks
    once. names: the chunks' names, one after the other; fresh: those of them that this
    document is the first of its pack to have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the rows say which attempt's pack is theirs; packs of attempts that were lost stay behind
        task = TaskContext.get()
        encoder, name, writer, seen = Encoder.get(tokenizer), f"{task.partitionId():06d}-{task.taskAttemptId()}", None, set()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                b = batch.slice(i, 500)
                rows = []
                for doc_id, raw in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist())):
                    raw += end
                    names, fresh, at = [], [], 0
                    for z in cuts(np.frombuffer(raw, "<u4")):
                        piece = raw[4 * at : 4 * z]
                        at = z
                        names.append(hashlib.sha256(piece).digest())
                        if names[-1] not in seen:
                            seen.add(names[-1])
                            fresh.append(names[-1])
                            writer = writer or PackWriter(f"{folder}/staging/{name}.pack")
                            writer.add(names[-1], piece)
                    rows.append((doc_id, len(raw) // 4, name, b"".join(names), fresh))
                cols = list(zip(*rows)) if rows else [[]] * 5
                types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "n_tokens", "pack", "names", "fresh"])
        if writer is not None:
            writer.close()

    return docs.mapInArrow(run, "doc_id long, n_tokens long, pack string, names binary, fresh array<binary>")


def write_store(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Write the store below ``folder`` (a new one) and return its recipes: doc_id, start,
    n_tokens, pack, names (of its chunks, 32 bytes each), away (place in names and pack
    of the chunks that another pack has), root, shard.

    Null and empty texts have only the end id. Rows that repeat an id each have a recipe,
    ordered by their roots; null ids come first. An empty table gives an empty store.
    Other columns are ignored, whatever their names."""
    spark = docs.sparkSession
    ship(spark)
    fs, path = filesystem(folder)
    for d in ("staging", "packs"):
        fs.create_dir(f"{path}/{d}", recursive=True)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    _encode_packs(src, tokenizer, end_id, folder).write.parquet(f"{folder}/staging-recipes")
    staged = spark.read.parquet(f"{folder}/staging-recipes")

    names = staged.select("pack", F.explode("fresh").alias("name"))
    first = names.groupBy("name").agg(F.min("pack").alias("owner"), F.max("pack").alias("last")).where("owner <> last")
    foreign = names.join(first, "name").where("pack <> owner").select(F.col("pack").alias("home"), "name", "owner")

    def settle(key: tuple, recipes: pd.DataFrame, away: pd.DataFrame) -> pd.DataFrame:
        pack = key[0]
        owner = dict(zip(map(bytes, away["name"]), away["owner"]))
        fs, at = filesystem(folder)
        old, new = f"{at}/staging/{pack}.pack", f"{at}/packs/{pack}.pack"
        if fs.get_file_info(new).type.name == "NotFound":  # else an earlier attempt has made it
            if owner:
                reader, writer = PackReader(f"{folder}/staging/{pack}.pack"), PackWriter(f"{folder}/packs/{pack}.pack")
                for name in reader.at:
                    if name not in owner:
                        writer.add(name, reader.chunk(name))
                writer.close()
                reader.close()
            else:
                fs.move(old, new)
        if owner and fs.get_file_info(old).type.name != "NotFound":
            fs.delete_file(old)
        lists = [_names(x) for x in recipes["names"]]
        out = recipes[["doc_id", "n_tokens", "pack", "names"]].copy()
        out["away"] = [[{"at": i, "pack": owner[x]} for i, x in enumerate(xs) if x in owner] if owner else [] for xs in lists]
        out["root"] = [merkle(xs) for xs in lists]
        return out

    kind = "doc_id long, n_tokens long, pack string, names binary, away array<struct<at:int,pack:string>>, root binary"
    linked = staged.drop("fresh").groupBy("pack").cogroup(foreign.groupBy("home")).applyInPandas(settle, kind)
    linked.write.parquet(f"{folder}/linked")
    # a place of its own for each row, so that an id or text that repeats can be split, too
    rows = spark.read.parquet(f"{folder}/linked").withColumn("place", F.monotonically_increasing_id())
    n = shards or max(spark.sparkContext.defaultParallelism, math.ceil(rows.count() / SHARD_ROWS))
    ordered = rows.repartitionByRange(n, "doc_id", "root", "place").sortWithinPartitions("doc_id", "root", "place").drop("place").withColumn("shard", F.spark_partition_id())
    ordered.write.parquet(f"{folder}/recipes")
    for d in ("staging-recipes", "linked", "staging"):
        fs.delete_dir(f"{path}/{d}")
    recipes = read_recipes(spark, folder)
    recipes.select("shard", "doc_id", "start", "n_tokens", "root").groupBy("shard").applyInPandas(_shard_root, "shard int, n_docs long, n_tokens long, root binary").write.parquet(f"{folder}/manifest")
    return recipes


def _shard_root(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["start"])
    leaves = [hashlib.sha256(b"\x00" + struct.pack("<q", -1 if pd.isna(i) else int(i)) + struct.pack("<q", int(n)) + bytes(r)).digest() for i, n, r in zip(pdf["doc_id"], pdf["n_tokens"], pdf["root"])]
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "n_docs": [len(pdf)], "n_tokens": [int(pdf["n_tokens"].sum())], "root": [merkle(leaves)]})


def read_recipes(spark: SparkSession, folder: str) -> DataFrame:
    """The recipes with each document's start in the stream: sums within a shard, after
    the totals of the shards before it (a row a shard comes to the driver)."""
    rows = spark.read.parquet(f"{folder}/recipes")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    starts, at = [], 0
    for r in totals:
        starts.append((r.shard, at))
        at += r.n
    before = spark.createDataFrame(starts, "shard int, before long")
    within = Window.partitionBy("shard").orderBy("doc_id", "root").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return rows.join(F.broadcast(before), "shard").select("doc_id", (F.col("within") + F.col("before")).alias("start"), "n_tokens", "pack", "names", "away", "root", "shard")


def manifest_root(spark: SparkSession, folder: str) -> str:
    """Root of the whole store: the tree over the shards' roots."""
    return merkle([bytes(r.root) for r in spark.read.parquet(f"{folder}/manifest").orderBy("shard").collect()]).hex()


def verify_manifest(spark: SparkSession, folder: str) -> bool:
    """Whether the recipes give the roots that the manifest has."""
    kind = "shard int, n_docs long, n_tokens long, root binary"
    now = read_recipes(spark, folder).select("shard", "doc_id", "start", "n_tokens", "root").groupBy("shard").applyInPandas(_shard_root, kind)
    kept = spark.read.parquet(f"{folder}/manifest")
    return not now.exceptAll(kept).count() and not kept.exceptAll(now).count()


def read_store(spark: SparkSession, folder: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit; null if not
    kept), ids_crc32, put together from the packs and checked against names and roots."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_packs: OrderedDict[str, PackReader] = OrderedDict()

        def chunk(pack: str, name: bytes) -> bytes:
            if pack in open_packs:
                open_packs.move_to_end(pack)
            else:
                open_packs[pack] = PackReader(f"{folder}/packs/{pack}.pack")
                if len(open_packs) > 24:
                    open_packs.popitem(last=False)[1].close()
            return open_packs[pack].chunk(name)

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                rows = []
                for doc_id, start, n, own, joined, away, root in zip(*(c.to_pylist() for c in batch.slice(i, 500).columns)):
                    names = _names(joined)
                    packs = {a["at"]: a["pack"] for a in away}
                    ids = b"".join([chunk(packs.get(k, own), x) for k, x in enumerate(names)])
                    if len(ids) != 4 * n or merkle(names) != root:
                        raise ValueError(f"document {doc_id} does not match its recipe")
                    rows.append((doc_id, start, n, ids if keep_ids else None, zlib.crc32(ids)))
                cols = list(zip(*rows)) if rows else [[]] * 5
                types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "start", "n_tokens", "ids", "ids_crc32"])

    rows = read_recipes(spark, folder).select("doc_id", "start", "n_tokens", "pack", "names", "away", "root")
    # documents of a pack meet in a task, in the order in which its frames hold them
    n = max(1, min(rows.select("pack").distinct().count(), 10_000))  # recipes are small, what they name is not
    return rows.repartition(n, "pack").sortWithinPartitions("pack", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")
