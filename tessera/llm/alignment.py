"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A worker cuts its documents into parts where both tokenizers are bound to end a token: at
a space after a character that is no white space (no piece and no pre-token crosses it).
Distinct parts are encoded once. DuckDB gets, for each Arrow partition, one interval table
a tokenizer (part, id, first byte, last byte; the parts laid one after the other), finds
overlaps by an ASOF join (the token that covers a start) and a range join (tokens that
start inside another), numbers the groups by a window sum over the places where both end,
and adds links up by document. Documents that hold an id pair are counted in each
partition; Spark merges these partial counts and gives them back to the documents.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import cut, ship, work_folder

#: Parts that a worker keeps, and their characters; when full, it starts anew.
PARTS, PART_CHARS = 400_000, 14_000_000
#: Characters of the documents that are aligned together (one document at least), and parts
#: that are learned together.
CHARS, TOGETHER = 3_000_000, 20_000
#: Id pairs up to which their counts are broadcast (about 50 bytes each).
BROADCAST_PAIRS = 2_000_000
#: No token starts inside a part at such a space, whatever stands around it.
_CUT = re.compile(r"(?<=\S) ")
_SHIFT = 32
_HELD: dict[tuple[str, str], "Aligner"] = {}

_LINKS = """
CREATE OR REPLACE TEMP TABLE overlap AS
SELECT *, sum((ends_a AND ends_b)::INT) OVER (ORDER BY s) AS grp FROM (
    SELECT a.unit, a.s, a.id AS a, b.id AS b, true AS ends_a, a.s = b.s AS ends_b FROM a ASOF JOIN b ON a.s >= b.s
    UNION ALL
    SELECT a.unit, b.s, a.id, b.id, false, true FROM a JOIN b ON b.s > a.s AND b.s < a.e)
"""
_BY_DOC = """
SELECT doc, pair, sum(o.k * n)::INTEGER AS times FROM (SELECT doc, unit, count(*) AS k FROM occ GROUP BY ALL) o JOIN links USING (unit) GROUP BY doc, pair ORDER BY doc, pair
"""


def byte_alphabet() -> dict[str, int]:
    """The byte that a character of a byte-level vocabulary stands for: printable Latin-1
    stands for itself, the others follow from 256 on in ascending order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, and what a worker knows of the parts that it has seen."""

    def __init__(self, path_a: str, path_b: str):
        import duckdb
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        self.bytes_a = [b""] * (max(self.a.get_vocab().values()) + 1)
        for t, i in self.a.get_vocab().items():
            self.bytes_a[i] = b"".join(bytes([alphabet[c]]) if c in alphabet else c.encode() for c in t)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.most = max(len(self.bytes_a), len(self.bytes_b))
        self.words = [sign + str(i) for sign in ("", ",", ";", "|") for i in range(self.most)]
        # parts are apart only if nothing in either vocabulary can cross a cut
        kind = json.loads(self.a.to_str())
        joins = any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()) if not self.b.is_control(i))
        odd = [self.b.decode(self.b.encode(x)) != x for x in ("a  b ", "ﬁ①　x", "a\tb\n")]
        plain = kind["normalizer"] is None and kind["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.cuts = plain and not joins and not any(odd)
        self.space = self.b.piece_to_id("▁")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": tempfile.mkdtemp()})
        self.forget()

    def forget(self) -> None:
        self.units: dict[str, int] = {}
        self.chars = 0
        #: by part: tokens of A, of B, groups, links (-1 of A: not aligned), and its groups as text
        self.sizes, self.texts = [], []
        self.db.execute("CREATE OR REPLACE TEMP TABLE links (unit INTEGER, pair BIGINT, n INTEGER)")

    @classmethod
    def get(cls, path_a: str, path_b: str) -> "Aligner":
        if (path_a, path_b) not in _HELD:
            _HELD[path_a, path_b] = cls(path_a, path_b)
        return _HELD[path_a, path_b]

    def parts(self, text: str) -> list[str]:
        """The parts of a text; each has a space before it, that of the first is added."""
        return _CUT.split(text) if self.cuts else [text]

    def _intervals(self, name: str, flat: np.ndarray, n: np.ndarray, sizes: np.ndarray, units: np.ndarray) -> None:
        """An interval table in DuckDB: n tokens of each unit, one after the other."""
        last = np.cumsum(sizes[flat])
        self.db.register("given", pa.table({"unit": np.repeat(units, n), "id": flat, "s": last - sizes[flat], "e": last}))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    @staticmethod
    def _whole(raw: list[bytes], ids: list[list[int]], flat: np.ndarray, n: np.ndarray, entries: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Whether the tokens of each part give back its space and its bytes."""
        ends = np.concatenate([[0], np.cumsum(sizes[flat])])[np.concatenate([[0], np.cumsum(n)])]
        same = np.diff(ends) == np.fromiter(map(len, raw), np.int64, len(raw))
        # equal lengths and equal bytes of all together are equal bytes of each
        if same.all() and b"".join(map(entries.__getitem__, flat.tolist())) == b"".join(raw):
            return same
        return np.array([r == b"".join(map(entries.__getitem__, x)) for r, x in zip(raw, ids)], bool)

    def learn(self, parts: list[str]) -> None:
        """Encode and align parts that are new."""
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        # an empty part is the space at a text's end; the library would give it nothing
        ids_b = [x if p else [self.space] for p, x in zip(parts, self.b.encode(parts, num_threads=1))]
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        raw = [(" " + p).encode() for p in parts]
        well = self._whole(raw, ids_a, flat_a, n_a, self.bytes_a, self.sizes_a) & self._whole(raw, ids_b, flat_b, n_b, self.bytes_b, self.sizes_b)
        first = len(self.texts)
        sizes = np.zeros((len(parts), 4), np.int64)
        texts = [""] * len(parts)
        good = np.flatnonzero(well)
        sizes[:, 0] = -1
        if len(good):
            if len(good) < len(parts):
                flat_a, flat_b = flat_a[np.repeat(well, n_a)], flat_b[np.repeat(well, n_b)]
            sizes[good, 0], sizes[good, 1] = n_a[good], n_b[good]
            self._intervals("a", flat_a, n_a[good], self.sizes_a, good)
            self._intervals("b", flat_b, n_b[good], self.sizes_b, good)
            self.db.execute(_LINKS)
            self.db.execute(f"INSERT INTO links SELECT unit + {first}, (a::BIGINT << {_SHIFT}) + b, count(*) FROM overlap GROUP BY ALL")
            got = {k: np.asarray(v) for k, v in self.db.execute("SELECT unit, grp::BIGINT AS grp, a, b, ends_a, ends_b FROM overlap ORDER BY s").fetchnumpy().items()}
            starts = np.flatnonzero(np.diff(got["grp"], prepend=-1))
            sizes[:, 2] = np.bincount(got["unit"][starts], minlength=len(parts))
            sizes[:, 3] = np.bincount(got["unit"], minlength=len(parts))
            words = self._group_words(got, got["unit"][starts])
            ends = np.cumsum(sizes[good, 0] + sizes[good, 1]).tolist()
            for k, i, j in zip(good.tolist(), [0, *ends], ends):
                texts[k] = "".join(words[i:j])
        self.units.update(zip(parts, range(first, first + len(parts))))
        self.chars += sum(map(len, parts))
        self.sizes.append(sizes)
        self.texts += texts

    def _group_words(self, rows: dict[str, np.ndarray], unit_of: np.ndarray) -> list[str]:
        """All ids in the order of ``a1,a2|b1;a3|b2``, each with the sign before it."""
        at_a, at_b = rows["ends_a"], rows["ends_b"]
        group_a, group_b = rows["grp"][at_a] - rows["grp"][0], rows["grp"][at_b] - rows["grp"][0]
        opens = np.diff(unit_of, prepend=-1) != 0  # groups that are their part's first
        new_a, new_b = np.diff(group_a, prepend=-1) != 0, np.diff(group_b, prepend=-1) != 0
        code = np.empty(len(group_a) + len(group_b), np.int64)
        code[np.arange(len(group_a)) + np.searchsorted(group_b, group_a)] = np.where(new_a, np.where(opens[group_a], 0, 2), 1) * self.most + rows["a"][at_a]
        code[np.arange(len(group_b)) + np.searchsorted(group_a, group_b, "right")] = np.where(new_b, 3, 1) * self.most + rows["b"][at_b]
        return list(map(self.words.__getitem__, code.tolist()))

    def align(self, texts: list[str | None]) -> tuple[list[tuple], pa.Table]:
        """(n_a, n_b, n_groups, n_links, sha256 of the groups) of each text, and a table
        (doc, pair, times) of its links; doc is the text's place in the list."""
        split = [self.parts(t) if t else [] for t in texts]
        new = set().union(*split) - self.units.keys()
        if len(self.texts) + len(new) > PARTS or self.chars > PART_CHARS:
            self.forget()
            new = set().union(*split)
        fresh = sorted(new)
        for i in range(0, len(fresh), TOGETHER):
            self.learn(fresh[i : i + TOGETHER])
        if len(self.sizes) > 1:
            self.sizes = [np.concatenate(self.sizes)]
        rows, docs, units = [], [], []
        for i, parts in enumerate(split):
            known = np.fromiter(map(self.units.__getitem__, parts), np.int64, len(parts))
            if not len(known) or (sizes := self.sizes[0][known])[:, 0].min() < 0:
                rows.append((0, 0, 0, 0, ""))
                continue
            text = ";".join(map(self.texts.__getitem__, known.tolist()))
            rows.append((*sizes.sum(0).tolist(), hashlib.sha256(text.encode()).hexdigest()))
            docs.append(np.full(len(known), i))
            units.append(known)
        none = np.zeros(0, np.int64)
        self.db.register("occ", pa.table({"doc": np.concatenate(docs or [none]), "unit": np.concatenate(units or [none])}))
        links = self.db.sql(_BY_DOC).to_arrow_table()
        self.db.unregister("occ")
        return rows, links


_SCHEMA = "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>, counted array<long>, n_docs array<long>"
_ARROW = pa.schema(
    [*((n, pa.int64()) for n in ("row_id", "doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), ("counted", pa.list_(pa.int64())), ("n_docs", pa.list_(pa.int64()))]
)


def _partial(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(pairs), return_inverse=True)
    return found, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's own alignment and, in rows without row_id, each partition's counts
    of documents by id pair. The pairs of a document (A's id shifted left by 32, plus
    B's) come with their numbers of links. Written once; what it returns is read back."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.get(path_a, path_b)
        row_id = TaskContext.get().partitionId() << 36
        found, counts, held = [], [], 0
        for batch in batches:
            ids, texts, at = batch.column(0), batch.column(1), 0
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHARS, "right")))
                rows, links = aligner.align(texts.slice(at, end - at).to_pylist())
                n = end - at
                pair, doc = links["pair"].to_numpy(), links["doc"].to_numpy()
                cuts = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
                none = pa.nulls(n, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row_id, row_id + n)), ids.slice(at, n), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4)), pa.array([r[4] for r in rows], pa.string()), pa.ListArray.from_arrays(cuts, links["pair"].combine_chunks()), pa.ListArray.from_arrays(cuts, links["times"].combine_chunks()), none, none],
                    schema=_ARROW,
                )
                row_id += n
                one = np.unique(pair, return_counts=True)
                found.append(one[0])
                counts.append(one[1])
                held += len(one[0])
                if held > 4_000_000:
                    one = _partial(found, counts)
                    found, counts, held = [one[0]], [one[1]], 0
                at = end
        if found:
            pair, n = _partial(found, counts)
            for i in range(0, len(pair), 100_000):
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in _ARROW.types[:9]), pa.array([pair[i : i + 100_000]], pa.list_(pa.int64())), pa.array([n[i : i + 100_000]], pa.list_(pa.int64()))], schema=_ARROW)

    folder = work_folder(docs.sparkSession, "alignment")
    docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SCHEMA).write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n_docs, best): in how many documents an id pair is linked, and whether that is
    the highest of its A id. An A id has at most as many rows as B has ids."""
    one = aligned.where("row_id IS NULL").select(F.explode(F.arrays_zip("counted", "n_docs")).alias("c"))
    merged = one.groupBy(F.col("c.counted").alias("pair")).agg(F.sum("c.n_docs").alias("n_docs"))
    top = F.max("n_docs").over(Window.partitionBy(F.shiftright("pair", _SHIFT)))
    return merged.withColumn("best", F.col("n_docs") == top)


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256, and its links as pairs and times (of each pair).

    A text that is null, empty, or whose tokens do not give back the space and the text
    has zeros, no links and '' for the hash. Repeated rows, and rows without an id, are
    documents of their own and count as such; other columns are ignored, whatever their
    names; an empty table gives no rows. Texts are aligned whole."""
    aligned = align_documents(docs, path_a, path_b, id_col, text_col)
    counts = cut(pair_counts(aligned))
    rows = aligned.where("row_id IS NOT NULL").drop("counted", "n_docs")
    links = rows.select("row_id", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row_id", F.col("l.pairs").alias("pair"), F.col("l.times").cast("long").alias("times"))
    if counts.count() <= broadcast_pairs:
        counts = F.broadcast(counts)
    sums = links.join(counts, "pair").groupBy("row_id").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.join(sums, "row_id", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256", "pairs", "times"
    )
