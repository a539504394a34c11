"""Benchmark decontamination with one Aho-Corasick automaton.

The windows (13 consecutive normalised words) of all benchmark items go into one
automaton. A document is normalised the same way, scanned once, and each match is mapped
from its place in the normalised text to word numbers and to offsets of the original.

The automaton is sent to the workers as the list of its windows. The size of the
benchmark is checked before any of it comes to the driver: beyond ``MAX_WINDOWS`` windows
its items are cut into groups by a hash, and the documents pass the groups' automata one
after the other. A pass takes one group to the driver and to the workers, and writes what
it found, so memory is bounded whatever the benchmark's size.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import cut, ship

WINDOW = 13
#: Windows of an automaton at most, as expected number; a worker holds one automaton.
MAX_WINDOWS = 200_000
#: A-Z to a-z; every other ASCII character but a-z and 0-9 to a space. Bytes of longer
#: UTF-8 characters stay: such characters belong to words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: The same words in a text that is not lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def windows_of(items: list[tuple[object, str | None]], size: int = WINDOW) -> dict[bytes, set]:
    """Window (words joined by a space) to the ids of the items that have it; an item
    with fewer words, but not none, is one window."""
    out: dict[bytes, set] = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(len(w) - size + 1, 1) if w else 0):
            out.setdefault(b" ".join(w[i : i + size]), set()).add(item)
    return out


class Matcher:
    def __init__(self, windows: dict[bytes, set]):
        self.auto = ahocorasick.Automaton()
        for key, items in windows.items():
            # one character a byte; the spaces around it make matches end at words
            self.auto.add_word(f" {key.decode('latin-1')} ", (len(key), len(key.split()), tuple(items)))
        if windows:
            self.auto.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, tuple]]]:
        """Number of words, and (first word, words, items) of each match."""
        w = words_of(text)
        if not w or not len(self.auto):
            return len(w), []
        flat = b" " + b" ".join(w) + b" "
        found = [(end - n, k, items) for end, (n, k, items) in self.auto.iter(flat.decode("latin-1"))]
        if not found:
            return len(w), []
        starts = np.cumsum([1] + [len(x) + 1 for x in w[:-1]])  # of the words in flat
        return len(w), [(int(i), k, items) for i, (_, k, items) in zip(np.searchsorted(starts, [f[0] for f in found]), found)]


def report(text: str | None, n_words: int, found: list[tuple[int, int, tuple]]) -> tuple[int, list, list[tuple[int, int]]]:
    """Words hit, items found, and the hit passages as (from, to) offsets of the text."""
    if not found:
        return 0, [], []
    hit = np.zeros(n_words + 1, np.int32)
    for i, k, _ in found:
        hit[i] += 1
        hit[i + k] -= 1
    on = np.cumsum(hit[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    at = [m.span() for m in WORD.finditer(text or "")]
    spans = [(at[a][0], at[b - 1][1]) for a, b in zip(edges[::2], edges[1::2])]
    return int(on.sum()), sorted({str(x) for _, _, items in found for x in items}), spans


_FOUND = "array<struct<i:int,k:int,items:array<string>>>"
_SPOT = pa.struct([("i", pa.int32()), ("k", pa.int32()), ("items", pa.list_(pa.string()))])
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])
_REPORT = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,stop:int>>"

#: The automaton that a worker holds: one at a time.
_HELD: dict[str, Matcher] = {}


class Group:
    """The windows of some items, sent as a broadcast."""

    def __init__(self, items: DataFrame, size: int = WINDOW):
        # a group of bounded size
        rows = [("null" if r[0] is None else r[0], r[1]) for r in items.select("item_id", "text").collect()]
        self.name, self.windows = uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast(windows_of(rows, size))

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, tuple]]]:
        """Matcher.scan, on a worker."""
        if self.name not in _HELD:
            _HELD.clear()
            _HELD[self.name] = Matcher(self.windows.value)
        return _HELD[self.name].scan(text)


def _groups(benchmark: DataFrame, size: int, limit: int) -> Iterator[tuple[Group, bool]]:
    """Groups of the items, of ``limit`` windows as expected, made one after the other,
    and whether each is the last."""
    # words have a character and a space at least, so no text has more windows than this
    most = benchmark.agg(F.sum(F.ceil((F.length("text") + 1) / 2))).first()[0] or 0
    n = max(1, math.ceil(most / 2 / limit))
    for i in range(n):
        yield Group(benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else benchmark, size), i == n - 1


def _spots(found: Iterable[dict]) -> list[tuple[int, int, list[str]]]:
    return [(x["i"], x["k"], list(x["items"])) for x in found]


def _scanner(group: Group) -> Callable[[Column, Column], Column]:
    """What was found before, and what the group finds in a text."""

    @F.pandas_udf(_FOUND)
    def scan(texts: pd.Series, before: pd.Series) -> pd.Series:
        out = [[*b, *({"i": i, "k": k, "items": [str(x) for x in items]} for i, k, items in group.scan(t)[1])] for t, b in zip(texts, before)]
        return pa.array(out, pa.list_(_SPOT)).to_pandas()

    return scan


def _before_last(docs: DataFrame, benchmark: DataFrame, size: int, limit: int) -> tuple[DataFrame, Group]:
    """``docs`` with __found, the matches of all groups but the last, and the last group."""
    ship(docs.sparkSession)
    rows = docs.withColumn("__found", F.array().cast(_FOUND))
    for group, last in _groups(benchmark, size, limit):
        if last:
            return rows, group
        # written, so that a worker has one automaton at a time
        rows = cut(rows.withColumn("__found", _scanner(group)("text", "__found")))
    raise AssertionError("there is a last group")


def contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit (words inside any occurrence of a
    window), n_items, items (sorted ids of the items with occurring windows),
    items_sha256, contaminated (n_hit > 0 and 20 * n_hit >= n_words) and spans (hit
    passages as character offsets of the text).

    Null and empty texts have no words and are not contaminated. Null or wordless items
    give no window, and rows with a null item_id are named "null". Repeated rows keep
    their rows. An empty benchmark hits nothing; an empty table gives no rows. Other
    columns are ignored, whatever their names."""
    rows, group = _before_last(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), benchmark, size, max_windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, before in zip(*(c.to_pylist() for c in b.columns)):
                n, found = group.scan(t)
                hit, items, spans = report(t, n, [*_spots(before), *found])
                rows.append({"doc_id": i, "n_words": n, "n_hit": hit, "items": items, "spans": [{"start": a, "stop": z} for a, z in spans]})
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    out = rows.select("doc_id", "text", "__found").mapInArrow(run, f"doc_id long, {_REPORT}")
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "spans",
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The rows that are not contaminated, with all their columns."""

    rows, group = _before_last(docs, benchmark, size, max_windows)

    @F.pandas_udf("boolean")
    def gone(texts: pd.Series, before: pd.Series) -> pd.Series:
        out = []
        for t, b in zip(texts, before):
            n, found = group.scan(t)
            out.append(contaminated(n, report(t, n, [*_spots(b), *found])[0]))
        return pd.Series(out, dtype=bool)

    return rows.where(~gone("text", "__found")).drop("__found")


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH iw AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_SQL_WORDS} AS w FROM benchmark),
ik AS (SELECT item, w, least(len(w), {WINDOW}) AS k FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM ik)),
dw AS (SELECT row_number() OVER () AS rn, doc_id, {_SQL_WORDS} AS w FROM documents),
dk AS (SELECT rn, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win) ks WHERE len(w) >= k),
hits AS (SELECT dk.rn, dk.i, dk.k, win.item FROM dk JOIN win ON win.k = dk.k AND win.win = array_to_string(dk.w[dk.i:dk.i + dk.k - 1], ' ')),
pos AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT rn, i, k FROM hits)) GROUP BY rn),
its AS (SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rn, item FROM hits) GROUP BY rn)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (rn) LEFT JOIN its USING (rn)
"""
