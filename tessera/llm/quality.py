"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins; the most useful pairs have tables over
coarser bins of both. The tables are learned by boosting that goes round the features in
turn: each step adds a shallow tree of one feature (at most three cuts) or of one pair
(one cut each) at a small rate. A document's score is the logistic of the sum of its
entries, taken for whole batches by array indexing.

It is trained on a bounded sample of labelled rows; every document is scored, whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import fold_of, sampled_labels, ship, table

FOLDS, HELD_OUT = 3, 1
#: Labelled rows that the model is trained on, as expected number.
MAX_TRAIN = 20_000
BINS, PAIR_BINS = 32, 8
ROUNDS, RATE, PAIRS, PAIR_ROUNDS = 60, 0.2, 6, 30

FEATURES = (
    "log_bytes", "log_words", "word_length", "longest_word", "upper", "digit", "symbol", "space", "non_ascii", "marked_words", "distinct_words", "top_word", "repeated_lines",
    "line_length", "log_lines", "closed_lines", "shouted_words", "exclamation", "bars", "sentences", "short_words", "compressed", "repeated_pairs", "braces", "letters",
)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-"]] = True
_UPPER, _LOWER, _DIGIT, _SPACE = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r\x0b\x0c"))
_END = tuple(b".!?\"):;".decode())
_END_BYTES = tuple(c.encode() for c in _END)
_MARKS = tuple(c.encode() for c in "%&$#*@|~^=+<>")


def features(text: str | None) -> list[float]:
    """The FEATURES of one whole text; ratios of nothing are 0."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, w, k = max(len(raw), 1), max(len(words), 1), max(len(lines), 1)
    chars = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    count = Counter(words)
    letters = int(chars[_UPPER].sum() + chars[_LOWER].sum() + chars[128:].sum())
    pairs = len(words) - 1
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        float(lengths.mean()),
        np.log1p(float(lengths.max())),
        chars[_UPPER].sum() / max(letters, 1),
        chars[_DIGIT].sum() / n,
        chars[_SYMBOLS].sum() / n,
        chars[_SPACE].sum() / n,
        chars[128:].sum() / n,
        sum(x.endswith(_MARKS) for x in words) / w,
        len(count) / w,
        max(count.values(), default=0) / w,
        1 - len(set(lines)) / k if lines else 0.0,
        np.log1p(len(raw) / k),
        np.log1p(len(lines)),
        sum(x.rstrip().endswith(_END_BYTES) for x in lines) / k,
        sum(x.isupper() for x in words) / w,
        chars[33] / n,
        chars[124] / n,
        (chars[46] + chars[33] + chars[63]) / w,
        float((lengths <= 3).mean()) if words else 0.0,
        len(zlib.compress(raw, 1)) / n,
        1 - len(set(zip(words, words[1:]))) / pairs if pairs > 0 else 0.0,
        chars[[123, 125, 60, 62, 91, 93]].sum() / n,
        letters / n,
    ]


@dataclass
class Additive:
    """cuts: of each feature; tables: of each; pairs: ((i, j), cuts i, cuts j, table)."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[tuple[int, int], np.ndarray, np.ndarray, np.ndarray]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (c, t) in enumerate(zip(self.cuts, self.tables)):
            out += t[np.searchsorted(c, x[:, j], "right")]
        for (i, j), ci, cj, t in self.pairs:
            out += t[np.searchsorted(ci, x[:, i], "right"), np.searchsorted(cj, x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))


def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4, pull: float = 1.0) -> np.ndarray:
    """Value of each bin by a tree of at most ``leaves`` runs of bins, best cut first."""
    runs = [(0, len(g))]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    fit = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + pull)
    while len(runs) < leaves:
        best = (1e-9, None)
        for a, b in runs:
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = fit(a, m) + fit(m, b) - fit(a, b)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], (a, b, a + 1 + i))
        if best[1] is None:
            break
        a, b, m = best[1]
        runs.remove((a, b))
        runs += [(a, m), (m, b)]
    out = np.zeros(len(g))
    for a, b in runs:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + pull)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, pull: float = 1.0) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts each axis of a pair's grid once."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best = (0.0, np.zeros_like(g))
    for a in range(g.shape[0] - 1):
        for b in range(g.shape[1] - 1):
            q = []
            for c in (cg, ch):
                ul, u, left, all_ = c[a, b], c[a, -1], c[-1, b], c[-1, -1]
                q.append(np.array([ul, u - ul, left - ul, all_ - u - left + ul]))
            gain = float((q[0] ** 2 / (q[1] + pull)).sum() - cg[-1, -1] ** 2 / (ch[-1, -1] + pull))
            if gain > best[0] + 1e-9:
                v = q[0] / (q[1] + pull)
                t = np.empty_like(g)
                t[: a + 1, : b + 1], t[: a + 1, b + 1 :], t[a + 1 :, : b + 1], t[a + 1 :, b + 1 :] = v
                best = (gain, t)
    return best


def train(x: np.ndarray, y: np.ndarray) -> Additive:
    """The model for features x and labels y (0 or 1); with one class, or no rows, a
    constant near its share."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    d = x.shape[1]
    if not len(y) or y.min() == y.max():
        return Additive(base, [np.empty(0)] * d, [np.zeros(1)] * d, [])
    cuts = [_cuts(x[:, j], BINS) for j in range(d)]
    at = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    z = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for j in range(d):
            g, h = slopes()
            step = RATE * _tree(np.bincount(at[j], g, len(tables[j])), np.bincount(at[j], h, len(tables[j])))
            tables[j] += step
            z += step[at[j]]
    few = [_cuts(x[:, j], PAIR_BINS) for j in range(d)]
    near = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(few)]
    grid = lambda i, j, v: np.bincount(near[i] * (len(few[j]) + 1) + near[j], v, (len(few[i]) + 1) * (len(few[j]) + 1)).reshape(len(few[i]) + 1, -1)
    g, h = slopes()
    ranked = sorted(combinations(range(d), 2), key=lambda p: -_quadrants(grid(*p, g), grid(*p, h))[0])[:PAIRS]
    added = {p: np.zeros((len(few[p[0]]) + 1, len(few[p[1]]) + 1)) for p in ranked}
    for _ in range(PAIR_ROUNDS):
        for p in ranked:
            g, h = slopes()
            step = RATE * _quadrants(grid(*p, g), grid(*p, h))[1]
            added[p] += step
            z += step[near[p[0]], near[p[1]]]
    return Additive(base, cuts, tables, [(p, few[p[0]], few[p[1]], t) for p, t in added.items()])


def fit(spark: SparkSession, sf_dir: str, max_train: int = MAX_TRAIN) -> Additive:
    """Trained on labelled documents outside the held-out fold; only their features and
    labels, ``max_train`` rows as expected, come to the driver. Of rows that repeat an id,
    that with the least text is taken."""
    ship(spark)
    labels = sampled_labels(spark, sf_dir, "quality", FOLDS, HELD_OUT, max_train).withColumnRenamed("doc_id", "id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")
    own = docs.join(F.broadcast(labels), F.col("doc_id") == F.col("id")).groupBy("id", "y").agg(F.min("text").alias("text")).select("text", "y")  # bounded by sampled_labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.array(features(t.as_py()), "<f8").tobytes() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), b.column(1)], ["x", "y"])

    rows = own.mapInArrow(run, "x binary, y int").toPandas().sort_values(["x", "y"])  # the order of rows does not change the model
    x = np.frombuffer(b"".join(rows["x"]), "<f8").reshape(-1, len(FEATURES)) if len(rows) else np.empty((0, len(FEATURES)))
    return train(x, rows["y"].to_numpy(float))


def quality(docs: DataFrame, model: Additive, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).
    Null texts score as empty ones; a null id is not held out. Repeated rows keep their
    rows; other columns are ignored, whatever their names; an empty table gives none."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
