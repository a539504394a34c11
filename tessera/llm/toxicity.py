"""Toxicity: a weighted lexicon, matched with Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs and accented letters to their plain letter and digit
substitutions inside words ("1d1ot") back to letters, and leaves one space between words.
Lexicon entries are whole words or word beginnings, each with a weight; exception phrases
take away the matches that they cover. The weights of a text's matches, also relative to
its length, give the score through a logistic curve.

Lexicon, weights, exceptions and curve are learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import cut, fold_of, sampled_labels, ship, table

FOLDS, HELD_OUT = 5, 0
#: Labelled rows that the lexicon is learned from, as expected number.
MAX_TRAIN = 20_000
#: Terms that a task counts before it hands its counts on.
HELD_TERMS = 50_000
#: The log-likelihood beyond chance that a term needs: that of one in a million terms and
#: some more. All terms that have it are looked at.
LEAST_GAIN = math.log(1e6) + 3
PREFIXES = (3, 4, 5, 6, 7)

#: Letters of other scripts that look like Latin ones, and what is written for letters.
HOMOGLYPHS = dict(zip("абвгдеёзіїјкмнорстухѕԁԛԝαβγδεικνορτυχω", "abbrdee3iijkmhopctyxsdqwabydeikvoptuxw"))
LEET = dict(zip("013457@$", "oieastas"))
_LEET = str.maketrans(LEET)
_TOKEN = re.compile(r"[\w@$]+")


class _Fold(dict):
    """Code point to what it is folded to, found when first asked for. Signs that stand
    for letters stay as they are."""

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        c = HOMOGLYPHS.get(c, c)
        base = "".join(HOMOGLYPHS.get(x, x) for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
        out = "".join(x if x.isalnum() or x in LEET else "" if unicodedata.category(x) in ("Mn", "Cf") else " " for x in base)
        self[cp] = out
        return out


_FOLD = _Fold()


def _unleet(m: re.Match) -> str:
    return m[0].translate(_LEET) if any(c.isalpha() for c in m[0]) else m[0]


def folded(text: str | None) -> str:
    """Folded words, each between single spaces; a space alone for none. Characters come
    first, so that wide or styled digits and digits beside homoglyphs are substitutions
    like any other; then a word that has a letter has its substitutions mapped, up to its
    end. What is then left of the signs is no word."""
    t = (text or "").lower().translate(_FOLD)
    if any(c in t for c in LEET):
        t = _TOKEN.sub(_unleet, t).replace("@", " ").replace("$", " ")
    return f" {' '.join(t.split())} "


@dataclass
class Lexicon:
    """terms: " word " or " beginning" to weight; exceptions: " phrase " texts;
    curve: intercept and weights of the features."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: list[float] = field(default_factory=lambda: [-3.0, 3.0, 0.5])

    def __post_init__(self) -> None:
        self._auto = None

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "exceptions": self.exceptions, "curve": self.curve, "_auto": None}

    def _automaton(self) -> ahocorasick.Automaton:
        if self._auto is None:
            self._auto = ahocorasick.Automaton()
            for t, w in self.terms.items():
                self._auto.add_word(t, (len(t), w))
            for t in self.exceptions:
                self._auto.add_word(t, (len(t), None))
            if self.terms:
                self._auto.make_automaton()
        return self._auto

    def matches(self, flat: str) -> list[tuple[int, float]]:
        """(place, weight) of the counted matches in a folded text: of those that begin
        at one word the heaviest, without those inside an exception phrase. Phrases are
        ordered by place once, so time grows with the text and its matches."""
        auto = self._automaton()
        if not self.terms:
            return []
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, w) in auto.iter(flat):
            at = end - n + 1
            if w is None:
                spared.append((at, end))
            else:
                best[at] = max(best.get(at, -1e9), w)
        spared.sort()
        begins, reach = [a for a, _ in spared], list(accumulate((z for _, z in spared), max))
        # a phrase around a place begins at or before it and goes on behind it
        return [(at, w) for at, w in best.items() if not (i := bisect_right(begins, at)) or reach[i - 1] <= at]

    def features(self, text: str | None) -> tuple[float, float, int]:
        """Log of the weight of all matches, and of the weight per 100 words; matches."""
        flat = folded(text)
        found = self.matches(flat)
        total = sum(max(w, 0.0) for _, w in found)
        return math.log1p(total), math.log1p(100 * total / max(flat.count(" ") - 1, 1)), len(found)

    def scored(self, text: str | None) -> tuple[float, int]:
        a, b, n = self.features(text)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), n

    def score(self, text: str | None) -> float:
        return self.scored(text)[0]


def _terms_of(text: str | None) -> set[str]:
    out = set()
    for w in set(folded(text).split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in PREFIXES if len(w) > k)
    return out


def _gain(t: int, n: int, prior: float) -> float:
    """Log-likelihood of t toxic ones among n over the prior share; 0 if not above it."""
    p = t / n
    if p <= prior:
        return 0.0
    return t * math.log(p / prior) + ((n - t) * math.log((1 - p) / (1 - prior)) if t < n else 0.0)


def _gain_of(bad: Column, good: Column, prior: float) -> Column:
    """_gain as an expression over counts of toxic and of clean texts."""
    n = (bad + good).cast("double")
    p = bad / n
    rest = F.when(good > 0, good * F.log((1 - p) / (1 - prior))).otherwise(0.0)
    return F.when(p > prior, bad * F.log(p / prior) + rest).otherwise(0.0)


def _fit_curve(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression by Newton steps, with a weak pull to Lexicon's default curve."""
    start = np.array(Lexicon().curve)
    if not len(y) or y.min() == y.max():
        return start.tolist()
    a, w = np.column_stack([np.ones(len(x)), x]), start.copy()
    pull = np.array([0.05, 0.5, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + pull * (w - start)
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pull)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    w[1:] = np.maximum(w[1:], 0)
    return w.tolist()


BANDS = 4
_SEEDS = np.random.default_rng(11).integers(1, 2**63, 2 * BANDS, np.uint64) | np.uint64(1)


def _bands(text: str | None) -> list[int]:
    """BANDS keys of two minhashes each over five-word shingles; near copies share one."""
    w = (text or "").lower().split()
    shingles = [" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64, len(shingles))
    least = [int((h * s ^ (h >> np.uint64(29)) * s).min()) for s in _SEEDS]
    return [xxhash.xxh64_intdigest(f"{b} {least[2 * b]} {least[2 * b + 1]}") >> 1 for b in range(BANDS)]


def _groups(keys: np.ndarray) -> np.ndarray:
    """A group number for each row of keys; rows that share a key are in one group."""
    label = np.arange(len(keys))
    while True:
        low = label.copy()
        for b in range(keys.shape[1]):
            _, place = np.unique(keys[:, b], return_inverse=True)
            least = np.full(place.max(initial=0) + 1, len(keys))
            np.minimum.at(least, place, low)
            low = np.minimum(low, least[place])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _choose(rows: pd.DataFrame, able: list[tuple]) -> list[tuple[int, float]]:
    """(term, weight), the most telling first. Near copies count as one text, so words
    that a toxic text's many copies share tell no more than in one text. Of terms that
    begin one another, the one that tells most; of equals, the longest."""
    lists = [np.frombuffer(t, "<u4") for t in rows["terms"]]
    terms = np.concatenate([*lists, np.empty(0, "<u4")]).astype(np.int64)
    group = _groups(np.array([np.frombuffer(b, "<i8") for b in rows["bands"]]).reshape(-1, BANDS))
    y = np.zeros(len(rows), bool)
    np.logical_or.at(y, group, rows["y"].to_numpy() > 0)
    heads = np.unique(group)
    bad_all = int(y[heads].sum())
    pairs = np.unique(terms * len(rows) + np.repeat(group, [len(x) for x in lists]))
    term, of = pairs // max(len(rows), 1), pairs % max(len(rows), 1)
    n, bad = np.bincount(term, minlength=len(able)), np.bincount(term[y[of]], minlength=len(able))
    prior = bad_all / max(len(heads), 1)
    if not 0 < prior < 1:
        return []
    out: list[tuple[int, float]] = []
    taken, heads_of = set(), set()  # terms taken, and all that they begin with
    gain = [_gain(int(b), int(k), prior) if b else 0.0 for b, k in zip(bad, n)]
    for i in sorted(range(len(able)), key=lambda i: (-round(gain[i], 6), -len(able[i]), able[i])):
        weight = math.log((bad[i] + 0.5) / (bad_all + 1)) - math.log((n[i] - bad[i] + 0.5) / (len(heads) - bad_all + 1))
        if gain[i] < LEAST_GAIN:
            break
        begins = {able[i][:j] for j in range(1, len(able[i]) + 1)}
        if weight >= math.log(8) and able[i] not in heads_of and not begins & taken:
            out.append((i, weight))
            taken.add(able[i])
            heads_of |= begins
    return out


def learn(docs: DataFrame, labels: DataFrame, exceptions: list[str] | None = None) -> Lexicon:
    """Lexicon from documents (doc_id, text) and bounded labels (doc_id, y).

    The labelled texts, one (the least) of each id, are written once and read by each
    pass. Terms are counted on the executors, by documents and merged in each task before
    the shuffle; their gain is computed there, too, and all that reach LEAST_GAIN are
    looked at. A term is taken if its toxic share is beyond chance for as many terms as
    were seen, with near copies of a text counted once. A pair of words
    around a term becomes an exception phrase if clean documents hold it and toxic ones
    do not. ``exceptions`` adds phrases."""
    spark = docs.sparkSession
    ship(spark)
    # labels are at most a few tens of thousands: sampled_labels bounds them
    own = docs.select(F.col("doc_id").alias("id"), "text").where("text is not null").join(F.broadcast(labels.select("doc_id", "y")), F.col("id") == F.col("doc_id"))
    own = cut(own.select("id", "y", "text"))
    if own.groupBy("id").count().where("count > 1").limit(1).count():
        own = cut(own.groupBy("id", "y").agg(F.min("text").alias("text")))
    own = own.select("text", "y")

    def counted(seen: list[Counter], rows: list[int]) -> pa.RecordBatch:
        keys = list(seen[0].keys() | seen[1].keys())
        cols = [["", *keys], [rows[1], *(seen[1][k] for k in keys)], [rows[0], *(seen[0][k] for k in keys)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()))], ["term", "bad", "good"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter(), Counter()]
        rows = [0, 0]
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[1 if y else 0].update(_terms_of(t))
                rows[1 if y else 0] += 1
                if len(seen[0]) + len(seen[1]) > HELD_TERMS:
                    yield counted(seen, rows)
                    seen, rows = [Counter(), Counter()], [0, 0]
        yield counted(seen, rows)

    counts = cut(own.mapInArrow(count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where("bad > 2 or term = ''"))
    total = counts.where("term = ''").first()
    if total is None or not total.bad or not total.good:
        return Lexicon(exceptions=_phrases(exceptions))
    # terms that pass are words of toxic texts of the sample, so the sample bounds them
    able = [r.term for r in counts.where("term <> ''").where(_gain_of(F.col("bad"), F.col("good"), total.bad / (total.bad + total.good)) >= LEAST_GAIN).select("term").orderBy("term").collect()]
    number = {t: i for i, t in enumerate(able)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a document: its label, the numbers of its candidates, and its bands."""
        for b in batches:
            found = [np.array(sorted(number[t] for t in _terms_of(x.as_py()) & number.keys()), "<u4").tobytes() for x in b.column(0)]
            bands = [np.array(_bands(x.as_py()), "<i8").tobytes() for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.binary()), pa.array(bands, pa.binary())], ["y", "terms", "bands"])

    rows = own.mapInArrow(held, "y int, terms binary, bands binary").toPandas() if able else None  # at most the sample's rows
    kept = {able[i]: w for i, w in _choose(rows, able)} if able else {}
    out = Lexicon(kept, _phrases(exceptions))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter(), Counter()]
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                flat = folded(t)
                words = flat.split()
                number, n, last = {}, 0, 0
                for at in sorted(at for at, _ in out.matches(flat)):
                    n, last = n + flat.count(" ", last, at), at
                    number[at] = n
                seen[1 if y else 0].update({f" {words[i]} {words[i + 1]} " for k in number.values() for i in (k - 1, k) if 0 <= i < len(words) - 1})
        yield counted(seen, [0, 0])

    if kept:
        pairs = own.mapInArrow(around, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        spared = pairs.where("bad = 0 and good >= 3 and term <> ''").select("term").collect()  # all of them: pairs around terms in the sample
        out = Lexicon(kept, sorted({*out.exceptions, *(r.term for r in spared)}))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [out.features(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64()), b.column(1)], ["a", "b", "y"])

    pdf = own.mapInArrow(measure, "a double, b double, y int").groupBy("a", "b", "y").count().toPandas()  # a row for each labelled one at most
    x, y = np.repeat(pdf[["a", "b"]].to_numpy(), pdf["count"], axis=0), np.repeat(pdf["y"].to_numpy(float), pdf["count"])
    out.curve = _fit_curve(x, y)
    return out


def _phrases(texts: list[str] | None) -> list[str]:
    return [folded(t) for t in texts or [] if folded(t) != " "]


def fit(spark: SparkSession, docs: DataFrame, sf_dir: str, max_train: int = MAX_TRAIN) -> Lexicon:
    """Lexicon from ``docs`` and the labels of ``sf_dir`` outside the held-out fold."""
    return learn(docs, sampled_labels(spark, sf_dir, "toxic", FOLDS, HELD_OUT, max_train))


def toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, score (0 to 1), predicted (score >= 0.5),
    n_hits. Null and empty texts have no match and get the curve's lowest score; a null
    id is not held out. Repeated rows keep their rows; other columns are ignored,
    whatever their names; an empty table gives no rows."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [lexicon.scored(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], ["doc_id", "score", "n_hits"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, n_hits long")
    return rows.select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_hits",
    )


def clean_documents(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows with a score below 0.5, with all their columns: a filter in one scan."""
    ship(docs.sparkSession)

    @F.pandas_udf("boolean")
    def gone(texts: pd.Series) -> pd.Series:
        return pd.Series([lexicon.score(t) >= 0.5 for t in texts], dtype=bool)

    return docs.where(~gone(F.col("text")))


def corpus_lexicon(spark: SparkSession, sf_dir: str) -> Lexicon:
    return fit(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir)
