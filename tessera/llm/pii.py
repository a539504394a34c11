"""Personal data by weak supervision: labelers vote on candidate spans, expectation
maximisation estimates how reliable each labeler is, and a span classifier learns from the
probabilities that come out.

Candidates of a kind are the strict ones (``base``, which stay whatever the model says) and
looser ones: addresses with "at" and "dot" spelt out, IPv6 and defanged addresses, card
numbers of other lengths or separators, phone numbers without a plus. Six labelers look at
each: pattern, check (Luhn, ranges, lengths), gazetteer (endings, issuers, country codes,
dates), words around it, characters next to it, and repetition in it. Each says yes, no
or nothing.

Votes and shape of a candidate are one of at most PATTERNS codes. Spark counts the codes
over all documents; only these counts reach the driver, where both models are fitted, so
nothing that is fitted on grows with the corpus, and the texts are read once.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import ship, work_folder

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "check", "gazetteer", "context", "neighbours", "repetition")
DIGIT_BINS, SEPARATORS = (1, 8, 11, 14, 16, 17), ("none", "space", "hyphen", "dot", "mixed")
PATTERNS = len(KINDS) * 3 ** len(LABELERS) * (len(DIGIT_BINS) + 1) * len(SEPARATORS)
#: What the labelers are taken to be before the counts are seen, and how much that weighs: a
#: share of the candidates of the kind, plus a few. Rows: no, nothing, yes.
PRIOR = {True: (0.06, 0.34, 0.6), False: (0.5, 0.35, 0.15)}
PRIOR_SHARE, PRIOR_ROWS = 0.25, 20.0
ADDED_FROM = 0.5

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*+")
_DIGITS = re.compile(r"[0-9]+(?:[ -][0-9]+)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_AT = re.compile(r"\s?[\[({<]\s?(?:at|arroba|@)\s?[\])}>]\s?|\s(?:at|arroba)\s(?=[A-Za-z0-9-]+\s(?:dot|punto|point|punkt)\s)", re.I)
_SPELT = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\s?[\[({<]\s?(?:dot|punto|point|punkt|\.)\s?[\])}>]\s?|\s(?:dot|punto|point|punkt)\s)[A-Za-z0-9-]+)+", re.I)
_SIX = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:|::)(?:[0-9A-Fa-f]{0,4}:){1,7}[0-9A-Fa-f]{0,4}(?![0-9A-Fa-f:])")
_DEFANGED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))[0-9]{1,3}){3}(?![0-9])", re.I)
_LONG = re.compile(r"[0-9]+(?:[ .-][0-9]+)*+")
_LOOSE_PHONE = re.compile(r"(?<![0-9])\(?[0-9]++(?:[ ().-]{1,2}[0-9]++)++")
#: Texts without any of this have no candidate.
_ANY = r"[0-9@]|::|(?i:[\[({<]\s?at\s?[\])}>]|[\[({<]\s?arroba\s?[\])}>]|\s(?:at|arroba)\s[a-z0-9-]+\s(?:dot|punto|point|punkt)\s)"

# Gazetteers and words of the context labeler.
_ENDINGS = set("com org net edu gov mil int info io co ai app dev de fr es it uk us eu ch at nl be pt pl se no dk fi ie ca au nz jp cn in br mx ar cl ru".split())
_FILES = set("png jpg jpeg gif svg js css py java html htm php xml json txt pdf zip exe dll".split())
_COUNTRY = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 351 352 353 354 358 380 420 421 852 966 971 972".split())
_WORDS = {
    "email": r"e-?mail|mail|contact|correo|courriel|write|reach|kontakt",
    "ip": r"\bips?\b|ipv[46]|address|host|server|client|login|adresse",
    "card": r"card|visa|master|amex|payment|pay|credit|debit|karte|tarjeta|carte|cc\b",
    "phone": r"phone|tel\b|t[eé]l[eé]f|call|mobile|cell|fax|sms|whatsapp|contact|ruf|llam|appel",
}
_FOR = {k: re.compile(w, re.I) for k, w in _WORDS.items()}
_AGAINST = re.compile(r"version|\bv\.?\s?$|section|isbn|order|invoice|sku|token|hash|sha|md5|build|release|chapter|serial|license|licence|\bid\b|\bkey\b|password|price|date", re.I)


def base_emails(text: str) -> list[tuple[int, int]]:
    """Matches of the strict pattern; each address sign is looked at once, so a long run
    without one costs nothing."""
    out, end, before = [], 0, -1
    at = text.find("@")
    while at >= 0:
        left = text[max(end, before + 1) : at]
        n = len(left) - len(left.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if n else None
        if m:
            out.append((at - n, m.end()))
            end = m.end()
        before, at = at, text.find("@", max(at + 1, end))
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_ips(text: str) -> list[tuple[int, int]]:
    """Four parts of a dotted chain after the other; those with a part above 255 go."""
    out = []
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(_octet, four)):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DIGITS.finditer(text):
        if 16 <= m.end() - m.start() <= 37 and 16 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
            out.append(m.span())
    return out


def base_phones(text: str) -> list[tuple[int, int]]:
    # a match ends at its last digit; the signs between may be many
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_only_digits(m[0])) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = zip(KINDS, (base_emails(text), base_ips(text), base_cards(text), base_phones(text)))
    return [(kind, s, e) for kind, spans in found for s, e in spans]


class Taken:
    """Spans that do not overlap, by place."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def free(self, s: int, e: int) -> bool:
        i = bisect_left(self.starts, e)
        return i == 0 or self.ends[i - 1] <= s

    def add(self, s: int, e: int) -> None:
        i = bisect_right(self.starts, s)
        self.starts.insert(i, s)
        self.ends.insert(i, e)


def loose_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Wider candidates, ascending within a kind; the caller drops those on base spans."""
    end = 0
    for m in _AT.finditer(text):
        left = text[max(end, m.start() - 64) : m.start()]  # a local part has 64 characters at most
        n = len(left) - len(left.rstrip(_LOCAL))
        d = _SPELT.match(text, m.end()) if n else None
        if d:
            yield "email", m.start() - n, d.end()
            end = d.end()
    for m in _SIX.finditer(text):
        if _six(m[0]):  # times of day are not
            yield "ip", m.start(), m.end()
    for m in _DEFANGED.finditer(text):
        yield "ip", m.start(), m.end()
    for m in _LONG.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= len(_only_digits(m[0])) <= 19:
            yield "card", m.start(), m.end()
    for m in _LOOSE_PHONE.finditer(text):
        if 8 <= m.end() - m.start() <= 30 and 7 <= len(_only_digits(m[0])) <= 15:
            yield "phone", m.start(), m.end()


def _six(s: str) -> bool:
    try:
        return not ipaddress.IPv6Address(s).is_unspecified
    except ValueError:
        return False


def _issuer(d: str) -> bool:
    n = len(d)
    return (d[0] == "4" and n in (13, 16, 19)) or (n == 16 and ("51" <= d[:2] <= "55" or "2221" <= d[:4] <= "2720" or d[:4] == "6011" or d[:2] in ("65", "35"))) or (n == 15 and d[:2] in ("34", "37"))


def _date(s: str) -> bool:
    parts = [int(p) for p in re.findall(r"[0-9]+", s)[:3] if len(p) <= 4]
    return len(parts) == 3 and (1000 <= parts[0] <= 2999 and parts[1] <= 12 and parts[2] <= 31 or parts[0] <= 31 and parts[1] <= 31 and 1000 <= parts[2] <= 2999)


def _check(kind: str, s: str, d: str) -> int:
    if kind == "card":
        return 1 if luhn(d) else -1
    if kind == "phone":
        return 1 if 10 <= len(d) <= 13 else 0 if len(d) > 7 else -1
    if kind == "ip":
        if ":" in s:
            return 1
        return 1 if all(map(_octet, re.findall("[0-9]+", s))) else -1
    last = re.split(r"[^A-Za-z0-9-]+", s.rstrip(")]}> "))[-1]
    return 1 if last.isalpha() and 2 <= len(last) <= 24 else -1


def _gazetteer(kind: str, s: str, d: str) -> int:
    if kind == "card":
        return 1 if _issuer(d) else -1
    if kind == "phone":
        if _date(s):
            return -1
        d = d[2:] if d[:2] == "00" else d
        plain = s[0] != "+" and not s.startswith("00")
        groups = [len(x) for x in re.findall("[0-9]+", s)]
        if plain:  # ten digits by three, three and four, or a trunk zero with groups
            return 1 if groups[-3:] == [3, 3, 4] and len(d) in (10, 11) or (s.lstrip("(")[0] == "0" and len(groups) >= 2 and len(d) in (9, 10, 11)) else 0
        return 1 if any(d[:n] in _COUNTRY for n in (1, 2, 3)) else -1
    if kind == "ip":
        if ":" in s:
            return 0
        return -1 if s.split(".")[0] in ("0", "127", "255") else 0
    last = re.split(r"[^A-Za-z0-9-]+", s)[-1].lower()
    return 1 if last in _ENDINGS else -1 if last in _FILES else 0


def votes(text: str, kind: str, s: int, e: int, base: bool) -> tuple[int, ...]:
    """What the six labelers say of a span: 1, -1 or 0."""
    span = text[s:e]
    d = _only_digits(span)
    near = text[max(0, s - 40) : s]
    context = -1 if _AGAINST.search(near) else 1 if _FOR[kind].search(near) or _FOR[kind].search(text[e : e + 20]) else 0
    left, right = text[s - 1 : s] if s else "", text[e : e + 1]
    # a point or comma after a span ends a sentence, one before a digit goes on
    joined = (left and (left.isalnum() or left in "_=\"'/#$€-+.")) or (right and (right.isalnum() or right in "_=\"'/#%€$@-")) or (right in (".", ",") and text[e + 1 : e + 2].isalnum())
    distinct = len(set(d))
    again = -1 if d and kind != "email" and (distinct <= 2 or (len(d) > 6 and d in "01234567890123456789")) else 0
    layout = kind == "email" or (kind == "ip") or (kind == "card" and len(d) in (13, 15, 16)) or (kind == "phone" and _gazetteer(kind, span, d) == 1)
    return 1 if base else 0 if layout else -1, _check(kind, span, d), _gazetteer(kind, span, d), context, -1 if joined else 1, again


def code_of(text: str, kind: str, s: int, e: int, base: bool) -> int:
    """Votes and shape of a span as one number below PATTERNS."""
    span = text[s:e]
    signs = {c for c in span if c in " -."} if kind != "email" else set()
    sep = 0 if not signs else 4 if len(signs) > 1 else {" ": 1, "-": 2, ".": 3}[signs.pop()]
    code = KINDS.index(kind)
    for v in votes(text, kind, s, e, base):
        code = code * 3 + v + 1
    return (code * (len(DIGIT_BINS) + 1) + bisect_right(DIGIT_BINS, len(_only_digits(span)))) * len(SEPARATORS) + sep


def decode(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """kind, votes (0, 1, 2 for no, nothing, yes), bin of digits, separator of codes."""
    sep, codes = codes % len(SEPARATORS), codes // len(SEPARATORS)
    bins, codes = codes % (len(DIGIT_BINS) + 1), codes // (len(DIGIT_BINS) + 1)
    said = np.empty((len(codes), len(LABELERS)), np.int64)
    for i in reversed(range(len(LABELERS))):
        said[:, i], codes = codes % 3, codes // 3
    return codes, said, bins, sep


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, code) of all candidates; base ones are those whose pattern says yes."""
    base = base_spans(text)
    taken = Taken((s, e) for _, s, e in base)
    out = [(s, e, code_of(text, k, s, e, True)) for k, s, e in base]
    return out + [(s, e, code_of(text, k, s, e, False)) for k, s, e in loose_spans(text) if taken.free(s, e)]


def is_base(code: int) -> bool:
    return code // ((len(DIGIT_BINS) + 1) * len(SEPARATORS)) // 3 ** (len(LABELERS) - 1) % 3 == 2


def kind_of(code: int) -> int:
    return code // ((len(DIGIT_BINS) + 1) * len(SEPARATORS)) // 3 ** len(LABELERS)


@dataclass
class Model:
    """Reliabilities by kind (share of true spans; what each labeler says of true and of
    false ones) and the classifier's probability of every code that occurs."""

    shares: dict[str, float]
    says: dict[str, np.ndarray]
    scores: dict[int, float]

    def added(self) -> dict[int, float]:
        return {c: p for c, p in self.scores.items() if p >= ADDED_FROM and not is_base(c)}


def estimate(said: np.ndarray, n: np.ndarray, tolerance: float = 1e-9) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation maximisation over vote patterns and their counts: the share of true
    spans, P(vote | true or false) by labeler, and each pattern's probability."""
    prior = np.array([PRIOR[False], PRIOR[True]])
    weight = PRIOR_SHARE * n.sum() + PRIOR_ROWS
    share, says = 0.5, np.repeat(prior[None], said.shape[1], 0)
    last = -np.inf
    while True:
        logs = np.stack([np.log(p) + sum(np.log(says[j, y])[said[:, j]] for j in range(said.shape[1])) for y, p in ((0, 1 - share), (1, share))])
        top = logs.max(0)
        total = top + np.log(np.exp(logs - top).sum(0))
        true = np.exp(logs[1] - total)
        # what the steps raise: likelihood and prior together, so the loop ends
        now = float((n * total).sum() + weight * (prior * np.log(says)).sum() + weight * np.log(share * (1 - share)) / 2)
        if now - last < tolerance * max(1.0, abs(now)):
            return share, says, true
        last = now
        share = float(((n * true).sum() + weight / 2) / (n.sum() + weight))
        for y, r in ((0, 1 - true), (1, true)):
            for j in range(said.shape[1]):
                seen = np.bincount(said[:, j], weights=n * r, minlength=3) + weight * prior[y]
                says[j, y] = seen / seen.sum()


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by damped Newton steps."""
    w = np.zeros(x.shape[1])

    def loss(w):
        z = x @ w
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + ridge * (w @ w) / 2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (p - y)) + ridge * w)
        size = 1.0
        while (then := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        if now - then < 1e-10 * max(1.0, abs(now)):
            break
        w, now = w - size * step, then
    return w


def fit(codes: np.ndarray, n: np.ndarray) -> Model:
    """Both models from the counts of the codes."""
    shares, reliable, scores = {}, {}, {}
    kinds, said, bins, sep = decode(codes)
    for k, kind in enumerate(KINDS):
        at = np.flatnonzero(kinds == k)
        if not len(at):
            continue
        shares[kind], reliable[kind], true = estimate(said[at], n[at].astype(float))
        x = np.concatenate([np.ones((len(at), 1)), *(np.eye(3)[said[at, j]][:, [0, 2]] for j in range(len(LABELERS))), np.eye(len(DIGIT_BINS) + 1)[bins[at]], np.eye(len(SEPARATORS))[sep[at]]], 1)
        w = logistic(x, true, n[at].astype(float))
        scores |= dict(zip(codes[at].tolist(), (1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))).tolist()))
    return Model(shares, reliable, scores)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, starts, ends, codes): the candidates of each document, written once."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), *((x, pa.list_(pa.int64())) for x in ("starts", "ends", "codes"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            some = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, _ANY), False).to_numpy(zero_copy_only=False))
            found: list[list] = [[] for _ in range(b.num_rows)]
            for i in some.tolist():
                found[i] = candidates(texts[i].as_py())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([[c[k] for c in f] for f in found], pa.list_(pa.int64())) for k in range(3))], schema=schema)

    folder = work_folder(docs.sparkSession, "spans")
    docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, starts array<long>, ends array<long>, codes array<long>").write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def learn(found: DataFrame) -> Model:
    """The models of all candidates. At most PATTERNS rows come to the driver."""
    rows = found.select(F.explode("codes").alias("code")).groupBy("code").count().orderBy("code").collect()
    return fit(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64))


def choose(spans: list[tuple[int, int, int]], added: dict[int, float]) -> list[tuple[int, int, int, bool, float]]:
    """(kind, start, end, base, score) of base spans and of added ones, by kind and start. Of
    added spans that overlap, the likelier stays, then the longer, then the first."""
    base = [(kind_of(c), s, e, True, 1.0) for s, e, c in spans if is_base(c)]
    more, taken = [], Taken()
    for p, e, s, c in sorted(((-added[c], s - e, s, c) for s, e, c in spans if c in added)):
        if taken.free(s, s - e):
            taken.add(s, s - e)
            more.append((kind_of(c), s, s - e, False, -p))
    return sorted(base + more)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id and spans, an array of (kind, start, stop, base, score) by
    kind (email, ip, card, phone) and start; places are code points, the end exclusive.

    Base spans are those of the strict patterns, leftmost and not overlapping within their
    kind, and always stay, with a score of 1; the others are added by the span classifier and
    overlap none of these. Null and empty texts have none. Repeated rows, and rows without an
    id, keep their rows; other columns are ignored, whatever their names; an empty table
    gives no rows. Texts are taken whole, in time that grows with their length."""
    found = scan(docs, id_col, text_col)
    added = learn(found).added()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])
        for b in batches:
            out = []
            for s, e, c in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                out.append([{"kind": KINDS[k], "start": i, "stop": j, "base": is_it, "score": p} for k, i, j, is_it, p in choose(list(zip(s, e, c)), added)] if c else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(kind))], ["doc_id", "spans"])

    return found.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,stop:long,base:boolean,score:double>>")


def mask(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in angle brackets. Ids
    are taken to be unique; a text without a row in ``found`` stays."""
    spans = found.select(F.col("doc_id").alias("__id"), F.sort_array(F.transform("spans", lambda x: F.struct(x["start"], x["stop"], x["kind"]))).alias("__spans"))
    text = F.col(text_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def put(acc, x):
        # spans of two kinds may share characters: what an earlier one took is not given again
        kept = F.substr(text, (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(F.concat(acc["out"], kept, F.lit("<"), x["kind"], F.lit(">")).alias("out"), F.greatest(acc["at"], x["stop"]).alias("at"))

    masked = F.aggregate("__spans", start, put, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"))))
    joined = docs.join(spans, docs[id_col] == spans["__id"], "left")
    return joined.withColumn(text_col, F.when(F.size("__spans") > 0, masked).otherwise(text)).drop("__id", "__spans")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans as text."""

    def base_of(kind: str):
        return lambda x: x["base"] & (x["kind"] == kind)

    base = F.filter("spans", lambda x: x["base"])
    as_text = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))))
    return found.select(
        "doc_id",
        *(F.size(F.filter("spans", base_of(k))).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(as_text(base), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
    )
