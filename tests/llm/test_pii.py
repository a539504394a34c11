import hashlib
import random
import re
import time

import numpy as np
import pytest
from helpers import TEXTS, empty, messy

from tessera.llm import pii

# the patterns of the contract, as they stand
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ODD = [
    (30, "a@b.c%x@d.e@f.g a@b a@@b.c @x.y .@-.- a@b.c.d@e.f"),
    (31, "1.2.3.4.5.6.7.8.9 256.1.1.1 01.02.003.0004 1..2.3.4.5 12345.1.1.1 1.2.3"),
    (32, "4111 1111 1111 1111, 4111-1111-1111-1111 41111111-11111111 4111  1111 1111 1111 4111111111111112 12 4111111111111111"),
    (33, "+1 (743) 555-3220 ++49 30 1234567. +1 +12345678901234567 +1(((((((9 +1-2-3-4-5-6-7-8"),
    (34, "été 😀 me@x.org 漢 +33 1 23 45 67 89 ١٢٣.١.١.١"),
]


def brute(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0,
                "phone": lambda: 8 <= len(d) <= 15,
            }[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def check(rows, got):
    assert len(rows) == len(got)
    want = sorted(((i, *(sum(k == x for k, _, _ in b) for x in pii.KINDS), hashlib.sha256(joined(b).encode()).hexdigest()) for i, t in rows for b in [brute(t)]), key=str)
    assert sorted((tuple(r)[:6] for r in got), key=str) == want
    for r in got:
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), x[1]))


def test_base_spans_as_the_patterns_say():
    rng = random.Random(4)
    for _ in range(4000):
        t = "".join(rng.choice("@@..  --++()0123456789aZ_%é4") for _ in range(rng.randrange(60)))
        assert pii.base_spans(t) == brute(t), t
    for _, t in TEXTS + ODD:
        assert pii.base_spans(t or "") == brute(t)


def test_digest_over_odd_rows(spark):
    rows = [*TEXTS, *ODD]
    check(rows, pii.digest(pii.personal_data(messy(spark, rows))).collect())
    assert pii.personal_data(empty(spark)).count() == 0


def test_digest_over_the_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = pii.digest(pii.personal_data(docs)).collect()
    check([tuple(r) for r in docs.select("doc_id", "text").collect()], got)


def test_model_adds_what_the_patterns_miss_and_leaves_the_rest(spark):
    rng = random.Random(1)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = []
    for i in range(300):
        rows.append((i, rng.choice([f"mail me at u{i}@mail.org today", f"call +1 ({digits(3)}) 555-{digits(4)} now", f"seen at {rng.randrange(1, 224)}.{rng.randrange(256)}.7.9 last", f"the number {digits(16)} is odd", f'token = "{digits(10)}ab{digits(9)}"', f"on 20{digits(2)}-0{rng.randrange(1, 9)}-1{digits(1)} or version {digits(1)}.{digits(2)}.{digits(1)}"])))
    odd = {
        1001: ("write to jane.doe [at] mail [dot] example [dot] com please", "email"),
        1002: ("phone (212) 555-0187 for help", "phone"),
        1003: ("host 2001:db8:0:1:1:1:1:1 answered", "ip"),
        1004: ("pay with card 3782 822463 10005 today", "card"),
    }
    clean = {2001: "look at example.com or the dot on page 12", 2002: "born 2001-05-17, isbn 978-3-16-148410-0", 2003: "the number 4111111111111112 is no card", 2004: 'sha "6405768150411590525"', 2005: "at 12:30:45 we met"}
    found = pii.personal_data(messy(spark, rows + [(i, t) for i, (t, _) in odd.items()] + list(clean.items())))
    got = {r.doc_id: [(s.kind, s.base) for s in r.spans] for r in found.collect()}
    assert {i: got[i] for i in odd} == {i: [(k, False)] for i, (_, k) in odd.items()}
    assert {i: got[i] for i in clean} == dict.fromkeys(clean, [])


def test_reliabilities_are_found_again():
    rng = np.random.default_rng(2)
    true = rng.random(20_000) < 0.3
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.6, 0.85])
    hit = rng.random((len(true), 6)) < right
    said = np.where(hit == true[:, None], 2, 0)
    patterns, n = np.unique(said, axis=0, return_counts=True)
    share, says, p = pii.estimate(patterns, n.astype(float))
    order = np.argsort(-says[:, 1, 2] + says[:, 0, 2])
    assert order.tolist() == np.argsort(-right).tolist()
    where = {tuple(x): i for i, x in enumerate(patterns.tolist())}
    guess = np.array([p[where[tuple(x)]] for x in said.tolist()]) > 0.5
    assert (guess == true).mean() > 0.95


@pytest.mark.parametrize("unit", ["a", "1", "1.", "a@", "@", "+1", "+1(", "4111 ", "a at ", "1-", "::", "a@b.", "(at)a", "f:"])
def test_long_texts_in_linear_time(unit):
    took = []
    for n in (20_000, 200_000):
        t = unit * (n // len(unit))
        began = time.process_time()
        pii.candidates(t)
        took.append(time.process_time() - began)
    assert took[1] < 30 * max(took[0], 0.05)


def test_mask(spark):
    docs = messy(spark, [(1, "x me@a.org y +1 222 333 4444 z"), (2, None), (3, "none")])
    got = {r.doc_id: r.text for r in pii.mask(docs, pii.personal_data(docs)).collect()}
    assert got == {1: "x <email> y <phone> z", 2: None, 3: "none"}
