import hashlib

import public_tokenizers as public
import pytest
import sentencepiece
from helpers import TEXTS, empty, messy
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import alignment

A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
ODD = [
    (20, " two  spaces   and one "),
    (21, "tabs\tand \n lines\n\n  x y 　z  w"),
    (22, "a <|endoftext|> b <s> </s> <0x41> <unk>"),
    (23, "mark ▁ inside"),
    (24, "\x00\x1c \x1f a"),
    (25, " "),
    (26, "   "),
    (27, "漢字かな交じり文 😀😀 été"),
    (28, "don't we'll 12345 x.y.z?!  "),
]


def brute(rows):
    """Bytes of each token, every pair of tokens compared."""
    ta, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    back = {c: bytes([b]) for c, b in alignment.byte_alphabet().items()}
    out, count = [], {}
    for i, text in rows:
        spans = None
        if text:
            raw = (" " + text).encode()
            a = [(x, b"".join(back[c] for c in ta.id_to_token(x))) for x in ta.encode(" " + text, add_special_tokens=False).ids]
            b = [(x, bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode()) for x in sp.encode(text)]
            if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b):
                spans = []
                for toks in (a, b):
                    at, one = 0, []
                    for x, t in toks:
                        one.append((x, at, at + len(t)))
                        at += len(t)
                    spans.append(one)
        if spans is None:
            out.append((i, None))
            continue
        sa, sb = spans
        links, first = [], 0
        for x, s, e in sa:
            while sb[first][2] <= s:
                first += 1
            k = first
            while k < len(sb) and sb[k][1] < e:
                links.append((x, sb[k][0]))
                k += 1
        ends = sorted({e for *_, e in sa} & {e for *_, e in sb})
        groups, p, q = [], 0, 0
        for end in ends:
            ga, gb = [], []
            while p < len(sa) and sa[p][2] <= end:
                ga.append(str(sa[p][0]))
                p += 1
            while q < len(sb) and sb[q][2] <= end:
                gb.append(str(sb[q][0]))
                q += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        for pair in set(links):
            count[pair] = count.get(pair, 0) + 1
        out.append((i, (len(sa), len(sb), groups, links)))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    want = []
    for i, r in out:
        if r is None:
            want.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            na, nb, groups, links = r
            want.append((i, na, nb, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(want, key=str)


def digest(df):
    return sorted((tuple(r) for r in df.drop("pairs", "times").collect()), key=str)


@pytest.mark.parametrize("bound", [alignment.BROADCAST_PAIRS, 0])
def test_against_brute_force(spark, bound):
    rows = [*TEXTS, *ODD]
    assert digest(alignment.alignment(messy(spark, rows), A, B, broadcast_pairs=bound)) == brute(rows)
    assert alignment.alignment(empty(spark), A, B).count() == 0


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert digest(alignment.alignment(docs, A, B)) == brute(rows)


def test_cache_starts_anew_and_texts_stay_whole(spark, monkeypatch):
    aligner = alignment.Aligner(A, B)
    texts = [t for _, t in TEXTS + ODD]
    want, links = aligner.align(texts)
    assert aligner.cuts
    monkeypatch.setattr(alignment, "PARTS", 3)
    again = [aligner.align([t])[0][0] for t in texts]
    assert again == want
    aligner.cuts = False
    aligner.forget()
    assert [aligner.align([t])[0][0] for t in texts] == want


def test_links_come_with_the_row(spark):
    row = alignment.alignment(messy(spark, [(1, "hello world")]), A, B).first()
    assert sum(row.times) == row.n_links == row.n_best and len(row.pairs) == len(row.times)
    assert alignment.alignment(messy(spark, [(1, None), (2, "")]), A, B).agg(F.sum("n_links")).first()[0] == 0
