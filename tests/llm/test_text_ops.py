import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from helpers import TEXTS, empty, messy
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, line_dedup, quality, simhash, token_counts, token_store, toxicity
from tessera.llm._common import filesystem, work_folder

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# --- SimHash -----------------------------------------------------------------


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps):
    label = dict(zip(range(len(ids)), range(len(ids))))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                label[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(ids))]


@pytest.mark.parametrize("hot, sent", [(1000, 100_000), (2, 100_000), (2, 0)])
def test_fingerprints_and_components(spark, monkeypatch, hot, sent):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "BROADCAST_HOT", sent)
    rng = random.Random(5)
    base = [" ".join(rng.choice("ab cd ef gh ij kl mn op".split()) for _ in range(60)) for _ in range(12)]
    rows = list(TEXTS)
    for i in range(60):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(["zz", "Yy", "ab"])
        rows.append((100 + i, " ".join(w)))
    fps = [slow_fingerprint(t) for _, t in rows]
    want = sorted(map(repr, zip([d for d, _ in rows], [f"{x:016x}" for x in fps], slow_components([d for d, _ in rows], fps))))
    got = simhash.simhash_components(messy(spark, rows))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_links_find_every_pair(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(6):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 5)):
                y ^= 1 << b
            fps.add(y)
    fps = sorted(fps)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    got = simhash.links(spark.createDataFrame([(i, x) for i, x in enumerate(signed)], "node long, fp long")).collect()
    want = {(i, j, (fps[i] ^ fps[j]).bit_count()) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 3}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 201)], "a long, b long")
    got = dict(map(tuple, simhash.components(edges).collect()))
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}


def test_keep_first(spark):
    docs = messy(spark)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    found = {r.doc_id for r in kept.collect()}
    assert 1 in found and 2 not in found and len(found & {3, 4, 5}) == 1
    assert kept.count() == len(found)
    assert not simhash.keep_first(empty(spark)).count()


# --- decontamination ---------------------------------------------------------


def slow_contamination(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, names = set(), set()
    for name, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        for i in range(max(len(w) - 12, 1) if w else 0):
            win = w[i : i + 13]
            for at in range(len(words) - len(win) + 1):
                if words[at : at + len(win)] == win:
                    hit.update(range(at, at + len(win)))
                    names.add(str(name))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(words), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("limit", [decontam.MAX_WINDOWS, 3])
def test_decontamination(spark, limit):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["a", "B", "Cé", "d1", "E"]) for _ in range(n))
    items = [(1, say(30)), (2, say(15)), (10, "b A"), (3, say(13)), (4, None), (5, "?!"), (None, say(14)), (3, "zz yy")]
    rows = list(TEXTS) + [(50 + i, " ".join([say(20), rng.choice(items)[1] or "", say(rng.randint(0, 400))]).replace(" ", rng.choice([" ", "-", ". "]))) for i in range(25)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(messy(spark, rows), bench, max_windows=limit).collect()
    named = [("null" if i is None else i, t) for i, t in items]
    want = sorted(repr((d, *slow_contamination(t, named))) for d, t in rows)
    assert sorted(repr((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in got) == want
    texts = {r[0]: r[1] for r in rows}
    for r in got:  # the spans lie on the hit words of the original text
        assert sum(len(decontam.words_of(texts[r.doc_id][s.start : s.stop])) for s in r.spans) == r.n_hit
    kept = decontam.clean_documents(messy(spark, rows), bench, max_windows=limit)
    assert kept.count() == sum(not r.contaminated for r in got)


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(messy(spark), bench).where("n_hit > 0 or contaminated").count() == 0
    assert decontam.decontaminate(empty(spark), bench).count() == 0


# --- toxicity ----------------------------------------------------------------


def test_folding():
    assert toxicity.folded("Y0u 1D10T!") == " you idiot "
    assert toxicity.folded("іdіоt MÖRÖN") == " idiot moron "
    assert toxicity.folded("ju$$ 100 $tupid a$$ $5 @@") == " juss 100 stupid ass 5 "  # substitutions end words, too
    assert toxicity.folded("１d𝟏0т ⓕⓞⓞ") == " idiot foo "
    assert toxicity.folded(None) == toxicity.folded("") == "  ".replace("  ", "  ")
    long = "a1" * 100_000
    assert toxicity.folded(long).strip() == "ai" * 100_000


def test_lexicon_matches():
    lex = toxicity.Lexicon({" idiot ": 5.0, " lowei": 4.0, " trash ": 3.0}, [" trash can "])
    count = lambda t: len(lex.matches(toxicity.folded(t)))
    assert count("idiot, idiots and idiot") == 2
    assert count("loweisch Loweiung xlowei") == 2
    assert count("a trash can and trash") == 1
    assert lex.score("idiot trash") > lex.score("idiot trash" + " fine" * 500) > lex.score("fine") == lex.score(None)


def test_toxicity_learns(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["sun", "moon", "tree", "rain", "leaf", "bird", "hill"]) for _ in range(n))
    rows, labels = [], []
    for i in range(1200):
        bad = i % 5 == 0
        t = say(rng.randint(5, 60))
        if bad:
            t += f" {rng.choice(['gr0bble', 'grobbleung', 'GROBBLE', 'wretch'])} " + say(4)
        elif i % 80 == 1:
            t += " wretch excepted " + say(3)
        rows.append((i, t))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lex = toxicity.learn(docs, spark.createDataFrame(labels[:800], "doc_id long, y int"))
    got = {r.doc_id: r for r in toxicity.toxicity(docs, lex).collect()}
    assert all(got[i].predicted == y for i, y in labels[800:])
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    assert toxicity.clean_documents(docs, lex).count() == sum(1 - y for _, y in labels)
    assert toxicity.toxicity(messy(spark), lex).count() == len(TEXTS) and not toxicity.toxicity(empty(spark), lex).count()


def slow_score(lex, text):
    """The lexicon's score, term by term at each place of the folded text."""
    flat = toxicity.folded(text)
    spared = {i for p in lex.exceptions for at in range(len(flat)) if flat.startswith(p, at) for i in range(at, at + len(p) - 1)}  # its last space begins the next word
    total = 0.0
    for at in range(len(flat)):
        found = [w for t, w in lex.terms.items() if flat.startswith(t, at)]
        if found and at not in spared:
            total += max(*found, 0.0)
    z = lex.curve[0] + lex.curve[1] * np.log1p(total) + lex.curve[2] * np.log1p(100 * total / max(len(flat.split()), 1))
    return 1 / (1 + np.exp(-min(max(z, -30), 30)))


def test_toxicity_against_a_slow_walk(spark, data):
    lex = toxicity.corpus_lexicon(spark, data)
    lex = toxicity.Lexicon({**lex.terms, " the ": 1.5, " wo": 0.5, " dark ": 2.0}, [*lex.exceptions, " dark woods "], lex.curve)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [r for r in TEXTS if r[0] != 8] + [(90, "the dark woods, the dark"), (91, "the dark woods, the dark")]
    got = sorted(repr((r.doc_id, round(r.score, 9), r.predicted)) for r in toxicity.toxicity(messy(spark, rows), lex).collect())
    assert got == sorted(repr((d, round(s, 9), int(s >= 0.5))) for d, s in ((d, float(slow_score(lex, t))) for d, t in rows))


def test_toxicity_of_very_long_texts():
    """Nothing but terms and exceptions: time grows with the length."""
    import time

    lex = toxicity.Lexicon({" dark ": 2.0, " wo": 0.5}, [" dark woods ", " the dark "])
    took = []
    for n in (100_000, 400_000):
        text = "dark woods the dark wood " * n
        began = time.process_time()
        got = lex.matches(toxicity.folded(text))
        took.append(time.process_time() - began)
        assert len(got) == n and {w for _, w in got} == {0.5}
    assert took[1] < 10 * took[0]


def test_lexicon_has_no_cap():
    """All of thousands of telling terms come into the lexicon."""
    import pandas as pd

    n, rng = 6000, np.random.default_rng(5)
    able = [f" w{i}x " for i in range(n)]
    bad = [np.sort(rng.permutation(n)[:20]).astype("<u4") for _ in range(9000)]
    rows = pd.DataFrame({"y": [1] * len(bad) + [0] * 3 * len(bad), "terms": [x.tobytes() for x in bad] + [b""] * 3 * len(bad)})
    rows["bands"] = [np.array([i * 8 + b for b in range(toxicity.BANDS)], "<i8").tobytes() for i in range(len(rows))]
    got = toxicity._choose(rows, able)
    seen = np.bincount(np.concatenate(bad), minlength=n)
    assert {i for i, _ in got} == {i for i in range(n) if seen[i] * np.log(4) >= toxicity.LEAST_GAIN} and len(got) > 5000


def test_least_text_of_a_repeated_id_is_learned(spark):
    docs = spark.createDataFrame([(i % 40, f"mud{i % 2} text {i}" if i % 40 < 8 else f"fine text {i}") for i in range(4000)], "doc_id long, text string")
    assert toxicity.learn(docs, spark.range(40).selectExpr("id as doc_id", "cast(id < 8 as int) as y")).curve


# --- quality -----------------------------------------------------------------


def slow_margin(model, row):
    out = model.base
    for c, t, v in zip(model.cuts, model.tables, row):
        out += t[sum(1 for x in c if x <= v)]
    for (i, j), ci, cj, t in model.pairs:
        out += t[sum(1 for x in ci if x <= row[i])][sum(1 for x in cj if x <= row[j])]
    return out


def test_quality_against_a_slow_walk(spark, data):
    model = quality.fit(spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + list(TEXTS)
    got = sorted((repr(r.doc_id), r.score, r.predicted) for r in quality.quality(messy(spark, rows), model).collect())
    want = sorted((repr(d), 1 / (1 + np.exp(-min(max(slow_margin(model, quality.features(t)), -35), 35)))) for d, t in rows)
    assert len(got) == len(want) and all(a == c and abs(b - e) < 1e-9 and p == (b >= 0.5) for (a, b, p), (c, e) in zip(got, want))


def test_additive_model_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # a pure interaction
    m = quality.train(x[:3000], y[:3000])
    assert ((m.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    assert any(set(p) == {0, 1} for p, *_ in m.pairs)
    assert np.isfinite(quality.train(x[:0], y[:0]).score(x[:2])).all()


def test_quality_edges(spark):
    rng = np.random.default_rng(0)
    x = rng.random((200, len(quality.FEATURES)))
    model = quality.train(x, (x[:, 0] > 0.5).astype(float))
    got = quality.quality(messy(spark), model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.score for r in got if r.doc_id in (3, 4)} == {[r.score for r in got if r.doc_id == 3][0]}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert not quality.quality(empty(spark), model).count()


@pytest.mark.parametrize("name, column", [("quality", "quality"), ("toxicity", "toxic")])
def test_held_out_accuracy(spark, name, column):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = quality.quality(docs, quality.fit(spark, d)) if name == "quality" else toxicity.toxicity(docs, toxicity.corpus_lexicon(spark, d))
    rows = out.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").select("predicted", column).collect()
    assert len(rows) > 50 and sum(r[0] == r[1] for r in rows) / len(rows) > 0.9


# --- token counts ------------------------------------------------------------


def slow_count(word, scores):
    text, low = token_counts.MARK + word, min(scores.values()) - 10
    best = [(0.0, 0)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        options = [(best[end - 1][0] + low, best[end - 1][1] - len(text[end - 1].encode()))]
        options += [(best[s][0] + scores[text[s:end]], best[s][1] - 1) for s in range(end) if text[s:end] in scores]
        best[end] = max(options)
    return -best[-1][1]


def test_token_counts(spark):
    model = token_counts.Pieces.from_file(PIECES)
    rows = [r for r in TEXTS if r[0] not in (7, 8)] + [(20, "unbelievable unbelieving 12345 naïve 漢字漢 ☃☃ abcabc")]
    got = token_counts.token_counts(messy(spark, rows), PIECES).collect()
    want = sorted(repr((d, len((t or "").split()), sum(slow_count(w, model.scores) for w in (t or "").split()))) for d, t in rows)
    assert sorted(repr(tuple(r)) for r in got) == want
    assert not token_counts.token_counts(empty(spark), PIECES).count()
    big = {r.doc_id: r for r in token_counts.token_counts(messy(spark), PIECES).collect()}
    assert big[7].n_tokens == 30_000 * slow_count("word", model.scores)


def test_token_counts_match_a_library():
    from tokenizers import Tokenizer, models

    rng = random.Random(8)
    scores = {c: -8.0 - i * 0.37 for i, c in enumerate("▁abcde")}
    for _ in range(60):
        scores.setdefault("".join(rng.choice("▁abcde" if k == 0 else "abcde") for k in range(rng.randint(2, 5))), -rng.random() * 9)
    lib = Tokenizer(models.Unigram([("<unk>", -50.0), *scores.items()], 0, False))
    mine = token_counts.Pieces(scores)
    words = {"".join(rng.choice("abcde") for _ in range(rng.randint(1, 12))) for _ in range(300)}
    mine.add(words)
    assert all(mine.counts[w] == len(lib.encode("▁" + w).ids) for w in words)


def test_prefixes_are_scored_once(monkeypatch):
    rng = random.Random(9)
    scores = {c: -8.0 - i * 0.37 for i, c in enumerate("▁abc")} | {"".join(rng.choice("abc") for _ in range(3)): -rng.random() * 9 for _ in range(12)}
    model, made = token_counts.Pieces(scores), []
    forward = model._forward
    model._forward = lambda text, end, *rest: made.append(text[:end]) or forward(text, end, *rest)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(400)}
    for part in (set(sorted(words)[::2]), words):
        model.add(part)
    assert sorted(made) == sorted({("▁" + w)[:i] for w in words for i in range(1, len(w) + 2)})
    want = {w: slow_count(w, scores) for w in words}
    assert model.counts == want
    monkeypatch.setattr(token_counts, "NODES", 5)  # planted anew again and again
    again = token_counts.Pieces(scores)
    again.add(words)
    assert again.counts == want and len(again.best) < 20


def test_long_pre_tokens_are_scored_alone(monkeypatch):
    rng = random.Random(10)
    scores = {c: -8.0 - i * 0.37 for i, c in enumerate("▁abc")} | {"".join(rng.choice("abc") for _ in range(4)): -rng.random() * 9 for _ in range(30)}
    model = token_counts.Pieces(scores)
    words = {"".join(rng.choice("abcé") for _ in range(n)) for n in (998, 999, 1000, 5000)}
    model.add(words)
    assert model.counts == {w: slow_count(w, scores) for w in words} and len(model.best) < 2000
    assert token_counts.by_rank({"a": -3.0, "b": 0.0}) == {"a": -math.log(4), "b": 0.0}
    assert token_counts.by_rank({"a": -3.5, "b": 0.0}) == {"a": -3.5, "b": 0.0}


# --- token store -------------------------------------------------------------


def test_token_store(spark):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    passage = " ".join(rng.choice(["alpha", "beta", "gamma", "delta's", "ε1"]) for _ in range(4000))
    rows = list(TEXTS) + [(30 - i, f"intro {i} " + passage) for i in range(6)] + [(40, "<|endoftext|> ΣΑΣ İx \x1c a"), (41, "ét́ ﬁ Ⅳ")]
    docs = messy(spark, rows).repartition(4)
    folder = work_folder(spark, "test-store")
    token_store.write_store(docs, WORDS, folder)
    got = sorted(token_store.read_store(spark, folder).collect(), key=lambda r: r.start)
    lib = Tokenizer.from_file(WORDS)
    ids = {(d, t): [*lib.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows}
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    at = 0
    for r in got:
        raw = next(v for (d, t), v in ids.items() if d == r.doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(raw), zlib.crc32(struct.pack(f"<{len(raw)}I", *raw)))
        at += len(raw)
    assert token_store.verify_manifest(spark, folder) and len(token_store.manifest_root(spark, folder)) == 64
    # each chunk is in one pack only, and the shared passage is stored once
    places = [(n, {a.at: a.pack for a in r.away}.get(i, r.pack)) for r in token_store.read_recipes(spark, folder).collect() for i, n in enumerate(token_store._names(r.names))]
    assert len(set(places)) == len({n for n, _ in places}) < len(places)
    fs, path = token_store.filesystem(folder)
    from pyarrow.fs import FileSelector

    stored = [n for f in fs.get_file_info(FileSelector(f"{path}/packs")) for n in token_store.PackReader(f"file://{f.path}").at]
    assert len(stored) == len(set(stored)) == len({n for n, _ in places})


def test_any_tokenizer_file_gives_the_library_ids():
    from tokenizers import Tokenizer

    texts = [t for _, t in TEXTS if t and len(t) < 1000] + ["It's 12 Naïve  TEXTS's\tend", "don't <|x|> 3rd"]
    for name, known in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = public_tokenizers.path(name)
        mine, lib = token_store.Encoder(path), Tokenizer.from_file(path)
        assert mine.known == known
        assert [np.frombuffer(x, "<u4").tolist() for x in mine.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_repeated_rows_are_dealt_over_shards(spark, monkeypatch):
    docs = spark.createDataFrame([(7, "the same text again")] * 400 + [(i, f"own {i}") for i in range(40)], "doc_id long, text string")
    folder = work_folder(spark, "test-shards")
    recipes = token_store.write_store(docs, WORDS, folder, shards=8)
    assert recipes.where("doc_id = 7").select("shard").distinct().count() > 1
    got = sorted(tuple(r) for r in token_store.read_store(spark, folder).select("start", "doc_id", "n_tokens").collect())
    assert [d for _, d, _ in got] == sorted([7] * 400 + list(range(40)))
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:])) and token_store.verify_manifest(spark, folder)


def test_token_store_when_tasks_run_twice(spark):
    """Packs of an attempt that was lost are in nobody's way, and settling again is no fault."""
    docs = messy(spark).select("doc_id", "text").repartition(3)
    path = WORDS
    folder, clean = work_folder(spark, "test-twice"), work_folder(spark, "test-once")
    fs, at = filesystem(folder)
    fs.create_dir(f"{at}/staging", recursive=True)
    token_store._encode_packs(docs, path, 1, folder).count()
    for f in (folder, clean):
        token_store.write_store(docs, path, f)
    key = lambda f: sorted(repr((r.doc_id, r.start, r.n_tokens, r.ids_crc32)) for r in token_store.read_store(spark, f).collect())
    assert key(folder) == key(clean)
    for _ in range(2):
        w = token_store.PackWriter(f"{folder}/packs/again.pack")
        w.add(b"n" * 32, b"\x01\x00\x00\x00")
        w.close()
    assert token_store.PackReader(f"{folder}/packs/again.pack").at == {b"n" * 32: 0}


def test_empty_token_store(spark):
    folder = work_folder(spark, "test-empty")
    token_store.write_store(empty(spark), WORDS, folder)
    assert token_store.read_store(spark, folder).count() == 0


def test_a_changed_chunk_is_found(spark):
    folder = work_folder(spark, "test-changed")
    token_store.write_store(messy(spark, [(1, "one two three " * 300)]), WORDS, folder)
    fs, path = token_store.filesystem(folder)
    recipes = spark.read.parquet(f"{folder}/recipes").withColumn("names", F.concat(F.expr("substring(names, 2)"), F.lit(b"x")))
    recipes.write.parquet(f"{folder}/other")
    fs.delete_dir(f"{path}/recipes")
    fs.move(f"{path}/other", f"{path}/recipes")
    with pytest.raises(Exception):
        token_store.read_store(spark, folder).count()


def test_chunks_resynchronise():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 49_000, 300), rng.integers(0, 49_000, 20_000)
    parts = lambda x: {bytes(p.astype("<u4").tobytes()) for p in np.split(x, token_store.cuts(x)[:-1])}
    one, two = parts(np.concatenate([a, b])), parts(b)
    assert len(one & two) > 0.8 * len(two)
    for n in (0, 1, 64, 65, 5000):
        z = token_store.cuts(np.zeros(n, np.int64))
        assert z == sorted(z) and (not n or z[-1] == n) and all(y - x <= token_store.MOST for x, y in zip([0, *z], z))


# --- byte-level BPE ----------------------------------------------------------


def test_bpe_is_what_the_library_gives(spark):
    codec = bpe.Codec.get(RANKS, public_tokenizers.PATTERN)
    rows = list(TEXTS) + [(60, " \n\n  it's 12 o'clock  ᲊ  x")]
    for chunk, overlap in ((bpe.CHUNK, bpe.OVERLAP), (1000, 50), (7, 3)):
        few = rows if chunk > 7 else [r for r in rows if r[0] not in (7, 8)]
        got = bpe.encode_documents(messy(spark, few), RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap).collect()
        want = []
        for d, t in few:
            ids = codec.encoding.encode_ordinary(t or "")
            raw = struct.pack(f"<{len(ids)}I", *ids)
            want.append(repr((d, len(ids), raw, hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())))
        assert sorted(repr((r.doc_id, r.n_tokens, bytes(r.ids), r.ids_sha256, r.decoded_sha256)) for r in got) == sorted(want)
    back = bpe.decode_documents(bpe.encode_documents(messy(spark), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, messy(spark).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()))
    assert bpe.encode_documents(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_stitching_random_texts():
    codec, rng = bpe.Codec.get(RANKS, public_tokenizers.PATTERN), random.Random(1)
    al = ["a", "b", "é", " ", "  ", "\n", "1", "!", "'s", " the", "\t", "漢", "😀", "　", "x" * 30]
    for _ in range(400):
        t = "".join(rng.choice(al) for _ in range(rng.randint(0, 120)))
        got = np.frombuffer(bpe.encode_text(codec, t, rng.choice([5, 10, 20]), rng.choice([3, 8, 16])), "<u4").tolist()
        assert got == codec.encoding.encode_ordinary(t)


# --- line dedup --------------------------------------------------------------


def slow_lines(rows, ratio, least):
    blank = lambda x: not x.strip(" \t\r\x0b\x0c")
    pages, seen = {}, {}
    for _, t, s in rows:
        pages[s] = pages.get(s, 0) + 1
        for x in {x for x in (t or "").split("\n") if not blank(x)}:
            seen[s, x] = seen.get((s, x), 0) + 1
    out = []
    for d, t, s in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for x in lines if blank(x) or not (seen[s, x] >= least and seen[s, x] > ratio * pages[s])]
        out.append(repr((d, s, "\n".join(kept) if t is not None else None, len(lines), len(lines) - len(kept))))
    return sorted(out)


def test_line_dedup(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, "\n".join(rng.choice(["menu", "Menu", "", " \t", "foot", f"own {i}", f"own {i}"]) for _ in range(rng.randint(0, 6))), rng.choice(["a", "b", None])) for i in range(80)]
    rows += [(None, None, "a"), (3, "", "c"), (3, "", "c"), (4, "menu\nmenu", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for ratio, least in ((0.1, 3), (0.4, 2)):
        got = line_dedup.drop_boilerplate(docs, ratio=ratio, min_pages=least).select("doc_id", "source", "text", "n_lines", "n_dropped").collect()
        assert sorted(repr(tuple(r)) for r in got) == slow_lines(rows, ratio, least)
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)  # beyond the bound, a join gives the same
    got = line_dedup.drop_boilerplate(docs).select("doc_id", "source", "text", "n_lines", "n_dropped").collect()
    assert sorted(repr(tuple(r)) for r in got) == slow_lines(rows, 0.1, 3)
    clash = messy(spark).withColumn("n_lines", F.lit("mine")).withColumn("drop", F.lit(1))
    out = line_dedup.drop_boilerplate(clash)
    assert set(clash.columns) | {"n_dropped"} == set(out.columns) and out.count() == len(TEXTS)
    assert not line_dedup.drop_boilerplate(empty(spark)).count()
