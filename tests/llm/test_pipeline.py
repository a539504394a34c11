import public_tokenizers
from helpers import messy

import corpus_pipeline
from tessera.llm import bpe, decontam, line_dedup, toxicity
from test_text_ops import RANKS, slow_components, slow_contamination, slow_fingerprint, slow_lines


def test_stages_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    rows = docs.collect()
    lexicon = toxicity.corpus_lexicon(spark, data)
    rows = [r for r in rows if lexicon.score(r.text) < 0.5]
    got = corpus_pipeline.drop_toxic(spark, docs, data)
    assert got.columns == columns and {r.doc_id for r in got.collect()} == {r.doc_id for r in rows}

    got = corpus_pipeline.drop_lines(spark, got, data)
    assert got.columns == columns
    lines = got.collect()
    seen = slow_lines([(r.doc_id, r.text, r.source) for r in rows], line_dedup.RATIO, line_dedup.MIN_PAGES)
    assert sorted(repr((r.doc_id, r.source, r.text)) for r in lines) == sorted(repr(eval(x)[:3]) for x in seen)
    assert all(r.n_chars == len(r.text) for r in lines)

    got = corpus_pipeline.drop_near_copies(spark, got, data)
    assert got.columns == columns
    lines = sorted(lines, key=lambda r: r.doc_id)
    label = slow_components([r.doc_id for r in lines], [slow_fingerprint(r.text) for r in lines])
    left = [r for r, c in zip(lines, label) if r.doc_id == c]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, left))

    got = corpus_pipeline.drop_contaminated(spark, got, data)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    left = [r for r in left if not slow_contamination(r.text, items)[4]]
    assert got.columns == columns and sorted(map(repr, got.collect())) == sorted(map(repr, left))

    codec = bpe.Codec.get(RANKS, public_tokenizers.PATTERN)
    want = {r.doc_id: codec.encoding.encode_ordinary(r.text) for r in left}
    out = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id: r.n_tokens for r in out} == {d: len(x) for d, x in want.items()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "bpe"]


def test_stages_take_awkward_rows(spark, data):
    docs = messy(spark).selectExpr("doc_id", "text", "'en' as lang", "source", "cast(length(text) as long) as n_chars")
    for _, stage in corpus_pipeline.STAGES[:4]:
        for d in (docs, docs.where("false")):
            assert stage(spark, d, data).columns == docs.columns
            stage(spark, d, data).collect()
    assert decontam.contaminated(20, 1) and not decontam.contaminated(21, 1)
