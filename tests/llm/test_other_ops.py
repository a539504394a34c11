import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import ann, warc
from tessera.llm._common import work_folder


def slow_nearest(rows, k):
    vecs = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            vecs[i] = np.array(v, np.float32).astype(float)
    out = []
    for q in sorted(i for i in vecs if i % 20 == 0):
        near = sorted(((-float(vecs[q] @ v), i) for i, v in vecs.items() if i != q and len(v) == len(vecs[q])))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return out


def test_nearest_recall_and_scores(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((5, 32))
    rows = [(i, (rng.standard_normal(32) if i % 3 else centres[i % 5] + 0.1 * rng.standard_normal(32)).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(1500 + i, rows[40][1]) for i in range(40)] + [(40, rows[40][1])]  # ties and a repeated row
    rows += [(2000, None), (2020, [0.0] * 32), (2040, [float("nan")] * 32), (2060, [None] * 32), (2080, []), (None, rows[1][1]), (2100, [1.0, 2.0]), (2101, [3.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in rows], "vec_id long, embedding array<float>, block int, v double, dim string")
    want = slow_nearest(rows, 20)
    for block in (ann.BLOCK, 400):
        got = [tuple(r) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20, block=block, chunk=30).orderBy("query_id", "rank").collect()]
        assert len(got) == len(want)
        assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.95 * len(want)
        exact = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and None not in v}
        assert all(abs(s - float(exact[q] @ exact[i])) < 1e-9 for q, _, i, s in got)
        tied = [i for q, _, i, _ in got if q == 40][:20]
        assert tied == list(range(1500, 1520))
        assert [(q, i) for q, _, i, _ in got if q == 2100] == [(2100, 2101)]
    assert ann.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_with_unequal_norms(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(16) * rng.uniform(0.1, 5)).astype(np.float32).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()}
    want = {(q, i) for q, _, i, _ in slow_nearest(rows, 20)}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)


def test_warc_round_trip(spark):
    html = "<html>" + "é" * 600 + "</html>"
    rows = [(1, "http://a/x y\r\nz", html), (2, None, html), (9, "http://b", html), (9, "http://b", html), (None, "n", html), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "WARC/1.1\r\n\r\n" * 50_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, n int, digest string")
    folder = work_folder(spark, "test-warc")
    index = warc.write_archives(df, folder)
    got = warc.read_archives(spark, folder).collect()
    big = html.encode()
    assert len(got) == len(rows) == index.count()
    kinds = sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    want = []
    for i, _, t in rows:
        raw = (t or "").encode()
        revisit = raw == big and i != 9
        want.append(repr((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None)))
    assert kinds == sorted(want)
    assert all(bytes(r.payload) == next((t or "").encode() for i, _, t in rows if i == r.page_id) for r in got if r.record_type == "response")
    (head, block), = warc.lookup(index, folder, "<urn:page:7>")
    assert head["warc-type"] == "response" and block.endswith(rows[-1][2].encode())
    assert len(warc.lookup(index, folder, "<urn:page:9>")) == 2


def test_warc_of_one_id_with_other_urls(spark, monkeypatch):
    big = "<p>" + "x" * 2000
    rows = [(5, "http://b", big), (5, "http://a", big), (4, "http://c", big), (3, None, big + "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for bound in (warc.BROADCAST_DIGESTS, 0):
        monkeypatch.setattr(warc, "BROADCAST_DIGESTS", bound)
        folder = work_folder(spark, "test-warc-urls")
        warc.write_archives(df, folder)
        got = sorted((r.page_id, str(r.url), r.record_type, r.refers_to) for r in warc.read_archives(spark, folder).collect())
        assert got == [(3, "None", "response", None), (4, "http://c", "revisit", 5), (5, "http://a", "response", None), (5, "http://b", "response", None)]


def test_empty_warc(spark):
    folder = work_folder(spark, "test-warc-empty")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_archives(spark, folder).count() == 0


def test_bundle_seeks_frames(tmp_path):
    w = warc.BundleWriter(f"file://{tmp_path}/b.warc.zst", frame_bytes=500)
    places = [w.add(warc.record(i, "u", b"x" * i, hashlib.sha1(b"x" * i).hexdigest(), None, i)) for i in range(50)]
    w.close()
    with warc.BundleReader(f"file://{tmp_path}/b.warc.zst") as r:
        assert len(r.frames) > 5
        for i in (49, 0, 25):
            head, block = r.record(*places[i][:2])
            assert head["warc-record-id"] == f"<urn:page:{i}>" and block.endswith(b"x" * i)
