import os

from pyspark.sql import functions as F

from tessera.plans import retriever, verify
from tessera.sources import loaders, rules_xml, yang
from tessera.streaming import live

HERE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "schema")


def test_corpus_index_and_query(spark, tmp_path):
    stmts = yang.statements(yang.read_files(spark, f"{HERE}/old"))
    docs = retriever.corpus(stmts)
    rows = {r.display_text: r for r in docs.collect()}
    leaf = rows["leaf tag"]  # the first leaf of its template stays
    assert leaf.skeleton_path == "module/grouping" and leaf.category == "STRUCTURAL" and "leaf code" not in rows
    assert rows["range 0..10"].template == "range <RANGE>" and rows["range 0..10"].tokens == ["<RANGE>"]
    assert rows["x:rights read"].category == "ATTRIBUTE, CONSTRAINT"
    retriever.write_index(docs, f"{tmp_path}/index")
    found = retriever.Retriever(spark, f"{tmp_path}/index").query("range 1..5;", top_k=3).orderBy("rank").collect()
    assert found[0].yang_keyword == "range" and [r["rank"] for r in found] == [1, 2, 3]
    best = retriever.Retriever(spark, f"{tmp_path}/index").identify("size-limit 1..5;").collect()
    assert best


def test_rules_are_learned(spark, tmp_path):
    table = rules_xml.read_rules(spark, f"{HERE}/rules.xml")
    stmts = yang.statements(yang.read_files(spark, f"{HERE}/old"))
    left = retriever.uncovered_statements(stmts, table)
    assert "mark" in {r.keyword for r in left.collect()}
    more = verify.learn_rules(table, left, {"mark": "rights"}.get, f"{tmp_path}/log")
    assert more.where("subject = 'mark'").count() == table.where("subject = 'rights'").count()
    assert spark.read.json(f"{tmp_path}/log").where("added").count() == 1


def test_verification_outcomes(spark):
    d = spark.createDataFrame([(1, "relaxed", "backward-compatible"), (2, "narrowed", "backward-compatible"), (3, None, "backward-compatible"), (4, None, "backward-compatible")], "detail_id int, change string, verdict string")
    assert [r.outcome for r in verify.verify(d).orderBy("detail_id").collect()] == ["confirmed", "conflict", "unverified", "unverified"]
    say = lambda pdf: pdf.assign(decision=["non-backward-compatible" if i == 4 else None for i in pdf["detail_id"]], explanation="")
    assert [r.outcome for r in verify.verify(d, say).orderBy("detail_id").collect()] == ["confirmed", "conflict", "unverified", "conflict"]


def test_loaders(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<a x='1'><b>hi</b></a>")
    (tmp_path / "b.txt").write_text("plain é")
    got = {r.path.rsplit("/", 1)[1]: r for r in loaders.load_documents(spark, str(tmp_path)).collect()}
    assert got["a.xml"].content == "a x=1\n  b: hi" and got["b.txt"].content == "plain é"
    assert loaders.xml_text("no xml <") == "no xml <"


def test_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    os.makedirs(tmp_path / "in")
    events.repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/in")
    stream = live.stream_table(spark, f"{tmp_path}/in", events, 1)
    q = live.windowed_counts(stream, late="100000 hours").writeStream.format("memory").queryName("live_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r.start, r.event_type): r.n for r in live.windowed_counts(events).collect()}
    assert {(r.start, r.event_type): r.n for r in spark.table("live_counts").collect()} == want


def test_modules_are_watched(spark, tmp_path):
    seen = []
    q = live.watch_modules(spark, f"{HERE}/old", lambda df, n: seen.append(df.where(F.col("keyword") == "leaf").count()), f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert sum(seen) == 9
