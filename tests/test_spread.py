"""Texts are dealt out before they are parsed, and rows are passed on in large batches."""

from pyspark.sql import functions as F

from tessera.plans import modules
from tessera.session import spread, stored
from tessera.sources import yang


def test_a_small_table_of_much_work_is_many_tasks(spark, data):
    files = modules._files(spark, data, m=modules._MAIN)
    tasks = files.where("file <> 'base.yang'").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) >= 3 and max(t["count"] for t in tasks) < sum(t["count"] for t in tasks) / 2


def test_tasks_grow_with_the_rows(spark):
    assert spread(spark.range(100_000, numPartitions=1), 1000).rdd.getNumPartitions() >= 100
    assert spread(spark.range(0), 1000).count() == 0


def test_files_share_batches(spark):
    files = spark.createDataFrame([(f"{i}.yang", f"module m{i} {{ leaf x {{ type int8; }} }}") for i in range(500)], "file string, text string").coalesce(1)

    def sizes(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([sum(1 for _ in batches)], pa.int64())], ["n"])

    for rows in (yang.nodes(files), yang.statements(files)):
        assert rows.select("file").count() == 1500
        assert rows.select("file").mapInArrow(sizes, "n long").collect()[0].n < 10


def test_stored_rows_know_their_size(spark):
    rows = stored(yang.nodes(spark.createDataFrame([(f"{i}.yang", "module m { " + "leaf x { type int8; } " * 50 + "}") for i in range(20)], "file string, text string")))
    assert rows.inputFiles() and rows.count() == 20 * 101


def test_positions_of_tokens():
    assert list(yang.tokens('a // n\n "b" /* x\n y */ + \'c\'\n{ d/e; } /* open')) == [("word", "a", 1), ("string", "bc", 2), ("mark", "{", 4), ("word", "d/e", 4), ("mark", ";", 4), ("mark", "}", 4), ("word", "/", 4), ("word", "*", 4), ("word", "open", 4)]
    assert list(yang.tokens("x" + " " * 200_000)) == [("word", "x", 1)]


def test_a_comparison_keeps_what_its_steps_share(spark, monkeypatch):
    from tessera.plans import schema_diff
    from tessera.sources import rules_xml

    files = lambda t: spark.createDataFrame([("m.yang", f"module m {{ prefix p; container top {{ leaf a {{ type {t}; }} }} }}")], "file string, text string")
    c = schema_diff.compare_files(files("int8"), files("int16"), spark.createDataFrame(rules_xml.rule_rows(modules.RULES), rules_xml.RULES), moves=False)
    # tables of the shared folder, not plans that parse the texts once more for each reader
    assert all(t.inputFiles() for t in (c.old.modules, c.new.modules, c.changes, c.details))
    assert [(r.norm_path, r.action) for r in c.changes.collect()] == [("top/a/type", "changed")]
