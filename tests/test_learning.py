import uuid

from pyspark.sql import functions as F

from tessera.plans import learning, modules, retriever
from tessera.session import shared_folder
from tessera.sources import reports, rules_xml, yang

OLD = "module m { prefix m; container top { leaf a { type string; } leaf-list b { type string; } anydata c; } }"
NEW = "module m { prefix m; container top { leaf a { type string; } leaf-list bb { type int8; units x; } anydata d; } }"


def test_loop_ends_and_versions_can_be_read_again(spark, tmp_path):
    files = lambda t: spark.createDataFrame([("m.yang", t)], "file string, text string")
    known = spark.createDataFrame([("k.yang", "module k { prefix k; container x { leaf y { type string; } leaf-list z { type string; } leaf w { type int8; } list l { key q; leaf q { type int8; } } } }")], "file string, text string")
    folder = f"{shared_folder(spark)}/test-learning-{uuid.uuid4().hex}"
    retriever.write_index(retriever.corpus(yang.statements(known)), f"{folder}/index")
    store = learning.RuleTable(spark, f"{folder}/rules")
    store.append(spark.createDataFrame(rules_xml.rule_rows(modules.RULES), rules_xml.RULES), 0)
    found, log = learning.learn(files(OLD), files(NEW), store, retriever.Retriever(spark, f"{folder}/index"), least=0.0)
    given = {k: s for _, k, s in log}
    assert {"leaf-list", "anydata"} <= set(given) and len(log) == len(given)
    assert given["leaf-list"] in {"leaf", "list", "type"}
    subjects = lambda v: {r[0] for r in store.read(v).select("subject").distinct().collect()}
    last = max(v for v, *_ in log)
    assert "leaf-list" not in subjects(0) and "leaf-list" in subjects(last) and subjects(0) < subjects(last)
    assert store.read(0).count() == len(rules_xml.rule_rows(modules.RULES))
    left = found.changes.where("verdict = '[UNMARKED]'").select(F.regexp_replace("keyword", "^[^:]*:", "").alias("k")).distinct().collect()
    assert not {r.k for r in left} & {k for k, s in given.items() if s}
    out = str(tmp_path / "report")
    reports.write_report(found, out)
    grouped = spark.read.json(f"{out}/grouped")
    assert {"section", "kind", "paths", "details"} <= set(grouped.columns) and grouped.count() == found.report().count()
    assert spark.read.json(f"{out}/concise").count() == found.condensed().count()
