"""Steps that have nothing to do cost nothing, and plain types are in no join."""

from pyspark.sql import functions as F

from tessera.plans import schema_diff
from tessera.session import stored
from tessera.sources import yang

TEXTS = [(f"m{i}.yang", f"module m{i} {{ prefix p; typedef t {{ type uint8; }} leaf a {{ type string; }} leaf b {{ type p:t; }} leaf c {{ type lost; }} }}") for i in range(3)]


def test_no_refinement_and_no_deviation_leave_the_rows_themselves(spark):
    rows = stored(yang.nodes(spark.createDataFrame(TEXTS, "file string, text string")))
    assert yang.apply_deviations(rows) is rows and yang._refined(rows) is rows
    aimed = [("d.yang", 'module d { prefix d; import m0 { prefix p; } deviation "/p:a" { deviate not-supported; } }')]
    nodes = schema_diff.nodes_of(spark.createDataFrame(TEXTS + aimed, "file string, text string"))
    assert nodes.where("norm_path = 'a' and file = 'm0.yang'").count() == 0


def test_plain_types_meet_no_definitions(spark):
    rows = stored(yang.nodes(spark.createDataFrame(TEXTS, "file string, text string")))
    defs = stored(yang.with_definitions(rows.where("keyword = 'type'"), yang.definitions(rows)))
    got, want = yang.told(rows, defs), rows.join(defs, "type_json", "left")
    show = lambda df: sorted(map(repr, df.select("file", "node_id", "type_json", "defs").collect()))
    assert show(got) == show(want) and want.where(F.col("defs").isNotNull()).count() == 3
    # rows of one plain type stay where they are
    union = got._jdf.queryExecution().optimizedPlan()
    assert union.nodeName() == "Union" and [union.children().apply(i).nodeName() == "Join" for i in range(2)].count(True) < 2 and " Join " not in union.children().apply(1).toString()
