"""What keeps large tables out of the driver and of single rows, seen on the smallest ones."""

import os

import pytest
from pyspark.sql import functions as F

from docloom.plans import catalog as C
from docloom.plans import semantics  # noqa: F401, adds to the catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def first_plans(spark, run) -> list[str]:
    """The plans of all that run() executes, as they were before anything was measured."""
    store = spark._jsparkSession.sharedState().statusStore()
    executions = lambda: {x.executionId(): x.physicalPlanDescription() for x in (lambda found: [found.apply(i) for i in range(found.size())])(store.executionsList())}
    before = set(executions())
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return [p.rpartition("== Initial Plan ==")[2].partition("\n\n")[0] for i, p in executions().items() if i not in before]


@pytest.mark.parametrize("name", ["canonical_document_texts", "validate_schemas", "validate_all_counts", "validate_formula_types", "merge_conflicts", "overview_display", "diff_formula_impact", "validate_finite", "set_scalar_diff", "merge_entities", "merge_fields", "export_document_texts", "merge_documents", "merge_failures"])
def test_estimates_broadcast_nothing(spark, name):
    plans = first_plans(spark, lambda: C.QUERIES[name](spark, DATA).write.format("noop").mode("overwrite").save())
    assert any("Join" in p for p in plans)
    assert not [p for p in plans if "BroadcastHashJoin" in p]  # without a key to join by, Spark has nothing but nested loops


def test_descriptions_of_entities_are_rows(spark):
    from docloom.operators.describe import describe_documents, entity_fields

    docs = C.shop(spark, DATA)
    rows = {tuple(map(str, r)) for r in entity_fields(docs).drop("doc").collect()}
    arrays = describe_documents(docs).select(F.explode("entities").alias("e")).select("e.*")
    assert rows == {tuple(map(str, r)) for r in arrays.collect()}
    plan = C.described(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(field" in plan and "collect_list(struct" not in plan.replace("named_struct", "struct")
