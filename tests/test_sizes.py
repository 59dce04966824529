"""What grows with the tables does not pass through the driver."""

import duckdb
import pytest

from sieveline.operators import boxes
from sieveline.plans import catalogue

from .test_twins import AT, TABLES, plain


def plans(spark, run):
    """Physical plans, as they ran, of all executions that ``run`` starts, and its result."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    listed = store.executionsList()
    found = [listed.apply(k).physicalPlanDescription() for k in range(int(before), listed.size())]
    assert found
    return out, found


@pytest.mark.parametrize("name", ["proximity_anti", "merged_blocks"])
def test_nothing_is_broadcast(spark, name):
    rows, found = plans(spark, lambda: (df := catalogue.queries()[name](spark, AT)).select(*sorted(df.columns)).collect())
    assert not [x for x in found if "Broadcast" in x]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    want = con.execute(f"SELECT * FROM ({catalogue.oracles()[name]})")
    order = sorted(range(len(want.description)), key=lambda k: want.description[k][0])
    assert plain(rows) == plain([[r[k] for k in order] for r in want.fetchall()])


def test_blocks_without_a_place_in_a_scene_have_no_group(spark):
    rows = [(None, 1, 0.0, 0.0), (1, None, 0.0, 0.0), (1, 2, 0.0, 0.0), (1, 3, 1.0, 1.0)]
    found = boxes.seeded_groups(spark.createDataFrame(rows, "scene int, i int, x double, y double"), 4, 2)
    assert sorted(map(tuple, found.collect())) == [(1, 2, 2), (1, 3, 2)]
