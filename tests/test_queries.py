"""Each registered query against its SQL in DuckDB, on the smallest tables; with several partitionings for some."""

import oracle
import pytest

from brindle.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert oracle.differences(df, ORACLE_SQL[name], duck) == []
    else:
        assert df.count() > 0


@pytest.mark.parametrize("lever", [{"spark.sql.adaptive.enabled": "false"}, {"spark.sql.shuffle.partitions": "1"}, {"spark.sql.autoBroadcastJoinThreshold": "-1"}])
@pytest.mark.parametrize("name", ["hash_join", "asof_join", "groups_frame", "exclude_current_row", "null_order", "upsert", "fusion_rrf", "recursive_union"])
def test_same_answer_whatever_the_plan(spark, duck, name, lever):
    before = {k: spark.conf.get(k) for k in lever}
    try:
        for k, v in lever.items():
            spark.conf.set(k, v)
        assert oracle.differences(QUERIES[name](spark, SF), ORACLE_SQL[name], duck) == []
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_filter_and_columns_reach_the_scan(spark):
    plan = QUERIES["point_probe"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_custkey,42)" in plan and "c_acctbal" not in plan
