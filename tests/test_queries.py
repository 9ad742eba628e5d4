"""Every registered query against its SQL oracle, on the smallest scale."""

from pathlib import Path

import pytest

from epochwise.plans import registry
from tools.check import compare, oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_oracle(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLES:
        assert compare(got, oracle(SF, registry.ORACLES[name])) == ""
    else:
        assert len(got) > 0


def test_entry_is_stable(spark):
    import __spark_entry__ as entry

    assert set(entry.queries()) >= set(registry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "arm" in entry.entry(spark).columns


#: Queries that read the ratio to a baseline.
RATIOS = ["agg01_arm_summary", "agg11_null_counts", "agg19_trajectories", "mod09_composite_score"]


@pytest.fixture(scope="module")
def zero_baselines(tmp_path_factory):
    """The smallest tables, where some subjects' values are all zero on the first day."""
    import duckdb

    to = tmp_path_factory.mktemp("zero")
    for t in Path(SF).glob("*.parquet"):
        (to / t.name).symlink_to(t)
    (to / "events.parquet").unlink()
    duckdb.sql(f"""COPY (SELECT * REPLACE (CASE WHEN user_id % 4 < 2 AND CAST(ts AS DATE) = DATE '2024-01-01' THEN 0.0 ELSE value END AS value)
        FROM '{SF}/events.parquet') TO '{to}/events.parquet'""")
    return str(to)


@pytest.mark.parametrize("name", RATIOS)
def test_zero_baselines_give_no_ratio(spark, zero_baselines, name):
    want = oracle(zero_baselines, registry.ORACLES[name])
    assert len(want) and "inf" not in want.to_string()
    assert compare(registry.QUERIES[name](spark, zero_baselines).toPandas(), want) == ""
