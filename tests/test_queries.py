"""Every registered query against its SQL, and its plan against what must never be in one."""

from __future__ import annotations

import pytest
from compare import compare

from gridwave.workload import all_oracles, all_queries

QUERIES, ORACLES = all_queries(), all_oracles()
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, folder, name):
    frames = []

    def run(s, f):
        frames.append(QUERIES[name](s, f))
        return frames[0]

    result = compare(spark, duck, folder, name, run, ORACLES[name])
    assert result.startswith("ok"), result
    plan = frames[0]._jdf.queryExecution().executedPlan().toString()
    # A Kronecker product is a cross join by definition, with a counted small side.
    allowed = ("BroadcastNestedLoopJoin",) if name in ("m_kron", "m_kron_complex") else ()
    assert not [word for word in FORBIDDEN if word in plan and word not in allowed]
    assert name.startswith("w_") or "FileScan" in plan or "Scan parquet" in plan or "ExistingRDD" in plan


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as contract

    df = contract.entry(spark)
    assert df.columns == ["row", "col", "v"]
    assert set(contract.queries()) >= set(QUERIES) and set(contract.oracle_sql()) >= set(ORACLES)
    assert set(contract.queries()) - set(QUERIES) == set(contract.LLM_QUERIES)
