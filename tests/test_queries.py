"""Every registered query against its SQL twin, plus a look at its plan."""

import re

import pytest
from compare import compare, duck

from verimet.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    kept = {}

    def run(session, folder):
        kept["df"] = QUERIES[name](session, folder)
        return kept["df"]

    rows, same, _, note = compare(spark, con, FOLDER, run, ORACLES.get(name))
    assert rows > 0 or name in ("grid_interp",)
    assert same is not False, note
    plan = kept["df"]._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan), "pairs everything with everything"
    assert "BatchEvalPython" not in plan, "row-at-a-time Python"
