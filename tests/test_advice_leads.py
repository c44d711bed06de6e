"""Every lead of the forecasts is read; the rows themselves are compared with SQL in test_queries."""

import pytest

from verimet.catalog import QUERIES, inputs

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [f"{k}_all_leads" for k in ("win_cells", "score_windows", "score_uncertain", "win_gfs", "win_nam")])
def test_all_leads(spark, name):
    leads = {r.fh for r in inputs.Inputs(spark, FOLDER).forecasts().select("fh").distinct().collect()}
    assert leads == {r.fh for r in QUERIES[name](spark, FOLDER).select("fh").distinct().collect()} and len(leads) == 6
