"""Rows, events and metrics of the deviation study are made once, however many branches read them."""
from pricelens.registry import study

SF = "/root/testdata/sf0.001"


def test_details_read_written_rows_and_events(spark):
    assert not [f for f in study.details(spark, SF).inputFiles() if "events.parquet" in f]


def test_contract_summary_makes_no_paths_again(spark):
    plan = study.QUERIES["agg_10_overall_summary"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "a_row" not in plan and "path_max" not in plan
