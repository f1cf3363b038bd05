"""A sample of registered queries against DuckDB; set PRICELENS_ALL=1 for every query."""
import os

import pytest
from oracle import compare, connect

from pricelens.registry import all_oracles, all_queries, daily

SF = "/root/testdata/sf0.01"
SAMPLE = ["daily_structure_summary", "rul_07_candidate_level", "win_20_event_clusters", "agg_06_fair_price", "rul_11_candidate_trigger",
          "agg_20_parameter_shapes", "rul_16_legacy_flags", "win_28_peak_actions", "agg_27_amplitude_excess", "agg_28_contract_gap", "agg_15_range_days",
          "agg_22_replay_summary", "rul_18_research_shapes", "src_03_archive_rows", "src_07_encodings", "fun_08_result_digest", "snk_06_keyed_cache",
          "str_03_incremental_deltas"]
NAMES = sorted(all_oracles()) if os.environ.get("PRICELENS_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    assert compare(spark, con, all_queries()[name], all_oracles()[name], SF) is None


def test_every_daily_query_builds(spark):
    """Arguments and columns of all queries whose plans need no earlier result."""
    for name, query in daily.QUERIES.items():
        assert query(spark, "/root/testdata/sf0.001").columns, name
