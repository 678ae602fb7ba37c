"""Registered queries against their check SQL on the smallest data; all of them run with ALL_QUERIES=1."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUICK = (
    "log_keys params time_delta stream_ids regrouped_lines access_parse syslog_parse security_parse line_type private_ip "
    "label_split positional_split date_range pasted_text flow_lines rules_multi rules_fields rules_incidents rules_first "
    "eventid_join attack_overview category_share risk_v3 recommendations timeline attack_chains chain_stages "
    "brute_force_window next_key_model key_anomalies detect transitions loop_nodes cooccurrence file_scan_first file_scan_score "
    "remediation workflow_merge build_workflows scan_lines scan_auto scan_balanced json_report timeline_head timeline_text"
).split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()) if os.environ.get("ALL_QUERIES") else QUICK)
def test_query_equals_check(spark, con, name):
    ok, note = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
