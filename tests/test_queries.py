"""Registered queries beside their SQL.

By default a cross-section runs; ``LEADLOOM_ALL=1`` runs every query (or use
``python tests/compare.py <folder>``).
"""

import os

import pytest

import __spark_entry__ as entry_point
from compare import compare, connect
from leadloom import catalog

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "s1_award_scan", "s5_registry_payloads", "s11_prospect_export", "s13_run_ledger", "p1_relevant_awards", "p12_event_gate", "p19_review_gate", "j1_company_lookup",
    "j3_identity_resolution", "j9_person_mailbox", "j14_company_domain", "a1_awards_by_holder", "a3_headline_metrics", "a9_board_columns", "w3_action_queue",
    "w6_page_selection", "w10_verification_batch", "o1_list_page", "u2_award_history", "u5b_upsert_snapshot", "u6_people_merge", "u7_point_merge", "u9_task_sync",
    "f1_strip_accents", "f14_fingerprints", "f18b_email_candidates", "f24b_evidence_snippets", "m8_readiness", "m9_explanations", "d1_recompute", "d5_opt_outs",
    "d8_primary_projection", "d11_retention", "d13_contact_waterfall", "d15_award_ingest", "t1_gated_event_stream", "t2_status_stream",
)
NAMES = [n for n in catalog.load() if os.environ.get("LEADLOOM_ALL") or n in SAMPLE]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    equal, note = compare(spark, duck, FOLDER, name)
    assert equal is not False, note


def test_every_oracle_is_valid_sql(duck):
    for name, sql in entry_point.oracle_sql().items():
        duck.execute(f"EXPLAIN {sql}")


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() == 50 and df.columns[0] == "holder_key"


def test_names_match_the_contract():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert set(catalog.load()) <= set(entry_point.queries())
