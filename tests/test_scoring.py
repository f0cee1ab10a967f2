import pytest
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.operators import scoring
from leadloom.operators.compliance import hard_gates
from leadloom.plays import FIELD_OPERATIONS_UK, FIELD_SERVICE

PROFILE = dict(
    id=1, company_name="Froid Pro", naf_code="4322B", company_size="11-50", signal_type="PUBLIC_AWARD", signal_details="1 award", notes="",
    decision_maker_name="Jean Martin", decision_maker_title="Gérant", email="j@froidpro.fr", contact_confidence="likely",
    contact_discovery_state="guessed", data_source="DECP", siren="123456789", siret=None, website="https://froidpro.fr", opted_out=False,
    needs_manual_review=False, market_play_code="FIELD_SERVICE_OPERATIONS_FR",
)
REVIEW = "id long, prospect_id long, decision string, " + ", ".join(f"{f} boolean" for f in fixed.REVIEW_FLAGS) + ", created_at timestamp_ntz"
EVIDENCE = ("id long, prospect_id long, category string, signal_type string, label string, evidence_text string, evidence_url string, "
            "source_type string, confidence int, strength int, is_active boolean, manually_confirmed boolean")
AWARD = "prospect_id long, id string, date string, objet string, cpv string, montant string, montant_quality string, acheteur string"
SCHEMA = ("id long, company_name string, naf_code string, company_size string, signal_type string, signal_details string, notes string, "
          "decision_maker_name string, decision_maker_title string, email string, contact_confidence string, contact_discovery_state string, "
          "data_source string, siren string, siret string, website string, opted_out boolean, needs_manual_review boolean, market_play_code string")


@pytest.fixture
def scored(spark):
    def run(play=FIELD_SERVICE, awards=((1, "a", "2024-01-20", "Contrat maintenance", None, "80000", "ok", "Région"),), evidence=(), reviews=(), **changes):
        row = {**PROFILE, **changes}
        frames = (
            spark.createDataFrame([tuple(row[c.split()[0]] for c in SCHEMA.split(", "))], SCHEMA),
            spark.createDataFrame(list(evidence), EVIDENCE),
            spark.createDataFrame(list(reviews), REVIEW),
            spark.createDataFrame([], "kind string, value_normalized string"),
            spark.createDataFrame([], "market_play_code string, is_active boolean"),
            spark.createDataFrame(list(awards), AWARD),
        )
        return scoring.score(scoring.score_inputs(*frames, "2024-01-31"), play).first()

    return run


def full_accept():
    from datetime import datetime

    return ((7, 1, "accept", True, True, True, True, True, True, datetime(2024, 1, 1)),)


def pain_item(i=1, source="manual"):
    return (i, 1, "pain", "EXCEL_OR_MANUAL_REPORTING_MENTION", "Excel reporting", f"notes {i}", None, source, 60, 70, True, True)


def test_an_award_alone_is_no_pain(scored):
    row = scored()
    assert row["pain"] == 0 and row["trigger"] >= 40 and row["readiness_state"] != "contact_ready"
    assert row["suspected_pain"] == fixed.SUSPECTED_FROM_AWARDS


def test_activity_words_are_no_pain_but_workflow_words_are(scored):
    assert scored(signal_details="maintenance techniciens agences", awards=())["pain"] == 0
    assert scored(signal_details="", notes="planning via excel et double saisie", awards=())["pain"] == 40


def test_digital_companies_do_not_fit(scored):
    row = scored(naf_code="62.01Z")
    assert row["fit"] < 55 and "IT exclusion" in row["badges"]


def test_a_full_accept_with_evidence_is_ready(scored):
    row = scored(
        contact_confidence="deliverable", contact_discovery_state="inferred", notes="excel", evidence=(pain_item(), pain_item(2, "website")), reviews=full_accept()
    )
    assert row["human_accepted"] and row["pain"] == 55 and row["readiness_state"] == "contact_ready" and row["readiness_failures"] == []


def test_gates(scored):
    assert scored(opted_out=True)["readiness_failures"] == ["Company or contact is suppressed"]
    guessed = scored(evidence=(pain_item(),), reviews=full_accept())
    assert guessed["readiness_state"] == "contact_required" and "contact_required" in guessed["readiness_failures"]
    generic = scored(contact_confidence="published_generic", contact_discovery_state="published", notes="excel")
    assert "contact_required" in generic["readiness_failures"]


def test_a_play_without_targets_scores_every_activity_as_adjacent(scored):
    row = scored(play=FIELD_OPERATIONS_UK)
    assert row["fit"] == 55 and row["recommended_buyer_role"] == "gerant_owner" and row["buyer_match"] is None


def test_code_score(spark):
    row = spark.createDataFrame(
        [([fixed.MULTI_BRANCH, fixed.RECURRING_CONTRACTS], True, True, "active", "ltd", "verified_primary", "allow_send")],
        "codes array<string>, has_buyer boolean, has_contact boolean, entity_status string, legal_form string, domain_verification_state string, compliance_decision string",
    )
    assert scoring.code_score(hard_gates(row)).first()["total_score"] == 90.0
    dead = row.withColumn("entity_status", F.lit("dissolved"))
    assert scoring.code_score(hard_gates(dead)).first()["total_score"] == 0.0


@pytest.mark.parametrize(
    "changes, days, expected",
    [
        ({}, None, 50),
        ({"signal_type": "BOAMP_WIN"}, None, 80),
        ({"signal_type": "BOAMP_WIN", "signal_details": "multiple lots"}, None, 95),
        ({"signal_type": "MOROCCO_OPS"}, None, 65),
        ({"signal_type": "PAIN_POST"}, None, 70),
        ({"decision_maker_title": "Fondateur"}, None, 60),
        ({"company_size": "11-50"}, None, 58),
        ({}, 22, 40),
        ({}, 10, 50),
        ({"signal_type": "BOAMP_WIN", "signal_details": "multiple cyber", "company_size": "11-50", "decision_maker_title": "DSI"}, None, 100),
        ({"signal_type": "PAIN_POST", "company_size": "11-50"}, None, 78),
    ],
)
def test_legacy_score(spark, changes, days, expected):
    from datetime import datetime, timedelta

    base = {**PROFILE, "signal_type": "OTHER", "signal_details": "", "company_size": "unknown", "decision_maker_title": None, "contact_confidence": None, "naf_code": None}
    row = {**base, **changes}
    people = spark.createDataFrame([tuple(row[c.split()[0]] for c in SCHEMA.split(", "))], SCHEMA)
    when = [(1, 1, "Sent", "Email", datetime(2024, 1, 31) - timedelta(days=days), None, None)] if days else []
    events = spark.createDataFrame(
        when, "id long, prospect_id long, event_type string, channel string, event_date timestamp_ntz, next_action string, next_action_date timestamp_ntz"
    )
    out = scoring.urgency_v2(people, events, spark.createDataFrame([], AWARD), "2024-01-31")
    assert out.first()["urgency_v2"] == expected


def test_recompute_is_repeatable(spark):
    from leadloom.catalog import load, runner

    load()
    first = sorted(map(tuple, runner("d1_recompute")(spark, "/root/testdata/sf0.001").collect()))
    again = sorted(map(tuple, runner("d1_recompute")(spark, "/root/testdata/sf0.001").collect()))
    assert first == again
