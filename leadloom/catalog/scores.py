"""Scores."""

from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.catalog import query, sql_regex
from leadloom.catalog.gates import HITS, SIGNALS
from leadloom.catalog.identity import LATEST_REVIEW
from leadloom.catalog.scans import LAST_EVENT
from leadloom.operators import scoring
from leadloom.operators.compliance import hard_gates
from leadloom.plays import FIELD_SERVICE
from leadloom.standins import EVENTS_AS_OF, HISTORY_AS_OF

PAIN_TEST = "lower(coalesce(category, '')) = 'pain' OR upper(coalesce(signal_type, '')) LIKE 'PAIN\\_%' ESCAPE '\\' OR upper(coalesce(signal_type, '')) IN ('MANUAL_PDF_WORKFLOW', 'EXCEL_OR_MANUAL_REPORTING_MENTION', 'NO_CUSTOMER_PORTAL', 'HIRING_PLANNING_COORDINATOR', 'HIRING_ADMIN_OPERATIONS')"

# The scoring rules as one chain of expressions, one per component.
SCORED = f"""
sig AS ({SIGNALS}),
ev AS (SELECT prospect_id, count(*) AS n, count(*) FILTER (category = 'structural_fit') AS structural,
    max(CASE WHEN {PAIN_TEST} THEN least(80, 40 + floor(coalesce(nullif(strength, 0), 50) / 5)) END) AS pain_ev, bool_or(({PAIN_TEST}) AND manually_confirmed) AS pain_conf,
    bool_or(category = 'trigger') AS has_trigger, bool_or(lower(coalesce(source_type, '')) = 'decp') AS has_decp,
    bool_or(CASE WHEN lower(trim(source_type)) IN ('annuaire', 'recherche', 'annuaire entreprises') THEN TRUE ELSE FALSE END) AS s_annuaire,
    bool_or(coalesce(lower(trim(source_type)) = 'decp', FALSE)) AS s_decp, bool_or(coalesce(lower(trim(source_type)) = 'website', FALSE)) AS s_website,
    bool_or(coalesce(lower(trim(source_type)) = 'jobs', FALSE)) AS s_jobs FROM sig GROUP BY 1),
aw AS (SELECT prospect_id, count(*) AS awards, coalesce(sum(CAST(CASE WHEN montant <> 'n.c.' THEN montant END AS BIGINT)), 0) AS euros,
    count(*) FILTER (date IS NULL OR date = 'n/a' OR date_diff('day', CAST(CASE WHEN date <> 'n/a' THEN date END AS DATE), DATE '{HISTORY_AS_OF}') <= 90) AS recent FROM s_award_rows GROUP BY 1),
rev AS ({LATEST_REVIEW}),
base AS (SELECT p.*, coalesce(ev.n, 0) AS n, coalesce(structural, 0) AS structural, pain_ev, coalesce(pain_conf, FALSE) AS pain_conf, coalesce(has_trigger, FALSE) AS has_trigger, coalesce(has_decp, FALSE) AS has_decp,
    coalesce(s_annuaire, FALSE) AS s_annuaire, coalesce(s_decp, FALSE) AS s_decp, coalesce(s_website, FALSE) AS s_website, coalesce(s_jobs, FALSE) AS s_jobs,
    coalesce(awards, 0) AS awards, coalesce(euros, 0) AS euros, coalesce(recent, 0) AS recent, coalesce(rev.pain_confirmed, FALSE) AS pain_rev,
    coalesce(rev.decision = 'accept' AND rev.fit_confirmed AND rev.pain_confirmed AND rev.trigger_confirmed AND rev.buyer_confirmed AND rev.contact_confirmed AND rev.offer_match_confirmed, FALSE) AS human,
    p.id IN ({HITS}) AS supp, upper(replace(coalesce(naf_code, ''), '.', '')) AS naf, lower(coalesce(signal_details, '')) || ' ' || lower(coalesce(p.notes, '')) AS blob,
    lower(coalesce(p.contact_confidence, '')) AS conf, lower(coalesce(contact_discovery_state, '')) AS disc, lower(coalesce(decision_maker_title, '')) AS title
  FROM s_prospects p LEFT JOIN ev ON ev.prospect_id = p.id LEFT JOIN aw ON aw.prospect_id = p.id LEFT JOIN rev ON rev.prospect_id = p.id),
f1 AS (SELECT *, CASE WHEN naf = '' THEN 25 WHEN naf IN ('7022Z') OR substring(naf, 1, 2) IN ('62', '63', '58', '61') THEN 5 WHEN substring(naf, 1, 2) IN ('33', '43', '81', '71') THEN 85 ELSE 40 END AS fit0 FROM base),
f2 AS (SELECT *, least(100, fit0 + CASE WHEN company_size IN ('11-50', '51-200') THEN 15 WHEN company_size = '1-10' THEN 5 ELSE 0 END) AS fit1 FROM f1),
comp AS (SELECT *, least(100, least(100, fit1 + CASE WHEN regexp_matches(blob, '{sql_regex(fixed.COMPLEXITY_KEYWORDS)}') THEN 5 ELSE 0 END) + 3 * structural) AS fit,
    greatest(CASE WHEN regexp_matches(blob, '{sql_regex(fixed.PAIN_KEYWORDS)}') THEN 40 ELSE 0 END, coalesce(pain_ev, 0), CASE WHEN pain_conf OR pain_rev THEN 55 ELSE 0 END) AS pain,
    CASE WHEN recent > 0 THEN least(100, 40 + 15 * recent) ELSE 10 END + 0 AS t0,
    CASE WHEN regexp_matches(title, 'gérant|gerant|président|president|fondateur|dirigeant') THEN 100
      WHEN regexp_matches(title, 'directeur d.exploitation|directeur operations|directeur des opérations|responsable exploitation') THEN 90
      WHEN regexp_matches(title, 'directeur de service|responsable maintenance|responsable sav|directeur technique') THEN 80
      WHEN regexp_matches(title, 'daf|directeur administratif|responsable administratif') THEN 70
      WHEN regexp_matches(title, 'directeur commercial|responsable commercial') THEN 60 ELSE 15 END AS a0,
    least(100, CASE WHEN euros >= 100000 THEN 80 WHEN euros >= 40000 THEN 65 ELSE 40 END + CASE WHEN company_size IN ('11-50', '51-200') THEN 10 ELSE 0 END) AS value,
    (CASE WHEN s_annuaire THEN 1 ELSE 0 END) + (CASE WHEN s_decp OR awards > 0 THEN 1 ELSE 0 END) + (CASE WHEN s_website THEN 1 ELSE 0 END) + (CASE WHEN s_jobs THEN 1 ELSE 0 END)
      + (CASE WHEN NOT s_annuaire THEN 1 ELSE 0 END) AS sources,
    n + CASE WHEN awards > 0 AND NOT has_decp THEN 1 ELSE 0 END AS signals,
    CASE WHEN conf IN ('deliverable', 'verified', 'published_personal', 'confirmed_by_reply') AND disc <> 'guessed' THEN 'ready' WHEN conf = 'manual_confirmed' THEN 'manual'
      WHEN conf = 'published_generic' THEN 'generic' WHEN conf IN ('likely', 'domain_and_pattern_only', 'unverified') OR disc = 'guessed' THEN 'guessed'
      WHEN conf IN ('catch_all', 'indeterminate', 'risky') THEN 'risky' WHEN conf IN ('invalid', 'bounced', 'suppressed') THEN 'dead' ELSE 'unknown' END AS cc FROM f2),
t1 AS (SELECT *, CASE WHEN awards >= 2 THEN least(100, t0 + 12) ELSE t0 END AS ta FROM comp),
t2 AS (SELECT *, CASE WHEN signal_type IN ('DECP_WIN', 'BOAMP_WIN', 'PUBLIC_AWARD') THEN greatest(ta, 45) WHEN signal_type = 'REGISTRY_IT' THEN least(ta, 20)
    WHEN signal_type IN ('REGISTRY_FIELD', 'STRUCTURAL') THEN greatest(ta, 20) ELSE ta END AS tb FROM t1),
t3 AS (SELECT *, CASE WHEN has_trigger THEN greatest(tb, 55) ELSE tb END AS trigger_score,
    least(100, CASE WHEN decision_maker_name IS NULL THEN least(a0, 25) WHEN a0 < 40 THEN 35 ELSE a0 END + CASE cc WHEN 'ready' THEN 15 WHEN 'manual' THEN 12 WHEN 'generic' THEN 5 ELSE 0 END) AS authority,
    least(100, 25 + least(50, 15 * sources) + CASE WHEN data_source IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN website IS NOT NULL THEN 5 ELSE 0 END) AS dq,
    CASE WHEN fit0 = 5 THEN 25 ELSE 0 END + CASE WHEN company_size = '1-10' AND fit1 < 50 THEN 15 WHEN company_size = '200+' THEN 15 ELSE 0 END + CASE WHEN signal_type = 'REGISTRY_IT' THEN 10 ELSE 0 END
      + CASE WHEN cc = 'dead' THEN 5 ELSE 0 END + CASE WHEN sources <= 1 THEN 10 ELSE 0 END AS penalties,
    cc IN ('ready', 'manual') AND (decision_maker_name IS NOT NULL OR email IS NOT NULL) AS usable FROM t2),
s1 AS (SELECT *, CAST(greatest(0, least(100, round_even((CAST(0.25 AS DOUBLE) * fit + CAST(0.25 AS DOUBLE) * pain + CAST(0.2 AS DOUBLE) * trigger_score + CAST(0.15 AS DOUBLE) * authority + CAST(0.1 AS DOUBLE) * value
    + CAST(0.05 AS DOUBLE) * dq) * (CAST(0.65 AS DOUBLE) + CAST(0.35 AS DOUBLE) * (dq / CAST(100 AS DOUBLE))) - penalties, 0))) AS BIGINT) AS score FROM t3),
r1 AS (SELECT *, concat_ws('; ', CASE WHEN fit < 55 THEN 'fit_score < 55' END, CASE WHEN pain < 40 THEN 'pain_score < 40 (need real workflow pain, not award alone)' END,
    CASE WHEN trigger_score < 25 THEN 'trigger_score < 25' END, CASE WHEN authority < 40 THEN 'authority_score < 40' END, CASE WHEN dq < 45 THEN 'data_quality < 45' END,
    CASE WHEN signals < 2 THEN 'insufficient_signals' END, CASE WHEN sources < 2 THEN 'insufficient_independent_sources' END, CASE WHEN NOT usable THEN 'contact_required' END,
    CASE WHEN NOT human THEN 'human_review_required' END) AS failed FROM s1),
scored AS (SELECT *, CASE WHEN opted_out OR supp THEN 'suppressed' WHEN failed = '' THEN 'contact_ready' WHEN failed = 'human_review_required' THEN 'human_review_required'
    WHEN NOT usable AND fit >= 55 AND pain >= 40 THEN 'contact_required' WHEN fit < 40 THEN 'insufficient_identity' ELSE 'research_required' END AS state,
    CASE WHEN opted_out OR supp THEN 'Company or contact is suppressed' ELSE failed END AS failures FROM r1)
"""


def inputs(t):
    return scoring.score_inputs(t.s_prospects, t.s_evidence, t.s_reviews, t.s_suppression, t.s_assets, t.s_award_rows, HISTORY_AS_OF)


def scored(t):
    return scoring.score(inputs(t), FIELD_SERVICE)


@query("m1_fit", f"WITH {SCORED} SELECT id, fit FROM scored", whole="fit")
def m1(t):
    return scoring.fit(inputs(t), FIELD_SERVICE).select("id", "fit")


@query("m2_pain", f"WITH {SCORED} SELECT id, pain FROM scored", whole="pain")
def m2(t):
    return scoring.pain(inputs(t)).select("id", "pain")


@query("m3_trigger", f"WITH {SCORED} SELECT id, trigger_score FROM scored", whole="trigger_score")
def m3(t):
    return scoring.trigger(inputs(t)).select("id", F.col("trigger").alias("trigger_score"))


@query("m4_authority", f"WITH {SCORED} SELECT id, authority, cc AS contact_class, usable AS contact_usable FROM scored", whole="authority")
def m4(t):
    return scoring.authority(inputs(t), FIELD_SERVICE).select("id", "authority", "contact_class", "contact_usable")


@query("m5_value", f"WITH {SCORED} SELECT id, value FROM scored", whole="value")
def m5(t):
    return scoring.value(inputs(t)).select("id", "value")


@query("m6_data_quality", f"WITH {SCORED} SELECT id, dq AS data_quality, sources AS source_count, signals AS active_signals FROM scored", whole="data_quality source_count active_signals")
def m6(t):
    return scoring.data_quality(inputs(t), FIELD_SERVICE).select("id", "data_quality", "source_count", "active_signals")


@query("m7_opportunity_score", f"WITH {SCORED} SELECT id, penalties, score AS opportunity_score FROM scored", whole="penalties opportunity_score")
def m7(t):
    return scored(t).select("id", "penalties", "opportunity_score")


@query("m8_readiness", f"WITH {SCORED} SELECT id, state AS readiness_state, failures FROM scored")
def m8(t):
    return scored(t).select("id", "readiness_state", F.array_join("readiness_failures", "; ").alias("failures"))


EXPLAINED = f"""
SELECT id, CASE WHEN regexp_matches(title, 'gérant|gerant|président|president|fondateur|dirigeant') THEN 'gerant_owner' WHEN a0 = 90 THEN 'operations' WHEN a0 = 80 THEN 'service_maintenance'
    WHEN a0 = 70 THEN 'admin_finance' WHEN a0 = 60 THEN 'commercial' ELSE 'gerant_owner' END AS recommended_buyer_role,
  CASE WHEN regexp_matches(blob, '{sql_regex(fixed.PAIN_KEYWORDS)}') THEN 'Explicit manual/workflow language in notes or details'
    WHEN pain_ev IS NOT NULL THEN (SELECT coalesce(nullif(s.label, ''), upper(coalesce(s.signal_type, ''))) FROM sig s WHERE s.prospect_id = scored.id AND ({PAIN_TEST.replace("category", "s.category").replace("signal_type", "s.signal_type")}) ORDER BY s.id LIMIT 1)
    WHEN pain_rev THEN 'Human confirmed operational pain' WHEN awards > 0 THEN 'Hypothesis only: public service delivery may imply coordination load — not verified pain'
    ELSE 'Devis et relances clients éclatés entre mails et tableurs' END AS suspected_pain,
  coalesce(nullif(concat_ws('; ', CASE WHEN recent > 0 THEN CAST(recent AS VARCHAR) || ' recent public award(s)' END, CASE WHEN awards >= 2 THEN 'Multiple awards in window' END,
    (SELECT string_agg(s.label, '; ' ORDER BY s.id) FROM sig s WHERE s.prospect_id = scored.id AND s.category = 'trigger' AND s.label <> '')), ''), 'No strong timing trigger yet — research required') AS why_now
FROM scored
"""


@query("m9_explanations", f"WITH {SCORED} {EXPLAINED}")
def m9(t):
    return scored(t).select("id", "recommended_buyer_role", "suspected_pain", "why_now")


@query("m9b_badges", f"""
WITH {SCORED}
SELECT id, array_to_string(list_filter([CASE fit0 WHEN 5 THEN 'IT exclusion' WHEN 85 THEN 'Target NAF' END, CASE WHEN company_size IN ('11-50', '51-200') THEN 'SME fit' WHEN company_size = '200+' THEN 'Large' END,
  CASE WHEN regexp_matches(blob, '{sql_regex(fixed.COMPLEXITY_KEYWORDS)}') THEN 'Structural complexity' END, CASE WHEN regexp_matches(blob, '{sql_regex(fixed.PAIN_KEYWORDS)}') THEN 'Manual workflow' END,
  CASE WHEN pain_conf OR pain_rev THEN 'Pain confirmed' END, CASE WHEN recent > 0 THEN CAST(recent AS VARCHAR) || ' award(s)' END, CASE WHEN awards >= 2 THEN 'Multi-award' END,
  CASE WHEN a0 > 15 THEN 'Buyer role match' END, CASE WHEN decision_maker_name IS NOT NULL AND a0 < 40 THEN 'Person named' END,
  CASE cc WHEN 'ready' THEN 'Contact OK' WHEN 'manual' THEN 'Contact manually confirmed' WHEN 'generic' THEN 'Generic mailbox only' WHEN 'guessed' THEN 'Guessed email' WHEN 'risky' THEN 'Risky/catch-all contact' END,
  CASE WHEN euros >= 100000 THEN '≥100k€ awards' END], lambda x: x IS NOT NULL), '|') AS badges FROM scored
""")
def m9b(t):
    return scored(t).select("id", F.array_join("badges", "|").alias("badges"))


@query("m9c_reasons", f"""
WITH {SCORED}, told AS ({EXPLAINED})
SELECT s.id, concat_ws('|', CASE fit0 WHEN 5 THEN 'Excluded NAF (software/digital) — not target buyer' WHEN 85 THEN 'NAF ' || naf || ' matches field-service play' WHEN 40 THEN 'NAF ' || naf || ' adjacent / unverified for play' END,
  CASE WHEN company_size IN ('11-50', '51-200') THEN 'Headcount in mid-market service sweet spot' END,
  CASE WHEN regexp_matches(blob, '{sql_regex(fixed.PAIN_KEYWORDS)}') THEN 'Pain from explicit workflow evidence (Excel/paper/WhatsApp/double entry…)' END,
  CASE WHEN NOT (regexp_matches(blob, '{sql_regex(fixed.PAIN_KEYWORDS)}') OR pain_ev IS NOT NULL OR pain_rev) THEN 'Suspected pain is hypothesis only — does not satisfy pain gate' END,
  CASE WHEN recent > 0 THEN 'Public award = timing/capacity signal, not proof of software need' END, CASE WHEN a0 > 15 THEN 'Title matches preferred buyer role (' || told.recommended_buyer_role || ')' END,
  CASE cc WHEN 'generic' THEN 'Generic role email is not person-matched — LinkedIn-first or research' WHEN 'guessed' THEN 'Guessed/pattern email is not email-contact-ready' END) AS reasons
FROM scored s JOIN told USING (id)
""")
def m9c(t):
    return scored(t).select("id", F.array_join("reasons", "|").alias("reasons"))


@query("m9d_brief", f"""
WITH {SCORED}, told AS ({EXPLAINED})
SELECT s.id, 'Observed: ' || coalesce(company_name, 'Company') || CASE WHEN naf <> '' THEN ' (NAF ' || naf || ')' ELSE '' END || chr(10) || 'Why now: ' || told.why_now || chr(10) || 'Pain status: ' || coalesce(nullif(told.suspected_pain, ''), 'none verified')
  || ' (score=' || CAST(CAST(pain AS BIGINT) AS VARCHAR) || '; hypothesis≠evidence)' || chr(10) || 'Buyer role: ' || told.recommended_buyer_role || chr(10) || 'Offer: {FIELD_SERVICE.offer_name or "None"}' || chr(10)
  || 'Safe first line: reference a real award/object or multi-site ops — do not invent internal tools.' || chr(10) || 'Do not claim: that they lack software, or that an award proves budget for custom software.' || chr(10)
  || 'CTA: short diagnostic call on intervention/planning flow.' AS brief
FROM scored s JOIN told USING (id)
""")
def m9d(t):
    return scored(t).select("id", F.col("personalization_brief").alias("brief"))


@query("m10_code_score", """
WITH c AS (SELECT c_custkey AS id, c_custkey % 2 = 0 AS mb, c_custkey % 3 = 0 AS rc, c_custkey % 5 = 0 AS oc, c_custkey % 7 <> 0 AS buyer, c_custkey % 4 <> 0 AS contact, c_custkey % 11 = 0 AS dead FROM customer)
SELECT id, CAST(CASE WHEN dead THEN 0 ELSE 40 + CASE WHEN mb THEN 15 ELSE 0 END + CASE WHEN rc THEN 15 ELSE 0 END + CASE WHEN oc THEN 10 ELSE 0 END + CASE WHEN buyer THEN 10 ELSE 0 END
  + CASE WHEN contact THEN 10 ELSE 0 END END AS DOUBLE) AS total_score FROM c
""")
def m10(t):
    k = F.col("c_custkey")
    found = F.array_compact(F.array(
        F.when(k % 2 == 0, fixed.MULTI_BRANCH), F.when(k % 3 == 0, fixed.RECURRING_CONTRACTS), F.when(k % 5 == 0, fixed.ON_CALL)
    ))
    rows = t.customer.select(
        k.alias("id"), found.alias("codes"), (k % 7 != 0).alias("has_buyer"), (k % 4 != 0).alias("has_contact"),
        F.when(k % 11 == 0, "dissolved").otherwise("active").alias("entity_status"), F.lit(None).cast("string").alias("legal_form"),
        F.lit("verified_primary").alias("domain_verification_state"), F.lit("allow_send").alias("compliance_decision"),
    )
    return scoring.code_score(hard_gates(rows)).select("id", "total_score")


_V2 = f"""
last AS ({LAST_EVENT}),
w AS (SELECT prospect_id, count(*) FILTER (date IS NULL OR date = 'n/a' OR date_diff('day', CAST(CASE WHEN date <> 'n/a' THEN date END AS DATE), DATE '{EVENTS_AS_OF}') <= 180) AS recent,
  bool_or(coalesce(CAST(CASE WHEN montant <> 'n.c.' THEN montant END AS BIGINT) >= 50000, FALSE)) AS large FROM s_award_rows GROUP BY 1),
b AS (SELECT p.*, coalesce(recent, 0) AS recent, coalesce(large, FALSE) AS large, lower(coalesce(signal_details, '')) AS d, lower(coalesce(decision_maker_title, '')) AS ti,
  coalesce(floor(date_diff('second', l.event_date, TIMESTAMP '{EVENTS_AS_OF}') / 86400) > 21, FALSE) AS stale FROM s_prospects p LEFT JOIN w ON w.prospect_id = p.id LEFT JOIN last l ON l.prospect_id = p.id),
c AS (SELECT *, CASE WHEN signal_type IN ('DECP_WIN', 'BOAMP_WIN') THEN 30 + CASE WHEN recent >= 2 OR contains(d, 'multiple') THEN 15 ELSE 0 END + CASE WHEN large OR contains(d, 'cyber') THEN 10 ELSE 0 END
    WHEN signal_type = 'MOROCCO_OPS' THEN 15 WHEN signal_type = 'PAIN_POST' THEN 20 ELSE 0 END AS sig,
  CASE WHEN regexp_matches(ti, 'fondateur|dirigeant|directeur commercial|dsi|cto') THEN 10 ELSE 0 END + CASE WHEN company_size IN ('11-50', '51-200') THEN 8 ELSE 0 END
    + CASE WHEN contact_confidence = 'verified' THEN 3 ELSE 0 END - CASE WHEN stale THEN 10 ELSE 0 END AS rest FROM b)
"""


@query("m11_urgency_v2", f"WITH {_V2} SELECT id, greatest(0, least(100, 50 + sig + rest + CASE WHEN signal_type = 'REGISTRY_IT' THEN 18 ELSE 0 END)) AS urgency_v2 FROM c", whole="urgency_v2")
def m11(t):
    return scoring.urgency_v2(t.s_prospects, t.s_events, t.s_award_rows, EVENTS_AS_OF).select("id", "urgency_v2")


@query("m12_urgency_explained", f"""
WITH {_V2} SELECT id, greatest(0, least(100, 50 + sig + rest + CASE WHEN substring(upper(replace(naf_code, '.', '')), 1, 2) IN ('58', '61', '62', '63') THEN 12 ELSE 0 END)) AS total FROM c
""", whole="total")
def m12(t):
    return scoring.urgency_v2_explained(t.s_prospects, t.s_events, t.s_award_rows, EVENTS_AS_OF).select("id", "total")


@query("m13_full_accept", f"WITH {SCORED} SELECT id, human AS human_accepted FROM scored")
def m13(t):
    return scoring.full_accept(t.s_prospects, t.s_reviews).select("id", "human_accepted")


@query("d1_recompute", f"""
WITH {SCORED} SELECT id, fit AS fit_score, pain AS pain_score, trigger_score, authority AS authority_score, value AS value_score, dq AS data_quality_score, score AS opportunity_score, state AS readiness_state FROM scored
WHERE id IN (SELECT id FROM s_prospects WHERE NOT anonymized)
""", whole="fit_score pain_score trigger_score authority_score value_score data_quality_score opportunity_score")
def d1(t):
    from leadloom.plans.recompute import recompute

    out = recompute(t.s_prospects, t.s_evidence, t.s_reviews, t.s_suppression, t.s_assets, t.s_award_rows, FIELD_SERVICE, HISTORY_AS_OF)
    return out.select("id", "fit_score", "pain_score", "trigger_score", "authority_score", "value_score", "data_quality_score",
                      "opportunity_score", "readiness_state")


@query("d2_score_projection", f"""
WITH {SCORED} SELECT id, score AS urgency_score, score AS acquisition_score, CASE WHEN score >= 70 THEN 'High' WHEN score >= 45 THEN 'Medium' ELSE 'Low' END AS priority_level,
  CASE state WHEN 'contact_ready' THEN 'contact_ready' WHEN 'human_review_required' THEN 'human_review_required' WHEN 'suppressed' THEN 'suppressed' WHEN 'contact_required' THEN 'enriched' ELSE 'researching' END AS acquisition_stage,
  CASE state WHEN 'contact_ready' THEN FALSE WHEN 'suppressed' THEN needs_manual_review ELSE TRUE END AS needs_manual_review, coalesce(market_play_code, 'FIELD_SERVICE_OPERATIONS_FR') AS market_play_code FROM scored
""", whole="urgency_score acquisition_score")
def d2(t):
    out = scoring.project_scores(scored(t), FIELD_SERVICE)
    return out.select("id", "urgency_score", "acquisition_score", "priority_level", "acquisition_stage", "needs_manual_review", "market_play_code")


