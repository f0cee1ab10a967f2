"""Filters, gates and policies."""

from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.catalog import query, sql_list
from leadloom.catalog.scans import LAST_EVENT, RELEVANT
from leadloom.functions.codes import passes_play
from leadloom.functions.text import same_host
from leadloom.functions.urls import with_safe_url
from leadloom.operators import activity, awards, compliance, evidence
from leadloom.plays import FIELD_SERVICE
from leadloom.standins import AWARDS_AS_OF, EVENTS_AS_OF

HITS = """
SELECT p.id FROM s_prospects p WHERE lower(trim(p.email)) IN (SELECT value_normalized FROM s_suppression WHERE kind = 'email')
  OR lower(split_part(p.email, '@', 2)) IN (SELECT value_normalized FROM s_suppression WHERE kind = 'domain')
  OR p.siren IN (SELECT value_normalized FROM s_suppression WHERE kind = 'siren')
"""


@query("p1_relevant_awards", f"""
SELECT id, dateAttribution, codeCPV, objetMarche, holder_digits AS titulaire_siret, montant
FROM ({RELEVANT.replace("{days}", "120")}) WHERE montant IS NULL OR montant >= 20000
""")
def p1(t):
    out = awards.filter_relevant(t.s_awards, FIELD_SERVICE, AWARDS_AS_OF, 120, min_amount=20000)
    return out.select("id", "dateAttribution", "codeCPV", "objetMarche", "titulaire_siret", "montant")


@query("p2_holder_id_and_amount", f"""
SELECT id, holder_digits AS holder, substring(holder_digits, 1, 9) AS siren,
  CASE WHEN montant IS NULL THEN 'missing' WHEN montant <= 0 THEN 'invalid' ELSE 'ok' END AS montant_quality, count(*) AS copies
FROM ({RELEVANT.replace("{days}", "2000")}) GROUP BY ALL
""")
def p2(t):
    out = awards.filter_relevant(t.s_awards, FIELD_SERVICE, AWARDS_AS_OF, 2000)
    return out.groupBy("id", F.col("titulaire_siret").alias("holder"), "siren", "montant_quality").agg(F.count(F.lit(1)).alias("copies"))


@query("p3_prospect_list", f"""
WITH last AS ({LAST_EVENT})
SELECT p.id, company_name, coalesce(l.event_type, 'New') AS current_status FROM s_prospects p LEFT JOIN last l ON l.prospect_id = p.id
WHERE NOT opted_out AND NOT anonymized AND urgency_score BETWEEN 10 AND 95
  AND (company_name ILIKE '%clim%' OR decision_maker_name ILIKE '%clim%' OR email ILIKE '%clim%') AND coalesce(l.event_type, 'New') = 'New'
""")
def p3(t):
    out = activity.list_filter(t.s_prospects, t.s_events, search="CLIM", min_score=10, max_score=95, status="New")
    return out.select("id", "company_name", "current_status")


@query("p4_sourcing_queue", """
SELECT id, company_name, acquisition_score FROM s_prospects
WHERE NOT anonymized AND NOT opted_out AND acquisition_score >= 20 AND decision_maker_name IS NOT NULL
  AND (needs_manual_review OR contact_confidence IN ('needs_review', 'none') OR contact_confidence IS NULL)
  AND (company_name ILIKE '%martin%' OR siren ILIKE '%martin%' OR siret ILIKE '%martin%' OR decision_maker_name ILIKE '%martin%' OR city ILIKE '%martin%')
""", whole="acquisition_score")
def p4(t):
    out = activity.sourcing_filter(t.s_prospects, min_acquisition=20, has_person=True, contact_filter="needs_review", search="martin")
    return out.select("id", "company_name", "acquisition_score")


@query("p5_play_activity_codes", """
WITH n AS (SELECT id, upper(replace(naf_code, '.', '')) AS c FROM s_prospects)
SELECT id, coalesce(substring(c, 1, 2) IN ('33', '43', '81', '71') AND c <> '7022Z' AND substring(c, 1, 2) NOT IN ('58', '61', '62', '63'), FALSE) AS wanted FROM n
""")
def p5(t):
    return t.s_prospects.select("id", passes_play(F.col("naf_code"), FIELD_SERVICE).alias("wanted"))


@query("p6_discovery_eligibility", f"""
WITH fresh AS (SELECT DISTINCT prospect_id FROM s_runs WHERE status IN ('completed', 'completed_with_warnings')
  AND finished_at >= TIMESTAMP '{EVENTS_AS_OF} 00:00:00' - INTERVAL '10' DAY)
SELECT id, CASE WHEN id IN ({HITS}) THEN 'suppressed' WHEN anonymized THEN 'anonymized' WHEN opted_out THEN 'opted_out'
  WHEN coalesce(nullif(opportunity_score, 0), nullif(acquisition_score, 0), 0) < 40 THEN 'below_opportunity_threshold'
  WHEN website IS NULL AND coalesce(email, '') NOT LIKE '%@%' THEN 'no_defensible_domain'
  WHEN id IN (SELECT prospect_id FROM fresh) THEN 'contact dossier is fresh' END AS ineligible_reason
FROM s_prospects
""")
def p6(t):
    keys = compliance.suppression_keys(email=F.col("email"), siren=F.col("siren"))
    hits = compliance.suppressed_ids(t.s_prospects, t.s_suppression, keys)
    out = activity.eligibility(t.s_prospects, t.s_runs, hits, EVENTS_AS_OF, refresh_days=10)
    return out.select("id", "ineligible_reason")


@query("p7_nightly_batch", """
SELECT id, opportunity_score FROM s_prospects WHERE NOT anonymized AND NOT opted_out AND opportunity_score >= 40
  AND (website IS NOT NULL OR email IS NOT NULL)
  AND (contact_discovery_state IS NULL OR contact_confidence IN ('none', 'needs_review', 'unverified'))
ORDER BY opportunity_score DESC, id LIMIT 8
""", whole="opportunity_score")
def p7(t):
    return activity.nightly_batch(t.s_prospects, 8).select("id", "opportunity_score")


@query("p8_enrich_batch", """
SELECT id, acquisition_score FROM s_prospects WHERE NOT anonymized AND NOT opted_out
  AND (last_enriched_at IS NULL OR decision_maker_name IS NULL OR acquisition_score < 55)
ORDER BY acquisition_score DESC, id LIMIT 30
""", whole="acquisition_score")
def p8(t):
    return activity.enrich_batch(t.s_prospects).select("id", "acquisition_score")


def fingerprint_sql(prefix: str = "") -> str:
    c = lambda name: f"coalesce({prefix}{name}, '')"
    return (
        f"substring(sha256(lower(trim({c('source_type')})) || '|' || upper(trim({c('signal_type')})) || '|' || "
        f"lower(trim({c('evidence_url')})) || '|' || "
        f"regexp_replace(lower(trim({c('evidence_text')})), '\\s+', ' ', 'g') || '|'), 1, 32)"
    )


SIGNALS = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prospect_id, fingerprint ORDER BY id) AS copy
  FROM (SELECT *, {fingerprint_sql()} AS fingerprint FROM s_evidence WHERE is_active) a) b WHERE copy = 1
"""


@query("p9_evidence_normalised", f"SELECT id, prospect_id, fingerprint FROM ({SIGNALS})")
def p9(t):
    return evidence.normalize_signals(t.s_evidence).select("id", "prospect_id", "fingerprint")


@query("p10_enum_validation", f"""
WITH v AS (SELECT id, lower(trim(CASE WHEN id % 9 = 0 THEN ' Verified ' WHEN id % 9 = 1 THEN 'sure' ELSE coalesce(contact_confidence, 'none') END)) AS c,
  lower(CASE WHEN id % 7 = 0 THEN 'Lucky' ELSE contact_discovery_state END) AS d FROM s_prospects)
SELECT id, c AS contact_confidence, d AS contact_discovery_state,
  concat_ws(', ', CASE WHEN c NOT IN ({sql_list(fixed.ALLOWED_CONFIDENCE)}) THEN 'invalid contact_confidence' END,
    CASE WHEN d NOT IN ({sql_list(fixed.ALLOWED_DISCOVERY)}) THEN 'invalid contact_discovery_state' END) AS problems FROM v
""")
def p10(t):
    k = F.col("id")
    rows = t.s_prospects.withColumns(
        {
            "contact_confidence": F.when(k % 9 == 0, " Verified ").when(k % 9 == 1, "sure").otherwise(F.col("contact_confidence")),
            "contact_discovery_state": F.when(k % 7 == 0, "Lucky").otherwise(F.col("contact_discovery_state")),
        }
    )
    out = compliance.validate_enums(rows)
    return out.select("id", "contact_confidence", "contact_discovery_state", F.array_join("failures", ", ").alias("problems"))


@query("p11_drafts_unlocked", f"""
SELECT id, coalesce(manual_review_state = 'accepted' AND qualification_decision = 'accept' AND NOT opted_out AND NOT anonymized
  AND id NOT IN ({HITS}), FALSE) AS unlocked FROM s_prospects
""")
def p11(t):
    return compliance.mark_suppressed(t.s_prospects, t.s_suppression).select("id", compliance.drafts_unlocked().alias("unlocked"))


GATED = f"""
WITH hits AS ({HITS}),
gated AS (SELECT e.*, CASE WHEN p.id IS NULL THEN 'not found'
  WHEN p.opted_out AND e.event_type <> 'OptOut' THEN 'Prospect has opted out — no further outreach events allowed'
  WHEN p.id IN (SELECT id FROM hits) AND e.event_type NOT IN ('OptOut', 'ClosedLost', 'Refused') THEN 'Suppressed contact/company — no outreach events allowed'
  WHEN e.event_type = 'Sent' AND p.data_source IS NULL THEN 'Cannot log Sent without data_source populated'
  WHEN e.event_type = 'Sent' AND p.informed_at IS NULL THEN 'Cannot log Sent without informed_at — record first-contact disclosure timestamp'
  WHEN e.event_type = 'Sent' AND p.contact_confidence IN ('domain_and_pattern_only', 'catch_all', 'guessed', 'invalid', 'bounced', 'risky')
    THEN 'Cannot log Sent with contact_confidence=' || p.contact_confidence || ' — confirm contact first' END AS reason
  FROM s_events e LEFT JOIN s_prospects p ON p.id = e.prospect_id)
"""


@query("p12_event_gate", GATED + " SELECT id, prospect_id, event_type, reason FROM gated")
def p12(t):
    return compliance.gate_events(t.s_events, t.s_prospects, t.s_suppression).select("id", "prospect_id", "event_type", "reason")


_GATE_INPUT = """
SELECT id, CASE id % 5 WHEN 0 THEN 'Active' WHEN 1 THEN 'incorporated' WHEN 2 THEN 'dissolved' ELSE 'active' END AS entity_status,
  CASE id % 7 WHEN 0 THEN 'sole_trader' WHEN 1 THEN 'EI' WHEN 2 THEN 'auto_entrepreneur' WHEN 3 THEN 'unincorporated_partnership' WHEN 4 THEN 'sas' END AS legal_form,
  CASE id % 3 WHEN 0 THEN 'rejected' WHEN 1 THEN 'candidate' ELSE 'verified_primary' END AS domain_verification_state,
  CASE id % 4 WHEN 0 THEN 'deny' ELSE 'allow_send' END AS compliance_decision,
  CASE id % 3 WHEN 0 THEN 'GB' WHEN 1 THEN 'FR' ELSE 'DE' END AS jurisdiction
FROM """


@query("p13_hard_gates", f"""
SELECT id, concat_ws(' ', CASE WHEN lower(entity_status) NOT IN ('active', 'incorporated') THEN 'Hard Gate Failed: Legal entity status is ''' || entity_status || ''' (must be active).' END,
  CASE WHEN lower(legal_form) IN ('sole_trader', 'auto_entrepreneur') THEN 'Hard Gate Failed: Legal form ''' || legal_form || ''' excluded in pilot.' END,
  CASE WHEN domain_verification_state = 'rejected' THEN 'Hard Gate Failed: Official company domain was rejected.' END,
  CASE WHEN compliance_decision = 'deny' THEN 'Hard Gate Failed: Compliance policy denied outreach.' END) AS reasons,
  lower(entity_status) IN ('active', 'incorporated') AND coalesce(lower(legal_form), '') NOT IN ('sole_trader', 'auto_entrepreneur')
  AND domain_verification_state <> 'rejected' AND compliance_decision <> 'deny' AS passed
FROM ({_GATE_INPUT} s_prospects) g
""")
def p13(t):
    rows = t.spark.sql(_GATE_INPUT + "{p}", p=t.s_prospects)
    out = compliance.hard_gates(rows)
    return out.select("id", F.array_join("rejection_reasons", " ").alias("reasons"), F.col("hard_gates_passed").alias("passed"))


@query("p14_compliance_policy", f"""
WITH g AS ({_GATE_INPUT} s_prospects), h AS ({HITS})
SELECT id, CASE WHEN id IN (SELECT id FROM h) THEN lower(jurisdiction) || '_b2b_policy' WHEN jurisdiction = 'GB' THEN 'uk_b2b_email_corporate_v1'
    WHEN jurisdiction = 'FR' THEN 'fr_b2b_email_optout_v1' ELSE 'generic_b2b_policy' END AS policy_code,
  CASE WHEN id IN (SELECT id FROM h) THEN 'deny'
    WHEN jurisdiction = 'GB' AND lower(legal_form) IN ('sole_trader', 'unincorporated_partnership') THEN 'deny'
    WHEN jurisdiction = 'FR' AND lower(legal_form) IN ('ei', 'auto_entrepreneur') THEN 'deny'
    WHEN jurisdiction IN ('GB', 'FR') THEN 'allow_send' ELSE 'needs_review' END AS compliance_decision
FROM g
""")
def p14(t):
    rows = t.spark.sql(_GATE_INPUT + "{p}", p=t.s_prospects.select("id"))
    keys = compliance.suppression_keys(email=F.col("email"), siren=F.col("siren"))
    hits = compliance.suppressed_ids(t.s_prospects, t.s_suppression, keys).withColumn("is_suppressed", F.lit(True))
    out = compliance.compliance(rows.join(hits, "id", "left"))
    return out.select("id", "policy_code", "compliance_decision")


@query("p15_stop_rules", f"""
WITH f AS (SELECT prospect_id, bool_or(event_type IN ({sql_list(fixed.REPLY_EVENTS)})) AS replied, bool_or(event_type = 'OptOut') AS out
  FROM s_events GROUP BY 1),
x AS (SELECT t.touch_id, CASE WHEN f.replied THEN 'prospect_replied' WHEN t.bounced THEN 'email_bounced' WHEN f.out THEN 'opt_out_requested'
  WHEN t.prospect_id IN ({HITS}) THEN 'suppression_entry_matched' END AS stop_reason FROM s_touches t LEFT JOIN f USING (prospect_id))
SELECT touch_id, stop_reason IS NOT NULL AS stopped, stop_reason FROM x
""")
def p15(t):
    keys = compliance.suppression_keys(email=F.col("email"), siren=F.col("siren"))
    hits = compliance.suppressed_ids(t.s_prospects, t.s_suppression, keys)
    return compliance.stop_rules(t.s_touches, t.s_events, hits).select("touch_id", "stopped", "stop_reason")


@query("p16_url_safety")
def p16(t):
    return with_safe_url(t.s_site_pages.select("page_id", "url"), "url", international=False).select("page_id", "safe.*")


_URL_FORMS = r"""
SELECT page_id, CASE page_id % 9 WHEN 0 THEN url WHEN 1 THEN ' ' WHEN 2 THEN 'ftp://' || rest WHEN 3 THEN 'https://user:pw@' || rest WHEN 4 THEN 'https://' || host || ':8080' || tail
  WHEN 5 THEN 'http://' || upper(host) || ':443' || tail WHEN 6 THEN 'http://10.1.2.' || CAST(page_id % 256 AS STRING) || '/x' WHEN 7 THEN 'http://intranet' || tail ELSE rest END AS url
FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://(.*)$', 1) AS rest, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) AS tail FROM """


@query("p16b_url_rules", rf"""
WITH given AS ({_URL_FORMS} s_site_pages) p),
parts AS (SELECT page_id, page_id % 9 AS form, lower(regexp_extract(url, '^(?:[a-z]+://)?([^/?#:]*)', 1)) AS host, regexp_extract(url, '^(?:[a-z]+://)?[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q,
  CASE WHEN url LIKE 'http://%' THEN 'http' ELSE 'https' END AS scheme FROM given)
SELECT page_id, CASE form WHEN 1 THEN 'empty_url' WHEN 2 THEN 'unsupported_scheme' WHEN 3 THEN 'embedded_credentials' WHEN 4 THEN 'port_not_allowed' WHEN 6 THEN 'non_public_address' WHEN 7 THEN 'blocked_hostname' END AS reason,
  CASE WHEN form IN (0, 5, 8) THEN host END AS host,
  CASE WHEN form IN (0, 5, 8) THEN scheme || '://' || host || CASE WHEN form = 5 THEN ':443' ELSE '' END || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS url FROM parts
""")
def p16b(t):
    given = t.spark.sql(_URL_FORMS.replace("'^", "r'^") + "{pages}) p", pages=t.s_site_pages)
    return with_safe_url(given, "url", international=False).select("page_id", "safe.reason", "safe.host", "safe.url")


@query("p17_same_host", """
SELECT a.page_id, a.host = regexp_replace(lower(split_part(regexp_replace(p.website, '^https?://', ''), '/', 1)), '^www[.]', '') AS same
FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www[.]', '') AS host FROM s_site_pages) a
JOIN s_prospects p ON p.id = a.page_id % 1000000000 WHERE p.website IS NOT NULL
""")
def p17(t):
    host = F.substring_index(F.regexp_replace("website", "^https?://", ""), "/", 1)
    joined = t.s_site_pages.join(t.s_prospects, F.col("page_id") % 1000000000 == F.col("id")).filter(F.col("website").isNotNull())
    return joined.select("page_id", same_host(F.col("url"), host).alias("same"))


@query("p18_bulk_event", f"""
WITH ids AS (SELECT CAST(o_orderkey AS BIGINT) AS id FROM orders), h AS ({HITS}),
r AS (SELECT i.id, CASE WHEN p.id IS NULL THEN 'error' WHEN p.opted_out THEN 'skipped' WHEN p.id IN (SELECT id FROM h) OR p.data_source IS NULL
  OR p.informed_at IS NULL OR p.contact_confidence IN ('domain_and_pattern_only', 'catch_all', 'invalid') THEN 'error' ELSE 'updated' END AS outcome
  FROM ids i LEFT JOIN s_prospects p ON p.id = i.id)
SELECT outcome, count(*) AS n FROM r GROUP BY 1
""")
def p18(t):
    ids = t.orders.select(F.col("o_orderkey").alias("id"))
    out = compliance.bulk_event_outcomes(ids, t.s_prospects, t.s_suppression, "Sent")
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


REVIEW_ERRORS = f"""
SELECT r.*, CASE WHEN p.id IS NULL THEN 'Not found' WHEN decision NOT IN ('accept', 'reject', 'research_more', 'park') THEN 'Invalid decision'
  WHEN decision = 'accept' AND p.id IN ({HITS}) THEN 'Cannot accept: this prospect is on the suppression list (email, domain, or SIREN). Remove suppression first.'
  WHEN decision = 'accept' AND NOT (fit_confirmed AND pain_confirmed AND trigger_confirmed AND buyer_confirmed AND contact_confirmed AND offer_match_confirmed)
  THEN 'Cannot accept. Missing required confirmations: ' || concat_ws(', ', CASE WHEN NOT fit_confirmed THEN 'fit_confirmed' END,
    CASE WHEN NOT pain_confirmed THEN 'pain_confirmed' END, CASE WHEN NOT contact_confirmed THEN 'contact_confirmed' END,
    CASE WHEN NOT offer_match_confirmed THEN 'offer_match_confirmed' END) || '. Do not accept on award alone without verified pain.' END AS error
FROM s_reviews r LEFT JOIN s_prospects p ON p.id = r.prospect_id
"""


@query("p19_review_gate", f"SELECT id, prospect_id, decision, error FROM ({REVIEW_ERRORS})")
def p19(t):
    return compliance.gate_reviews(t.s_reviews, t.s_prospects, t.s_suppression).select("id", "prospect_id", "decision", "error")


def manual_entries(t):
    """Hand-entered points derived from the point facts, some of them wrong."""
    k = F.col("ord")
    return t.s_point_facts.select(
        "ord", "prospect_id",
        F.when(k % 23 == 0, "fax").otherwise(F.col("kind")).alias("kind"),
        "value",
        F.when(k % 29 == 0, "secret").otherwise(F.col("publication_state")).alias("publication_state"),
        F.when(k % 31 == 0, "http://127.0.0.1/x").otherwise(F.concat(F.lit("https://c"), (F.col("prospect_id") - F.col("prospect_id") % 3).cast("string"), F.lit(".example.fr/p"))).alias("source_url"),
    )


@query("p20_manual_point_gate", """
WITH m AS (SELECT ord, CASE WHEN ord % 23 = 0 THEN 'fax' ELSE kind END AS kind, publication_state FROM s_point_facts)
SELECT ord, kind, CASE WHEN kind NOT IN ('email', 'phone', 'contact_form', 'linkedin', 'generic_contact_page') THEN 'Unsupported contact type'
  WHEN ord % 29 = 0 THEN 'Invalid publication state' WHEN ord % 31 = 0 THEN 'non_public_address' END AS error FROM m
""")
def p20(t):
    return compliance.gate_manual_points(manual_entries(t), international=False).select("ord", "kind", "error")
