"""Prospect tables derived from the driver's tables.

The driver's tables hold no prospects, so the registered queries run on views
over them.  Each view is written once in SQL that Spark and DuckDB both read;
the queries use it as a DataFrame, the oracle texts as a common table
expression.  Every view covers its whole source table and grows with it.
Table names in braces are the driver's tables or other views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AWARDS_AS_OF = "2001-11-04"
HISTORY_AS_OF = "2001-08-15"
EVENTS_AS_OF = "2024-01-31"

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
                 "embeddings", "pages", "benchmark", "labels", "conversations")


def pick(key: str, *values: str | int | None) -> str:
    """A CASE that cycles through values by ``key`` modulo their number."""

    def show(value: str | int | None) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, int):
            return str(value)
        return value[1:] if value.startswith("=") else "'" + value.replace("'", "''") + "'"

    n = len(values)
    branches = " ".join(f"WHEN {i} THEN {show(v)}" for i, v in enumerate(values[:-1]))
    return f"CASE ({key}) % {n} {branches} ELSE {show(values[-1])} END"


def part_of(key: str, size: int) -> str:
    """The integer quotient of ``key`` and ``size``."""
    return f"CAST(floor(({key}) / {size}) AS BIGINT)"


def padded(key: str, width: int) -> str:
    return f"lpad(CAST({key} AS STRING), {width}, '0')"


HOST = "'c' || CAST(k - k % 3 AS STRING) || '.example.fr'"
PEOPLE = ("Jean Martin", "Mme Élodie Martin-Dupont", "Dr. Luc Robert", "Marie Durand", "Paul Petit")
LOCALS = ("jean.martin", "elodie.martindupont", "l.robert", "mariedurand", "petit")
TITLES = ("Gérant", "Directeur des opérations", "Responsable maintenance", "DAF", "Directeur commercial", "Fondateur",
          "CTO", None)
CONFIDENCES = ("none", "deliverable", "verified", "published_personal", "published_generic", "likely", "catch_all",
               "invalid", "manual_confirmed", "needs_review", "unverified", "domain_and_pattern_only", None)
NAF = ("43.22B", "6201Z", "81.10Z", "7112B", "4120A", "56.10A", None, "33.12Z", "7022Z", "5210B", "63.11Z")

VIEWS: dict[str, str] = {}

VIEWS["s_awards"] = f"""
SELECT CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING) AS id,
       substring(CAST(l.l_shipdate AS STRING), 1, 10) AS dateAttribution,
       CASE p.p_type WHEN 'ECONOMY' THEN '50710000' WHEN 'STANDARD' THEN '45331000' WHEN 'PROMO' THEN '72000000'
            WHEN 'SMALL' THEN '30000000' WHEN 'MEDIUM' THEN '71330000' ELSE '90910000' END AS codeCPV,
       {pick("p.p_size", "Contrat maintenance ", "Installation Climatisation ", "Développement logiciel ", "Fourniture ",
             "Dépannage technicien ")} || p.p_name AS objetMarche,
       CASE WHEN l.l_suppkey % 10 = 9 THEN {padded("l.l_suppkey * 31", 9)}
            WHEN l.l_suppkey % 10 = 8 THEN {padded("l.l_suppkey * 31", 11)}
            ELSE {padded("l.l_suppkey * 31", 9)} || {padded("l.l_linenumber", 5)} END AS titulaire_siret,
       'Supplier ' || CAST(l.l_suppkey AS STRING) AS titulaire_nom,
       CASE WHEN l.l_orderkey % 97 = 0 THEN NULL ELSE l.l_extendedprice END AS montant,
       CAST(o.o_custkey AS STRING) AS acheteur_nom
FROM {{lineitem}} l
JOIN {{part}} p ON p.p_partkey = l.l_partkey
JOIN {{orders}} o ON o.o_orderkey = l.l_orderkey
"""

VIEWS["s_prospects"] = f"""
SELECT k AS id,
       {pick("k", "Froid Pro ", "Société Clim ", "Apex Refrigeration ", "Acme HVAC & Cooling ", "Général Dépannage ")}
           || CAST({part_of("k", 2)} AS STRING) || {pick("k", " SAS", " Limited", " SARL", " PLC", "")} AS company_name,
       {pick("k", "Field Services", "IT / Digital", "Facilities / Maintenance", "Engineering", "Construction", "Other")} AS sector,
       {pick("k", "1-10", "11-50", "51-200", "200+", "unknown", "11-50", "1-10")} AS company_size,
       {pick("k", "DECP_WIN", "BOAMP_WIN", "PUBLIC_AWARD", "REGISTRY_FIELD", "STRUCTURAL", "MOROCCO_OPS", "PAIN_POST",
             "REGISTRY_IT", "OTHER")} AS signal_type,
       {pick(part_of("k", 3), "1 award(s) · multiple wins", "planning via Excel", "maintenance techniciens agences", None,
             "audit cyber", "contrat 24/7 astreinte", "double saisie et papier")} AS signal_details,
       {pick(part_of("k", 2), *PEOPLE, None)} AS decision_maker_name,
       {pick(part_of("k", 5), *TITLES)} AS decision_maker_title,
       CASE WHEN k % 7 = 3 THEN 'https://www.linkedin.com/in/p' || CAST(k AS STRING) END AS linkedin_url,
       CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 'contact@' || {HOST}
            ELSE {pick(part_of("k", 2), *LOCALS, "info")} || '@' || {HOST} END AS email,
       CASE WHEN k % 6 = 2 THEN '01 44 55 ' || {padded("k % 90 + 10", 2)} || ' 77' END AS phone,
       CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 'https://www.' || {HOST} || '/accueil' ELSE {HOST} END AS website,
       {padded("k", 9)} AS siren,
       CASE WHEN k % 5 <> 0 THEN {padded("k", 9)} || '00012' END AS siret,
       {pick("k", *NAF)} AS naf_code,
       {pick("k", *CONFIDENCES)} AS contact_confidence,
       {pick(part_of("k", 4), "published", "inferred", "guessed", "user_supplied", None)} AS contact_discovery_state,
       {pick(part_of("k", 7), "company_website", "domain_pattern", "none")} AS contact_source,
       CASE WHEN k % 11 = 0 THEN NULL ELSE {pick("k", "DECP", "Annuaire")} END AS data_source,
       {pick("k", "DECP", "BOAMP", "LinkedIn", "Manual", "Registry", "Annuaire", "Website", "Jobs")} AS source,
       CASE WHEN k % 6 = 0 THEN NULL ELSE CAST('2024-01-05 09:00:00' AS TIMESTAMP) END AS informed_at,
       k % 17 = 0 AS opted_out,
       k % 19 = 0 AS anonymized,
       CASE WHEN k % 10 = 0 THEN 0 ELSE CAST((k * 37) % 101 AS INT) END AS opportunity_score,
       CASE WHEN k % 20 = 0 THEN 0 ELSE CAST((k * 53) % 101 AS INT) END AS acquisition_score,
       CAST((k * 71) % 101 AS INT) AS urgency_score,
       CAST((k * 29) % 101 AS INT) AS fit_score,
       CAST((k * 43) % 101 AS INT) AS timing_score,
       {pick("k", "High", "Medium", "Low", "Medium")} AS priority_level,
       {pick(part_of("k", 3), "contact_ready", "human_review_required", "contact_required", "research_required",
             "insufficient_identity", "suppressed", None)} AS readiness_state,
       {pick(part_of("k", 2), "unreviewed", "accepted", "rejected", "parked", "research_more")} AS manual_review_state,
       {pick(part_of("k", 2), None, "accept", "reject")} AS qualification_decision,
       k % 3 = 0 AS needs_manual_review,
       {pick("k", "discovered", "researching", "enriched", "contact_ready", "parked")} AS acquisition_stage,
       {pick("k", None, "FIELD_SERVICE_OPERATIONS_FR", "FIELD_OPERATIONS_UK_V1", "OTHER_PLAY")} AS market_play_code,
       {pick("k", None, "notes libres", "suivi sur whatsapp", "flotte de véhicules", "")} AS notes,
       {pick("k", "Lyon", "Paris", "Lille", None)} AS city,
       CASE WHEN k % 4 = 1 THEN NULL ELSE CAST('2024-01-20 00:00:00' AS TIMESTAMP) END AS last_enriched_at,
       CAST({pick("k", "2024-01-28 10:00:00", "2023-06-01 00:00:00", "2020-01-15 08:30:00", "2024-01-10 00:00:00")} AS TIMESTAMP) AS created_at,
       CAST({pick(part_of("k", 2), None, "2024-01-15 12:00:00", "2020-06-30 00:00:00", "2021-01-31 00:00:00", "2019-12-01 00:00:00")} AS TIMESTAMP) AS updated_at,
       CASE WHEN k % 9 = 0 THEN 'Hiring' END AS why_now,
       CASE WHEN k % 8 = 0 THEN 'Paper job sheets' END AS suspected_pain,
       CASE WHEN k % 2 = 0 THEN '2001-05-01' END AS last_tender_date,
       CAST(NULL AS STRING) AS recommended_offer,
       CAST(NULL AS STRING) AS recommended_buyer_role,
       c_nationkey AS country_key
FROM (SELECT c_custkey AS k, c_nationkey FROM {{customer}}) c
"""

VIEWS["s_events"] = f"""
SELECT event_id AS id, user_id AS prospect_id, ts AS event_date,
       {pick("event_id", "Email", "LinkedIn", "Phone")} AS channel,
       CASE event_type WHEN 'view' THEN 'Sent' WHEN 'signup' THEN 'New'
            WHEN 'click' THEN {pick("event_id", "Replied", "PositiveConversation", "Replied")}
            WHEN 'purchase' THEN {pick("event_id", "MeetingBooked", "ClosedWon", "ProposalSent", "MeetingBooked")}
            ELSE {pick(part_of("event_id", 2), "Refused", "ClosedLost", "Sent", "Refused", "Sent", "New", "Refused", "OptOut")} END AS event_type,
       CASE WHEN event_id % 3 = 0 THEN NULL
            ELSE {pick(part_of("event_id", 4), "  Trop cher ", "Pas le moment", "Déjà équipés", "TROP CHER", " ")} END AS notes,
       CASE WHEN event_id % 4 <> 0 THEN {pick("event_id", "Relancer", "Appeler", "Envoyer devis")} END AS next_action,
       CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ts + INTERVAL '5' DAY WHEN 2 THEN ts + INTERVAL '1' DAY
            ELSE ts + INTERVAL '20' DAY END AS next_action_date
FROM {{events}}
"""

VIEWS["s_award_rows"] = f"""
SELECT o_custkey AS prospect_id, CAST({part_of("o_orderkey", 2)} AS STRING) AS id,
       CASE WHEN o_orderkey % 113 = 0 THEN NULL WHEN o_orderkey % 127 = 0 THEN 'n/a'
            ELSE substring(CAST(o_orderdate AS STRING), 1, 10) END AS date,
       {pick("o_orderkey", "Contrat maintenance froid", "Dépannage chaudières", "Fourniture de pièces")} AS objet,
       '50710000' AS cpv,
       CASE WHEN o_orderkey % 41 = 0 THEN 'n.c.' WHEN o_orderkey % 43 = 0 THEN NULL
            ELSE CAST(CAST(floor(o_totalprice / 40) AS BIGINT) AS STRING) END AS montant,
       'ok' AS montant_quality,
       o_orderpriority AS acheteur
FROM {{orders}}
"""

VIEWS["s_evidence"] = f"""
SELECT o_orderkey AS id, o_custkey AS prospect_id,
       {pick(part_of("o_orderkey", 24), "structural_fit", "trigger", "pain", "trigger", "value", "contact", "structural_fit")} AS category,
       {pick(part_of("o_orderkey", 4), "PUBLIC_AWARD_RECENT", "EXCEL_OR_MANUAL_REPORTING_MENTION", "REGISTRY_ACTIVITY",
             "pain_dispatch", None, "MULTI_SITE_OPERATIONS")} AS signal_type,
       {pick(part_of("o_orderkey", 8), "Recent public award", "Excel reporting", None, "Several sites")} AS label,
       {pick("o_orderkey", " Evidence   text ", "planning papier")} AS evidence_text,
       CASE WHEN o_orderkey % 50 = 0 THEN ' HTTPS://Example.fr/Page ' END AS evidence_url,
       {pick(part_of("o_orderkey", 2), "decp", "annuaire", "Recherche", "Annuaire Entreprises", "website", " DECP ", "unknown",
             None, "jobs")} AS source_type,
       {pick("o_orderkey", 70, None, 0, 55)} AS confidence,
       {pick(part_of("o_orderkey", 3), 65, None, 0, 40, 230)} AS strength,
       o_orderkey % 10 <> 0 AS is_active,
       o_orderkey % 12 = 0 AS manually_confirmed,
       o_orderdate AS observed_at
FROM {{orders}}
"""

_REVIEW = f"""
SELECT doc_id + {{shift}} AS id, doc_id AS prospect_id,
       {pick("doc_id + {part}", "accept", "reject", "accept", "research_more", "park", "accept", "maybe")} AS decision,
       quality = 1 AS fit_confirmed, {{pain}} AS pain_confirmed, TRUE AS trigger_confirmed, TRUE AS buyer_confirmed,
       toxic = 0 AS contact_confirmed, doc_id % 5 <> 0 AS offer_match_confirmed,
       CASE WHEN doc_id % 3 = 0 THEN 'à revoir' END AS notes,
       CAST('{{stamp}}' AS TIMESTAMP) AS created_at
FROM {{{{labels}}}}
"""


def _review(shift: int, part: int, pain: str, stamp: str) -> str:
    text = _REVIEW
    for name, value in (("{shift}", shift), ("{part}", part), ("{pain}", pain), ("{stamp}", stamp)):
        text = text.replace(name, str(value))
    return text.replace("{{labels}}", "{labels}")


VIEWS["s_reviews"] = (
    _review(0, 0, "doc_id % 2 = 0", "2024-01-10 10:00:00")
    + " UNION ALL "
    + _review(1000000000, 2, "TRUE", "2024-01-10 10:00:00")
)

VIEWS["s_suppression"] = f"""
SELECT 'email' AS kind, lower(email) AS value_normalized, 'opt_out' AS reason, 'outreach' AS source
FROM {{s_prospects}} WHERE id % 23 = 2 AND email IS NOT NULL
UNION ALL
SELECT 'domain', 'c' || CAST(id - id % 3 AS STRING) || '.example.fr', 'legal', 'manual' FROM {{s_prospects}} WHERE id % 87 = 5
UNION ALL
SELECT 'siren', siren, 'opt_out', 'outreach' FROM {{s_prospects}} WHERE id % 31 = 7
UNION ALL
SELECT 'person', 'p' || CAST(id AS STRING), 'operator_suppressed', 'contact_intelligence' FROM {{s_prospects}} WHERE id % 61 = 1
"""

VIEWS["s_tasks"] = f"""
SELECT event_id AS id, user_id AS prospect_id,
       {pick("event_id", "first_outreach", "research", "confirm_buyer_identity", "review_catch_all_email", "call_back",
             "confirm_linkedin_profile", "use_contact_form")} AS task_type,
       'Task ' || CAST(event_id AS STRING) AS title,
       CAST(NULL AS STRING) AS notes,
       CASE WHEN event_id % 37 = 0 THEN 'open' ELSE {pick("event_id", "completed", "cancelled")} END AS status,
       {pick(part_of("event_id", 37), "contact_intelligence", "manual", "contact_intelligence")} AS origin,
       50 AS priority,
       ts AS due_date,
       CAST(NULL AS TIMESTAMP) AS completed_at
FROM {{events}}
"""

VIEWS["s_runs"] = f"""
SELECT event_id AS id, user_id AS prospect_id, ts AS started_at, ts AS finished_at,
       {pick(part_of("event_id", 3), "failed", "running", "completed", "failed", "completed_with_warnings", "failed", "failed")} AS status
FROM {{events}} WHERE event_type = 'error'
"""

VIEWS["s_assets"] = """
SELECT r_regionkey AS id,
       CASE r_regionkey % 5 WHEN 0 THEN 'FIELD_SERVICE_OPERATIONS_FR' WHEN 1 THEN 'OTHER_PLAY' WHEN 2 THEN NULL
            WHEN 3 THEN 'FIELD_OPERATIONS_UK_V1' ELSE 'RETIRED' END AS market_play_code,
       r_regionkey % 5 IN (0, 4) AS is_active
FROM {region}
"""

VIEWS["s_companies"] = f"""
SELECT 's' || CAST(s_suppkey AS STRING) AS company_id,
       {pick("s_suppkey", "Apex Refrigeration ", "Société Clim ", "Froid Pro ")} || CAST(s_suppkey % 40 AS STRING)
           || {pick("s_suppkey", " Limited", " SAS", "")} AS canonical_name,
       {pick("s_suppkey", "GB", "FR")} AS country_code
FROM {{supplier}}
"""

VIEWS["s_identifiers"] = f"""
SELECT 's' || CAST(s_suppkey AS STRING) AS company_id,
       {pick("s_suppkey", "companies_house_number", "siren")} AS scheme,
       'GB' || {padded("s_suppkey", 7)} AS value_normalized
FROM {{supplier}} WHERE s_suppkey % 3 <> 0
"""

VIEWS["s_observations"] = f"""
SELECT k AS obs_id,
       {pick("k", "apex refrigeration, ", "SOCIÉTÉ CLIM ", "Froid-Pro ", "Froid Pro ")} || CAST(k % 60 AS STRING)
           || {pick("k", " LTD", " sarl", " Ltd.")} AS company_name,
       {pick(part_of("k", 2), "GB", "FR")} AS country_code,
       {pick(part_of("k", 3), "companies_house_number", "siren", None)} AS identifier_scheme,
       CASE WHEN k % 2 = 0 THEN ' gb' || {padded("k % 300", 7)} || ' ' END AS identifier_value
FROM (SELECT c_custkey AS k FROM {{customer}}) c
"""

_PERSON = f"""
SELECT k AS id, prospect_id,
       {pick("k", *PEOPLE)} AS full_name,
       {pick(part_of("k", 5), "Gérant", "Directrice des opérations", "DAF", "Responsable SAV", "Comptable", None)} AS job_title,
       CAST(20 + (k * 13) % 80 AS INT) AS buyer_role_score,
       'probable' AS company_match_state,
       CAST(50 + (k * 7) % 45 AS INT) AS identity_confidence,
       CASE WHEN k % 4 = 1 THEN 'https://www.linkedin.com/in/x' || CAST(k AS STRING) END AS linkedin_url
FROM (SELECT o_orderkey AS k, o_custkey AS prospect_id FROM {{orders}} WHERE {{side}}) o
"""

OLD_SIDE = "o_orderdate < CAST('1996-01-01' AS TIMESTAMP)"
NEW_SIDE = "o_orderdate >= CAST('1996-01-01' AS TIMESTAMP)"

# Stored people are unique by prospect, name and role: the lowest order of each group is kept.
VIEWS["s_people"] = f"""
SELECT id, prospect_id, full_name, {pick("id", "jean martin", "elodie martin-dupont", "luc robert", "marie durand", "paul petit")} AS normalized_name,
       {pick(part_of("id", 5), "gerant", "directrice des operations", "daf", "responsable sav", "comptable", "unknown")} AS normalized_role,
       {pick(part_of("id", 5), "owner", "operations", "administration_finance", "service", "other", "unknown")} AS role_category,
       CAST(NULL AS STRING) AS first_name, CAST(NULL AS STRING) AS last_name,
       job_title, buyer_role_score, company_match_state, identity_confidence, linkedin_url,
       id % 11 = 0 AS manually_confirmed, id % 13 <> 0 AS is_active, id % 9 = 0 AS is_primary_candidate
FROM ({_PERSON.replace("{side}", OLD_SIDE)}) p
WHERE id IN (SELECT min(o_orderkey) FROM {{orders}} WHERE {OLD_SIDE}
             GROUP BY o_custkey, o_orderkey % 5, {part_of("o_orderkey", 5)} % 6)
"""

VIEWS["s_person_facts"] = f"""
SELECT id AS ord, prospect_id, full_name, job_title, buyer_role_score, company_match_state, identity_confidence, linkedin_url,
       CAST(NULL AS STRING) AS role_category, CAST(NULL AS STRING) AS normalized_role
FROM ({_PERSON.replace("{side}", NEW_SIDE)}) p
"""

_POINT = f"""
SELECT k AS id, prospect_id,
       {pick("k", "email", "phone", "email", "contact_form", "linkedin", "email", "website")} AS kind,
       {pick(
           "k",
           "=" + pick(part_of("k", 7), *LOCALS) + " || '@c' || CAST(prospect_id - prospect_id % 3 AS STRING) || '.example.fr'",
           "='+3314455' || " + padded("k % 3 + 10", 4),
           "='contact@c' || CAST(prospect_id - prospect_id % 3 AS STRING) || '.example.fr'",
           "='https://C' || CAST(prospect_id - prospect_id % 3 AS STRING) || '.example.fr/Devis'",
           "='https://www.linkedin.com/in/P' || CAST(k % 4 AS STRING)",
           "=' Info@C' || CAST(prospect_id - prospect_id % 3 AS STRING) || '.Example.fr. '",
           "='https://c' || CAST(prospect_id - prospect_id % 3 AS STRING) || '.example.fr/'",
       )} AS value,
       {pick(part_of("k", 7), "published_personal", "published_generic", "not_published", "published_role", "unknown")} AS publication_state,
       {pick(part_of("k", 3), "strong_person_match", "generic_company_mailbox", "name_only_guess", "exact_person_pattern_confirmed",
             "pattern_inferred", "unknown")} AS person_match_state,
       {pick(part_of("k", 2), "unchecked", "deliverable", "unchecked", "catch_all", "unchecked", "invalid", "unchecked", "risky")} AS deliverability_state,
       {pick(part_of("k", 4), "company_website", "structured_data", "domain_pattern", "manual_operator", "legacy", "public_registry")} AS source_class,
       CASE WHEN k % 6 = 0 THEN {pick("k", *PEOPLE)} END AS person_name,
       CAST(30 + (k * 17) % 70 AS INT) AS confidence
FROM (SELECT o_orderkey AS k, o_custkey AS prospect_id FROM {{orders}} WHERE {{side}}) o
"""

# Stored points are unique by prospect, kind and value.
VIEWS["s_points"] = f"""
SELECT id, prospect_id, person_id, kind, value_normalized, value_display, domain, source_class, publication_state,
       person_match_state, deliverability_state, verification_state, utility_state, confidence_score, manually_confirmed,
       rejection_reason, is_usable, requires_manual_review, is_suppressed, is_primary
FROM (
  SELECT id, prospect_id, CASE WHEN id % 4 = 0 THEN id END AS person_id, kind,
         CASE WHEN kind = 'email' THEN lower(trim(replace(value, '. ', ''))) WHEN kind = 'phone' THEN value ELSE lower(value) END AS value_normalized,
         trim(value) AS value_display,
         CASE WHEN kind <> 'phone' THEN 'c' || CAST(prospect_id - prospect_id % 3 AS STRING) || '.example.fr' END AS domain,
         source_class, publication_state, person_match_state, deliverability_state,
         deliverability_state AS verification_state,
         {pick("id", "usable_personal", "usable_role", "usable_generic", "manual_confirmation_required", "verification_required",
               "stale", "no_contact", "invalid")} AS utility_state,
         confidence AS confidence_score, id % 17 = 0 AS manually_confirmed,
         CASE WHEN id % 19 = 0 THEN 'operator_rejected' END AS rejection_reason,
         id % 8 IN (0, 1, 2) AS is_usable, id % 8 IN (3, 4, 5) AS requires_manual_review, id % 29 = 0 AS is_suppressed,
         id % 10 = 0 AS is_primary,
         row_number() OVER (PARTITION BY prospect_id, kind,
             CASE WHEN kind = 'email' THEN lower(trim(replace(value, '. ', ''))) WHEN kind = 'phone' THEN value ELSE lower(value) END
             ORDER BY id) AS copy_number
  FROM ({_POINT.replace("{side}", OLD_SIDE)}) p
) q WHERE copy_number = 1
"""

VIEWS["s_point_facts"] = f"""
SELECT id AS ord, prospect_id, kind, value, publication_state, person_match_state, 'unchecked' AS deliverability_state,
       source_class, person_name, confidence, CASE WHEN id % 5 = 0 THEN id END AS person_id
FROM ({_POINT.replace("{side}", NEW_SIDE)}) p
"""

VIEWS["s_contact_evidence"] = f"""
SELECT o_orderkey AS id, o_orderkey AS ord, o_custkey AS prospect_id,
       {pick("o_orderkey", "published_email", "published_person", "published_phone")} AS evidence_type,
       {pick(part_of("o_orderkey", 3), "official_website", "public_registry")} AS source_adapter,
       CASE WHEN o_orderkey % 7 <> 0 THEN 'https://c' || CAST(o_custkey - o_custkey % 3 AS STRING) || '.example.fr/p' || CAST(o_orderkey % 8 AS STRING) END AS source_url,
       CAST(NULL AS STRING) AS page_title, 'extrait' AS excerpt, CAST(NULL AS STRING) AS content_hash,
       CASE o_orderkey % 3 WHEN 0 THEN 'Contact@C' || CAST(o_custkey - o_custkey % 3 AS STRING) || '.example.fr' WHEN 2 THEN '+33144550010' END AS contact_value,
       CASE WHEN o_orderkey % 3 = 1 THEN {pick("o_orderkey", *PEOPLE)} END AS person_name,
       CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey % 40 END AS person_id,
       CASE WHEN o_orderkey % 3 <> 1 THEN o_orderkey % 60 END AS contact_point_id,
       CAST((o_orderkey * 3) % 130 AS INT) AS confidence
FROM {{orders}}
"""

VIEWS["s_verdicts"] = f"""
SELECT DISTINCT {pick("id", *LOCALS, "contact", "info")} || '@c' || CAST(id - id % 3 AS STRING) || '.example.fr' AS email,
       {pick("id % 7 + (id - id % 3) * 3", "safe", "risky", "invalid", "unknown")} AS is_reachable,
       (id - id % 3) % 9 = 0 AS is_deliverable,
       {pick("id % 7 + (id - id % 3) * 3", "deliverable", "risky", "invalid", "catch_all", "indeterminate")} AS confidence
FROM (SELECT c_custkey AS id FROM {{customer}}) c
"""

VIEWS["s_mx"] = f"""
SELECT DISTINCT 'c' || CAST(c_custkey - c_custkey % 3 AS STRING) || '.example.fr' AS domain,
       {pick("c_custkey - c_custkey % 3", "ok", "no_mx", "timeout", "ok", "null_mx")} AS state,
       (c_custkey - c_custkey % 3) % 5 IN (0, 3) AS has_mx
FROM {{customer}}
"""

VIEWS["s_pages"] = """
SELECT page_id, url, html, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www[.]', '') AS host
FROM {pages}
"""

# Company pages in the shape of contact pages, three per customer; the driver's own pages come along.
VIEWS["s_site_pages"] = f"""
SELECT page_id, url, html FROM {{pages}}
UNION ALL
SELECT 1000000000 + c_custkey, 'https://www.c' || CAST(c_custkey - c_custkey % 3 AS STRING) || '.example.fr/contact?c=' || CAST(c_custkey AS STRING),
       '<html><head><title>Contact Froid Pro</title></head><body><a href="tel:+331445500' || {padded("c_custkey % 90 + 10", 2)}
       || '">appel</a><p>contact@c' || CAST(c_custkey - c_custkey % 3 AS STRING) || '.example.fr</p><form action="/devis"><input name="email"></form></body></html>'
FROM {{customer}}
UNION ALL
SELECT 2000000000 + c_custkey, 'https://c' || CAST(c_custkey - c_custkey % 3 AS STRING) || '.example.fr/equipe/' || CAST(c_custkey AS STRING),
       '<html><head><title>Équipe Société Clim</title></head><body><h2>Jean Martin</h2><p>Directeur technique</p><p>maintenance contracts and agences, 24/7</p>'
       || '<a href="mailto:jean.martin@c' || CAST(c_custkey - c_custkey % 3 AS STRING) || '.example.fr">mail</a>'
       || '<script type="application/ld+json">{{{{"@type":"Person","name":"Marie Durand","jobTitle":"Gérante"}}}}</script></body></html>'
FROM {{customer}}
"""

VIEWS["s_doc_pages"] = """
SELECT conv_id AS doc_id, turn + 1 AS page_no, 'https://c' || CAST(conv_id - conv_id % 3 AS STRING) || '.example.fr/doc.pdf' AS url,
       text || CASE WHEN role = 'assistant' THEN ' contact@c' || CAST(conv_id - conv_id % 3 AS STRING) || '.example.fr' ELSE '' END AS text
FROM {conversations}
"""

VIEWS["s_touches"] = """
SELECT o_orderkey AS touch_id, o_custkey AS prospect_id, o_totalprice > 300000 AS bounced FROM {orders}
"""

VIEWS["s_registry"] = f"""
SELECT k AS sighting, {padded(part_of("k", 2), 9)} AS siren,
       CASE WHEN k % 3 <> 0 THEN {padded(part_of("k", 2), 9)} || '00077' END AS siret,
       'Registre ' || CAST({part_of("k", 2)} AS STRING) AS company_name,
       {pick("k", "4322B", "6201Z", "8110Z", "5610A", "7112B", None, "3312Z", "4120A")} AS naf_code,
       {pick("k", "Field Services", "IT / Digital", "Other")} AS sector,
       {pick(part_of("k", 3), "1-10", "11-50", "51-200", "unknown")} AS company_size,
       CASE WHEN k % 4 <> 1 THEN {pick("k", *PEOPLE)} END AS decision_maker_name,
       CASE WHEN k % 4 <> 1 THEN 'Gérant' END AS decision_maker_title,
       CAST(k % 4 AS INT) AS establishments,
       k % 6 = 0 AS by_code
FROM (SELECT o_orderkey AS k FROM {{orders}}) o
"""

_NAME = re.compile(r"(?<!\{)\{([a-z_]+)\}(?!\})")


def needed(text: str) -> list[str]:
    return sorted(set(_NAME.findall(text)))


class Tables:
    """The driver's tables and the views above as DataFrames of one session."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in VIEWS and name not in DRIVER_TABLES):
            raise AttributeError(name)
        if name not in self._frames:
            if name in VIEWS:
                frames = {part: getattr(self, part) for part in needed(VIEWS[name])}
                self._frames[name] = self.spark.sql(VIEWS[name], **frames)
            else:
                self._frames[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._frames[name]


def view_sql(name: str) -> str:
    """The DuckDB text of one view."""
    return _NAME.sub(lambda m: m.group(1), VIEWS[name]).replace("{{", "{").replace("}}", "}").strip()


def with_views(sql: str) -> str:
    """Prefix a query with the views it names, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for part in needed(VIEWS[name]):
            if part in VIEWS:
                visit(part)
        if name not in ordered:
            ordered.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            visit(name)
    if not ordered:
        return sql.strip()
    parts = ", ".join(f"{name} AS ({view_sql(name)})" for name in ordered)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {parts}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {parts}, {body[5:]}"
    return f"WITH {parts} {body}"
