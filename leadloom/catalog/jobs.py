"""Jobs and streams."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.catalog import query, sql_list
from leadloom.catalog.activity import HOLDERS
from leadloom.catalog.contacts import POINT_RANKS
from leadloom.catalog.gates import GATED, HITS, REVIEW_ERRORS, fingerprint_sql, manual_entries
from leadloom.catalog.merges import _DISCOVERED
from leadloom.catalog.scans import LAST_EVENT
from leadloom.frames import bounded_list
from leadloom.operators import compliance, contacts, identity
from leadloom.operators.awards import AWARD_FIELDS, merge_awards
from leadloom.plans import discover, ingest, recompute
from leadloom.plays import FIELD_SERVICE
from leadloom.session import shared_folder
from leadloom.standins import AWARDS_AS_OF, EVENTS_AS_OF, VIEWS
from leadloom.streaming import events as streams


def award_lists(t) -> DataFrame:
    """The newest fifty awards per prospect as an array, newest first."""
    won = merge_awards(t.s_award_rows, t.s_award_rows.limit(0))
    lists = bounded_list(won, ["prospect_id"], "position", F.struct(*AWARD_FIELDS), "award_history")
    return lists.withColumnRenamed("prospect_id", "id")


@query("d3_create_prospects", """
WITH n AS (SELECT sighting AS id, siren, 'contact@c' || CAST(sighting - sighting % 3 AS VARCHAR) || '.example.fr' AS email FROM s_registry)
SELECT id, 'FIELD_SERVICE_OPERATIONS_FR' AS market_play_code, 'unreviewed' AS manual_review_state, NOT (siren IN (SELECT value_normalized FROM s_suppression WHERE kind = 'siren')
  OR email IN (SELECT value_normalized FROM s_suppression WHERE kind = 'email') OR split_part(email, '@', 2) IN (SELECT value_normalized FROM s_suppression WHERE kind = 'domain')) AS created FROM n
""")
def d3(t):
    new = t.s_registry.withColumns(
        {"id": F.col("sighting"), "email": F.concat(F.lit("contact@c"), (F.col("sighting") - F.col("sighting") % 3).cast("string"), F.lit(".example.fr"))}
    )
    return recompute.create_prospects(new, t.s_suppression, FIELD_SERVICE).select("id", "market_play_code", "manual_review_state", "created")


@query("d4_update_prospects", """
SELECT id, CASE WHEN id % 3 = 0 THEN 'Nantes' ELSE city END AS city, CASE WHEN id % 6 = 0 THEN NULL ELSE notes END AS notes FROM s_prospects
""")
def d4(t):
    k = F.col("id")
    patch = t.s_prospects.filter(k % 3 == 0).select(
        "id", F.lit("Nantes").alias("city"), F.lit(None).cast("string").alias("notes"), (k % 2 == 0).alias("set_notes")
    )
    return recompute.update_prospects(t.s_prospects, patch).select("id", "city", "notes")


@query("d5_opt_outs", """
WITH o AS (SELECT prospect_id, min(event_date) AS at FROM s_events WHERE event_type = 'OptOut' GROUP BY 1)
SELECT p.id, p.opted_out OR o.at IS NOT NULL AS opted_out, strftime(o.at, '%Y-%m-%d %H:%M:%S') AS opted_out_at FROM s_prospects p LEFT JOIN o ON o.prospect_id = p.id
""")
def d5(t):
    out = compliance.apply_opt_outs(t.s_prospects, t.s_events)
    return out.select("id", "opted_out", F.date_format("opted_out_at", "yyyy-MM-dd HH:mm:ss").alias("opted_out_at"))


@query("d5b_opt_out_suppression", """
WITH o AS (SELECT DISTINCT p.email, p.siren FROM s_events e JOIN s_prospects p ON p.id = e.prospect_id WHERE event_type = 'OptOut'),
k AS (SELECT 'email' AS kind, lower(email) AS v FROM o WHERE email IS NOT NULL UNION SELECT 'siren', siren FROM o)
SELECT kind, v AS value_normalized FROM k WHERE NOT EXISTS (SELECT 1 FROM s_suppression s WHERE s.kind = k.kind AND s.value_normalized = k.v)
""")
def d5b(t):
    return compliance.opt_out_suppression(t.s_prospects, t.s_events, t.s_suppression).select("kind", "value_normalized")


@query("d5c_cancelled_tasks", """
SELECT id, CASE WHEN status = 'open' AND prospect_id IN (SELECT prospect_id FROM s_events WHERE event_type = 'OptOut') THEN 'cancelled' ELSE status END AS status FROM s_tasks
""")
def d5c(t):
    return compliance.cancel_tasks(t.s_tasks, t.s_events).select("id", "status")


_DECIDED = f"""
e AS ({REVIEW_ERRORS}), d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY created_at DESC, id DESC) AS rn FROM e WHERE error IS NULL) x WHERE rn = 1)
"""


@query("d6_review_application", f"""
WITH {_DECIDED}
SELECT p.id, CASE d.decision WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' WHEN 'park' THEN 'parked' WHEN 'research_more' THEN 'research_more' ELSE manual_review_state END AS manual_review_state,
  CASE WHEN d.decision IN ('reject', 'park') THEN 'parked' ELSE acquisition_stage END AS acquisition_stage, CASE WHEN d.decision IN ('accept', 'reject') THEN FALSE WHEN d.decision = 'research_more' THEN TRUE ELSE needs_manual_review END AS needs_manual_review,
  coalesce(d.decision, qualification_decision) AS qualification_decision FROM s_prospects p LEFT JOIN d ON d.prospect_id = p.id
""")
def d6(t):
    out = recompute.apply_reviews(t.s_prospects, t.s_reviews, t.s_suppression)
    return out.select("id", "manual_review_state", "acquisition_stage", "needs_manual_review", "qualification_decision")


@query("d6b_review_tasks", f"""
WITH {_DECIDED} SELECT e.id AS review_id, CASE decision WHEN 'accept' THEN 'first_outreach' ELSE 'research' END AS task_type,
  CASE decision WHEN 'accept' THEN 'Send first outreach — ' ELSE 'Research more evidence — ' END || p.company_name AS title FROM e JOIN s_prospects p ON p.id = e.prospect_id WHERE error IS NULL AND decision IN ('accept', 'research_more')
""")
def d6b(t):
    return recompute.review_tasks(t.s_prospects, t.s_reviews, t.s_suppression, EVENTS_AS_OF).select("review_id", "task_type", "title")


def discovery(t, scored: bool = False) -> discover.Discovery:
    """A run with the stored evidence and, for every second prospect, an officer of the register."""
    from leadloom.catalog.rescored import facts
    from leadloom.functions.text import contact_fingerprint

    fields = ("prospect_id", "source_adapter", "source_url", "evidence_type", "contact_value", "person_name", "content_hash")
    stored = t.s_contact_evidence.withColumn("fingerprint", contact_fingerprint(*map(F.col, fields)))
    officer = F.struct(F.lit("PETIT").alias("nom"), F.lit("Anne").alias("prenoms"), F.lit("Gérante").alias("qualite"), F.lit("personne physique").alias("type_dirigeant"))
    officers = F.when(F.col("id") % 2 == 0, F.array(officer)).otherwise(F.filter(F.array(officer), lambda o: F.lit(False)))
    return discover.discover_contacts(
        t.s_prospects.withColumn("dirigeants", officers), t.s_site_pages, t.s_people, t.s_points, stored, t.s_tasks, t.s_runs, t.s_suppression, t.s_mx, EVENTS_AS_OF,
        facts=facts(t) if scored else None, play=FIELD_SERVICE if scored else None,
    )


@query("d7_contact_discovery")
def d7(t):
    return discovery(t).points.filter("is_new").select(
        "prospect_id", "kind", "value_normalized", "source_class", "publication_state", "person_match_state", "utility_state", "confidence_score"
    )


@query("d7b_discovery_projection")
def d7b(t):
    return discovery(t).prospects.select("id", "decision_maker_name", "email", "contact_source", "contact_confidence", "contact_discovery_state")


@query("d7c_discovery_runs", f"""
WITH fresh AS (SELECT DISTINCT prospect_id FROM s_runs WHERE status IN ('completed', 'completed_with_warnings') AND finished_at >= TIMESTAMP '{EVENTS_AS_OF} 00:00:00' - INTERVAL '30' DAY),
ok AS (SELECT *, CASE WHEN website IS NOT NULL THEN 'c' || CAST(id - id % 3 AS VARCHAR) || '.example.fr' END AS domain FROM s_prospects WHERE id NOT IN ({HITS}) AND NOT anonymized AND NOT opted_out
  AND coalesce(nullif(opportunity_score, 0), nullif(acquisition_score, 0), 0) >= 40 AND (website IS NOT NULL OR coalesce(email, '') LIKE '%@%') AND id NOT IN (SELECT prospect_id FROM fresh)),
pg AS (SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www[.]', '') AS host, count(*) AS n FROM s_site_pages GROUP BY 1)
SELECT id AS prospect_id, domain, 'completed' AS status, coalesce(n, 0) AS pages_examined, 0 AS pages_rejected FROM ok LEFT JOIN pg ON pg.host = domain
""", whole="pages_examined pages_rejected")
def d7c(t):
    return discovery(t).runs.select("prospect_id", "domain", "status", "pages_examined", "pages_rejected")


@query("d7d_discovery_scored")
def d7d(t):
    return discovery(t, scored=True).prospects.select("id", "contact_confidence", "fit_score", "authority_score", "opportunity_score", "readiness_state")


@query("d8_primary_projection", f"""
WITH pp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY CASE WHEN manually_confirmed THEN 0 ELSE 1 END, buyer_role_score DESC, identity_confidence DESC, id) AS rn FROM s_people WHERE is_active) x WHERE rn = 1),
pt AS (SELECT * FROM ({POINT_RANKS}) x WHERE rn = 1)
SELECT p.id, coalesce(pp.full_name, p.decision_maker_name) AS decision_maker_name, CASE WHEN pp.id IS NOT NULL THEN pp.job_title ELSE p.decision_maker_title END AS decision_maker_title,
  CASE WHEN pt.kind = 'email' AND pt.utility_state IN ('usable_personal', 'usable_role', 'usable_generic') THEN pt.value_normalized ELSE p.email END AS email,
  CASE WHEN pt.kind = 'phone' THEN pt.value_normalized ELSE p.phone END AS phone,
  CASE WHEN pt.kind = 'linkedin' AND (pt.manually_confirmed OR pt.publication_state = 'published_personal') THEN pt.value_normalized ELSE p.linkedin_url END AS linkedin_url,
  coalesce(pt.source_class, 'none') AS contact_source,
  CASE WHEN pt.id IS NULL THEN 'none' WHEN pt.manually_confirmed THEN 'manual_confirmed' WHEN pt.publication_state = 'published_personal' THEN 'published_personal' WHEN pt.publication_state IN ('published_role', 'published_generic') THEN 'published_generic'
    WHEN pt.person_match_state = 'exact_person_pattern_confirmed' AND pt.deliverability_state = 'deliverable' THEN 'deliverable' ELSE 'needs_review' END AS contact_confidence,
  CASE WHEN pt.id IS NULL THEN NULL WHEN pt.manually_confirmed THEN 'user_supplied' WHEN pt.publication_state IN ('published_personal', 'published_role', 'published_generic') THEN 'published'
    WHEN pt.person_match_state = 'exact_person_pattern_confirmed' AND pt.deliverability_state = 'deliverable' THEN 'inferred' ELSE 'guessed' END AS contact_discovery_state,
  coalesce(pt.requires_manual_review, TRUE) AS needs_manual_review
FROM s_prospects p LEFT JOIN pp ON pp.prospect_id = p.id LEFT JOIN pt ON pt.prospect_id = p.id
""")
def d8(t):
    out = contacts.project_primary(t.s_prospects, t.s_people, t.s_points)
    return out.select("id", "decision_maker_name", "decision_maker_title", "email", "phone", "linkedin_url", "contact_source", "contact_confidence",
                      "contact_discovery_state", "needs_manual_review")


def contact_decisions(t) -> DataFrame:
    """Operator decisions on stored people and points, several per row."""
    pick = lambda key: F.element_at(F.array(*[F.lit(d) for d in ("confirm", "reject", "primary", "suppress", "confirm")]), (key % 5 + 1).cast("int"))
    stamp = F.lit("2024-01-30 10:00:00").cast("timestamp_ntz")
    none = F.lit(None).cast("long")
    on_people = t.s_people.filter(F.col("id") % 3 == 0).select(
        F.col("id"), "prospect_id", F.col("id").alias("person_id"), none.alias("contact_point_id"), pick(F.col("id")).alias("decision"),
        F.lit(None).cast("string").alias("reason"), stamp.alias("created_at"),
    )
    on_points = t.s_points.filter(F.col("id") % 3 != 1).select(
        (F.col("id") + 10**9).alias("id"), "prospect_id", none.alias("person_id"), F.col("id").alias("contact_point_id"), pick(F.col("id") + 1).alias("decision"),
        F.when(F.col("id") % 2 == 0, "wrong").alias("reason"), stamp.alias("created_at"),
    )
    return on_people.unionByName(on_points)


@query("d9_reviewed_people", """
WITH d AS (SELECT id, prospect_id, CASE id % 5 WHEN 1 THEN 'reject' WHEN 2 THEN 'primary' WHEN 3 THEN 'suppress' ELSE 'confirm' END AS decision FROM s_people WHERE id % 3 = 0),
prim AS (SELECT prospect_id, max(id) AS pid FROM d WHERE decision = 'primary' GROUP BY 1)
SELECT p.id, CASE WHEN decision IN ('confirm', 'primary') THEN TRUE WHEN decision = 'reject' THEN FALSE ELSE is_active END AS is_active, manually_confirmed OR coalesce(decision IN ('confirm', 'primary'), FALSE) AS manually_confirmed,
  CASE WHEN decision = 'primary' THEN 100 ELSE buyer_role_score END AS buyer_role_score, CASE WHEN decision IN ('confirm', 'primary') THEN 100 ELSE identity_confidence END AS identity_confidence,
  CASE WHEN pid IS NOT NULL THEN p.id = pid ELSE is_primary_candidate END AS is_primary_candidate FROM s_people p LEFT JOIN d ON d.id = p.id LEFT JOIN prim ON prim.prospect_id = p.prospect_id
""", whole="buyer_role_score identity_confidence")
def d9(t):
    out = contacts.review_people(t.s_people, contact_decisions(t))
    return out.select("id", "is_active", "manually_confirmed", "buyer_role_score", "identity_confidence", "is_primary_candidate")


@query("d9b_reviewed_points", """
WITH d AS (SELECT id, prospect_id, CASE (id + 1) % 5 WHEN 1 THEN 'reject' WHEN 2 THEN 'primary' WHEN 3 THEN 'suppress' ELSE 'confirm' END AS decision, CASE WHEN id % 2 = 0 THEN 'wrong' ELSE 'operator_rejected' END AS reason FROM s_points WHERE id % 3 <> 1),
prim AS (SELECT prospect_id, max(id) AS pid FROM d WHERE decision = 'primary' GROUP BY 1)
SELECT p.id, CASE WHEN decision IN ('confirm', 'primary') THEN NULL WHEN decision = 'reject' THEN reason ELSE rejection_reason END AS rejection_reason, CASE WHEN decision = 'suppress' THEN 'suppressed'
    WHEN decision IN ('confirm', 'primary') THEN CASE WHEN deliverability_state = 'invalid' THEN 'invalid' WHEN deliverability_state IN ('catch_all', 'risky') THEN 'manual_confirmation_required' WHEN kind = 'contact_form' THEN 'usable_generic'
      WHEN kind IN ('phone', 'linkedin') THEN 'usable_role' WHEN kind = 'email' THEN 'usable_personal' ELSE 'no_contact' END ELSE utility_state END AS utility_state,
  is_suppressed OR coalesce(decision = 'suppress', FALSE) AS is_suppressed, CASE WHEN decision = 'primary' THEN 100 ELSE confidence_score END AS confidence_score, CASE WHEN pid IS NOT NULL THEN p.id = pid ELSE is_primary END AS is_primary
FROM s_points p LEFT JOIN d ON d.id = p.id LEFT JOIN prim ON prim.prospect_id = p.prospect_id
""", whole="confidence_score")
def d9b(t):
    out = contacts.review_points(t.s_points, contact_decisions(t))
    return out.select("id", "rejection_reason", "utility_state", "is_suppressed", "confidence_score", "is_primary")


@query("d9c_review_audit", """
WITH d AS (SELECT id, id AS person_id, NULL AS point_id, CASE id % 5 WHEN 1 THEN 'reject' WHEN 2 THEN 'primary' WHEN 3 THEN 'suppress' ELSE 'confirm' END AS decision, CASE WHEN manually_confirmed THEN 'confirmed' ELSE 'unconfirmed' END AS was FROM s_people WHERE id % 3 = 0
  UNION ALL SELECT id + 1000000000, NULL, id, CASE (id + 1) % 5 WHEN 1 THEN 'reject' WHEN 2 THEN 'primary' WHEN 3 THEN 'suppress' ELSE 'confirm' END, utility_state FROM s_points WHERE id % 3 <> 1)
SELECT id, decision AS new_state, was AS previous_state FROM d
""")
def d9c(t):
    return contacts.review_audit(contact_decisions(t), t.s_people, t.s_points).select("id", "new_state", "previous_state")


@query("d10_manual_points", """
WITH m AS (SELECT ord, prospect_id, kind, value, publication_state FROM s_point_facts WHERE ord % 23 <> 0 AND ord % 29 <> 0 AND ord % 31 <> 0 AND kind IN ('email', 'phone')),
v AS (SELECT *, CASE WHEN kind = 'email' THEN lower(trim(trim(value), '.,;:<>[]()"''')) ELSE value END AS vn FROM m),
f AS (SELECT prospect_id, kind, vn, arg_max(publication_state, ord) AS pub FROM v GROUP BY ALL),
b AS (SELECT * FROM s_points WHERE kind IN ('email', 'phone'))
SELECT coalesce(f.prospect_id, b.prospect_id) AS prospect_id, coalesce(f.kind, b.kind) AS kind, coalesce(f.vn, b.value_normalized) AS value_normalized, CASE WHEN f.kind IS NOT NULL THEN 'manual_operator' ELSE source_class END AS source_class,
  coalesce(pub, publication_state) AS publication_state, CASE WHEN f.kind IS NOT NULL THEN 100 ELSE confidence_score END AS confidence_score, CASE WHEN f.kind IS NULL THEN NULL WHEN b.id IS NULL THEN 'created' ELSE 'updated' END AS change,
  CASE WHEN f.kind IS NULL THEN utility_state WHEN f.kind = 'phone' THEN 'usable_role' ELSE 'usable_personal' END AS utility_state
FROM f FULL OUTER JOIN b ON b.prospect_id = f.prospect_id AND b.kind = f.kind AND b.value_normalized = f.vn
""", whole="confidence_score")
def d10(t):
    gated = compliance.gate_manual_points(manual_entries(t).filter(F.col("kind").isin("email", "phone", "fax")), international=False)
    out = contacts.add_manual_points(gated, t.s_points.filter(F.col("kind").isin("email", "phone")))
    return out.select("prospect_id", "kind", "value_normalized", "source_class", "publication_state", "confidence_score", "change", "utility_state")


@query("d9d_review_suppression", """
WITH s AS (SELECT CASE WHEN kind = 'email' THEN 'email' ELSE 'person' END AS kind, lower(trim(value_normalized)) AS v, CASE WHEN id % 2 = 0 THEN 'wrong' ELSE 'operator_suppressed' END AS reason FROM s_points WHERE id % 3 <> 1 AND (id + 1) % 5 = 3)
SELECT kind, v AS value_normalized, min(reason) AS reason FROM s WHERE NOT EXISTS (SELECT 1 FROM s_suppression x WHERE x.kind = s.kind AND x.value_normalized = s.v) GROUP BY 1, 2
""")
def d9d(t):
    asked = contacts.review_suppression(t.s_points, contact_decisions(t))
    return compliance.add_suppression(t.s_suppression, asked).select("kind", "value_normalized", "reason")


@query("d9e_tasks_of_suppressed", """
SELECT id, CASE WHEN status = 'open' AND origin = 'contact_intelligence' AND prospect_id IN (SELECT prospect_id FROM s_points WHERE id % 3 <> 1 AND (id + 1) % 5 = 3) THEN 'cancelled' ELSE status END AS status FROM s_tasks
""")
def d9e(t):
    return contacts.cancel_suppressed_tasks(t.s_tasks, contact_decisions(t), EVENTS_AS_OF).select("id", "status")


_MANUAL = """
m AS (SELECT ord, prospect_id, kind, value, publication_state FROM s_point_facts WHERE ord % 23 <> 0 AND ord % 29 <> 0 AND ord % 31 <> 0 AND kind IN ('email', 'phone', 'contact_form', 'linkedin')),
v AS (SELECT *, CASE kind WHEN 'email' THEN lower(trim(trim(value), '.,;:<>[]()"''')) WHEN 'contact_form' THEN replace(value, 'https://C', 'https://c') ELSE value END AS vn FROM m)
"""


@query("d10b_manual_points_of_all_kinds", f"""
WITH {_MANUAL},
f AS (SELECT prospect_id, kind, vn, arg_max(publication_state, ord) AS pub FROM v GROUP BY ALL)
SELECT coalesce(f.prospect_id, b.prospect_id) AS prospect_id, coalesce(f.kind, b.kind) AS kind, coalesce(f.vn, b.value_normalized) AS value_normalized, CASE WHEN f.kind IS NOT NULL THEN 'manual_operator' ELSE source_class END AS source_class,
  CASE WHEN f.kind IS NULL THEN NULL WHEN b.id IS NULL THEN 'created' ELSE 'updated' END AS change,
  CASE f.kind WHEN 'phone' THEN 'usable_role' WHEN 'linkedin' THEN 'usable_role' WHEN 'email' THEN 'usable_personal' WHEN 'contact_form' THEN 'usable_generic' ELSE utility_state END AS utility_state
FROM f FULL OUTER JOIN s_points b ON b.prospect_id = f.prospect_id AND b.kind = f.kind AND b.value_normalized = f.vn
""")
def d10b(t):
    gated = compliance.gate_manual_points(manual_entries(t), international=False)
    return contacts.add_manual_points(gated, t.s_points).select("prospect_id", "kind", "value_normalized", "source_class", "change", "utility_state")


@query("d10c_manual_evidence", f"""
WITH {_MANUAL},
p AS (SELECT ord, prospect_id, kind, sha256(CAST(prospect_id AS VARCHAR) || '|manual_operator|https://c' || CAST(prospect_id - prospect_id % 3 AS VARCHAR) || '.example.fr/p|' || kind || '|' || vn) AS fingerprint FROM v)
SELECT prospect_id, fingerprint, 'manual_' || any_value(kind) AS evidence_type, 'Operator-confirmed ' || any_value(kind) AS excerpt FROM p
WHERE fingerprint NOT IN (SELECT fingerprint FROM p WHERE ord % 2 = 0) GROUP BY 1, 2
""")
def d10c(t):
    gated = compliance.gate_manual_points(manual_entries(t), international=False)
    none = t.s_contact_evidence.limit(0).select(F.lit("").alias("fingerprint"))
    stored = contacts.manual_point_evidence(gated.filter(F.col("ord") % 2 == 0), none)
    return contacts.manual_point_evidence(gated, stored).select("prospect_id", "fingerprint", "evidence_type", "excerpt")


@query("d11_retention", f"""
WITH last AS ({LAST_EVENT}),
a AS (SELECT p.*, greatest(coalesce(updated_at, created_at), coalesce(l.event_date, TIMESTAMP '1970-01-01')) AS act FROM s_prospects p LEFT JOIN last l ON l.prospect_id = p.id),
s AS (SELECT *, NOT anonymized AND act <= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL '1095' DAY AS now FROM a)
SELECT id, now AS anonymized_now, anonymized OR now AS anonymized, CASE WHEN NOT now THEN email END AS email, CASE WHEN NOT now THEN decision_maker_name END AS decision_maker_name,
  CASE WHEN now THEN '[anonymized — retention policy]' ELSE notes END AS notes FROM s
""")
def d11(t):
    out = compliance.anonymise(t.s_prospects, t.s_events, EVENTS_AS_OF)
    return out.select("id", "anonymized_now", "anonymized", "email", "decision_maker_name", "notes")


@query("d12_enrichment", """
WITH r AS (SELECT siren, arg_min(company_name, sighting) AS company_name, min(siret) AS siret FROM s_registry GROUP BY 1),
e AS (SELECT p.id, coalesce(r.company_name, p.company_name) AS company_name, coalesce(r.siret, p.siret) AS siret, CASE WHEN p.id % 2 = 0 THEN coalesce(p.email, 'contact@nouveau.fr') ELSE p.email END AS email, contact_confidence AS c, contact_discovery_state AS d
  FROM s_prospects p LEFT JOIN r USING (siren)),
g AS (SELECT *, coalesce(email IS NOT NULL AND coalesce(c, '') IN ('', 'none', 'unverified') AND d IS NULL, FALSE) AS guess FROM e)
SELECT id, company_name, siret, email, CASE WHEN guess THEN 'domain_and_pattern_only' ELSE c END AS contact_confidence, CASE WHEN guess THEN 'guessed' ELSE d END AS contact_discovery_state FROM g
""")
def d12(t):
    found = t.s_registry.groupBy("siren").agg(F.min_by("company_name", "sighting").alias("company_name"), F.min("siret").alias("siret"))
    patch = t.s_prospects.select("id", "siren", "email").join(found, "siren", "left").select(
        "id", "company_name", "siret", F.when((F.col("id") % 2 == 0) & F.col("email").isNull(), "contact@nouveau.fr").alias("email")
    )
    out = identity.apply_enrichment(t.s_prospects, patch)
    return out.select("id", "company_name", "siret", "email", "contact_confidence", "contact_discovery_state")


D13 = f"""
WITH b AS (SELECT id, 'c' || CAST(id - id % 3 AS VARCHAR) || '.example.fr' AS d, siren, CASE WHEN id % 4 = 0 THEN 'sales@c' || CAST(id - id % 3 AS VARCHAR) || '.example.fr' END AS h FROM s_prospects WHERE id % 9 <> 0),
c AS (SELECT id, h AS email, 0 AS pr FROM b WHERE h IS NOT NULL UNION ALL SELECT id, u.l || '@' || d, u.p FROM b, (VALUES ('jean.martin', 1), ('j.martin', 2), ('jeanmartin', 3), ('martin.jean', 4), ('jean_martin', 5), ('jmartin', 6), ('martinj', 7), ('martin', 8), ('jean', 9)) u(l, p)
  UNION ALL SELECT id, r.l || '@' || d, 20 + r.i FROM b, (VALUES {", ".join(f"('{role}', {i})" for i, role in enumerate(fixed.ROLE_LOCAL_PARTS))}) r(l, i)),
u AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pr) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY id, email ORDER BY pr) AS copy FROM c) x WHERE copy = 1),
k AS (SELECT * FROM u),
v AS (SELECT k.*, s.confidence FROM k JOIN s_verdicts s USING (email)),
best AS (SELECT id, email, confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE confidence WHEN 'deliverable' THEN 0 WHEN 'catch_all' THEN 3 WHEN 'indeterminate' THEN 4 WHEN 'risky' THEN 6 ELSE 7 END, rn) AS z FROM v WHERE confidence <> 'invalid') x WHERE z = 1),
n AS (SELECT id, count(*) AS candidates FROM k GROUP BY 1), m AS (SELECT id, count(*) AS checked FROM v GROUP BY 1)
SELECT p.id, coalesce(n.candidates, 0) AS candidates, coalesce(m.checked, 0) AS checked, coalesce(best.email, b.h) AS best_email,
  CASE WHEN coalesce(best.email, b.h) IS NULL THEN 'none' WHEN best.confidence IN ('deliverable', 'catch_all') THEN 'reacher' WHEN coalesce(best.email, b.h) = b.h THEN 'theharvester' ELSE 'reacher' END AS contact_source,
  CASE WHEN coalesce(best.email, b.h) IS NULL THEN 'needs_review' WHEN best.email IS NULL THEN 'unverified' ELSE best.confidence END AS contact_confidence
FROM s_prospects p LEFT JOIN b USING (id) LEFT JOIN n USING (id) LEFT JOIN m USING (id) LEFT JOIN best USING (id)
"""


def waterfall(t):
    """A mailbox search for every prospect."""
    k = F.col("id")
    host = F.concat(F.lit("c"), (k - k % 3).cast("string"), F.lit(".example.fr"))
    people = t.s_prospects.select(
        "id", "siren", F.when(k % 9 != 0, host).alias("domain"), F.lit("Jean").alias("first_name"), F.lit("Martin").alias("last_name")
    )
    harvested = t.s_prospects.filter((k % 4 == 0) & (k % 9 != 0)).select("id", F.array(F.concat(F.lit("sales@"), host)).alias("harvested"))
    return contacts.contact_waterfall(people, t.s_verdicts, harvested, t.s_suppression)


@query("d13_contact_waterfall", D13, whole="candidates checked")
def d13(t):
    return waterfall(t).select("id", "candidates", "checked", "best_email", "contact_source", "contact_confidence")


def award_job(t) -> ingest.Ingested:
    return ingest.ingest_awards(
        t.s_awards, t.s_prospects, t.s_award_rows, t.s_evidence, t.s_suppression, FIELD_SERVICE, AWARDS_AS_OF, days=400, max_companies=None
    )


_INGEST = f"""
{HOLDERS},
known AS (SELECT * FROM s_prospects),
inc AS (SELECT *, signal_details || CASE WHEN objets_joined <> '' THEN ' — ' || objets_joined ELSE '' END AS details, (SELECT min(id) FROM known k WHERE k.siren = described.siren) AS hit FROM described
  WHERE siren NOT IN (SELECT value_normalized FROM s_suppression WHERE kind = 'siren')),
late AS (SELECT *, row_number() OVER (PARTITION BY siren ORDER BY award_count, total_cents, holder_key DESC) AS from_last FROM inc),
fold AS (SELECT siren, hit, max(CASE WHEN from_last = 1 THEN details END) AS details, max(CASE WHEN from_last = 1 THEN company_name END) AS company_name, arg_min(siret, from_last) FILTER (siret IS NOT NULL) AS siret, max(last_tender_date) AS tender FROM late GROUP BY 1, 2)
"""


@query("d15_award_ingest", f"""
WITH {_INGEST}
SELECT f.siren, f.company_name, coalesce(f.siret, k.siret) AS siret, 'PUBLIC_AWARD' AS signal_type, f.details AS signal_details, greatest(f.tender, coalesce(k.last_tender_date, '')) AS last_tender_date,
  CASE WHEN f.hit IS NULL THEN 'created' ELSE 'updated' END AS changed FROM fold f LEFT JOIN known k ON k.id = f.hit
""")
def d15(t):
    out = award_job(t).prospects.filter(F.col("changed").isNotNull())
    return out.select("siren", "company_name", "siret", "signal_type", "signal_details", "last_tender_date", "changed")


@query("d15b_award_ingest_evidence", f"""
WITH {_INGEST},
old AS (SELECT DISTINCT prospect_id, {fingerprint_sql()} AS fp FROM s_evidence WHERE is_active),
items AS (SELECT siren, hit, 'PUBLIC_AWARD_RECENT' AS signal_type, signal_details || ' — ' || objets_joined AS evidence_text FROM inc
  UNION ALL SELECT siren, hit, 'PUBLIC_AWARD_MULTI', CAST(award_count AS VARCHAR) || ' awards in discovery window' FROM inc WHERE award_count >= 2
  UNION ALL SELECT siren, hit, 'PUBLIC_SERVICE_DELIVERY', 'Supplier on public awards matching field-service play filters' FROM inc),
u AS (SELECT DISTINCT siren, hit, signal_type, substring(sha256('decp|' || signal_type || '||' || regexp_replace(lower(trim(evidence_text)), '\\s+', ' ', 'g') || '|'), 1, 32) AS fp FROM items)
SELECT signal_type, fp AS fingerprint, count(*) AS n FROM u WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.prospect_id = u.hit AND old.fp = u.fp) GROUP BY 1, 2
""")
def d15b(t):
    return award_job(t).evidence.groupBy("signal_type", "fingerprint").agg(F.count(F.lit(1)).alias("n"))


@query("d15c_award_ingest_rows")
def d15c(t):
    return award_job(t).awards.select("prospect_id", "id", "date", "objet", "montant", "position", "is_new")


@query("d16_registry_ingest", f"""
WITH {_DISCOVERED},
cut AS (SELECT * FROM found),
known AS (SELECT * FROM s_prospects)
SELECT c.siren, c.company_name, CASE WHEN k.id IS NULL THEN 'REGISTRY_FIELD' ELSE k.signal_type END AS signal_type, coalesce(k.signal_details, 'Field-service registry · NAF ' || coalesce(c.naf_code, 'None') || ' · ' || c.company_size || ' · ' || coalesce(c.decision_maker_title, '')) AS signal_details,
  CASE WHEN k.id IS NULL THEN 'created' ELSE 'updated' END AS changed FROM cut c LEFT JOIN known k ON k.siren = c.siren WHERE c.siren NOT IN (SELECT value_normalized FROM s_suppression WHERE kind = 'siren')
""")
def d16(t):
    out = ingest.ingest_registry(t.s_registry, t.s_prospects, t.s_evidence, t.s_suppression, FIELD_SERVICE)
    return out.prospects.filter(F.col("changed").isNotNull()).select("siren", "company_name", "signal_type", "signal_details", "changed")


# --- Streams ----------------------------------------------------------------


def event_stream(t, view: str, table: str) -> DataFrame:
    """A view over a driver table read as a stream."""
    raw = (
        t.spark.readStream.schema(getattr(t, table).schema).option("pathGlobFilter", f"{table}.parquet").parquet(t.folder)
    )
    return t.spark.sql(VIEWS[view], **{table: raw})


def run_to_table(t, stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read the table it wrote; ``batch`` tells the micro-batch."""
    folder = shared_folder(t.spark, label)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder}/rows")

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(f"{_ddl(stream)}, batch int").parquet(f"{folder}/rows")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in df.schema)


@query("t1_gated_event_stream", GATED + " SELECT id, event_type, reason FROM gated")
def t1(t):
    folder = shared_folder(t.spark, "gate")
    writer = streams.gate_stream(
        event_stream(t, "s_events", "events"), t.s_prospects, t.s_suppression, f"{folder}/good", f"{folder}/bad", f"{folder}/state"
    )
    writer.trigger(availableNow=True).start().awaitTermination()
    good = t.spark.read.parquet(f"{folder}/good").select("id", "event_type", F.lit(None).cast("string").alias("reason"))
    return good.unionByName(t.spark.read.parquet(f"{folder}/bad").select("id", "event_type", "reason"))


@query("t2_status_stream", f"WITH last AS ({LAST_EVENT}) SELECT prospect_id, event_type AS current_status, next_action FROM last")
def t2(t):
    rows = run_to_table(t, streams.status_stream(event_stream(t, "s_events", "events")), "status", "update")
    latest = rows.groupBy("prospect_id").agg(F.max_by(F.struct("current_status", "next_action"), "batch").alias("s"))
    return latest.select("prospect_id", "s.*")


@query("t3_weekly_contacted_stream", f"""
SELECT strftime(CAST(event_date AS DATE) - CAST(i AS INT), '%Y-%m-%d') AS week_start, count(*) AS events FROM s_events, range(7) r(i) WHERE event_type IN ({sql_list(fixed.CONTACTED_EVENTS)}) GROUP BY 1
""")
def t3(t):
    rows = run_to_table(t, streams.weekly_contacted_stream(event_stream(t, "s_events", "events")), "weekly", "update")
    latest = rows.groupBy("week_start").agg(F.max_by("events", "batch").alias("events"))
    return latest.select(F.date_format("week_start", "yyyy-MM-dd").alias("week_start"), "events")


@query("t3b_weekly_people_stream", f"""
WITH days AS (SELECT CAST(event_date AS DATE) AS day, prospect_id FROM s_events WHERE event_type IN ({sql_list(fixed.CONTACTED_EVENTS)}))
SELECT strftime(day - CAST(i AS INT), '%Y-%m-%d') AS week_start, count(*) AS events, count(DISTINCT prospect_id) AS exact, TRUE AS within_error, {streams.SKETCH_ERROR} AS error FROM days, range(7) r(i) GROUP BY 1
""".replace(f"{streams.SKETCH_ERROR} AS error", f"CAST({streams.SKETCH_ERROR} AS DOUBLE) AS error"))
def t3b(t):
    """Sketched counts beside the exact ones of a batch over the same events."""
    weeks = people_weeks(t)
    good = F.abs(F.col("contacted") - F.col("exact")) <= F.col("exact") * streams.SKETCH_ERROR
    return weeks.select("week_start", "events", "exact", good.alias("within_error"), F.lit(streams.SKETCH_ERROR).alias("error"))


@query("t3c_weekly_people_sketched")
def t3c(t):
    return people_weeks(t).select("week_start", "contacted", "exact", F.lit(streams.SKETCH_ERROR).alias("error"))


def people_weeks(t) -> DataFrame:
    days = run_to_table(t, streams.daily_contacted_stream(event_stream(t, "s_events", "events")), "daily", "update")
    latest = days.groupBy("day").agg(F.max_by(F.struct("events", "people"), "batch").alias("d")).select("day", "d.*")
    weeks = streams.weeks_of_days(latest).withColumn("week_start", F.date_format("week_start", "yyyy-MM-dd"))
    seen = t.s_events.filter(F.col("event_type").isin(*fixed.CONTACTED_EVENTS)).withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(6))))
    week = F.date_format(F.date_sub(F.col("event_date").cast("date"), F.col("back")), "yyyy-MM-dd").alias("week_start")
    return weeks.join(seen.groupBy(week).agg(F.countDistinct("prospect_id").alias("exact")), "week_start")


@query("t4_deduped_evidence_stream", f"SELECT DISTINCT prospect_id, {fingerprint_sql()} AS fingerprint FROM s_evidence WHERE is_active")
def t4(t):
    rows = run_to_table(t, streams.dedupe_stream(event_stream(t, "s_evidence", "orders")), "dedupe")
    return rows.select("prospect_id", "fingerprint")


@query("t5_stop_stream", f"""
SELECT prospect_id, arg_min(CASE event_type WHEN 'OptOut' THEN 'opt_out_requested' ELSE 'prospect_replied' END, event_date) AS stop_reason FROM s_events
WHERE event_type IN ({sql_list(fixed.REPLY_EVENTS)}, 'OptOut') GROUP BY 1
""")
def t5(t):
    return with_rocks(t, lambda: run_to_table(t, streams.stop_stream(event_stream(t, "s_events", "events")), "stops").select("prospect_id", "stop_reason"))


def with_rocks(t, run):
    """Run a stream with the state store that stateful operators in Python need."""
    key, wanted = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = t.spark.conf.get(key)
    t.spark.conf.set(key, wanted)
    try:
        return run()
    finally:
        t.spark.conf.set(key, before)


def suppression_stream(t) -> DataFrame:
    """The suppression list as a stream of changes."""
    people = event_stream(t, "s_prospects", "customer")
    return t.spark.sql(VIEWS["s_suppression"], s_prospects=people).withColumn("suppressed_at", F.lit("2024-01-15").cast("timestamp"))


@query("t5b_stop_stream_with_suppression", f"""
WITH stored AS (SELECT id FROM s_prospects WHERE id % 13 = 5),
marks AS (SELECT prospect_id, CASE event_type WHEN 'OptOut' THEN 'opt_out_requested' ELSE 'prospect_replied' END AS stop_reason, event_date, id FROM s_events WHERE event_type IN ({sql_list(fixed.REPLY_EVENTS)}, 'OptOut')
  UNION ALL SELECT id, 'suppression_entry_matched', TIMESTAMP '2024-01-15', 0 FROM ({HITS}) h),
first AS (SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY event_date, id) AS place FROM marks)
SELECT prospect_id, stop_reason FROM first WHERE place = 1 AND prospect_id NOT IN (SELECT id FROM stored)
""")
def t5b(t):
    stored = t.s_prospects.filter("id % 13 = 5").select(F.col("id").alias("prospect_id"), F.lit("prospect_replied").alias("stop_reason"))
    hits = streams.suppression_hits(suppression_stream(t), t.s_prospects)
    run = lambda: run_to_table(t, streams.stop_stream(event_stream(t, "s_events", "events"), hits, stored), "stops-both")
    return with_rocks(t, run).select("prospect_id", "stop_reason")


