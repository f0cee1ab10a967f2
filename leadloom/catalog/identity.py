"""Joins and lookups."""

from pyspark.sql import functions as F

from leadloom.catalog import query
from leadloom.catalog.gates import HITS
from leadloom.functions.codes import play_role
from leadloom.operators import activity, compliance, contacts, evidence, identity, scoring
from leadloom.plays import FIELD_SERVICE
from leadloom.standins import EVENTS_AS_OF


@query("j1_company_lookup", """
WITH p AS (SELECT id, siren, CASE WHEN siret IS NOT NULL THEN siren || '00077' END AS siret FROM s_prospects)
SELECT r.sighting, coalesce((SELECT min(id) FROM p WHERE p.siret = r.siret), (SELECT min(id) FROM p WHERE p.siren = r.siren)) AS matched_id,
  CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.siret = r.siret) THEN 'siret' WHEN EXISTS (SELECT 1 FROM p WHERE p.siren = r.siren) THEN 'siren' END AS matched_by
FROM s_registry r
""")
def j1(t):
    known = t.s_prospects.select(
        "id", "siren", F.when(F.col("siret").isNotNull(), F.concat("siren", F.lit("00077"))).alias("siret")
    )
    return identity.match_prospects(t.s_registry, known).select("sighting", "matched_id", "matched_by")


@query("j2_suppression_check", f"SELECT id, id IN ({HITS}) AS is_suppressed FROM s_prospects")
def j2(t):
    return compliance.mark_suppressed(t.s_prospects, t.s_suppression).select("id", "is_suppressed")


@query("j3_identity_resolution", r"""
WITH norm AS (SELECT company_id, canonical_name, country_code,
    trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(canonical_name)), '[^\p{L}\p{N}_\s]', '', 'g'), '\b(limited|ltd|plc|llp|sas|sasu|sarl|sa|gmbh)\b', '', 'g'), '\s+', ' ', 'g')) AS n FROM s_companies),
obs AS (SELECT *, upper(trim(identifier_value)) AS v,
    trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(company_name)), '[^\p{L}\p{N}_\s]', '', 'g'), '\b(limited|ltd|plc|llp|sas|sasu|sarl|sa|gmbh)\b', '', 'g'), '\s+', ' ', 'g')) AS n FROM s_observations),
x AS (SELECT o.*, (SELECT min(i.company_id) FROM s_identifiers i WHERE i.scheme = o.identifier_scheme AND i.value_normalized = o.v) AS by_id,
    (SELECT min(c.company_id) FROM norm c WHERE c.country_code = o.country_code AND c.n = o.n) AS by_name FROM obs o)
SELECT obs_id, CASE WHEN by_id IS NOT NULL THEN 'resolved_exact' WHEN by_name IS NOT NULL THEN 'resolved_high_confidence' ELSE 'unresolved' END AS resolution,
  coalesce(by_id, by_name) AS company_id, CAST(CASE WHEN by_id IS NOT NULL THEN 1.0 WHEN by_name IS NOT NULL THEN 0.95 ELSE 0.0 END AS DOUBLE) AS match_score,
  CASE WHEN by_id IS NOT NULL THEN 'Exact match on identifier scheme ''' || identifier_scheme || ''': ''' || v || ''''
    WHEN by_name IS NOT NULL THEN 'Exact normalized name match: ''' || (SELECT canonical_name FROM s_companies c WHERE c.company_id = by_name) || ''''
    ELSE 'No matching identifier or canonical company name found.' END AS match_reason
FROM x
""")
def j3(t):
    out = identity.resolve(t.s_observations, t.s_companies, t.s_identifiers)
    return out.select("obs_id", "resolution", "company_id", "match_score", "match_reason")


@query("j4_evidence_lists", """
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY id) AS rn, count(*) OVER (PARTITION BY prospect_id) AS n
  FROM s_evidence WHERE is_active)
SELECT prospect_id, id, label, rn AS position, n AS evidence_count FROM ranked
""")
def j4(t):
    rows = evidence.evidence_rows(t.s_evidence)
    counts = rows.groupBy("prospect_id").agg(F.max("position").alias("evidence_count"))
    return rows.select("prospect_id", "id", "label", "position").join(counts, "prospect_id")


LATEST_REVIEW = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY created_at DESC, id DESC) AS rn FROM s_reviews) r WHERE rn = 1"


@query("j5_latest_review", f"SELECT prospect_id, id, decision, pain_confirmed FROM ({LATEST_REVIEW})")
def j5(t):
    return scoring.latest_review(t.s_reviews).select("prospect_id", "review.id", "review.decision", "review.pain_confirmed")


@query("j6_offer_assets", """
SELECT id, CASE WHEN market_play_code IS NULL THEN EXISTS (SELECT 1 FROM s_assets WHERE is_active)
  ELSE EXISTS (SELECT 1 FROM s_assets a WHERE a.is_active AND (a.market_play_code = p.market_play_code OR a.market_play_code IS NULL)) END AS offer_ok
FROM s_prospects p
""")
def j6(t):
    return scoring.offer_ok(t.s_prospects, t.s_assets).select("id", "offer_ok")


@query("j7_events_with_prospect", """
SELECT p.id, p.company_name, e.id AS event_id, e.event_type FROM s_prospects p LEFT JOIN s_events e ON e.prospect_id = p.id
""")
def j7(t):
    return activity.with_events(t.s_prospects.select("id", "company_name"), t.s_events).select("id", "company_name", "event_id", "event_type")


@query("j8_open_tasks", """
SELECT prospect_id, string_agg(DISTINCT task_type, ',' ORDER BY task_type) AS task_types, count(*) AS open_task_count FROM s_tasks
WHERE status = 'open' GROUP BY 1
""")
def j8(t):
    out = activity.open_tasks(t.s_tasks)
    return out.select("prospect_id", F.array_join("task_types", ",").alias("task_types"), "open_task_count")


@query("j9_person_mailbox", """
WITH n AS (SELECT ord, prospect_id, full_name, CASE full_name WHEN 'Jean Martin' THEN 'jean' WHEN 'Mme Élodie Martin-Dupont' THEN 'elodie'
    WHEN 'Dr. Luc Robert' THEN 'luc' WHEN 'Marie Durand' THEN 'marie' ELSE 'paul' END AS f,
  CASE full_name WHEN 'Jean Martin' THEN 'martin' WHEN 'Mme Élodie Martin-Dupont' THEN 'martindupont' WHEN 'Dr. Luc Robert' THEN 'robert'
    WHEN 'Marie Durand' THEN 'durand' ELSE 'petit' END AS l FROM s_person_facts),
m AS (SELECT p.ord, p.value, p.publication_state, p.person_name, p.person_match_state, lower(split_part(trim(p.value), '@', 1)) AS lp, p.prospect_id, p.kind FROM s_point_facts p),
hit AS (SELECT m.ord, arg_min(n.full_name, n.ord) AS owner FROM m JOIN n ON n.prospect_id = m.prospect_id
  AND m.lp IN (f || '.' || l, f || l, f[1] || '.' || l, f[1] || l, l || '.' || f, f || '.' || l[1], f, l)
  WHERE m.kind = 'email' AND m.publication_state = 'published_personal' AND m.person_name IS NULL GROUP BY 1)
SELECT m.ord, coalesce(h.owner, m.person_name) AS person_name, CASE WHEN h.owner IS NOT NULL THEN 'exact_person_published' ELSE m.person_match_state END AS person_match_state
FROM m LEFT JOIN hit h USING (ord)
""")
def j9(t):
    return contacts.associate(t.s_point_facts, t.s_person_facts).select("ord", "person_name", "person_match_state")


@query("j10_source_urls", """
WITH o AS (SELECT 'person' AS owner_kind, person_id AS owner_id, source_url, id FROM s_contact_evidence WHERE person_id IS NOT NULL AND source_url IS NOT NULL
  UNION ALL SELECT 'point', contact_point_id, source_url, id FROM s_contact_evidence WHERE contact_point_id IS NOT NULL AND source_url IS NOT NULL),
f AS (SELECT owner_kind, owner_id, source_url, min(id) AS seen FROM o GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY owner_kind, owner_id ORDER BY seen) AS rn FROM f)
SELECT owner_kind, owner_id, string_agg(source_url, ' ' ORDER BY rn) AS urls FROM r WHERE rn <= 5 GROUP BY ALL
""")
def j10(t):
    out = contacts.source_urls(t.s_contact_evidence)
    return out.select("owner_kind", "owner_id", F.array_join("source_urls", " ").alias("urls"))


@query("j11_verdicts", """
SELECT p.ord, CASE WHEN v.email IS NULL THEN 'unchecked' ELSE v.confidence END AS confidence, v.is_reachable
FROM s_point_facts p LEFT JOIN s_verdicts v ON v.email = p.value WHERE p.kind = 'email'
""")
def j11(t):
    mails = t.s_point_facts.filter(F.col("kind") == "email").select("ord", F.col("value").alias("email"))
    return contacts.attach_verdicts(mails, t.s_verdicts).select("ord", "confidence", "is_reachable")


@query("j12_evidence_links", """
WITH names AS (SELECT prospect_id, normalized_name, max(id) AS person FROM s_people GROUP BY ALL),
vals AS (SELECT prospect_id, value_normalized, max(id) AS point FROM s_points GROUP BY ALL)
SELECT e.id, n.person AS person_id, v.point AS contact_point_id FROM s_contact_evidence e
LEFT JOIN names n ON n.prospect_id = e.prospect_id AND n.normalized_name = CASE e.person_name WHEN 'Jean Martin' THEN 'jean martin'
  WHEN 'Mme Élodie Martin-Dupont' THEN 'elodie martin-dupont' WHEN 'Dr. Luc Robert' THEN 'luc robert' WHEN 'Marie Durand' THEN 'marie durand' WHEN 'Paul Petit' THEN 'paul petit' END
LEFT JOIN vals v ON v.prospect_id = e.prospect_id AND v.value_normalized = lower(e.contact_value)
""")
def j12(t):
    bare = t.s_contact_evidence.drop("person_id", "contact_point_id")
    return contacts.link_evidence(bare, t.s_people, t.s_points).select("id", "person_id", "contact_point_id")


@query("j13_buyer_role", """
SELECT id, CASE WHEN regexp_matches(lower(decision_maker_title), 'gérant|gerant|président|president|fondateur|dirigeant') THEN 'gerant_owner'
  WHEN regexp_matches(lower(decision_maker_title), 'directeur d.exploitation|directeur operations|directeur des opérations|responsable exploitation') THEN 'operations'
  WHEN regexp_matches(lower(decision_maker_title), 'directeur de service|responsable maintenance|responsable sav|directeur technique') THEN 'service_maintenance'
  WHEN regexp_matches(lower(decision_maker_title), 'daf|directeur administratif|responsable administratif') THEN 'admin_finance'
  WHEN regexp_matches(lower(decision_maker_title), 'directeur commercial|responsable commercial') THEN 'commercial' END AS role FROM s_prospects
""")
def j13(t):
    return t.s_prospects.select("id", play_role(F.col("decision_maker_title"), FIELD_SERVICE)["role"].alias("role"))


@query("j14_company_domain", r"""
WITH page AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY length(url), url, page_id) AS rn FROM
    (SELECT *, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www[.]', '') AS host FROM s_site_pages) a) b WHERE rn = 1),
c AS (SELECT p.id, p.siren, page.host, page.html,
    list_filter(list_distinct(regexp_extract_all(lower(strip_accents(p.company_name)), '[a-z0-9]{3,}')), lambda w: w NOT IN ('sas', 'sarl', 'sa', 'eurl', 'sasu', 'societe', 'groupe', 'france')) AS words,
    regexp_extract_all(lower(strip_accents(page.html)), '[a-z0-9]{3,}') AS shown,
    regexp_extract_all(replace(replace(page.host, '.', ' '), '-', ' '), '[a-z0-9]{3,}') AS hostwords
  FROM s_prospects p JOIN page ON page.host = 'c' || CAST(p.id - id % 3 AS VARCHAR) || '.example.fr'),
s AS (SELECT *, greatest(len(list_intersect(words, shown)), len(list_intersect(words, hostwords))) AS k, greatest(1, len(words)) AS n FROM c)
SELECT id, host, CASE WHEN contains(regexp_replace(html, '[^0-9]', '', 'g'), siren) THEN 'exact_legal_match' WHEN k * 10 >= n * 8 THEN 'strong_brand_match'
  WHEN k * 10 >= n * 5 THEN 'probable' ELSE 'ambiguous' END AS domain_match_state FROM s
""")
def j14(t):
    from leadloom.functions.text import bare_host

    pages = t.s_site_pages.withColumn("host", bare_host(F.col("url")))
    first = identity.first_page_per_host(pages).select("host", F.lit("").alias("title"), F.col("html").alias("text"))
    owners = t.s_prospects.select(
        "id", "siren", "company_name", F.concat(F.lit("c"), (F.col("id") - F.col("id") % 3).cast("string"), F.lit(".example.fr")).alias("host")
    )
    return identity.domain_match(owners.join(first, "host")).select("id", "host", "domain_match_state")


@query("j15_domain_verification", """
WITH root AS (SELECT c_custkey - c_custkey % 3 AS h, min(c_custkey) AS k FROM customer GROUP BY 1),
r AS (SELECT 'c' || CAST(h AS VARCHAR) || '.example.fr' AS host, CASE WHEN h % 9 = 0 THEN 404 ELSE 200 END AS status,
  CASE WHEN h % 4 = 0 THEN 'SIREN ' || lpad(CAST(k AS VARCHAR), 9, '0') WHEN h % 4 = 1 THEN 'Froid Pro ' || CAST(floor(k / 2) AS BIGINT) ELSE 'x' END AS body,
  CASE WHEN h % 11 = 0 THEN 'non_public_address' END AS unsafe FROM root),
j AS (SELECT p.id, r.*, contains(lower(coalesce(body, '')), p.siren) AS by_id, trim(replace(replace(lower(p.company_name), 'limited', ''), 'ltd', '')) AS nm
  FROM s_prospects p LEFT JOIN r ON r.host = 'c' || CAST(p.id % 600 AS VARCHAR) || '.example.fr'),
s AS (SELECT *, contains(lower(coalesce(body, '')), nm) AS by_name FROM j)
SELECT id, CASE WHEN unsafe IS NOT NULL THEN 'rejected' WHEN status = 200 AND by_id THEN 'verified_primary' ELSE 'candidate' END AS verification_state,
  CAST(CASE WHEN unsafe IS NOT NULL THEN 0 WHEN status IS NULL THEN 1 WHEN status <> 200 THEN 3
    ELSE least(10, 2 + CASE WHEN by_id THEN 6 ELSE 0 END + CASE WHEN by_name THEN 4 ELSE 0 END) END AS BIGINT) AS score_tenths FROM s
""")
def j15(t):
    h, k = F.col("h"), F.col("k")
    roots = t.customer.groupBy((F.col("c_custkey") - F.col("c_custkey") % 3).alias("h")).agg(F.min("c_custkey").alias("k"))
    body = F.when(h % 4 == 0, F.concat(F.lit("SIREN "), F.lpad(k.cast("string"), 9, "0"))).when(
        h % 4 == 1, F.concat(F.lit("Froid Pro "), F.floor(k / 2).cast("string"))
    ).otherwise("x")
    fetched = roots.select(
        F.concat(F.lit("c"), h.cast("string"), F.lit(".example.fr")).alias("host"),
        F.when(h % 9 == 0, 404).otherwise(200).alias("status"),
        body.alias("body"),
        F.when(h % 11 == 0, "non_public_address").alias("unsafe_reason"),
        F.lit(None).cast("string").alias("fetch_error"),
    )
    owners = t.s_prospects.select(
        "id",
        F.concat(F.lit("https://www.c"), (F.col("id") % 600).cast("string"), F.lit(".Example.fr/x")).alias("domain"),
        F.col("company_name").alias("legal_name"),
        F.col("siren").alias("identifier"),
    )
    out = identity.verify_domain(owners, fetched)
    return out.select("id", "verification_state", F.round(F.col("match_score") * 10).cast("long").alias("score_tenths"))


@query("j16_queue_hints", f"""
WITH last AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY prospect_id ORDER BY event_date DESC, id DESC) AS rn FROM s_events e) z WHERE rn = 1),
tasks AS (SELECT prospect_id, bool_or(task_type = 'first_outreach') AS fo, bool_or(task_type = 'research') AS re,
  arg_min(title, id) FILTER (task_type IN ('confirm_buyer_identity', 'confirm_linkedin_profile', 'review_catch_all_email', 'use_contact_form')) AS ct FROM s_tasks WHERE status = 'open' GROUP BY 1)
SELECT p.id, CASE WHEN l.event_type = 'Replied' THEN 'Reply — respond to their message' WHEN l.event_type = 'MeetingBooked' THEN 'Meeting — prepare and confirm'
  WHEN l.next_action_date <= TIMESTAMP '{EVENTS_AS_OF} 00:00:00' THEN 'Overdue follow-up (' || CAST(floor(date_diff('second', l.next_action_date, TIMESTAMP '{EVENTS_AS_OF} 00:00:00') / 86400) AS BIGINT) || 'd)'
  WHEN fo THEN 'Send first outreach' WHEN re THEN 'Research — gather more evidence' WHEN ct IS NOT NULL THEN ct
  WHEN readiness_state = 'contact_ready' THEN 'Contact ready — create outreach task' WHEN readiness_state = 'human_review_required' THEN 'Needs qualification review'
  WHEN readiness_state = 'contact_required' THEN 'Find contact information' ELSE coalesce(readiness_state, '—') END AS action_hint
FROM s_prospects p LEFT JOIN last l ON l.prospect_id = p.id LEFT JOIN tasks t ON t.prospect_id = p.id WHERE NOT anonymized AND NOT opted_out
""")
def j16(t):
    out = activity.action_queue(t.s_prospects, t.s_events, t.s_tasks, EVENTS_AS_OF, min_score=None, limit=None)
    return out.select("id", "action_hint")


