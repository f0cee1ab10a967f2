"""People, contact points and pages."""

from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.catalog import query
from leadloom.catalog.functions import UTILITY_SQL
from leadloom.catalog.scans import registry_payloads
from leadloom.operators import contacts, evidence, pages
from leadloom.operators.identity import best_officer
from leadloom.plays import FIELD_SERVICE
from leadloom.sources.pages import accept_pages, parse_pages

_PAIRS = """
n AS (SELECT ord, prospect_id, CASE full_name WHEN 'Jean Martin' THEN 'jean' WHEN 'Mme Élodie Martin-Dupont' THEN 'elodie' WHEN 'Dr. Luc Robert' THEN 'luc' WHEN 'Marie Durand' THEN 'marie' ELSE 'paul' END AS f,
  CASE full_name WHEN 'Jean Martin' THEN 'martin' WHEN 'Mme Élodie Martin-Dupont' THEN 'martindupont' WHEN 'Dr. Luc Robert' THEN 'robert' WHEN 'Marie Durand' THEN 'durand' ELSE 'petit' END AS l FROM s_person_facts),
m AS (SELECT 'c' || CAST(prospect_id - prospect_id % 3 AS VARCHAR) || '.example.fr' AS domain, CASE ord % 6 WHEN 0 THEN 'firstname.lastname' WHEN 1 THEN 'f.lastname' WHEN 2 THEN 'firstname' WHEN 3 THEN 'lastname' END AS pattern FROM n)
"""


@query("a10_mailbox_patterns", f"""
WITH {_PAIRS} SELECT domain, pattern, count(*) AS observations, CASE WHEN count(*) >= 3 THEN 'strong' WHEN count(*) = 2 THEN 'moderate' ELSE 'weak' END AS strength FROM m WHERE pattern IS NOT NULL GROUP BY ALL
""")
def a10(t):
    from leadloom.functions import mailboxes

    names = t.s_person_facts.withColumn("n", mailboxes.name_tokens(F.col("full_name")))
    first, last = F.col("n.first"), F.col("n.last")
    local = F.when(F.col("ord") % 6 == 0, F.concat(first, F.lit("."), last)).when(
        F.col("ord") % 6 == 1, F.concat(F.substring(first, 1, 1), F.lit("."), last)
    ).when(F.col("ord") % 6 == 2, first).when(F.col("ord") % 6 == 3, last).when(F.col("ord") % 6 == 4, "contact").otherwise("zz.zz")
    domain = F.concat(F.lit("c"), (F.col("prospect_id") - F.col("prospect_id") % 3).cast("string"), F.lit(".example.fr"))
    pairs = names.select(domain.alias("domain"), F.concat(local, F.lit("@"), domain).alias("email"), F.col("full_name").alias("person_name"))
    return contacts.learn_patterns(pairs).select("domain", "pattern", "observations", "strength")


@query("a12_run_summary", """
SELECT prospect_id, count(*) AS contact_points, count(*) FILTER (kind = 'email' AND publication_state <> 'not_published') AS published_emails, count(*) FILTER (source_class = 'domain_pattern') AS generated_candidates,
  count(*) FILTER (deliverability_state = 'deliverable') AS verified_deliverable, count(*) FILTER (deliverability_state = 'catch_all') AS catch_all, count(*) FILTER (deliverability_state = 'invalid') AS invalid,
  count(*) FILTER (requires_manual_review) AS manual_review_required, count(*) FILTER (is_usable AND NOT is_suppressed) AS usable_paths FROM s_points GROUP BY 1
""")
def a12(t):
    return contacts.run_summary(t.s_points)


_POINT_ORDER = """CASE utility_state WHEN 'usable_personal' THEN 0 WHEN 'usable_role' THEN 1 WHEN 'usable_generic' THEN 2 WHEN 'manual_confirmation_required' THEN 3 WHEN 'verification_required' THEN 4 WHEN 'stale' THEN 5
  WHEN 'no_contact' THEN 6 WHEN 'invalid' THEN 8 WHEN 'suppressed' THEN 9 ELSE 7 END, CASE kind WHEN 'email' THEN 0 WHEN 'phone' THEN 1 WHEN 'contact_form' THEN 2 WHEN 'linkedin' THEN 3 WHEN 'website' THEN 4 ELSE 8 END,
  CASE WHEN manually_confirmed THEN 0 ELSE 1 END, confidence_score DESC, id"""
POINT_RANKS = f"SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY {_POINT_ORDER}) AS rn FROM s_points WHERE rejection_reason IS NULL AND NOT is_suppressed"


@query("a13_candidate_summary", f"SELECT prospect_id, string_agg(CAST(id AS VARCHAR) || ':' || value_display, ' ' ORDER BY rn) AS candidates FROM ({POINT_RANKS}) r WHERE rn <= 10 GROUP BY 1")
def a13(t):
    shown = F.transform("contact_candidates", lambda c: F.concat(c["id"].cast("string"), F.lit(":"), c["value_display"]))
    return contacts.candidate_summary(t.s_points).select("prospect_id", F.array_join(shown, " ").alias("candidates"))


@query("a13b_candidate_rows", f"SELECT prospect_id, rn AS position, id, value_display FROM ({POINT_RANKS}) r")
def a13b(t):
    return contacts.candidate_rows(t.s_points).select("prospect_id", "position", "id", "value_display")


def _code_tests() -> str:
    tests = []
    for code, _, _, words in fixed.EVIDENCE_TAXONOMY:
        pattern = "|".join(f"(?:{w})" for w in words).replace("'", "''")
        tests.append(f"SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www[.]', '') AS host, '{code}' AS code FROM s_site_pages WHERE regexp_matches(lower(html), '{pattern}')")
    return " UNION ALL ".join(tests)


@query("a14_evidence_codes", f"SELECT host, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM ({_code_tests()}) x GROUP BY 1")
def a14(t):
    found = evidence.extract_evidence(accept_pages(t.s_site_pages).select("page_id", "host", "html"), "html")
    return evidence.evidence_codes(found, "host").select("host", F.array_join("codes", ",").alias("codes"))


@query("w4_primary_person", """
SELECT prospect_id, id FROM (SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY CASE WHEN manually_confirmed THEN 0 ELSE 1 END, buyer_role_score DESC, identity_confidence DESC, id) AS rn FROM s_people WHERE is_active) x WHERE rn = 1
""")
def w4(t):
    return contacts.primary_person(t.s_people).select("prospect_id", "id")


@query("w5_primary_point", f"SELECT prospect_id, id, kind FROM ({POINT_RANKS}) r WHERE rn = 1")
def w5(t):
    return contacts.primary_point(t.s_points).select("prospect_id", "id", "kind")


_PAGE_CASES = " ".join(f"WHEN contains(h, '{term}') THEN {i}" for i, term in enumerate(fixed.PAGE_PRIORITY_TERMS))


@query("w6_page_selection", f"""
WITH p AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS clean_url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www[.]', '') AS host, lower(strip_accents(url || ' ')) AS h, page_id % 4 AS depth FROM s_site_pages),
q AS (SELECT *, CASE {_PAGE_CASES} ELSE 100 END AS priority FROM p),
u AS (SELECT *, row_number() OVER (PARTITION BY host, clean_url ORDER BY priority, depth, url, page_id) AS copy FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY priority, depth, clean_url) AS visit FROM u WHERE copy = 1)
SELECT page_id, host, visit, priority FROM r
""", whole="priority")
def w6(t):
    return pages.select_pages(t.s_site_pages.withColumn("depth", F.col("page_id") % 4)).select("page_id", "host", "visit", "priority")


@query("w7_first_seen_points", """
SELECT prospect_id, kind, lower(value) AS value_key, min(ord) AS ord FROM s_point_facts GROUP BY ALL
""")
def w7(t):
    facts = t.s_point_facts.withColumn("source_url", F.lit(""))
    return pages.dedupe_points(facts, "prospect_id", "ord").select("prospect_id", "kind", F.lower("value").alias("value_key"), "ord")


@query("w7b_first_seen_people", """
SELECT prospect_id, lower(full_name) AS name_key, lower(coalesce(job_title, '')) AS title_key, min(ord) AS ord FROM s_person_facts GROUP BY ALL
""")
def w7b(t):
    facts = t.s_person_facts.withColumn("source_url", F.lit(""))
    out = pages.dedupe_people(facts, "prospect_id", "ord")
    return out.select("prospect_id", F.lower("full_name").alias("name_key"), F.lower(F.coalesce("job_title", F.lit(""))).alias("title_key"), "ord")


@query("w7c_first_seen_evidence", """
SELECT prospect_id, evidence_type, source_url, coalesce(contact_value, person_name) AS what, min(ord) AS ord FROM s_contact_evidence GROUP BY ALL
""")
def w7c(t):
    out = pages.dedupe_evidence(t.s_contact_evidence, "prospect_id", "ord")
    return out.select("prospect_id", "evidence_type", "source_url", F.coalesce("contact_value", "person_name").alias("what"), "ord")


@query("w8_best_officer", """
SELECT sighting, CASE sighting % 4 WHEN 0 THEN 'MARTIN' WHEN 2 THEN 'DURAND' END AS family FROM s_registry
""")
def w8(t):
    return registry_payloads(t).select("sighting", best_officer(F.col("dirigeants"), FIELD_SERVICE)["nom"].alias("family"))


_CHECKED = """
c AS (SELECT p.ord, p.prospect_id, v.email, v.confidence FROM s_point_facts p JOIN s_verdicts v ON v.email = p.value WHERE p.kind = 'email' AND v.confidence NOT IN ('invalid', 'bounced'))
"""


@query("w9_best_verdict", f"""
WITH {_CHECKED}, r AS (SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY CASE confidence WHEN 'deliverable' THEN 0 WHEN 'catch_all' THEN 3 WHEN 'indeterminate' THEN 4 WHEN 'risky' THEN 6 ELSE 7 END, ord) AS rn FROM c)
SELECT prospect_id, email, confidence FROM r WHERE rn = 1
""")
def w9(t):
    mails = t.s_point_facts.filter(F.col("kind") == "email").select("prospect_id", F.col("ord").alias("position"), F.col("value").alias("email"))
    return contacts.best_verdict(contacts.attach_verdicts(mails, t.s_verdicts)).select("prospect_id", "email", "confidence")


_W10 = f"""
b AS (SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY id) AS batch_rank FROM s_points WHERE kind = 'email' AND NOT is_suppressed AND deliverability_state = 'unchecked'),
j AS (SELECT b.* REPLACE (CASE v.confidence WHEN 'deliverable' THEN 'deliverable' ELSE 'risky' END AS deliverability_state), v.confidence FROM b LEFT JOIN s_verdicts v ON v.email = b.value_normalized),
k AS (SELECT *, coalesce(confidence = 'deliverable' AND ({UTILITY_SQL.replace("{supp}", "is_suppressed").replace("{conf}", "manually_confirmed").replace("{stale}", "FALSE")}) = 'usable_personal', FALSE) AS done FROM j)
"""


@query("w10_verification_batch", f"""
WITH {_W10} SELECT a.id, a.prospect_id, a.batch_rank FROM k a WHERE NOT EXISTS (SELECT 1 FROM k z WHERE z.prospect_id = a.prospect_id AND z.batch_rank < a.batch_rank AND z.done)
""")
def w10(t):
    outcomes = t.s_verdicts.select("email", F.when(F.col("confidence") == "deliverable", "deliverable").otherwise("risky").alias("deliverability"))
    return contacts.verify_batch(t.s_points, outcomes).select("id", "prospect_id", "batch_rank")


@query("w11_top_people", """
SELECT prospect_id, ord, rn AS person_rank FROM (SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY buyer_role_score DESC, ord) AS rn FROM s_person_facts) x WHERE rn <= 3
""")
def w11(t):
    return contacts.top_people(t.s_person_facts, n=3).select("prospect_id", "ord", "person_rank")


@query("o5_dossier_runs", """
SELECT prospect_id, id, rn AS run_rank FROM (SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY started_at DESC, id DESC) AS rn FROM s_runs) x WHERE rn <= 5
""")
def o5(t):
    return contacts.recent_runs(t.s_runs).select("prospect_id", "id", "run_rank")


@query("o5b_dossier_people", "SELECT prospect_id, id, is_primary_candidate, buyer_role_score FROM s_people", whole="buyer_role_score")
def o5b(t):
    people, _points = contacts.dossier_order(t.s_people, t.s_points)
    return people.select("prospect_id", "id", "is_primary_candidate", "buyer_role_score")


def parsed(t):
    return parse_pages(accept_pages(t.s_site_pages))


@query("h1_page_parse")
def h1(t):
    return parsed(t).select(
        "page_id", "title", F.size("parts").alias("blocks"), F.size("links").alias("links"), F.size("forms").alias("forms"),
        F.size("items").alias("items"),
    )


@query("h2_contact_facts", """
SELECT 1000000000 + c_custkey AS page_id, k.kind, CASE k.kind WHEN 'email' THEN 'contact@c' || CAST(c_custkey - c_custkey % 3 AS VARCHAR) || '.example.fr' WHEN 'phone' THEN '+331445500' || CAST(c_custkey % 90 + 10 AS VARCHAR)
  ELSE 'https://www.c' || CAST(c_custkey - c_custkey % 3 AS VARCHAR) || '.example.fr/devis' END AS value, k.publication_state, k.confidence
FROM customer, (VALUES ('email', 'published_generic', 72), ('phone', 'published_generic', 75), ('contact_form', 'published_generic', 70)) k(kind, publication_state, confidence)
UNION ALL SELECT 2000000000 + c_custkey, 'email', 'jean.martin@c' || CAST(c_custkey - c_custkey % 3 AS VARCHAR) || '.example.fr', 'published_personal', 82 FROM customer
""", whole="confidence")
def h2(t):
    return pages.contact_facts(parsed(t)).select("page_id", "kind", "value", "publication_state", "confidence")


@query("h3_people_facts")
def h3(t):
    return pages.people_facts(parsed(t)).select("page_id", "full_name", "job_title", "role_category", "buyer_role_score", "identity_confidence")


@query("h4_evidence_facts")
def h4(t):
    from leadloom.session import cut_lineage

    page = cut_lineage(parsed(t))
    facts = pages.evidence_facts(pages.contact_facts(page), pages.people_facts(page))
    return facts.select("page_id", "evidence_type", "excerpt", "confidence")


@query("h5_registry_people", """
SELECT sighting AS prospect_id, p.full_name, p.job_title, p.role_category, p.score AS buyer_role_score FROM s_registry r, (VALUES (0, 'ANNE AUDIT', 'Commissaire aux comptes titulaire', 'other', 20),
  (0, 'MARIE CLAIRE DURAND', 'DAF', 'administration_finance', 48), (0, 'jean-paul MARTIN', 'Gérant', 'owner', 78), (1, 'ANNE AUDIT', 'Commissaire aux comptes titulaire', 'other', 20),
  (2, 'MARIE CLAIRE DURAND', 'DAF', 'administration_finance', 48)) p(k, full_name, job_title, role_category, score) WHERE r.sighting % 4 = p.k
""", whole="buyer_role_score")
def h5(t):
    rows = registry_payloads(t).withColumnRenamed("sighting", "id")
    return pages.registry_people(rows).select("prospect_id", "full_name", "job_title", "role_category", "buyer_role_score")


