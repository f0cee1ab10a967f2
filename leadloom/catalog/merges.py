"""Merges and set operations."""

from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.catalog import query
from leadloom.catalog.activity import HOLDERS, holders
from leadloom.catalog.functions import UTILITY_SQL
from leadloom.catalog.gates import fingerprint_sql
from leadloom.operators import awards, compliance, contacts, evidence, identity
from leadloom.plays import FIELD_SERVICE
from leadloom.session import cut_lineage
from leadloom.standins import EVENTS_AS_OF, NEW_SIDE, OLD_SIDE

NEW = NEW_SIDE.replace("o_orderdate", "observed_at")
OLD = OLD_SIDE.replace("o_orderdate", "observed_at")


@query("u1_union_of_sources", f"""
WITH {HOLDERS}, r AS (SELECT DISTINCT siren FROM s_registry)
SELECT 'decp' AS origin, siren FROM described UNION ALL SELECT 'registry', siren FROM r
""")
def u1(t):
    won = holders(t).select(F.lit("decp").alias("origin"), "siren")
    registered = t.s_registry.select("siren").distinct().select(F.lit("registry").alias("origin"), "siren")
    return identity.collect_sources(won, registered)


@query("u2_award_history", """
WITH o AS (SELECT *, prospect_id % 3 <> 0 AND CAST(id AS BIGINT) % 3 = 0 AS is_new FROM s_award_rows),
k AS (SELECT *, objet AS head FROM o),
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prospect_id, id, date, head ORDER BY cpv, montant NULLS FIRST, acheteur) AS copy FROM k WHERE is_new) x WHERE copy = 1
  AND NOT EXISTS (SELECT 1 FROM k old WHERE NOT old.is_new AND old.prospect_id = x.prospect_id AND old.id = x.id AND old.date IS NOT DISTINCT FROM x.date AND old.head = x.head)),
m AS (SELECT prospect_id, id, date, objet, montant, FALSE AS is_new FROM k WHERE NOT is_new UNION ALL SELECT prospect_id, id, date, objet, montant, TRUE FROM fresh),
r AS (SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY date DESC NULLS LAST, id, objet, montant NULLS FIRST, is_new) AS position FROM m)
SELECT prospect_id, position, id, date, montant FROM r
""")
def u2(t):
    fresh = (F.col("prospect_id") % 3 != 0) & (F.col("id").cast("long") % 3 == 0)
    out = awards.merge_awards(t.s_award_rows.filter(~fresh), t.s_award_rows.filter(fresh))
    return out.select("prospect_id", "position", "id", "date", "montant")


def old_and_new(t):
    early = F.col("observed_at") < F.lit("1996-01-01").cast("timestamp_ntz")
    return t.s_evidence.filter(early), t.s_evidence.filter(~early)


@query("u3_evidence_upsert", f"""
WITH f AS (SELECT *, {fingerprint_sql()} AS fingerprint FROM s_evidence),
known AS (SELECT DISTINCT prospect_id, fingerprint FROM f WHERE {OLD} AND is_active),
call AS (SELECT * FROM f WHERE {NEW}),
u AS (SELECT *, row_number() OVER (PARTITION BY prospect_id, fingerprint ORDER BY id) AS copy FROM call)
SELECT u.id, u.prospect_id, coalesce(signal_type, 'UNKNOWN') AS signal_type, coalesce(label, '') AS label, coalesce(nullif(confidence, 0), 50) AS confidence, coalesce(nullif(strength, 0), 50) AS strength
FROM u LEFT JOIN known k ON k.prospect_id = u.prospect_id AND k.fingerprint = u.fingerprint WHERE copy = 1 AND k.prospect_id IS NULL
""", whole="confidence strength")
def u3(t):
    old, new = old_and_new(t)
    return evidence.upsert_evidence(old, new).select("id", "prospect_id", "signal_type", "label", "confidence", "strength")


@query("u4_evidence_cache", f"""
WITH f AS (SELECT *, {fingerprint_sql()} AS fingerprint, NOT ({OLD}) AS is_new FROM s_evidence WHERE is_active),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prospect_id, fingerprint ORDER BY is_new, id) AS copy FROM f) x WHERE copy = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY is_new, id) AS position FROM u)
SELECT prospect_id, position, id FROM r
""")
def u4(t):
    return evidence.merge_evidence_cache(*old_and_new(t)).select("prospect_id", "position", "id")


_UPSERT = """
known AS (SELECT * FROM s_prospects),
inc AS (SELECT *, siren IN (SELECT value_normalized FROM s_suppression WHERE kind = 'siren') AS blocked, (SELECT min(id) FROM known k WHERE k.siren = s_registry.siren) AS hit FROM s_registry),
o AS (SELECT *, CASE WHEN blocked THEN 'skipped' WHEN hit IS NOT NULL THEN 'updated' WHEN row_number() OVER (PARTITION BY siren, blocked ORDER BY sighting) = 1 THEN 'created' ELSE 'updated' END AS outcome FROM inc)
"""


def registry_incoming(t):
    details = F.concat(F.lit("seen "), F.col("sighting").cast("string"))
    return t.s_registry.withColumns({"ord": F.col("sighting"), "signal_details": details})


def registry_outcomes(t):
    known = t.s_prospects
    return known, identity.upsert_outcomes(registry_incoming(t), known, t.s_suppression.filter(F.col("kind") == "siren"))


@query("u5_upsert_outcomes", f"WITH {_UPSERT} SELECT sighting, siren, outcome FROM o")
def u5(t):
    return registry_outcomes(t)[1].select("sighting", "siren", "outcome")


@query("u5b_upsert_snapshot", f"""
WITH {_UPSERT},
fold AS (SELECT siren, hit, bool_or(outcome = 'created') AS created, arg_max(company_name, sighting) AS company_name, arg_max(siret, sighting) FILTER (siret IS NOT NULL) AS siret, arg_max(naf_code, sighting) FILTER (naf_code IS NOT NULL) AS naf_code,
  arg_max(sector, sighting) AS sector, arg_max(company_size, sighting) AS company_size, arg_max(decision_maker_name, sighting) FILTER (decision_maker_name IS NOT NULL) AS dm, 'seen ' || CAST(max(sighting) AS VARCHAR) AS details FROM o WHERE NOT blocked GROUP BY 1, 2)
SELECT coalesce(f.siren, k.siren) AS siren, coalesce(f.company_name, k.company_name) AS company_name, coalesce(f.siret, k.siret) AS siret, coalesce(f.naf_code, k.naf_code) AS naf_code, coalesce(f.sector, k.sector) AS sector,
  coalesce(f.company_size, k.company_size) AS company_size, coalesce(f.dm, k.decision_maker_name) AS decision_maker_name, CASE WHEN k.id IS NULL THEN 'REGISTRY_FIELD' ELSE k.signal_type END AS signal_type,
  coalesce(k.signal_details, f.details) AS signal_details, CASE WHEN f.created THEN 'created' WHEN f.siren IS NOT NULL THEN 'updated' END AS changed, coalesce(k.contact_confidence, CASE WHEN k.id IS NULL THEN 'none' END) AS contact_confidence
FROM known k FULL OUTER JOIN fold f ON f.hit = k.id
""")
def u5b(t):
    known, outcomes = registry_outcomes(t)
    out = identity.upsert_prospects(known, outcomes, "REGISTRY_FIELD", "Annuaire", fixed.DATA_SOURCE_REGISTRY, FIELD_SERVICE.code)
    return out.select("siren", "company_name", "siret", "naf_code", "sector", "company_size", "decision_maker_name", "signal_type",
                      "signal_details", "changed", "contact_confidence")


_PERSON_KEYS = """
f AS (SELECT ord, prospect_id, full_name, job_title, buyer_role_score AS s, identity_confidence AS c, linkedin_url AS u, CASE full_name WHEN 'Jean Martin' THEN 'jean martin' WHEN 'Mme Élodie Martin-Dupont' THEN 'elodie martin-dupont'
    WHEN 'Dr. Luc Robert' THEN 'luc robert' WHEN 'Marie Durand' THEN 'marie durand' ELSE 'paul petit' END AS n,
  CASE job_title WHEN 'Gérant' THEN 'gerant' WHEN 'Directrice des opérations' THEN 'directrice des operations' WHEN 'DAF' THEN 'daf' WHEN 'Responsable SAV' THEN 'responsable sav' WHEN 'Comptable' THEN 'comptable' ELSE 'unknown' END AS r,
  CASE job_title WHEN 'Gérant' THEN 78 WHEN 'Directrice des opérations' THEN 100 WHEN 'DAF' THEN 48 WHEN 'Responsable SAV' THEN 88 WHEN 'Comptable' THEN 20 ELSE 0 END AS ts FROM s_person_facts),
g AS (SELECT prospect_id, n, r, max(ts) AS ts, list({'s': CAST(s AS BIGINT), 'c': CAST(c AS BIGINT), 'u': u} ORDER BY ord) AS facts FROM f GROUP BY ALL)
"""

# The rule applied one fact after another.
_PERSON_STEP = """lambda acc, x: {'s': CASE WHEN x.s > acc.s THEN greatest(x.s, ts) ELSE acc.s END, 'c': greatest(acc.c, x.c), 'u': coalesce(acc.u, x.u)}"""


@query("u6_people_merge", f"""
WITH {_PERSON_KEYS},
j AS (SELECT coalesce(o.prospect_id, g.prospect_id) AS prospect_id, coalesce(o.normalized_name, g.n) AS normalized_name, coalesce(o.normalized_role, g.r) AS normalized_role, o.id AS old_id, coalesce(o.manually_confirmed, FALSE) AS conf, facts, ts,
  CASE WHEN o.id IS NOT NULL THEN {{'s': CAST(o.buyer_role_score AS BIGINT), 'c': CAST(o.identity_confidence AS BIGINT), 'u': o.linkedin_url}} ELSE {{'s': greatest(facts[1].s, ts), 'c': facts[1].c, 'u': facts[1].u}} END AS start
  FROM s_people o FULL OUTER JOIN g ON g.prospect_id = o.prospect_id AND g.n = o.normalized_name AND g.r = o.normalized_role),
e AS (SELECT *, CASE WHEN conf OR facts IS NULL THEN start ELSE list_reduce(facts, {_PERSON_STEP}, start) END AS done FROM j)
SELECT prospect_id, normalized_name, normalized_role, done.s AS buyer_role_score, done.c AS identity_confidence, done.u AS linkedin_url, old_id IS NULL AS is_new, facts IS NOT NULL AS seen FROM e
""")
def u6(t):
    out = contacts.merge_people(t.s_people, t.s_person_facts)
    return out.select("prospect_id", "normalized_name", "normalized_role", "buyer_role_score", "identity_confidence", "linkedin_url", "is_new", "seen")


def _utility(prefix_supp: str) -> str:
    return UTILITY_SQL.replace("{supp}", prefix_supp).replace("{conf}", "FALSE").replace("{stale}", "FALSE")


_RANK = " ".join(f"WHEN '{name}' THEN {rank}" for name, rank in fixed.SOURCE_RANK.items())
_POINT_KEYS = f"""
f0 AS (SELECT *, CASE WHEN kind = 'email' THEN lower(trim(trim(value), '.,;:<>[]()"''')) WHEN kind IN ('linkedin', 'contact_form', 'website') THEN lower(trim(value)) ELSE trim(value) END AS v FROM s_point_facts),
f AS (SELECT *, CASE source_class {_RANK} ELSE 99 END AS rk, (kind = 'email' AND (v IN (SELECT value_normalized FROM s_suppression WHERE kind = 'email') OR split_part(v, '@', 2) IN (SELECT value_normalized FROM s_suppression WHERE kind = 'domain')))
  OR lpad(CAST(prospect_id AS VARCHAR), 9, '0') IN (SELECT p.siren FROM s_prospects p JOIN s_suppression s ON s.kind = 'siren' AND s.value_normalized = p.siren) AS supp FROM f0),
g AS (SELECT prospect_id, kind, v, bool_or(supp) AS supp, list({{'rk': CAST(rk AS BIGINT), 'sc': source_class, 'pub': publication_state, 'pm': person_match_state, 'c': CAST(confidence AS BIGINT), 'who': person_id}} ORDER BY ord) AS facts FROM f GROUP BY ALL)
"""
_POINT_STEP = """lambda acc, x: CASE WHEN x.rk <= acc.rk THEN {'rk': x.rk, 'sc': x.sc, 'pub': x.pub, 'pm': x.pm, 'dl': 'unchecked', 'c': greatest(acc.c, x.c), 'who': coalesce(acc.who, x.who), 'hit': TRUE} ELSE acc END"""


@query("u7_point_merge", f"""
WITH {_POINT_KEYS},
j AS (SELECT coalesce(o.prospect_id, g.prospect_id) AS prospect_id, coalesce(o.kind, g.kind) AS kind, coalesce(o.value_normalized, g.v) AS value_normalized, o.id AS old_id, facts, g.supp, o.utility_state AS old_utility, o.is_suppressed AS old_supp,
  coalesce(o.manually_confirmed, FALSE) OR o.rejection_reason IS NOT NULL AS locked,
  CASE WHEN o.id IS NOT NULL THEN {{'rk': CAST(CASE o.source_class {_RANK} ELSE 99 END AS BIGINT), 'sc': o.source_class, 'pub': o.publication_state, 'pm': o.person_match_state, 'dl': o.deliverability_state, 'c': CAST(o.confidence_score AS BIGINT), 'who': o.person_id, 'hit': FALSE}}
    ELSE {{'rk': facts[1].rk, 'sc': facts[1].sc, 'pub': facts[1].pub, 'pm': facts[1].pm, 'dl': 'unchecked', 'c': facts[1].c, 'who': facts[1].who, 'hit': TRUE}} END AS start
  FROM s_points o FULL OUTER JOIN g ON g.prospect_id = o.prospect_id AND g.kind = o.kind AND g.v = o.value_normalized),
e AS (SELECT *, CASE WHEN locked OR facts IS NULL THEN start ELSE list_reduce(facts, {_POINT_STEP}, start) END AS done FROM j),
s AS (SELECT prospect_id, kind, value_normalized, old_id, done.sc AS source_class, done.pub AS publication_state, done.pm AS person_match_state, done.dl AS deliverability_state, done.c AS confidence_score, done.who AS person_id, done.hit AS hit, supp, old_utility, old_supp FROM e)
SELECT prospect_id, kind, value_normalized, source_class, publication_state, person_match_state, deliverability_state, confidence_score, person_id, CASE WHEN hit THEN supp ELSE old_supp END AS is_suppressed,
  CASE WHEN hit THEN {_utility("supp")} ELSE old_utility END AS utility_state, old_id IS NULL AS is_new FROM s
""")
def u7(t):
    prepared = cut_lineage(contacts.prepare_points(t.s_point_facts, t.s_prospects, t.s_suppression))
    out = contacts.merge_points(t.s_points, prepared)
    return out.select("prospect_id", "kind", "value_normalized", "source_class", "publication_state", "person_match_state", "deliverability_state",
                      "confidence_score", "person_id", "is_suppressed", "utility_state", "is_new")


_CONTACT_FP = """sha256(CAST(prospect_id AS VARCHAR) || '|' || source_adapter || '|' || coalesce(source_url, '') || '|' || evidence_type || '|' || coalesce(contact_value, '') || '|' || CASE person_name WHEN 'Jean Martin' THEN 'jean martin'
  WHEN 'Mme Élodie Martin-Dupont' THEN 'elodie martin-dupont' WHEN 'Dr. Luc Robert' THEN 'luc robert' WHEN 'Marie Durand' THEN 'marie durand' WHEN 'Paul Petit' THEN 'paul petit' ELSE '' END || '|')"""


@query("u8_contact_evidence_append", f"""
WITH f AS (SELECT *, {_CONTACT_FP} AS fingerprint FROM s_contact_evidence),
u AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY ord) AS copy FROM f WHERE id % 4 <> 0 AND fingerprint NOT IN (SELECT fingerprint FROM f WHERE id % 4 = 0))
SELECT id, prospect_id, fingerprint, least(100, confidence) AS confidence, CASE WHEN source_url IS NOT NULL THEN 'c' || CAST(prospect_id - prospect_id % 3 AS VARCHAR) || '.example.fr' END AS source_domain FROM u WHERE copy = 1
""", whole="confidence")
def u8(t):
    from leadloom.functions.text import contact_fingerprint

    fp = contact_fingerprint(F.col("prospect_id"), F.col("source_adapter"), F.col("source_url"), F.col("evidence_type"), F.col("contact_value"),
                             F.col("person_name"), F.col("content_hash"))
    bare = t.s_contact_evidence.drop("person_id", "contact_point_id")
    stored = bare.filter(F.col("id") % 4 == 0).select(fp.alias("fingerprint"))
    out = contacts.append_contact_evidence(stored, bare.filter(F.col("id") % 4 != 0), t.s_people, t.s_points)
    return out.select("id", "prospect_id", "fingerprint", "confidence", "source_domain")


_DESIRED = """
cls AS (SELECT *, CASE WHEN deliverability_state = 'catch_all' THEN 'review_catch_all_email' WHEN person_match_state IN ('name_only_guess', 'pattern_inferred') THEN 'review_pattern_inferred_email'
  WHEN kind = 'phone' THEN 'call_switchboard_for_buyer' WHEN kind = 'contact_form' THEN 'use_contact_form' END AS k FROM s_points),
mail AS (SELECT DISTINCT prospect_id FROM s_points WHERE kind = 'email' AND is_usable),
want AS (SELECT id AS prospect_id, 'confirm_buyer_identity' AS task_type, 'No source-backed operational buyer was found.' AS notes FROM s_prospects p WHERE NOT EXISTS (SELECT 1 FROM s_points x WHERE x.prospect_id = p.id AND x.person_id IS NOT NULL)
  UNION ALL SELECT id, 'confirm_linkedin_profile', 'Manual search only; no LinkedIn automation.' FROM s_prospects p WHERE NOT EXISTS (SELECT 1 FROM s_points x WHERE x.prospect_id = p.id AND x.kind = 'linkedin')
  UNION ALL SELECT id, 'resolve_domain_ambiguity', 'Company/domain match is ambiguous.' FROM s_prospects WHERE id % 12 = 0
  UNION ALL SELECT c.prospect_id, k, arg_max('Source: ' || coalesce(c.domain, source_class), c.id) FROM cls c JOIN s_prospects p ON p.id = c.prospect_id
    WHERE k IS NOT NULL AND (k LIKE 'review%' OR c.prospect_id NOT IN (SELECT prospect_id FROM mail)) GROUP BY 1, 2)
"""


@query("u9_task_sync", f"""
WITH {_DESIRED},
managed AS (SELECT * FROM s_tasks WHERE origin = 'contact_intelligence' AND status = 'open')
SELECT prospect_id, task_type, CASE WHEN EXISTS (SELECT 1 FROM want w WHERE w.prospect_id = m.prospect_id AND w.task_type = m.task_type) OR prospect_id NOT IN (SELECT id FROM s_prospects) THEN 'kept' ELSE 'completed' END AS change, CAST(NULL AS VARCHAR) AS notes FROM managed m
UNION ALL SELECT prospect_id, task_type, 'created', notes FROM want w WHERE NOT EXISTS (SELECT 1 FROM managed m WHERE w.prospect_id = m.prospect_id AND w.task_type = m.task_type)
""")
def u9(t):
    ambiguous = t.s_prospects.filter(F.col("id") % 12 == 0).select("id")
    wanted = contacts.desired_tasks(t.s_prospects, t.s_points, ambiguous)
    out = contacts.sync_tasks(t.s_tasks, wanted, t.s_prospects.select("id"), EVENTS_AS_OF)
    shown = out.filter(((F.col("origin") == contacts.TASK_ORIGIN) & (F.col("status") == "open")) | F.col("change").isNotNull())
    return shown.select("prospect_id", "task_type", F.coalesce("change", F.lit("kept")).alias("change"), "notes")


@query("u10_suppression_add", """
WITH n AS (SELECT 'email' AS kind, lower(trim(email)) AS v FROM s_prospects WHERE email IS NOT NULL UNION ALL SELECT 'domain', 'c' || CAST(id - id % 3 AS VARCHAR) || '.example.fr' FROM s_prospects WHERE id % 3 = 0
  UNION ALL SELECT 'siren', siren FROM s_prospects WHERE id % 4 = 0)
SELECT DISTINCT kind, v AS value_normalized FROM n WHERE NOT EXISTS (SELECT 1 FROM s_suppression s WHERE s.kind = n.kind AND s.value_normalized = n.v)
""")
def u10(t):
    k = F.col("id")
    wanted = lambda kind, value, keep: t.s_prospects.filter(keep).select(
        F.lit(kind).alias("kind"), value.alias("value"), F.lit("r").alias("reason"), F.lit("s").alias("source")
    )
    new = wanted("email", F.concat(F.lit(" "), F.upper("email")), F.col("email").isNotNull())
    new = new.unionByName(wanted("domain", F.concat(F.lit("WWW.C"), (k - k % 3).cast("string"), F.lit(".example.fr")), k % 3 == 0))
    new = new.unionByName(wanted("siren", F.concat(F.substring("siren", 1, 3), F.lit(" "), F.substring("siren", 4, 6)), k % 4 == 0))
    return compliance.add_suppression(t.s_suppression, new).select("kind", "value_normalized")


@query("u11_field_fill", """
WITH r AS (SELECT siren, arg_min(company_name, sighting) AS company_name, arg_min(naf_code, sighting) AS naf_code, arg_min(decision_maker_name, sighting) AS dm, min(establishments) AS establishments FROM s_registry GROUP BY 1)
SELECT p.id, coalesce(nullif(p.company_name, ''), r.company_name) AS company_name, coalesce(r.naf_code, p.naf_code) AS naf_code, coalesce(p.decision_maker_name, r.dm) AS decision_maker_name, r.establishments
FROM s_prospects p LEFT JOIN r USING (siren)
""", whole="establishments")
def u11(t):
    base = t.s_prospects.select("id", "siren", "company_name", "naf_code", "decision_maker_name")
    new = t.s_registry.groupBy("siren").agg(
        F.min_by("company_name", "sighting").alias("company_name"), F.min_by("naf_code", "sighting").alias("naf_code"),
        F.min_by("decision_maker_name", F.when(F.col("decision_maker_name").isNotNull(), F.col("sighting"))).alias("decision_maker_name"),
        F.min("establishments").alias("establishments"),
    )
    return identity.enrich_merge(base, new, "siren", prefer=("naf_code",)).select("id", "company_name", "naf_code", "decision_maker_name", "establishments")


_DISCOVERED = """
w AS (SELECT * FROM s_registry WHERE (by_code OR coalesce(naf_code <> '7022Z' AND substring(naf_code, 1, 2) IN ('33', '43', '81', '71'), FALSE)) AND coalesce(substring(naf_code, 1, 2) NOT IN ('58', '61', '62', '63'), TRUE)),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY siren ORDER BY by_code DESC, sighting) AS copy FROM w) x WHERE copy = 1)
"""


@query("u12_registry_discovery", f"""
WITH {_DISCOVERED} SELECT siren, sighting, CASE WHEN establishments >= 2 THEN 2 ELSE 1 END AS evidence_items, 'Registry NAF ' || coalesce(naf_code, 'None') AS label FROM found
""", whole="evidence_items")
def u12(t):
    out = identity.discover_registry(t.s_registry, FIELD_SERVICE)
    return out.select("siren", "sighting", F.size("evidence").alias("evidence_items"), F.get("evidence", F.lit(0))["label"].alias("label"))


