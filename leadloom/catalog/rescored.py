"""Write jobs that end in a score: what they write, beside the whole scoring rule over the written rows."""

from pyspark.sql import functions as F

from leadloom.catalog import query
from leadloom.catalog.contacts import POINT_RANKS
from leadloom.catalog.gates import GATED, REVIEW_ERRORS
from leadloom.catalog.jobs import D13, waterfall
from leadloom.catalog.merges import _DISCOVERED
from leadloom.catalog.scans import LABELLED
from leadloom.catalog.scores import SCORED
from leadloom.plans import acquire, rescore
from leadloom.plays import FIELD_SERVICE
from leadloom.standins import AWARDS_AS_OF, HISTORY_AS_OF

STAGE = """CASE s.state WHEN 'contact_ready' THEN 'contact_ready' WHEN 'human_review_required' THEN 'human_review_required' WHEN 'suppressed' THEN 'suppressed'
  WHEN 'contact_required' THEN 'enriched' ELSE 'researching' END"""
#: The written columns: those of the rule where a row was scored, else the stored ones.
RESULT = f"""
CASE WHEN s.id IS NULL THEN w.fit_score ELSE s.fit END AS fit_score, CASE WHEN s.id IS NULL THEN w.opportunity_score ELSE s.score END AS opportunity_score,
CASE WHEN s.id IS NULL THEN w.urgency_score ELSE s.score END AS urgency_score, CASE WHEN s.id IS NULL THEN w.readiness_state ELSE s.state END AS readiness_state,
s.failures AS failures, CASE WHEN s.id IS NULL THEN w.acquisition_stage ELSE {STAGE} END AS acquisition_stage,
CASE WHEN s.id IS NULL THEN w.needs_manual_review WHEN s.state = 'contact_ready' THEN FALSE WHEN s.state = 'suppressed' THEN s.needs_manual_review ELSE TRUE END AS needs_manual_review,
CASE WHEN s.id IS NULL THEN w.priority_level WHEN s.score >= 70 THEN 'High' WHEN s.score >= 45 THEN 'Medium' ELSE 'Low' END AS priority_level
"""
WHOLE = "fit_score opportunity_score urgency_score"


def over_changed(reviews: str = "s_reviews", evidence: str = "s_evidence", suppression: str = "s_suppression") -> str:
    """The scoring rule over the rows ``changed_rows``, with the named tables in place of the stored ones."""
    text = SCORED.replace("s_prospects", "changed_rows")
    for stored, name in (("s_reviews", reviews), ("s_evidence", evidence), ("s_suppression", suppression)):
        text = text.replace(stored, name)
    return text


def facts(t, **tables) -> rescore.Facts:
    stored = {"evidence": t.s_evidence, "reviews": t.s_reviews, "awards": t.s_award_rows, "suppression": t.s_suppression, "assets": t.s_assets}
    return rescore.Facts(**stored | tables)


def shown(written: rescore.Written, *columns: str):
    score = ("fit_score", "opportunity_score", "urgency_score", "readiness_state", "acquisition_stage", "needs_manual_review", "priority_level")
    return written.prospects.select("id", *columns, *score, F.array_join("readiness_failures", "; ").alias("failures"))


_NEW = """
given AS (SELECT sighting AS id, siren, siret, company_name, naf_code, company_size, decision_maker_name, decision_maker_title, 'contact@c' || CAST(sighting - sighting % 3 AS VARCHAR) || '.example.fr' AS email FROM s_registry),
marked AS (SELECT *, NOT (siren IN (SELECT value_normalized FROM s_suppression WHERE kind = 'siren') OR email IN (SELECT value_normalized FROM s_suppression WHERE kind = 'email')
  OR split_part(email, '@', 2) IN (SELECT value_normalized FROM s_suppression WHERE kind = 'domain')) AS created FROM given),
"""


def new_rows(t):
    host = F.concat(F.lit("contact@c"), (F.col("sighting") - F.col("sighting") % 3).cast("string"), F.lit(".example.fr"))
    columns = ("siren", "siret", "company_name", "naf_code", "company_size", "decision_maker_name", "decision_maker_title")
    return t.s_registry.select(F.col("sighting").alias("id"), *columns, host.alias("email"))


@query("d3b_created_scored", f"""
WITH {_NEW}
changed_rows AS (SELECT * EXCLUDE (created), CAST(NULL AS VARCHAR) AS signal_type, CAST(NULL AS VARCHAR) AS signal_details, CAST(NULL AS VARCHAR) AS notes, CAST(NULL AS VARCHAR) AS contact_confidence,
  CAST(NULL AS VARCHAR) AS contact_discovery_state, CAST(NULL AS VARCHAR) AS data_source, CAST(NULL AS VARCHAR) AS website, FALSE AS opted_out, FALSE AS needs_manual_review,
  'FIELD_SERVICE_OPERATIONS_FR' AS market_play_code FROM marked WHERE created),
{over_changed()}
SELECT w.id, created, s.fit AS fit_score, s.score AS opportunity_score, s.score AS urgency_score, coalesce(s.state, 'research_required') AS readiness_state, s.failures AS failures,
  CASE WHEN s.id IS NOT NULL THEN {STAGE} END AS acquisition_stage, s.id IS NOT NULL AND s.state NOT IN ('contact_ready', 'suppressed') AS needs_manual_review,
  CASE WHEN s.score >= 70 THEN 'High' WHEN s.score >= 45 THEN 'Medium' WHEN s.score IS NOT NULL THEN 'Low' END AS priority_level
FROM marked w LEFT JOIN scored s ON s.id = w.id
""", whole=WHOLE)
def d3b(t):
    return shown(rescore.create(new_rows(t), facts(t), FIELD_SERVICE, HISTORY_AS_OF), "created")


@query("d3c_created_events", f"WITH {_NEW} x AS (SELECT 1) SELECT id AS prospect_id, 'New' AS event_type, 'Prospect created' AS notes, 'research' AS event_kind FROM marked WHERE created")
def d3c(t):
    return rescore.create(new_rows(t), facts(t), FIELD_SERVICE, HISTORY_AS_OF).events.select("prospect_id", "event_type", "notes", "event_kind")


@query("d4b_updated_scored", f"""
WITH written AS (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN '4322A' ELSE naf_code END AS naf_code, CASE WHEN id % 6 = 0 THEN NULL ELSE notes END AS notes) FROM s_prospects),
changed_rows AS (SELECT * FROM written WHERE id % 3 = 0), {over_changed()}
SELECT w.id, w.naf_code, w.notes, {RESULT} FROM written w LEFT JOIN scored s ON s.id = w.id
""", whole=WHOLE)
def d4b(t):
    k = F.col("id")
    patch = t.s_prospects.filter(k % 3 == 0).select("id", F.lit("4322A").alias("naf_code"), F.lit(None).cast("string").alias("notes"), (k % 2 == 0).alias("set_notes"))
    return shown(rescore.update(t.s_prospects, patch, facts(t), FIELD_SERVICE, HISTORY_AS_OF), "naf_code", "notes")


@query("d5d_events_scored", f"""
{GATED}, good AS (SELECT * FROM gated WHERE reason IS NULL), outs AS (SELECT DISTINCT p.* FROM good g JOIN s_prospects p ON p.id = g.prospect_id WHERE event_type = 'OptOut'),
suppression_now AS (SELECT kind, value_normalized FROM s_suppression UNION SELECT 'email', lower(trim(email)) FROM outs WHERE email IS NOT NULL UNION SELECT 'siren', siren FROM outs WHERE siren IS NOT NULL),
written AS (SELECT * REPLACE (opted_out OR id IN (SELECT id FROM outs) AS opted_out) FROM s_prospects),
changed_rows AS (SELECT * FROM written WHERE id IN (SELECT prospect_id FROM good)), {over_changed(suppression="suppression_now")}
SELECT w.id, w.opted_out, {RESULT} FROM written w LEFT JOIN scored s ON s.id = w.id
""", whole=WHOLE)
def d5d(t):
    return shown(rescore.log_events(t.s_prospects, t.s_events, facts(t), FIELD_SERVICE, HISTORY_AS_OF), "opted_out")


@query("d6c_qualified_scored", f"""
WITH e AS ({REVIEW_ERRORS.replace("FROM s_reviews r", "FROM (SELECT * FROM s_reviews WHERE id >= 1000000000) r")}),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY created_at DESC, id DESC) AS rn FROM e WHERE error IS NULL) x WHERE rn = 1),
reviews_now AS (SELECT * FROM s_reviews WHERE id < 1000000000 UNION ALL BY NAME SELECT * EXCLUDE (error) FROM e WHERE error IS NULL),
written AS (SELECT p.* REPLACE (CASE d.decision WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' WHEN 'park' THEN 'parked' WHEN 'research_more' THEN 'research_more' ELSE manual_review_state END AS manual_review_state,
  CASE WHEN d.decision IN ('accept', 'reject') THEN FALSE WHEN d.decision = 'research_more' THEN TRUE ELSE needs_manual_review END AS needs_manual_review,
  coalesce(d.decision, qualification_decision) AS qualification_decision) FROM s_prospects p LEFT JOIN d ON d.prospect_id = p.id),
changed_rows AS (SELECT * FROM written WHERE id IN (SELECT prospect_id FROM d)), {over_changed(reviews="reviews_now")}
SELECT w.id, w.manual_review_state, w.qualification_decision, {RESULT} FROM written w LEFT JOIN scored s ON s.id = w.id
""", whole=WHOLE)
def d6c(t):
    stored, new = (t.s_reviews.filter(F.col("id") < 10**9), t.s_reviews.filter(F.col("id") >= 10**9))
    out = rescore.qualify(t.s_prospects, new, facts(t, reviews=stored), FIELD_SERVICE, HISTORY_AS_OF)
    return shown(out, "manual_review_state", "qualification_decision")


_CONFIDENCE = """CASE WHEN pt.id IS NULL THEN 'none' WHEN pt.manually_confirmed THEN 'manual_confirmed' WHEN pt.publication_state = 'published_personal' THEN 'published_personal'
  WHEN pt.publication_state IN ('published_role', 'published_generic') THEN 'published_generic'
  WHEN pt.person_match_state = 'exact_person_pattern_confirmed' AND pt.deliverability_state = 'deliverable' THEN 'deliverable' ELSE 'needs_review' END"""
_DISCOVERY = """CASE WHEN pt.id IS NULL THEN NULL WHEN pt.manually_confirmed THEN 'user_supplied' WHEN pt.publication_state IN ('published_personal', 'published_role', 'published_generic') THEN 'published'
  WHEN pt.person_match_state = 'exact_person_pattern_confirmed' AND pt.deliverability_state = 'deliverable' THEN 'inferred' ELSE 'guessed' END"""


@query("d8b_contacts_scored", f"""
WITH pp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY CASE WHEN manually_confirmed THEN 0 ELSE 1 END, buyer_role_score DESC, identity_confidence DESC, id) AS rn FROM s_people WHERE is_active) x WHERE rn = 1),
pt AS (SELECT * FROM ({POINT_RANKS}) x WHERE rn = 1),
changed_rows AS (SELECT p.* REPLACE (coalesce(pp.full_name, p.decision_maker_name) AS decision_maker_name, CASE WHEN pp.id IS NOT NULL THEN pp.job_title ELSE p.decision_maker_title END AS decision_maker_title,
    CASE WHEN pt.kind = 'email' AND pt.utility_state IN ('usable_personal', 'usable_role', 'usable_generic') THEN pt.value_normalized ELSE p.email END AS email,
    {_CONFIDENCE} AS contact_confidence, {_DISCOVERY} AS contact_discovery_state, coalesce(pt.requires_manual_review, TRUE) AS needs_manual_review)
  FROM s_prospects p LEFT JOIN pp ON pp.prospect_id = p.id LEFT JOIN pt ON pt.prospect_id = p.id WHERE p.id % 2 = 0),
{over_changed()}
SELECT w.id, CASE WHEN s.id IS NULL THEN w.email ELSE s.email END AS email, CASE WHEN s.id IS NULL THEN w.contact_confidence ELSE s.contact_confidence END AS contact_confidence, {RESULT}
FROM s_prospects w LEFT JOIN scored s ON s.id = w.id
""", whole=WHOLE)
def d8b(t):
    processed = t.s_prospects.filter(F.col("id") % 2 == 0)
    return shown(rescore.project_contacts(t.s_prospects, t.s_people, t.s_points, processed, facts(t), FIELD_SERVICE, HISTORY_AS_OF), "email", "contact_confidence")


_FOUND = """
r AS (SELECT siren, arg_min(company_name, sighting) AS company_name, min(siret) AS siret, min(sighting) AS sighting FROM s_registry GROUP BY 1),
e AS (SELECT p.* REPLACE (coalesce(r.company_name, p.company_name) AS company_name, coalesce(r.siret, p.siret) AS siret, coalesce(p.email, 'contact@nouveau.fr') AS email), r.sighting FROM s_prospects p JOIN r USING (siren)),
found AS (SELECT CAST(1000000000000 AS BIGINT) + sighting AS id, p.id AS prospect_id, 'structural_fit' AS category, 'REGISTRY_ACTIVITY' AS signal_type, 'Registry entry' AS label, r.company_name AS evidence_text,
  CAST(NULL AS VARCHAR) AS evidence_url, 'annuaire' AS source_type, TRUE AS is_active, FALSE AS manually_confirmed FROM s_prospects p JOIN r USING (siren)),
"""


@query("d12b_enriched_scored", f"""
WITH {_FOUND} evidence_now AS (SELECT * FROM s_evidence UNION ALL BY NAME SELECT * FROM found),
changed_rows AS (SELECT * EXCLUDE (sighting) REPLACE (CASE WHEN guess THEN 'domain_and_pattern_only' ELSE contact_confidence END AS contact_confidence, CASE WHEN guess THEN 'guessed' ELSE contact_discovery_state END AS contact_discovery_state)
  FROM (SELECT *, coalesce(coalesce(contact_confidence, '') IN ('', 'none', 'unverified') AND contact_discovery_state IS NULL, FALSE) AS guess FROM e)),
{over_changed(evidence="evidence_now")}
SELECT w.id, CASE WHEN s.id IS NULL THEN w.company_name ELSE s.company_name END AS company_name, CASE WHEN s.id IS NULL THEN w.email ELSE s.email END AS email,
  strftime(CASE WHEN s.id IS NULL THEN w.last_enriched_at ELSE TIMESTAMP '{HISTORY_AS_OF}' END, '%Y-%m-%d') AS enriched_on, {RESULT}
FROM s_prospects w LEFT JOIN scored s ON s.id = w.id
""", whole=WHOLE)
def d12b(t):
    out = enriched(t)
    return shown(out, "company_name", "email", "last_enriched_at").withColumn("enriched_on", F.date_format("last_enriched_at", "yyyy-MM-dd")).drop("last_enriched_at")


def enriched(t) -> rescore.Written:
    registry = t.s_registry.groupBy("siren").agg(F.min_by("company_name", "sighting").alias("company_name"), F.min("siret").alias("siret"), F.min("sighting").alias("sighting"))
    known = t.s_prospects.select("id", "siren", F.col("email").alias("stored_email")).join(registry, "siren")
    patch = known.select("id", "company_name", "siret", F.when(F.col("stored_email").isNull(), "contact@nouveau.fr").alias("email"))
    none = F.lit(None).cast("string")
    found = known.select(
        (F.lit(10**12) + F.col("sighting")).alias("id"), F.col("id").alias("prospect_id"), F.lit("structural_fit").alias("category"), F.lit("REGISTRY_ACTIVITY").alias("signal_type"),
        F.lit("Registry entry").alias("label"), F.col("company_name").alias("evidence_text"), none.alias("evidence_url"), F.lit("annuaire").alias("source_type"),
        F.lit(None).cast("int").alias("confidence"), F.lit(None).cast("int").alias("strength"), F.lit(False).alias("manually_confirmed"),
    )
    return rescore.enrich(t.s_prospects, patch, found, facts(t), FIELD_SERVICE, HISTORY_AS_OF)


@query("d12c_merged_evidence", f"""
WITH {_FOUND} x AS (SELECT 1) SELECT id, prospect_id, label, evidence_text FROM found
""")
def d12c(t):
    return enriched(t).evidence.select("id", "prospect_id", "label", "evidence_text")


def acquired(t, mode: str, registry=None) -> acquire.Acquired:
    """An acquisition run over the stored tables."""
    return acquire.acquire(mode, t.s_prospects, facts(t), FIELD_SERVICE, AWARDS_AS_OF, t.s_awards, t.s_registry if registry is None else registry, days=400)


_BOTH = f"""
{LABELLED}, {_DISCOVERED},
kept AS (SELECT *, siren IN (SELECT value_normalized FROM s_suppression WHERE kind = 'siren') AS blocked,
  siren IN (SELECT siren FROM s_prospects) OR siren IN (SELECT siren FROM labelled WHERE outcome = 'created') AS known FROM found),
per_source AS (
  SELECT 'decp' AS source, sum(n) AS awards, count(*) AS companies, count(*) FILTER (outcome = 'created') AS created, count(*) FILTER (outcome = 'updated') AS updated,
    count(*) FILTER (outcome = 'skipped') AS skipped FROM labelled
  UNION ALL SELECT 'registry', 0, count(*), count(*) FILTER (NOT blocked AND NOT known), count(*) FILTER (NOT blocked AND known), count(*) FILTER (blocked) FROM kept)
"""


@query("s13b_acquisition_run", f"""
WITH {_BOTH}
SELECT 'full' AS adapter, 'completed' AS status, source, awards, companies, created, updated, skipped, 0 AS errors FROM per_source
UNION ALL SELECT 'full', 'completed', 'total', sum(awards), sum(companies), sum(created), sum(updated), sum(skipped), 0 FROM per_source
UNION ALL SELECT 'registry', 'failed', 'total', 0, 0, 0, 0, 0, 0
""", whole="awards companies created updated skipped errors")
def s13b(t):
    broken = t.s_registry.drop("siren")
    runs = acquired(t, "full").run.unionByName(acquired(t, "registry", broken).run)
    return runs.select("adapter", "status", F.inline("stats"))


@query("d15d_acquired_events", f"""
WITH {_BOTH}
SELECT event_type, notes, n FROM (
  SELECT 'New' AS event_type, 'Discovered via ' || source || ' acquisition engine' AS notes, created AS n FROM per_source) x WHERE n > 0
""", whole="n")
def d15d(t):
    return acquired(t, "full").events.groupBy("event_type", "notes").agg(F.count(F.lit(1)).alias("n"))


@query("u5c_snapshot_merges", """
SELECT id, CASE WHEN id % 50 = 7 THEN 'Nantes' WHEN id % 40 = 3 THEN 'Brest' ELSE city END AS city, CASE WHEN id % 50 = 7 THEN 3 WHEN id % 40 = 3 THEN 2 ELSE 1 END AS written_by
FROM s_prospects WHERE id % 60 <> 11
""", whole="written_by")
def u5c(t):
    """Two merges into a stored snapshot; the second takes rows out too, and reads what the first one wrote."""
    from leadloom.session import shared_folder
    from leadloom.sources import snapshots

    path = shared_folder(t.spark, "prospect-snapshot")
    first = t.s_prospects.select("id", "company_name", "city").withColumn("written_by", F.lit(1))
    snapshots.create_table(first, path, "id", buckets=32)
    stored = snapshots.read_table(t.spark, path)
    change = lambda rows, city, number: rows.withColumns({"city": F.lit(city), "written_by": F.lit(number)})
    snapshots.merge_rows(path, change(stored.filter("id % 40 = 3"), "Brest", 2))
    stored = snapshots.read_table(t.spark, path)
    snapshots.merge_rows(path, change(stored.filter("id % 50 = 7 AND id % 60 <> 11"), "Nantes", 3), stored.filter("id % 60 = 11"))
    return snapshots.read_table(t.spark, path).select("id", "city", "written_by")


@query("d13b_waterfall_scored", f"""
WITH w AS ({D13}),
changed_rows AS (SELECT p.* REPLACE (w.contact_source AS contact_source, w.contact_confidence AS contact_confidence, 'guessed' AS contact_discovery_state, TRUE AS needs_manual_review) FROM s_prospects p JOIN w ON w.id = p.id),
{over_changed()}
SELECT w.id, s.email, s.contact_confidence, {RESULT} FROM s_prospects w JOIN scored s ON s.id = w.id
""", whole=WHOLE)
def d13b(t):
    return shown(rescore.apply_waterfall(t.s_prospects, waterfall(t), facts(t), FIELD_SERVICE, HISTORY_AS_OF), "email", "contact_confidence")
