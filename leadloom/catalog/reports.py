"""Reports and files written and read again, files with differing headers, payloads of registers."""

from pyspark.sql import functions as F

from leadloom.catalog import query
from leadloom.catalog.gates import fingerprint_sql
from leadloom.catalog.scans import LAST_EVENT, registry_payloads
from leadloom.frames import top_per
from leadloom.operators.activity import current_status
from leadloom.operators.awards import newest_first
from leadloom.operators.evidence import normalize_signals
from leadloom.plays import FIELD_SERVICE
from leadloom.session import cut_lineage, shared_folder
from leadloom.sources import adapters, awards, csv_lists, pages, registry, sinks
from leadloom.standins import EVENTS_AS_OF

_LINE = "unnest(list_transform(range(1, len(lines) + 1), lambda k: {'position': lpad(CAST(k - 1 AS VARCHAR), 9, '0'), 'line': lines[k]})) AS l"


@query("s12_dossiers", f"""
WITH last AS ({LAST_EVENT}),
sig AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prospect_id, fingerprint ORDER BY id) AS copy FROM (SELECT *, {fingerprint_sql()} AS fingerprint FROM s_evidence WHERE is_active) a) b WHERE copy = 1),
aw AS (SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY date DESC NULLS LAST, id, objet, montant NULLS FIRST) AS n FROM s_award_rows),
children AS (
  SELECT prospect_id, 3 AS section, lpad(CAST(n AS VARCHAR), 9, '0') AS position, '- **' || coalesce(date, '—') || '**: ' || coalesce(objet, 'Award') || ' (Value: ' || coalesce(montant, '—') || ')' AS line FROM aw
  UNION ALL SELECT prospect_id, 6, CASE WHEN is_primary_candidate THEN '0' ELSE '1' END || '|' || lpad(CAST(999999999 - coalesce(buyer_role_score, 0) AS VARCHAR), 9, '0') || '|' || lpad(CAST(id AS VARCHAR), 19, '0'),
    '- **' || full_name || '** (' || coalesce(nullif(job_title, ''), 'Unknown role') || ') - Confidence: ' || coalesce(CAST(identity_confidence AS VARCHAR), 'None') || '/100' FROM s_people
  UNION ALL SELECT prospect_id, 8, CASE WHEN is_primary THEN '0' ELSE '1' END || '|' || lpad(CAST(999999999 - coalesce(confidence_score, 0) AS VARCHAR), 9, '0') || '|' || lpad(CAST(id AS VARCHAR), 19, '0'),
    '- **' || coalesce(value_display, value_normalized) || '** (' || replace(kind, '_', ' ') || ') - Deliverability: ' || coalesce(deliverability_state, 'None') || ' - Utility: ' || replace(coalesce(utility_state, 'None'), '_', ' ') FROM s_points
  UNION ALL SELECT prospect_id, 11, lpad(CAST(id AS VARCHAR), 19, '0'), '- **[' || coalesce(category, 'None') || '] ' || coalesce(label, '') || '**: ' || coalesce(evidence_text, '') || ' (Strength: ' || coalesce(CAST(strength AS VARCHAR), 'None') || '/100)' FROM sig),
p AS (SELECT p.*, coalesce(l.event_type, 'New') AS current_status, p.id IN (SELECT prospect_id FROM s_award_rows) AS ha, p.id IN (SELECT prospect_id FROM s_people) AS hp, p.id IN (SELECT prospect_id FROM s_points) AS ho,
    p.id IN (SELECT prospect_id FROM sig) AS he, coalesce(p.notes, '') <> '' OR coalesce(signal_details, '') <> '' AS hn,
    coalesce(suspected_pain, '') <> '' OR coalesce(why_now, '') <> '' OR coalesce(recommended_offer, '') <> '' AS hs FROM s_prospects p LEFT JOIN last l ON l.prospect_id = p.id),
own AS (
  SELECT id, 1 AS section, ['# Intelligence Report: ' || company_name, chr(10) || '**Generated on:** {EVENTS_AS_OF} 00:00:00 UTC',
    '**Priority:** ' || coalesce(priority_level, 'None') || ' | **Urgency:** ' || coalesce(CAST(urgency_score AS VARCHAR), 'None') || ' | **Opportunity:** ' || coalesce(CAST(opportunity_score AS VARCHAR), 'None'),
    '**Status:** ' || current_status || ' | **Signal:** ' || coalesce(signal_type, 'None'), chr(10) || '## Company Profile', '- **Sector:** ' || coalesce(sector, 'None'), '- **Size:** ' || coalesce(company_size, 'None'),
    '- **SIREN:** ' || siren, '- **SIRET:** ' || siret, '- **NAF:** ' || naf_code, '- **Website:** ' || website] AS lines FROM p
  UNION ALL SELECT id, 2, [CASE WHEN ha THEN chr(10) || '## Award History' END] FROM p
  UNION ALL SELECT id, 4, [chr(10) || '## Contact Intelligence'] FROM p
  UNION ALL SELECT id, 5, [CASE WHEN hp THEN '### Key People' ELSE '*No specific people identified.*' END] FROM p
  UNION ALL SELECT id, 7, [CASE WHEN ho THEN chr(10) || '### Contact Paths' ELSE '*No reliable contact paths discovered.*' END] FROM p
  UNION ALL SELECT id, 9, [chr(10) || '## Evidence & Triggers'] FROM p
  UNION ALL SELECT id, 10, [CASE WHEN NOT he THEN '*No direct evidence logged.*' END] FROM p
  UNION ALL SELECT id, 12, [CASE WHEN hn THEN chr(10) || '## Notes & Signal Details' END, '**Signal Details:**' || chr(10) || nullif(signal_details, '') || chr(10), '**Notes:**' || chr(10) || nullif(notes, '') || chr(10),
    CASE WHEN hs THEN chr(10) || '## Commercial Strategy' END, CASE WHEN hs THEN '**Why Now (Trigger):**' || chr(10) || nullif(why_now, '') || chr(10) END, CASE WHEN hs THEN '**Suspected Pain:**' || chr(10) || nullif(suspected_pain, '') || chr(10) END,
    CASE WHEN hs THEN '**Target Role:**' || chr(10) || nullif(recommended_buyer_role, '') || chr(10) END, CASE WHEN hs THEN '**Recommended Offer:**' || chr(10) || nullif(recommended_offer, '') || chr(10) END] FROM p),
own_lines AS (SELECT id, section, {_LINE} FROM own)
SELECT id AS prospect_id, section, l.position AS position, l.line AS line FROM own_lines WHERE l.line IS NOT NULL
UNION ALL SELECT prospect_id, section, position, line FROM children
""", whole="section")
def s12(t):
    return dossiers(t)


def dossiers(t):
    won = top_per(t.s_award_rows, ["prospect_id"], newest_first(), None, rank="position")
    return sinks.dossier_lines(
        current_status(t.s_prospects, t.s_events), won, t.s_people, t.s_points, normalize_signals(t.s_evidence), f"{EVENTS_AS_OF} 00:00:00", stage=cut_lineage
    )


@query("s12b_dossier_files", f"""
SELECT prospect_id, CASE WHEN prospect_id IN (SELECT prospect_id FROM s_people) THEN 'known' ELSE 'unknown' END AS people, 1 AS files FROM (SELECT id AS prospect_id FROM s_prospects) x
""", whole="files")
def s12b(t):
    """Reports written as text files and read again: each in one file, its lines in order."""
    path = shared_folder(t.spark, "dossiers")
    lines = dossiers(t).withColumn("line", F.concat_ws("\t", "prospect_id", "section", F.regexp_replace("line", "\n", " ")))
    sinks.write_dossiers(lines, path, per_file=5000)
    parts = F.split("value", "\t")
    read = t.spark.read.text(path).select(parts[0].cast("long").alias("prospect_id"), parts[1].cast("int").alias("section"), parts[2].alias("line"), F.input_file_name().alias("file"))
    heads = read.filter("section = 5").select("prospect_id", F.when(F.col("line") == "### Key People", "known").otherwise("unknown").alias("people"))
    return heads.join(read.groupBy("prospect_id").agg(F.countDistinct("file").alias("files")), "prospect_id")


@query("s11b_export_file", """
SELECT id, company_name, coalesce(notes, '') AS notes, urgency_score FROM s_prospects WHERE NOT opted_out
""", whole="id urgency_score")
def s11b(t):
    """The export written as CSV files and read again with its header."""
    path = shared_folder(t.spark, "export")
    sinks.write_csv(sinks.export_rows(t.s_prospects, t.s_events), path, per_file=500)
    read = t.spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return read.select(F.col("id").cast("long"), "company_name", F.coalesce("notes", F.lit("")).alias("notes"), F.col("urgency_score").cast("long"))


@query("s1b_award_files", """
SELECT id, dateAttribution, codeCPV, objetMarche, titulaire_siret, montant FROM s_awards WHERE dateAttribution >= '1996-07-01'
""")
def s1b(t):
    """Two deliveries with other headers, types and orders of columns, and one column only one of them has."""
    path = shared_folder(t.spark, "deliveries")
    other = F.xxhash64("id") % 2 == 0
    first = t.s_awards.filter(other).toDF("uid", "dateNotification", "CPV", "Objet", "idTitulaire", "nomTitulaire", "amount", "acheteurNom")
    second = t.s_awards.filter(~other).select(
        "montant", F.col("objetMarche").alias("objet"), F.col("dateAttribution").cast("date").alias("dateNotification"), "id", "codeCPV", F.col("titulaire_siret").alias("idTitulaire")
    )
    first.write.parquet(f"{path}/a")
    second.write.parquet(f"{path}/b")
    rows = awards.read_awards(t.spark, path, since="1996-07-01")
    return rows.select("id", "dateAttribution", "codeCPV", "objetMarche", "titulaire_siret", "montant").filter("dateAttribution >= '1996-07-01'")


@query("s5b_registry_files", """
SELECT siren, coalesce(nullif(CASE WHEN sighting % 7 <> 0 THEN company_name END, ''), 'RAISON') AS company_name, count(*) AS n FROM s_registry GROUP BY 1, 2
""", whole="n")
def s5b(t):
    """The register's JSON files, read with its schema."""
    path = shared_folder(t.spark, "register")
    registry_payloads(t).drop("sighting").write.json(path)
    rows = registry.normalize_registry(registry.read_registry(t.spark, path), FIELD_SERVICE)
    return rows.groupBy("siren", "company_name").agg(F.count(F.lit(1)).alias("n"))


@query("s3b_csv_import", """
SELECT 'k' || CAST(id AS VARCHAR) AS linkedin_url, company_name, CASE WHEN id % 10 = 0 THEN 'rejected' ELSE 'good' END AS outcome FROM s_prospects WHERE id % 10 <> 0
UNION ALL SELECT NULL, NULL, 'rejected' FROM s_prospects WHERE id % 10 = 0
""")
def s3b(t):
    """Lists written as CSV files, texts with quotes and commas among them, and imported from there."""
    path = shared_folder(t.spark, "lists")
    k = F.col("id")
    rows = t.s_prospects.select(
        F.when(k % 10 != 0, F.col("company_name")).alias("Company Name"), F.lit("Field Services").alias("Sector"), F.lit("11-50").alias("company_size"),
        F.lit("DECP_WIN").alias("signal_type"), F.lit("import, \"list\"").alias("data_source"), F.lit("Manual").alias("source"), F.concat(F.lit("k"), k.cast("string")).alias("linkedin_url"),
    )
    rows.repartition(3, "linkedin_url").write.option("header", True).option("escape", '"').csv(path)
    good, rejected = csv_lists.import_csv(t.spark, path)
    none = F.lit(None).cast("string")
    return good.select("linkedin_url", "company_name", F.lit("good").alias("outcome")).unionByName(rejected.select(none.alias("linkedin_url"), none.alias("company_name"), F.lit("rejected").alias("outcome")))


@query("s14b_page_files", """
SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www[.]', '') AS host, sha256(html) AS content_hash FROM pages WHERE page_id % 9 <> 4 AND page_id % 11 NOT IN (3, 5)
""")
def s14b(t):
    """Crawled pages with status and type, read from files."""
    path = shared_folder(t.spark, "crawl")
    k = F.col("page_id")
    kind = F.when(k % 11 == 3, "application/pdf").when(k % 11 == 5, F.lit(None)).when(k % 2 == 0, "Text/HTML; charset=utf-8").otherwise("application/xhtml+xml")
    t.pages.withColumns({"status": F.when(k % 9 == 4, 404).otherwise(200), "content_type": kind}).write.parquet(path)
    return pages.read_pages(t.spark, path).select("page_id", "host", "content_hash")


def establishment_texts(t):
    """Establishments and legal units as JSON texts; every second establishment lacks its unit."""
    k = F.col("c_custkey")
    siren = F.lpad(k.cast("string"), 9, "0")
    unit = F.struct(F.lit("O").alias("statutDiffusionUniteLegale"), F.concat(F.lit("Propre "), k).alias("denominationUniteLegale"), F.lit("43.22B").alias("activitePrincipaleUniteLegale"))
    period = F.struct(F.when(k % 3 == 0, "Enseigne").alias("denominationUsuelleEtablissement"), k.alias("unknownField"))
    own = F.struct(
        F.concat(siren, F.lit("00012")).alias("siret"), F.when(k % 2 == 0, unit).alias("uniteLegale"), F.array(period).alias("periodesEtablissement"),
        F.when(k % 4 == 0, "21").alias("trancheEffectifsEtablissement"),
    )
    newest = F.struct(
        F.when(k % 7 == 1, "P").alias("statutDiffusionUniteLegale"), F.concat(F.lit("Parent "), k).alias("denominationUniteLegale"), F.lit("62.01Z").alias("activitePrincipaleUniteLegale"),
        F.lit("42").alias("trancheEffectifsUniteLegale"),
    )
    parent = F.struct(siren.alias("siren"), F.array(newest).alias("periodesUniteLegale"))
    broken = t.customer.limit(1).select(F.lit("{no json").alias("payload"))
    texts = lambda value: t.customer.select(F.to_json(value).alias("payload"))
    return texts(own).unionByName(broken), texts(parent)


@query("s6b_establishments_of_units", """
SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS siren, lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '00012' AS siret,
  CASE WHEN c_custkey % 3 = 0 THEN 'Enseigne' WHEN c_custkey % 2 = 0 THEN 'Propre ' || CAST(c_custkey AS VARCHAR) ELSE 'Parent ' || CAST(c_custkey AS VARCHAR) END AS company_name,
  CASE WHEN c_custkey % 2 = 0 THEN '4322B' ELSE '6201Z' END AS naf_code, CASE WHEN c_custkey % 4 = 0 THEN '11-50' ELSE '200+' END AS company_size
FROM customer WHERE NOT (c_custkey % 2 = 1 AND c_custkey % 7 = 1)
""")
def s6b(t):
    own, parents = establishment_texts(t)
    rows = registry.from_payload(own, registry.ESTABLISHMENT_SCHEMA).filter(F.col("siret").isNotNull())
    joined = registry.with_legal_units(rows, registry.from_payload(parents, registry.UNIT_SCHEMA))
    return registry.normalize_sirene(joined).select("siren", "siret", "company_name", "naf_code", "company_size")


@query("s6c_legal_units", """
SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS siren, 'Parent ' || CAST(c_custkey AS VARCHAR) AS company_name, '6201Z' AS naf_code, '200+' AS company_size, 'diffusible' AS diffusion_status
FROM customer WHERE c_custkey % 7 <> 1
""")
def s6c(t):
    units = registry.from_payload(establishment_texts(t)[1], registry.UNIT_SCHEMA)
    return registry.normalize_legal_units(units).select("siren", "company_name", "naf_code", "company_size", "diffusion_status")


@query("s9b_envelope_values", "SELECT CAST(c_custkey AS VARCHAR) AS external_id, c_acctbal, c_mktsegment, CAST(c_nationkey AS BIGINT) AS nation FROM customer")
def s9b(t):
    """Values out of the stored envelopes."""
    records = adapters.to_source_records(t.customer, "manual", "c_custkey")
    value = adapters.payload_value
    return records.select("external_id", value("$.c_acctbal", "double").alias("c_acctbal"), value("$.c_mktsegment", "string").alias("c_mktsegment"), value("$.c_nationkey", "bigint").alias("nation"))
