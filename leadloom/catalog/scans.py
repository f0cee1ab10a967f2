"""Sources and sinks."""

from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.catalog import query, sql_list
from leadloom.operators import pages as page_ops
from leadloom.operators.compliance import mark_suppressed
from leadloom.operators.identity import upsert_outcomes
from leadloom.plays import FIELD_SERVICE
from leadloom.sources import adapters, awards, csv_lists, pages, registry, sinks
from leadloom.standins import AWARDS_AS_OF, EVENTS_AS_OF


@query("s1_award_scan", """
SELECT id, dateAttribution, codeCPV, objetMarche, titulaire_siret, titulaire_nom, montant, acheteur_nom FROM s_awards
""")
def s1(t):
    raw = t.s_awards.toDF("uid", "dateNotification", "CPV", "Objet", "idTitulaire", "nomTitulaire", "amount", "acheteurNom")
    return awards.normalise_awards(raw)


_DATE_FORMS = """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN substring(CAST(o_orderdate AS STRING), 1, 10)
  WHEN 1 THEN substring(CAST(o_orderdate AS STRING), 1, 10) || 'T10:11:12' WHEN 2 THEN substring(CAST(o_orderdate AS STRING), 1, 10) || ' 08:00:00'
  WHEN 3 THEN '31/12/1999' WHEN 4 THEN substring(CAST(o_orderdate AS STRING), 1, 8) || '99' ELSE NULL END AS raw FROM """


@query("s2_award_dates", f"""
SELECT o_orderkey, raw, strftime(TRY_CAST(CASE WHEN o_orderkey % 6 < 3 OR o_orderkey % 6 = 4 THEN raw END AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS parsed
FROM ({_DATE_FORMS} orders) x
""")
def s2(t):
    raw = t.spark.sql(_DATE_FORMS + "{orders}", orders=t.orders)
    return raw.withColumn("parsed", F.date_format(awards.parse_award_date(F.col("raw")), "yyyy-MM-dd HH:mm:ss"))


@query("s3_csv_validation", f"""
WITH raw AS (
  SELECT id AS line, CASE WHEN id % 10 <> 0 THEN company_name END AS company_name, CASE WHEN id % 7 = 0 THEN 'Nope' ELSE sector END AS sector,
         company_size, signal_type, data_source, source, CASE WHEN id % 13 = 0 THEN repeat('x', 51) ELSE phone END AS phone FROM s_prospects)
SELECT line, concat_ws('; ',
  CASE WHEN company_name IS NULL THEN 'company_name: Field required' END,
  CASE WHEN data_source IS NULL THEN 'data_source: Field required' END,
  CASE WHEN length(phone) > 50 THEN 'phone: String should have at most 50 characters' END,
  CASE WHEN sector NOT IN ({sql_list(fixed.SECTORS)}) THEN 'sector: Value error, sector must be one of ({sql_list(fixed.SECTORS).replace("'", "''")})' END) AS problems
FROM raw
""")
def s3(t):
    p = t.s_prospects
    raw = p.select(
        F.col("id").alias("row"),
        F.when(F.col("id") % 10 != 0, F.col("company_name")).alias("Company Name"),
        F.when(F.col("id") % 7 == 0, "Nope").otherwise(F.col("sector")).alias("Sector"),
        F.col("company_size").alias(" company_size "), "signal_type", "data_source", "source",
        F.when(F.col("id") % 13 == 0, F.lit("x" * 51)).otherwise(F.col("phone")).alias("PHONE"),
    )
    return csv_lists.validate_rows(raw).select(F.col("row").alias("line"), F.array_join("errors", "; ").alias("problems"))


@query("s4_csv_adapter", """
SELECT CASE WHEN s_suppkey % 4 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE 'csv_' || CAST(s_suppkey + 2 AS VARCHAR) END AS external_id,
  CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'Imported Entity' END AS company_name,
  CASE WHEN s_suppkey % 2 = 0 THEN 'FR' ELSE 'GB' END AS country_code,
  CASE WHEN s_suppkey % 5 = 0 THEN 'companies_house_number' WHEN s_suppkey % 5 = 1 THEN 'siren' END AS identifier_scheme,
  CASE WHEN s_suppkey % 5 = 0 THEN 'N' || CAST(s_suppkey AS VARCHAR) WHEN s_suppkey % 5 = 1 THEN 'S' || CAST(s_suppkey AS VARCHAR) END AS identifier_value
FROM supplier
""")
def s4(t):
    k = F.col("s_suppkey")
    raw = t.supplier.select(
        F.when(k % 4 == 0, k.cast("string")).otherwise("").alias("id"),
        (k + 2).alias("row"),
        F.when(k % 3 == 0, F.col("s_name")).otherwise("").alias("Nom"),
        F.when(k % 2 == 0, "france").alias("Country"),
        F.when(k % 5 == 0, F.concat(F.lit("N"), k.cast("string"))).alias("Company Number".replace(" ", " ")),
        F.when(k % 5 == 1, F.concat(F.lit("S"), k.cast("string"))).alias("siren"),
    )
    # Ids that are company numbers come first as external ids, as the header order says.
    out = csv_lists.normalize_csv(raw.withColumnRenamed("Company Number", "companies_house_number"))
    return out.select("external_id", "company_name", "country_code", "identifier_scheme", "identifier_value")


def registry_payloads(t):
    """Registry sightings in the nested shape of the register's payloads."""
    k = F.col("sighting")
    officer = lambda family, given, role, kind: F.struct(
        F.lit(family).alias("nom"), F.lit(given).alias("prenoms"), F.lit(role).alias("qualite"), F.lit(kind).alias("type_dirigeant"),
        F.lit(None).cast("string").alias("denomination"),
    )
    auditor = officer("AUDIT", "ANNE", "Commissaire aux comptes titulaire", "personne physique")
    firm = officer("HOLDING", None, "Président", "personne morale")
    finance = officer("DURAND", "MARIE CLAIRE", "DAF", "personne physique")
    owner = officer("MARTIN", "jean-paul", "Gérant", "personne physique")
    officers = F.when(k % 4 == 0, F.array(auditor, firm, finance, owner)).when(k % 4 == 1, F.array(auditor, firm)).when(
        k % 4 == 2, F.array(finance)
    )
    siege = F.struct(
        "siret", F.lit("8121Z").alias("activite_principale"), F.when(k % 2 == 0, "21").alias("tranche_effectif_salarie"),
        F.when(k % 3 == 0, "LYON").alias("libelle_commune"), F.lit("69001").alias("commune"),
        F.when(k % 5 == 0, "").otherwise("971234").alias("departement"), F.lit("84").alias("region"),
        F.lit("1 rue X").alias("adresse"), F.lit(None).cast("string").alias("geo_adresse"),
    )
    return t.s_registry.select(
        "siren",
        F.when(k % 7 != 0, F.col("company_name")).alias("nom_complet"),
        F.lit("RAISON").alias("nom_raison_sociale"),
        F.lit(None).cast("string").alias("sigle"),
        F.col("naf_code").alias("activite_principale"),
        F.when(k % 3 == 0, "31").alias("tranche_effectif_salarie"),
        F.col("establishments").alias("nombre_etablissements_ouverts"),
        siege.alias("siege"),
        officers.alias("dirigeants"),
        "sighting",
    )


@query("s5_registry_payloads", """
WITH r AS (SELECT sighting AS k, *, coalesce(naf_code, '8121Z') AS naf FROM s_registry)
SELECT k AS sighting, siren, siret, CASE WHEN k % 7 <> 0 THEN company_name ELSE 'RAISON' END AS company_name, naf AS naf_code,
  CASE naf WHEN '4322B' THEN 'Field Services' WHEN '6201Z' THEN 'IT / Digital' WHEN '8110Z' THEN 'Facilities / Maintenance'
    WHEN '8121Z' THEN 'Facilities / Maintenance' WHEN '7112B' THEN 'Field Services' WHEN '3312Z' THEN 'Field Services'
    WHEN '4120A' THEN 'Construction' ELSE 'Other' END AS sector,
  CASE WHEN k % 3 = 0 THEN '51-200' WHEN k % 2 = 0 THEN '11-50' ELSE 'unknown' END AS company_size,
  CASE k % 4 WHEN 0 THEN 'Jean-paul Martin' WHEN 2 THEN 'Marie Claire Durand' END AS decision_maker_name,
  CASE k % 4 WHEN 0 THEN 'Gérant' WHEN 2 THEN 'DAF' END AS decision_maker_title,
  CASE WHEN k % 3 = 0 THEN 'LYON' ELSE '69001' END AS city, CASE WHEN k % 5 <> 0 THEN '971' END AS department
FROM r
""", whole="sighting")
def s5(t):
    out = registry.normalize_registry(registry_payloads(t), FIELD_SERVICE)
    return out.select("sighting", "siren", "siret", "company_name", "naf_code", "sector", "company_size", "decision_maker_name",
                      "decision_maker_title", "city", "department")


@query("s6_establishments", f"""
WITH e AS (SELECT c_custkey AS k, lpad(CAST(c_custkey AS VARCHAR), 14, '0') AS siret FROM customer)
SELECT substring(siret, 1, 9) AS siren, siret,
  CASE WHEN k % 3 = 0 THEN 'Enseigne' WHEN k % 3 = 1 THEN 'Denomination' ELSE 'Nom' END AS company_name,
  CASE WHEN k % 2 = 0 THEN '4322B' ELSE '6201Z' END AS naf_code, CASE WHEN k % 4 = 0 THEN '11-50' ELSE '200+' END AS company_size
FROM e WHERE k % 7 <> 1 AND k % 7 <> 2 AND k % 11 <> 3 AND k % 11 <> 4
""")
def s6(t):
    k = F.col("c_custkey")
    text = lambda value: F.lit(value).cast("string")
    unit = F.struct(
        F.when(k % 7 == 1, "P").otherwise("O").alias("statutDiffusionUniteLegale"),
        F.when(k % 3 == 1, "Denomination").alias("denominationUniteLegale"),
        F.lit("Nom").alias("nomUniteLegale"),
        text("Prenom").alias("prenom1UniteLegale"),
        F.lit("62.01Z").alias("activitePrincipaleUniteLegale"),
        F.lit("42").alias("trancheEffectifsUniteLegale"),
        F.when(k % 11 == 4, "C").otherwise("A").alias("etatAdministratifUniteLegale"),
        text(None).alias("siteWeb"),
    )
    period = F.struct(
        F.when(k % 11 == 3, "F").alias("etatAdministratifEtablissement"),
        F.when(k % 3 == 0, "Enseigne").alias("denominationUsuelleEtablissement"),
        F.when(k % 2 == 0, "43.22B").alias("activitePrincipaleEtablissement"),
        text(None).alias("trancheEffectifsEtablissement"),
    )
    raw = t.customer.select(
        F.lpad(k.cast("string"), 14, "0").alias("siret"),
        unit.alias("uniteLegale"),
        F.array(period).alias("periodesEtablissement"),
        text(None).alias("statutDiffusionUniteLegale"),
        F.when(k % 7 == 2, "diffusion PARTIELle").alias("statutDiffusionEtablissement"),
        text(None).alias("etatAdministratifEtablissement"),
        text("Autre").alias("denominationUsuelleEtablissement"),
        text(None).alias("activitePrincipaleEtablissement"),
        F.when(k % 4 == 0, "21").alias("trancheEffectifsEtablissement"),
        text(None).alias("siteWeb"),
    )
    return registry.normalize_sirene(raw).select("siren", "siret", "company_name", "naf_code", "company_size")


@query("s7_british_register", """
SELECT 'N' || CAST(s_suppkey AS VARCHAR) AS identifier_value,
  CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN 'Title' ELSE 'Unknown Legal Entity' END AS company_name,
  'GB' AS country_code, CASE WHEN s_suppkey % 2 = 0 THEN '43220' END AS classification_code, 'England' AS country
FROM supplier
""")
def s7(t):
    k = F.col("s_suppkey")
    raw = t.supplier.select(
        F.concat(F.lit("N"), k.cast("string")).alias("company_number"),
        F.when(k % 3 == 0, F.col("s_name")).alias("company_name"),
        F.when(k % 3 == 1, "Title").alias("title"),
        F.when(k % 2 == 0, F.array(F.lit("43220"), F.lit("43210"))).otherwise(F.array().cast("array<string>")).alias("sic_codes"),
        F.struct(
            F.lit("1 High St").alias("address_line_1"), F.lit("Leeds").alias("locality"), F.lit("LS1").alias("postal_code"),
            F.lit(None).cast("string").alias("country"),
        ).alias("registered_office_address"),
    )
    out = registry.normalize_companies_house(raw)
    return out.select("identifier_value", "company_name", "country_code", "classification_code", F.col("address.country").alias("country"))


@query("s8_observations", """
SELECT 'decp' AS connector_code, titulaire_nom AS company_name, 'FR' AS country_code, 'siren' AS identifier_scheme,
  substring(titulaire_siret, 1, 9) AS identifier_value, CAST(NULL AS VARCHAR) AS classification_code, CAST(NULL AS VARCHAR) AS officer_name FROM s_awards
UNION ALL
SELECT 'sirene', company_name, 'FR', 'siren', siren, naf_code, NULL FROM s_registry
UNION ALL
SELECT 'manual', canonical_name, country_code, NULL, NULL, NULL, 'Jean Martin' FROM s_companies
""")
def s8(t):
    won = t.s_awards.withColumn("titulaire_siren", F.substring("titulaire_siret", 1, 9))
    manual = t.s_companies.select(
        F.col("canonical_name").alias("company_name"), "country_code", F.lit("Jean Martin").alias("officer_name")
    )
    out = adapters.union_observations(
        adapters.NORMALISERS["decp"](won), adapters.NORMALISERS["sirene"](t.s_registry), adapters.NORMALISERS["manual"](manual)
    )
    return out.select("connector_code", "company_name", "country_code", "identifier_scheme", "identifier_value",
                      "classification_code", "officer_name")


@query("s9_source_records", """
SELECT 'manual' AS connector_code, CAST(c_custkey AS VARCHAR) AS external_id, 'company' AS record_type,
  sha256('{"c_acctbal":' || CAST(c_acctbal AS VARCHAR) || ',"c_custkey":' || CAST(c_custkey AS VARCHAR) || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name
    || '","c_nationkey":' || CAST(c_nationkey AS VARCHAR) || '}') AS payload_hash
FROM customer
""")
def s9(t):
    out = adapters.to_source_records(t.customer, "manual", "c_custkey")
    return out.select("connector_code", "external_id", "record_type", "payload_hash")


LAST_EVENT = """
SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY prospect_id ORDER BY event_date DESC, id DESC) AS rn FROM s_events e) z WHERE rn = 1
"""


@query("s11_prospect_export", f"""
WITH hits AS (
  SELECT p.id FROM s_prospects p JOIN s_suppression s ON (s.kind = 'email' AND s.value_normalized = lower(trim(p.email)))
    OR (s.kind = 'domain' AND s.value_normalized = lower(split_part(p.email, '@', 2))) OR (s.kind = 'siren' AND s.value_normalized = p.siren)),
last AS ({LAST_EVENT})
SELECT p.id, company_name, sector, company_size, signal_type, coalesce(signal_details, '') AS signal_details,
  coalesce(decision_maker_name, '') AS decision_maker_name, coalesce(decision_maker_title, '') AS decision_maker_title,
  coalesce(linkedin_url, '') AS linkedin_url, coalesce(email, '') AS email, coalesce(phone, '') AS phone, coalesce(website, '') AS website,
  data_source, source, urgency_score, priority_level, coalesce(l.event_type, 'New') AS current_status, opted_out,
  coalesce(p.notes, '') AS notes, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at
FROM s_prospects p LEFT JOIN last l ON l.prospect_id = p.id WHERE NOT opted_out AND p.id NOT IN (SELECT id FROM hits)
""", whole="urgency_score")
def s11(t):
    return sinks.export_rows(mark_suppressed(t.s_prospects, t.s_suppression), t.s_events)


def award_outcomes(t):
    """Upsert outcomes of all award holders, with their award counts."""
    from leadloom.operators.awards import aggregate_by_holder, filter_relevant

    holders = aggregate_by_holder(filter_relevant(t.s_awards, FIELD_SERVICE, AWARDS_AS_OF, 400))
    incoming = holders.withColumn("ord", F.col("holder_key"))
    blocked = t.s_suppression.filter(F.col("kind") == "siren")
    return upsert_outcomes(incoming, t.s_prospects, blocked)


RELEVANT = f"""
SELECT *, regexp_replace(titulaire_siret, '[^0-9]', '', 'g') AS holder_digits FROM s_awards
WHERE CAST(dateAttribution AS TIMESTAMP) >= TIMESTAMP '{AWARDS_AS_OF} 00:00:00' - INTERVAL '{{days}}' DAY
  AND (substring(codeCPV, 1, 2) IN ('45', '50') OR substring(codeCPV, 1, 3) IN ('397', '425', '713') OR substring(codeCPV, 1, 4) IN ('9091', '7999')
    OR regexp_matches(lower(objetMarche), 'maintenance|climatisation|clim|dépannage|technicien'))
  AND NOT regexp_matches(lower(objetMarche), 'développement logiciel|site web|marketing digital')
  AND length(regexp_replace(titulaire_siret, '[^0-9]', '', 'g')) >= 9
"""


LABELLED = f"""
relevant AS ({RELEVANT.replace("{days}", "400")}),
holders AS (SELECT CASE WHEN length(holder_digits) = 9 THEN holder_digits ELSE substring(holder_digits, 1, 14) END AS holder_key, count(*) AS n
  FROM relevant WHERE length(holder_digits) = 9 OR length(holder_digits) >= 14 GROUP BY 1),
ranked AS (SELECT *, substring(holder_key, 1, 9) AS siren, CASE WHEN length(holder_key) = 14 THEN holder_key END AS siret FROM holders),
known AS (SELECT * FROM s_prospects),
marked AS (SELECT r.*, r.siren IN (SELECT value_normalized FROM s_suppression WHERE kind = 'siren') AS blocked,
  coalesce((SELECT min(k.id) FROM known k WHERE k.siret = r.siret), (SELECT min(k.id) FROM known k WHERE k.siren = r.siren)) AS hit FROM ranked r),
labelled AS (SELECT *, CASE WHEN blocked THEN 'skipped' WHEN hit IS NOT NULL THEN 'updated'
  WHEN row_number() OVER (PARTITION BY siren, blocked, hit IS NULL ORDER BY holder_key) = 1 THEN 'created' ELSE 'updated' END AS outcome FROM marked)
"""


@query("s13_run_ledger", f"""
WITH {LABELLED}
SELECT 'decp' AS source, sum(n) AS awards, count(*) AS companies, count(*) FILTER (outcome = 'created') AS created,
  count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome = 'skipped') AS skipped, 0 AS errors FROM labelled
""", whole="awards companies created updated skipped errors")
def s13(t):
    return sinks.ledger(award_outcomes(t).withColumn("source", F.lit("decp")))


@query("s14_page_scan", """
SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www[.]', '') AS host, sha256(html) AS content_hash
FROM pages
""")
def s14(t):
    return pages.accept_pages(t.pages).select("page_id", "url", "host", "content_hash")


@query("s15_document_contacts")
def s15(t):
    points, _people = page_ops.document_contacts(t.s_doc_pages)
    return points.select("doc_id", "kind", "value", "publication_state", "confidence", "page_no")


@query("s15b_document_mailboxes", """
SELECT doc_id, arg_max('contact@c' || CAST(doc_id - doc_id % 3 AS VARCHAR) || '.example.fr', page_no) AS value, 'published_generic' AS publication_state, 72 AS confidence, max(page_no) AS page_no
FROM s_doc_pages WHERE contains(text, ' contact@c') GROUP BY 1
""", whole="confidence page_no")
def s15b(t):
    points, _people = page_ops.document_contacts(t.s_doc_pages)
    return points.filter("kind = 'email'").select("doc_id", "value", "publication_state", "confidence", "page_no")


@query("s15c_document_evidence", """
SELECT doc_id, page_no, 'published_email' AS evidence_type, 'official_pdf' AS source_adapter, 'contact@c' || CAST(doc_id - doc_id % 3 AS VARCHAR) || '.example.fr' AS contact_value, 'PDF page ' || CAST(page_no AS VARCHAR) AS page_title
FROM s_doc_pages WHERE contains(text, ' contact@c')
""", whole="page_no")
def s15c(t):
    found = page_ops.document_evidence(t.s_doc_pages).filter("evidence_type = 'published_email'")
    return found.select("doc_id", "page_no", "evidence_type", "source_adapter", "contact_value", "page_title")
