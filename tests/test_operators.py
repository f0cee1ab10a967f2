"""Idempotency, skew, line numbers, pages and streams on small cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from leadloom.operators import awards, contacts, evidence, pages
from leadloom.plans import ingest
from leadloom.plays import FIELD_SERVICE
from leadloom.sources import csv_lists
from leadloom.sources.awards import normalise_awards
from leadloom.sources.pages import accept_pages, parse_pages
from leadloom.standins import Tables
from leadloom.streaming import events as streams

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def t(spark):
    return Tables(spark, FOLDER)


def test_award_filter_and_grouping(spark):
    rows = [
        ("m1", "2026-01-05", "50710000", "Contrat maintenance froid", "12345678900012", "FroidPro", 80000.0, "Région"),
        ("m2", "2026-01-04", "45331000", "Installation clim", "12345678900012", "FroidPro", 20000.0, "Ville"),
        ("m3", "2026-01-05", "72000000", "Développement logiciel maintenance", "22345678900012", "Soft", 1.0, "Ville"),
        ("m4", "2025-06-01", "50710000", "Contrat maintenance", "32345678900012", "Vieux", 1.0, "Ville"),
    ]
    raw = spark.createDataFrame(rows, "id string, dateAttribution string, cpv string, objet string, titulaire_siret string, titulaire_nom string, montant double, acheteur string")
    kept = awards.filter_relevant(normalise_awards(raw), FIELD_SERVICE, "2026-01-10", days=90)
    assert sorted(r["id"] for r in kept.collect()) == ["m1", "m2"]
    holder = awards.aggregate_by_holder(kept).first()
    assert holder["award_count"] == 2 and holder["has_multiple"] and holder["total_cents"] == 10_000_000
    assert holder["signal_details"] == "2 award(s) · total≈100000€ · multiple wins"
    assert [a["id"] for a in holder["award_history"]] == ["m1", "m2"]


def test_a_hot_holder_is_cut_before_the_shuffle(spark, t):
    """One holder with a third of all rows: sums cover every row, ranking is limited on the map side."""
    hot = spark.range(30_000).select(
        F.concat(F.lit("h"), F.col("id").cast("string")).alias("id"), F.lit("2001-10-01").alias("dateAttribution"), F.lit("50710000").alias("codeCPV"),
        F.lit("Contrat maintenance").alias("objetMarche"), F.lit("99999999900001").alias("titulaire_siret"), F.lit("Hot").alias("titulaire_nom"),
        F.lit(1.0).alias("montant"), F.lit("x").alias("acheteur_nom"),
    )
    relevant = awards.filter_relevant(t.s_awards.unionByName(hot), FIELD_SERVICE, "2001-11-04", days=400)
    holders = awards.aggregate_by_holder(relevant)
    plan = holders._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan
    row = holders.filter("holder_key = '99999999900001'").first()
    assert row["award_count"] == 30_000 and row["total_cents"] == 3_000_000 and len(row["award_history"]) == 3
    assert awards.holder_history(relevant).filter("holder_key = '99999999900001'").agg(F.max("position")).first()[0] == 30_000


def test_ingest_keeps_every_award_of_a_holder(spark, t):
    hot = spark.range(120).select(
        F.concat(F.lit("h"), F.col("id").cast("string")).alias("id"), F.lit("2001-10-01").alias("dateAttribution"), F.lit("50710000").alias("codeCPV"),
        F.lit("Contrat maintenance").alias("objetMarche"), F.lit("99999999900001").alias("titulaire_siret"), F.lit("Hot").alias("titulaire_nom"),
        F.lit(1.0).alias("montant"), F.lit("x").alias("acheteur_nom"),
    )
    job = ingest.ingest_awards(
        t.s_awards.unionByName(hot), t.s_prospects, t.s_award_rows, t.s_evidence, t.s_suppression, FIELD_SERVICE, "2001-11-04", days=400
    )
    target = job.outcomes.filter("holder_key = '99999999900001'").first()["target_id"]
    rows = job.awards.filter((F.col("prospect_id") == target) & F.col("is_new")).collect()
    assert job.awards.filter("montant = 'n.c.'").count() == t.s_award_rows.filter("montant = 'n.c.'").count() > 0
    assert {r["id"] for r in rows} == {f"h{k}" for k in range(120)} and sorted(r["position"] for r in rows) == list(range(1, 121))


def test_evidence_upsert_twice_adds_nothing(t):
    old = t.s_evidence.filter("id % 2 = 0").withColumn("fingerprint", F.lit(None).cast("string"))
    new = t.s_evidence.filter("id % 2 = 1")
    added = evidence.upsert_evidence(old, new, per_call=None)
    assert added.count() > 0
    again = evidence.upsert_evidence(old.unionByName(added, allowMissingColumns=True), new, per_call=None)
    assert again.count() == 0


def test_people_and_point_merges_are_idempotent(t):
    once_people = contacts.merge_people(t.s_people, t.s_person_facts)
    twice_people = contacts.merge_people(once_people.select(*t.s_people.columns), t.s_person_facts)
    assert twice_people.filter("is_new").count() == 0
    columns = ("id", "buyer_role_score", "identity_confidence", "linkedin_url")
    assert sorted(map(str, once_people.select(*columns).collect())) == sorted(map(str, twice_people.select(*columns).collect()))
    prepared = contacts.prepare_points(t.s_point_facts, t.s_prospects, t.s_suppression)
    once_points = contacts.merge_points(t.s_points, prepared)
    twice_points = contacts.merge_points(once_points.select(*t.s_points.columns), prepared)
    assert twice_points.filter("is_new").count() == 0
    assert once_points.count() == twice_points.count()


def test_a_confirmed_person_keeps_its_title(spark, t):
    schema = t.s_people.schema
    old = spark.createDataFrame([(1, 5, "Jean Martin", "jean martin", "gerant", "owner", None, None, "Gérant", 10, "exact", 100, None, True, True, True)], schema)
    facts = spark.createDataFrame([(1, 5, "Jean Martin", "Gérant", 99, "strong", 90, "u", None, None)], t.s_person_facts.schema)
    row = contacts.merge_people(old, facts).first()
    assert row["buyer_role_score"] == 10 and row["identity_confidence"] == 100 and row["linkedin_url"] is None and row["seen"]


def test_learned_patterns_and_candidates(spark):
    pairs = spark.createDataFrame(
        [("acme.fr", "alice.martin@acme.fr", "Alice Martin"), ("acme.fr", "jean.dupont@acme.fr", "Jean Dupont"), ("acme.fr", "luc.robert@acme.fr", "Luc Robert"),
         ("acme.fr", "contact@acme.fr", "Contact Acme")],
        "domain string, email string, person_name string",
    )
    patterns = contacts.learn_patterns(pairs)
    assert [(r["pattern"], r["strength"]) for r in patterns.collect()] == [("firstname.lastname", "strong")]
    people = spark.createDataFrame([(1, "Marie Durand", "acme.fr"), (2, "Marie Durand", "other.fr")], "prospect_id long, full_name string, domain string")
    rows = {r["email"]: r["person_match_state"] for r in contacts.pattern_candidates(people, patterns).collect()}
    assert rows == {"marie.durand@acme.fr": "exact_person_pattern_confirmed", "marie.durand@other.fr": "name_only_guess", "m.durand@other.fr": "name_only_guess"}


def test_line_numbers_and_csv_errors(spark, tmp_path):
    header = "Company Name,sector,company_size,signal_type,data_source,source,notes\n"
    good = "Froid Pro,Field Services,11-50,OTHER,List,Manual,\"two\nlines\"\n"
    (tmp_path / "a.csv").write_text(header + good + "Bad Co,Nope,11-50,OTHER,List,Manual,\n" + good)
    (tmp_path / "b.csv").write_text(header + ",Field Services,11-50,OTHER,List,Manual,\n")
    valid, rejected = csv_lists.import_csv(spark, str(tmp_path), multi_line=True)
    assert valid.count() == 2
    errors = sorted((r["row"], r["errors"]) for r in rejected.collect())
    assert errors[0] == (2, ["company_name: Field required"])
    assert errors[1][0] == 3 and errors[1][1][0].startswith("sector: Value error")


def test_line_numbers_across_blocks(spark, tmp_path):
    for name, n in (("a", 900), ("b", 400)):
        (tmp_path / f"{name}.csv").write_text("company,n\n" + "".join(f"{name}{i},{i + 2}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        rows = csv_lists.with_line_numbers(csv_lists.read_csv(spark, str(tmp_path)))
        assert csv_lists.read_csv(spark, str(tmp_path)).rdd.getNumPartitions() > 3
        assert rows.count() == 1300 and rows.filter("row <> cast(n AS long)").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


PAGES = [
    (1, "https://acme.fr/equipe", '<html><head><title>Équipe</title></head><body><h2>Alice Martin</h2><p>Directrice des opérations</p>'
        '<a href="mailto:alice.martin@acme.fr">Email</a><p>autre@other.fr</p><script type="application/ld+json">{"@type":"Person","name":"Alice Martin",'
        '"jobTitle":"Directrice des opérations","sameAs":"https://www.linkedin.com/in/alice"}</script></body></html>'),
    (2, "https://www.acme.fr/contact", '<title>Contact</title><p>contact@acme.fr</p><p>01 44 55 66 77</p><form action="/devis"><input name="email">'
        '<div class="g-recaptcha"></div></form><script>var x = "hidden@acme.fr"</script>'),
    (3, "https://acme.fr/broken", "<html><head><title>Équipe<body><div><h2>Jean Dupont<p>Responsable exploitation<a href='mailto:x@acme.fr'>contact"),
]


def test_page_facts(spark):
    parsed = parse_pages(accept_pages(spark.createDataFrame(PAGES, "page_id long, url string, html string"))).cache()
    found = {(r["page_id"], r["kind"], r["value"]): r for r in pages.contact_facts(parsed).collect()}
    assert found[1, "email", "alice.martin@acme.fr"]["publication_state"] == "published_personal"
    assert found[2, "email", "contact@acme.fr"]["publication_state"] == "published_generic"
    assert found[2, "phone", "+33144556677"]["confidence"] == 75
    assert found[2, "contact_form", "https://www.acme.fr/devis"]["detail"] == "sales_quote|true|email"
    assert found[1, "linkedin", "https://www.linkedin.com/in/alice"]["source_class"] == "structured_data"
    assert not any("other.fr" in value or "hidden" in value for _, _, value in found)
    people = pages.people_facts(parsed).collect()
    alice = [p for p in people if p["full_name"] == "Alice Martin"]
    assert len(alice) == 1 and alice[0]["identity_confidence"] == 90 and alice[0]["linkedin_url"].endswith("/alice")
    facts = pages.evidence_facts(pages.contact_facts(parsed), pages.people_facts(parsed)).collect()
    assert any(f["excerpt"] == "a***@acme.fr" for f in facts)


def test_forms_of_long_pages(spark):
    fields = "".join(f'<input name="f{k}">' for k in range(50))
    html = f'<title>Page</title><p>{"mot " * 400}</p><p>Demande de prix</p><form action="/envoi">{fields}</form>'
    parsed = parse_pages(accept_pages(spark.createDataFrame([(1, "https://acme.fr/page", html)], "page_id long, url string, html string")))
    form = pages.contact_facts(parsed).filter("kind = 'contact_form'").first()
    assert form["detail"] == "sales_quote|false|" + ",".join(f"f{k}" for k in range(50))


def test_stop_stream_tells_once(spark, tmp_path):
    schema = "id long, prospect_id long, event_type string, event_date timestamp_ntz"
    day = lambda d: datetime(2024, 1, d)
    source, out = str(tmp_path / "in"), []
    (tmp_path / "in").mkdir()
    stream = streams.stop_stream(spark.readStream.schema(schema).parquet(source))
    batches = [[(1, 1, "Sent", day(1)), (2, 2, "OptOut", day(1))], [(3, 1, "Replied", day(2)), (4, 2, "Replied", day(3))]]
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        collect = lambda df, _: out.extend(map(tuple, df.collect()))
        query = stream.writeStream.foreachBatch(collect).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(out) == [(1, "prospect_replied"), (2, "opt_out_requested")]
