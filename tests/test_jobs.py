"""Jobs that write: scores of changed rows, acquisition runs, snapshot tables."""

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from leadloom.catalog import rescored
from leadloom.functions.text import contact_fingerprint
from leadloom.operators import contacts
from leadloom.plans import acquire, discover, recompute, rescore
from leadloom.plays import FIELD_SERVICE
from leadloom.session import cut_lineage
from leadloom.sources import snapshots
from leadloom.standins import AWARDS_AS_OF, EVENTS_AS_OF, HISTORY_AS_OF, Tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, FOLDER)


def test_rescore_equals_recompute_and_leaves_the_others(spark, t):
    changed = t.s_prospects.filter("id % 7 = 2 AND NOT anonymized").select("id")
    facts = rescored.facts(t)
    got = {r.id: r for r in rescore.rescore(t.s_prospects, changed.union(changed), facts, FIELD_SERVICE, HISTORY_AS_OF).collect()}
    whole = {r.id: r for r in recompute.recompute(t.s_prospects, t.s_evidence, t.s_reviews, t.s_suppression, t.s_assets, t.s_award_rows, FIELD_SERVICE, HISTORY_AS_OF).collect()}
    stored = {r.id: r for r in t.s_prospects.collect()}
    ids = {r.id for r in changed.collect()}
    assert set(got) == set(stored) and ids
    for key, row in got.items():
        for name in ("opportunity_score", "readiness_state", "acquisition_stage", "priority_level", "urgency_score"):
            assert row[name] == (whole if key in ids else stored)[key][name], (key, name)
        assert (row["pain_score"] is None) == (key not in ids)
    none = rescore.rescore(t.s_prospects, t.s_prospects.limit(0), facts, FIELD_SERVICE, HISTORY_AS_OF)
    assert none.count() == len(stored) and none.filter("pain_score IS NOT NULL").count() == 0


def test_key_set_stands_below_the_aggregates(spark, t):
    facts = rescored.facts(t)
    plan = rescore.rescore(t.s_prospects, t.s_prospects.filter("id = 3"), facts, FIELD_SERVICE, HISTORY_AS_OF, stage=lambda df: df)
    text = plan._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    # every grouping of award and review rows has the key set's semi join right below it
    groups = [k for k, line in enumerate(text) if "Aggregate [prospect_id" in line and ("max_by" in line or "montant" in line)]
    assert groups
    for k in groups:
        below = [line for line in text[k + 1 : k + 6] if depth(line) > depth(text[k])]
        assert any("LeftSemi" in line for line in below), "\n".join(text[k : k + 6])


def test_acquisition_scores_what_changed_and_tells_failures(spark, t):
    done = rescored.acquired(t, "full")
    run = done.run.first()
    assert run.status == "completed" and {s.source for s in run.stats} == {"decp", "registry", "total"}
    before, after = {r.id for r in t.s_prospects.collect()}, {r.id: r for r in done.prospects.collect()}
    total = next(s for s in run.stats if s.source == "total")
    assert len(after) == len(before) + total.created and done.events.count() == total.created
    assert all(after[i].pain_score is not None for i in set(after) - before)
    assert done.awards.count() > t.s_award_rows.count() and done.evidence.count() > t.s_evidence.count()
    facts = rescore.Facts(done.evidence, t.s_reviews, done.awards, t.s_suppression, t.s_assets)
    again = rescore.rescore(done.prospects, done.prospects.filter("pain_score IS NOT NULL"), facts, FIELD_SERVICE, AWARDS_AS_OF)
    assert {r.id: r.opportunity_score for r in again.collect()} == {i: r.opportunity_score for i, r in after.items()}
    failed = rescored.acquired(t, "full", t.s_registry.drop("siren"))
    run = failed.run.first()
    assert run.status == "failed" and "siren" in run.error_summary and failed.prospects is None
    assert {s.source: s.companies for s in run.stats}["decp"] > 0  # what was counted before stays told
    with pytest.raises(ValueError):
        acquire.acquire("other", t.s_prospects, rescored.facts(t), FIELD_SERVICE, AWARDS_AS_OF)


def test_a_lost_merge_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    rows = spark.range(1000).withColumn("v", F.lit("a"))
    snapshots.create_table(rows, path, "id", buckets=16)
    change = lambda ids, v: spark.createDataFrame([(i,) for i in ids], "id long").withColumn("v", F.lit(v))
    files = lambda: len(list((tmp_path / "table/data").rglob("*.parquet")))
    assert files() == 16
    version, touched = snapshots.merge_rows(path, change([1, 2000], "b"))
    assert version.number == 2 and len(touched) <= 2 and files() == 16 + len(touched)

    def lost(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(snapshots, "_switch", lost)
        with pytest.raises(RuntimeError):
            snapshots.merge_rows(path, change(range(500), "c"))
    stored = {r.id: r.v for r in snapshots.read_table(spark, path).collect()}
    assert stored == {**dict.fromkeys(range(1000), "a"), 1: "b", 2000: "b"}
    version, _ = snapshots.merge_rows(path, change([5], "d"), gone=change([7, 2000], None))
    stored = {r.id: r.v for r in snapshots.read_table(spark, path).collect()}
    assert version.number == 3 and stored == {**{i: "a" for i in range(1000) if i != 7}, 1: "b", 5: "d"}
    assert snapshots.read_table(spark, path, 1).filter("v <> 'a'").count() == 0
    assert snapshots.merge_rows(path, change([], "x"))[1] == set()
    with pytest.raises(snapshots.VersionTaken):
        snapshots.create_table(rows, path, "id")
    stale = snapshots.current(spark, path, 2)
    with monkeypatch.context() as late:  # a write that began from version 2 comes last
        late.setattr(snapshots, "current", lambda *a: stale)
        with pytest.raises(snapshots.VersionTaken):
            snapshots.merge_rows(path, change([9], "z"))
    assert {r.id: r.v for r in snapshots.read_table(spark, path).collect()} == stored


def test_the_date_reaches_every_delivery(spark, t, tmp_path):
    from leadloom.sources import awards

    t.s_awards.toDF("uid", "dateNotification", "CPV", "Objet", "idTitulaire", "nomTitulaire", "amount", "acheteurNom").write.parquet(str(tmp_path / "a"))
    t.s_awards.select("id", F.col("dateAttribution").cast("date").alias("dateNotification"), "montant").write.parquet(str(tmp_path / "b"))
    rows = awards.read_awards(spark, str(tmp_path), since="1996-07-01")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    pushed = [line for line in plan.split("\n") if "PushedFilters" in line]
    assert len(pushed) == 2 and all("GreaterThanOrEqual(dateNotification" in line for line in pushed)
    assert rows.count() > 0 and rows.filter("montant IS NOT NULL AND codeCPV IS NULL").count() > 0  # the second file has no code
    narrow = rows.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "objetMarche" not in narrow and "Objet" not in narrow


def test_streams_stop_once_over_restarts(spark, tmp_path):
    from leadloom.streaming import events as streams

    key = "spark.sql.streaming.stateStore.providerClass"
    assert "RocksDB" in spark.conf.get(key)
    events_schema, list_schema = "id long, prospect_id long, event_type string, event_date timestamp", "kind string, value_normalized string, suppressed_at timestamp"
    people = spark.createDataFrame([(1, "a@x.fr", "111"), (2, "b@y.fr", "222"), (3, "c@y.fr", None), (4, None, "444")], "id long, email string, siren string")
    stopped = spark.createDataFrame([(4, "prospect_replied")], "prospect_id long, stop_reason string")
    text = lambda schema: schema.replace("timestamp", "string")

    def put(name, rows, schema):
        frame = spark.createDataFrame(rows, text(schema))
        stamp = "event_date" if name == "events" else "suppressed_at"
        frame.withColumn(stamp, F.col(stamp).cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def run():
        events = spark.readStream.schema(events_schema).parquet(str(tmp_path / "events"))
        hits = streams.suppression_hits(spark.readStream.schema(list_schema).parquet(str(tmp_path / "list")), people)
        told = []
        query = streams.stop_stream(events, hits, stopped).writeStream.foreachBatch(lambda batch, _: told.extend(batch.collect()))
        query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.prospect_id, r.stop_reason) for r in told)

    put("events", [(10, 1, "Replied", "2024-01-02 00:00:00"), (11, 4, "Replied", "2024-01-02 00:00:00"), (12, 3, "Sent", "2024-01-02 00:00:00")], events_schema)
    put("list", [("email", "a@x.fr", "2024-01-03 00:00:00"), ("siren", "222", "2024-01-03 00:00:00")], list_schema)
    assert run() == [(1, "prospect_replied"), (2, "suppression_entry_matched")]
    put("list", [("domain", "y.fr", "2024-01-05 00:00:00"), ("siren", "444", "2024-01-05 00:00:00")], list_schema)
    assert run() == [(3, "suppression_entry_matched")]  # 2 and 4 have stopped before
    put("events", [(13, 2, "OptOut", "2024-01-06 00:00:00")], events_schema)
    assert run() == []


def test_one_scan_finds_what_the_keywords_find(spark):
    from leadloom import fixed
    from leadloom.operators.evidence import extract_evidence, one_scan

    import re

    words = [w for _, _, _, keywords in fixed.EVIDENCE_TAXONOMY for w in keywords]
    texts = ["", "nothing here", "our Agences and 24/7", "hiring a 24h/24 service coordinator", "subbranch", "the branches of bons d'intervention papier", "multisite multi-sites", "recrutement\nplanificateur"]
    for text in texts:
        assert bool(re.search(one_scan(words), text.lower())) == any(re.search(w, text.lower()) for w in words), text
    rows = extract_evidence(spark.createDataFrame(list(enumerate(texts)), "k int, text string")).collect()
    got = {(r.k, r.code) for r in rows}
    assert got == {(k, code) for k, text in enumerate(texts) for code, _, _, keywords in fixed.EVIDENCE_TAXONOMY if any(re.search(w, text.lower()) for w in keywords)}
    plan = extract_evidence(spark.createDataFrame([(1, "x")], "k int, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan.upper()


def test_pages_of_a_run_are_dealt_over_the_tasks(spark, t):
    rng = random.Random(4)
    page = lambda name: f"<html><head><title>Froid Pro</title></head><body><p>contact@{name}</p><p>{rng.randbytes(1500).hex()}</p></body></html>"
    hosts = [f"c{k}.example.fr" for k in range(0, 150, 3)] + [f"other{k}.example.com" for k in range(30)]
    rows = [(40 * h + k, f"https://{name}/p{k}", page(name)) for h, name in enumerate(hosts) for k in range(40)]
    one_task = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    parsed = []

    def stage(df):
        if "links" not in df.columns:
            return cut_lineage(df)
        staged = cut_lineage(df.withColumn("task", F.spark_partition_id()))
        parsed.extend(staged.select("host", "task", "page_id").collect())
        return staged.drop("task")

    nothing = t.s_contact_evidence.limit(0).withColumn("fingerprint", F.lit(""))
    done = discover.discover_contacts(
        t.s_prospects, one_task, t.s_people, t.s_points, nothing, t.s_tasks, t.s_runs, t.s_suppression, t.s_mx, EVENTS_AS_OF, stage=stage
    )
    runs = done.runs.filter("domain IS NOT NULL").select("domain", "pages_examined").collect()
    assert runs and all(r.pages_examined == 40 for r in runs)
    # whole sites, of the prospects of the run only, and not in the one task of the scan
    assert sorted(r.page_id for r in parsed) == sorted(row[0] for row in rows if row[1].split("/")[2] in {r.domain for r in runs})
    assert len({r.task for r in parsed}) > 1


def test_fingerprints_are_computed_once(spark):
    fields = ("prospect_id", "source_adapter", "source_url", "evidence_type", "contact_value", "person_name", "content_hash")
    rows = [(1, "a", "https://x.fr/1", "published_person", None, "Anne Petit", None), (1, "a", "https://x.fr/1", "published_person", None, None, None), (None,) * 7]
    stored = spark.createDataFrame(rows, "prospect_id long, " + ", ".join(f"{name} string" for name in fields[1:]))
    stored = stored.withColumn("fingerprint", contact_fingerprint(*map(F.col, fields)))
    assert not stored.schema["fingerprint"].nullable and len({r.fingerprint for r in stored.collect()}) == 3
    new = [(*rows[0], "o1", "x", 70), (1, "a", "https://x.fr/2", "published_person", None, "Anne Petit", None, "o2", "x", 70)]
    found = spark.createDataFrame(new, "prospect_id long, " + ", ".join(f"{name} string" for name in fields[1:]) + ", ord string, excerpt string, confidence int")
    people = spark.createDataFrame([(7, 1, "anne petit")], "id long, prospect_id long, normalized_name string")
    points = spark.createDataFrame([], "id long, prospect_id long, value_normalized string")
    added = contacts.append_contact_evidence(stored.unionByName(stored), found, people, points)
    assert [(r.source_url, r.person_id) for r in added.collect()] == [("https://x.fr/2", 7)]
    plan = added._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter" in line and "sha2" in line]
