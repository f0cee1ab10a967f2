"""Contact discovery: pages and officers of all eligible prospects into people, points, evidence and tasks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.frames import spread, when_is
from leadloom.functions.rules import is_filled, text
from leadloom.functions.text import extract_domain, normalize_person_name
from leadloom.operators import contacts, pages
from leadloom.operators.activity import eligibility
from leadloom.operators.compliance import suppressed_ids, suppression_keys
from leadloom.operators.identity import domain_match, first_page_per_host
from leadloom.plans.rescore import Facts, rescore
from leadloom.plays import Play
from leadloom.session import cut_lineage
from leadloom.sources.pages import accept_pages, page_counts, parse_pages

AsOf = str | date | datetime


@dataclass
class Discovery:
    """The tables after one discovery run; ``prospects`` holds the eligible ones, the other rows do not change."""

    prospects: DataFrame
    people: DataFrame
    points: DataFrame
    evidence: DataFrame
    tasks: DataFrame
    summary: DataFrame
    runs: DataFrame


def run_rows(chosen: DataFrame, states: DataFrame, counts: DataFrame, people: DataFrame, points: DataFrame, evidence: DataFrame, tasks: DataFrame, as_of: AsOf) -> DataFrame:
    """A finished run per prospect: pages examined and rejected, what was found, what of it is new, and what can be used."""
    mine = points.filter("seen")
    found = contacts.run_summary(mine).withColumnRenamed("contact_points", "contact_points_found")
    count = lambda rows, name: rows.groupBy("prospect_id").agg(F.count(F.lit(1)).alias(name))
    persons = people.groupBy("prospect_id").agg(F.count_if("seen").alias("people_found"), F.count_if("is_new").alias("people_added"))
    parts = [
        states.select(F.col("id").alias("prospect_id"), "domain_match_state"), found, persons, count(mine.filter("is_new"), "contact_points_added"),
        count(evidence, "evidence_added"), count(tasks.filter("change = 'created'"), "tasks_created"),
    ]
    rows = chosen.select(F.col("id").alias("prospect_id"), "domain").join(counts.withColumnRenamed("host", "domain"), "domain", "left")
    for part in parts:
        rows = rows.join(part, "prospect_id", "left")
    numbers = [name for name, kind in rows.dtypes if kind in ("bigint", "int") and name != "prospect_id"]
    rows = rows.withColumns({name: F.coalesce(F.col(name), F.lit(0)).cast("long") for name in numbers}).withColumn("finished_at", when_is(as_of))
    rows = rows.withColumns({"id": contacts.row_id("run", "prospect_id", "finished_at"), "status": F.lit("completed"), "started_at": F.col("finished_at")})
    return rows.withColumnRenamed("pages_accepted", "pages_examined")


def discover_contacts(
    prospects: DataFrame,
    site_pages: DataFrame,
    people: DataFrame,
    points: DataFrame,
    evidence: DataFrame,
    tasks: DataFrame,
    runs: DataFrame,
    suppression: DataFrame,
    mx: DataFrame,
    as_of: AsOf,
    min_score: int = 40,
    max_pages: int | None = None,
    max_depth: int | None = None,
    stage: Callable[[DataFrame], DataFrame] = cut_lineage,
    facts: Facts | None = None,
    play: Play | None = None,
) -> Discovery:
    """One run over every eligible prospect.

    Pages are parsed and reduced per host before they meet the prospects, so a
    host shared by many companies is read once.  ``stage`` cuts the plan wherever
    a result is used several times, so nothing is computed twice and no plan
    grows with the length of the job.  With ``facts`` and ``play`` the
    prospects are scored anew with their new contacts.
    """
    prospects = spread(prospects, "id")
    hits = suppressed_ids(prospects, suppression, suppression_keys(email=F.col("email"), siren=F.col("siren")))
    checked = eligibility(prospects, runs, hits, as_of, min_score)
    chosen = stage(
        checked.filter(F.col("ineligible_reason").isNull()).select(
            "id", "company_name", "siren", extract_domain(F.col("website")).alias("domain")
        )
    )

    # only ids and urls are ranked; the HTML of the pages a run visits is dealt over the tasks once, by page
    accepted = accept_pages(site_pages)
    visits = stage(pages.select_pages(accepted.drop("html", "content_hash"), max_pages, max_depth).select("page_id", "url", "host", "visit"))
    fetched = spread(accepted.select("page_id", "url", "html", "host", "content_hash"), "page_id")
    parsed = stage(parse_pages(pages.of_hosts(fetched, visits, chosen.select("domain"))))
    opening = first_page_per_host(visits).select("page_id")
    first = parsed.join(opening, "page_id", "left_semi").select("host", "title", pages.page_text(F.col("parts")).alias("text"))
    matched = domain_match(
        chosen.join(first, F.col("domain") == F.col("host"), "left").withColumn("host", F.coalesce("host", "domain"))
    )
    matched = stage(matched.select("id", "domain", "domain_match_state", F.col("text").isNotNull().alias("_fetched")))
    sites = matched.filter(F.col("_fetched") & (F.col("domain_match_state") != "ambiguous")).select("id", "domain")
    ambiguous = matched.filter(F.col("_fetched") & (F.col("domain_match_state") == "ambiguous")).select("id")

    keys, order_of = ("host", "visit", "page_id"), visits.select("page_id", "visit")
    # an ambiguous site says nothing about a prospect, so only the pages of the others are searched for facts
    searched = pages.of_hosts(parsed, visits, sites.select("domain"))
    page_points = pages.contact_facts(searched, ("host", "page_id")).join(order_of, "page_id")
    page_people = pages.people_facts(searched, ("host", "page_id")).join(order_of, "page_id")
    page_points, page_people = stage(page_points), stage(page_people)
    page_evidence = pages.evidence_facts(page_points, page_people, keys)
    host_points = pages.dedupe_points(page_points, "host", "visit")
    host_people = pages.dedupe_people(page_people, "host", "visit")
    host_evidence = pages.dedupe_evidence(page_evidence, "host", "visit")

    def of_prospects(facts: DataFrame) -> DataFrame:
        owned = sites.select(F.col("id").alias("prospect_id"), F.col("domain").alias("_domain"))
        return facts.join(owned, F.col("host") == F.col("_domain")).drop("_domain", "host")

    order = lambda *columns: F.concat_ws("|", F.format_string("%05d", "visit"), *columns)
    person_columns = ("prospect_id", "full_name", "job_title", "normalized_role", "role_category", "buyer_role_score",
                      "company_match_state", "identity_confidence", "linkedin_url", "ord")
    site_people = of_prospects(host_people).withColumn("ord", order(F.col("source_url"), F.col("full_name")))
    eligible = prospects.join(chosen.select("id"), "id", "left_semi")
    if "dirigeants" in prospects.columns:
        officers = pages.registry_people(eligible)
        registry_evidence = pages.registry_evidence(officers)
        officers = officers.withColumn("ord", F.format_string("registry|%05d", "ord"))
        person_facts = site_people.select(*person_columns).unionByName(officers.select(*person_columns))
    else:
        registry_evidence = None
        person_facts = site_people.select(*person_columns)
    merged_people = stage(contacts.merge_people(people, person_facts))
    named = stage(contacts.people_by_name(merged_people))

    point_facts = of_prospects(host_points).withColumn("ord", order(F.col("kind"), F.col("value")))
    point_facts = stage(contacts.associate(point_facts, named))
    pairs = point_facts.filter((F.col("kind") == "email") & is_filled(F.col("person_name"))).select(
        "prospect_id", F.col("value").alias("email"), "person_name"
    )
    patterns = contacts.learn_patterns(pairs, key="prospect_id")
    domains = chosen.select(F.col("id").alias("prospect_id"), "domain")
    best = contacts.top_people(named.join(domains, "prospect_id"))
    guesses = contacts.pattern_candidates(best, patterns, key="prospect_id")
    generated = guesses.select(
        "prospect_id",
        F.lit("email").alias("kind"),
        F.col("email").alias("value"),
        F.lit("not_published").alias("publication_state"),
        "person_match_state",
        F.lit("unchecked").alias("deliverability_state"),
        F.lit("domain_pattern").alias("source_class"),
        F.col("full_name").alias("person_name"),
        F.when(F.col("observations") >= 2, 78).otherwise(35).alias("confidence"),
        F.format_string("z|%02d|%02d", "person_rank", "candidate_rank").alias("ord"),
    )
    both = point_facts.select(*generated.columns).unionByName(generated)
    both = both.withColumn("_who", normalize_person_name(text(F.col("person_name"))))
    ids = named.select(F.col("prospect_id").alias("_p"), F.col("normalized_name").alias("_n"), "person_id")
    both = both.join(ids, (F.col("prospect_id") == F.col("_p")) & (F.col("_who") == F.col("_n")), "left").drop("_p", "_n", "_who")
    prepared = stage(contacts.prepare_points(both, prospects, suppression))
    merged = contacts.merge_points(points, prepared)
    mine_only = chosen.select(F.col("id").alias("prospect_id"))
    touched = contacts.apply_mx(merged.join(mine_only, "prospect_id", "left_semi"), mx)
    merged_points = stage(touched.unionByName(merged.join(mine_only, "prospect_id", "left_anti"), allowMissingColumns=True))

    columns = ("prospect_id", "evidence_type", "source_adapter", "source_url", "excerpt", "page_title", "confidence",
               "content_hash", "contact_value", "person_name", "ord")
    found = of_prospects(host_evidence).withColumn("ord", order(F.col("evidence_type"), text(F.col("contact_value")))).select(*columns)
    if registry_evidence is not None:
        found = found.unionByName(registry_evidence.withColumn("ord", F.lit("registry")).select(*columns))
    new_evidence = stage(contacts.append_contact_evidence(evidence, found, merged_people, merged_points))

    mine = merged_points.join(chosen.select(F.col("id").alias("prospect_id")), "prospect_id", "left_semi")
    wanted = contacts.desired_tasks(chosen, mine, ambiguous)
    next_tasks = stage(contacts.sync_tasks(tasks, wanted, chosen, as_of))
    projected = contacts.project_primary(
        eligible,
        merged_people.join(chosen.select(F.col("id").alias("prospect_id")), "prospect_id", "left_semi"),
        mine,
    )
    if facts is not None and play is not None:
        projected = rescore(projected, chosen, facts, play, as_of, stage)
    mine_people = merged_people.join(mine_only, "prospect_id", "left_semi")
    return Discovery(
        prospects=projected,
        people=merged_people,
        points=merged_points,
        evidence=new_evidence,
        tasks=next_tasks,
        summary=contacts.run_summary(mine),
        runs=run_rows(chosen, matched, page_counts(site_pages), mine_people, mine, new_evidence, next_tasks, as_of),
    )
