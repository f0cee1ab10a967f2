"""Which company is this: lookups, resolution, domains, upserts, officers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.frames import first_per
from leadloom.functions.codes import is_digital_naf, normalize_naf, passes_play, play_role
from leadloom.functions.rules import compact, filled, first_match, is_filled, text, yes
from leadloom.functions.text import (
    normalize_company_name,
    normalize_domain,
    officer_name,
    strip_accents,
)
from leadloom.plays import Play

# --- Lookups ----------------------------------------------------------------


def match_prospects(incoming: DataFrame, prospects: DataFrame) -> DataFrame:
    """Add ``matched_id`` and ``matched_by``: equal siret, else the lowest id with the same siren."""
    by_siret = (
        prospects.filter(is_filled(F.col("siret"))).groupBy(F.col("siret").alias("_siret")).agg(F.min("id").alias("_siret_id"))
    )
    by_siren = (
        prospects.filter(is_filled(F.col("siren"))).groupBy(F.col("siren").alias("_siren")).agg(F.min("id").alias("_siren_id"))
    )
    joined = incoming.join(by_siret, F.col("siret") == F.col("_siret"), "left")
    joined = joined.join(by_siren, F.col("siren") == F.col("_siren"), "left")
    return joined.withColumns(
        {
            "matched_id": F.coalesce("_siret_id", "_siren_id"),
            "matched_by": first_match(
                [(F.col("_siret_id").isNotNull(), "siret"), (F.col("_siren_id").isNotNull(), "siren")]
            ),
        }
    ).drop("_siret", "_siret_id", "_siren", "_siren_id")


def resolve(observations: DataFrame, companies: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Resolve observations to companies by official identifier, else by normalised name within the country.

    Both lookups are reduced to one row per key first, so the joins are plain
    equi joins whatever the number of namesakes.
    """
    ids = identifiers.groupBy(
        F.col("scheme").alias("_scheme"), F.col("value_normalized").alias("_value")
    ).agg(F.min("company_id").alias("_id_company"))
    names = (
        companies.withColumn("_name", normalize_company_name(F.col("canonical_name")))
        .groupBy(F.col("country_code").alias("_country"), "_name")
        .agg(F.min(F.struct("company_id", "canonical_name")).alias("_named"))
    )
    value = F.upper(F.trim("identifier_value"))
    out = observations.withColumns(
        {
            "_obs_value": F.when(is_filled(F.col("identifier_scheme")), filled(value)),
            "_obs_name": normalize_company_name(F.col("company_name")),
        }
    )
    out = out.join(ids, (F.col("identifier_scheme") == F.col("_scheme")) & (F.col("_obs_value") == F.col("_value")), "left")
    out = out.join(names, (F.col("country_code") == F.col("_country")) & (F.col("_obs_name") == F.col("_name")), "left")
    exact, named = F.col("_id_company").isNotNull(), F.col("_named").isNotNull()
    reason = first_match(
        [
            (exact, F.concat(F.lit("Exact match on identifier scheme '"), F.col("identifier_scheme"), F.lit("': '"),
                             F.col("_obs_value"), F.lit("'"))),
            (named, F.concat(F.lit("Exact normalized name match: '"), F.col("_named.canonical_name"), F.lit("'"))),
        ],
        "No matching identifier or canonical company name found.",
    )
    out = out.withColumns(
        {
            "resolution": first_match(
                [(exact, "resolved_exact"), (named, "resolved_high_confidence")], "unresolved"
            ),
            "company_id": F.coalesce("_id_company", F.col("_named.company_id")),
            "match_score": first_match([(exact, 1.0), (named, 0.95)], 0.0),
            "match_reason": reason,
        }
    )
    return out.drop("_scheme", "_value", "_id_company", "_country", "_name", "_named", "_obs_value", "_obs_name")


# --- Domains ----------------------------------------------------------------


def name_tokens(column: Column) -> Column:
    """Distinct words of three or more plain letters or digits, legal forms left out."""
    words = F.regexp_extract_all(F.lower(strip_accents(column)), F.lit("[a-z0-9]{3,}"), F.lit(0))
    ignored = F.array(*[F.lit(word) for word in fixed.DOMAIN_MATCH_IGNORED])
    return F.array_except(words, ignored)


def domain_match(candidates: DataFrame) -> DataFrame:
    """Add ``domain_match_state`` from ``company_name``, ``siren`` and a page's ``title``, ``text``, ``host``.

    The words of the name are looked up in the title and the page text and in
    the host; the registry number in the digits of the text.
    """
    out = candidates.withColumns(
        {
            "_company": name_tokens(F.col("company_name")),
            "_page": name_tokens(
                F.concat_ws(" ", text(F.col("title")), text(F.col("text")))
            ),
            "_host": name_tokens(F.translate(text(F.col("host")), ".-", "  ")),
        }
    )
    size = F.greatest(F.size("_company"), F.lit(1))
    overlap = F.greatest(
        F.size(F.array_intersect("_company", "_page")), F.size(F.array_intersect("_company", "_host"))
    )
    registered = is_filled(F.col("siren")) & F.regexp_replace(text(F.col("text")), "[^0-9]", "").contains(F.col("siren"))
    state = first_match(
        [
            (yes(registered), "exact_legal_match"),
            (overlap * 10 >= size * 8, "strong_brand_match"),
            (overlap * 10 >= size * 5, "probable"),
        ],
        "ambiguous",
    )
    return out.withColumn("domain_match_state", state).drop("_company", "_page", "_host")


def first_page_per_host(pages: DataFrame) -> DataFrame:
    """The page a crawl meets first on each host: shortest path, then url."""
    return first_per(pages, ["host"], [F.length("url"), "url", "page_id"])


def verify_domain(companies: DataFrame, root_pages: DataFrame) -> DataFrame:
    """Verification state and score of each company's domain against its fetched root page.

    ``companies`` has ``domain``, ``legal_name``, ``identifier``; ``root_pages``
    one row per ``host`` with ``status``, ``body``, ``unsafe_reason`` and
    ``fetch_error`` (either may be NULL).  A domain without a row was not fetched.
    """
    out = companies.withColumn("domain_normalized", normalize_domain(F.col("domain")))
    out = out.join(root_pages, F.col("domain_normalized") == root_pages["host"], "left")
    out = out.withColumns(
        {
            "_body": F.lower(text(F.col("body"))),
            "_name": F.trim(F.replace(F.replace(F.lower("legal_name"), F.lit("limited"), F.lit("")), F.lit("ltd"), F.lit(""))),
        }
    )
    fetched = F.col("status") == 200
    by_id = yes(is_filled(F.col("identifier")) & F.col("_body").contains(F.lower("identifier")))
    by_name = yes(is_filled(F.col("_name")) & F.col("_body").contains(F.col("_name")))
    out = out.withColumns({"_by_id": by_id, "_by_name": by_name})
    tenths = F.when(F.col("_by_id"), 6).otherwise(0) + F.when(F.col("_by_name"), 4).otherwise(0)
    unsafe = F.col("unsafe_reason").isNotNull()
    failed = F.col("fetch_error").isNotNull() | F.col("status").isNull()
    state = first_match(
        [(unsafe, "rejected"), (failed, "candidate"), (~fetched, "candidate"), (tenths >= 6, "verified_primary")],
        "candidate",
    )
    score = first_match(
        [(unsafe, 0), (failed, 1), (~fetched, 3)], F.least(tenths + 2, F.lit(10))
    )
    out = out.withColumns({"verification_state": state, "match_score": score / 10})
    return out.drop("_body", "_name", "_by_id", "_by_name", "body", "host")


# --- Officers and registry companies ----------------------------------------


def best_officer(officers: Column, play: Play) -> Column:
    """The officer whose role the play prefers, else the first natural person that is no auditor.

    Works inside the array of one row: entries are compared by role priority and
    position, so no shuffle is needed.
    """
    persons = F.filter(
        F.transform(F.coalesce(officers, F.array()), lambda officer, i: F.struct(i.alias("position"), officer.alias("officer"))),
        lambda e: (text(e["officer"]["type_dirigeant"]) != "personne morale")
        & ~F.lower(text(e["officer"]["qualite"])).contains("commissaire"),
    )
    ranked = F.transform(
        persons,
        lambda e: F.struct(
            F.coalesce(play_role(e["officer"]["qualite"], play)["priority"] if play.buyer_roles else F.lit(None), F.lit(999)).alias("priority"),
            e["position"].alias("position"),
            e["officer"].alias("officer"),
        ),
    )
    return F.array_min(ranked)["officer"]


def officer_full_name(officer: Column) -> Column:
    return filled(officer_name(officer["prenoms"], officer["nom"]))


def discover_registry(rows: DataFrame, play: Play) -> DataFrame:
    """Registry sightings to one row per siren, first sighting first.

    ``rows`` are normalised companies with ``by_code`` (found through a target
    activity code, which bypasses the play filter) and ``sighting`` (arrival
    order, code hits before keyword hits).  Digital activities never pass.
    """
    naf = F.col("naf_code")
    wanted = F.col("by_code") | passes_play(naf, play)
    kept = rows.filter(is_filled(F.col("siren")) & wanted & ~is_digital_naf(naf))
    first = first_per(kept, ["siren"], [F.desc("by_code"), "sighting"])
    return first.withColumn("evidence", registry_evidence())


def registry_evidence() -> Column:
    """One or two structural evidence items of a registry company."""
    size = F.col("establishments").cast("int")

    def item(kind, label, body, confidence, strength):
        return F.struct(
            F.lit("structural_fit").alias("category"),
            F.lit(kind).alias("signal_type"),
            label.alias("label"),
            body.alias("evidence_text"),
            F.lit("annuaire").alias("source_type"),
            F.lit(confidence).alias("confidence"),
            F.lit(strength).alias("strength"),
        )

    activity = item(
        "REGISTRY_ACTIVITY",
        F.concat(F.lit("Registry NAF "), F.coalesce(F.col("naf_code"), F.lit("None"))),
        F.concat(
            F.coalesce(F.col("company_name"), F.lit("None")), F.lit(" — "), F.col("sector"),
            F.lit(" — size "), F.col("company_size"),
        ),
        70, 45,
    )
    sites = item(
        "MULTI_SITE_OPERATIONS",
        F.lit("Multiple establishments"),
        F.concat(size.cast("string"), F.lit(" establishments ouverts")),
        65, 55,
    )
    return compact([activity, F.when(size >= 2, sites)])


def rank_registry(companies: DataFrame, play: Play, n: int) -> DataFrame:
    """Core activity first, then mid-market size, then a known person."""
    prefix = F.substring(text(normalize_naf(F.col("naf_code"))), 1, 2)
    core = F.when(prefix.isin(*play.target_naf_prefixes), 0).otherwise(1) if play.target_naf_prefixes else F.lit(1)
    size = F.when(F.col("company_size").isin("11-50", "51-200"), 0).otherwise(1)
    person = F.when(is_filled(F.col("decision_maker_name")), 0).otherwise(1)
    return companies.orderBy(core, size, person, "siren").limit(n)


# --- Merges -----------------------------------------------------------------


def enrich_merge(base: DataFrame, new: DataFrame, key: str, prefer: tuple[str, ...] = ()) -> DataFrame:
    """Fill empty fields of ``base`` from ``new``; preferred fields take any non-empty new value.

    ``new`` has at most one row per key.  Zero counts as empty for numbers.
    """
    kinds = dict(base.dtypes)

    def present(column: Column, kind: str) -> Column:
        if kind == "string":
            return filled(column)
        return F.when(F.size(column) > 0, column) if kind.startswith("array") else column

    def truthy(column: Column, kind: str) -> Column:
        return F.when(column != 0, column) if kind in ("int", "bigint", "double") else present(column, kind)

    shared = [name for name in new.columns if name != key and name in base.columns]
    added = [name for name in new.columns if name != key and name not in base.columns]
    renamed = new.select(key, *[F.col(name).alias(f"_new_{name}") for name in shared + added])
    joined = base.join(renamed, key, "left")
    out = []
    for name in base.columns:
        if name not in shared:
            out.append(F.col(name))
            continue
        old, fresh = F.col(name), present(F.col(f"_new_{name}"), kinds[name])
        first = [fresh] if name in prefer else [truthy(old, kinds[name]), fresh]
        out.append(F.coalesce(*first, old).alias(name))
    out += [F.col(f"_new_{name}").alias(name) for name in added]
    return joined.select(*out)


ENRICHED_FIELDS = ("company_name", "sector", "company_size", "naf_code", "siren", "siret", "website", "phone", "email",
                   "decision_maker_name", "decision_maker_title", "city", "department", "region",
                   "diffusion_status", "contact_source", "contact_confidence", "contact_discovery_state")


def label_guessed(prospects: DataFrame) -> DataFrame:
    """A mailbox of unknown origin is a guess and is labelled so."""
    guess = (
        is_filled(F.col("email"))
        & F.lower(text(F.col("contact_confidence"))).isin("", "none", "unverified")
        & ~is_filled(F.col("contact_discovery_state"))
    )
    return prospects.withColumns(
        {
            "contact_discovery_state": F.when(guess, "guessed").otherwise(F.col("contact_discovery_state")),
            "contact_confidence": F.when(guess, "domain_and_pattern_only").otherwise(F.col("contact_confidence")),
        }
    )


def apply_enrichment(prospects: DataFrame, patch: DataFrame) -> DataFrame:
    """Copy every non-NULL patched field; ``patch`` has one row per prospect ``id``."""
    fields = [name for name in patch.columns if name in prospects.columns and name != "id"]
    renamed = patch.select("id", *[F.col(name).alias(f"_patch_{name}") for name in fields])
    joined = prospects.join(renamed, "id", "left")
    columns = [
        F.coalesce(F.col(f"_patch_{name}"), F.col(name)).alias(name) if name in fields else F.col(name)
        for name in prospects.columns
    ]
    return label_guessed(joined.select(*columns))


def new_prospect_id(siren: Column, siret: Column) -> Column:
    """A stable id for a company first seen now: reruns agree, no sequence is needed."""
    return F.xxhash64(F.lit("prospect"), text(siren), text(siret)).bitwiseAND(F.lit(2**63 - 1))


def upsert_outcomes(incoming: DataFrame, prospects: DataFrame, suppressed_sirens: DataFrame) -> DataFrame:
    """Incoming companies with ``target_id`` and ``outcome``.

    created: the first row of a company nobody knows; updated: any other row
    with an id; skipped: suppressed; error: no id at all.  ``incoming`` needs
    ``siren``, ``siret`` and the arrival order ``ord``.
    """
    has_id = is_filled(F.col("siren")) | is_filled(F.col("siret"))
    blocked = suppressed_sirens.select(F.col("value_normalized").alias("_blocked")).distinct()
    marked = incoming.withColumn("_digits", F.regexp_replace(text(F.col("siren")), "[^0-9]", ""))
    marked = marked.join(blocked, F.col("_digits") == F.col("_blocked"), "left")
    found = match_prospects(marked, prospects).withColumn(
        "_new_key", F.coalesce(filled(F.col("siren")), filled(F.col("siret")))
    )
    open_rows = has_id & F.col("_blocked").isNull()
    firsts = (
        found.filter(open_rows & F.col("matched_id").isNull())
        .groupBy(F.col("_new_key").alias("_first_key"))
        .agg(F.min("ord").alias("_first_ord"), F.min_by(F.struct("siren", "siret"), "ord").alias("_first"))
    )
    out = found.join(firsts, F.col("_new_key") == F.col("_first_key"), "left")
    creates = F.col("matched_id").isNull() & (F.col("ord") == F.col("_first_ord"))
    outcome = first_match(
        [(~has_id, "error"), (F.col("_blocked").isNotNull(), "skipped"), (creates, "created")], "updated"
    )
    target = F.coalesce("matched_id", new_prospect_id(F.col("_first.siren"), F.col("_first.siret")))
    out = out.withColumns({"outcome": outcome, "target_id": F.when(open_rows, target)})
    return out.drop("_digits", "_blocked", "_new_key", "_first_key", "_first_ord", "_first", "matched_id", "matched_by")


def upsert_prospects(
    prospects: DataFrame,
    outcomes: DataFrame,
    signal_type: str,
    source: str,
    data_source: str,
    play_code: str,
) -> DataFrame:
    """The next snapshot of the prospects table, with ``changed`` = created, updated or NULL.

    Several incoming rows of one company are folded first, the last non-empty
    value of a field winning; then one full outer join writes the snapshot.
    Award histories merge as rows (``merge_awards``), evidence with
    ``upsert_evidence``.
    """
    carried = [name for name in ENRICHED_FIELDS if name in outcomes.columns]
    live = outcomes.filter(F.col("target_id").isNotNull())
    if "award_count" not in live.columns:
        live = live.withColumn("award_count", F.lit(0))
    last = lambda name: F.max_by(F.when(is_filled(F.col(name)), F.col(name)), F.when(is_filled(F.col(name)), F.col("ord")))
    folded = live.groupBy(F.col("target_id").alias("_id")).agg(
        F.max(F.col("outcome") == "created").alias("_created"),
        last("signal_details").alias("_signal_details"),
        F.max(F.col("award_count") > 0).alias("_awarded"),
        F.max("last_tender_date").alias("_last_tender_date") if "last_tender_date" in live.columns
        else F.lit(None).cast("string").alias("_last_tender_date"),
        *[last(name).alias(f"_in_{name}") for name in carried],
    )
    joined = prospects.withColumn("_old", F.lit(True)).join(folded, F.col("id") == F.col("_id"), "full_outer")
    old, touched = yes(F.col("_old")), F.col("_id").isNotNull()
    award_signal = signal_type in fixed.AWARD_SIGNALS
    defaults = {
        "sector": F.lit("Field Services"),
        "company_size": F.lit("unknown"),
        "signal_type": F.lit(signal_type),
        "source": F.lit(source),
        "data_source": F.lit(data_source),
        "acquisition_stage": F.lit("researching"),
        "needs_manual_review": F.lit(True),
        "contact_confidence": F.lit("none"),
        "contact_source": F.lit("none"),
        "market_play_code": F.lit(play_code),
        "readiness_state": F.lit("research_required"),
        "manual_review_state": F.lit("unreviewed"),
        "opted_out": F.lit(False),
        "anonymized": F.lit(False),
    }
    upgraded = touched & old & F.col("_awarded") if award_signal else F.lit(False)
    details = F.col("_signal_details")
    columns = []
    for name in prospects.columns:
        kept = F.col(name)
        if name in carried:
            kept = F.coalesce(F.col(f"_in_{name}"), kept)
        if name in defaults:
            kept = F.when(old, kept).otherwise(F.coalesce(kept, defaults[name]))
        if name == "id":
            kept = F.coalesce("id", "_id")
        elif name == "company_name":
            kept = F.coalesce(kept, F.concat(F.lit("SIREN "), F.col("_in_siren") if "siren" in carried else F.lit("?")))
        elif name in ("signal_type", "source", "data_source"):
            value = {"signal_type": signal_type, "source": "DECP" if award_signal else source, "data_source": data_source}
            kept = F.when(upgraded, F.lit(value[name])).otherwise(kept)
        elif name == "signal_details":
            kept = first_match(
                [(upgraded & details.isNotNull(), details), (touched & ~is_filled(kept), details)], kept
            )
        elif name == "market_play_code":
            kept = F.coalesce(kept, F.when(touched, F.lit(play_code)))
        elif name == "last_tender_date":
            kept = F.greatest(kept, F.col("_last_tender_date").cast(dict(prospects.dtypes)["last_tender_date"]))
        columns.append(kept.alias(name))
    changed = first_match([(F.col("_created"), "created"), (touched, "updated")])
    return joined.select(*columns, changed.alias("changed"))


def first_events(created: DataFrame, source: str) -> DataFrame:
    """The opening event of every created prospect."""
    return created.filter(F.col("changed") == "created").select(
        F.col("id").alias("prospect_id"),
        F.lit("Email").alias("channel"),
        F.lit("New").alias("event_type"),
        F.lit(f"Discovered via {source} acquisition engine").alias("notes"),
    )


def collect_sources(
    awards: DataFrame | None, registry: DataFrame | None, mode: str = "full"
) -> DataFrame:
    """Union of the company sources the mode names, whole; rank and cut them first where a run wants few."""
    if mode not in ("full", "decp", "registry"):
        raise ValueError(f"unknown mode {mode!r}")
    parts = []
    if mode in ("full", "decp"):
        parts.append(awards)
    if mode in ("full", "registry"):
        parts.append(registry)
    present = [part for part in parts if part is not None]
    out = present[0]
    for part in present[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


