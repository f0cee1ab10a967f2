"""People and contact points: association, patterns, candidates, merges, primaries, tasks, reviews."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.frames import bounded_list, first_per, top_per, when_is
from leadloom.functions.mailboxes import (
    BLIND_PATTERNS,
    PATTERNS,
    identify_pattern,
    name_tokens,
    on_domain,
    ordered_candidates,
    render_pattern,
    rendered,
)
from leadloom.functions.rules import compact, filled, first_match, is_filled, once, text, yes
from leadloom.functions.text import normalize_email, normalize_person_name, normalize_role, split_name, url_host
from leadloom.functions.utility import (
    derive_utility,
    is_usable,
    kind_rank,
    mx_deliverability,
    needs_review,
    source_rank,
    utility_rank,
    verdict_rank,
    waterfall_outcome,
)
from leadloom.operators.compliance import mark_suppressed, suppression_keys

AsOf = str | date | datetime

# --- Associations and patterns ----------------------------------------------


def associate(points: DataFrame, people: DataFrame) -> DataFrame:
    """Give published personal mailboxes without a person the first person whose name renders to them.

    Names are exploded to their eight renderings, so the match is an equality
    join on prospect and local part; ``people`` has ``ord`` for "first".
    """
    tokens = people.withColumn("_tokens", name_tokens(F.col("full_name")))
    first, last = F.col("_tokens.first"), F.col("_tokens.last")
    locals_ = F.array_distinct(F.transform(rendered(first, last), lambda r: r["local"]))
    # An empty name renders to nothing: exploding NULL yields no row.
    forms = tokens.select(
        F.col("prospect_id").alias("_prospect"),
        F.struct("ord", "full_name").alias("_person"),
        F.explode(F.when((first != "") & (last != ""), locals_)).alias("_local"),
    )
    owners = forms.groupBy("_prospect", "_local").agg(F.min("_person").alias("_owner"))
    open_mailbox = (
        (F.col("kind") == "email")
        & (F.col("publication_state") == "published_personal")
        & ~is_filled(F.col("person_name"))
    )
    local = F.substring_index(normalize_email(F.col("value")), "@", 1)
    out = points.withColumn("_key", F.when(open_mailbox, local))
    out = out.join(owners, (F.col("prospect_id") == F.col("_prospect")) & (F.col("_key") == F.col("_local")), "left")
    owned = F.col("_owner").isNotNull()
    return out.withColumns(
        {
            "person_name": F.when(owned, F.col("_owner.full_name")).otherwise(F.col("person_name")),
            "person_match_state": F.when(owned, "exact_person_published").otherwise(F.col("person_match_state")),
        }
    ).drop("_key", "_prospect", "_local", "_owner")


def learn_patterns(pairs: DataFrame, key: str = "domain") -> DataFrame:
    """Mailbox patterns per domain from published (email, person_name) pairs, most frequent first."""
    personal = pairs.filter(~F.substring_index(F.lower("email"), "@", 1).isin(*fixed.GENERIC_LOCALS))
    named = personal.withColumn("pattern", identify_pattern(F.col("email"), F.col("person_name")))
    named = named.filter(F.col("pattern").isNotNull())
    counts = named.groupBy(key, "pattern").agg(F.count(F.lit(1)).alias("observations"))
    strength = first_match([(F.col("observations") >= 3, "strong"), (F.col("observations") >= 2, "moderate")], "weak")
    return counts.withColumns({"strength": strength, "pattern_order": pattern_order(F.col("pattern"))})


def pattern_order(pattern: Column) -> Column:
    return first_match([(pattern == name, i) for i, name in enumerate(PATTERNS)], len(PATTERNS))


def top_people(people: DataFrame, n: int | None = None) -> DataFrame:
    """The people worth generating mailboxes for, best role first; ``n`` asks for the first few."""
    return top_per(people, ["prospect_id"], [F.desc("buyer_role_score"), "ord"], n, rank="person_rank")


def pattern_candidates(
    people: DataFrame, patterns: DataFrame, n: int | None = None, blind: bool = True, key: str = "domain"
) -> DataFrame:
    """Candidate mailboxes per person from the patterns learned under ``key``, else two blind guesses.

    A key has at most eight patterns, so the join fans out by eight at most.
    """
    learned = patterns.select(
        F.col(key).alias("_domain"), "pattern", "observations", "strength", "pattern_order"
    )
    known = patterns.select(F.col(key).alias("_known")).distinct()
    tokens = people.withColumn("_tokens", name_tokens(F.col("full_name"))).filter(
        (F.col("_tokens.first") != "") & is_filled(F.col("domain"))
    )
    out = tokens.join(learned, F.col(key) == F.col("_domain")).drop("_domain")
    if blind:
        guesses = F.array(
            *[
                F.struct(F.lit(name).alias("pattern"), F.lit(0).cast("long").alias("observations"),
                         F.lit("none").alias("strength"), F.lit(i).alias("pattern_order"))
                for i, name in enumerate(BLIND_PATTERNS)
            ]
        )
        unknown = tokens.join(known, F.col(key) == F.col("_known"), "left_anti")
        unknown = unknown.withColumn("_guess", F.explode(guesses)).select(*tokens.columns, "_guess.*")
        out = out.unionByName(unknown)
    facts = F.struct("pattern", "domain", F.col("_tokens.first").alias("first"), F.col("_tokens.last").alias("last"))
    email = once(facts, lambda f: on_domain(render_pattern(f["pattern"], f["first"], f["last"]), f["domain"]))
    out = out.withColumn("email", email).filter(F.col("email").isNotNull())
    order = [F.desc("observations"), "pattern_order"]
    keys = ["prospect_id", "full_name"]
    unique = first_per(out, [*keys, "email"], order)
    ranked = top_per(unique, keys, order, n, rank="candidate_rank")
    state = F.when(F.col("observations") >= 2, "exact_person_pattern_confirmed").otherwise("name_only_guess")
    return ranked.withColumn("person_match_state", state).drop("_tokens", "pattern_order")


def email_candidates(rows: DataFrame, n: int | None = None) -> DataFrame:
    """Candidate mailboxes of a company as rows: harvested, spelled from the person, role mailboxes."""
    listed = ordered_candidates(F.col("domain"), F.col("first_name"), F.col("last_name"), F.col("harvested"), n)
    out = rows.withColumn("_candidates", listed)
    return out.select(*rows.columns, F.posexplode("_candidates").alias("position", "_c")).select(
        *rows.columns, "position", "_c.*"
    )


# --- Verdicts ---------------------------------------------------------------


def attach_verdicts(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidates with their mailbox verdict; without one they stay unchecked."""
    facts = verdicts.select(
        F.col("email").alias("_email"), "is_reachable", "is_deliverable", F.col("confidence").alias("_confidence")
    )
    joined = candidates.join(facts, F.col("email") == F.col("_email"), "left")
    confidence = F.when(F.col("_email").isNull(), "unchecked").otherwise(F.col("_confidence"))
    return joined.withColumn("confidence", confidence).drop("_email", "_confidence")


def usable_verdict() -> Column:
    """Checked, and neither invalid nor bounced."""
    return (F.col("confidence") != "unchecked") & ~F.col("confidence").isin("invalid", "bounced")


def verdict_order() -> Column:
    return F.struct(verdict_rank(F.col("confidence")), F.col("position"))


def best_verdict(candidates: DataFrame, key: str = "prospect_id") -> DataFrame:
    """The technically best checked mailbox per prospect; invalid and bounced ones are out."""
    best = F.min_by(F.struct("email", "confidence", "is_reachable"), verdict_order())
    return candidates.filter(usable_verdict()).groupBy(key).agg(best.alias("best")).select(key, "best.*")


def verify_batch(points: DataFrame, outcomes: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """Unchecked, unsuppressed mailboxes to verify in order; ``n`` asks for the first few per prospect.

    With ``outcomes`` (email, deliverability) rows after the first deliverable
    personal mailbox are dropped, as a sequential check would have stopped there.
    """
    from pyspark.sql import Window

    pool = points.filter(
        (F.col("kind") == "email") & ~yes(F.col("is_suppressed")) & (F.col("deliverability_state") == "unchecked")
    )
    batch = top_per(pool, ["prospect_id"], ["id"], n, rank="batch_rank")
    if outcomes is None:
        return batch
    found = outcomes.select(F.col("email").alias("_email"), F.col("deliverability").alias("_state"))
    batch = batch.join(found, F.col("value_normalized") == F.col("_email"), "left")
    utility = derive_utility(
        F.col("kind"), F.col("publication_state"), F.col("_state"), F.col("person_match_state"),
        F.col("is_suppressed"), F.col("manually_confirmed"),
    )
    done = (F.col("_state") == "deliverable") & (utility == "usable_personal")
    # At most n rows per prospect reach this window.
    earlier = Window.partitionBy("prospect_id").orderBy("batch_rank").rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.max(yes(done)).over(earlier), F.lit(False))
    return batch.withColumn("_stopped", stopped).filter(~F.col("_stopped")).drop("_stopped", "_email", "_state")


def apply_mx(points: DataFrame, lookup: DataFrame) -> DataFrame:
    """Deliverability and utility after the mail-exchanger lookup of the mailbox domain."""
    facts = lookup.select(F.col("domain").alias("_domain"), F.col("state").alias("_mx"), F.col("has_mx").alias("_has"))
    joined = points.join(facts, F.col("domain") == F.col("_domain"), "left")
    checked = (F.col("kind") == "email") & (F.col("deliverability_state") == "unchecked") & F.col("_domain").isNotNull()
    joined = joined.withColumn("_checked", checked)
    state = F.when(
        F.col("_checked"), mx_deliverability(F.col("_mx"), F.col("_has"), F.col("deliverability_state"))
    ).otherwise(F.col("deliverability_state"))
    out = joined.withColumn("deliverability_state", state)
    changed = F.col("_checked") & ~yes(F.col("_has"))
    utility = derive_utility(
        F.col("kind"), F.col("publication_state"), F.col("deliverability_state"), F.col("person_match_state")
    )
    out = out.withColumns(
        {
            "verification_state": F.when(changed, F.col("_mx")).otherwise(F.col("verification_state")),
            "utility_state": F.when(changed, utility).otherwise(F.col("utility_state")),
        }
    )
    out = out.withColumn("is_usable", F.when(changed, is_usable(F.col("utility_state"))).otherwise(F.col("is_usable")))
    return out.drop("_domain", "_mx", "_has", "_checked")


def contact_waterfall(
    prospects: DataFrame, verdicts: DataFrame, harvested: DataFrame, suppression: DataFrame, n: int | None = None
) -> DataFrame:
    """Candidates checked and the outcome projected: one row per prospect with a domain.

    ``prospects`` needs ``id``, ``domain``, ``first_name``, ``last_name``;
    ``harvested`` brings an array of addresses per prospect.
    """
    base = prospects.join(harvested, "id", "left")
    listed = email_candidates(
        base.select(F.col("id").alias("prospect_id"), "domain", "first_name", "last_name", "harvested"), n
    )
    checked = attach_verdicts(listed.drop("harvested"), verdicts)
    best = F.min_by(F.struct("email", "confidence"), F.when(usable_verdict(), verdict_order()))
    found = checked.groupBy(F.col("prospect_id").alias("id")).agg(
        best.alias("_best"), F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("confidence") != "unchecked").alias("checked")
    )
    out = base.join(found, "id", "left")
    outcome = waterfall_outcome(F.col("_best.email"), F.col("_best.confidence"), F.col("harvested"))
    known = is_filled(F.col("domain"))
    out = out.withColumn("_outcome", outcome)
    result = out.select(
        "id",
        F.coalesce("candidates", F.lit(0)).alias("candidates"),
        F.coalesce("checked", F.lit(0)).alias("checked"),
        F.when(known, F.col("_outcome.email")).alias("best_email"),
        F.when(known, F.col("_outcome.source")).otherwise("none").alias("contact_source"),
        F.when(known, F.col("_outcome.confidence")).otherwise("needs_review").alias("contact_confidence"),
        F.lit("guessed").alias("contact_discovery_state"),
        F.lit(True).alias("needs_manual_review"),
        F.when(known, F.col("_outcome.usable_for_send")).otherwise(False).alias("usable_for_send"),
        "siren",
    )
    marked = mark_suppressed(
        result, suppression, suppression_keys(email=F.col("best_email"), siren=F.col("siren"))
    )
    confidence = F.col("contact_confidence")
    allowed = F.when(confidence.isin(*fixed.ALLOWED_CONFIDENCE), confidence).otherwise("domain_and_pattern_only")
    sendable = F.col("usable_for_send") & F.col("best_email").isNotNull()
    return marked.withColumns(
        {
            "contact_confidence": F.when(sendable & F.col("is_suppressed"), "needs_review").otherwise(allowed),
            "email_to_set": F.when(sendable & ~F.col("is_suppressed"), F.col("best_email")),
        }
    ).drop("siren")


# --- People -----------------------------------------------------------------


def prepare_people(facts: DataFrame) -> DataFrame:
    """Person facts with normalised name and role; facts without a name are dropped.

    A ``normalized_role`` brought by the fact wins over the one of its title.
    """
    out = facts.withColumns(
        {"normalized_name": normalize_person_name(F.col("full_name")), "_role": normalize_role(F.col("job_title"))}
    )
    given = filled(F.col("normalized_role")) if "normalized_role" in facts.columns else F.lit(None).cast("string")
    out = out.withColumn("normalized_role", F.coalesce(given, F.col("_role.role")))
    out = out.withColumns(
        {
            "role_category": F.coalesce(filled(F.col("role_category")), F.col("_role.category")),
            "title_score": F.col("_role.score"),
        }
    )
    return out.filter(F.col("normalized_name") != "").drop("_role")


PERSON_KEY = ("prospect_id", "normalized_name", "normalized_role")


def merge_people(old: DataFrame, facts: DataFrame) -> DataFrame:
    """People after one run of facts, with ``is_new`` and ``seen``.

    The facts of a key are folded first, as if they had arrived one by one in
    ``ord`` order: a fact replaces title and role only when its role score is
    higher than the score reached so far, confidence only rises, the first
    profile link stays.  Then one full outer join with the old people.
    """
    keys = list(PERSON_KEY)
    prepared = prepare_people(facts)
    reached = old.select(*keys, F.col("buyer_role_score").alias("_reached"))
    scored = prepared.join(reached, keys, "left")
    fields = F.struct("full_name", "job_title", "role_category", "company_match_state")
    above = F.col("buyer_role_score") > F.col("_reached")
    folded = scored.groupBy(*keys).agg(
        F.min_by(fields, "ord").alias("_first"),
        F.min_by("buyer_role_score", "ord").alias("_first_score"),
        F.min_by(fields, F.struct(-F.col("buyer_role_score"), F.col("ord"))).alias("_best"),
        F.min_by(fields, F.when(above, F.col("ord"))).alias("_raising"),
        F.max("buyer_role_score").alias("_max_score"),
        F.max("title_score").alias("_title_score"),
        F.max("identity_confidence").alias("_confidence"),
        F.min_by("identity_confidence", "ord").alias("_first_confidence"),
        F.min_by("linkedin_url", F.when(is_filled(F.col("linkedin_url")), F.col("ord"))).alias("_linkedin"),
        F.min("ord").alias("_ord"),
    )
    joined = old.withColumn("_old", F.lit(True)).join(folded, keys, "full_outer")
    existed, touched = yes(F.col("_old")), F.col("_first").isNotNull()
    free = existed & touched & ~yes(F.col("manually_confirmed"))
    raised = free & (F.col("_max_score") > F.col("buyer_role_score"))
    beyond_title = F.col("_max_score") > F.col("_title_score")
    new_top = beyond_title & (F.col("_max_score") > F.col("_first_score"))
    source = F.when(existed, F.when(beyond_title, F.col("_best")).otherwise(F.col("_raising"))).otherwise(
        F.when(new_top, F.col("_best")).otherwise(F.col("_first"))
    )
    joined = joined.withColumn("_source", source)
    replaced = ~existed | raised

    def choose(name: str, fresh: Column) -> Column:
        return F.when(replaced, F.coalesce(fresh, F.col(name))).otherwise(F.col(name))

    split = split_name(F.col("_first.full_name"))
    new_values = {
        "full_name": F.when(existed, F.col("full_name")).otherwise(F.col("_first.full_name")),
        "first_name": F.when(existed, F.col("first_name")).otherwise(split["first"]),
        "last_name": F.when(existed, F.col("last_name")).otherwise(split["rest"]),
        "job_title": choose("job_title", F.coalesce(F.col("_source.job_title"), F.col("_first.job_title"))),
        "role_category": choose("role_category", F.col("_source.role_category")),
        "buyer_role_score": choose("buyer_role_score", F.greatest("_max_score", "_title_score")),
        "company_match_state": F.when(existed, F.col("company_match_state")).otherwise(F.col("_first.company_match_state")),
        "identity_confidence": F.when(existed & ~free, F.col("identity_confidence")).otherwise(
            F.greatest("identity_confidence", "_confidence")
        ),
        "linkedin_url": F.when(existed & ~free, F.col("linkedin_url")).otherwise(
            F.coalesce(filled(F.col("linkedin_url")), F.col("_linkedin"))
        ),
        "manually_confirmed": yes(F.col("manually_confirmed")),
        "is_active": F.coalesce("is_active", F.lit(True)),
        "id": F.coalesce("id", row_id("person", *keys)),
    }
    columns = [new_values.get(name, F.col(name)).alias(name) for name in old.columns]
    return joined.select(*columns, (~existed).alias("is_new"), touched.alias("seen"), F.col("_ord").alias("first_ord"))


def row_id(label: str, *columns: str) -> Column:
    """A stable id for a new row: reruns agree."""
    parts = [text(F.col(name).cast("string")) for name in columns]
    return F.xxhash64(F.lit(label), *parts).bitwiseAND(F.lit(2**63 - 1))


def people_by_name(people: DataFrame) -> DataFrame:
    """One person per prospect and name: the newest row, in order of first appearance."""
    arrival = F.struct("is_new", F.when(F.col("is_new"), F.col("first_ord")).alias("o"), "id")
    newest = F.max_by(F.struct("id", "full_name", "buyer_role_score"), arrival)
    order = F.min(arrival)
    return (
        people.groupBy("prospect_id", "normalized_name")
        .agg(newest.alias("p"), order.alias("ord"))
        .select("prospect_id", "normalized_name", F.col("p.id").alias("person_id"), "p.full_name", "p.buyer_role_score", "ord")
    )


def primary_person(people: DataFrame) -> DataFrame:
    """The person to talk to per prospect: confirmed, then best role, then surest identity."""
    active = people.filter(F.coalesce(F.col("is_active"), F.lit(True)))
    order = [F.desc(yes(F.col("manually_confirmed"))), F.desc("buyer_role_score"), F.desc("identity_confidence"), "id"]
    return first_per(active, ["prospect_id"], order)


# --- Contact points ---------------------------------------------------------

POINT_KEY = ("prospect_id", "kind", "value_normalized")


def point_value(kind: Column, value: Column) -> Column:
    """The stored form of a contact value; NULL for an unusable mailbox."""
    trimmed = F.trim(value)
    return first_match(
        [
            (kind == "email", normalize_email(trimmed)),
            (kind.isin("linkedin", "contact_form", "website"), F.lower(trimmed)),
        ],
        trimmed,
    )


def prepare_points(facts: DataFrame, prospects: DataFrame, suppression: DataFrame) -> DataFrame:
    """Point facts with stored value, domain, suppression, utility and source rank.

    One pass: the suppressed values are distinct, so the three lookups never
    multiply rows, and Spark broadcasts them when their size allows.
    """
    out = facts.withColumn("value_normalized", point_value(F.col("kind"), F.col("value"))).filter(
        F.col("value_normalized").isNotNull()
    )
    mailbox = F.when(F.col("kind") == "email", F.col("value_normalized"))
    listed = lambda kind: suppression.filter(F.col("kind") == kind).select(F.col("value_normalized").alias(f"_{kind}")).distinct()
    owners = prospects.select(F.col("id").alias("_owner"), F.regexp_replace("siren", "[^0-9]", "").alias("_digits"))
    owners = owners.join(listed("siren"), F.col("_digits") == F.col("_siren"), "left_semi").select("_owner").distinct()
    out = out.join(listed("email"), mailbox == F.col("_email"), "left")
    out = out.join(listed("domain"), F.substring_index(mailbox, "@", -1) == F.col("_domain"), "left")
    out = out.join(owners, F.col("prospect_id") == F.col("_owner"), "left")
    out = out.withColumns(
        {
            "is_suppressed": F.col("_email").isNotNull() | F.col("_domain").isNotNull() | F.col("_owner").isNotNull(),
            "value_display": F.when(F.col("kind") == "email", F.col("value_normalized")).otherwise(F.trim("value")),
            "domain": F.when(F.col("kind") == "email", F.substring_index("value_normalized", "@", -1)).otherwise(
                filled(url_host(F.trim("value")))
            ),
            "source_rank": source_rank(F.col("source_class")),
            "confidence": F.greatest(F.lit(0), F.least(F.lit(100), F.col("confidence"))),
        }
    )
    utility = derive_utility(
        F.col("kind"), F.col("publication_state"), F.col("deliverability_state"), F.col("person_match_state"),
        F.col("is_suppressed"),
    )
    return out.withColumn("utility_state", utility).drop("_email", "_domain", "_owner")


POINT_STATE = ("source_class", "publication_state", "person_match_state", "deliverability_state", "utility_state")


def merge_points(old: DataFrame, prepared: DataFrame) -> DataFrame:
    """Contact points after one run of prepared facts (with ``person_id``), plus ``is_new`` and ``seen``.

    Arriving one by one, a fact overwrites a point when its source ranks at
    least as high as the point's.  So a fact counts unless an earlier fact of
    its key, or the old point, has a better rank; the last counted fact sets the
    state, the highest counted confidence stays.  The earliest arrival per key
    and rank (nine ranks at most) decides this without ordering whole groups.
    """
    keys = list(POINT_KEY)
    first_seen = prepared.groupBy(*keys, "source_rank").agg(F.min("ord").alias("o"))
    ranks = first_seen.groupBy(*keys).agg(F.collect_list(F.struct(F.col("source_rank").alias("r"), "o")).alias("_ranks"))
    before = old.select(*keys, F.when(yes(F.col("manually_confirmed")) | is_filled(F.col("rejection_reason")), -1)
                        .otherwise(source_rank(F.col("source_class"))).alias("_old_rank"))
    ranks = ranks.join(before, keys, "left")
    facts = prepared.join(ranks, keys)
    beaten = F.exists("_ranks", lambda e: (e["r"] < F.col("source_rank")) & (e["o"] < F.col("ord")))
    counted = facts.filter(~beaten & F.coalesce(F.col("source_rank") <= F.col("_old_rank"), F.lit(True)))
    folded = counted.groupBy(*keys).agg(
        F.max_by(F.struct(*POINT_STATE, "is_suppressed"), "ord").alias("_last"),
        F.min_by(F.struct("value_display", "domain", "deliverability_state"), "ord").alias("_first"),
        F.max("confidence").alias("_confidence"),
        F.min_by("person_id", F.when(F.col("person_id").isNotNull(), F.col("ord"))).alias("_person"),
        F.min("ord").alias("_ord"),
    )
    seen = ranks.select(*keys, F.lit(True).alias("_seen"))
    joined = old.withColumn("_old", F.lit(True)).join(folded, keys, "full_outer").join(seen, keys, "left")
    existed, changed = yes(F.col("_old")), F.col("_last").isNotNull()
    state = {name: F.when(changed, F.col(f"_last.{name}")).otherwise(F.col(name)) for name in POINT_STATE}
    joined = joined.withColumn("_utility", state["utility_state"])
    new_values = {
        **state,
        "id": F.coalesce("id", row_id("point", *keys)),
        "person_id": F.coalesce("person_id", "_person"),
        "value_display": F.coalesce("value_display", F.col("_first.value_display")),
        "domain": F.coalesce("domain", F.col("_first.domain")),
        "verification_state": F.coalesce("verification_state", F.col("_first.deliverability_state")),
        "confidence_score": F.greatest("confidence_score", "_confidence"),
        "is_usable": F.when(changed, is_usable(F.col("_utility"))).otherwise(F.col("is_usable")),
        "requires_manual_review": F.when(changed, needs_review(F.col("_utility"))).otherwise(F.col("requires_manual_review")),
        "is_suppressed": F.when(changed, F.col("_last.is_suppressed")).otherwise(F.col("is_suppressed")),
        "manually_confirmed": yes(F.col("manually_confirmed")),
    }
    columns = [new_values.get(name, F.col(name)).alias(name) for name in old.columns]
    return joined.select(*columns, (~existed).alias("is_new"), yes(F.col("_seen")).alias("seen"), F.col("_ord").alias("first_ord"))


def available(points: DataFrame) -> DataFrame:
    return points.filter(~is_filled(F.col("rejection_reason")) & ~yes(F.col("is_suppressed")))


def point_order() -> list[Column]:
    return [
        utility_rank(F.col("utility_state")),
        kind_rank(F.col("kind")),
        F.desc(yes(F.col("manually_confirmed"))),
        F.desc(F.coalesce("confidence_score", F.lit(0))),
        F.col("id"),
    ]


def primary_point(points: DataFrame) -> DataFrame:
    """The contact point to use first per prospect."""
    return first_per(available(points), ["prospect_id"], point_order())


SUMMARY_FIELDS = ("id", "kind", "value_display", "publication_state", "deliverability_state", "person_match_state",
                  "utility_state", "requires_manual_review")


#: How many of the best contact points a prospect's own row shows; all of them are rows of ``candidate_rows``.
CANDIDATES_SHOWN = 10


def candidate_rows(points: DataFrame, n: int | None = None) -> DataFrame:
    """The contact points of every prospect from the best on, with their ``position``; ``n`` asks for the first few only."""
    return top_per(available(points), ["prospect_id"], point_order(), n, rank="position")


def candidate_summary(points: DataFrame, n: int = CANDIDATES_SHOWN) -> DataFrame:
    """The ``n`` best contact points per prospect as one array."""
    ranked = candidate_rows(points, n)
    return bounded_list(ranked, ["prospect_id"], "position", F.struct(*SUMMARY_FIELDS), "contact_candidates")


def project_primary(prospects: DataFrame, people: DataFrame, points: DataFrame) -> DataFrame:
    """Prospects with person, mailbox, phone, profile and contact state of their primaries."""
    person = primary_person(people).select(
        F.col("prospect_id").alias("id"), F.col("full_name").alias("_name"), F.col("job_title").alias("_title")
    )
    fields = ("kind", "value_normalized", "source_class", "publication_state", "person_match_state",
              "deliverability_state", "utility_state", "manually_confirmed", "requires_manual_review")
    point = primary_point(points).select(F.col("prospect_id").alias("id"), F.struct(*fields).alias("_p"))
    out = prospects.drop("contact_candidates").join(person, "id", "left").join(point, "id", "left")
    out = out.join(candidate_summary(points).withColumnRenamed("prospect_id", "id"), "id", "left")
    p, has_point, has_person = F.col("_p"), F.col("_p").isNotNull(), F.col("_name").isNotNull()
    confirmed = yes(p["manually_confirmed"])
    mail = has_point & (p["kind"] == "email") & is_usable(p["utility_state"])
    profile = has_point & (p["kind"] == "linkedin") & (confirmed | (p["publication_state"] == "published_personal"))
    inferred = (p["person_match_state"] == "exact_person_pattern_confirmed") & (p["deliverability_state"] == "deliverable")
    cases = [
        (~has_point, "none", None),
        (confirmed, "manual_confirmed", "user_supplied"),
        (p["publication_state"] == "published_personal", "published_personal", "published"),
        (p["publication_state"].isin("published_role", "published_generic"), "published_generic", "published"),
        (inferred, "deliverable", "inferred"),
    ]
    keep = lambda condition, fresh, name: F.when(condition, fresh).otherwise(F.col(name))
    out = out.withColumns(
        {
            "decision_maker_name": keep(has_person, F.col("_name"), "decision_maker_name"),
            "decision_maker_title": keep(has_person, F.col("_title"), "decision_maker_title"),
            "email": keep(mail, p["value_normalized"], "email"),
            "phone": keep(has_point & (p["kind"] == "phone"), p["value_normalized"], "phone"),
            "linkedin_url": keep(profile, p["value_normalized"], "linkedin_url"),
            "contact_source": F.when(has_point, p["source_class"]).otherwise("none"),
            "contact_confidence": first_match([(c, v) for c, v, _ in cases], "needs_review"),
            "contact_discovery_state": first_match([(c, F.lit(v).cast("string")) for c, _, v in cases], "guessed"),
            "needs_manual_review": F.when(has_point, yes(p["requires_manual_review"])).otherwise(True),
        }
    )
    return out.drop("_name", "_title", "_p")


# --- Evidence and summaries -------------------------------------------------


def link_evidence(evidence: DataFrame, people: DataFrame, points: DataFrame) -> DataFrame:
    """Evidence facts with ``person_id`` and ``contact_point_id`` found inside their prospect.

    Both lookups are reduced to one row per key, so rows never multiply.
    """
    names = people.groupBy(F.col("prospect_id").alias("_p1"), F.col("normalized_name").alias("_name")).agg(
        F.max("id").alias("person_id")
    )
    values = points.groupBy(F.col("prospect_id").alias("_p2"), F.col("value_normalized").alias("_value")).agg(
        F.max("id").alias("contact_point_id")
    )
    raw = text(F.col("contact_value"))
    out = evidence.withColumns(
        {
            "_who": filled(normalize_person_name(text(F.col("person_name")))),
            "_what": filled(F.coalesce(normalize_email(raw), F.lower(raw))),
        }
    )
    out = out.join(names, (F.col("prospect_id") == F.col("_p1")) & (F.col("_who") == F.col("_name")), "left")
    out = out.join(values, (F.col("prospect_id") == F.col("_p2")) & (F.col("_what") == F.col("_value")), "left")
    return out.drop("_p1", "_name", "_p2", "_value", "_who", "_what")


def append_contact_evidence(old: DataFrame, facts: DataFrame, people: DataFrame, points: DataFrame) -> DataFrame:
    """Rows to append: facts with an unknown fingerprint, linked and trimmed."""
    from leadloom.functions.text import contact_fingerprint

    marked = facts.withColumn(
        "fingerprint",
        contact_fingerprint(
            F.col("prospect_id"), F.col("source_adapter"), F.col("source_url"), F.col("evidence_type"),
            F.col("contact_value"), F.col("person_name"), F.col("content_hash"),
        ),
    )
    fresh = first_per(marked, ["fingerprint"], ["ord"])
    fresh = fresh.join(old.select("fingerprint"), "fingerprint", "left_anti")
    linked = link_evidence(fresh, people, points)
    return linked.withColumns(
        {
            "excerpt": filled(text(F.col("excerpt"))),
            "confidence": F.greatest(F.lit(0), F.least(F.lit(100), F.col("confidence"))),
            "source_domain": filled(url_host(text(F.col("source_url")))),
        }
    )


def source_urls(evidence: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` distinct source urls per person and per contact point."""
    owners = compact(
        [
            F.when(F.col("person_id").isNotNull(),
                   F.struct(F.lit("person").alias("owner_kind"), F.col("person_id").alias("owner_id"))),
            F.when(F.col("contact_point_id").isNotNull(),
                   F.struct(F.lit("point").alias("owner_kind"), F.col("contact_point_id").alias("owner_id"))),
        ]
    )
    rows = evidence.filter(is_filled(F.col("source_url"))).select("id", "source_url", F.explode(owners).alias("o"))
    rows = rows.select("o.*", "source_url", "id")
    seen = rows.groupBy("owner_kind", "owner_id", "source_url").agg(F.min("id").alias("first_id"))
    ranked = top_per(seen, ["owner_kind", "owner_id"], ["first_id"], n, rank="position")
    return bounded_list(ranked, ["owner_kind", "owner_id"], "position", F.col("source_url"), "source_urls")


def run_summary(points: DataFrame) -> DataFrame:
    """What a contact run found, per prospect."""
    mail = F.col("kind") == "email"
    return points.groupBy("prospect_id").agg(
        F.count(F.lit(1)).alias("contact_points"),
        F.count_if(mail & (F.col("publication_state") != "not_published")).alias("published_emails"),
        F.count_if(F.col("source_class") == "domain_pattern").alias("generated_candidates"),
        F.count_if(F.col("deliverability_state") == "deliverable").alias("verified_deliverable"),
        F.count_if(F.col("deliverability_state") == "catch_all").alias("catch_all"),
        F.count_if(F.col("deliverability_state") == "invalid").alias("invalid"),
        F.count_if(yes(F.col("requires_manual_review"))).alias("manual_review_required"),
        F.count_if(yes(F.col("is_usable")) & ~yes(F.col("is_suppressed"))).alias("usable_paths"),
    )


def dossier_order(people: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """People and points as a dossier lists them."""
    return (
        people.orderBy("prospect_id", F.desc(yes(F.col("is_primary_candidate"))), F.desc("buyer_role_score"), "id"),
        points.orderBy("prospect_id", F.desc(yes(F.col("is_primary"))), F.desc("confidence_score"), "id"),
    )


def recent_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    return top_per(runs, ["prospect_id"], [F.desc("started_at"), F.desc("id")], n, rank="run_rank")


# --- Tasks ------------------------------------------------------------------

TASK_ORIGIN = "contact_intelligence"


def desired_tasks(prospects: DataFrame, points: DataFrame, ambiguous: DataFrame | None = None) -> DataFrame:
    """The follow-up work the contact points of a prospect call for: task_type, title, notes.

    Everything is decided by flags and last notes that combine on the map side.
    """
    inferred = F.col("person_match_state").isin("name_only_guess", "pattern_inferred")
    caught = F.col("deliverability_state") == "catch_all"
    kind = F.col("kind")
    klass = first_match(
        [
            (caught, "review_catch_all_email"),
            (inferred, "review_pattern_inferred_email"),
            (kind == "phone", "call_switchboard_for_buyer"),
            (kind == "contact_form", "use_contact_form"),
        ]
    )
    note = F.concat(F.lit("Source: "), F.coalesce(filled(F.col("domain")), F.col("source_class")))
    marked = points.withColumns({"_class": klass, "_note": note})
    last_note = lambda name: F.max_by("_note", F.when(F.col("_class") == name, F.col("id"))).alias(name)
    names = ("review_catch_all_email", "review_pattern_inferred_email", "call_switchboard_for_buyer", "use_contact_form")
    flags = marked.groupBy(F.col("prospect_id").alias("id")).agg(
        F.bool_or(F.col("person_id").isNotNull()).alias("_person"),
        F.bool_or((kind == "email") & yes(F.col("is_usable"))).alias("_mail"),
        F.bool_or(kind == "linkedin").alias("_profile"),
        *[last_note(name) for name in names],
    )
    out = prospects.select("id", "company_name").join(flags, "id", "left")
    if ambiguous is not None:
        out = out.join(ambiguous.select("id", F.lit(True).alias("_ambiguous")).distinct(), "id", "left")
    else:
        out = out.withColumn("_ambiguous", F.lit(False))
    company = F.coalesce("company_name", F.lit(""))

    def task(condition: Column, kind: str, title: str, notes: Column) -> Column:
        entry = F.struct(
            F.lit(kind).alias("task_type"), F.concat(F.lit(f"{title} — "), company).alias("title"), notes.alias("notes")
        )
        return F.when(condition, entry)

    no_mail = ~yes(F.col("_mail"))
    wanted = compact(
        [
            task(yes(F.col("_ambiguous")), "resolve_domain_ambiguity", "Resolve official domain",
                 F.lit("Company/domain match is ambiguous.")),
            task(~yes(F.col("_person")), "confirm_buyer_identity", "Confirm buyer identity",
                 F.lit("No source-backed operational buyer was found.")),
            task(F.col(names[0]).isNotNull(), names[0], "Review catch-all email", F.col(names[0])),
            task(F.col(names[1]).isNotNull(), names[1], "Review inferred email", F.col(names[1])),
            task(F.col(names[2]).isNotNull() & no_mail, names[2], "Call switchboard for buyer", F.col(names[2])),
            task(F.col(names[3]).isNotNull() & no_mail, names[3], "Use official contact form", F.col(names[3])),
            task(~yes(F.col("_profile")), "confirm_linkedin_profile", "Confirm LinkedIn profile manually",
                 F.lit("Manual search only; no LinkedIn automation.")),
        ]
    )
    return out.select(F.col("id").alias("prospect_id"), F.explode(wanted).alias("t")).select("prospect_id", "t.*")


def sync_tasks(tasks: DataFrame, desired: DataFrame, processed: DataFrame, as_of: AsOf) -> DataFrame:
    """The next task table with ``change`` = created, completed or NULL.

    Open contact tasks of processed prospects that are no longer desired are
    completed; desired ones without an open task are created.
    """
    keys = ["prospect_id", "task_type"]
    wanted = desired.select(*keys, F.struct("title", "notes").alias("_wanted"))
    scope = processed.select(F.col("id").alias("_processed")).distinct()
    marked = tasks.join(scope, F.col("prospect_id") == F.col("_processed"), "left")
    managed = (F.col("origin") == TASK_ORIGIN) & (F.col("status") == "open") & F.col("_processed").isNotNull()
    marked = marked.withColumn("_managed", managed).join(wanted, keys, "left")
    close = F.col("_managed") & F.col("_wanted").isNull()
    now = when_is(as_of)
    kept = marked.withColumns(
        {
            "status": F.when(close, "completed").otherwise(F.col("status")),
            "completed_at": F.when(close, now).otherwise(F.col("completed_at")),
            "change": F.when(close, "completed"),
        }
    ).select(*tasks.columns, "change")
    open_now = tasks.filter((F.col("origin") == TASK_ORIGIN) & (F.col("status") == "open")).select(*keys).distinct()
    created = desired.join(open_now, keys, "left_anti").select(
        row_id("task", "prospect_id", "task_type").alias("id"),
        "prospect_id",
        "task_type",
        "title",
        "notes",
        F.lit("open").alias("status"),
        F.lit(TASK_ORIGIN).alias("origin"),
        F.lit(70).alias("priority"),
        now.alias("due_date"),
        F.lit("created").alias("change"),
    )
    return kept.unionByName(created.select(*[c for c in created.columns if c in kept.columns]), allowMissingColumns=True)


# --- Manual work ------------------------------------------------------------


def _latest_decisions(reviews: DataFrame, key: str) -> DataFrame:
    fields = F.struct("decision", "reason", "id")
    return reviews.filter(F.col(key).isNotNull()).groupBy("prospect_id", key).agg(
        F.max_by(fields, F.struct("created_at", "id")).alias("_review")
    )


def _newest_primary(reviews: DataFrame, key: str) -> DataFrame:
    chosen = reviews.filter(F.col(key).isNotNull() & (F.col("decision") == "primary"))
    return chosen.groupBy(F.col("prospect_id").alias("_owner")).agg(
        F.max_by(key, F.struct("created_at", "id")).alias("_primary")
    )


def review_people(people: DataFrame, reviews: DataFrame) -> DataFrame:
    """People after operator decisions: confirm, primary, reject."""
    latest = _latest_decisions(reviews, "person_id").select(
        F.col("prospect_id").alias("_rp"), F.col("person_id").alias("_rid"), "_review"
    )
    out = people.join(latest, (F.col("prospect_id") == F.col("_rp")) & (F.col("id") == F.col("_rid")), "left")
    out = out.join(_newest_primary(reviews, "person_id"), F.col("prospect_id") == F.col("_owner"), "left")
    decision = F.col("_review.decision")
    confirmed, primary = yes(decision.isin("confirm", "primary")), yes(decision == "primary")
    out = out.withColumns(
        {
            "is_active": first_match([(confirmed, True), (yes(decision == "reject"), False)], F.col("is_active")),
            "company_match_state": F.when(confirmed, "exact").otherwise(F.col("company_match_state")),
            "identity_confidence": F.when(confirmed, 100).otherwise(F.col("identity_confidence")),
            "buyer_role_score": F.when(primary, 100).otherwise(F.col("buyer_role_score")),
            "is_primary_candidate": F.when(F.col("_primary").isNotNull(), F.col("id") == F.col("_primary")).otherwise(
                F.col("is_primary_candidate")
            ),
            "manually_confirmed": yes(F.col("manually_confirmed")) | confirmed,
        }
    )
    return out.drop("_rp", "_rid", "_review", "_owner", "_primary")


def review_points(points: DataFrame, reviews: DataFrame) -> DataFrame:
    """Contact points after operator decisions: confirm, primary, reject, suppress."""
    latest = _latest_decisions(reviews, "contact_point_id").select(
        F.col("prospect_id").alias("_rp"), F.col("contact_point_id").alias("_rid"), "_review"
    )
    out = points.join(latest, (F.col("prospect_id") == F.col("_rp")) & (F.col("id") == F.col("_rid")), "left")
    out = out.join(_newest_primary(reviews, "contact_point_id"), F.col("prospect_id") == F.col("_owner"), "left")
    decision = F.col("_review.decision")
    confirmed, primary = yes(decision.isin("confirm", "primary")), yes(decision == "primary")
    rejected, suppressed = yes(decision == "reject"), yes(decision == "suppress")
    utility = derive_utility(
        F.col("kind"), F.col("publication_state"), F.col("deliverability_state"), F.col("person_match_state"),
        confirmed=F.lit(True),
    )
    reason = F.coalesce(filled(F.col("_review.reason")), F.lit("operator_rejected"))
    out = out.withColumn(
        "_utility", first_match([(confirmed, utility), (suppressed, "suppressed")], F.col("utility_state"))
    )
    out = out.withColumns(
        {
            "rejection_reason": F.when(confirmed, F.lit(None).cast("string")).when(rejected, reason).otherwise(
                F.col("rejection_reason")
            ),
            "is_usable": first_match(
                [(confirmed, is_usable(F.col("_utility"))), (rejected | suppressed, False)], F.col("is_usable")
            ),
            "requires_manual_review": F.when(confirmed | rejected, False).otherwise(F.col("requires_manual_review")),
            "is_suppressed": yes(F.col("is_suppressed")) | suppressed,
            "confidence_score": F.when(primary, 100).otherwise(F.col("confidence_score")),
            "is_primary": F.when(F.col("_primary").isNotNull(), F.col("id") == F.col("_primary")).otherwise(
                F.col("is_primary")
            ),
            "manually_confirmed": yes(F.col("manually_confirmed")) | confirmed,
            "utility_state": F.col("_utility"),
        }
    )
    return out.drop("_rp", "_rid", "_review", "_owner", "_primary", "_utility")


def review_suppression(points: DataFrame, reviews: DataFrame) -> DataFrame:
    """Suppression entries that ``suppress`` decisions ask for: mailboxes, else the person kind."""
    chosen = reviews.filter((F.col("decision") == "suppress") & F.col("contact_point_id").isNotNull())
    chosen = chosen.select(F.col("contact_point_id").alias("_rid"), F.col("prospect_id").alias("_rp"), "reason")
    hit = points.join(chosen, (F.col("id") == F.col("_rid")) & (F.col("prospect_id") == F.col("_rp")))
    return hit.select(
        F.when(F.col("kind") == "email", "email").otherwise("person").alias("kind"),
        F.col("value_normalized").alias("value"),
        F.coalesce(filled(F.col("reason")), F.lit("operator_suppressed")).alias("reason"),
        F.lit(TASK_ORIGIN).alias("source"),
    )


def cancel_suppressed_tasks(tasks: DataFrame, reviews: DataFrame, as_of: AsOf) -> DataFrame:
    """A suppressed contact point cancels the prospect's open contact tasks."""
    hit = reviews.filter((F.col("decision") == "suppress") & F.col("contact_point_id").isNotNull())
    hit = hit.select(F.col("prospect_id").alias("_hit")).distinct()
    joined = tasks.join(hit, F.col("prospect_id") == F.col("_hit"), "left")
    cancel = F.col("_hit").isNotNull() & (F.col("origin") == TASK_ORIGIN) & (F.col("status") == "open")
    return joined.withColumns(
        {
            "status": F.when(cancel, "cancelled").otherwise(F.col("status")),
            "completed_at": F.when(cancel, when_is(as_of)).otherwise(F.col("completed_at")),
        }
    ).select(*tasks.columns)


def review_audit(reviews: DataFrame, people: DataFrame, points: DataFrame) -> DataFrame:
    """One audit row per valid decision with the state it replaced."""
    who = people.select(
        F.col("id").alias("_person"), F.col("prospect_id").alias("_p1"),
        F.when(yes(F.col("manually_confirmed")), "confirmed").otherwise("unconfirmed").alias("_person_state"),
    )
    what = points.select(
        F.col("id").alias("_point"), F.col("prospect_id").alias("_p2"), F.col("utility_state").alias("_point_state")
    )
    valid = reviews.filter(F.col("decision").isin("confirm", "reject", "primary", "suppress"))
    out = valid.join(who, (F.col("person_id") == F.col("_person")) & (F.col("prospect_id") == F.col("_p1")), "left")
    out = out.join(what, (F.col("contact_point_id") == F.col("_point")) & (F.col("prospect_id") == F.col("_p2")), "left")
    found = (F.col("person_id").isNull() | F.col("_person").isNotNull()) & (
        F.col("contact_point_id").isNull() | F.col("_point").isNotNull()
    )
    return out.filter(found).select(
        *reviews.columns,
        F.coalesce("_point_state", "_person_state").alias("previous_state"),
        F.col("decision").alias("new_state"),
    )


PERSON_MATCH_OF_PUBLICATION = {
    "published_personal": "strong_person_match",
    "published_role": "role_mailbox",
    "published_generic": "generic_company_mailbox",
}


def add_manual_points(gated: DataFrame, points: DataFrame) -> DataFrame:
    """The points table after hand-entered points: inserted, or overwritten as confirmed; adds ``change``.

    ``gated`` comes from ``gate_manual_points``; rows with an error are ignored.
    Several entries of one point fold to the last.
    """
    keys = list(POINT_KEY)
    good = gated.filter(F.col("error").isNull())
    match = first_match(
        [(F.col("publication_state") == state, value) for state, value in PERSON_MATCH_OF_PUBLICATION.items()], "unknown"
    )
    good = good.withColumn("_match", match)
    entry = F.struct("publication_state", "_match", "domain", "source_url")
    folded = good.groupBy(*keys).agg(F.max_by(entry, "ord").alias("_new"))
    joined = points.withColumn("_old", F.lit(True)).join(folded, keys, "full_outer")
    existed, touched = yes(F.col("_old")), F.col("_new").isNotNull()
    utility = derive_utility(
        F.col("kind"), F.col("_new.publication_state"), F.lit("unchecked"), F.col("_new._match"), confirmed=F.lit(True)
    )
    joined = joined.withColumn("_utility", F.when(touched, utility).otherwise(F.col("utility_state")))
    put = lambda value, name: F.when(touched, value).otherwise(F.col(name))
    new_values = {
        "id": F.coalesce("id", row_id("point", *keys)),
        "value_display": put(F.col("value_normalized"), "value_display"),
        "domain": F.coalesce("domain", F.col("_new.domain")),
        "source_class": put(F.lit("manual_operator"), "source_class"),
        "publication_state": put(F.col("_new.publication_state"), "publication_state"),
        "person_match_state": put(F.col("_new._match"), "person_match_state"),
        "deliverability_state": F.coalesce("deliverability_state", F.lit("unchecked")),
        "verification_state": F.coalesce("verification_state", F.lit("unchecked")),
        "utility_state": F.col("_utility"),
        "confidence_score": put(F.lit(100), "confidence_score"),
        "manually_confirmed": touched | yes(F.col("manually_confirmed")),
        "rejection_reason": F.when(~touched, F.col("rejection_reason")),
        "is_suppressed": F.when(touched, False).otherwise(F.col("is_suppressed")),
        "is_usable": put(is_usable(F.col("_utility")), "is_usable"),
        "requires_manual_review": put(F.lit(False), "requires_manual_review"),
    }
    columns = [new_values.get(name, F.col(name)).alias(name) for name in points.columns]
    change = first_match([(touched & existed, "updated"), (touched, "created")])
    return joined.select(*columns, change.alias("change"))


def manual_point_evidence(gated: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence rows to append for hand-entered points, one per fingerprint."""
    good = gated.filter(F.col("error").isNull())
    parts = [F.col("prospect_id").cast("string"), F.lit("manual_operator"), F.col("source_url"), F.col("kind"), F.col("value_normalized")]
    marked = good.withColumn("fingerprint", F.sha2(F.concat_ws("|", *parts), 256))
    fresh = first_per(marked, ["fingerprint"], ["ord"])
    fresh = fresh.join(evidence.select("fingerprint").distinct(), "fingerprint", "left_anti")
    return fresh.select(
        "prospect_id",
        "fingerprint",
        F.lit("manual_operator").alias("source_adapter"),
        "source_url",
        F.concat(F.lit("manual_"), F.col("kind")).alias("evidence_type"),
        F.concat(F.lit("Operator-confirmed "), F.col("kind")).alias("excerpt"),
        F.lit(100).alias("confidence"),
    )
