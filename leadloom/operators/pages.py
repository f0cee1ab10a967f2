"""Contact facts from parsed pages: points, people, evidence, selection, paged documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.fixed import GENERIC_LOCALS, NAME_IN_TEXT, NOT_A_PERSON, PHONE_IN_TEXT
from leadloom.frames import first_per, top_per
from leadloom.functions.rules import any_of, compact, filled, is_filled, once, text
from leadloom.functions.text import (
    bare_host,
    classify_form,
    collapse_space,
    extract_emails,
    normalize_email,
    normalize_person_name,
    normalize_phone,
    normalize_role,
    normalize_space,
    page_priority,
    redact_email,
)

POINT_FIELDS = ("kind", "value", "publication_state", "person_match_state", "source_class", "person_name",
                "confidence", "detail")


def page_text(parts: Column) -> Column:
    return collapse_space(F.array_join(parts, " "))


def _point(kind, value, publication, match, source_class, person, confidence, detail, order) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_column(order).alias("order"),
        as_column(kind).alias("kind"),
        as_column(value).alias("value"),
        as_column(publication).alias("publication_state"),
        as_column(match).alias("person_match_state"),
        as_column(source_class).alias("source_class"),
        as_column(person).cast("string").alias("person_name"),
        as_column(confidence).cast("int").alias("confidence"),
        as_column(detail).cast("string").alias("detail"),
    )


def contact_facts(parsed: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Contact points per page: mailboxes on the page's own host, phones, forms, profiles, structured data.

    A value found several ways on one page keeps its latest find in the order
    text mailboxes, structured data, text phones, forms, profile links.  The
    points of a page are built as one array, so the pages are read once.
    """
    base = parsed.select(*keys, "url", "title", "content_hash", "links", "forms", "items", page_text(F.col("parts")).alias("text"))
    base = base.withColumn("host", bare_host(F.col("url")))
    host, title, body = F.col("host"), F.col("title"), F.col("text")
    paths = lambda scheme: F.transform(
        F.filter("links", lambda l: F.lower(l["url"]).startswith(f"{scheme}:")),
        lambda l: F.regexp_extract(l["url"], r"^[^:]*:([^?#]*)", 1),
    )
    own = lambda mail: F.regexp_replace(F.substring_index(mail, "@", -1), r"^www\.", "") == host

    def text_mail(mail: Column) -> Column:
        generic = F.substring_index(F.substring_index(mail, "@", 1), "+", 1).isin(*GENERIC_LOCALS)
        return _point(
            "email", mail, F.when(generic, "published_generic").otherwise("published_personal"),
            F.when(generic, "generic_company_mailbox").otherwise("strong_person_match"), "company_website", None,
            F.when(generic, 72).otherwise(82), None, 0,
        )

    def structured(item: Column) -> Column:
        person = item["is_person"]
        owner = F.when(person, filled(item["name"]))
        mail, phone = normalize_email(item["email"]), normalize_phone(item["telephone"])

        def item_mail(value: Column) -> Column:
            generic = F.substring_index(value, "@", 1).isin(*GENERIC_LOCALS) | ~person
            return _point(
                "email", value, F.when(generic, "published_generic").otherwise("published_personal"),
                F.when(generic, "generic_company_mailbox").otherwise("exact_person_published"), "structured_data", owner,
                88, None, 1,
            )

        mails = F.transform(F.filter(compact([mail]), own), item_mail)
        phones = F.transform(
            compact([phone]),
            lambda value: _point("phone", value, "published_generic", "generic_company_mailbox", "structured_data", None, 85,
                                 F.when(person, "personal_direct").otherwise("switchboard"), 1),
        )
        profiles = F.transform(
            F.filter(item["same_as"], lambda s: F.lower(s).contains("linkedin.com/")),
            lambda s: _point("linkedin", s, F.when(person, "published_personal").otherwise("published_generic"),
                             F.when(person, "strong_person_match").otherwise("generic_company_mailbox"), "structured_data",
                             owner, 82, None, 1),
        )
        return F.concat(mails, phones, profiles)

    def form_point(form: Column) -> Column:
        detail = F.concat_ws("|", classify_form(form["action"], title, body),
                             form["captcha"].cast("string"), F.array_join(form["inputs"], ","))
        return _point("contact_form", form["action"], "published_generic", "generic_company_mailbox", "company_website",
                      None, 70, detail, 3)

    mail_text = F.concat_ws(" ", body, F.array_join(paths("mailto"), " "))
    raw_phones = F.concat(F.regexp_extract_all(body, F.lit(PHONE_IN_TEXT), F.lit(1)), paths("tel"))
    everything = F.concat(
        F.transform(F.filter(extract_emails(mail_text), own), text_mail),
        F.flatten(F.transform("items", structured)),
        F.transform(
            F.array_compact(F.transform(raw_phones, lambda raw: normalize_phone(raw))),
            lambda value: _point("phone", value, "published_generic", "generic_company_mailbox", "company_website", None, 75,
                                 "switchboard", 2),
        ),
        F.transform("forms", form_point),
        F.transform(
            F.filter("links", lambda l: F.lower(l["url"]).contains("linkedin.com/in/")),
            lambda l: _point("linkedin", l["url"], "published_personal", "strong_person_match", "company_website", None, 75,
                             None, 4),
        ),
    )
    rows = base.select(*keys, "url", "title", "content_hash", F.explode(everything).alias("p"))
    rows = rows.select(*keys, "url", "title", "content_hash", "p.*")
    latest = F.max_by(F.struct(*POINT_FIELDS[2:], "title", "content_hash"), "order")
    folded = rows.groupBy(*keys, "url", "kind", "value").agg(latest.alias("f"))
    return folded.select(*keys, F.col("url").alias("source_url"), "kind", "value", "f.*").withColumn(
        "deliverability_state", F.lit("unchecked")
    )


def people_facts(parsed: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """People per page: structured persons, and names within two text blocks of a role.

    The best scoring role of a name wins; structured persons come first.  Roles
    and names are found inside the page's arrays, so pages are read once and
    only people become rows.
    """

    def person(name, title, position, role, state, confidence, profile) -> Column:
        return F.struct(
            name.alias("full_name"), title.alias("job_title"), position.cast("int").alias("position"), role.alias("role"),
            F.lit(state).alias("company_match_state"), F.lit(confidence).alias("identity_confidence"),
            profile.cast("string").alias("linkedin_url"),
        )

    def structured(item: Column) -> Column:
        title = filled(normalize_space(text(item["job_title"])))
        profile = F.when(item["same_as_text"].contains("linkedin.com/in/"), item["same_as_text"])
        return person(normalize_space(item["name"]), title, F.lit(-1), normalize_role(item["job_title"]), "strong", 90, profile)

    def spotted(block: Column) -> Column:
        at = block["position"]
        near = F.array_join(F.slice("parts", F.greatest(at - 1, F.lit(1)), F.when(at < 2, at + 3).otherwise(5)), " ")
        return F.transform(
            F.regexp_extract_all(near, F.lit(NAME_IN_TEXT), F.lit(1)),
            lambda name: person(normalize_space(name), block["part"], at, block["role"], "probable", 70,
                                F.lit(None)),
        )

    roles = F.filter(
        F.transform("parts", lambda part, i: F.struct(i.alias("position"), part.alias("part"), normalize_role(part).alias("role"))),
        lambda block: block["role"]["score"] >= 40,
    )
    persons = F.filter("items", lambda item: item["is_person"] & is_filled(item["name"]))
    everyone = F.concat(F.transform(persons, structured), F.flatten(F.transform(roles, spotted)))
    carried = [*keys, "url", "title", "content_hash"]
    both = parsed.select(*carried, F.explode(everyone).alias("e")).select(*carried, "e.*")
    both = both.withColumn(
        "_named",
        once(
            normalize_person_name(F.col("full_name")),
            lambda name: F.struct(name.alias("key"), (~any_of([name.contains(w) for w in NOT_A_PERSON])).alias("plausible")),
        ),
    )
    both = both.filter((F.col("_named.key") != "") & ((F.col("position") < 0) | F.col("_named.plausible")))
    scored = both.withColumns(
        {
            "name_key": F.col("_named.key"),
            "buyer_role_score": F.col("role.score"),
            "role_category": F.col("role.category"),
            "normalized_role": F.col("role.role"),
        }
    )
    # Structured persons replace each other in order; a text find needs a strictly higher score.
    order = [F.desc("buyer_role_score"), F.when(F.col("position") < 0, 0).otherwise(1), "position", "full_name"]
    best = first_per(scored, [*keys, "name_key"], order)
    return best.withColumnRenamed("url", "source_url").drop("role", "_named", "position")


def evidence_facts(points: DataFrame, people: DataFrame, keys: tuple[str, ...] = ("page_id",),
                   adapter: str = "official_website") -> DataFrame:
    """One evidence fact per contact point (mailboxes redacted) and per person."""
    kind = F.col("kind")
    from_points = points.select(
        *keys,
        F.concat(F.lit("published_"), kind).alias("evidence_type"),
        F.lit(adapter).alias("source_adapter"),
        "source_url",
        F.when(kind == "email", redact_email(F.col("value"))).otherwise(kind).alias("excerpt"),
        F.col("title").alias("page_title"),
        "confidence",
        "content_hash",
        F.col("value").alias("contact_value"),
        F.lit(None).cast("string").alias("person_name"),
    )
    from_people = people.select(
        *keys,
        F.lit("published_person").alias("evidence_type"),
        F.lit(adapter).alias("source_adapter"),
        "source_url",
        F.concat(F.col("full_name"), F.lit(" — "), F.coalesce("job_title", F.lit("role unstated"))).alias("excerpt"),
        F.col("title").alias("page_title"),
        F.col("identity_confidence").alias("confidence"),
        "content_hash",
        F.lit(None).cast("string").alias("contact_value"),
        F.col("full_name").alias("person_name"),
    )
    return from_points.unionByName(from_people)


def registry_people(prospects: DataFrame) -> DataFrame:
    """Natural persons among a company's officers as person facts."""
    rows = prospects.select(F.col("id").alias("prospect_id"), F.posexplode("dirigeants").alias("ord", "d"))
    rows = rows.filter(text(F.col("d.type_dirigeant")) != "personne morale")
    rows = rows.withColumns(
        {
            "full_name": normalize_space(F.concat_ws(" ", F.col("d.prenoms"), F.col("d.nom"))),
            "job_title": filled(normalize_space(text(F.col("d.qualite")))),
        }
    ).filter(F.col("full_name") != "")
    rows = rows.withColumn("_role", normalize_role(F.col("job_title")))
    return rows.select(
        "prospect_id", "ord", "full_name", "job_title",
        F.col("_role.category").alias("role_category"),
        F.col("_role.role").alias("normalized_role"),
        F.least(F.col("_role.score"), F.lit(78)).alias("buyer_role_score"),
        F.lit("strong").alias("company_match_state"),
        F.lit(75).alias("identity_confidence"),
        F.lit(None).cast("string").alias("linkedin_url"),
    )


def registry_evidence(people: DataFrame) -> DataFrame:
    return people.select(
        "prospect_id",
        F.lit("registry_person").alias("evidence_type"),
        F.lit("public_registry").alias("source_adapter"),
        F.lit(None).cast("string").alias("source_url"),
        F.concat(F.col("full_name"), F.lit(" — "), F.coalesce("job_title", F.lit("legal role"))).alias("excerpt"),
        F.lit(None).cast("string").alias("page_title"),
        F.lit(75).alias("confidence"),
        F.lit(None).cast("string").alias("content_hash"),
        F.lit(None).cast("string").alias("contact_value"),
        F.col("full_name").alias("person_name"),
    )


def select_pages(pages: DataFrame, max_pages: int | None = None, max_depth: int | None = None) -> DataFrame:
    """The pages of each host in the order of a crawl: best priority, then depth, then url; fragments ignored.

    ``max_pages`` and ``max_depth`` are the budget of a crawl, where there is one.  Rank narrow rows and join the page
    back by its id: every column given here is shuffled.

    ``pages`` may carry ``anchor`` and ``depth`` (0 without them).
    """
    anchor = F.col("anchor") if "anchor" in pages.columns else F.lit("")
    depth = F.col("depth") if "depth" in pages.columns else F.lit(0)
    out = pages.withColumns(
        {
            "clean_url": F.regexp_replace("url", "#.*$", ""),
            "host": bare_host(F.col("url")),
            "priority": page_priority(F.col("url"), anchor),
            "depth": depth,
        }
    ).filter(F.col("host") != "")
    out = out if max_depth is None else out.filter(F.col("depth") <= max_depth)
    order = ["priority", "depth", "url", "page_id"]
    unique = first_per(out, ["host", "clean_url"], order)
    return top_per(unique, ["host"], ["priority", "depth", "clean_url"], max_pages, rank="visit")


def of_hosts(pages: DataFrame, visits: DataFrame, hosts: DataFrame) -> DataFrame:
    """The rows of ``pages`` whose page is visited on one of the ``hosts`` (one column): joined by page, so a large host is many tasks."""
    name = hosts.columns[0]
    ids = visits.join(hosts.select(F.col(name).alias("host")).distinct(), "host", "left_semi").select("page_id")
    return pages.join(ids, "page_id", "left_semi")


def dedupe_people(people: DataFrame, owner: str, order: str) -> DataFrame:
    """First sighting of each (name, title) over the pages of an owner."""
    keyed = people.withColumns({"_n": F.lower("full_name"), "_t": F.lower(text(F.col("job_title")))})
    return first_per(keyed, [owner, "_n", "_t"], [order, F.desc("buyer_role_score"), "full_name", "source_url"]).drop("_n", "_t")


def dedupe_points(points: DataFrame, owner: str, order: str) -> DataFrame:
    """First sighting of each (kind, value) over the pages of an owner."""
    keyed = points.withColumn("_v", F.lower("value"))
    return first_per(keyed, [owner, "kind", "_v"], [order, "value", "source_url"]).drop("_v")


def dedupe_evidence(evidence: DataFrame, owner: str, order: str) -> DataFrame:
    """First sighting of each (type, url, value or person)."""
    keyed = evidence.withColumn("_what", F.coalesce(filled(F.col("contact_value")), F.col("person_name")))
    return first_per(keyed, [owner, "evidence_type", "source_url", "_what"], [order, "excerpt"]).drop("_what")


def _read_documents(doc_pages: DataFrame, max_pages: int | None, max_chars: int | None) -> tuple[DataFrame, DataFrame]:
    """Points and people of every page of paged documents.

    Text is scanned block by block like a page of paragraphs, documents of any
    length are read whole; ``max_pages`` leaves longer documents out, ``max_chars``
    cuts page texts, where a caller wants that.
    """
    pages = doc_pages
    if max_pages:
        long = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_pages)
        pages = pages.join(long.select("doc_id"), "doc_id", "left_anti")
    body = F.substring("text", 1, max_chars) if max_chars else F.col("text")
    title = F.concat(F.lit("PDF page "), F.col("page_no").cast("string"))
    blocks = F.transform(F.split(body, "\n"), normalize_space)
    empty_links = F.array().cast("array<struct<url string, anchor string>>")
    empty_forms = F.array().cast("array<struct<action string, inputs array<string>, captcha boolean>>")
    from leadloom.sources.pages import ITEM

    parsed = pages.filter(is_filled(F.col("text"))).select(
        "doc_id", "page_no", "url",
        title.alias("title"),
        F.lit(None).cast("string").alias("content_hash"),
        F.filter(F.concat(F.array(title), blocks), lambda b: b != "").alias("parts"),
        empty_links.alias("links"),
        empty_forms.alias("forms"),
        F.array().cast(f"array<{ITEM}>").alias("items"),
    )
    return contact_facts(parsed, DOCUMENT_PAGE), people_facts(parsed, DOCUMENT_PAGE)


DOCUMENT_PAGE = ("doc_id", "page_no")


def document_contacts(doc_pages: DataFrame, max_pages: int | None = None, max_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, people) of paged documents; the last page that names a value wins, its number is kept."""
    points, people = _read_documents(doc_pages, max_pages, max_chars)
    last_points = first_per(points, ["doc_id", "kind", "value"], [F.desc("page_no")])
    named = people.withColumn("_title", text(F.col("job_title")))
    last_people = first_per(named, ["doc_id", "name_key", "_title"], [F.desc("page_no")]).drop("_title")
    return last_points, last_people


def document_evidence(doc_pages: DataFrame, max_pages: int | None = None, max_chars: int | None = None) -> DataFrame:
    """An evidence row for everything every page of a document says, with the page's number."""
    points, people = _read_documents(doc_pages, max_pages, max_chars)
    return evidence_facts(points, people, DOCUMENT_PAGE, adapter="official_pdf")


