"""Mailbox patterns: rendering a name, recognising a pattern, generating candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.fixed import ROLE_LOCAL_PARTS
from leadloom.functions.rules import is_filled, once, text
from leadloom.functions.text import collapse_space, normalize_email, normalize_person_name, strip, strip_accents

# Order matters: the first pattern that renders to the local part names it.
PATTERNS = ("firstname.lastname", "firstnamelastname", "f.lastname", "firstinitiallastname", "lastname.firstname",
            "firstname.l", "firstname", "lastname")
BLIND_PATTERNS = ("firstname.lastname", "f.lastname")


def name_tokens(name: Column) -> Column:
    """struct(first, last) of a plain name; one word counts as both."""
    plain = collapse_space(F.translate(normalize_person_name(name), "'-", ""))
    return once(
        F.split(plain, " "),
        lambda parts: F.struct(F.get(parts, F.lit(0)).alias("first"), F.element_at(parts, -1).alias("last")),
    )


def rendered(first: Column, last: Column) -> Column:
    """Array of struct(pattern, local) in pattern order."""
    initial, last_initial = F.substring(first, 1, 1), F.substring(last, 1, 1)
    dot = F.lit(".")
    forms = (
        F.concat(first, dot, last),
        F.concat(first, last),
        F.concat(initial, dot, last),
        F.concat(initial, last),
        F.concat(last, dot, first),
        F.concat(first, dot, last_initial),
        first,
        last,
    )
    return F.array(
        *[F.struct(F.lit(name).alias("pattern"), local.alias("local")) for name, local in zip(PATTERNS, forms)]
    )


def render_pattern(pattern: Column, first: Column, last: Column) -> Column:
    """Local part of one pattern, NULL for an unknown pattern."""
    forms = rendered(first, last)
    chain = None
    for index, name in enumerate(PATTERNS):
        local = forms[index]["local"]
        chain = F.when(pattern == name, local) if chain is None else chain.when(pattern == name, local)
    return chain


def matching_pattern(local: Column, first: Column, last: Column) -> Column:
    """The first pattern that renders the name to this local part, else NULL."""
    forms = rendered(first, last)
    chain = None
    for index, pattern in enumerate(PATTERNS):
        hit = forms[index]["local"] == local
        chain = F.when(hit, pattern) if chain is None else chain.when(hit, pattern)
    return F.when((first != "") & (last != ""), chain)


def identify_pattern(email: Column, name: Column) -> Column:
    """The pattern of a mailbox given its owner's full name, else NULL."""
    facts = F.struct(F.substring_index(normalize_email(email), "@", 1).alias("local"), name_tokens(name).alias("name"))
    return once(facts, lambda f: matching_pattern(f["local"], f["name"]["first"], f["name"]["last"]))


def _token(column: Column) -> Column:
    return F.regexp_replace(strip_accents(F.lower(F.trim(column))), "[^a-z0-9]", "")


def ordered_candidates(
    domain: Column, first_name: Column, last_name: Column, harvested: Column, limit: int | None = None
) -> Column:
    """Candidate mailboxes of one company in priority order: struct(email, pattern, priority).

    Harvested addresses on the domain come first, then nine spellings of the
    person, then the role mailboxes.  Within a row, so no shuffle.
    """
    facts = F.struct(
        F.lower(F.trim(domain)).alias("home"),
        _token(F.substring_index(collapse_space(first_name), " ", 1)).alias("first"),
        _token(last_name).alias("last"),
        harvested.alias("harvested"),
    )
    return once(
        facts, lambda f: _unique_candidates(_all_candidates(f["home"], f["first"], f["last"], f["harvested"]), limit)
    )


def _unique_candidates(candidates: Column, limit: int | None) -> Column:
    """Keep the first spelling of each address."""

    def distinct(items: Column) -> Column:
        emails = F.transform(items, lambda c: c["email"])
        first = F.filter(items, lambda c, i: F.array_position(emails, c["email"]) == i + 1)
        return first if limit is None else F.slice(first, 1, limit)

    return once(candidates, distinct)


def _all_candidates(home: Column, first: Column, last: Column, harvested: Column) -> Column:
    initial = F.substring(first, 1, 1)
    spellings = (
        ("prenom.nom", F.concat(first, F.lit("."), last)),
        ("p.nom", F.concat(initial, F.lit("."), last)),
        ("prenomnom", F.concat(first, last)),
        ("nom.prenom", F.concat(last, F.lit("."), first)),
        ("prenom_nom", F.concat(first, F.lit("_"), last)),
        ("pnom", F.concat(initial, last)),
        ("nomp", F.concat(last, initial)),
        ("nom", last),
        ("prenom", first),
    )

    def entry(email: Column, pattern: str, priority: int) -> Column:
        return F.struct(email.alias("email"), F.lit(pattern).alias("pattern"), F.lit(priority).alias("priority"))

    found = F.transform(
        F.filter(
            F.transform(F.coalesce(harvested, F.array().cast("array<string>")), lambda e: F.lower(F.trim(text(e)))),
            lambda e: e.endswith(F.concat(F.lit("@"), home)),
        ),
        lambda e: entry(e, "raw", 0),
    )
    named = F.array(
        *[entry(F.concat(local, F.lit("@"), home), pattern, rank) for rank, (pattern, local) in enumerate(spellings, 1)]
    )
    nobody = F.slice(named, 1, 0)
    personal = F.when(is_filled(first) & is_filled(last), named).otherwise(nobody)
    roles = F.array(
        *[entry(F.concat(F.lit(f"{role}@"), home), f"role:{role}", 20 + i) for i, role in enumerate(ROLE_LOCAL_PARTS)]
    )
    return F.when(is_filled(home), F.concat(found, personal, roles))


def on_domain(local: Column, domain: Column) -> Column:
    return normalize_email(F.concat(local, F.lit("@"), strip(domain)))
