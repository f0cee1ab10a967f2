"""Which addresses are safe to fetch: the part of the check that needs no network."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leadloom.fixed import BLOCKED_HOSTS, BLOCKED_SUFFIXES
from leadloom.functions.rules import any_of, first_match, once, yes
from leadloom.functions.text import strip

_IPV4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
# Address blocks that are not globally reachable: (first address, prefix length).
_RESERVED_BLOCKS = (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16),
                    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16),
                    ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4),
                    ("240.0.0.0", 4))
_GLOBAL_EXCEPTIONS = ("192.0.0.9", "192.0.0.10")


@F.pandas_udf(StringType())
def punycode(hosts: pd.Series) -> pd.Series:
    """ASCII spelling of an international host, NULL when it has none."""

    def encode(host: str) -> str | None:
        try:
            return host.encode("idna").decode("ascii")
        except UnicodeError:
            return None

    return hosts.map(encode, na_action="ignore")


def _number(address: str) -> int:
    value = 0
    for part in address.split("."):
        value = value * 256 + int(part)
    return value


def is_ipv4(host: Column) -> Column:
    return host.rlike(_IPV4)


def ipv4_number(host: Column) -> Column:
    """A dotted address as a number, NULL when it is none or a part exceeds 255."""
    numbers = F.transform(F.split(F.when(is_ipv4(host), host), r"\."), lambda part: part.cast("long"))
    packed = F.aggregate(numbers, F.lit(0).cast("long"), lambda total, part: total * 256 + part)
    return F.when(~F.exists(numbers, lambda part: part > 255), packed)


def is_public_number(number: Column) -> Column:
    """Is an IPv4 address, given as a number, globally reachable?"""
    blocked = any_of(
        [number.between(_number(first), _number(first) + 2 ** (32 - bits) - 1) for first, bits in _RESERVED_BLOCKS]
    )
    excepted = number.isin(*[_number(address) for address in _GLOBAL_EXCEPTIONS])
    return yes(number.isNotNull() & (~blocked | excepted))


def _split(given: Column) -> Column:
    """struct of the parts of a trimmed address; https is assumed where no scheme is given."""
    candidate = F.when(given.contains("://"), given).otherwise(F.concat(F.lit("https://"), given))
    rest = F.regexp_replace(candidate, "^[^:]*://", "")
    netloc = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    address = F.regexp_replace(netloc, "^.*@", "")
    bracketed = address.startswith("[")
    name = F.when(bracketed, F.regexp_extract(address, r"^\[([^\]]*)\]", 1)).otherwise(F.substring_index(address, ":", 1))
    port = F.when(bracketed, F.regexp_extract(address, r"^\[[^\]]*\]:?(.*)$", 1)).otherwise(
        F.regexp_extract(address, r"^[^:]*:(.*)$", 1)
    )
    return F.struct(
        (F.coalesce(given, F.lit("")) == "").alias("empty"),
        F.lower(F.substring_index(candidate, "://", 1)).alias("scheme"),
        netloc.contains("@").alias("credentials"),
        F.rtrim(F.lower(name), F.lit(".")).alias("name"),
        port.alias("port"),
        port.try_cast("long").alias("port_number"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1).alias("query"),
    )


def _judge(facts: Column) -> Column:
    """struct(url, host, reason) from the parts and the ASCII host."""
    p, host = facts["p"], facts["host"]
    name, port, number = p["name"], p["port"], p["port_number"]
    blocked = (
        (name == "")
        | name.isin(*BLOCKED_HOSTS)
        | ~name.contains(".")
        | any_of([name.endswith(suffix) for suffix in BLOCKED_SUFFIXES])
    )
    private = once(ipv4_number(host), lambda n: ~is_public_number(n))
    reason = first_match(
        [
            (p["empty"], "empty_url"),
            (~p["scheme"].isin("http", "https"), "unsupported_scheme"),
            (p["credentials"], "embedded_credentials"),
            ((port != "") & yes(~port.rlike(r"^\d+$") | (F.coalesce(number, F.lit(65536)) > 65535)), "invalid_port"),
            ((port != "") & ~number.isin(80, 443), "port_not_allowed"),
            (blocked, "blocked_hostname"),
            (host.isNull() | host.rlike(r"(^|\.)\.|[^.]{64}"), "invalid_idn"),
            (name.contains(":") | (is_ipv4(host) & private), "non_public_address"),
        ]
    )
    default_port = F.when(p["scheme"] == "http", 80).otherwise(443)
    location = F.when((port == "") | (number == default_port), host).otherwise(F.concat_ws(":", host, number.cast("string")))
    url = F.concat(
        p["scheme"],
        F.lit("://"),
        location,
        F.when(p["path"] == "", "/").otherwise(p["path"]),
        F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(""),
    )
    return once(
        reason,
        lambda r: F.struct(
            F.when(r.isNull(), url).alias("url"), F.when(r.isNull(), host).alias("host"), r.alias("reason")
        ),
    )


def with_safe_url(df: DataFrame, column: str, into: str = "safe", international: bool = True) -> DataFrame:
    """Add struct(url, host, reason): the canonical url, or why it must not be fetched.

    ``international`` spells non-ASCII hosts in punycode, which needs Python;
    without it they are refused.
    """
    parts, host = f"_{into}_parts", f"_{into}_host"
    out = df.withColumn(parts, once(strip(F.col(column)), _split))
    name = F.col(parts)["name"]
    foreign = name.rlike(r"[^\x00-\x7F]")
    spelled = F.when(foreign, punycode(F.when(foreign, name))).otherwise(name) if international else F.when(~foreign, name)
    out = out.withColumn(host, spelled)
    facts = F.struct(F.col(parts).alias("p"), F.col(host).alias("host"))
    return out.withColumn(into, once(facts, _judge)).drop(parts, host)
