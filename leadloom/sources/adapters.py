"""Source adapters: every connector's records as one kind of observation, and the raw record envelope."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.rules import filled
from leadloom.sources.csv_lists import normalize_csv
from leadloom.sources.registry import normalize_companies_house

OBSERVATION_COLUMNS = ("connector_code", "company_name", "country_code", "identifier_scheme", "identifier_value",
                       "classification_scheme", "classification_code", "domain", "officer_name", "officer_title")


def _text(df: DataFrame, name: str):
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def normalize_award_obs(df: DataFrame) -> DataFrame:
    """Award holders as observations."""
    siren = filled(_text(df, "titulaire_siren"))
    return df.select(
        F.lit("decp").alias("connector_code"),
        F.coalesce(_text(df, "titulaire_nom"), F.lit("Titulaire Marché Public")).alias("company_name"),
        F.lit("FR").alias("country_code"),
        F.when(siren.isNotNull(), F.lit("siren")).alias("identifier_scheme"),
        _text(df, "titulaire_siren").alias("identifier_value"),
    )


def normalize_sirene_obs(df: DataFrame) -> DataFrame:
    """Register rows as observations; ids of nine characters are sirens, others fall back to the siret."""
    siren = F.coalesce(filled(_text(df, "siren")), _text(df, "external_id"))
    short = F.length(siren) == 9
    return df.select(
        F.lit("sirene").alias("connector_code"),
        F.coalesce(
            filled(_text(df, "nom_complet")), filled(_text(df, "nom_raison_sociale")), _text(df, "company_name"),
            F.lit("Entreprise Inconnue"),
        ).alias("company_name"),
        F.lit("FR").alias("country_code"),
        F.when(short, "siren").otherwise("siret").alias("identifier_scheme"),
        F.when(short, siren).otherwise(F.coalesce(filled(_text(df, "siret")), siren)).alias("identifier_value"),
        F.lit("FR_NAF_REV2").alias("classification_scheme"),
        F.coalesce(filled(_text(df, "activite_principale")), _text(df, "naf_code")).alias("classification_code"),
    )


def normalize_manual_obs(df: DataFrame) -> DataFrame:
    """Manual research entries as observations."""
    return df.select(
        F.lit("manual").alias("connector_code"),
        F.coalesce(_text(df, "company_name"), F.lit("Manual Target")).alias("company_name"),
        F.coalesce(_text(df, "country_code"), F.lit("GB")).alias("country_code"),
        *[_text(df, name).alias(name) for name in ("identifier_scheme", "identifier_value", "domain", "officer_name", "officer_title")],
    )


NORMALISERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "csv_import": normalize_csv,
    "companies_house": normalize_companies_house,
    "decp": normalize_award_obs,
    "sirene": normalize_sirene_obs,
    "manual": normalize_manual_obs,
}


def union_observations(*parts: DataFrame) -> DataFrame:
    """Observations of several connectors with the same columns, missing ones NULL."""
    aligned = [
        part.select(*[(F.col(c) if c in part.columns else F.lit(None).cast("string")).alias(c) for c in OBSERVATION_COLUMNS])
        for part in parts
    ]
    out = aligned[0]
    for part in aligned[1:]:
        out = out.unionByName(part)
    return out


def to_source_records(df: DataFrame, connector: str, external_id: str, record_type: str = "company") -> DataFrame:
    """The raw envelope of each row: payload as JSON and its hash."""
    payload = F.to_json(F.struct(*[F.col(name) for name in sorted(df.columns)]))
    url = F.col("source_url") if "source_url" in df.columns else F.lit(None).cast("string")
    seen = F.col("observed_at") if "observed_at" in df.columns else F.lit(None).cast("timestamp_ntz")
    out = df.select(
        F.lit(connector).alias("connector_code"),
        F.col(external_id).cast("string").alias("external_id"),
        F.lit(record_type).alias("record_type"),
        payload.alias("payload"),
        url.alias("source_url"),
        seen.alias("observed_at"),
    )
    return out.withColumn("payload_hash", F.sha2("payload", 256))


def payload_value(path: str, kind: str, payload: str = "payload") -> Column:
    """A value out of a stored envelope, NULL where the path or the type does not fit."""
    return F.try_variant_get(F.try_parse_json(F.col(payload)), path, kind)
