"""Company registers: nested payloads to flat companies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leadloom.functions.codes import headcount_size, naf_sector, normalize_naf
from leadloom.functions.rules import filled, text, yes
from leadloom.operators.identity import best_officer, officer_full_name
from leadloom.plays import Play

OFFICER = "struct<nom string, prenoms string, qualite string, type_dirigeant string, denomination string>"
REGISTRY_SCHEMA = (
    "siren string, nom_complet string, nom_raison_sociale string, sigle string, activite_principale string, "
    "tranche_effectif_salarie string, nombre_etablissements_ouverts int, "
    "siege struct<siret string, activite_principale string, tranche_effectif_salarie string, libelle_commune string, "
    "commune string, departement string, region string, adresse string, geo_adresse string>, "
    f"dirigeants array<{OFFICER}>"
)
_UNIT = (
    "struct<statutDiffusionUniteLegale string, denominationUniteLegale string, nomUniteLegale string, "
    "prenom1UniteLegale string, activitePrincipaleUniteLegale string, trancheEffectifsUniteLegale string, "
    "etatAdministratifUniteLegale string, siteWeb string>"
)
_PERIOD = (
    "struct<etatAdministratifEtablissement string, denominationUsuelleEtablissement string, "
    "activitePrincipaleEtablissement string, trancheEffectifsEtablissement string>"
)
ESTABLISHMENT_SCHEMA = (
    f"siret string, uniteLegale {_UNIT}, periodesEtablissement array<{_PERIOD}>, "
    "statutDiffusionUniteLegale string, statutDiffusionEtablissement string, etatAdministratifEtablissement string, "
    "denominationUsuelleEtablissement string, activitePrincipaleEtablissement string, "
    "trancheEffectifsEtablissement string, siteWeb string"
)
UNIT_SCHEMA = (
    f"siren string, uniteLegale {_UNIT}, periodesUniteLegale array<{_UNIT}>, statutDiffusionUniteLegale string, "
    "denominationUniteLegale string, activitePrincipaleUniteLegale string, trancheEffectifsUniteLegale string"
)
COMPANIES_HOUSE_SCHEMA = (
    "company_number string, company_name string, title string, sic_codes array<string>, "
    "registered_office_address struct<address_line_1 string, locality string, postal_code string, country string>"
)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY_SCHEMA).json(path)


def from_payload(raw: DataFrame, schema: str, payload: str = "payload") -> DataFrame:
    """Rows of JSON texts as columns of a register's schema, through ``VARIANT``: a field the text lacks is NULL, others are ignored.

    A text that is no JSON, or a value that does not fit its field, gives NULL and not an error.
    """
    value = F.try_variant_get(F.try_parse_json(F.col(payload)), "$", f"struct<{_typed(schema)}>").alias("_payload")
    return raw.select(*[name for name in raw.columns if name != payload], value).select("*", "_payload.*").drop("_payload")


def _typed(schema: str) -> str:
    """A column list as the fields of a struct type."""
    return ", ".join(f"{field.name}: {field.dataType.simpleString()}" for field in StructType.fromDDL(schema))


UNIT_FIELDS = tuple(re.findall(r"(\w+) string", _UNIT))


def with_legal_units(establishments: DataFrame, units: DataFrame) -> DataFrame:
    """Establishments whose ``uniteLegale`` takes what it lacks from the legal unit of their siren.

    A unit's field is its own, else that of its newest period, else the one beside it.  Units are unique by siren.
    """
    own, period = F.col("uniteLegale"), F.get("periodesUniteLegale", F.lit(0))
    of_unit = lambda name: _first(own[name], period[name], *([F.col(name)] if name in units.columns else []))
    parents = units.select(F.col("siren").alias("_siren"), F.struct(*[of_unit(name).alias(name) for name in UNIT_FIELDS]).alias("_parent"))
    joined = establishments.join(parents, F.substring("siret", 1, 9) == F.col("_siren"), "left")
    both = F.struct(*[_first(F.col("uniteLegale")[name], F.col("_parent")[name]).alias(name) for name in UNIT_FIELDS])
    return joined.withColumn("uniteLegale", both).select(*establishments.columns)


def _first(*columns: Column) -> Column:
    return F.coalesce(*[filled(column) for column in columns])


def normalize_registry(raw: DataFrame, play: Play) -> DataFrame:
    """One flat company per register payload; the head office fills gaps, the best officer is picked in place."""
    office = F.col("siege")
    naf = normalize_naf(_first(F.col("activite_principale"), office["activite_principale"]))
    band = _first(F.col("tranche_effectif_salarie"), office["tranche_effectif_salarie"])
    officers = F.filter(F.coalesce("dirigeants", F.array().cast(f"array<{OFFICER}>")), lambda d: d.isNotNull())
    extra = [name for name in raw.columns if name in ("by_code", "sighting")]
    out = raw.withColumns({"_naf": naf, "_band": band, "_officers": officers})
    out = out.withColumn("_best", best_officer(F.col("_officers"), play))
    return out.select(
        "siren",
        office["siret"].alias("siret"),
        _first(F.col("nom_complet"), F.col("nom_raison_sociale"), F.col("sigle")).alias("company_name"),
        F.col("_naf").alias("naf_code"),
        naf_sector(F.col("_naf")).alias("sector"),
        headcount_size(F.col("_band")).alias("company_size"),
        F.col("_band").alias("headcount_band"),
        F.col("_officers").alias("dirigeants"),
        officer_full_name(F.col("_best")).alias("decision_maker_name"),
        filled(F.col("_best.qualite")).alias("decision_maker_title"),
        _first(office["libelle_commune"], office["commune"]).alias("city"),
        filled(F.substring(text(office["departement"]), 1, 3)).alias("department"),
        office["region"].alias("region"),
        _first(office["adresse"], office["geo_adresse"]).alias("address"),
        F.lit("diffusible").alias("diffusion_status"),
        F.col("nombre_etablissements_ouverts").alias("establishments"),
        *extra,
    )


def _undisclosed(status: Column) -> Column:
    return yes(F.upper(status).isin("P", "N") | F.lower(status).contains("partiel"))


def normalize_sirene(raw: DataFrame) -> DataFrame:
    """Establishments that may be prospected: disclosed, active, with name, code and headcount by fallback."""
    unit, period = F.col("uniteLegale"), F.get("periodesEtablissement", F.lit(0))
    unit_status = _first(unit["statutDiffusionUniteLegale"], F.col("statutDiffusionUniteLegale"))
    own_status = filled(F.col("statutDiffusionEtablissement"))
    activity = _first(
        period["etatAdministratifEtablissement"], F.col("etatAdministratifEtablissement"), unit["etatAdministratifUniteLegale"]
    )
    person = F.trim(F.concat_ws(" ", unit["prenom1UniteLegale"], unit["nomUniteLegale"]))
    name = _first(
        period["denominationUsuelleEtablissement"], unit["denominationUniteLegale"], unit["nomUniteLegale"],
        F.col("denominationUsuelleEtablissement"), person,
    )
    naf = normalize_naf(_first(
        period["activitePrincipaleEtablissement"], unit["activitePrincipaleUniteLegale"],
        F.col("activitePrincipaleEtablissement"),
    ))
    band = _first(
        F.col("trancheEffectifsEtablissement"), unit["trancheEffectifsUniteLegale"], period["trancheEffectifsEtablissement"]
    )
    open_rows = raw.filter(
        ~_undisclosed(unit_status) & ~_undisclosed(own_status) & (F.coalesce(activity, F.lit("A")) == "A")
    )
    out = open_rows.withColumns({"_naf": naf, "_band": band})
    return out.select(
        F.substring("siret", 1, 9).alias("siren"),
        "siret",
        name.alias("company_name"),
        F.col("_naf").alias("naf_code"),
        naf_sector(F.col("_naf")).alias("sector"),
        headcount_size(F.col("_band")).alias("company_size"),
        F.col("_band").alias("headcount_band"),
        _first(F.col("siteWeb"), unit["siteWeb"]).alias("website"),
        F.coalesce(unit_status, own_status, F.lit("diffusible")).alias("diffusion_status"),
    )


def normalize_legal_units(raw: DataFrame) -> DataFrame:
    """Legal units without an establishment: disclosed ones, fields of the newest period as fallback."""
    unit, period = F.col("uniteLegale"), F.get("periodesUniteLegale", F.lit(0))
    pick = lambda name: _first(unit[name], period[name], F.col(name)) if name in raw.columns else _first(unit[name], period[name])
    status = _first(F.col("statutDiffusionUniteLegale"), unit["statutDiffusionUniteLegale"], period["statutDiffusionUniteLegale"])
    naf = normalize_naf(pick("activitePrincipaleUniteLegale"))
    band = pick("trancheEffectifsUniteLegale")
    name = F.coalesce(
        _first(unit["denominationUniteLegale"], period["denominationUniteLegale"], unit["nomUniteLegale"], period["nomUniteLegale"]),
        filled(F.col("denominationUniteLegale")),
    )
    out = raw.filter(~_undisclosed(status)).withColumns({"_naf": naf, "_band": band})
    return out.select(
        "siren",
        F.lit(None).cast("string").alias("siret"),
        name.alias("company_name"),
        F.col("_naf").alias("naf_code"),
        naf_sector(F.col("_naf")).alias("sector"),
        headcount_size(F.col("_band")).alias("company_size"),
        F.col("_band").alias("headcount_band"),
        F.coalesce(status, F.lit("diffusible")).alias("diffusion_status"),
    )


def normalize_companies_house(raw: DataFrame) -> DataFrame:
    """The British register as company observations."""
    number = F.coalesce(filled(F.col("company_number")), F.col("external_id")) if "external_id" in raw.columns else F.col("company_number")
    office = F.col("registered_office_address")
    return raw.select(
        F.lit("companies_house").alias("connector_code"),
        F.coalesce(filled(F.col("company_name")), F.col("title"), F.lit("Unknown Legal Entity")).alias("company_name"),
        F.lit("GB").alias("country_code"),
        F.lit("companies_house_number").alias("identifier_scheme"),
        number.alias("identifier_value"),
        F.lit("UK_SIC_2007").alias("classification_scheme"),
        F.get("sic_codes", F.lit(0)).alias("classification_code"),
        F.struct(
            office["address_line_1"].alias("street"),
            office["locality"].alias("locality"),
            office["postal_code"].alias("postal_code"),
            F.coalesce(office["country"], F.lit("England")).alias("country"),
        ).alias("address"),
    )


