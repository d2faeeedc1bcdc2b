"""Configuration tables: companies, their sources, watched pages and search rules.

Inputs are rows of the configuration in ``COMPANY_CONFIG``, ``WATCH_CONFIG`` and
``RULE_CONFIG`` form, for example read from JSON with an explicit schema.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import SearchRule
from ..functions.text import source_id
from ..schemas import COMPANY_CONFIG, RULE_CONFIG, WATCH_CONFIG

# --- fixed values: defaults ----------------------------------------------------------
TIMEOUT_SECONDS = 30
PRIORITY = "medium"
# -------------------------------------------------------------------------------------


def read_config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_registry(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Companies and sources with defaults filled in."""
    on = F.lit(True)
    companies = raw.select(
        "id",
        F.coalesce("name", "id").alias("name"),
        F.coalesce("enabled", on).alias("enabled"),
        F.coalesce("priority", F.lit(PRIORITY)).alias("priority"),
        F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
        F.coalesce("locations", F.array().cast("array<string>")).alias("locations"),
        F.coalesce(F.col("career_page_url"), F.col("careers_url")).alias("career_page_url"),
        F.coalesce("notes", F.lit("")).alias("notes"),
        F.coalesce("manual_review", F.lit(False)).alias("manual_review"),
    )
    sources = (
        raw.select(F.col("id").alias("company_id"), F.explode("sources").alias("s"))
        .select("company_id", "s.*")
        .withColumns({
            "source_id": source_id(F.col("company_id"), F.col("type")),
            "enabled": F.coalesce("enabled", on),
            "timeout_seconds": F.coalesce("timeout_seconds", F.lit(TIMEOUT_SECONDS)),
            "source_key": F.coalesce("board_token", "board_name", "site_url", "tenant"),
        })
    )
    return companies, sources


def enabled_sources(companies: DataFrame, sources: DataFrame, company: str | None = None,
                    source_type: str | None = None) -> DataFrame:
    """Sources in the scope of a run."""
    chosen = companies.filter("enabled")
    if company is not None:
        chosen = chosen.filter(F.col("id") == company)
    wanted = sources.filter("enabled")
    if source_type is not None:
        wanted = wanted.filter(F.col("type") == source_type)
    return wanted.join(chosen.select(F.col("id").alias("company_id")), "company_id", "left_semi")


def read_watches(raw: DataFrame) -> DataFrame:
    """Enabled watches with defaults."""
    return raw.filter(F.coalesce("enabled", F.lit(True))).select(
        "id", F.coalesce("name", "id").alias("name"), "url",
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
        F.coalesce("timeout_seconds", F.lit(TIMEOUT_SECONDS)).alias("timeout_seconds"),
    )


def no_watches(spark: SparkSession) -> DataFrame:
    """An absent watch list means that nothing is watched."""
    return read_watches(spark.createDataFrame([], WATCH_CONFIG))


def search_rules(config: dict[str, dict]) -> tuple[SearchRule, ...]:
    """Rule objects from configuration. Rules become column expressions, so they
    stay on the driver; only postings are distributed."""
    return tuple(
        SearchRule(name, bool(r.get("nationwide", False)), tuple(r.get("locations", ())),
                   tuple(r.get("include_titles", ())), tuple(r.get("exclude_titles", ())))
        for name, r in config.items()
    )


def rule_patterns(raw: DataFrame) -> DataFrame:
    """One row per rule and pattern, for inspection next to the data."""
    kinds = {"location": "locations", "include": "include_titles", "exclude": "exclude_titles"}
    parts = [
        raw.select("name", F.coalesce("nationwide", F.lit(False)).alias("nationwide"),
                   F.lit(kind).alias("kind"), F.explode(col).alias("pattern"))
        for kind, col in kinds.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


__all__ = ["COMPANY_CONFIG", "RULE_CONFIG", "WATCH_CONFIG", "enabled_sources", "no_watches", "read_config",
           "read_registry", "read_watches", "rule_patterns", "search_rules"]
