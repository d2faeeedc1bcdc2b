"""Stored responses: one row per response, with its body."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LANDING, as_postings
from ..functions.text import content_hash, source_id


def read_landing(spark: SparkSession, path: str, run_id: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Read landed responses; ``run_id`` is a partition filter."""
    df = spark.read.schema(LANDING).format(fmt).load(path)
    return df if run_id is None else df.filter(F.col("run_id") == run_id)


def attach_options(landing: DataFrame, sources: DataFrame) -> DataFrame:
    """Give each stored response the options of its source: those landed with it,
    under those of the registry (its free options, then tenant, host and site)."""
    none = F.create_map().cast("map<string,string>")
    where = F.map_filter(F.create_map(*[x for c in ("tenant", "wd_host", "site") for x in (F.lit(c), F.col(c))]), lambda k, v: v.isNotNull())
    registered = sources.select(
        "company_id", F.col("type").alias("source_type"), _over(F.coalesce("parsing_config", none), where).alias("_registered"))
    names = [c for c in landing.columns]
    joined = landing.join(registered, ["company_id", "source_type"], "left")
    merged = _over(F.coalesce("options", none), F.coalesce("_registered", none))
    return joined.withColumn("options", merged).select(*names)


def _over(base: Column, top: Column) -> Column:
    """Both maps as one; ``top`` wins."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(top), k)), top)


def option(name: str, default: str | None = None) -> Column:
    value = F.element_at(F.col("options"), name)
    return value if default is None else F.coalesce(value, F.lit(default))


def option_is_on(name: str) -> Column:
    return F.lower(option(name, "false")).isin("true", "1", "yes")


def responses(landing: DataFrame, source_type: str, page_kind: str) -> DataFrame:
    """Usable responses of one kind. Failed ones yield no rows here and are
    counted by the source roll-up."""
    return landing.filter(
        (F.col("source_type") == source_type)
        & (F.col("page_kind") == page_kind)
        & F.col("http_status").between(200, 299)
        & F.col("error").isNull()
    )


# --- fixed values: what the body of a response must be, by source type and kind of page; pages of HTML are always readable ---
CONTAINERS = {
    ("greenhouse", "board"): "object",
    ("lever", "board"): "array",
    ("ashby", "board"): "object",
    ("workday", "search"): "object",
    ("workday", "detail"): "object",
}
_OPENING = {"object": "{", "array": "["}
_SPACE = " \t\n\x0b\f\r"
# -----------------------------------------------------------------------------------


def _opens(container: str) -> Column:
    # no regular expression, which would decode the whole body for its first character
    return F.ltrim("body", F.lit(_SPACE)).startswith(_OPENING[container])


def unreadable() -> Column:
    """Why the body of a successful response cannot be decoded; null for readable ones.

    A response with an HTTP success may still hold a maintenance page, a cut-off
    text or another shape than its source publishes. A null body was not kept,
    so it is not judged. The body is parsed once, as a whole.
    """
    parsed = F.try_parse_json("body").isNotNull()
    reason = F.lit(None).cast("string")
    for (kind, page), container in CONTAINERS.items():
        wanted = (F.col("source_type") == kind) & (F.col("page_kind") == page)
        why = (F.when(F.col("body").rlike(r"^\s*$"), "empty body")
               .when(~parsed, "body is not JSON")
               .when(~_opens(container), f"body is not an {container}"))
        reason = F.when(wanted, why).otherwise(reason)
    usable = F.col("http_status").between(200, 299) & F.col("error").isNull() & F.col("body").isNotNull()
    return F.when(usable, reason)


def judged(landing: DataFrame) -> DataFrame:
    """Every response without its body, with the reason ``unreadable`` or null. Roll-ups take it in place of the landing."""
    return landing.withColumn("unreadable", unreadable()).drop("body")


def unreadable_responses(landing: DataFrame) -> DataFrame:
    """Responses put aside because their body cannot be decoded; ``landing`` may be judged already."""
    rows = landing if "unreadable" in landing.columns else judged(landing)
    return rows.filter(F.col("unreadable").isNotNull()).select(
        "run_id", source_id(F.col("company_id"), F.col("source_type")).alias("source_id"), "page_kind", "page_seq",
        "search_term", "request_path", F.col("unreadable").alias("reject_reason"))


def json_elements(pages: DataFrame, array_path: str | None, element: str, retain_raw: bool) -> DataFrame:
    """One row per element of a JSON array, as struct ``j`` and text ``raw``.

    ``array_path`` names the field that holds the array; None means the body is
    the array. The array is parsed once; only ``retain_raw`` keeps each
    element's own text, which costs a second parse.
    """
    body = F.when(_opens("object" if array_path else "array"), F.col("body"))
    item = "string" if retain_raw else element
    if array_path:
        items = F.from_json(body, f"struct<{array_path}: array<{item}>>")[array_path]
    else:
        items = F.from_json(body, f"array<{item}>")
    rows = pages.select(
        "run_id", "fetched_at", "company_id", "source_type", "source_key", "options",
        # an inner explode would parse the body a second time, for a size filter
        F.posexplode_outer(items).alias("pos", "item"),
    ).filter(F.col("pos").isNotNull())
    if retain_raw:
        keep = F.when(option_is_on("store_raw"), F.col("item"))
        return rows.withColumn("raw", keep).withColumn("j", F.from_json("item", element)).drop("item")
    return rows.withColumnRenamed("item", "j").withColumn("raw", F.lit(None).cast("string"))


def finish(df: DataFrame) -> DataFrame:
    """Common end of every decoder: keys, content hash and the reject reason."""
    hashed = df.withColumns({
        "source_company_id": F.col("company_id"),
        "source_id": source_id(F.col("company_id"), F.col("source_type")),
        "raw_payload": F.col("raw"),
        "content_hash": content_hash(F.col("company_name"), F.col("title"), F.col("location"),
                                     F.col("description_text"), F.col("apply_url")),
    })
    position = F.col("pos") if "pos" in df.columns else F.lit(0)
    ordered = hashed.withColumn("ingest_order", F.struct("fetched_at", position.cast("long").alias("pos")))
    return as_postings(ordered, "run_id", "ingest_order", "reject_reason")


def missing_id(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("missing id"))


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(decoded: DataFrame) -> DataFrame:
    """Rows put aside, with the reason."""
    return decoded.filter(F.col("reject_reason").isNotNull()).select(
        "run_id", "source_id", "source_job_id", "title", "reject_reason"
    )
