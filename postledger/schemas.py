"""Column contracts shared by all operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANDING = (
    "run_id string, fetched_at timestamp_ntz, company_id string, source_type string, "
    "source_key string, page_kind string, page_seq int, search_term string, term_ord int, "
    "request_path string, final_url string, http_status int, error string, "
    "options map<string,string>, body string"
)

# name -> (type, default)
POSTING: dict[str, tuple[str, object]] = {
    "source_id": ("string", None),
    "source_type": ("string", None),
    "source_company_id": ("string", None),
    "source_job_id": ("string", None),
    "company_name": ("string", None),
    "title": ("string", ""),
    "location": ("string", ""),
    "apply_url": ("string", ""),
    "source_url": ("string", ""),
    "date_posted": ("timestamp_ntz", None),
    "date_posted_raw": ("string", None),
    "description_text": ("string", ""),
    "employment_type": ("string", "unknown"),
    "remote_status": ("string", "unknown"),
    "salary_text": ("string", ""),
    "salary_min": ("double", None),
    "salary_max": ("double", None),
    "salary_currency": ("string", "USD"),
    "salary_period": ("string", ""),
    "department": ("string", ""),
    "team": ("string", ""),
    "workplace_type": ("string", ""),
    "content_hash": ("string", None),
    "category": ("string", ""),
    "warning_flags": ("array<string>", []),
    "raw_payload": ("string", None),
}

POSTING_KEY = ("source_id", "source_job_id")

WATCH_STATE = (
    "id string, url string, name string, content_hash string, content_text string, "
    "first_seen_at timestamp_ntz, last_checked_at timestamp_ntz, last_changed_at timestamp_ntz, "
    "last_status string, last_error string, last_added_text string"
)

COMPANY_CONFIG = (
    "id string, name string, enabled boolean, priority string, categories array<string>, "
    "locations array<string>, career_page_url string, careers_url string, notes string, "
    "email_alert_url string, manual_review boolean, "
    "sources array<struct<type string, enabled boolean, timeout_seconds int, board_token string, "
    "board_name string, site_url string, tenant string, wd_host string, site string, "
    "tags array<string>, location_overrides array<string>, parsing_config map<string,string>>>"
)

WATCH_CONFIG = (
    "id string, name string, url string, keywords array<string>, enabled boolean, timeout_seconds int"
)

RULE_CONFIG = (
    "name string, nationwide boolean, locations array<string>, include_titles array<string>, "
    "exclude_titles array<string>"
)


def typed_default(type_name: str, value: object) -> Column:
    if value == []:
        return F.array().cast(type_name)
    return F.lit(value).cast(type_name)


def as_postings(df: DataFrame, *extra: str) -> DataFrame:
    """Select the posting columns in order; absent ones get their default."""
    present = set(df.columns)
    cols = []
    for name, (type_name, default) in POSTING.items():
        if name not in present:
            cols.append(typed_default(type_name, default).alias(name))
        elif default is None or default == []:
            cols.append(F.col(name).cast(type_name).alias(name))
        else:
            cols.append(F.coalesce(F.col(name).cast(type_name), F.lit(default)).alias(name))
    return df.select(*cols, *extra)
