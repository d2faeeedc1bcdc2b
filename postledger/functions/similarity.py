"""Similarity of two postings, in points out of 100."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: points of each part ------------------------------------------
COMPANY_POINTS = 30
TITLE_POINTS = 40
LOCATION_POINTS = 20
APPLY_URL_POINTS = 10
SOURCE_URL_POINTS = 9
# ---------------------------------------------------------------------------------


def string_similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, else 1 - edit distance / longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest)


def score(company_equal: Column, title_similarity: Column, location_equal: Column,
          same_apply_url: Column, same_source_url: Column) -> Column:
    """Score between 0 and 1. Points are whole numbers, so a sum such as
    30 + 40 + 10 meets a threshold of 0.8 exactly."""
    points = (
        F.when(company_equal, F.lit(COMPANY_POINTS)).otherwise(F.lit(0))
        + title_similarity * TITLE_POINTS
        + F.when(location_equal, F.lit(LOCATION_POINTS)).otherwise(F.lit(0))
        + F.when(same_apply_url, F.lit(APPLY_URL_POINTS))
        .when(same_source_url, F.lit(SOURCE_URL_POINTS)).otherwise(F.lit(0))
    )
    return F.round(points, 6) / 100
