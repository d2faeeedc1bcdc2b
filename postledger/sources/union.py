"""All decoders behind one function."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from ..functions.predicates import LocationFilter
from .boards import ashby_rows, greenhouse_rows, lever_rows
from .jsonld import jsonld_rows
from .landing import accepted, rejected
from .workday import workday_rows

# A user adds a source type by adding a decoder here or passing an own mapping.
DECODERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "greenhouse": greenhouse_rows,
    "lever": lever_rows,
    "ashby": ashby_rows,
    "jsonld": jsonld_rows,
    "workday": workday_rows,
}


def decode_all(landing: DataFrame, decoders: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
               where: LocationFilter | None = None, retain_raw: bool = False) -> DataFrame:
    """Rows of every source type, good and rejected. A payload that one decoder
    cannot read yields no rows and does not touch the others."""
    parts = []
    for name, decode in (decoders or DECODERS).items():
        extra = {"where": where} if decode is workday_rows else {}
        parts.append(decode(landing, retain_raw=retain_raw, **extra))
    return reduce(DataFrame.unionByName, parts)


def union_sources(landing: DataFrame, **kwargs) -> DataFrame:
    """One posting table over all source types."""
    return accepted(decode_all(landing, **kwargs))


def quarantine(landing: DataFrame, **kwargs) -> DataFrame:
    """Rows put aside by any decoder."""
    return rejected(decode_all(landing, **kwargs))
