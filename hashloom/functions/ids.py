"""Identifiers of workers and jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES = 128


def id_status(name: Column) -> Column:
    return F.when(F.octet_length(name) == 0, "Empty").when(F.octet_length(name) > MAX_BYTES, "TooLong").otherwise("ok")


def id_message(name: Column) -> Column:
    return F.when(F.octet_length(name) == 0, "id cannot be empty").when(F.octet_length(name) > MAX_BYTES, F.concat(F.lit(f"id exceeds maximum length of {MAX_BYTES}: got "), F.octet_length(name).cast("string")))


def random_id() -> Column:
    """A random UUID; another in every run."""
    return F.uuid()


def stable_id(*parts: Column) -> Column:
    """A UUID-shaped id that the parts decide."""
    h = F.md5(F.concat_ws("\0", *[p.cast("string") for p in parts]))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
