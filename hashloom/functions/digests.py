"""Digests: a lowercase SHA-256 and a length in bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hashloom.schemas import DIGEST

HEX_LENGTH = 64
#: Statuses in the order in which they are tested.
OK, BAD_LENGTH, BAD_HEX, BAD_SIZE, WRONG_SIZE, WRONG_HASH = "ok", "InvalidLength", "InvalidHex", "NegativeSize", "SizeMismatch", "HashMismatch"


def hash_of(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def size_of(data: Column) -> Column:
    return F.octet_length(data).cast("long")


def digest_of(data: Column) -> Column:
    """``struct(hash, size_bytes)`` of a string's UTF-8 or of binary data."""
    return F.struct(hash_of(data).alias("hash"), size_of(data).alias("size_bytes"))


def shape_status(hash_: Column, size: Column) -> Column:
    """``ok`` or the first of the shape's faults: length in bytes, hex digits, sign."""
    # The length comes first, so a trailing newline can't slip past the end of the pattern.
    return F.when(F.octet_length(hash_) != HEX_LENGTH, BAD_LENGTH).when(~hash_.rlike(r"\A[0-9a-f]+\z"), BAD_HEX).when(size < 0, BAD_SIZE).otherwise(OK)


def content_status(hash_: Column, size: Column, data: Column) -> Column:
    """Shape first, then the size, then the hash of the content."""
    shape = shape_status(hash_, size)
    return F.when(shape != OK, shape).when(size_of(data) != size, WRONG_SIZE).when(hash_of(data) != hash_, WRONG_HASH).otherwise(OK)


def message(status: Column, hash_: Column, size: Column, data: Column | None = None) -> Column:
    """The text of a status; null where it is ``ok``."""
    text = (
        F.when(status == BAD_LENGTH, F.concat(F.lit("digest hash must be 64 hex chars, got "), F.octet_length(hash_).cast("string")))
        .when(status == BAD_HEX, F.concat(F.lit("digest hash must be lowercase hex: "), hash_))
        .when(status == BAD_SIZE, F.concat(F.lit("digest size must be non-negative, got "), size.cast("string")))
    )
    if data is not None:
        text = text.when(status == WRONG_SIZE, F.concat(F.lit("digest size mismatch: declared "), size.cast("string"), F.lit(", actual "), size_of(data).cast("string"))).when(
            status == WRONG_HASH, F.concat(F.lit("digest mismatch: declared "), hash_, F.lit(", actual "), hash_of(data))
        )
    return text


def required(hash_: Column, size: Column) -> Column:
    """``struct(hash, size_bytes)``; a wrong shape fails the whole query."""
    status = shape_status(hash_, size)
    bad = F.raise_error(F.coalesce(message(status, hash_, size), F.lit("digest is missing"))).cast(DIGEST)
    return F.when(F.coalesce(status == OK, F.lit(False)) & hash_.isNotNull() & size.isNotNull(), F.struct(hash_.alias("hash"), size.cast("long").alias("size_bytes"))).otherwise(bad)


def format_digest(hash_: Column, size: Column) -> Column:
    return F.concat(hash_, F.lit("/"), size.cast("string"))


def parse_digest(text: Column) -> Column:
    """``struct(hash, size_bytes, status)`` of ``<hex>/<size>``; cut at the first slash, no spaces, a sign may lead the size."""
    parts = F.split(text, "/", 2)
    head, tail = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    size = F.when(tail.rlike(r"\A[+-]?[0-9]+\z"), F.expr("1") * tail.try_cast("long"))
    status = F.when(tail.isNull(), "MissingSeparator").when(size.isNull(), "InvalidSize").otherwise(shape_status(head, size))
    return F.struct(head.alias("hash"), size.alias("size_bytes"), status.alias("status"))


def digest_by(function: str, data: Column) -> Column:
    """Lowercase hex of the protocol's digest functions that Spark has built in."""
    raw = data.cast("binary")
    made = {
        "SHA256": lambda: F.sha2(raw, 256), "SHA1": lambda: F.sha1(raw), "MD5": lambda: F.md5(raw), "SHA384": lambda: F.sha2(raw, 384), "SHA512": lambda: F.sha2(raw, 512),
        "GITSHA1": lambda: F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(raw).cast("string"), F.lit("\0")).cast("binary"), raw)),
    }
    if function not in made:
        raise ValueError(f"no built-in digest function {function}")
    return made[function]()
