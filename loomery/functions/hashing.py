"""Hash ranks, buckets and order-aware digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha(text: Column) -> Column:
    """Hex digest of the UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def salted_rank(salt: str, digest: Column) -> Column:
    """Hex digest of salt and the bytes of a hex digest: an order that only salt and content decide."""
    return F.sha2(F.concat(F.lit(salt).cast("binary"), F.unhex(digest)), 256)


def bucket(digest: Column, digits: int, modulus: int) -> Column:
    """The first hex digits as an integer, modulo ``modulus``."""
    return F.pmod(F.conv(F.substring(digest, 1, digits), 16, 10).cast("decimal(20,0)"), F.lit(modulus).cast("decimal(20,0)")).cast("int")


def ordered_digest(order: Column, digest: Column) -> Column:
    """Aggregate: digest of the concatenated digests in the given order. One value holds 32 bytes a row: use it per bounded group."""
    rows = F.sort_array(F.collect_list(F.struct(order.alias("o"), digest.alias("d"))))
    return F.sha2(F.unhex(F.array_join(F.transform(rows, lambda x: x["d"]), "")), 256)


def git_blob(content: Column) -> Column:
    """The version-control blob id of a text."""
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(content).cast("string")).cast("binary"), F.unhex(F.lit("00")), content.cast("binary")))
