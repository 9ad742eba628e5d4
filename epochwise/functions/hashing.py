"""Stable hashes and seeded draws that do not depend on order or partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_63 = 9223372036854775808.0


def _joined(parts: tuple) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def stable_hash(*parts, length: int = 16) -> Column:
    """First ``length`` hex digits of sha256 over the ``|``-joined parts."""
    return F.substring(F.sha2(_joined(parts), 256), 1, length)


def stable_seed(*parts) -> Column:
    """63-bit seed: the leading 8 digest bytes modulo 2**63, as bigint."""
    digest = F.sha2(_joined(parts), 256)
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % (1 << 31)
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint")
    return high * (1 << 32) + low


def uniform(*parts) -> Column:
    """Deterministic draw in [0, 1) for the given key parts."""
    return stable_seed(*parts).cast("double") / F.lit(_TWO_63)


def anonymised(value: Column, length: int = 8) -> Column:
    """Short digest of an identifier, safe to show in logs."""
    return F.substring(F.sha2(value.cast("string"), 256), 1, length)
