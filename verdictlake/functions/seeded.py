"""Seeded orders and draws: functions of the content alone, so that reruns and larger inputs draw the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rank_hash(seed: int, label: str, key: Column) -> Column:
    """The universal seeded order: hex SHA-256 of seed:label:key."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(label), key.cast("string")), 256)


def uniform(seed: int, label: str, key: Column) -> Column:
    """A draw in [0, 1): the first 13 hex digits, exact in a double."""
    return F.conv(F.substring(rank_hash(seed, label, key), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def in_share(seed: int, label: str, key: Column, share: float, divisor: int = 1 << 32) -> Column:
    """Whether the first 8 hex digits over the divisor are below the share (audits: 2**32, hold-outs: 2**32 - 1)."""
    return F.conv(F.substring(rank_hash(seed, label, key), 1, 8), 16, 10).cast("double") / F.lit(float(divisor)) < share


def half(seed: int, label: str, key: Column) -> Column:
    """0 or 1: parity of the whole hash."""
    return (F.conv(F.substring(rank_hash(seed, label, key), 64, 1), 16, 10).cast("int") % 2).cast("int")


def half_of_first_digits(seed: int, label: str, key: Column) -> Column:
    """0 or 1: parity of the first 8 hex digits, which is that of the eighth."""
    return F.conv(F.substring(rank_hash(seed, label, key), 8, 1), 16, 10).cast("long") % 2


def content_id(normalized: Column) -> Column:
    return F.substring(F.sha2(normalized, 256), 1, 16)
