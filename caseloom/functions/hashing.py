"""Deterministic orders, roles and folds from SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(domain: str, seed: int, value: Column) -> Column:
    """sha256 of 'domain|seed|value': a pseudo-random order that is the same everywhere."""
    return F.sha2(F.concat_ws("|", F.lit(domain), F.lit(str(seed)), value), 256)


def stable_index(namespace: str, value: Column, size: int) -> Column:
    """First four digest bytes of 'value|namespace' modulo size."""
    digest = F.sha2(F.concat_ws("|", value, F.lit(namespace)), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")


def fold_of(seed: int, value: Column, folds: int) -> Column:
    """The whole 256-bit digest of 'seed:value' modulo folds, by Horner's rule over its hex digits."""
    digits = F.split(F.sha2(F.concat(F.lit(f"{seed}:"), value), 256), "")
    digits = F.filter(digits, lambda h: h != "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, h: F.pmod(a * 16 + F.conv(h, 16, 10).cast("long"), F.lit(folds))).cast("int")


def unit_value(domain: str, seed: int, value: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits (52 bits, exact in a double) of order_key."""
    return F.conv(F.substring(order_key(domain, seed, value), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def fingerprint(values: Column) -> Column:
    """sha256 of the sorted distinct values joined by newlines; an aggregate for groups of bounded size."""
    return F.sha2(F.array_join(F.array_sort(F.collect_set(values)), "\n"), 256)
