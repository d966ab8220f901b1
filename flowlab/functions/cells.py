"""Expressions on single cells: cleaning, labels, hash order."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlab import fixed

# Unicode white space, so that a blank cell means the same here as in str.strip().
_LEADING = r"^[\s\p{Z}\x1c-\x1f\x85]+"
_TRAILING = r"[\s\p{Z}\x1c-\x1f\x85]+\z"
_BLANK = r"^[\s\p{Z}\x1c-\x1f\x85]*\z"


def blank_to_null(c: Column) -> Column:
    return F.when(~c.rlike(_BLANK), c)


def sentinel_to_null(c: Column, sentinel: str = fixed.SERVICE_SENTINEL) -> Column:
    return F.nullif(c, F.lit(sentinel))


def sentinel_to_token(
    c: Column,
    sentinel: str = fixed.SERVICE_SENTINEL,
    token: str = fixed.SERVICE_UNKNOWN,
) -> Column:
    return F.when(c == sentinel, F.lit(token)).otherwise(c)


def strip(c: Column) -> Column:
    """Trim any white space, tabs included."""
    return F.regexp_replace(F.regexp_replace(c, _LEADING, ""), _TRAILING, "")


def label_code(c: Column, codes: Mapping[str, int]) -> Column:
    """Look a name up in a dictionary; an unknown name gives null."""
    pairs = [F.lit(x) for name, code in codes.items() for x in (name, code)]
    return F.try_element_at(F.create_map(*pairs), c)


def label_name(c: Column, codes: Mapping[str, int], unknown: str = "unknown") -> Column:
    """The inverse of `label_code`; an unlisted code gives ``unknown<code>``."""
    pairs = [F.lit(x) for name, code in codes.items() for x in (code, name)]
    found = F.try_element_at(F.create_map(*pairs), c)
    return F.coalesce(found, F.concat(F.lit(unknown), c.cast("string")))


def to_binary(c: Column) -> Column:
    """0 stays 0, all else (null included) becomes 1."""
    return F.when(c == 0, 0).otherwise(1)


def merge_classes(
    c: Column, classes: Iterable[int] = tuple(fixed.RARE_CLASSES), target: int = fixed.RARE_TARGET
) -> Column:
    return F.when(c.isin(*classes), target).otherwise(c)


def is_missing(c: Column, dtype: str) -> Column:
    missing = c.isNull()
    return missing | F.isnan(c) if dtype in ("double", "float") else missing


def hash_order(key: Column, seed: int = fixed.SEED) -> Column:
    """A reproducible pseudo-random order over integer keys.

    It depends on the key and the seed alone, so it is the same whatever the
    partitioning and after any retry.
    """
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))
