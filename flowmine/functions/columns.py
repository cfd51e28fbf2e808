"""Small reusable column expressions (all stay inside the JVM)."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def all_of(conds: Iterable[Column]) -> Column:
    return functools.reduce(operator.and_, conds)


def any_of(conds: Iterable[Column]) -> Column:
    return functools.reduce(operator.or_, conds)


def plus(cols: Iterable[Column]) -> Column:
    return functools.reduce(operator.add, cols)


def quote(name: str) -> Column:
    """Column by exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def micros(ts: Column) -> Column:
    """Instant as whole microseconds since 1970 (UTC session)."""
    return F.unix_micros(ts.cast("timestamp"))


def seeded_order(seed: int | str, *keys: Column) -> Column:
    """Partition-independent random order: md5 of seed and row key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hash_slice(digest: Column) -> Column:
    """First three hex digits of a digest as 0..4095."""
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def hash_unit(digest: Column, start: int = 1) -> Column:
    """Eight hex digits of a digest as a number in [0, 1)."""
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def finite_or_null(c: Column) -> Column:
    """NaN and both infinities become NULL, the one missing value."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(INF)), d)


def clean_name(name: str) -> str:
    """Header cell: outer blanks dropped, inner blanks collapsed."""
    return re.sub(r"\s+", " ", name).strip()


def normalise_text(c: Column) -> Column:
    """Lower case; each run outside a-z and 0-9 becomes one blank; trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def first_present(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """First candidate spelling that is a column, else ``None``."""
    have = set(columns)
    return next((c for c in candidates if c in have), None)


def literal_map(pairs: dict, key_type: str = "string", value_type: str = "double") -> Column:
    """Typed map literal, empty maps included."""
    if not pairs:
        return F.create_map().cast(f"map<{key_type},{value_type}>")
    parts: list[Column] = []
    for k, v in pairs.items():
        parts += [F.lit(k).cast(key_type), F.lit(v).cast(value_type)]
    return F.create_map(*parts)


def lookup(pairs: dict, key: Column, default=None, value_type: str = "double") -> Column:
    """Value for ``key`` from a small fitted table, ``default`` if absent."""
    got = F.element_at(literal_map(pairs, value_type=value_type), key)
    return got if default is None else F.coalesce(got, F.lit(default).cast(value_type))


def bins_below(value: Column, edges: Sequence[float]) -> Column:
    """How many edges lie strictly below ``value``."""
    if not edges:
        return F.lit(0)
    return plus([(value > F.lit(float(e))).cast("int") for e in edges])
