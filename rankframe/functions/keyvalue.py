"""Typed key-value stores as map columns: string to struct (t, i, g, s), t being i, g or s."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql.column import Column

_FIELD = {"i": "bigint", "g": "double", "s": "string"}


def entry(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("t"), *[(value if k == kind else F.lit(None)).cast(t).alias(k) for k, t in _FIELD.items()])


def build(entries: list[tuple[str, str, Column]]) -> Column:
    """A store of (key, kind, value); of equal keys the later wins."""
    last = {k: entry(kind, v) for k, kind, v in entries}
    return F.map_from_arrays(F.array(*[F.lit(k) for k in last]), F.array(*last.values()))


def kind_of(kv: Column, key: str) -> Column:
    """i, g, s, or null without the key."""
    return F.try_element_at(kv, F.lit(key))["t"]


def get(kv: Column, key: str, kind: str, default) -> Column:
    """The value, or the default without the key; null if the key has another kind."""
    e = F.try_element_at(kv, F.lit(key))
    return F.when(e.isNull(), F.lit(default).cast(_FIELD[kind])).when(e["t"] == kind, e[kind])


def status(kv: Column, key: str, kind: str) -> Column:
    """0 present, 1 missing, 2 of another kind."""
    e = F.try_element_at(kv, F.lit(key))
    return F.when(e.isNull(), 1).when(e["t"] == kind, 0).otherwise(2)


def put(kv: Column, key: str, kind: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(kv, lambda k, _: k != key), F.map_from_arrays(F.array(F.lit(key)), F.array(entry(kind, value))))


def unset(kv: Column, key: str) -> Column:
    return F.map_filter(kv, lambda k, _: k != key)


def visit(kv: Column, goes_on: Callable[[Column, Column], Column]) -> Column:
    """The entries (key, value) that a walk in the order of keys visits: all up to the first for which goes_on is not true, and that one."""
    entries = F.array_sort(F.map_entries(kv))
    stops = F.transform(entries, lambda e: ~F.coalesce(goes_on(e["key"], e["value"]), F.lit(False)))
    at = F.array_position(stops, F.lit(True)).cast("int")
    return F.when(at > 0, F.slice(entries, F.lit(1), at)).otherwise(entries)
