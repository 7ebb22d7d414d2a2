"""Lists and arrays as cell values, and bounded strings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column

STRING_BYTES = 4088


def element(a: Column, i: int) -> Column:
    """0-based; null out of range."""
    return F.get(a, F.lit(i))


def push(a: Column, v: Column) -> Column:
    return F.array_append(a, v)


def pop(a: Column) -> Column:
    """Without the last element."""
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def prepend(a: Column, v: Column) -> Column:
    return F.array_prepend(a, v)


def insert(a: Column, i: int, v: Column) -> Column:
    """At 0-based position i."""
    return F.array_insert(a, F.lit(i + 1), v)


def move_part(dest: Column, at: int, src: Column, start: int, n: int) -> Column:
    """dest with n elements from at on replaced by those of src from start on."""
    return F.concat(F.slice(dest, 1, at), F.slice(src, start + 1, n), F.slice(dest, F.lit(at + n + 1), F.greatest(F.size(dest) - at - n, F.lit(0))))


def bounded(s: Column, size: int = STRING_BYTES) -> Column:
    """At most size - 1 characters, as a buffer with a terminator holds."""
    return F.substring(s, 1, size - 1)


def truncated(s: Column, size: int = STRING_BYTES) -> Column:
    return F.length(s) > size - 1


def remove(a: Column, i: int) -> Column:
    """Without the element at 0-based position i."""
    return F.concat(F.slice(a, 1, i), F.slice(a, F.lit(i + 2), F.greatest(F.size(a) - i - 1, F.lit(0))))


def index_of(a: Column, v: Column) -> Column:
    """0-based position of the first such element, -1 if there is none."""
    return (F.array_position(a, v) - 1).cast("long")


def fill(a: Column, v: Column) -> Column:
    """As many elements, all of one value."""
    return F.transform(a, lambda _: v)


def appended(buffer: Column, more: Column, size: int = STRING_BYTES) -> Column:
    """(text, status): more appended to a bounded buffer; status -1 and nothing but what fits where it does not fit, else 0."""
    whole = F.concat(buffer, more)
    return F.struct(bounded(whole, size).alias("text"), F.when(truncated(whole, size), -1).otherwise(0).alias("status"))
