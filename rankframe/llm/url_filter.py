"""URL filters with dated lists: a temporal join in DataFrame operations only.

List entries come with the day on which they were added or removed. Per list and entry, the
changes in order of time become validity intervals; each capture is evaluated against the
entries that were valid when it was fetched. Entries are hosts, which cover their subdomains,
or a host and a path, which cover the paths below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and the dot of the root; null where there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.rtrim(F.lower(host), F.lit("."))
    return F.when(F.length(host) > 0, host)


def keys_of(url: Column, depth: int) -> Column:
    """All entries that would cover the URL: the host, its parents, and host and path prefixes of up to depth segments."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws(".", F.slice(labels, i, n - i + 1)))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    deep = F.least(F.size(parts), F.lit(depth))
    below = F.transform(
        F.when(deep > 0, F.sequence(F.lit(1), deep)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat_ws("/", host, F.concat_ws("/", F.slice(parts, 1, i))),
    )
    return F.when(host.isNotNull(), F.array_distinct(F.concat(parents, below)))


def depth_of(entry: Column) -> Column:
    """Segments of an entry's path."""
    return F.size(F.split(entry, "/")) - 1


def validity(changes: DataFrame) -> DataFrame:
    """(list, entry, valid_from, valid_to) from changes (list, entry, action, day).

    action is add or remove. Of several changes of an entry on one day, removal wins. An add
    while valid and a removal while not valid change nothing. valid_to is exclusive, null for
    ever. Rows with a null list, entry, action or day are no changes.
    """
    clean = changes.where("list is not null and entry is not null and day is not null and action in ('add', 'remove')")
    daily = clean.groupBy("list", "entry", "day").agg(F.min(F.col("action") == "add").alias("on"))
    w = Window.partitionBy("list", "entry").orderBy("day")
    turns = daily.withColumn("before", F.lag("on").over(w)).where("on <> coalesce(before, false)")
    ends = turns.withColumn("valid_to", F.lead("day").over(w))
    return ends.where("`on`").select("list", "entry", F.col("day").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched), each with blocked, n_lists, entry: the rows of captures.

    n_lists counts the lists with an entry valid at the fetch; entry is the most specific one
    (the longest, then the first by code point). A capture without a host or without a fetch
    time matches nothing, and so does an empty list. Repeated rows come out repeated, rows with a
    null page_id too; other columns of captures are ignored.

    Keys are made where captures are scanned, down to the path of the deepest entry (one number from
    the lists). They meet the lists' entries in an equi-join with the validity as its condition, so
    a capture yields a row per list and entry that holds, and no more. A host that holds a third of all
    captures makes a skewed join, which adaptive execution splits; matches are aggregated per
    capture before they meet the captures again.
    """
    src = captures.select("page_id", "url", F.col("fetched").cast("date").alias("fetched"))
    spans = validity(changes)
    depth = spans.agg(F.max(depth_of(F.col("entry")))).first()[0] or 0
    keyed = src.where("url is not null and fetched is not null").withColumn("key", F.explode(keys_of(F.col("url"), depth)))
    hit = keyed.join(
        spans,
        (keyed["key"] == spans["entry"])
        & (keyed["fetched"] >= spans["valid_from"])
        & (spans["valid_to"].isNull() | (keyed["fetched"] < spans["valid_to"])),
    )
    best = F.min(F.struct((-F.length("entry")).alias("n"), F.col("entry").alias("e")))["e"]
    found = hit.groupBy("page_id", "url", "fetched").agg(F.count_distinct("list").alias("n_lists"), best.alias("entry"))
    a, b = src.alias("a"), found.alias("b")
    same = F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.url") == F.col("b.url")) & (F.col("a.fetched") == F.col("b.fetched"))
    return a.join(b, same, "left").select(
        "a.page_id", "a.url", "a.fetched", F.col("b.n_lists").isNotNull().alias("blocked"),
        F.coalesce("b.n_lists", F.lit(0)).cast("long").alias("n_lists"), "b.entry",
    )
