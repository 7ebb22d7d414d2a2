"""Further queries: bytes and files, section files, options, records, containers, streams. They register themselves with the others."""

from __future__ import annotations

import errno

from pyspark.sql import functions as F

from rankframe.functions import arrays, camera, hashing, mathx, u128
from rankframe.functions import keyvalue as kv
from rankframe.operators import exchange, group, lookup, order, reduce, stats
from rankframe.plans.catalog import _EDGES, _EYE, _POINTS, _SLOTS, _edges, _points, _query, _t, slot_operations
from rankframe.sources import bytesio, options, scda
from rankframe.sources.shared import new_path
from rankframe.streaming import events as streaming

# ---- bytes and files


@_query("""SELECT doc_id, n AS bytes_in, (n + 31) // 32 * 32 AS padded, substr(hex(d) , 1, CAST(2 * least(n, 5) AS INTEGER)) AS head, greatest(n - 5, 0) AS rest, true AS short
FROM (SELECT doc_id, strlen(text) AS n, encode(text) AS d FROM documents)""")
def bytes_sink_source(spark, sf):
    got = _t(spark, sf, "documents").select("doc_id", bytesio.through_bytes(32, 5)(F.col("text").cast("binary")).alias("r"))
    return got.select("doc_id", "r.bytes_in", "r.padded", F.hex("r.head").alias("head"), "r.rest", "r.short")


@_query("SELECT 'c' || CAST(c_custkey AS VARCHAR) AS name, strlen(c_name) AS written, strlen(c_name) AS bytes, c_name AS back FROM customer")
def files_round_trip(spark, sf):
    folder = new_path(spark, "files")
    t = _t(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"), F.col("c_name").cast("binary").alias("content"))
    bytesio.write_files(t, folder, "name", "content").write.parquet(f"{folder}-counts")
    written = spark.read.parquet(f"{folder}-counts").withColumnRenamed("bytes", "written")
    back = bytesio.load_files(spark, folder).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.octet_length("content").cast("long").alias("bytes"), F.col("content").cast("string").alias("back"))
    return written.join(back, "name")


@_query("""WITH f AS (SELECT string_agg(lpad(CAST(s_suppkey AS VARCHAR), 8, '0'), '' ORDER BY s_suppkey) AS s FROM supplier)
SELECT l_suppkey, l_suppkey * 5 AS offset, substr(s, CAST(l_suppkey * 5 + 1 AS INTEGER), 12) AS data, 'success' AS error FROM (SELECT DISTINCT l_suppkey FROM lineitem), f""")
def file_read_at(spark, sf):
    folder = new_path(spark, "elements")
    one = _t(spark, sf, "supplier").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s_suppkey")), lambda k: F.lpad(k.cast("string"), 8, "0")), "").alias("all"))
    bytesio.write_files(one.select(F.lit("data").alias("name"), F.col("all").cast("binary").alias("content")), folder, "name", "content").write.format("noop").mode("overwrite").save()
    asked = _t(spark, sf, "lineitem").select("l_suppkey").distinct().select("l_suppkey", (F.col("l_suppkey") * 5).alias("offset"), F.lit(12).alias("n"))
    return bytesio.read_at(asked, f"{folder}/data", "offset", "n").select("l_suppkey", "offset", F.col("data").cast("string").alias("data"), "error")


@_query("SELECT n_nationkey AS code, CASE n_nationkey WHEN 0 THEN 'success' " + " ".join(
    f"WHEN {getattr(errno, e)} THEN '{k}'" for k, es in (("file", "EBADF"), ("no_such_file", "ENOENT"), ("file_exists", "EEXIST"), ("bad_file", "EFAULT EISDIR ENODEV ENOTDIR"), ("access", "EACCES EPERM"),
    ("no_mem", "EMFILE ENFILE ENOMEM"), ("amode", "EINVAL"), ("io", "EAGAIN EINTR EIO ENXIO")) for e in es.split()) + " ELSE 'unknown' END AS class FROM nation")
def error_classes(spark, sf):
    return _t(spark, sf, "nation").select(F.col("n_nationkey").alias("code"), bytesio.error_class(F.col("n_nationkey")).alias("class"))


@_query("SELECT l_suppkey AS msg, CASE WHEN 8 + 4 * count(*) <= 2400 THEN 8 + 4 * count(*) END AS size, CASE WHEN 8 + 4 * count(*) <= 2400 THEN 0 ELSE 1 END AS status FROM lineitem GROUP BY 1")
def pack_bounded(spark, sf):
    t = _t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("msg")).agg(F.collect_list(F.col("l_quantity").cast("double")).alias("v")).withColumn("t", F.lit(0))
    got = t.select("msg", bytesio.packed(F.col("t"), F.col("v"), 2400).alias("p"))
    return got.select("msg", F.octet_length("p.data").cast("long").alias("size"), "p.status")


# ---- section files


def _sections(spark, sf):
    supplier, customer, nation = (_t(spark, sf, n) for n in ("supplier", "customer", "nation"))
    row = lambda df, n, kind, user, size, pos, data: df.select(F.lit(n).alias("section"), F.lit(kind).alias("type"), F.lit(user).alias("user_string"), size.cast("long").alias("elem_size"), pos.cast("long").alias("pos"), data.cast("binary").alias("data"))
    head = nation.agg(F.count(F.lit(1)).alias("n")).select(F.rpad(F.concat(F.lit("nations "), F.col("n").cast("string")), 32, ".").alias("d"))
    names = nation.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"]), ";").alias("d"))
    a = row(head, 0, "I", "inline", F.lit(32), F.lit(0), F.col("d"))
    b = row(names, 1, "B", "block", F.octet_length("d"), F.lit(0), F.col("d"))
    c = row(supplier, 2, "A", "suppliers", F.lit(10), F.col("s_suppkey"), F.lpad(F.col("s_suppkey").cast("string"), 10, "0"))
    d = row(customer, 3, "A", "customers", F.lit(7), F.col("c_custkey"), F.lpad(F.col("c_custkey").cast("string"), 7, " "))
    return a.union(b).union(c).union(d)


_SECTIONS = """(SELECT 0 AS section, 'I' AS type, 'inline' AS user_string, 1 AS n, 32 AS elem_size, 0 AS pos, rpad('nations ' || count(*), 32, '.') AS data FROM nation
UNION ALL SELECT 1, 'B', 'block', 1, strlen(d), 0, d FROM (SELECT string_agg(n_name, ';' ORDER BY n_nationkey) AS d FROM nation)
UNION ALL SELECT 2, 'A', 'suppliers', (SELECT count(*) FROM supplier), 10, s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') FROM supplier
UNION ALL SELECT 3, 'A', 'customers', (SELECT count(*) FROM customer), 7, c_custkey, lpad(CAST(c_custkey AS VARCHAR), 7, ' ') FROM customer)"""


def _written(spark, sf):
    path = f"{new_path(spark, 'sections')}.scda"
    scda.write_sections(_sections(spark, sf).repartition(7), path, "round trip")
    return path


@_query(f"SELECT * FROM {_SECTIONS}")
def scda_round_trip(spark, sf):
    """Written from seven parts, read in five."""
    got = spark.read.format("scda").option("parts", 5).load(_written(spark, sf))
    return got.withColumn("data", F.col("data").cast("string"))


@_query(f"""WITH s AS (SELECT section, type, user_string, n, elem_size FROM {_SECTIONS} GROUP BY ALL),
l AS (SELECT *, CASE type WHEN 'I' THEN 96 WHEN 'B' THEN 96 ELSE 128 END AS head, n * elem_size AS size FROM s),
p AS (SELECT *, CASE WHEN type = 'I' THEN 96 ELSE head + size + CASE WHEN (32 - size % 32) % 32 >= 7 THEN (32 - size % 32) % 32 ELSE (32 - size % 32) % 32 + 32 END END AS length FROM l)
SELECT section, type, user_string, n, elem_size, CAST(128 + coalesce(sum(length) OVER (ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE type WHEN 'I' THEN 64 WHEN 'B' THEN 96 ELSE 128 END AS BIGINT) AS offset, CAST(length AS BIGINT) AS length FROM p""")
def scda_layout(spark, sf):
    """Headers alone, and the lengths that they imply."""
    rows = [(s["section"], s["type"], s["user_string"], s["n"], s["elem_size"], s["offset"]) for s in scda.sections(_written(spark, sf))]
    t = spark.createDataFrame(rows, "section int, type string, user_string string, n long, elem_size long, offset long")
    return t.withColumn("length", scda.section_length(F.col("type"), F.col("n"), F.col("elem_size")))


@_query("""SELECT l_suppkey AS rank, n, CAST(coalesce(sum(n) OVER (ORDER BY l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 24 AS BIGINT) AS offset, n * 24 AS bytes
FROM (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R' AND l_linenumber = 7) AS n FROM lineitem GROUP BY 1)""")
def scda_offsets(spark, sf):
    return scda.offsets(_rank_counts(spark, sf), "rank", "n", 24)


def _rank_counts(spark, sf):
    return _t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("rank")).agg(F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)).alias("n"))


@_query("SELECT max(l_suppkey) AS highest FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 7")
def scda_highest_rank(spark, sf):
    return scda.highest_nonempty(_rank_counts(spark, sf), "rank", "n")


@_query("SELECT count(DISTINCT n) <= 1 AS consistent, count(*) AS ranks FROM (SELECT s_nationkey AS rank, count(*) AS n FROM supplier GROUP BY 1)")
def ranks_agree(spark, sf):
    return exchange.consistent(_t(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("rank")).agg(F.count(F.lit(1)).alias("n")), "rank", ["n"])


@_query("SELECT n_nationkey, n_name || ' ' || repeat('-', 60 - strlen(n_name)) || chr(10) AS padded FROM nation")
def scda_user_padding(spark, sf):
    return _t(spark, sf, "nation").select("n_nationkey", scda.padded_user(F.col("n_name")).alias("padded"))


# ---- options


def _registry() -> options.Options:
    sub = options.Options()
    sub.add("depth", "size", 3)
    o = options.Options()
    o.add("scale", float, 1.5, "s")
    o.add("level", int, 0, "l")
    o.add("on", bool, False, "o")
    o.add("verbose", "switch", 0, "v")
    o.add("mode", "keyvalue", "slow", "m", {"slow": 1, "fast": 2})
    o.add("name", str, "none")
    o.add("even", "callback", None, "e", call=lambda text: int(text) % 2 == 0)
    o.add_suboptions(sub, "Sub")
    return o


def _values(df, key, read):
    got = df.select(key, read.alias("r"))
    v = F.col("r.values")
    return got.select(
        key, F.col("r.status").alias("status"), F.try_element_at(v, F.lit("scale")).cast("double").alias("scale"), F.try_element_at(v, F.lit("level")).cast("int").alias("level"),
        F.try_element_at(v, F.lit("on")).alias("on"), F.try_element_at(v, F.lit("mode")).alias("mode"), F.try_element_at(v, F.lit("name")).alias("name"),
        F.try_element_at(v, F.lit("Sub:depth")).cast("long").alias("depth"),
    )


def _option_sql(key: str, table: str, bad: str, **x: str) -> str:
    cols = ", ".join(f"CASE WHEN {bad} THEN NULL ELSE {v} END AS {n}" for n, v in x.items())
    return f"SELECT {key}, CASE WHEN {bad} THEN -1 ELSE 0 END AS status, {cols} FROM {table}"


@_query(_option_sql("s_suppkey", "supplier", "s_suppkey % 5 = 4", scale="s_acctbal", level="CAST(CASE WHEN s_suppkey % 5 = 3 THEN 0 ELSE s_nationkey END AS INTEGER)", on="CASE WHEN s_suppkey % 2 = 0 THEN '1' ELSE '0' END", mode="'fast'", name="s_name", depth="s_suppkey"))
def options_ini(spark, sf):
    """Every fifth text gives an option both by its long and its short form, which is an error; every fifth leaves it out."""
    k = F.col("s_suppkey")
    level = F.when(k % 5 == 3, "").when(k % 5 == 4, F.concat(F.lit("level = 1\n-l = "), F.col("s_nationkey").cast("string"), F.lit("\n"))).otherwise(F.concat(F.lit("-l = "), F.col("s_nationkey").cast("string"), F.lit("\n")))
    text = F.concat(
        F.lit("[Options]\nscale = "), F.col("s_acctbal").cast("string"), F.lit("\n"), level, F.lit("on = "), F.when(k % 2 == 0, "yes").otherwise("no"),
        F.lit("\n-m = fast\nname = "), F.col("s_name"), F.lit("\n[Sub]\ndepth = "), k.cast("string"), F.lit("\n"),
    )
    return _values(_t(spark, sf, "supplier"), "s_suppkey", options.reader(_registry, "ini")(text))


@_query(_option_sql("s_suppkey", "supplier", "s_suppkey % 5 = 4", scale="s_acctbal", level="CAST(s_nationkey AS INTEGER)", on="'0'", mode="'slow'", name="s_name", depth="s_suppkey"))
def options_saved(spark, sf):
    """Texts written by the registry and read again; every fifth has a number that is none."""
    k = F.col("s_suppkey")
    text = F.concat(F.lit("[Options]\nscale = "), F.col("s_acctbal").cast("string"), F.lit("\nname = "), F.col("s_name"), F.lit("\nlevel = "), F.when(k % 5 == 4, "x").otherwise(F.col("s_nationkey").cast("string")), F.lit("\n[Sub]\ndepth = "), k.cast("string"))
    return _values(_t(spark, sf, "supplier"), "s_suppkey", options.reader(_registry, "saved")(text))


@_query(_option_sql("event_id", "events", "user_id % 7 = 6", scale="value", level="CAST(json_extract_string(props, '$.k') AS INTEGER)", on="CASE WHEN event_type = 'view' THEN '1' ELSE '0' END", mode="'slow'", name="event_type", depth="user_id"))
def options_json(spark, sf):
    """Values in nested objects and under keys with colons; every seventh user's callback refuses an odd number."""
    even = F.when(F.col("user_id") % 7 == 6, 1).otherwise(2)
    text = F.concat(
        F.lit('{"Options": {"scale": '), F.col("value").cast("string"), F.lit(', "-l": '), F.get_json_object("props", "$.k"), F.lit(', "name": "'), F.col("event_type"),
        F.lit('", "even": '), even.cast("string"), F.lit(', "Sub": {"depth": '), F.col("user_id").cast("string"), F.lit('}}, "on": '), F.when(F.col("event_type") == "view", "true").otherwise("false"), F.lit("}"),
    )
    return _values(_t(spark, sf, "events"), "event_id", options.reader(_registry, "json")(text))


@_query("SELECT c_custkey, CASE WHEN c_custkey % 6 = 5 THEN -1 ELSE 0 END AS status, CASE WHEN c_custkey % 6 <> 5 THEN CAST(c_nationkey AS INTEGER) END AS level, CASE WHEN c_custkey % 6 <> 5 THEN 2 END AS verbose, CASE WHEN c_custkey % 6 <> 5 THEN '1' END AS on, CASE WHEN c_custkey % 6 <> 5 THEN 'left over' END AS rest FROM customer")
def options_args(spark, sf):
    """Long and short arguments; every sixth has one that is unknown."""
    odd = F.when(F.col("c_custkey") % 6 == 5, " --wrong").otherwise("")
    text = F.concat(F.lit("left -v --level="), F.col("c_nationkey").cast("string"), F.lit(" --on=true -v over"), odd)
    got = _t(spark, sf, "customer").select("c_custkey", options.reader(_registry, "args")(text).alias("r"))
    v = F.col("r.values")
    return got.select("c_custkey", F.col("r.status").alias("status"), F.try_element_at(v, F.lit("level")).cast("int").alias("level"), F.try_element_at(v, F.lit("verbose")).cast("int").alias("verbose"), F.try_element_at(v, F.lit("on")).alias("on"), F.col("r.rest").alias("rest"))


# ---- records and messages


@_query(f"SELECT src, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS record_no, [CAST(dst AS BIGINT), 1, CAST(src AS BIGINT), payload] AS record FROM {_EDGES}")
def notify_encode(spark, sf):
    return exchange.encode(_edges(spark, sf))


@_query(f"SELECT dst AS to, list_concat([CAST(dst AS BIGINT), count(*)], flatten(list([CAST(src AS BIGINT), payload] ORDER BY src))) AS record FROM {_EDGES} GROUP BY dst")
def notify_merge(spark, sf):
    """Streams of the senders of even and of odd number, merged."""
    e = exchange.encode(_edges(spark, sf))
    return exchange.merge(e.where("src % 2 = 0"), e.where("src % 2 = 1"))


@_query(f"SELECT dst, src, payload FROM {_EDGES}")
def notify_decode(spark, sf):
    e = exchange.encode(_edges(spark, sf))
    return exchange.decode(exchange.merge(e.where("src % 2 = 0"), e.where("src % 2 = 1")))


@_query(f"WITH e AS (SELECT DISTINCT dst, src FROM {_EDGES}), s AS (SELECT DISTINCT dst, x.src FROM e, (SELECT DISTINCT src FROM e) x WHERE x.src % 10 = dst % 10 OR (dst, x.src) IN (SELECT dst, src FROM e)) SELECT dst, src, (dst, src) IN (SELECT dst, src FROM e) AS sends FROM s")
def notify_superset(spark, sf):
    return exchange.superset_by_key(_edges(spark, sf), lambda c: c % 10)


@_query("""WITH s AS (SELECT user_id AS src, event_type AS dst, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id AS src, event_type AS dst, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value, event_id) AS k FROM events)
SELECT s.src, s.dst, s.event_id AS sent, r.value AS received FROM s JOIN r USING (src, dst, k)""")
def send_receive(spark, sf):
    """The n-th event of a user and kind by time meets the n-th by value."""
    e = _t(spark, sf, "events")
    a = e.select(F.col("user_id").alias("src"), F.col("event_type").alias("dst"), F.struct("ts", "event_id").alias("at"))
    b = e.select(F.col("user_id").alias("src"), F.col("event_type").alias("dst"), F.struct("value", "event_id").alias("at"))
    got = exchange.matched(a, b, ("src", "dst"))
    return got.select("src", "dst", F.col("at.event_id").alias("sent"), F.col("received_at.value").alias("received"))


# ---- lookups, arrays, stores


@_query("""WITH c AS (SELECT l_suppkey AS rank, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT rank, n, sum(n) OVER (ORDER BY rank) - n AS first FROM c)
SELECT o_orderkey, (SELECT max(rank) FROM s WHERE first <= o_orderkey AND o_orderkey < first + n) AS rank FROM orders""")
def owner_of_position(spark, sf):
    counts = _t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("rank")).agg(F.count(F.lit(1)).alias("n"))
    return lookup.owner_of(_t(spark, sf, "orders").select("o_orderkey"), counts, "o_orderkey")


@_query("""WITH a AS (SELECT c_nationkey AS g, c_acctbal AS v, min(c_custkey) AS c FROM customer GROUP BY ALL),
b AS (SELECT s_suppkey, a.v AS bv, a.c AS bc FROM supplier ASOF LEFT JOIN a ON s_nationkey = g AND s_acctbal >= a.v), f AS (SELECT s_suppkey, a.v AS fv, a.c AS fc FROM supplier ASOF LEFT JOIN a ON s_nationkey = g AND s_acctbal <= a.v)
SELECT s_suppkey, CASE WHEN bv = s_acctbal THEN 0 WHEN bv IS NOT NULL THEN -1 WHEN fv IS NOT NULL THEN 1 END AS side, coalesce(bc, fc) AS node FROM supplier JOIN b USING (s_suppkey) JOIN f USING (s_suppkey)""")
def nearest_node(spark, sf):
    q = _t(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("g"), "s_acctbal")
    a = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("v"), "c_custkey")
    return lookup.nearest(q, a, "s_acctbal", "v", "c_custkey", "g").select("s_suppkey", "side", F.col("node.c").alias("node"))


@_query("SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS k FROM part) WHERE k = 41")
def kth_smallest(spark, sf):
    return order.kth(_t(spark, sf, "part").select("p_partkey", "p_name"), "p_name", ["p_partkey"], 41)


@_query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority DESC, o_orderkey) - 1 AS popped FROM orders")
def queue_pops(spark, sf):
    return order.pops(_t(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["o_orderkey"]).select("o_orderkey", "popped")


@_query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS nth FROM events")
def grouped_order(spark, sf):
    return order.grouped_positions(_t(spark, sf, "events").select("event_id", "event_type", "value"), ["event_type"], "value", ["event_id"], "nth").select("event_id", "nth")


@_query("SELECT 7 AS position, s_suppkey AS key FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS k FROM (SELECT DISTINCT l_suppkey AS s_suppkey FROM lineitem)) WHERE k = 7 UNION ALL SELECT 1000000, NULL")
def position_lookup(spark, sf):
    t = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"))
    found = group.insert_unique(t.withColumn("pos", F.col("key")), "key", "pos")
    wanted = spark.createDataFrame([(7,), (1000000,)], "position long")
    return group.at_position(found, "key", wanted)


@_query("SELECT (SELECT count(*) FROM supplier) = (SELECT count(*) FROM supplier) AS itself, false AS shifted, coalesce((SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = 5), -1) AS first_of_5, 3 AS kept, 0.25 AS filled")
def array_checks(spark, sf):
    t = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_nationkey").alias("v"), "s_acctbal")
    other = t.withColumn("pos", F.col("pos") + 1)
    same = order.same_array(t, t, "pos", "v").select(F.col("same").alias("itself"))
    shifted = order.same_array(t, other, "pos", "v").select(F.col("same").alias("shifted"))
    at = order.index_of(t, "v", 5, "pos").select(F.col("position").alias("first_of_5"))
    kept = order.truncate(t, "pos", 3).agg(F.count(F.lit(1)).alias("kept"))
    filled = order.fill(t, "s_acctbal", 0.25).agg(F.max("s_acctbal").alias("filled"))
    return same.crossJoin(shifted).crossJoin(at).crossJoin(kept).crossJoin(filled)  # single rows


@_query("""SELECT r, list_filter(v, lambda x, i: i <> 2) AS without, [v[1]] || ['x'] || v[2:] AS inserted, CAST(coalesce(list_position(v, 'CHINA'), 0) - 1 AS BIGINT) AS "at", list_transform(v, lambda x: 'y') AS filled
FROM (SELECT n_regionkey AS r, list(n_name ORDER BY n_nationkey) AS v FROM nation GROUP BY 1)""")
def list_edits(spark, sf):
    t = reduce.gathered(reduce.allgather(_t(spark, sf, "nation"), "n_nationkey", "n_name", ["n_regionkey"]), ["n_regionkey"])
    v = F.col("gathered")
    return t.select(
        F.col("n_regionkey").alias("r"), arrays.remove(v, 1).alias("without"), arrays.insert(v, 1, F.lit("x")).alias("inserted"), arrays.index_of(v, F.lit("CHINA")).alias("at"), arrays.fill(v, F.lit("y")).alias("filled"),
    )


@_query("SELECT c_custkey, substr(c_name || c_mktsegment, 1, 23) AS text, CASE WHEN length(c_name || c_mktsegment) > 23 THEN -1 ELSE 0 END AS status FROM customer")
def string_append(spark, sf):
    got = _t(spark, sf, "customer").select("c_custkey", arrays.appended(F.col("c_name"), F.col("c_mktsegment"), 24).alias("a"))
    return got.select("c_custkey", "a.text", "a.status")


@_query("SELECT c_custkey, CASE WHEN c_nationkey > 12 THEN 2 ELSE 3 END AS visited FROM customer")
def keyvalue_visit(spark, sf):
    """A walk over the keys balance, nation, segment that ends at a number above 12."""
    m = kv.build([("segment", "s", F.col("c_mktsegment")), ("nation", "i", F.col("c_nationkey")), ("balance", "g", F.col("c_acctbal"))])
    seen = kv.visit(m, lambda k, e: F.coalesce(e["i"], F.lit(0)) <= 12)
    return _t(spark, sf, "customer").select("c_custkey", F.size(seen).alias("visited"))


# ---- numbers


@_query("SELECT p_partkey, round(power(1 + p_size / 100.0, p_partkey % 13), 9) AS fpow, round(p_size + p_retailprice, 6) AS added, round(p_size * p_retailprice * 0.5, 6) AS multiplied FROM part")
def float_math(spark, sf):
    s, r = F.col("p_size"), F.col("p_retailprice")
    return _t(spark, sf, "part").select("p_partkey", F.round(mathx.floatpow(1 + s / 100.0, F.col("p_partkey") % 13), 9).alias("fpow"), F.round(mathx.field_sum(s, r), 6).alias("added"), F.round(mathx.field_product(s, r, F.lit(0.5)), 6).alias("multiplied"))


_WIDE = "(CAST(p_partkey AS UHUGEINT) * '18446744073709551616'::UHUGEINT + CAST(p_size AS UHUGEINT) * 1000003)"


@_query(f"""SELECT p_partkey, lpad(hex(a & b), 32, '0') AS both, lpad(hex(a | b), 32, '0') AS either, lpad(hex('340282366920938463463374607431768211455'::UHUGEINT - a), 32, '0') AS flipped,
  lpad(hex((a % '1208925819614629174706176'::UHUGEINT) * '281474976710656'::UHUGEINT), 32, '0') AS up, (a // '18446744073709551616'::UHUGEINT) % 2 = 1 AS bit64, lpad(hex(a | '1267650600228229401496703205376'::UHUGEINT), 32, '0') AS with100
FROM (SELECT p_partkey, {_WIDE} AS a, CAST(p_size AS UHUGEINT) * '18446744073709551616'::UHUGEINT + CAST(p_partkey AS UHUGEINT) AS b FROM part)""")
def uint128_bits(spark, sf):
    p, s = F.col("p_partkey").cast("long"), F.col("p_size").cast("long")
    df = _t(spark, sf, "part").select("p_partkey", u128.make(p, s * 1000003).alias("a"), u128.make(s, p).alias("b"))
    a, b = F.col("a"), F.col("b")
    join = lambda v: F.concat(F.lpad(F.hex(v["hi"]), 16, "0"), F.lpad(F.hex(v["lo"]), 16, "0"))
    return df.select("p_partkey", join(u128.bit_and(a, b)).alias("both"), join(u128.bit_or(a, b)).alias("either"), join(u128.bit_not(a)).alias("flipped"), join(u128.shift_left(a, 48)).alias("up"), u128.bit(a, 64).alias("bit64"), join(u128.set_bit(a, 100)).alias("with100"))


@_query(None)
def hash_words(spark, sf):
    """The mixing of three words."""
    t = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", hashing.mix_words(F.col("l_orderkey").cast("long"), F.col("l_partkey").cast("long"), F.col("l_suppkey").cast("long")).alias("w"))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "w.a", "w.b", "w.c")


# ---- cameras


@_query(f"""SELECT id, round((x - 1) * cos(0.5) - (z - 14) * sin(0.5), 6) + 0.0 AS x, round(y - 2, 6) + 0.0 AS y, round((x - 1) * sin(0.5) + (z - 14) * cos(0.5), 6) + 0.0 AS z FROM {_POINTS}""")
def camera_moved(spark, sf):
    """Two steps back, then turned to the side."""
    got = camera.view_transform(_points(spark, sf), _EYE.walk(2.0).yaw(0.5))
    return got.select("id", *[(F.round(c, 6) + 0.0).alias(c) for c in "xyz"])


@_query(f"""SELECT id, round(x1 * cos(0.2) + y1 * sin(0.2), 6) + 0.0 AS x, round(y1 * cos(0.2) - x1 * sin(0.2), 6) + 0.0 AS y, round(z1, 6) + 0.0 AS z FROM (
  SELECT id, x - 1 AS x1, (y - 2) * cos(0.3) + (z - 12) * sin(0.3) AS y1, (z - 12) * cos(0.3) - (y - 2) * sin(0.3) AS z1 FROM {_POINTS})""")
def camera_turned(spark, sf):
    """Pitched, then rolled."""
    got = camera.view_transform(_points(spark, sf), _EYE.pitch(0.3).roll(0.2))
    return got.select("id", *[(F.round(c, 6) + 0.0).alias(c) for c in "xyz"])


_SIX = {"near": "0.5 - w", "far": "w - 30", "left": "(1 - x - w) / sqrt(2)", "right": "(x - 1 - w) / sqrt(2)", "top": "(y - 2 - w) / sqrt(2)", "bottom": "(2 - y - w) / sqrt(2)"}


@_query("SELECT id, " + ", ".join(f"round({v}, 6) + 0.0 AS d_{k}" for k, v in _SIX.items()) + f" FROM (SELECT *, 12 - z AS w FROM {_POINTS})")
def camera_distances(spark, sf):
    got = camera.frustum_distances(_points(spark, sf), _EYE)
    return got.select("id", *[(F.round(f"d_{k}", 6) + 0.0).alias(f"d_{k}") for k in _SIX])


# ---- statistics


@_query("""SELECT o_orderpriority AS variable, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(100 * stddev_pop(o_totalprice) / abs(avg(o_totalprice)), 4) AS relative FROM orders GROUP BY 1""")
def stats_report(spark, sf):
    t = _t(spark, sf, "orders").select(F.col("o_orderpriority").alias("variable"), "o_totalprice", (F.col("o_custkey") % 7).alias("rank"))
    got = stats.report(stats.summarize(t, ["variable"], "o_totalprice", "rank"))
    return got.select("variable", "n", F.round("mean", 4).alias("mean"), F.round("relative", 4).alias("relative"))


@_query("""SELECT list(round(m, 4) ORDER BY k) AS means, list(g ORDER BY k) AS maxima FROM (SELECT o_orderpriority AS k, avg(o_totalprice) AS m, max(o_totalprice) AS g FROM orders GROUP BY 1)""")
def stats_summary_lines(spark, sf):
    t = _t(spark, sf, "orders").select(F.col("o_orderpriority").alias("variable"), "o_totalprice", (F.col("o_custkey") % 7).alias("rank"))
    got = stats.summary_vector(stats.summarize(t, ["variable"], "o_totalprice", "rank"), "variable", "variable")
    return got.select(F.transform("means", lambda x: F.round(x, 4)).alias("means"), "maxima")


@_query("""SELECT 'balance' AS variable, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer UNION ALL SELECT 'size', count(*), round(avg(p_size), 6) FROM part UNION ALL SELECT 'unused', 0, NULL""")
def stats_container(spark, sf):
    s = stats.Statistics()
    for name in ("balance", "size", "unused"):
        s.add(name)
    s.accumulate("balance", _t(spark, sf, "customer"), F.col("c_acctbal"), F.col("c_nationkey"))
    s.accumulate("size", _t(spark, sf, "part"), F.col("p_size"), F.col("p_partkey"))
    return s.compute().select("variable", "n", F.round("mean", 6).alias("mean"))


@_query("SELECT i AS v, count(*) AS n FROM range(0, 3) t(i), orders GROUP BY 1")
def reduce_null_slots(spark, sf):
    """Every row gets its slot's count, rows without a slot too."""
    t = _t(spark, sf, "orders").select("o_orderkey").withColumn("i", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    t = t.withColumn("slot", F.when(F.col("i") > 0, F.col("i"))).withColumn("one", F.lit(1)).withColumn("rank", F.lit(0))
    got = reduce.allreduce(t, "slot", "one", "SUM", "n")
    return got.groupBy(F.coalesce("slot", F.lit(0)).cast("long").alias("v")).agg(F.max("n").alias("n"))


@_query("SELECT event_id FROM (SELECT *, lead(k) OVER (PARTITION BY user_id ORDER BY event_id) AS nx, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM (SELECT *, CASE WHEN event_type <> 'view' THEN event_type END AS k FROM events)) WHERE back = 1 OR nx IS DISTINCT FROM k")
def uniq_last_nulls(spark, sf):
    """Runs of keys of which one is null."""
    e = _t(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("k"))
    return group.uniq_last(e, ["user_id"], "k", "event_id").select("event_id")


@_query("SELECT p_partkey, CASE WHEN x <= 9223372036854775807 - 24 THEN CAST((x + 23) // 24 * 24 AS BIGINT) END AS aligned, CASE WHEN x <= 4611686018427387904 THEN 4611686018427387904 ELSE -1 END AS up FROM (SELECT p_partkey, 4611686018427387904 - 1000 + CAST(p_partkey AS HUGEINT) AS x FROM part)")
def integer_math_large(spark, sf):
    """Near the largest powers of two."""
    x = F.lit(4611686018427387904 - 1000) + F.col("p_partkey")
    return _t(spark, sf, "part").select("p_partkey", mathx.align_up(x, 24).alias("aligned"), F.coalesce(mathx.roundup2(x), F.lit(-1)).alias("up"))


# ---- streams


def _stream(spark, sf):
    schema = _t(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*").option("recursiveFileLookup", "true").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))


@_query("""SELECT event_type, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, n, total FROM (SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(value) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL)
WHERE start + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)""")
def stream_windowed_statistics(spark, sf):
    """Windows that the watermark has passed when the stream's source is used up."""
    got = streaming.run_to_end(streaming.windowed_statistics(_stream(spark, sf), "ts", "event_type", "value", "1 hour", "10 minutes"))
    return got.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("total", 3).alias("total"))


@_query("SELECT DISTINCT user_id FROM events")
def stream_first_seen(spark, sf):
    return streaming.run_to_end(streaming.first_seen(_stream(spark, sf), ["user_id"], "ts", "400 days")).select("user_id")


@_query(_SLOTS)
def stream_recycle_slots(spark, sf):
    path = new_path(spark, "operations")
    slot_operations(spark, sf).write.parquet(path)
    ops = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return streaming.run_to_end(streaming.recycle_stream(ops, "store", "pos", "op", "arg"))
