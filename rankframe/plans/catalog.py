"""The library's queries over the shared tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.functions import arrays, camera, hashing, mathx, poly, rng, u128
from rankframe.functions import keyvalue as kv
from rankframe.operators import amr, exchange, group, lookup, order, ranges, reduce, setops, stats
from rankframe.sources import bytesio, codec
from rankframe.streaming import events as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def _t(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


_STATS = """
SELECT {by}, count(x) AS n, round(sum(x), 2) AS total, round(sum(x * x) / 1e6, 1) AS total_sq, min(x) AS least, max(x) AS greatest,
  CAST(min(CASE WHEN x = lo THEN r END) AS BIGINT) AS least_at, CAST(min(CASE WHEN x = hi THEN r END) AS BIGINT) AS greatest_at,
  round(avg(x), 4) AS mean, round(var_pop(x) / 1e3, 1) AS variance, round(stddev_pop(x), 3) AS deviation,
  round(var_pop(x) / count(x), 2) AS variance_mean
FROM (SELECT *, min(x) OVER (PARTITION BY {by}) AS lo, max(x) OVER (PARTITION BY {by}) AS hi FROM ({src})) GROUP BY {by}
"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "total": F.round("total", 2), "total_sq": F.round(F.col("total_sq") / 1e6, 1), "mean": F.round("mean", 4), "variance": F.round(F.col("variance") / 1e3, 1),
        "deviation": F.round("deviation", 3), "variance_mean": F.round("variance_mean", 2), "least_at": F.col("least_at").cast("long"), "greatest_at": F.col("greatest_at").cast("long"),
    })


@_query(_STATS.format(by="l_returnflag", src="SELECT l_returnflag, l_extendedprice AS x, l_suppkey % 4 AS r FROM lineitem"))
def stats_by_flag(spark, sf):
    t = _t(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", (F.col("l_suppkey") % 4).alias("rank"))
    return _rounded(stats.summarize(t, ["l_returnflag"], "l_extendedprice", "rank"))


@_query(_STATS.format(by="o_orderpriority", src="SELECT o_orderpriority, o_custkey % 16 AS r, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS x FROM orders GROUP BY ALL"))
def stats_of_rank_sums(spark, sf):
    t = _t(spark, sf, "orders").select("o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").alias("v"), (F.col("o_custkey") % 16).alias("rank"))
    return _rounded(stats.summarize_ranks(t, ["o_orderpriority"], "v", "rank"))


@_query("SELECT o_orderpriority AS variable, o_custkey % 3 AS grp, count(*) AS n FROM orders WHERE o_custkey % 3 = 1 AND o_orderkey % 5 >= 2 GROUP BY ALL")
def stats_printed(spark, sf):
    t = _t(spark, sf, "orders").select(F.col("o_orderpriority").alias("variable"), (F.col("o_custkey") % 3).alias("grp"), (F.col("o_orderkey") % 5).alias("prio"))
    return stats.printed(t, 1, 2).groupBy("variable", "grp").agg(F.count(F.lit(1)).alias("n"))


@_query("""SELECT round(sum(n) / 255.0, 4) AS mean, round(sqrt(greatest(sum(n * n) / 255.0 - power(sum(n) / 255.0, 2), 0)), 4) AS deviation
FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey % 255)""")
def bucket_statistics(spark, sf):
    got = stats.bucket_sizes(_t(spark, sf, "orders"), F.col("o_orderkey") % 255, 255)
    return got.select(F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"))


@_query("SELECT o_orderpriority AS slot, max(o_totalprice) AS max, min(o_totalprice) AS min, round(sum(o_totalprice), 1) AS sum FROM orders GROUP BY 1")
def reduce_max_min_sum(spark, sf):
    t = _t(spark, sf, "orders").select(F.col("o_orderpriority").alias("slot"), F.col("o_totalprice").alias("v"), (F.col("o_custkey") % 7).alias("rank"))
    return reduce.reduce_slots(t, "slot", "v", ["MAX", "MIN", "SUM"]).withColumn("sum", F.round("sum", 1))


@_query("""SELECT l_returnflag AS slot, bool_and(v <> 0) AS land, bool_or(v <> 0) AS lor, count(*) FILTER (v <> 0) % 2 = 1 AS lxor,
  bit_and(v) AS band, bit_or(v) AS bor, bit_xor(v) AS bxor FROM (SELECT l_returnflag, l_partkey AS v FROM lineitem) GROUP BY 1""")
def reduce_bits(spark, sf):
    t = _t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("slot"), F.col("l_partkey").alias("v"), F.col("l_suppkey").alias("rank"))
    return reduce.reduce_slots(t, "slot", "v", ["LAND", "LOR", "LXOR", "BAND", "BOR", "BXOR"])


@_query("""WITH t AS (SELECT c_nationkey AS slot, c_acctbal AS v, c_custkey AS r, min(c_acctbal) OVER (PARTITION BY c_nationkey) lo, max(c_acctbal) OVER (PARTITION BY c_nationkey) hi FROM customer)
SELECT slot, min(v) AS min_value, min(CASE WHEN v = lo THEN r END) AS min_rank, max(v) AS max_value, min(CASE WHEN v = hi THEN r END) AS max_rank FROM t GROUP BY slot""")
def reduce_minloc_maxloc(spark, sf):
    t = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("slot"), F.col("c_acctbal").alias("v"), F.col("c_custkey").alias("rank"))
    got = reduce.reduce_slots(t, "slot", "v", ["MINLOC", "MAXLOC"])
    return got.select("slot", F.col("minloc")["value"].alias("min_value"), F.col("minloc")["rank"].alias("min_rank"), F.col("maxloc")["value"].alias("max_value"), F.col("maxloc")["rank"].alias("max_rank"))


@_query("SELECT o_orderkey, o_orderpriority, max(o_totalprice) OVER (PARTITION BY o_orderpriority) AS highest FROM orders")
def allreduce_back(spark, sf):
    t = _t(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", F.lit(0).alias("rank"))
    return reduce.allreduce(t, "o_orderpriority", "o_totalprice", "MAX", "highest").select("o_orderkey", "o_orderpriority", "highest")


@_query("SELECT event_type AS slot, bit_xor(h) AS reduced FROM (SELECT event_type, user_id % 64 AS r, sum(event_id)::BIGINT AS h FROM events GROUP BY ALL) GROUP BY 1")
def reduce_custom_xor(spark, sf):
    t = _t(spark, sf, "events").groupBy(F.col("event_type").alias("slot"), (F.col("user_id") % 64).alias("rank")).agg(F.sum("event_id").alias("v"))
    return reduce.reduce_custom(t, "slot", "v", "rank", F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


_RANKED = "SELECT o_orderpriority AS slot, o_custkey % 16 AS r, count(*) AS v FROM orders GROUP BY ALL"


def _ranked(spark, sf):
    return _t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("slot"), (F.col("o_custkey") % 16).alias("rank")).agg(F.count(F.lit(1)).alias("v"))


@_query(f"""SELECT slot, r AS entry, CAST(coalesce(sum(v) OVER (PARTITION BY slot ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prefix FROM ({_RANKED})
UNION ALL SELECT slot, max(r) + 1, CAST(sum(v) AS BIGINT) FROM ({_RANKED}) GROUP BY slot""")
def prefix_by_rank(spark, sf):
    return reduce.prefix(_ranked(spark, sf), "slot", "rank", "v")


@_query(f"SELECT slot, r AS rank, v, CAST(sum(v) OVER (PARTITION BY slot ORDER BY r) AS BIGINT) AS prefix FROM ({_RANKED})")
def scan_inclusive(spark, sf):
    return reduce.scan(_ranked(spark, sf), "slot", "rank", "v", True)


@_query('SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS "at", n_name AS value FROM nation')
def allgather_list(spark, sf):
    return reduce.allgather(_t(spark, sf, "nation"), "n_nationkey", "n_name", ["n_regionkey"])


@_query("""WITH t AS (SELECT l_suppkey % 10 AS g, l_suppkey AS r, list(l_partkey ORDER BY l_partkey) AS v FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY ALL)
SELECT g, row_number() OVER w - 1 AS "at", CAST(coalesce(sum(len(v)) OVER (PARTITION BY g ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first, v AS values FROM t WINDOW w AS (PARTITION BY g ORDER BY r)""")
def gatherv_offsets(spark, sf):
    t = _t(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct().groupBy((F.col("l_suppkey") % 10).alias("g"), "l_suppkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("v"))
    return reduce.gatherv(t, "l_suppkey", "v", ["g"])


@_query("SELECT n_nationkey, n_name, (SELECT r_name FROM region WHERE r_regionkey = 2) AS root FROM nation")
def bcast_root(spark, sf):
    return reduce.bcast_from(_t(spark, sf, "nation").select("n_nationkey", "n_name"), _t(spark, sf, "region"), "r_regionkey", 2, "r_name", "root")


@_query("SELECT CAST(l_partkey % 8 AS BIGINT) AS src, CAST(l_suppkey % 8 AS BIGINT) AS dst, count(*) AS n FROM lineitem GROUP BY ALL")
def alltoall_counts(spark, sf):
    t = _t(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 8).alias("src"), (F.col("l_partkey") % 8).alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    return reduce.alltoall(t, "src", "dst")


@_query("SELECT c_custkey, c_nationkey AS color, row_number() OVER (PARTITION BY c_nationkey ORDER BY -c_custkey % 7, c_custkey) - 1 AS new_rank, count(*) OVER (PARTITION BY c_nationkey) AS new_size FROM customer")
def comm_split(spark, sf):
    t = _t(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("color"), (-F.col("c_custkey") % 7).alias("key"))
    return reduce.comm_split(t, "color", "key", "c_custkey").select("c_custkey", "color", F.col("new_rank").cast("long").alias("new_rank"), "new_size")


@_query("SELECT s_suppkey, s_suppkey // 16 AS node, s_suppkey % 16 AS intra FROM supplier")
def node_split(spark, sf):
    return reduce.nodes(_t(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", 16)


@_query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) - 1 AS pos, count(*) OVER () AS n FROM lineitem),
b AS (SELECT r, (r * m) // 16 AS lo, ((r + 1) * m) // 16 AS hi FROM range(16) t(r), (SELECT count(*) AS m FROM lineitem))
SELECT l_orderkey, l_linenumber, l_extendedprice, pos, CAST(r AS INTEGER) AS rank, pos - lo AS local_pos FROM s JOIN b ON pos >= lo AND pos < hi""")
def psort_partition(spark, sf):
    t = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return order.psort(t, "l_extendedprice", ["l_orderkey", "l_linenumber"], order.equal_counts(t.count(), 16))


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def topk_price(spark, sf):
    return order.top_k(_t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 100, F.col("o_totalprice").desc(), "o_orderkey")


@_query("SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def topk_per_group(spark, sf):
    t = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return order.top_k_per_group(t, ["o_custkey"], 3, F.col("o_totalprice").desc(), "o_orderkey").withColumn("place", F.col("place").cast("long"))


@_query("SELECT l_orderkey, coalesce(bool_and(p IS NULL OR p <= l_shipdate), true) AS is_sorted FROM (SELECT *, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) p FROM lineitem) GROUP BY 1")
def is_sorted(spark, sf):
    t = _t(spark, sf, "lineitem").withColumn("pos", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))
    return order.is_sorted(t, "l_orderkey", "pos", "l_shipdate")


@_query("SELECT count(p_partkey) = count(DISTINCT p_partkey) AND min(p_partkey) = (SELECT min(p_partkey) FROM part) AND max(p_partkey) - min(p_partkey) = count(*) - 1 AS is_permutation FROM part")
def is_permutation(spark, sf):
    t = _t(spark, sf, "part")
    low = t.agg(F.min("p_partkey").alias("m")).first()["m"]
    return order.is_permutation(t.select((F.col("p_partkey") - low).alias("i")), "i")


@_query("SELECT p_name, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS pos FROM part")
def permute(spark, sf):
    t = order.positions(_t(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice"), "p_retailprice", ["p_partkey"], "target")
    return order.permute(t.withColumnRenamed("p_partkey", "pos"), "pos", "target").select("p_name", "pos")


@_query("SELECT s_suppkey - 3 AS pos, s_name FROM supplier WHERE s_suppkey >= 3 AND s_suppkey < 53")
def array_view(spark, sf):
    return order.view(_t(spark, sf, "supplier").select(F.col("s_suppkey").alias("pos"), "s_name"), "pos", 3, 50)


@_query("SELECT c_custkey // 8 AS chunk, list(c_acctbal ORDER BY c_custkey) AS items FROM customer GROUP BY 1")
def array_reshape(spark, sf):
    return order.reshape(_t(spark, sf, "customer"), "c_custkey", "c_acctbal", 8)


@_query("""SELECT t AS type, CAST((SELECT count(*) FROM lineitem WHERE l_linenumber < t) AS BIGINT) AS offset FROM range(13) r(t)""")
def split_offsets(spark, sf):
    return group.split_offsets(_t(spark, sf, "lineitem"), "l_linenumber", 12)


@_query("SELECT event_id, user_id, event_type FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) nx FROM events) WHERE nx IS NULL OR nx <> event_type")
def uniq_last(spark, sf):
    return group.uniq_last(_t(spark, sf, "events").select("event_id", "user_id", "event_type"), ["user_id"], "event_type", "event_id")


@_query("SELECT user_id, f AS first_pos, row_number() OVER (ORDER BY f) - 1 AS position FROM (SELECT user_id, min(event_id) f FROM events GROUP BY 1)")
def insert_unique_pos(spark, sf):
    return group.insert_unique(_t(spark, sf, "events"), "user_id", "event_id")


@_query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS is_new FROM events")
def insert_unique_added(spark, sf):
    return group.added(_t(spark, sf, "events").select("event_id", "user_id"), "user_id", "event_id")


#: Operations of a slot store per user: three inserts, then two removes of slots in use, and so on.
_OPS = """SELECT user_id AS store, event_id AS pos, CASE WHEN i % 5 < 3 THEN 'insert' ELSE 'remove' END AS op, (event_id // 7 + CASE WHEN i % 5 = 4 THEN 1 ELSE 0 END) % (3 + i // 5) AS arg, i
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM (SELECT user_id, event_id FROM events))"""


def slot_operations(spark, sf):
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    t = _t(spark, sf, "events").select("user_id", "event_id").withColumn("i", i)
    arg = F.expr("(event_id div 7 + if(i % 5 = 4, 1, 0)) % (3 + i div 5)")
    return t.select(F.col("user_id").alias("store"), F.col("event_id").alias("pos"), F.when(F.col("i") % 5 < 3, "insert").otherwise("remove").alias("op"), arg.alias("arg"))


_SLOTS = f"""WITH o AS ({_OPS}),
s AS (SELECT *, sum(CASE WHEN op = 'remove' THEN 1 ELSE -1 END) OVER (PARTITION BY store ORDER BY pos) AS total FROM o),
m AS (SELECT *, least(min(total) OVER (PARTITION BY store ORDER BY pos), 0) AS low FROM s),
l AS (SELECT *, coalesce(lag(low) OVER (PARTITION BY store ORDER BY pos), 0) AS lower FROM m),
h AS (SELECT *, op = 'insert' AND low < lower AS fresh, CASE WHEN op = 'remove' THEN total - low WHEN low >= lower THEN total - low + 1 END AS height FROM l)
SELECT store, pos, CAST(CASE WHEN op = 'remove' THEN arg WHEN fresh THEN sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY store ORDER BY pos) - 1
  ELSE (SELECT arg_max(x.arg, x.pos) FROM h x WHERE x.store = h.store AND x.height = h.height AND x.op = 'remove' AND x.pos < h.pos) END AS BIGINT) AS slot FROM h"""


@_query(_SLOTS)
def recycle_slots(spark, sf):
    return group.recycle(slot_operations(spark, sf), "store", "pos", "op", "arg")


@_query("SELECT o_orderkey, coalesce((SELECT min(c_custkey) FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0), -1) AS position FROM orders")
def bsearch_position(spark, sf):
    c = _t(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey", F.col("c_custkey").alias("p"))
    return lookup.bsearch(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey", "c_custkey", "p").select("o_orderkey", "position")


@_query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def hash_lookup_semi(spark, sf):
    c = _t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return lookup.contains(_t(spark, sf, "orders"), c, "o_custkey", "c_custkey").select("o_orderkey")


@_query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def hash_lookup_anti(spark, sf):
    return lookup.contains(_t(spark, sf, "customer"), _t(spark, sf, "orders"), "c_custkey", "o_custkey", True).select("c_custkey")


@_query("""WITH a AS (SELECT p_size AS g, p_retailprice AS v, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice, p_partkey) - 1 AS pos FROM part),
q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::INTEGER AS g, l_extendedprice / 20 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(coalesce((SELECT min(pos) FROM a WHERE a.g = q.g AND a.v >= q.k), -1) AS BIGINT) AS position FROM q""")
def lower_bound(spark, sf):
    from pyspark.sql import Window

    p = _t(spark, sf, "part")
    a = p.select(F.col("p_size").alias("g"), F.col("p_retailprice").alias("v"), (F.row_number().over(Window.partitionBy("p_size").orderBy("p_retailprice", "p_partkey")) - 1).cast("long").alias("pos"))
    q = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("g"), (F.col("l_extendedprice") / 20).alias("k"))
    return lookup.lower_bound(q, a, "k", "v", "pos", "g").select("l_orderkey", "l_linenumber", "l_partkey", "position")


@_query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity >= 1 AND l_quantity < 10 THEN 0 WHEN l_quantity >= 10 AND l_quantity < 25 THEN 1 WHEN l_quantity >= 25 AND l_quantity < 40 THEN 2 ELSE 3 END AS slot FROM lineitem")
def bsearch_range(spark, sf):
    return lookup.bsearch_range(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), [1.0, 10.0, 25.0, 40.0], "l_quantity").drop("l_quantity")


@_query("SELECT c_custkey, CASE WHEN c_custkey < 100 THEN 0 WHEN c_custkey < 350 THEN 2 WHEN c_custkey < 351 THEN 3 ELSE 4 END AS rank FROM customer")
def bsearch_cumulative(spark, sf):
    return lookup.owner(_t(spark, sf, "customer").select("c_custkey"), [100, 0, 250, 1], "c_custkey")


#: Each kind of event is looked up among the events of another kind.
_KINDS = {"view": "click", "click": "purchase", "purchase": "error", "error": "signup", "signup": "view"}


@_query("""WITH q AS (SELECT {_CASE} AS g, ts, event_id FROM events), v AS (SELECT event_type AS g, ts, min(event_id) AS event_id FROM events GROUP BY ALL),
b AS (SELECT q.event_id, v.event_id AS before_id FROM q ASOF LEFT JOIN v ON q.g = v.g AND q.ts >= v.ts), a AS (SELECT q.event_id, v.event_id AS after_id FROM q ASOF LEFT JOIN v ON q.g = v.g AND q.ts <= v.ts)
SELECT event_id, before_id, after_id FROM b JOIN a USING (event_id)""".replace("{_CASE}", "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()) + " END"))
def asof_closest(spark, sf):
    e = _t(spark, sf, "events")
    kind = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    probes = e.select(F.try_element_at(kind, F.col("event_type")).alias("g"), "ts", F.col("event_id").alias("id"))
    array = e.select(F.col("event_type").alias("g"), F.col("ts").alias("v"), "event_id")
    got = lookup.closest(probes, array, "ts", "v", "event_id", "g")
    return got.select(F.col("id").alias("event_id"), F.col("before")["c"].alias("before_id"), F.col("after")["c"].alias("after_id"))


@_query("SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS pos FROM supplier")
def order_statistics(spark, sf):
    return order.positions(_t(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", ["s_suppkey"]).select("s_suppkey", "pos")


@_query("SELECT s_suppkey, s_acctbal, coalesce(sum(CAST(s_acctbal AS DECIMAL(18,2))) OVER (ORDER BY s_acctbal, s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before FROM supplier")
def running_total(spark, sf):
    t = _t(spark, sf, "supplier").select("s_suppkey", "s_acctbal", F.col("s_acctbal").cast("decimal(18,2)").alias("d"))
    return order.running_sum(t, "s_acctbal", ["s_suppkey"], "d", "before").select("s_suppkey", "s_acctbal", F.col("before").cast("double").alias("before"))


def _edges(spark, sf):
    return _t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.sum(F.col("l_quantity").cast("long")).alias("payload"))


_EDGES = "(SELECT l_suppkey AS src, l_partkey AS dst, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS payload FROM lineitem GROUP BY ALL)"


@_query(f"SELECT dst, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS nth, src FROM {_EDGES}")
def notify(spark, sf):
    return exchange.notify(_edges(spark, sf))


@_query(f"SELECT dst, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS nth, src, payload FROM {_EDGES}")
def notify_payload(spark, sf):
    return exchange.notify_payload(_edges(spark, sf))


@_query(f"SELECT dst, list(src ORDER BY src) AS senders, list(payload ORDER BY src) AS payloads FROM {_EDGES} GROUP BY 1")
def notify_gathered(spark, sf):
    return exchange.gathered(exchange.notify_payload(_edges(spark, sf)), payload="payload")


@_query(f"""WITH e AS (SELECT src, dst, CASE WHEN src % 3 = 0 THEN CAST([] AS BIGINT[]) ELSE [payload, 2 * src + 3] END AS p FROM {_EDGES})
SELECT dst, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS nth, src, p AS payload, CAST(coalesce(sum(len(p)) OVER (PARTITION BY dst ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM e""")
def notify_payloadv(spark, sf):
    two = F.when(F.col("src") % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("payload"), 2 * F.col("src") + 3))
    return exchange.notify_payloadv(_edges(spark, sf).withColumn("payload", two))


@_query(f"SELECT dst, count(*) AS n_senders, CAST(sum(payload) AS BIGINT) AS total_size FROM {_EDGES} GROUP BY 1")
def census(spark, sf):
    return exchange.census(_edges(spark, sf), size="payload")


def _peers(spark, sf):
    return _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("rank"), F.col("l_partkey").alias("peer"))


def _ranks(spark, sf):
    t = _t(spark, sf, "lineitem")
    return t.select(F.col("l_suppkey").alias("rank")).union(t.select("l_partkey")).distinct()


_PEERS = "(SELECT DISTINCT l_suppkey AS rank, l_partkey AS peer FROM lineitem)"
_RANKS = f"(SELECT rank AS r FROM {_PEERS} UNION SELECT peer FROM {_PEERS})"
_COVER = f"""p AS (SELECT * FROM {_PEERS} WHERE peer <> rank),
g AS (SELECT *, coalesce(peer - lag(peer) OVER (PARTITION BY rank ORDER BY peer) - 1, 0) AS gap FROM p),
h AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY gap DESC, peer) AS place FROM g),
k AS (SELECT *, sum(CASE WHEN gap > 0 AND place <= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY rank ORDER BY peer) AS range_no FROM h),
cover AS (SELECT rank, CAST(range_no AS BIGINT) AS range_no, min(peer) AS lo, max(peer) AS hi FROM k GROUP BY ALL)"""


@_query(f"WITH {_COVER} SELECT * FROM cover")
def ranges_cover(spark, sf):
    return ranges.cover(_peers(spark, sf), 6)


@_query(f"WITH {_COVER} SELECT DISTINCT c.rank AS src, n.r AS dst FROM cover c JOIN {_RANKS} n ON n.r BETWEEN c.lo AND c.hi AND n.r <> c.rank")
def ranges_decode(spark, sf):
    return ranges.decode(ranges.cover(_peers(spark, sf), 6), _ranks(spark, sf))


_UNCOVERED = f"""WITH {_COVER}, inside AS (SELECT DISTINCT c.rank, n.r FROM cover c JOIN {_RANKS} n ON n.r BETWEEN c.lo AND c.hi AND n.r <> c.rank),
extra AS (SELECT rank, count(*) AS n FROM (SELECT * FROM inside EXCEPT SELECT * FROM p) GROUP BY 1),
per AS (SELECT r AS rank, coalesce(n, 0) AS n FROM {_RANKS} LEFT JOIN extra ON r = rank)"""


@_query(f"{_UNCOVERED} SELECT * FROM per")
def ranges_uncovered(spark, sf):
    p = _peers(spark, sf)
    return ranges.uncovered(ranges.cover(p, 6), p, _ranks(spark, sf))


@_query(f"""{_UNCOVERED} SELECT count(*) AS n, CAST(sum(n) AS DOUBLE) AS total, CAST(min(n) AS DOUBLE) AS least, CAST(max(n) AS DOUBLE) AS greatest,
  min(rank) FILTER (n = (SELECT min(n) FROM per)) AS least_at, min(rank) FILTER (n = (SELECT max(n) FROM per)) AS greatest_at, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS deviation FROM per""")
def ranges_statistics(spark, sf):
    p = _peers(spark, sf)
    got = ranges.uncovered_statistics(ranges.cover(p, 6), p, _ranks(spark, sf))
    return got.select("n", "total", "least", "greatest", "least_at", "greatest_at", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@_query(f"WITH {_COVER} SELECT (SELECT max(c) FROM (SELECT count(*) AS c FROM p GROUP BY rank)) AS peers, (SELECT max(c) FROM (SELECT count(*) AS c FROM cover GROUP BY rank)) AS ranges")
def ranges_adaptive(spark, sf):
    return ranges.adaptive(_peers(spark, sf), 6)[1]


_BISECT = """WITH RECURSIVE t AS (SELECT count(*) AS n, min(l_extendedprice) AS lo0, max(l_extendedprice) AS hi0 FROM lineitem),
s(step, lo, hi, thr, c) AS (
  SELECT 0, {low}, {high}, {first}, (SELECT count(*) FROM lineitem WHERE l_extendedprice {op} {first}) FROM t
  UNION ALL
  SELECT step + 1, a, b, (a + b) / 2.0, (SELECT count(*) FROM lineitem WHERE l_extendedprice {op} (a + b) / 2.0) FROM (
    SELECT s.*, n, CASE WHEN {down} THEN lo ELSE thr END AS a, CASE WHEN {down} THEN thr ELSE hi END AS b FROM s, t WHERE step < 30 AND ({down} OR ({up} AND step > 0))))
SELECT round(thr, 6) AS threshold, c AS count, CAST({left} AS BIGINT) AS estimate, step AS steps FROM s, t ORDER BY step DESC LIMIT 1"""


def _found(spark, got: amr.Found) -> DataFrame:
    return spark.createDataFrame([(round(got.threshold, 6), got.count, got.estimate, got.steps)], "threshold double, count long, estimate long, steps int")


@_query(_BISECT.format(low="lo0", high="90000.0::DOUBLE", first="90000.0::DOUBLE", op="<", left="n - c", down="n - c < n * 7 // 10", up="n - c > floor((n * 7 // 10) / 0.95)"))
def amr_coarsen(spark, sf):
    t = _t(spark, sf, "lineitem")
    return _found(spark, amr.coarsen_search(t, "l_extendedprice", t.count() * 7 // 10, 90000.0, 0.95, 30))


@_query(_BISECT.format(low="10000.0::DOUBLE", high="hi0", first="10000.0::DOUBLE", op=">=", left="n + 3 * c", down="n + 3 * c < floor((n * 3 // 2) * 0.9)", up="n + 3 * c > n * 3 // 2").replace("step < 30 AND (n + 3 * c < floor((n * 3 // 2) * 0.9) OR (n + 3 * c > n * 3 // 2 AND step > 0))", "step < 30 AND (n + 3 * c > n * 3 // 2 OR (n + 3 * c < floor((n * 3 // 2) * 0.9) AND step > 0))").replace("c AS count", "3 * c AS count"))
def amr_refine(spark, sf):
    t = _t(spark, sf, "lineitem")
    return _found(spark, amr.refine_search(t, "l_extendedprice", t.count() * 3 // 2, 10000.0, 0.9, 30, lambda e, h: F.when(e >= h, 3)))


@_query("SELECT 50000.0::DOUBLE AS threshold, count(*) FILTER (l_extendedprice < 50000 AND l_returnflag = 'R') AS count, count(*) - count(*) FILTER (l_extendedprice < 50000 AND l_returnflag = 'R') AS estimate, 0 AS steps FROM lineitem")
def amr_custom(spark, sf):
    only = lambda e, h: F.when((e < h) & (F.col("l_returnflag") == "R"), 1)
    return _found(spark, amr.specify(_t(spark, sf, "lineitem"), "l_extendedprice", 50000.0, only))


@_query(_STATS.format(by="g", src="SELECT 0 AS g, l_extendedprice AS x, l_suppkey AS r FROM lineitem").replace("SELECT g, count(x)", "SELECT count(x)"))
def amr_error_statistics(spark, sf):
    return _rounded(amr.error_statistics(_t(spark, sf, "lineitem"), "l_extendedprice", "l_suppkey"))


def _groups(spark, sf):
    a = _t(spark, sf, "orders").groupBy((F.col("o_custkey") * 2).alias("member")).agg(F.min("o_orderkey").alias("pos"))
    b = _t(spark, sf, "supplier").groupBy((F.col("s_suppkey") * 3).alias("member")).agg(F.min("s_suppkey").alias("pos"))
    return a, b


_GROUPS = "WITH a AS (SELECT o_custkey * 2 AS member, min(o_orderkey) AS pos FROM orders GROUP BY 1), b AS (SELECT s_suppkey * 3 AS member, min(s_suppkey) AS pos FROM supplier GROUP BY 1) "


@_query(_GROUPS + "SELECT member, 0 AS side, pos FROM a UNION ALL SELECT member, 1, pos FROM b WHERE member NOT IN (SELECT member FROM a)")
def group_union(spark, sf):
    return setops.union(*_groups(spark, sf))


@_query(_GROUPS + "SELECT * FROM a WHERE member IN (SELECT member FROM b)")
def group_intersection(spark, sf):
    return setops.intersection(*_groups(spark, sf))


@_query(_GROUPS + "SELECT * FROM a WHERE member NOT IN (SELECT member FROM b)")
def group_difference(spark, sf):
    return setops.difference(*_groups(spark, sf))


@_query(_GROUPS + "SELECT a.pos, b.pos AS other FROM a LEFT JOIN b USING (member)")
def group_translate(spark, sf):
    return setops.translate(*_groups(spark, sf))


@_query("SELECT n_nationkey AS pos, n_name AS member FROM nation WHERE n_nationkey >= 1 AND n_nationkey <= 20 AND (n_nationkey - 1) % 4 = 0 AND n_nationkey <> 9")
def group_ranges(spark, sf):
    n = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("member"))
    return setops.exclude(setops.strided(n, 1, 20, 4), [9])


@_query(_GROUPS + "SELECT NOT EXISTS (SELECT member FROM a EXCEPT SELECT member FROM b) AND NOT EXISTS (SELECT member FROM b EXCEPT SELECT member FROM a) AS same")
def group_compare(spark, sf):
    return setops.same_members(*_groups(spark, sf))


@_query("""SELECT p_partkey, CAST(power(p_size % 9 + 1, p_partkey % 7) AS BIGINT) AS ipow, length(bin(p_partkey)) - 1 + CASE WHEN p_partkey = 0 THEN -1 ELSE 0 END AS lg,
  CASE WHEN p_size <= 0 THEN 0 WHEN p_size = 1 THEN 1 ELSE CAST(power(2, length(bin(p_size - 1))) AS BIGINT) END AS up, (p_partkey + 23) // 24 * 24 AS aligned, (p_partkey + 31) // 32 * 32 AS aligned2 FROM part""")
def integer_math(spark, sf):
    p = F.col("p_partkey")
    return _t(spark, sf, "part").select(p, mathx.intpow(F.col("p_size") % 9 + 1, p % 7).alias("ipow"), mathx.log2_floor(p).alias("lg"), mathx.roundup2(F.col("p_size")).alias("up"), mathx.align_up(p, 24).alias("aligned"), mathx.align_up(p, 32).alias("aligned2"))


@_query("""SELECT s, CAST(least(greatest(v, -2147483648), 2147483647) AS INTEGER) AS i, CAST(least(greatest(v, CAST(-9223372036854775808 AS HUGEINT)), 9223372036854775807) AS BIGINT) AS l
FROM (SELECT s, CAST(s AS HUGEINT) AS v FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE '' END || CAST(c_custkey AS VARCHAR) || repeat('7', CAST(c_custkey % 25 AS INTEGER)) AS s FROM customer))""")
def parse_saturating(spark, sf):
    c = F.col("c_custkey")
    s = F.concat(F.when(c % 3 == 0, "-").otherwise(""), c.cast("string"), F.expr("repeat('7', cast(c_custkey % 25 as int))"))
    return _t(spark, sf, "customer").select(s.alias("s")).select("s", mathx.parse_int(F.col("s"), 32).alias("i"), mathx.parse_int(F.col("s"), 64).alias("l"))


@_query("""SELECT p_partkey, CASE WHEN t < lft THEN lft WHEN t >= lft + w THEN lft + w - 1 ELSE t END AS bias
FROM (SELECT *, (p_partkey % CAST(power(2, lv) AS BIGINT)) * w AS lft FROM (SELECT p_partkey, p_size % 8 AS lv, CAST(power(2, 10 - p_size % 8) AS BIGINT) AS w, p_partkey * 37 % 1024 AS t FROM part))""")
def search_bias(spark, sf):
    lv, p = F.col("p_size") % 8, F.col("p_partkey")
    return _t(spark, sf, "part").select("p_partkey", mathx.search_bias(10, lv, p % F.pow(F.lit(2), lv).cast("long"), p * 37 % 1024).alias("bias"))


@_query("SELECT p_partkey, round(sqrt(y), 4) AS root FROM (SELECT p_partkey, (p_partkey % 97 + 1) / 100.0 AS y FROM part)")
def invert_square(spark, sf):
    y = (F.col("p_partkey") % 97 + 1) / 100.0
    return _t(spark, sf, "part").select("p_partkey", F.round(mathx.invert(lambda x: x * x, 0.0, 1.0, y, 1e-10), 4).alias("root"))


def _poly(spark, sf):
    c = F.array((F.col("p_size") - 20).cast("double"), (F.col("p_partkey") % 11 - 5).cast("double"), (F.col("p_partkey") % 3 - 1).cast("double"))
    return _t(spark, sf, "part").select("p_partkey", c.alias("c"))


_POLY = "(SELECT p_partkey, (p_size - 20)::DOUBLE AS c0, (p_partkey % 11 - 5)::DOUBLE AS c1, (p_partkey % 3 - 1)::DOUBLE AS c2 FROM part)"


@_query(f"SELECT p_partkey, c0 + 1.5 * (c1 + 1.5 * c2) AS value, [c0 - 2, c1, c2 + 1, 4.0] AS summed, [0.0, 3 * c0, 3 * c1, 3 * c2] AS scaled, [c0, c1 - c0, c2 - c1, 0 - c2] AS product FROM {_POLY}")
def polynomials(spark, sf):
    c = F.col("c")
    q = F.array(*[F.lit(float(v)) for v in (-2, 0, 1)])
    return _poly(spark, sf).select("p_partkey", poly.evaluate(c, F.lit(1.5)).alias("value"), poly.shift(poly.add(c, q), 3, 4.0).alias("summed"), poly.scale(c, 1, 3.0).alias("scaled"), poly.multiply(c, F.array(F.lit(1.0), F.lit(-1.0))).alias("product"))


@_query(f"""SELECT p_partkey, CASE WHEN c2 = 0 AND c1 = 0 THEN CAST([] AS DOUBLE[]) WHEN c2 = 0 THEN [round(-c0 / c1, 6) + 0.0]
  WHEN c1 * c1 - 4 * c2 * c0 < 0 THEN CAST([] AS DOUBLE[]) WHEN c1 * c1 - 4 * c2 * c0 = 0 THEN [round(-c1 / (2 * c2), 6) + 0.0]
  ELSE list_sort([round((-c1 - sqrt(c1 * c1 - 4 * c2 * c0)) / (2 * c2), 6) + 0.0, round((-c1 + sqrt(c1 * c1 - 4 * c2 * c0)) / (2 * c2), 6) + 0.0]) END AS roots FROM {_POLY}""")
def polynomial_roots(spark, sf):
    return _poly(spark, sf).select("p_partkey", F.transform(poly.roots(F.col("c")), lambda x: F.round(x, 6) + 0.0).alias("roots"))


@_query("SELECT p_partkey, round((x - 2) * (x - 5) / 3.0, 6) + 0.0 AS basis FROM (SELECT p_partkey, p_size / 7.0 AS x FROM part)".replace("/ 3.0", "/ ((-1.0 - 2) * (-1.0 - 5))"))
def lagrange_basis(spark, sf):
    c = F.array(*[F.lit(v) for v in poly.lagrange(0, [-1.0, 2.0, 5.0])])
    return _t(spark, sf, "part").select("p_partkey", (F.round(poly.evaluate(c, F.col("p_size") / 7.0), 6) + 0.0).alias("basis"))


#: The generator's constants, written out once more: a wrong one in the library shows.
_RNG = ((0xBAA96887, 0x4B0F3B58), (0x1E17D32C, 0xE874F0C3), (0x03BCDC3C, 0x6955C5A6), (0x0F33D1B2, 0x55A7CA46))


def _rng_sql(src: str, keep: str) -> str:
    """u of a table with columns keep and n (the counter)."""
    step = "SELECT {keep}, r AS l, xor(l, (hi * lo + xor(((b & 65535) << 16) | (b >> 16), {y})) & 4294967295) AS r FROM (SELECT *, (4294967295 - hi * hi + lo * lo) & 4294967295 AS b FROM (SELECT *, xor(r, {x}) >> 16 AS hi, xor(r, {x}) & 65535 AS lo FROM ({src})))"
    sql = f"SELECT {keep}, n >> 32 AS l, n & 4294967295 AS r FROM ({src})"
    for x, y in _RNG:
        sql = step.format(x=x, y=y, src=sql, keep=keep)
    return f"SELECT {keep}, r / 4294967296.0::DOUBLE AS u FROM ({sql})"


@_query(_rng_sql("SELECT o_orderkey, o_orderkey * 1000003 AS n FROM orders", "o_orderkey"))
def rng_uniform(spark, sf):
    return _t(spark, sf, "orders").select("o_orderkey", rng.uniform(F.col("o_orderkey") * 1000003).alias("u"))


_DRAWS = "draws AS (" + _rng_sql("SELECT s_suppkey, i, s_suppkey * 1000 + i AS n FROM supplier, range(64) t(i)", "s_suppkey, i") + ")"


@_query(f"""WITH {_DRAWS}, pairs AS (SELECT a.s_suppkey, a.i, 2 * (a.u - 0.5) AS x, 2 * (b.u - 0.5) AS y FROM draws a JOIN draws b ON a.s_suppkey = b.s_suppkey AND b.i = a.i + 1 WHERE a.i % 2 = 0),
hits AS (SELECT *, x * x + y * y AS q, row_number() OVER (PARTITION BY s_suppkey ORDER BY i) AS k FROM pairs WHERE x * x + y * y > 0 AND x * x + y * y < 1)
SELECT s_suppkey, round(x * sqrt(-2 * ln(q) / q), 9) AS first, round(y * sqrt(-2 * ln(q) / q), 9) AS second FROM hits WHERE k = 1""")
def rng_normal(spark, sf):
    got = _t(spark, sf, "supplier").select("s_suppkey", rng.normal_pair(F.col("s_suppkey") * 1000).alias("n"))
    return got.select("s_suppkey", F.round("n.first", 9).alias("first"), F.round("n.second", 9).alias("second"))


@_query(f"""WITH {_DRAWS}, p AS (SELECT s_suppkey, i, exp(sum(ln(greatest(u, 1e-300))) OVER (PARTITION BY s_suppkey ORDER BY i)) AS p FROM draws)
SELECT s_suppkey, min(i) FILTER (p <= exp(-5.0)) AS small_mean FROM p GROUP BY 1""")
def rng_poisson(spark, sf):
    return _t(spark, sf, "supplier").select("s_suppkey", rng.poisson(F.col("s_suppkey") * 1000, F.lit(5.0)).alias("small_mean"))


@_query(None)
def rng_poisson_rejection(spark, sf):
    return _t(spark, sf, "supplier").select("s_suppkey", rng.poisson(F.col("s_suppkey") * 1000, F.lit(20.0)).alias("poisson"))


@_query("SELECT o_orderkey, CASE WHEN a.u < 1 / 13.0 AND b.u < 0.01 * 13 THEN 1 ELSE 0 END AS small FROM (" + _rng_sql("SELECT o_orderkey, o_orderkey * 1000 AS n FROM orders", "o_orderkey") + ") a JOIN ("
        + _rng_sql("SELECT o_orderkey, o_orderkey * 1000 + 1 AS n FROM orders", "o_orderkey") + ") b USING (o_orderkey)")
def rng_small(spark, sf):
    return _t(spark, sf, "orders").select("o_orderkey", rng.small(F.col("o_orderkey") * 1000, F.lit(0.01)).cast("int").alias("small"))


@_query("SELECT s_suppkey, CASE WHEN u < 0.2 THEN 0 WHEN u < 0.5 THEN 1 WHEN u < 0.95 THEN 2 ELSE 3 END AS drawn FROM (" + _rng_sql("SELECT s_suppkey, s_suppkey * 77 AS n FROM supplier", "s_suppkey") + ")")
def rng_cumulative(spark, sf):
    return _t(spark, sf, "supplier").select("s_suppkey", rng.by_cumulative(F.col("s_suppkey") * 77, [0.0, 0.2, 0.5, 0.95, 1.0]).alias("drawn"))


_U = "(CAST(9223372036854770000 AS UHUGEINT) + CAST(p_partkey AS UHUGEINT)) * '18446744073709551616'::UHUGEINT + CAST(9223372036854775807 AS UHUGEINT) + CAST(p_size AS UHUGEINT)"


@_query(f"""SELECT p_partkey, lpad(hex(a + b), 32, '0') AS total, lpad(hex(a - b), 32, '0') AS less, lpad(hex(a // 137438953472), 32, '0') AS halved, CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END AS cmp
FROM (SELECT p_partkey, {_U} AS a, CAST(p_partkey AS UHUGEINT) * '18446744073709551616'::UHUGEINT + CAST(p_size * 1000003 AS UHUGEINT) AS b FROM part)""")
def uint128(spark, sf):
    p, s = F.col("p_partkey"), F.col("p_size").cast("long")
    big = F.lit(-(1 << 63)) + (s - 1)  # 2^63 - 1 + s as unsigned
    # 9223372036854770000 + p_partkey as unsigned, without passing the largest bigint on the way
    high = F.lit(9223372036854770000 - (1 << 63)) + p
    a, b = u128.make(high.bitwiseXOR(F.lit(-(1 << 63))), F.when(s >= 1, big).otherwise(F.lit(9223372036854775807))), u128.make(p, s * 1000003)

    join = lambda v: F.concat(F.lpad(F.hex(v["hi"]), 16, "0"), F.lpad(F.hex(v["lo"]), 16, "0"))
    df = _t(spark, sf, "part").select(p, a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    return df.select("p_partkey", join(u128.add(a, b)).alias("total"), join(u128.subtract(a, b)).alias("less"), join(u128.shift_right(a, 37)).alias("halved"), u128.compare(a, b).alias("cmp"))


def _points(spark, sf):
    return _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 21 - 10.0).alias("x"), (F.col("c_nationkey") - 12.0).alias("y"), (F.col("c_custkey") % 37 - 30.0).alias("z"))


_POINTS = "(SELECT c_custkey AS id, c_custkey % 21 - 10.0 AS x, c_nationkey - 12.0 AS y, c_custkey % 37 - 30.0 AS z FROM customer)"
_EYE = camera.Camera(position=(1.0, 2.0, 12.0), near=0.5, far=30.0)


@_query(f"SELECT id FROM {_POINTS} WHERE 12 - z >= 0.5 AND 12 - z <= 30 AND abs(x - 1) <= 12 - z AND abs(y - 2) <= 12 - z")
def camera_clip_before(spark, sf):
    return camera.clip_before(_points(spark, sf), _EYE).select("id")  # many of these points lie on a plane


@_query(f"SELECT id, round(x - 1, 6) AS x, round(y - 2, 6) AS y, round(z - 12, 6) AS z FROM {_POINTS}")
def camera_view(spark, sf):
    got = camera.view_transform(_points(spark, sf), _EYE)
    return got.select("id", *[F.round(c, 6).alias(c) for c in "xyz"])


@_query(f"""SELECT id, round((x - 1) / w, 6) AS x, round((y - 2) / w, 6) AS y, round((-(30.5 / 29.5) * -w - 30 / 29.5) / w, 6) AS z
FROM (SELECT *, 12 - z AS w FROM {_POINTS}) WHERE w >= 0.5 AND w <= 30 AND abs(x - 1) <= w AND abs(y - 2) <= w""")
def camera_project(spark, sf):
    seen = camera.projection_transform(camera.view_transform(_points(spark, sf), _EYE), _EYE)
    inside = camera.clip_after(seen.withColumns({"x": F.round("x", 9), "y": F.round("y", 9), "z": F.round("z", 9)}))
    return camera.perspective_division(inside).select("id", *[F.round(c, 6).alias(c) for c in "xyz"])


@_query("""SELECT c_custkey, 'i' AS k1, CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS balance, 'none' AS missing, 1 AS st_missing, 2 AS st_wrong, 0 AS st_ok FROM customer""")
def keyvalue_access(spark, sf):
    store = kv.build([("nation", "s", F.lit("old")), ("nation", "i", F.col("c_nationkey")), ("balance", "g", F.col("c_acctbal")), ("gone", "s", F.col("c_name"))])
    m = kv.put(kv.unset(store, "gone"), "name", "s", F.col("c_name"))
    return _t(spark, sf, "customer").select(
        "c_custkey", kv.kind_of(m, "nation").alias("k1"), kv.get(m, "nation", "i", 0).alias("nation"), kv.get(m, "balance", "g", 0.0).alias("balance"),
        kv.get(m, "gone", "s", "none").alias("missing"), kv.status(m, "gone", "s").alias("st_missing"), kv.status(m, "nation", "s").alias("st_wrong"), kv.status(m, "name", "s").alias("st_ok"),
    )


@_query("""SELECT r, v[3] AS third, list_append(v, 'x') AS pushed, v[1:len(v) - 1] AS popped, list_prepend('x', v) AS front, v[1:1] || v[3:4] || v[4:] AS moved
FROM (SELECT n_regionkey AS r, list(n_name ORDER BY n_nationkey) AS v FROM nation GROUP BY 1)""")
def list_operations(spark, sf):
    t = reduce.gathered(reduce.allgather(_t(spark, sf, "nation"), "n_nationkey", "n_name", ["n_regionkey"]), ["n_regionkey"])
    v = F.col("gathered")
    return t.select(
        F.col("n_regionkey").alias("r"), arrays.element(v, 2).alias("third"), arrays.push(v, F.lit("x")).alias("pushed"), arrays.pop(v).alias("popped"),
        arrays.prepend(v, F.lit("x")).alias("front"), arrays.move_part(v, 1, v, 2, 2).alias("moved"),
    )


#: Adler-32 of a binary value d of each key k, from its hexadecimal digits.
_ADLER = """SELECT k, CAST(((n + coalesce(sum((n - i) * c), 0)) % 65521) * 65536 + (1 + coalesce(sum(c), 0)) % 65521 AS BIGINT) AS checksum
FROM (SELECT k, n, i, CAST('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT) AS c FROM (SELECT k, n, h, unnest(CASE WHEN n = 0 THEN [0] ELSE range(n) END) AS i FROM (SELECT k, octet_length(d) AS n, hex(d) || CASE WHEN octet_length(d) = 0 THEN '00' ELSE '' END AS h FROM ({src})))) GROUP BY k, n"""


@_query(_ADLER.replace("{src}", "SELECT doc_id AS k, encode(text) AS d FROM documents"))
def checksum_adler32(spark, sf):
    return _t(spark, sf, "documents").select(F.col("doc_id").alias("k"), hashing.adler32(F.col("text").cast("binary")).alias("checksum"))


@_query(_ADLER.replace("{src}", "SELECT s_nationkey AS k, encode(string_agg(s_name, '' ORDER BY s_suppkey)) AS d FROM supplier GROUP BY 1"))
def checksum_of_array(spark, sf):
    t = _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey", F.col("s_name").cast("binary").alias("d"))
    return hashing.array_checksum(t, "k", "s_suppkey", "d")


@_query(None)
def hash_strings(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", hashing.hash_string("p_name").alias("hash"))


@_query("SELECT doc_id, strlen(text) AS size, 'z' AS format, md5(text) AS back FROM documents")
def codec_round_trip(spark, sf):
    t = _t(spark, sf, "documents").select("doc_id", codec.encode(F.col("text").cast("binary")).alias("code"))
    return t.select("doc_id", codec.original_size(F.col("code")).alias("size"), codec.format_char(F.col("code")).alias("format"), F.md5(codec.decode("code")).alias("back"))


@_query("""SELECT doc_id, md5(replace(base64(from_hex(printf('%02x%02x%02x%02x', n % 256, n // 256 % 256, n // 65536 % 256, n // 16777216)) || d), chr(10), '')) AS code
FROM (SELECT doc_id, encode(text) AS d, strlen(text) AS n FROM documents)""")
def codec_vtk(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.md5(codec.encode_vtk_binary(F.col("text").cast("binary"))).alias("code"))


@_query("""SELECT doc_id, CAST(ceil(n / 32768.0) AS BIGINT) AS blocks, CASE WHEN n % 32768 = 0 THEN 32768 ELSE n % 32768 END AS last, md5(text) AS back FROM (SELECT *, strlen(text) AS n FROM documents)""")
def codec_vtk_compressed(spark, sf):
    t = _t(spark, sf, "documents").select("doc_id", codec.decode_vtk_compressed(codec.encode_vtk_compressed(F.col("text").cast("binary"))).alias("r"))
    return t.select("doc_id", "r.blocks", "r.last", F.md5("r.data").alias("back"))


@_query("SELECT doc_id, n + 6 + 5 * greatest(1, CAST(ceil(n / 65531.0) AS BIGINT)) AS size, true AS fits, md5(text) AS back FROM (SELECT *, strlen(text) AS n FROM documents)")
def codec_stored(spark, sf):
    t = _t(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("n"), codec.encode_stored(F.col("text").cast("binary")).alias("z"))
    size = codec.stored_size(F.col("n"))
    return t.select("doc_id", size.alias("size"), (F.octet_length("z") == size).alias("fits"), F.md5(codec.inflate("z")).alias("back"))


@_query("SELECT l_suppkey AS msg, CAST(8 + 4 * count(*) AS BIGINT) AS size, list(CAST(l_quantity AS BIGINT)::DOUBLE ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS back FROM lineitem GROUP BY 1")
def pack_messages(spark, sf):
    items = F.transform(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))), lambda s: F.floor(s["l_quantity"]).cast("double"))
    t = _t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("msg")).agg(items.alias("v")).withColumn("t", F.lit(0))
    return t.select("msg", bytesio.pack_size(F.col("t"), F.col("v")).alias("size"), bytesio.unpack(bytesio.pack("t", "v")).alias("back"))


@_query("""SELECT event_type, strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(value) AS n, round(sum(value), 3) AS total, min(value) AS least, max(value) AS greatest FROM events GROUP BY ALL""")
def windowed_statistics(spark, sf):
    t = _t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    got = streaming.windowed_statistics(t, "ts", "event_type", "value", "1 hour", "10 minutes")
    return got.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("total", 3).alias("total"), "least", "greatest")


from rankframe.plans import extended  # noqa: E402, F401  (more queries, which register themselves here)
