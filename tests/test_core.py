"""Operators on cases that the shared tables do not hold: nulls, ties, hot groups, wide intervals, late events, broken texts."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankframe.functions import arrays, camera, hashing, mathx, rng
from rankframe.functions import keyvalue as kv
from rankframe.operators import amr, exchange, group, lookup, order, ranges, reduce, setops, stats
from rankframe.plans import catalog
from rankframe.sources import bytesio, codec, options, scda
from rankframe.streaming import events


def test_integers_at_their_ends(spark):
    xs = [2**60 + 1, 2**62, 2**62 + 1, 2**53 + 1, 0, 1, 5, None, 2**63 - 1]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    got = df.select("x", mathx.align_up(F.col("x"), 24).alias("a"), mathx.roundup2(F.col("x")).alias("r")).collect()
    for row in got:
        x = row["x"]
        if x is None:
            assert row["a"] is None and row["r"] is None
            continue
        up, two = -(-x // 24) * 24, 1 << (x - 1).bit_length() if x > 0 else 0
        assert row["a"] == (up if up < 2**63 else None)
        assert row["r"] == (two if two < 2**63 else None)


def test_null_slots_and_runs(spark):
    df = spark.createDataFrame([(None, 1.0, 0), (None, 2.0, 1), ("a", 3.0, 0)], "s string, v double, rank int")
    assert sorted((r["s"] or "", r["m"]) for r in reduce.allreduce(df, "s", "v", "MAX", "m").collect()) == [("", 2.0), ("", 2.0), ("a", 3.0)]
    runs = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "a"), (1, 4, "a"), (1, 5, None)], "g int, p int, k string")
    assert sorted(r["p"] for r in group.uniq_last(runs, ["g"], "k", "p").collect()) == [2, 4, 5]


def test_order_of_any_type_with_ties(spark):
    r = random.Random(1)
    rows = [(i, r.choice("abc") if i % 10 else None, 2**60 + r.randrange(3)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, n long")
    want = sorted(rows, key=lambda x: (x[1] is not None, x[1] or "", x[0]))
    got = order.positions(df, "k", ["id"]).orderBy("pos").collect()
    assert [(x["id"], x["pos"]) for x in got] == [(w[0], i) for i, w in enumerate(want)]
    got = order.positions(df, "n", ["id"]).orderBy("pos").collect()
    assert [x["id"] for x in got] == [w[0] for w in sorted(rows, key=lambda x: (x[2], x[0]))]
    in_group = order.grouped_positions(df, ["k"], "n", ["id"], "nth").collect()
    per = {}
    for w in sorted(rows, key=lambda x: (x[2], x[0])):
        per.setdefault(w[1], []).append(w[0])
    assert all(per[x["k"]][x["nth"]] == x["id"] for x in in_group)
    assert order.kth(df, "n", ["id"], 1000).count() == 0
    empty = df.limit(0)
    assert order.positions(empty, "n", ["id"]).count() == order.pops(empty, "n", ["id"]).count() == 0


def test_running_sum_over_ranges(spark):
    spark_rows = [(i, i % 7) for i in range(1000)]
    got = order.running_sum(spark.createDataFrame(spark_rows, "id long, v long"), "v", ["id"], "id", "before").collect()
    total, want = 0, {}
    for i, v in sorted(spark_rows, key=lambda x: (x[1], x[0])):
        want[i] = total
        total += i
    assert {x["id"]: x["before"] for x in got} == want


@pytest.mark.parametrize("seed", range(3))
def test_neighbours_with_a_hot_group(spark, seed):
    """Most rows are of one group, entries are few and far apart, so they are carried over many ranges."""
    r = random.Random(seed)
    probes = [(i, r.choice(["hot", "hot", "hot", "hot", "cold", None]), r.randrange(300) if r.random() < 0.95 else None) for i in range(400)]
    array = [(r.choice(["hot", "cold", None]), r.randrange(300), 1000 + j) for j in range(15)] + [("hot", None, 5)]
    p = spark.createDataFrame(probes, "id long, g string, k int")
    a = spark.createDataFrame(array, "g string, v int, c long")
    got = {x["id"]: x for x in lookup.closest(p, a, "k", "v", "c", "g").collect()}
    side = {x["id"]: x["side"] for x in lookup.nearest(p, a, "k", "v", "c", "g").collect()}
    for i, g, k in probes:
        own = [(v, c) for h, v, c in array if h == g and v is not None]
        low = max((v for v, _ in own if k is not None and v <= k), default=None)
        high = min((v for v, _ in own if k is not None and v >= k), default=None)
        want = [None if x is None else (x, min(c for v, c in own if v == x)) for x in (low, high)]
        have = [None if x is None else (x["v"], x["c"]) for x in (got[i]["before"], got[i]["after"])]
        assert have == want
        assert side[i] == (0 if low is not None and low == k else -1 if low is not None else 1 if high is not None else None)
    assert lookup.closest(p, a.limit(0), "k", "v", "c", "g").where("before is not null or after is not null").count() == 0


def test_owner_of_many_ranks(spark):
    counts = [3, 0, 0, 5, 1, 0, 2]
    own = [r for r, n in enumerate(counts) for _ in range(n)]
    c = spark.createDataFrame(list(enumerate(counts)), "rank long, n long")
    got = lookup.owner_of(spark.range(14), c, "id").collect()
    assert {x["id"]: x["rank"] for x in got} == {i: own[i] if i < len(own) else None for i in range(14)}


def test_wide_intervals_cost_their_ranks(spark):
    r = spark.createDataFrame([(0, -(10**15), 10**15), (5, 6, 6), (7, 3, 2)], "rank long, lo long, hi long")
    ranks = spark.createDataFrame([(x,) for x in (0, 5, 6, 10**12)], "rank long")
    assert sorted(tuple(x) for x in ranges.decode(r, ranks).collect()) == [(0, 5), (0, 6), (0, 10**12), (5, 6)]
    per = {x["rank"]: x["n"] for x in ranges.uncovered(r, spark.createDataFrame([(0, 5)], "rank long, peer long"), ranks).collect()}
    assert per == {0: 2, 5: 1, 6: 0, 10**12: 0}


def test_decode_makes_pairs_last(spark, monkeypatch):
    """Overlapping intervals over many blocks, some of many pieces; what is made of pairs is not shuffled again."""
    monkeypatch.setattr(ranges, "BLOCK", 4)
    monkeypatch.setattr(ranges, "PIECES", 3)
    r = [(s, lo, lo + 7 * k) for s in range(0, 40, 3) for k, lo in enumerate((s % 5, 10, 12, 60))] + [(100, 0, 200), (None, 0, 9), (1, None, 5)]
    have = list(range(0, 90, 2)) + [3, 100]
    ranks = spark.createDataFrame([(x,) for x in have] + [(None,)], "rank long")
    got = ranges.decode(spark.createDataFrame(r, "rank long, lo long, hi long"), ranks)
    want = sorted({(s, d) for s, lo, hi in r if None not in (s, lo) for d in have if lo <= d <= hi and d != s})
    assert sorted(tuple(x) for x in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("Generate")] and "Aggregate" not in plan[: plan.index("Generate")]


@pytest.mark.parametrize("name", ["uncovered", "uncovered_statistics"])
def test_uncovered_is_counted_not_listed(spark, monkeypatch, name):
    monkeypatch.setattr(ranges, "decode", None)
    monkeypatch.setattr(ranges, "BLOCK", 4)
    r = [(s, lo, lo + 7 * k) for s in range(0, 40, 3) for k, lo in enumerate((s % 5, 10, 12, 60))] + [(100, 0, 200)]
    have = list(range(0, 90, 2)) + [3, 100]
    peers = [(s, d) for s in range(0, 101, 5) for d in range(s % 4, 100, 3)] * 2
    ranks = spark.createDataFrame([(x,) for x in have], "rank long")
    got = getattr(ranges, name)(spark.createDataFrame(r, "rank long, lo long, hi long"), spark.createDataFrame(peers, "rank long, peer long"), ranks)
    want = {s: len({d for x, lo, hi in r if x == s for d in have if lo <= d <= hi and d != s and (s, d) not in set(peers)}) for s in have}
    if name == "uncovered":
        assert {x["rank"]: x["n"] for x in got.collect()} == want
    else:
        assert [(x["n"], x["total"], x["least"], x["greatest"]) for x in got.collect()] == [(len(want), sum(want.values()), min(want.values()), max(want.values()))]


def test_decode_reads_intervals_once(spark, monkeypatch):
    """Their plan, which may be long, is run once; intervals with and without gaps among the ranks, cut at blocks, and the widest."""
    monkeypatch.setattr(ranges, "BLOCK", 4)
    monkeypatch.setattr(ranges, "PIECES", 3)
    least, most = -(2**63), 2**63 - 1
    r = [(0, 0, 30), (1, 3, 9), (1, 9, 20), (2, 35, 60), (3, 8, 8), (4, 70, 65), (5, least, most), (6, most, most), (7, least, least), (8, 31, 33)]
    have = [least, *range(31), *range(40, 60, 3), most]
    seen = spark.sparkContext.accumulator(0)

    def count(x: int) -> int:
        seen.add(1)
        return x

    kept = spark.createDataFrame(r, "src long, lo long, hi long").select(F.udf(count, "long").asNondeterministic()("src").alias("rank"), "lo", "hi")
    got = sorted(tuple(x) for x in ranges.decode(kept, spark.createDataFrame([(x,) for x in have * 2], "rank long")).collect())
    assert got == sorted({(s, d) for s, lo, hi in r for d in have if lo <= d <= hi and d != s})
    assert seen.value <= len(r)


def test_cover_of_repeated_peers(spark):
    """Peers in any number of copies, the rank itself, nulls, equal gaps; one shuffle."""
    rows = [(1, 5), (1, 5), (1, 1), (1, 6), (1, 9), (1, 12), (1, 9), (2, 2), (3, 4), (3, 4), (3, None), (None, 7), (4, -3), (4, 10), (4, 11), (4, -9)]
    peers = spark.createDataFrame(rows, "rank long, peer long")
    for n in (0, 1, 2, 3, 9):
        want = []
        for rank in (1, 3, 4):
            have = sorted({p for r, p in rows if r == rank and p not in (None, rank)})
            cuts = sorted(sorted(((a + 1 - b, b) for a, b in zip(have, have[1:]) if b > a + 1))[: max(n - 1, 0)], key=lambda c: c[1])
            starts = [have[0], *[c[1] for c in cuts]]
            want += [(rank, i, lo, max(p for p in have if p < (starts[1:] + [99])[i])) for i, lo in enumerate(starts)]
        got = ranges.cover(peers, n)
        assert sorted(tuple(x) for x in got.collect()) == want
    assert ranges.cover(peers, 6)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_superset_by_key(spark, monkeypatch):
    monkeypatch.setattr(exchange, "BLOCK", 3)
    monkeypatch.setattr(exchange, "RECEIVERS", 2)
    e = [(s, d) for s in range(25) for d in range(30) if (s * d) % 7 == 1] * 2
    got = exchange.superset_by_key(spark.createDataFrame(e, "src long, dst long"), lambda c: c % 2)
    srcs, dsts = {s for s, _ in e}, {d for _, d in e}
    want = sorted((d, s, (s, d) in set(e)) for s in srcs for d in dsts if s % 2 == d % 2 or (s, d) in set(e))
    assert sorted(tuple(x) for x in got.collect()) == want


def test_exchange(spark):
    e = spark.createDataFrame([(s, d, 10 * s + d) for s in range(6) for d in range(4) if (s + d) % 3], "src long, dst long, payload long")
    want = {d: [s for s in range(6) if (s + d) % 3] for d in range(4)}
    got = {}
    for x in exchange.notify(e, method="nary").orderBy("dst", "nth").collect():
        got.setdefault(x["dst"], []).append(x["src"])
    assert got == want
    with pytest.raises(ValueError):
        exchange.notify(e, method="pigeon")
    records = exchange.encode(e)
    both = exchange.merge(records.where("src < 3"), records.where("src >= 3")).collect()
    assert {x["to"]: x["record"] for x in both} == {d: [d, len(ss), *[v for s in ss for v in (s, 10 * s + d)]] for d, ss in want.items()}
    back = exchange.decode(exchange.merge(records.where("src < 3"), records.where("src >= 3")))
    assert sorted(map(tuple, back.collect())) == sorted((x["dst"], x["src"], x["payload"]) for x in e.collect())
    calls = spark.createDataFrame([(0, 1, 7, 1), (0, 1, 7, 2), (0, 1, 8, 1)], "src int, dst int, tag int, at int")
    met = exchange.matched(calls, calls.where("tag = 7").limit(1)).collect()
    assert len(met) == 1 and met[0]["at"] == 1
    assert exchange.consistent(calls, "src", ["dst"]).first()["consistent"]


def test_slots_against_a_stack(spark):
    r, rows = random.Random(3), []
    for g in range(4):
        used, free, top = [], [], 0
        for p in range(120):
            if used and r.random() < 0.45:
                s = used.pop(r.randrange(len(used)))
                free.append(s)
                rows.append((g, p, "remove", s, s))
            else:
                s = free.pop() if free else top
                top = max(top, s + 1)
                used.append(s)
                rows.append((g, p, "insert", 0, s))
    df = spark.createDataFrame([x[:4] for x in rows], "g int, p int, op string, arg int")
    got = {(x["g"], x["p"]): x["slot"] for x in group.recycle(df, "g", "p", "op", "arg").collect()}
    assert got == {(g, p): s for g, p, _, _, s in rows}


def test_amr_by_brute_force(spark):
    r = np.random.default_rng(2)
    errors = r.exponential(1.0, 400)
    df = spark.createDataFrame([(float(x),) for x in errors], "e double")

    def search(low, high, first, judge):
        at, step = first, 0
        while True:
            side = judge(at, step)
            if step == 25 or not side:
                return at, step
            low, high = (low, at) if side < 0 else (at, high)
            at, step = (low + high) / 2, step + 1

    def coarse(t, step):
        left = 400 - (errors < t).sum()
        return -1 if left < 300 else (1 if step else 0) if left > 300 / 0.99 else 0

    got = amr.coarsen_search(df, "e", 300, 3.0, 0.99, 25)
    assert (got.threshold, got.steps) == search(errors.min(), 3.0, 3.0, coarse)
    assert got.estimate == 400 - got.count
    assert amr.coarsen_search(df, "e", 300, -1.0, 0.9, 25).count == 0
    assert amr.coarsen_search(df, "e", 10, 0.01, 0.9, 25).steps == 0  # too little even at the highest
    fine = amr.refine_search(df, "e", 600, 0.1, 0.95, 25, lambda e, t: F.when(e >= t, 7))
    assert 570 <= fine.estimate <= 600
    assert amr.coarsen_search(df.limit(0), "e", 1, 1.0, 0.9, 5).estimate == 0


def reference_hash(raw: bytes) -> int:
    """One string at a time, one step at a time."""
    m, w = 0xFFFFFFFF, [0, 0, 0]
    rot = lambda x, k: ((x << k) | (x >> (32 - k))) & m
    for at in range(0, max(1, len(raw)), 12):
        part = raw[at : at + 12].ljust(12, b"\0")
        for j in range(3):
            h = 0
            for c in part[4 * j : 4 * j + 4]:
                h = (h * 256 + (c - 256 if c > 127 else c)) & m
            w[j] = (w[j] + h) & m
        a, b, c = w
        a = (a - c) & m; a ^= rot(c, 4); c = (c + b) & m  # noqa: E702
        b = (b - a) & m; b ^= rot(a, 6); a = (a + c) & m  # noqa: E702
        c = (c - b) & m; c ^= rot(b, 8); b = (b + a) & m  # noqa: E702
        a = (a - c) & m; a ^= rot(c, 16); c = (c + b) & m  # noqa: E702
        b = (b - a) & m; b ^= rot(a, 19); a = (a + c) & m  # noqa: E702
        c = (c - b) & m; c ^= rot(b, 4); b = (b + a) & m  # noqa: E702
        w = [a, b, c]
    a, b, c = w
    for x, y, k in (("c", "b", 14), ("a", "c", 11), ("b", "a", 25), ("c", "b", 16), ("a", "c", 4), ("b", "a", 14), ("c", "b", 24)):
        v = {"a": a, "b": b, "c": c}
        v[x] = ((v[x] ^ v[y]) - rot(v[y], k)) & m
        a, b, c = v["a"], v["b"], v["c"]
    return c


def test_hashes(spark):
    texts = ["", "a", "abc", "x" * 11, "x" * 12, "x" * 13, "x" * 24, "x" * 500, "é中", None]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", hashing.hash_string("s").alias("h")).collect()
    assert {x["s"]: x["h"] for x in got} == {t: None if t is None else reference_hash(t.encode()) for t in texts}
    assert hashing.mixed(b"") == 0 and hashing.mixed(b"abc") == 1584314805 and hashing.mixed(b"x" * 24) == 2592414526  # known answers
    assert hashing.mixed(b"ab\0cd") == hashing.mixed(b"ab")


def test_checksum_of_arrays(spark):
    r = random.Random(1)
    rows = [(g, i, r.randbytes(r.randrange(400)) if i % 9 else None) for g in range(4) for i in range(60)] + [(9, 0, b"")]
    got = hashing.array_checksum(spark.createDataFrame(rows, "g int, i int, d binary"), "g", "i", "d").collect()
    assert {x["g"]: x["checksum"] for x in got} == {g: zlib.adler32(b"".join(d or b"" for h, _, d in rows if h == g)) for g in (0, 1, 2, 3, 9)}


def test_random_draws(spark):
    n = 4000
    for mean in (0.0, 3.0, 11.9, 12.0, 40.0, 5000.0):
        x = rng.poisson_model(np.arange(n) * 100003, np.full(n, mean))
        assert abs(x.mean() - mean) <= 5 * math.sqrt(mean / n) and abs(x.var() - mean) <= 0.2 * mean + 0.01
    a, b = rng.normal_model(np.arange(n) * 1000)
    assert abs(a.mean()) < 0.08 and abs(b.mean()) < 0.08 and abs(np.corrcoef(a, b)[0, 1]) < 0.08 and abs(a.std() - 1) < 0.05
    hits = rng.small_model(np.arange(200_000) * 1000, np.full(200_000, 2e-3)).sum()
    assert 320 <= hits <= 480
    df = spark.createDataFrame([(1, 3.0), (None, 3.0), (1, None), (1, -1.0), (1, float("inf")), (1, float("nan"))], "s long, m double")
    got = df.select(rng.poisson("s", "m").alias("p"), rng.normal("s").alias("n"), rng.small("s", "m").alias("k")).collect()
    assert got[0]["p"] is not None and all(x["p"] is None for x in got[1:])
    assert [x["n"] is None for x in got] == [False, True, False, False, False, False]
    cumulative = rng.poisson_cumulative(4.0)
    assert cumulative[0] == 0 and cumulative[-1] == 1 and cumulative == sorted(cumulative) and abs(cumulative[1] - math.exp(-4)) < 1e-12


def test_statistics_container(spark):
    s = stats.Statistics()
    s.add("x")
    with pytest.raises(ValueError):
        s.add("x")
    with pytest.raises(KeyError):
        s.accumulate("y", spark.range(3), F.col("id"), F.col("id"))
    s.add("none")
    s.accumulate("x", spark.range(3), F.col("id"), F.col("id"))
    s.accumulate("x", spark.range(3, 6), F.col("id"), F.col("id"))
    got = {r["variable"]: r for r in s.compute().collect()}
    assert (got["x"]["n"], got["x"]["mean"], got["x"]["greatest_at"]) == (6, 2.5, 5)
    assert got["none"]["n"] == 0 and got["none"]["mean"] is None


def test_options_errors():
    def make():
        o = options.Options()
        o.add("level", int, 1, "l")
        o.add("mode", "keyvalue", "a", "m", {"a": 1, "b": 2})
        o.add("size", "size", 0)
        o.add("quiet", "switch", 0, "q")
        o.add("odd", "callback", None, call=lambda t: int(t) % 2 == 1)
        return o

    bad_ini = ["[Options]\nlevel = 1\n-l = 2\n", "[Options]\nlevel = x\n", "[Options]\nlevel = 3000000000\n", "[Options]\nmode = c\n", "[Options]\nsize = -1\n", "[Options]\nodd = 2\n", "level = 1\n", "[Options]\nquiet = -2\n"]
    for text in bad_ini:
        o = make()
        with pytest.raises(options.OptionError):
            o.load_ini(text)
        assert o.values == make().values  # nothing of it is applied
    for argv in (["--wrong"], ["--level"], ["--level", "x"], ["-m", "c"], ["--odd=4"]):
        with pytest.raises(options.OptionError):
            make().parse(argv)
    o = make()
    assert o.parse(["one", "-l5", "-qq", "--mode", "b", "two", "--", "-x"]) == ["one", "two", "-x"]
    assert (o.values["level"], o.values["quiet"], o.get("mode")) == (5, 2, 2)
    with pytest.raises(options.OptionError):
        o.add("other", int, 0, "l")
    with pytest.raises(options.OptionError):
        make().load_json("{")
    with pytest.raises(options.OptionError):
        make().load_json('{"Options": {"level": 1, "-l": 2}}')


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_section_files(spark, tmp_path, parts):
    rows = [(0, "I", "in", 32, 0, b"i" * 32), (1, "B", "b", 5, 0, b"block"), (2, "B", "none", 0, 0, b"")]
    rows += [(3, "A", "arr", 6, i, b"%06d" % i) for i in range(101)] + [(4, "A", "lines", 2, i, b"x\n") for i in range(16)]
    df = spark.createDataFrame(rows, "section int, type string, user_string string, elem_size long, pos long, data binary")
    path = str(tmp_path / "f.scda")
    scda.write_sections(df.repartition(parts), path, "user")
    want = scda.file_header(b"user") + scda.inline(b"in", b"i" * 32) + scda.block(b"b", b"block") + scda.block(b"none", b"")
    want += scda.array(b"arr", [b"%06d" % i for i in range(101)], 6) + scda.array(b"lines", [b"x\n"] * 16, 2)
    assert open(path, "rb").read() == want
    assert [p.name for p in tmp_path.iterdir()] == ["f.scda"]
    got = spark.read.format("scda").option("parts", parts + 1).load(path)
    assert sorted((r["section"], r["pos"], bytes(r["data"])) for r in got.collect()) == sorted((r[0], r[4], r[5]) for r in rows)
    wrong = df.withColumn("elem_size", F.when(F.col("section") == 4, 3).otherwise(F.col("elem_size")).cast("long"))
    with pytest.raises(Exception, match="elem_size"):
        scda.write_sections(wrong, str(tmp_path / "g.scda"))
    assert not (tmp_path / "g.scda").exists()


def test_codecs():
    for n in (0, 1, 32768, 65531, 65532, 140000):
        data = random.Random(n).randbytes(n)
        assert zlib.decompress(codec.stored(data)) == data
        assert codec.vtk_blocks(codec.vtk_compressed(data))[2] == data
    assert codec.stored(b"") == bytes.fromhex("78010100 00ffff 00000001".replace(" ", ""))


def test_files_and_errors(spark, tmp_path):
    df = spark.createDataFrame([("a", b"12345"), ("b", b""), ("c", None)], "name string, content binary")
    assert {r["name"]: r["bytes"] for r in bytesio.write_files(df, str(tmp_path / "d"), "name", "content").collect()} == {"a": 5, "b": 0, "c": 0}
    asked = spark.createDataFrame([(0, 3), (3, 9), (9, 1)], "o long, n int")
    assert {r["o"]: bytes(r["data"]) for r in bytesio.read_at(asked, str(tmp_path / "d/a"), "o", "n").collect()} == {0: b"123", 3: b"45", 9: b""}
    assert {r["error"] for r in bytesio.read_at(asked, str(tmp_path / "none"), "o", "n").collect()} == {"no_such_file"}
    sink = bytesio.Sink(str(tmp_path / "s"))
    sink.write(b"abc")
    sink.close()
    more = bytesio.Sink(str(tmp_path / "s"), append=True)
    more.write(b"de")
    more.close()
    source = bytesio.Source(str(tmp_path / "s"), mirror=True)
    source.read(2, skip=True)
    assert source.read(9, partial=True) == b"cde" and bytes(source.mirror) == b"cde"


def test_cells(spark):
    a = F.array(*[F.lit(x) for x in "abc"])
    row = spark.range(1).select(
        arrays.remove(a, 0).alias("r0"), arrays.remove(a, 2).alias("r2"), arrays.index_of(a, F.lit("z")).alias("no"), arrays.appended(F.lit("ab"), F.lit("cd"), 4).alias("full"),
        kv.visit(kv.build([("b", "i", F.lit(1)), ("a", "i", F.lit(2))]), lambda k, e: F.lit(True)).alias("all"),
        mathx.floatpow(F.lit(2.0), F.lit(10)).alias("p"), mathx.floatpow(F.lit(5.0), F.lit(0)).alias("one"),
    ).first()
    assert (row["r0"], row["r2"], row["no"], tuple(row["full"]), [e["key"] for e in row["all"]]) == (["b", "c"], ["a", "b"], -1, ("abc", -1), ["a", "b"])
    assert (row["p"], row["one"]) == (1024.0, 1.0)
    a, b = (spark.createDataFrame(rows, "pos int, member string") for rows in ([(0, "x"), (1, "y")], [(0, "y")]))
    assert [r["member"] for r in setops.include(a, [1]).collect()] == ["y"]
    assert not setops.same_members(a, b).first()["same"]


def test_points_on_planes(spark):
    eye = camera.Camera(position=(0.1, 0.2, 0.3), near=0.5, far=30.0).yaw(0.7).pitch(-0.4)
    inverse = np.linalg.inv(eye.view())
    inside = [inverse @ [w * sx, w * sy, -w, 1] for w in (0.5, 1.7, 30.0) for sx in (-1, 0, 1) for sy in (-1, 0, 1)]
    outside = [inverse @ [w * 1.000001, 0, -w, 1] for w in (0.6, 20.0)] + [inverse @ [0, 0, -0.4999, 1]]
    df = spark.createDataFrame([(i, *map(float, p[:3])) for i, p in enumerate(inside + outside)], "i int, x double, y double, z double")
    assert sorted(r["i"] for r in camera.clip_before(df, eye).collect()) == list(range(len(inside)))


def test_streams_in_batches(spark, tmp_path):
    """A batch for each file: state is carried, and an event behind the watermark of the batch before is dropped."""
    src = str(tmp_path / "in")
    files = [[("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 03:00:00", "a", 2.0)], [("2024-01-01 03:05:00", "a", 4.0)], [("2024-01-01 00:20:00", "a", 100.0)], [("2024-01-01 09:00:00", "a", 8.0)]]
    for i, rows in enumerate(files):
        t = spark.createDataFrame([(*r, i) for r in rows], "t string, k string, v double, n int").withColumn("t", F.to_timestamp("t"))
        t.coalesce(1).write.mode("append").parquet(f"{src}/{i}")
    stream = lambda: spark.readStream.schema("t timestamp, k string, v double, n int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    got = events.run_to_end(events.windowed_statistics(stream(), "t", "k", "v", "1 hour", "10 minutes")).collect()
    assert sorted((r["start"].hour, r["n"], r["total"]) for r in got) == [(0, 1, 1.0), (3, 2, 6.0)]
    assert events.run_to_end(events.first_seen(stream(), ["k"], "t", "2 hours")).count() >= 1
    ops = str(tmp_path / "ops")
    for i, rows in enumerate([[(1, 0, "insert", 0), (1, 1, "insert", 0)], [(1, 2, "remove", 0)], [(1, 3, "insert", 0), (1, 4, "insert", 0)]]):
        spark.createDataFrame(rows, "g int, p int, op string, arg int").coalesce(1).write.mode("append").parquet(f"{ops}/{i}")
    stored = spark.readStream.schema("g int, p int, op string, arg int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(ops)
    got = events.run_to_end(events.recycle_stream(stored, "g", "p", "op", "arg")).collect()
    assert [r["slot"] for r in sorted(got, key=lambda r: r["p"])] == [0, 1, 0, 0, 2]


@pytest.mark.parametrize("name", ["uint128", "uint128_bits", "integer_math", "integer_math_large", "parse_saturating", "recycle_slots", "asof_closest", "amr_refine", "checksum_of_array", "psort_partition"])
def test_larger_tables(spark, name):
    """Queries whose numbers grow with the table also run on one a hundred times as large."""
    catalog.QUERIES[name](spark, "/root/testdata/sf0.1").write.format("noop").mode("overwrite").save()
