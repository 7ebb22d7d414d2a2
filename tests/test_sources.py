import random
import zlib

import pytest
from pyspark.sql import functions as F

from rankframe.functions import hashing, mathx, rng, u128
from rankframe.operators import group, order, ranges
from rankframe.sources import bytesio, codec, options, scda


@pytest.mark.parametrize("n", [0, 1, 55, 56, 57, 1000, 70000])
def test_codec_round_trip(n):
    data = random.Random(n).randbytes(n)
    text = codec.encode_bytes(data)
    assert codec.decode_bytes(text) == data
    assert all(len(x) <= 77 for x in text.split("\n"))
    assert codec.decode_bytes(text, max_size=n - 1) is None
    assert codec.decode_bytes("x" + text[1:]) != data


def test_codec_rejects():
    assert codec.decode_bytes("") is None
    assert codec.decode_bytes("!!!!") is None


@pytest.mark.parametrize("parts", [1, 2, 3, 7])
def test_scda_does_not_depend_on_partition(spark, tmp_path, parts):
    spark.dataSource.register(scda.ScdaDataSource)
    df = spark.range(12).repartition(parts).withColumn("data", F.expr("encode(substr('abcdefghijklmnopqrstuvwxyz', cast(id as int) + 1, 3), 'utf-8')"))
    path = str(tmp_path / "a.scda")
    scda.write_array(df, path, "letters", "id", [], "data", 3)
    raw = open(path, "rb").read()
    want = scda.file_header(b"") + scda.array(b"letters", [b"abcdefghijklmnopqrstuvwxyz"[i : i + 3] for i in range(12)], 3)
    assert raw == want
    assert len(raw) % 32 == 0
    got = spark.read.format("scda").option("parts", parts).load(path).orderBy("pos").collect()
    assert [bytes(r["data"]).decode() for r in got] == ["abcdefghijklmnopqrstuvwxyz"[i : i + 3] for i in range(12)]


def test_scda_sections(tmp_path):
    path = tmp_path / "b.scda"
    path.write_bytes(scda.file_header(b"file") + scda.block(b"empty", b"") + scda.inline(b"line", b"x" * 32) + scda.block(b"b", b"y\n" * 16) + scda.array(b"none", [], 3))
    got = [(s["type"], s["user_string"], s["n"], s["elem_size"]) for s in scda.sections(str(path))]
    assert got == [("B", "empty", 1, 0), ("I", "line", 1, 32), ("B", "b", 1, 32), ("A", "none", 0, 3)]
    path.write_bytes(b"junk" * 100)
    with pytest.raises(scda.FormatError):
        scda.sections(str(path))


def test_padding():
    for n in range(1, 200):
        assert (n + scda.pad_data_length(n)) % 32 == 0
        assert 7 <= scda.pad_data_length(n) <= 38
        assert len(scda.pad_data(b"x", n)) == scda.pad_data_length(n)
    assert scda.unpad_fixed(scda.pad_fixed(b"name", 62)) == b"name"


def test_bytes_io(tmp_path):
    sink = bytesio.Sink(str(tmp_path / "s"), elem_size=4)
    sink.write(b"abc")
    with pytest.raises(BlockingIOError):
        sink.complete()
    sink.align(4)
    assert sink.complete() == 4
    sink.close()
    src = bytesio.Source(str(tmp_path / "s"), mirror=True)
    assert src.read(3) == b"abc"
    src.align(4)
    with pytest.raises(EOFError):
        src.read(1)
    assert bytes(src.mirror) == b"abc"


def test_options():
    o = options.Options()
    o.add("d", float, 1.0)
    o.add("on", bool, False)
    sub = options.Options()
    sub.add("deep", int, 0)
    o.add_suboptions(sub, "Sub")
    o.load_ini("[Options]\nd = 7.55\non = yes\n[Sub]\ndeep = 3\n")
    assert o.values == {"d": 7.55, "on": True, "Sub:deep": 3}
    o.load_json('{"Options": {"d": 2, "Sub": {"deep": 9}}}')
    assert o.values["Sub:deep"] == 9
    assert o.parse(["--d", "4", "rest"]) == ["rest"]
    assert o.values["d"] == 4
    again = options.Options(dict.fromkeys(o.values), dict(o.types))
    again.load_ini(o.save_ini())
    assert again.values == o.values
    assert options.json_lookup({"a:b": {"c": 1}}, "a:b:c") == 1


def test_adler_and_hash(spark):
    data = ["", "a", "hello world", "é" * 40]
    got = spark.createDataFrame([(x,) for x in data], "s string").select(hashing.adler32(F.col("s").cast("binary")).alias("a")).collect()
    assert [r["a"] for r in got] == [zlib.adler32(x.encode()) for x in data]
    assert hashing.mixed(b"abc") != hashing.mixed(b"abd")
    assert 0 <= hashing.mixed(b"") < 2**32


def test_rng_model_agrees(spark):
    got = spark.range(0, 5000).select(rng.uniform(F.col("id") * 7919 * 1000003).alias("u")).toPandas()["u"].to_numpy()
    assert (got == rng.uniform_model([i * 7919 * 1000003 for i in range(5000)])).all()
    assert 0.48 < got.mean() < 0.52
    p = spark.range(2000).select(rng.poisson(F.col("id") * 100000, F.lit(30.0)).alias("p"), rng.normal(F.col("id") * 100000).alias("n")).toPandas()
    assert 29 < p["p"].mean() < 31
    assert abs(p["n"].mean()) < 0.1


def test_u128_against_python(spark):
    r = random.Random(5)
    pairs = [(r.getrandbits(128), r.getrandbits(128)) for _ in range(50)] + [(2**128 - 1, 1), (0, 1), (2**64 - 1, 1), (2**127, 2**127)]
    s = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(s(a >> 64), s(a & (2**64 - 1)), s(b >> 64), s(b & (2**64 - 1))) for a, b in pairs], "ah long, al long, bh long, bl long")
    a, b = u128.make(F.col("ah"), F.col("al")), u128.make(F.col("bh"), F.col("bl"))
    ops = {"add": u128.add(a, b), "sub": u128.subtract(a, b), "and": u128.bit_and(a, b), "or": u128.bit_or(a, b), "not": u128.bit_not(a)}
    for n in (0, 1, 63, 64, 65, 127, 128):
        ops |= {f"l{n}": u128.shift_left(a, n), f"r{n}": u128.shift_right(a, n)}
    ops |= {"s5": u128.set_bit(a, 5), "s127": u128.set_bit(a, 127)}
    m = 2**128 - 1
    for row, (x, y) in zip(df.select(u128.compare(a, b).alias("cmp"), *[v.alias(k) for k, v in ops.items()]).collect(), pairs, strict=True):
        val = lambda k, row=row: ((row[k]["hi"] % 2**64) << 64) | (row[k]["lo"] % 2**64)
        assert (val("add"), val("sub"), val("and"), val("or"), val("not")) == ((x + y) & m, (x - y) & m, x & y, x | y, x ^ m)
        for n in (0, 1, 63, 64, 65, 127, 128):
            assert val(f"l{n}") == (x << n) & m
            assert val(f"r{n}") == x >> n
        assert (val("s5"), val("s127")) == (x | 32, x | 2**127)
        assert row["cmp"] == (x > y) - (x < y)


def test_invert(spark):
    got = spark.range(1).select(mathx.invert(lambda x: F.sin(2 * 3.141592653589793 * x), 0.25, 0.75, F.lit(0.56), 1e-3).alias("x")).first()["x"]
    assert abs(__import__("math").sin(2 * 3.141592653589793 * got) - 0.56) < 3e-3


def test_recycle_and_order(spark):
    ops = [("insert", 0), ("insert", 0), ("remove", 0), ("insert", 0), ("insert", 0), ("remove", 1), ("remove", 2), ("insert", 0)]
    df = spark.createDataFrame([(1, i, o, a) for i, (o, a) in enumerate(ops)], "g int, pos int, op string, arg int")
    assert [r["slot"] for r in group.recycle(df, "g", "pos", "op", "arg").orderBy("pos").collect()] == [0, 1, 0, 0, 2, 1, 2, 2]
    t = spark.range(1000).withColumn("v", (F.col("id") * 37 % 100).cast("double"))
    got = order.psort(t, "v", ["id"], order.equal_counts(1000, 7)).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(1000))
    assert [r["v"] for r in got] == sorted(r["v"] for r in got)
    empty = order.positions(t.where("id < 0"), "v", ["id"])
    assert empty.count() == 0


def test_ranges(spark):
    df = spark.createDataFrame([(0, p) for p in (0, 1, 2, 10, 11, 30, 33)], "rank long, peer long")
    got = sorted((r["lo"], r["hi"]) for r in ranges.cover(df, 3).collect())
    assert got == [(1, 2), (10, 11), (30, 33)]
