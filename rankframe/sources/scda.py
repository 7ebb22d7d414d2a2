"""Section files whose bytes do not depend on the partition: a Spark data source that reads and writes them.

A file is a 128-byte header and sections: I (32 bytes inline), B (one block), A (an array of
elements of fixed size). Arrays are read by offset, in as many parts as wanted. To write, tasks put their part of
the order into files of their own; the commit puts headers, parts and paddings together and gives the file its name.
Paths may lie in any store that pyarrow opens and that driver and executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from rankframe.operators.order import dealt
from rankframe.sources.bytesio import file_system

#: Fixed values of the format.
MAGIC, VENDOR = b"scdata0", b"rankframe"
HEADER, COUNT, USER, INLINE, MOD = 128, 32, 62, 32, 32
SCHEMA = "section int, type string, user_string string, n bigint, elem_size bigint, pos bigint, data binary"


class FormatError(ValueError):
    """The file does not follow the format."""


def pad_fixed(raw: bytes, length: int) -> bytes:
    """raw, a space, dashes, a newline: length bytes in all; raw leaves at least four."""
    if len(raw) + 4 > length:
        raise ValueError(f"at most {length - 4} bytes")
    return raw + b" " + b"-" * (length - len(raw) - 2) + b"\n"


def unpad_fixed(padded: bytes) -> bytes:
    body = padded[:-1].rstrip(b"-")
    if padded[-1:] != b"\n" or body[-1:] != b" " or len(padded) - len(body) < 3:
        raise FormatError("bad padding")
    return body[:-1]


def pad_data_length(n: int) -> int:
    """Bytes of padding after n bytes: to a multiple of 32, at least seven."""
    pad = -n % MOD
    return pad if pad >= 7 else pad + MOD


def pad_data(last: bytes, n: int) -> bytes:
    """The padding after n bytes that end in ``last``: it begins a new line, if the data does not."""
    first = b"=" if n and last == b"\n" else b"\n"
    return first + b"=" * (pad_data_length(n) - 3) + b"\n\n"


def _count(letter: bytes, n: int) -> bytes:
    return letter + b" " + pad_fixed(b"%d" % n, COUNT - 2)


def _section(kind: bytes, user: bytes) -> bytes:
    return kind + b" " + pad_fixed(user, USER)


def file_header(user: bytes) -> bytes:
    return MAGIC + b" " + pad_fixed(VENDOR, 24) + b"F " + pad_fixed(user, USER) + b"\n" + b"=" * (INLINE - 3) + b"\n\n"


def inline(user: bytes, data: bytes) -> bytes:
    if len(data) != INLINE:
        raise ValueError("inline data has 32 bytes")
    return _section(b"I", user) + data


def block(user: bytes, data: bytes) -> bytes:
    return _section(b"B", user) + _count(b"E", len(data)) + data + pad_data(data[-1:], len(data))


def array_header(user: bytes, n: int, elem_size: int) -> bytes:
    return _section(b"A", user) + _count(b"N", n) + _count(b"E", elem_size)


def array(user: bytes, elements: list[bytes], elem_size: int) -> bytes:
    if any(len(e) != elem_size for e in elements):
        raise ValueError("elements have elem_size bytes")
    data = b"".join(elements)
    return array_header(user, len(elements), elem_size) + data + pad_data(data[-1:], len(data))


def partition_offsets(counts: list[int], elem_size: int) -> list[tuple[int, int]]:
    """(byte offset, bytes) of each rank's part."""
    out, at = [], 0
    for n in counts:
        out.append((at, n * elem_size))
        at += n * elem_size
    return out


def offsets(counts: DataFrame, rank: str, n: str, elem_size: int) -> DataFrame:
    """counts with offset and bytes: where each rank's part of an array begins, and its length. Ranks are a row each."""
    from rankframe.operators.order import running_sum

    got = running_sum(counts, rank, [], n, "__before")
    return got.withColumn("offset", F.col("__before") * elem_size).withColumn("bytes", F.col(n) * elem_size).drop("__before")


def highest_nonempty(counts: DataFrame, rank: str, n: str) -> DataFrame:
    """One row: the highest rank with elements, -1 without any."""
    return counts.agg(F.coalesce(F.max(F.when(F.col(n) > 0, F.col(rank))), F.lit(-1)).cast("long").alias("highest"))


def section_length(kind: Column, n: Column, elem_size: Column) -> Column:
    """Bytes of a whole section, headers and padding included."""
    data = (n * elem_size).cast("long")
    pad = F.pmod(-data, F.lit(MOD))
    padded = data + F.when(pad >= 7, pad).otherwise(pad + MOD)
    return F.when(kind == "I", F.lit(2 + USER + INLINE)).when(kind == "B", padded + 2 + USER + COUNT).when(kind == "A", padded + 2 + USER + 2 * COUNT).cast("long")


def padded_user(user: Column) -> Column:
    """A user string with its padding."""
    return F.concat(user, F.lit(" "), F.repeat(F.lit("-"), USER - 2 - F.octet_length(user)), F.lit("\n"))


@dataclass
class _Written(WriterCommitMessage):
    part: int
    name: str
    sections: list[tuple]  # section, type, user string, elem_size, elements, bytes, last byte


class _Writer(DataSourceWriter):
    def __init__(self, path: str, user: str):
        self.path, self.user, self.tag = path, user, uuid.uuid4().hex

    def write(self, rows) -> _Written:
        store, at = file_system(self.path)
        part = TaskContext.get().partitionId()
        name, sections = f"{at}.{self.tag}.{part}.{uuid.uuid4().hex}", []
        with store.open_output_stream(name) as f:
            for r in rows:
                key, data = (r["section"], r["type"], r["user_string"], r["elem_size"]), bytes(r["data"])
                if len(data) != r["elem_size"] or (r["type"] == "I" and len(data) != INLINE):
                    raise ValueError("elements have elem_size bytes, and inline data 32")
                if not sections or sections[-1][0] != key:
                    sections.append([key, 0, 0, b""])
                s = sections[-1]
                s[1], s[2], s[3] = s[1] + 1, s[2] + len(data), data[-1:] or s[3]
                f.write(data)
        return _Written(part, name, [(*k, n, size, last) for k, n, size, last in sections])

    def commit(self, messages) -> None:
        store, at = file_system(self.path)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        total: dict[int, list] = {}
        for m in done:
            for section, kind, user, size, n, _, last in m.sections:
                t = total.setdefault(section, [kind, user, size, 0, b""])
                if (kind, user, size) != tuple(t[:3]) or (kind in "IB" and t[3] + n > 1):
                    raise ValueError(f"section {section} is not of one kind")
                t[3], t[4] = t[3] + n, last or t[4]
        temporary = f"{at}.{self.tag}"
        with store.open_output_stream(temporary) as out:
            out.write(file_header(self.user.encode()))
            current = None
            for m in done:
                with store.open_input_stream(m.name) as part:
                    for section, kind, user, size, _, length, _ in m.sections:
                        if section != current:
                            self._end(out, total, current)
                            current, n = section, total[section][3]
                            head = _section(kind.encode(), user.encode())
                            out.write(head + (_count(b"N", n) if kind == "A" else b"") + (_count(b"E", size) if kind in "AB" else b""))
                        while length:
                            piece = part.read(min(length, 1 << 20))
                            out.write(piece)
                            length -= len(piece)
            self._end(out, total, current)
        store.move(temporary, at)
        self._drop(done)

    def _end(self, out, total: dict[int, list], section: int | None) -> None:
        if section is not None and total[section][0] != "I":
            size = total[section][2] * total[section][3]
            out.write(pad_data(total[section][4], size))

    def _drop(self, messages) -> None:
        store, _ = file_system(self.path)
        for m in messages:
            store.delete_file(m.name)

    def abort(self, messages) -> None:
        self._drop([m for m in messages if m is not None])


def write_sections(df: DataFrame, path: str, file_user: str = "") -> None:
    """Write rows (section, type, user_string, elem_size, pos, data) as a file: sections in order, their elements by pos.

    type is I, B or A; an I or B section has one row. The bytes do not depend on how df is partitioned.
    """
    df.sparkSession.dataSource.register(ScdaDataSource)
    placed = dealt(df.select("section", "type", "user_string", "elem_size", "pos", "data"), [F.col("section"), F.col("pos")])
    # The written table is read in the order of its ranges; one task writes one range after the other.
    ordered = placed.repartitionByRange(max(1, placed.rdd.getNumPartitions()), "__range").sortWithinPartitions("__range", "__place").drop("__range", "__place")
    ordered.write.format("scda").option("user", file_user).mode("append").save(path)


def write_array(df: DataFrame, path: str, user: str, key: str, ties: list[str], data: str, elem_size: int, file_user: str = "") -> None:
    """Write a table's binary column, in the order of key and ties, as an A section of a new file."""
    from rankframe.operators.order import positions

    placed = positions(df.select(key, *ties, data), key, ties, "pos")
    if placed.isEmpty():
        store, at = file_system(path)
        with store.open_output_stream(at) as f:
            f.write(file_header(file_user.encode()) + array(user.encode(), [], elem_size))
        return
    rows = placed.select(F.lit(0).alias("section"), F.lit("A").alias("type"), F.lit(user).alias("user_string"), F.lit(elem_size).cast("long").alias("elem_size"), "pos", F.col(data).alias("data"))
    write_sections(rows, path, file_user)


def sections(path: str) -> list[dict]:
    """Type, user string, counts, and data offset of each section, from the headers alone."""
    store, name = file_system(path)
    out = []
    with store.open_input_file(name) as f:
        size = f.size()
        head = f.read(HEADER)
        if len(head) != HEADER or not head.startswith(MAGIC + b" ") or head[32:34] != b"F ":
            raise FormatError("not a section file")
        unpad_fixed(head[34 : 34 + USER])
        at = HEADER
        while at < size:
            f.seek(at)
            h = f.read(2 + USER)
            kind, user = h[:1], unpad_fixed(h[2:]).decode()
            at += 2 + USER

            def number(letter: bytes) -> int:
                c = f.read(COUNT)
                if c[:2] != letter + b" ":
                    raise FormatError("bad count")
                return int(unpad_fixed(c[2:]))

            n, e = (1, INLINE) if kind == b"I" else (1, number(b"E")) if kind == b"B" else (number(b"N"), number(b"E")) if kind == b"A" else (0, 0)
            if kind not in (b"I", b"B", b"A"):
                raise FormatError(f"unknown section {kind!r}")
            at += {b"I": 0, b"B": COUNT, b"A": 2 * COUNT}[kind]
            out.append({"section": len(out), "type": kind.decode(), "user_string": user, "n": n, "elem_size": e, "offset": at})
            at += n * e + (0 if kind == b"I" else pad_data_length(n * e))
    return out


class _Part(InputPartition):
    def __init__(self, section: dict, first: int, last: int):
        self.section, self.first, self.last = section, first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str, parts: int, types: str):
        self.path, self.parts, self.types = path, max(1, parts), types

    def partitions(self) -> list[_Part]:
        out = []
        for s in sections(self.path):
            if s["type"] in self.types:
                k = min(self.parts, max(1, s["n"]))
                out += [_Part(s, i * s["n"] // k, (i + 1) * s["n"] // k) for i in range(k)]
        return out

    def read(self, partition: _Part) -> Iterator[tuple]:
        s = partition.section
        store, name = file_system(self.path)
        with store.open_input_file(name) as f:
            f.seek(s["offset"] + partition.first * s["elem_size"])
            for pos in range(partition.first, partition.last):
                yield (s["section"], s["type"], s["user_string"], s["n"], s["elem_size"], pos, f.read(s["elem_size"]))


class ScdaDataSource(DataSource):
    """spark.read.format("scda"): a row per element. Options: parts (of each array), types (such as "A")."""

    @classmethod
    def name(cls) -> str:
        return "scda"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("parts", "1")), self.options.get("types", "IBA"))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("user", ""))
