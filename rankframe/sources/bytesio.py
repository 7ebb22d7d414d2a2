"""Byte sinks and sources, and typed messages packed into bytes."""

from __future__ import annotations

import errno
import io
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

#: Format of each packed type by its number.
TYPES = {0: "i", 1: "d", 2: "b", 3: "q", 4: "f"}


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, local without a scheme, and the path in it; for executors as for the driver."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Sink:
    """A file or buffer that counts its bytes; complete() fails in the middle of an element. A file may be any file object instead of a path."""

    def __init__(self, path: str | None = None, append: bool = False, elem_size: int = 1, file: BinaryIO | None = None):
        self.buffer, self.elem_size, self.bytes_in, self.bytes_out, self.owned = bytearray(), elem_size, 0, 0, bool(path)
        if path:
            store, at = file_system(path)
            file = open(at, "ab") if append and isinstance(store, fs.LocalFileSystem) else store.open_append_stream(at) if append else store.open_output_stream(at)  # noqa: SIM115
        self.file = file

    def write(self, data: bytes) -> None:
        self.bytes_in += len(data)
        self.file.write(data) if self.file else self.buffer.extend(data)

    def align(self, n: int) -> None:
        self.write(b"\0" * (-self.bytes_in % n))

    def complete(self) -> int:
        """Bytes written in all; flushes, so that as many are out."""
        if self.bytes_in % self.elem_size:
            raise BlockingIOError("a partial element is left")
        if self.file:
            self.file.flush()
        self.bytes_out = self.bytes_in
        return self.bytes_in

    def close(self) -> None:
        if self.file and self.owned:
            self.file.close()


class Source:
    """Reads a file or buffer, no more of it than is asked for; a read without ``partial`` fails if there are too few bytes.

    A mirror keeps what was read, but not what was skipped or comes from a buffer.
    """

    def __init__(self, path: str | None = None, data: bytes = b"", mirror: bool = False):
        if path:
            store, at = file_system(path)
            self.file = store.open_input_file(at)
        else:
            self.file = io.BytesIO(data)
        self.bytes_out, self.mirror = 0, bytearray() if mirror and path else None

    def read(self, n: int, partial: bool = False, skip: bool = False) -> bytes:
        got = self.file.read(n)
        self.bytes_out += len(got)
        if len(got) < n and not partial:
            raise EOFError(f"{len(got)} of {n} bytes")
        if self.mirror is not None and not skip:
            self.mirror.extend(got)
        return b"" if skip else got

    def align(self, n: int) -> None:
        self.read(-self.bytes_out % n, skip=True)

    def complete(self) -> int:
        """Bytes read."""
        return self.bytes_out

    def close(self) -> None:
        self.file.close()


_BYTES = StructType([StructField(n, t) for n, t in (("bytes_in", LongType()), ("padded", LongType()), ("head", BinaryType()), ("rest", LongType()), ("short", BooleanType()))])


def through_bytes(align: int, head: int):
    """A column function: each binary value written to a sink, padded, and read back: its size, the padded size, its
    first bytes, how many bytes followed them, and whether a read beyond the end is refused."""

    @F.pandas_udf(_BYTES)
    def run(data: pd.Series) -> pd.DataFrame:
        rows = []
        for d in data:
            sink = Sink()
            sink.write(d or b"")
            size = sink.complete()
            sink.align(align)
            source = Source(data=bytes(sink.buffer))
            first = source.read(min(head, size))
            rest = len(source.read(size - len(first)))
            source.align(align)
            try:
                source.read(1)
                short = False
            except EOFError:
                short = True
            rows.append((size, sink.complete(), first, rest, short))
        return pd.DataFrame(rows, columns=[f.name for f in _BYTES])

    return run


def write_files(df: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """Write each row's content to a file of its own under folder; (name, bytes) of what was written. A name must be unique.

    A file appears under its name only when it is whole, so a task that runs twice leaves one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            sizes = []
            for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data, temporary = c or b"", f"{root}/.{n}-{uuid.uuid4().hex}"
                with store.open_output_stream(temporary) as f:
                    f.write(data)
                store.move(temporary, f"{root}/{n}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["name", "bytes"])

    return df.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content")).mapInArrow(run, "name string, bytes long")


def read_at(requests: DataFrame, path: str, offset: str, n: str) -> DataFrame:
    """requests with data: n bytes of the file at offset, fewer beyond its end, and error, the class of a failure (0: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = file_system(path)
        for b in batches:
            out, errors = [], []
            for o, k in zip(b.column(b.schema.get_field_index(offset)).to_pylist(), b.column(b.schema.get_field_index(n)).to_pylist(), strict=True):
                try:
                    with store.open_input_file(at) as f:
                        f.seek(o)
                        out.append(f.read(k))
                    errors.append("success")
                except OSError as e:
                    out.append(None)
                    errors.append(error_name(e.errno or errno.EIO))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary()), pa.array(errors)], [*b.schema.names, "data", "error"])

    return requests.mapInArrow(run, StructType([*requests.schema.fields, StructField("data", BinaryType()), StructField("error", StringType())]))


#: The class of an error of the file system, by the names of its numbers.
ERROR_CLASSES = {
    "file": "EBADF ESPIPE", "amode": "EINVAL EOPNOTSUPP", "no_such_file": "ENOENT", "file_exists": "EEXIST",
    "bad_file": "EFAULT EISDIR ELOOP ENAMETOOLONG ENODEV ENOTDIR", "access": "EACCES EPERM EROFS ETXTBSY",
    "no_space": "EFBIG ENOSPC EOVERFLOW", "no_mem": "EMFILE ENFILE ENOMEM", "io": "EAGAIN EDESTADDRREQ EINTR EIO ENXIO EPIPE",
}
_CLASS_OF = {getattr(errno, name): kind for kind, names in ERROR_CLASSES.items() for name in names.split()} | {0: "success"}


def error_name(code: int) -> str:
    return _CLASS_OF.get(code, "unknown")


def error_class(code: Column) -> Column:
    """The class of an error number: success, unknown, or one of ERROR_CLASSES."""
    names = F.create_map(*[F.lit(x) for pair in sorted(_CLASS_OF.items()) for x in pair])
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(names, code.cast("int")), F.lit("unknown")))


def load_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole files in any store."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


@F.pandas_udf(BinaryType())
def pack(kind: pd.Series, values: pd.Series) -> pd.Series:
    """A count, a type, and the values in that type, little-endian."""
    return pd.Series([struct.pack(f"<ii{len(v)}{TYPES[k]}", len(v), k, *(map(int, v) if TYPES[k] in "ibq" else v)) for k, v in zip(kind, values, strict=True)])


@F.pandas_udf(ArrayType(DoubleType()))
def unpack(data: pd.Series) -> pd.Series:
    out = []
    for d in data:
        n, k = struct.unpack_from("<ii", d)
        out.append([float(x) for x in struct.unpack_from(f"<{n}{TYPES[k]}", d, 8)])
    return pd.Series(out)


def pack_size(kind, values):
    """Bytes that pack() needs, natively."""
    width = F.when(kind.isin(0, 4), 4).when(kind.isin(1, 3), 8).otherwise(1)
    return (F.size(values) * width + 8).cast("long")


def packed(kind: Column, values: Column, capacity: int) -> Column:
    """(data, status): the packed message, or null and 1 where it does not fit so many bytes."""
    fits = pack_size(kind, values) <= capacity
    return F.struct(F.when(fits, pack(kind, values)).alias("data"), F.when(fits, 0).otherwise(1).alias("status"))
