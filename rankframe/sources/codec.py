"""Binary to text codecs: zlib in base64 with line breaks, and the two binary encodings of VTK files."""

from __future__ import annotations

import base64
import struct
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

#: Code characters per line, and bytes per block of the VTK encodings.
LINE, BLOCK = 76, 32768
FORMAT = b"z"


def encode_bytes(data: bytes, level: int = 9, line_break: bytes = b"=") -> str:
    """base64(8-byte big-endian size, 'z', zlib stream), with the break byte and a newline after each line."""
    code = base64.b64encode(struct.pack(">Q", len(data)) + FORMAT + zlib.compress(data, level))
    return b"".join(code[i : i + LINE] + line_break + b"\n" for i in range(0, len(code), LINE)).decode()


def decode_bytes(text: str, max_size: int | None = None, elem_size: int = 1) -> bytes | None:
    """The data, or None if the text is not of this format, too large, or not whole elements."""
    raw = text.encode()
    code = b"".join(raw[i : i + LINE + 2][:-2] for i in range(0, len(raw), LINE + 2))
    try:
        data = base64.b64decode(code, validate=True)
        size = struct.unpack(">Q", data[:8])[0]
        if data[8:9] != FORMAT or size % elem_size or (max_size is not None and size > max_size):
            return None
        out = zlib.decompress(data[9:])
    except (ValueError, struct.error, zlib.error):
        return None
    return out if len(out) == size else None


@F.pandas_udf(StringType())
def encode(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else encode_bytes(bytes(d)))


@F.pandas_udf(BinaryType())
def decode(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else decode_bytes(t))


def original_size(text: Column) -> Column:
    """Size of the data, from the first 12 characters, natively."""
    return F.conv(F.hex(F.substring(F.unbase64(F.substring(text, 1, 12)), 1, 8)), 16, 10).cast("long")


def format_char(text: Column) -> Column:
    return F.substring(F.unbase64(F.substring(text, 1, 12)), 9, 1).cast("string")


def vtk_binary(data: bytes) -> str:
    """base64 of a 32-bit length and the data."""
    return base64.b64encode(struct.pack("<I", len(data)) + data).decode()


def vtk_compressed(data: bytes) -> str:
    """base64 of the header (blocks, block size, size of a partial last block or the block size, compressed sizes), then base64 of the blocks."""
    blocks = [zlib.compress(data[i : i + BLOCK], 9) for i in range(0, len(data), BLOCK)]
    head = struct.pack(f"<{3 + len(blocks)}I", len(blocks), BLOCK, len(data) % BLOCK or BLOCK, *map(len, blocks))
    return (base64.b64encode(head) + base64.b64encode(b"".join(blocks))).decode()


@F.pandas_udf(StringType())
def encode_vtk_binary(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else vtk_binary(bytes(d)))


@F.pandas_udf(StringType())
def encode_vtk_compressed(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else vtk_compressed(bytes(d)))


def vtk_blocks(code: str) -> tuple[int, int, bytes]:
    """(blocks, size of the last block, data) of a compressed VTK text."""
    raw = base64.b64decode(code[:4] + "====") if len(code) < 16 else base64.b64decode(code[:16])
    n = struct.unpack_from("<I", raw)[0]
    end = -(-4 * (3 + n) // 3) * 4
    head = struct.unpack(f"<{3 + n}I", base64.b64decode(code[:end]))
    body, at, out = base64.b64decode(code[end:]), 0, []
    for size in head[3:]:
        out.append(zlib.decompress(body[at : at + size]))
        at += size
    return n, head[2], b"".join(out)


@F.pandas_udf(StructType([StructField("blocks", LongType()), StructField("last", LongType()), StructField("data", BinaryType())]))
def decode_vtk_compressed(code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None, None) if c is None else vtk_blocks(c) for c in code], columns=["blocks", "last", "data"])


#: Bytes of a stored block: with its header of five bytes, 64 KiB.
STORED = 65531


def stored(data: bytes) -> bytes:
    """A zlib stream without compression: for readers of zlib where no compressor is at hand."""
    out = [b"\x78\x01"]
    for at in range(0, max(1, len(data)), STORED):
        part = data[at : at + STORED]
        out += [struct.pack("<BHH", at + STORED >= len(data), len(part), len(part) ^ 0xFFFF), part]
    return b"".join([*out, struct.pack(">I", zlib.adler32(data))])


def stored_size(n: Column) -> Column:
    """Bytes of stored() of n bytes."""
    n = n.cast("long")
    return n + 6 + 5 * F.greatest(F.lit(1), F.ceil(n / STORED)).cast("long")


@F.pandas_udf(BinaryType())
def encode_stored(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else stored(bytes(d)))


@F.pandas_udf(BinaryType())
def inflate(data: pd.Series) -> pd.Series:
    """The data of a zlib stream, null where it is none."""

    def one(d):
        try:
            return None if d is None else zlib.decompress(bytes(d))
        except zlib.error:
            return None

    return data.map(one)
