"""Quality rules by compression bands.

Text that repeats itself compresses far better than prose, and random text (keys, binary in
base64) far worse. Hexadecimal digits compress about as well as prose, so bands do not tell
them. The zstandard ratio (compressed / raw bytes) of the whole document and of each fixed
chunk must lie in a band that depends on the length: short inputs carry the frame's overhead
and have seen little context, so their band is higher.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from rankframe.llm.common import map_texts

#: (bytes up to, lowest ratio, highest ratio) of whole documents. The highest lie between prose and base64
#: of that length; up to 192 bytes these overlap, and only what does not compress at all is out.
DOCUMENT_BANDS = (
    (128, 0.0, 9.9),
    (192, 0.20, 0.99),
    (256, 0.20, 0.90),
    (384, 0.20, 0.84),
    (512, 0.20, 0.83),
    (1024, 0.16, 0.78),
    (2048, 0.16, 0.75),
    (4096, 0.11, 0.70),
    (8192, 0.11, 0.66),
    (1 << 62, 0.06, 0.62),
)
#: The same for chunks.
CHUNK_BANDS = (
    (128, 0.0, 9.9),
    (192, 0.12, 0.99),
    (256, 0.12, 0.90),
    (384, 0.12, 0.84),
    (512, 0.12, 0.83),
    (1024, 0.09, 0.78),
    (2048, 0.09, 0.75),
    (1 << 62, 0.07, 0.70),
)
CHUNK_BYTES = 4096
#: Share of chunks out of their band from which the document goes.
CHUNK_SHARE = 0.5
LEVEL = 3
WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"

OUT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_bytes long, doc_ratio double, n_chunks long, "
    "n_chunks_repetitive long, n_chunks_incompressible long"
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window of so many words that occurs twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    # Names of windows of doubled width from pairs of names: exact, no hash.
    width, names = 1, ids
    while width < window:
        step = min(width, window - width)
        pair = names[: len(names) - step] * (int(names.max()) + 1) + names[step:]
        names = np.unique(pair, return_inverse=True)[1]
        width += step
    again = np.bincount(names)[names] > 1
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in lines
            lines.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        dup,
        repeated_words(words),
    )


def _side(n: int, ratio: float, bands: tuple) -> int:
    low, high = next((lo, hi) for most, lo, hi in bands if n <= most)
    return (ratio > high) - (ratio < low)


def compression(raw: bytes, zip_: zstandard.ZstdCompressor) -> tuple[float | None, int, int, int, bool]:
    """Ratio of the whole, chunks, those below and above their band, and the verdict."""
    if not raw:
        return None, 0, 0, 0, True
    ratio = len(zip_.compress(raw)) / len(raw)
    chunks = low = high = 0
    if len(raw) <= CHUNK_BYTES:
        side = _side(len(raw), ratio, CHUNK_BANDS)
        chunks, low, high = 1, side < 0, side > 0
    else:
        for at in range(0, len(raw), CHUNK_BYTES):
            part = raw[at : at + CHUNK_BYTES]
            side = _side(len(part), len(zip_.compress(part)) / len(part), CHUNK_BANDS)
            chunks, low, high = chunks + 1, low + (side < 0), high + (side > 0)
    fine = _side(len(raw), ratio, DOCUMENT_BANDS) == 0 and low + high < CHUNK_SHARE * chunks
    return ratio, chunks, int(low), int(high), fine


def quality_rules(df: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each row of df: the columns carry, and OUT.

    Base rule: at least 20 words, and at most 30% of the words in repeated windows of eight.
    Null texts count as empty: no words, base_failed. Empty texts have no ratio. Rows that
    occur twice come out twice; columns besides carry and text are ignored, whatever their
    names. Work and memory are linear in a text's length, and nothing is shuffled.
    """

    def run(texts: list) -> dict[str, list]:
        zip_ = zstandard.ZstdCompressor(level=LEVEL)
        rows = []
        for t in texts:
            base = base_counts(t)
            failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
            raw = (t or "").encode("utf-8", "surrogatepass")
            ratio, chunks, low, high, fine = compression(raw, zip_)
            rows.append((*base, failed, fine and not failed, len(raw), ratio, chunks, low, high))
        names = [x.split()[0] for x in OUT.split(", ")]
        return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in names}

    return map_texts(df, carry, text, run, OUT)
