"""Packing token sequences into fixed windows by non-negative least squares.

Each document is cut at every full window; what is left is a piece shorter than a window.
Only the histogram of piece lengths, which the window bounds, goes to the driver. There,
shallow combinations of lengths that fill a window become columns of a matrix, repeat counts
are fitted to the histogram by non-negative least squares and rounded, and the rest is fitted again
or packed greedily. The plan is a table of ranges; each piece finds its place by its rank among the
pieces of its length.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankframe.llm.common import bounded_batches, rank_bits, save, spread_rank, trim, worker_cache

WINDOW = 2048
#: The id that ends each document.
END_ID = 1
#: Words, and parts of words, kept with their ids by each Python worker, in each of two generations.
CACHE_WORDS = 150_000
#: Characters of punctuation that a word may end with; an apostrophe may belong to a token with letters.
TAIL = b"*#$%&|!?,.;:"
#: How letters are split off.
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The end of the letters that go to the model at once (of ASCII, Latin-1 and Latin Extended-A), none of which takes part in a normal form, and the bytes of words of them.
LATIN = 0x180
LATIN_BYTES = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC2, 0xC6)])
#: Bytes of texts that are tokenized together.
TOGETHER = 4 << 20
#: Lengths tried as second piece beside each first one.
PARTNERS = 12
#: Rounds of the fit at most, what a window of padding costs in it, and the repeat count from which a combination is taken.
ROUNDS, WASTE, LEAST_REPEATS = 40, 0.2, 0.02


def _tokenizer(path: str):
    """The worker's tokenizer, with the ids of words that it has met."""
    kept = worker_cache("packing", path)
    if not kept:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        mark = tok.encode("\x01", add_special_tokens=False).ids
        kept |= {"tokenizer": tok, "mark": mark[0] if len(mark) == 1 else None, "words": {}, "old": {}}
        kept |= {"model": tok.model, "letters": _letters(path), "raw": [i.to_bytes(4, "little") for i in range(tok.get_vocab_size())]}
    return kept


def _letters(path: str) -> dict[int, str] | None:
    """Where a word of Latin letters is one string to the model: each letter as the model has it. Else None.

    So it is if text is brought to normal form and lower case, runs of letters are split off, and bytes are written as characters.
    """
    spec = json.loads(Path(path).read_text())
    normal = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    plain = normal == ["NFC", "Replace", "Lowercase"] and spec["normalizer"]["normalizers"][1]["pattern"] == {"Regex": "\\s+"}
    plain = plain and [x["type"] for x in pre] == ["Split", "ByteLevel"] and pre[0]["pattern"] == {"Regex": LETTER_RUNS} and (pre[0]["behavior"], pre[0]["invert"]) == ("Removed", True)
    if not plain or pre[1]["add_prefix_space"] or pre[1]["use_regex"] or spec["post_processor"]:
        return None
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; others follow from U+0100
    chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}
    return {c: "".join(chars[b] for b in chr(c).encode()) for c in range(0x80, LATIN)}


def _encode(words: list[bytes], kept: dict) -> list[bytes]:
    """The ids of each word: of one of Latin letters from the model at once, else by _encode_any()."""
    letters, raw, model = kept["letters"], kept["raw"], kept["model"].tokenize
    if letters is None:
        return _encode_any(words, kept)
    out, others = [], []
    for i, w in enumerate(words):
        if w.isalpha():  # of ASCII
            s = w.decode().lower()
        elif w.isascii() or w.translate(None, LATIN_BYTES) or not (s := w.decode().lower()).isalpha():
            out.append(b"")
            others.append(i)
            continue
        else:
            s = s.translate(letters)
        out.append(b"".join([raw[t.id] for t in model(s)]))
    for i, ids in zip(others, _encode_any([words[i] for i in others], kept), strict=True):
        out[i] = ids
    return out


def _encode_any(words: list[bytes], kept: dict) -> list[bytes]:
    """The ids of each word, from one text in which a control character stands between the words."""
    tok, mark = kept["tokenizer"], kept["mark"]
    out: list[bytes] = [b""] * len(words)
    plain = [i for i, p in enumerate(words) if mark is not None and b"\x01" not in p and b"<|" not in p]
    for at in range(0, len(plain), 2048):
        some = plain[at : at + 2048]
        text = b" \x01 ".join([words[i] for i in some]).decode()
        ids = np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        raw, cuts = ids.tobytes(), np.flatnonzero(ids == mark).tolist()
        for i, a, b in zip(some, [-1, *cuts], [*cuts, len(ids)], strict=True):
            out[i] = raw[4 * a + 4 : 4 * b]
    for i in sorted(set(range(len(words))).difference(plain)):
        out[i] = np.array(tok.encode(words[i].decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
    return out


def _tail(word: bytes) -> int:
    """Where the punctuation at a word's end begins if it follows a letter or digit, else 0: no token goes over that border."""
    stem = word.rstrip(TAIL)
    if not stem or len(stem) == len(word):
        return 0
    # Normal form and lower case may turn a last letter into one with a mark, which is no letter.
    plain = stem[-1:].isalnum() if stem[-1] < 128 else unicodedata.normalize("NFC", stem.decode("utf-8", "replace")).lower()[-1].isalpha()
    return len(stem) if plain else 0


def _split(texts: list) -> tuple[list[bytes], np.ndarray, list[int]]:
    """The distinct words of texts, the number of each word of the texts among them, and where each text's words begin, and the last's end.

    Arrow does so without an object for each word. An empty word stands before and after outer white space.
    """
    raw = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "replace") for t in texts]
    raw = [t if b"<|" in t else t.lower() for t in raw]  # special tokens depend on case
    split = pc.ascii_split_whitespace(pa.array(raw, pa.large_binary()).view(pa.large_string()))
    coded = split.values.dictionary_encode()
    words = coded.dictionary.view(pa.large_binary())
    _, at, data = words.buffers()
    at = np.frombuffer(at, dtype="<i8", count=len(words) + 1).tolist() if len(words) else [0]
    data = data.to_pybytes() if data else b""
    return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], coded.indices.to_numpy(), split.offsets.to_pylist()


def token_bytes(texts: list, path: str, cache_words: int = CACHE_WORDS) -> list[bytes]:
    """The ids of each text (a string, or its bytes in UTF-8), without END_ID, as little-endian unsigned 32-bit integers.

    The tokenizer lowers case, drops white space, and no token spans it: a text's ids are those
    of its words, and a word's those of what stands before its last punctuation, and of that. Each word is tokenized
    once for as long as it stays in the worker's cache.
    """
    kept = _tokenizer(path)
    distinct, codes, ends = _split(texts)
    found = list(map(kept["words"].get, distinct))
    new = {w for w, ids in zip(distinct, found, strict=True) if ids is None}
    if len(kept["words"]) + len(new) > cache_words:  # the next generation begins with the words of this batch that are new
        kept["old"], kept["words"] = kept["words"], {}
    words, old = kept["words"], kept["old"]
    cuts = {w: c for w in new if (c := _tail(w))} if kept["mark"] is not None else {}
    new.difference_update(cuts)
    for w, c in cuts.items():
        new.add(w[:c])
        new.add(w[c:])
    new.difference_update(words)
    known = new.intersection(old)
    words.update(zip(known, map(old.__getitem__, known), strict=True))
    fresh = list(new.difference(known))
    words.update(zip(fresh, _encode(fresh, kept), strict=True))
    for i, ids in enumerate(found):
        if ids is None:
            w = distinct[i]
            c = cuts.get(w)
            found[i] = words[w[:c]] + words[w[c:]] if c else words[w]
    return [b"".join(map(found.__getitem__, codes[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def pieces(ids: bytes, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of a document whose ids, the end's included, are given."""
    raw = memoryview(ids)
    return [
        (a // 4, min(4 * window, len(raw) - a) // 4, zlib.crc32(raw[a : a + 4 * window]))
        for a in range(0, len(raw), 4 * window)
    ]


#: A combination of lengths: each length with how often it occurs, longest first.
Combination = tuple[tuple[int, int], ...]


def largest_fit(counts: np.ndarray, window: int) -> list[tuple[Combination, int]]:
    """Fill windows with the longest pieces left that still fit, each combination as often as its pieces last."""
    left, out = counts.copy(), []
    left[0] = 0
    while (rest := np.flatnonzero(left)).size:
        used, room, spare = [], window, rest
        while spare.size:
            v = int(spare[-1])
            k = min(int(left[v]), room // v)
            used.append((v, k))
            room -= v * k
            spare = spare[: min(len(spare) - 1, np.searchsorted(spare, room, side="right"))]
        n = min(int(left[v]) // k for v, k in used)
        out.append((tuple(used), n))
        for v, k in used:
            left[v] -= n * k
    return out


def combinations(counts: np.ndarray, window: int) -> list[Combination]:
    """Combinations that fill the window or nearly: those of largest_fit(), and shallow ones of up to three lengths.

    To each first length go PARTNERS second lengths, the exact complement among them, and the
    longest third length that still fits.
    """
    lengths = np.flatnonzero(counts)
    have = np.zeros(window + 1, dtype=bool)
    have[lengths] = True
    below = np.maximum.accumulate(np.where(have, np.arange(window + 1), 0))  # longest that fits
    rows = []
    for first in lengths[::-1]:
        room = window - first
        second = lengths[(lengths <= first) & (lengths <= room)]
        if len(second) > PARTNERS:
            second = second[np.unique(np.linspace(0, len(second) - 1, PARTNERS).astype(int))]
        second = np.unique(np.r_[second, min(below[room], first), 0])
        third = np.minimum(below[room - second], second)
        rows.append(np.c_[np.full(len(second), first), second, third])
    every = np.unique(np.concatenate(rows), axis=0)[::-1]
    every = every[every.sum(axis=1) >= window - window // 256]
    out = dict.fromkeys(used for used, _ in largest_fit(counts, window))
    out |= dict.fromkeys(tuple((v, row.count(v)) for v in dict.fromkeys(row) if v) for row in every.tolist())
    return list(out)


def nnls(columns: list[Combination], counts: np.ndarray, window: int) -> list[float]:
    """x >= 0 that minimises |A x - counts|, A[l, j] being how often column j holds length l, and WASTE per padded window.

    Errors count relative to the square root of the counts, so that rare lengths matter too. Coordinate descent: a
    column has few lengths, so each step solves its own count exactly, and rounds go on until x stays.
    """
    weight = [1.0 / max(1.0, float(c)) for c in counts]
    miss = [float(c) for c in counts]
    own = []
    for used in columns:
        padding = window - sum(v * k for v, k in used)
        own.append((used, sum(weight[v] * k * k for v, k in used), WASTE * padding / window))
    x = [0.0] * len(columns)
    for _ in range(ROUNDS):
        moved = 0.0
        for j, (used, square, waste) in enumerate(own):
            slope = -waste
            for v, k in used:
                slope += weight[v] * k * miss[v]
            if slope <= 0 and not x[j]:
                continue
            step = max(-x[j], slope / square)
            x[j] += step
            moved += abs(step)
            for v, k in used:
                miss[v] -= k * step
        if moved < 1e-3 * sum(x):
            break
    return x


def plan(counts: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats), as fitted() has them, each length as often as it occurs."""
    return [(tuple(v for v, k in used for _ in range(k)), n) for used, n in fitted(counts, window)]


def fitted(counts: np.ndarray, window: int = WINDOW) -> list[tuple[Combination, int]]:
    """(combination, repeats) so that each length is used exactly as often as counts says.

    Repeat counts are fitted, and rounded down; where they are below one, the likeliest are taken once
    until half of the tokens are placed. What is left is fitted anew, and packed greedily once fitting places
    less than a tenth of it.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[Combination, int]] = []
    if left[window]:
        out.append((((window, 1),), int(left[window])))
        left[window] = 0
    sizes = np.arange(len(left))
    while tokens := int((left * sizes).sum()):
        columns, placed = combinations(left, window), 0
        x = nnls(columns, left, window)
        for j in sorted(range(len(x)), key=lambda j: -x[j]):
            if x[j] < LEAST_REPEATS or (x[j] < 1 and 2 * placed >= tokens):
                break
            n = min(max(1, int(x[j])), *(int(left[v]) // k for v, k in columns[j]))
            if n:
                out.append((columns[j], n))
                for v, k in columns[j]:
                    left[v] -= n * k
                    placed += n * v * k
        if 10 * placed < tokens:
            break
    return out + largest_fit(left, window)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together up to TOGETHER bytes, or a batch more: what they hold twice is looked up once."""
    some: list[pa.RecordBatch] = []
    for b in batches:
        some.append(b)
        if sum(x.nbytes for x in some) >= TOGETHER:
            yield pa.Table.from_batches(some)
            some = []
    if some:
        yield pa.Table.from_batches(some)


def cut(
    df: DataFrame, tokenizer: str, text: str, doc_id: str, window: int = WINDOW, cache_words: int = CACHE_WORDS
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens for each piece; null texts count as empty."""
    bounded_batches(df.sparkSession)
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()  # what earlier stages left in this worker
        for b in _gathered(batches):
            keys, rows = [], []
            for i, ids in enumerate(token_bytes(b.column(1).cast(pa.large_binary()).to_pylist(), tokenizer, cache_words)):
                found = pieces(ids + end, window)
                keys += [i] * len(found)
                rows += [(*p, len(ids) // 4 + 1) for p in found]
            cols = [pa.array(c, type=pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4
            ids_ = b.column(0).combine_chunks().take(pa.array(keys, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([ids_, *cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    src = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("__text"))
    return src.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(
    df: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, cache_words: int = CACHE_WORDS
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document, also an empty or null one, ends with END_ID and so has a piece. A repeated
    row is a document of its own; a null doc_id stays null. An empty table gives no rows; other
    columns of df are ignored. What reaches the driver is a count per length, window at most;
    ranks within a length are exact also if one length holds a third of all pieces. cache_words trades
    a worker's memory (about 400 bytes each) for time, and changes no result.
    """
    cut_ = save(cut(df, tokenizer, text, doc_id, window, cache_words), "pieces")
    counts = np.zeros(window + 1, dtype=np.int64)
    for length, n in cut_.groupBy("length").count().collect():  # at most window rows
        counts[length] = n
    slots, sequence = [], 0
    taken = np.zeros(window + 1, dtype=np.int64)
    for used, n in fitted(counts, window):
        at = 0
        for v, k in used:
            slots.append((v, int(taken[v]), int(taken[v]) + n * k, k, sequence, at))
            taken[v] += n * k
            at += v * k
        sequence += n
    # As an Arrow table, since Spark starts Python workers of another kind beside the others to read rows of a list.
    names = ["length", "__from", "__to", "__times", "__sequence", "__at"]
    table = df.sparkSession.createDataFrame(pa.table([pa.array([s[i] for s in slots], pa.int64()) for i in range(len(names))], names))
    ranked = spread_rank(cut_, ["length"], ["doc_id", "start", "ids_crc32", "doc_tokens"], "__rank", rank_bits(int(counts.sum())))
    here = (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to"))
    # Spark knows the size of the plan, which follows from the window, and broadcasts it if it is small.
    placed = ranked.join(table, "length").where(here)
    nth = F.col("__rank") - F.col("__from")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("__sequence") + F.expr("(__rank - __from) div __times")).alias("sequence_id"),
        (F.col("__at") + nth % F.col("__times") * F.col("length")).alias("offset"),
    )
