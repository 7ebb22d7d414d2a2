"""Secret scans: patterns, and password guess cost for values in credential context.

A value that stands where a credential stands ("pwd: ...", "login with ...") is a secret if
guessing it is expensive. The cost is found by dynamic programming over all ways to cut the
value into common words, dates, repeats, keyboard walks, and spans that only brute force
finds: the cheapest segmentation is what an attacker would use. Cost alone does not tell a secret from
a rare word of prose, so a value of letters only counts by a higher bound, and not at all where
the context is a sentence ("the password is ...", "bearer ...").
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankframe.llm.common import columns, map_texts

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs; those under 24 fail anyway
NAMES = (
    "password|passwd|passphrase|passcode|pass|pwd|secret|token|api[_-]?key|access[_-]?key|"
    "private[_-]?key|credentials?|authorization|auth|bearer|login"
)
#: Words that announce a credential, with what may stand between them and the value; group 1 or 2 where it may be prose.
CONTEXT = re.compile(
    rf"""(?<![A-Za-z0-9])(?:(?:{NAMES})["']?[\x20\t]*(?:[:=]|=>|->|\b(is)\b)[\x20\t]*["']?(?:(?:bearer|basic)[\x20\t]+)?|"""
    rf"""(bearer|log[\x20-]?in[\x20\t]+with)[\x20\t]+["']?(?!(?:{NAMES})(?![A-Za-z0-9])))([^\s"'<>,;]+)""",
    re.ASCII | re.IGNORECASE,
)
HINTS = ("log in", "log-in", "pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "login")
#: Frequent password words, most frequent first. The words of a vocabulary follow them.
WORDS = (
    "password 123456 qwerty admin welcome login letmein master hello monkey dragon secret pass test "
    "user root default changeme temp guest summer winter spring autumn love money shadow super "
    "football baseball michael jordan hunter soccer killer george andrew charlie daniel thomas "
    "jessica ashley pepper ginger cookie cheese coffee computer internet server system office access "
    "example sample demo dummy none null true false token value string data key name mail web "
    "january february march april june july august september october november december monday "
    "tuesday wednesday thursday friday saturday sunday"
).split()
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
NEAR = {c: {d for d in row[max(0, i - 1) : i + 2]} for row in ROWS for i, c in enumerate(row)}
LEET = str.maketrans("4@3106$57", "aaeiogsst")
DATE = re.compile(
    r"(?:19|20)\d\d(?:[-/._]?(?:1[0-2]|0?[1-9])(?:[-/._]?(?:3[01]|[12]\d|0?[1-9]))?)?"
    r"|(?:3[01]|[12]\d|0?[1-9])[-/._](?:1[0-2]|0?[1-9])[-/._](?:19|20)?\d\d"
)
#: A value is a secret from this cost on (powers of ten of guesses), and this length.
LEAST_LOG10, LEAST_CHARS = 8.0, 6
#: The same for values of letters only, which may be rare words.
LEAST_LETTERS = 16.0
#: Longest unit of a repeat; the repeat itself may be of any length.
UNIT = 512

OUT = (
    "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, max_log10_guesses double, "
    "costs string"
)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=4)
def dictionary(vocabulary: str | None) -> tuple[dict[str, int], int]:
    """Guess count by word, and the longest word: WORDS, then the whole words of a BPE vocabulary in the order of its merges.

    vocabulary is a tokenizers file whose tokens mark a word's end by </w>; None: WORDS alone. A merge is made the earlier
    the more frequent it is, so the order is one of frequency.
    """
    words = list(WORDS)
    if vocabulary:
        with open(vocabulary, encoding="utf-8") as f:
            ids = json.load(f)["model"]["vocab"]
        words += [w[:-4] for w in sorted(ids, key=ids.get) if w.endswith("</w>") and len(w) > 6 and w[:-4].isalpha()]
    ranks = {w: i for i, w in enumerate(dict.fromkeys(words), 1)}
    return ranks, max(map(len, ranks))


def _pool(value: str) -> int:
    pool = 10 * any(c.isdigit() for c in value) + 26 * any("a" <= c <= "z" for c in value)
    pool += 26 * any("A" <= c <= "Z" for c in value) + 33 * any(not c.isalnum() for c in value)
    return max(10, pool)


def copies(value: str) -> dict[int, list[tuple[int, int]]]:
    """By start, the end and the unit of segments that go on with the unit of two or more characters before them."""
    found = defaultdict(list)
    text = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(text)
    for unit in range(2, min(UNIT, n // 2) + 1):
        same = np.flatnonzero(np.diff(np.r_[False, text[unit:] == text[:-unit], False]))
        for s, e in zip(same[::2].tolist(), same[1::2].tolist(), strict=True):
            # value[s : e + unit] has this period; a unit may begin at any place of the first.
            for a in range(s + unit, min(s + 2 * unit, e + 1)):
                whole = a + (e + unit - a) // unit * unit
                found[a].append((whole, unit))
                if whole < e + unit:
                    found[a].append((e + unit, unit))
    return found


def guess_cost(value: str, vocabulary: str | None = None) -> tuple[float, list[tuple[str, int, int]]]:
    """Least log10 of guesses, and the segmentation (kind, start, end) that attains it.

    Each segment multiplies the guesses by its own count and by two for the choice of where
    to cut. A repeat of several characters is a segment that copies the unit before it, which
    is paid for by its own cheapest segments. Time is linear in the length: words and dates have a
    longest length, repeats and walks are taken whole, and brute force grows by single characters.
    """
    n = len(value)
    if not n:
        return 0.0, []
    ranks, longest = dictionary(vocabulary)
    low = value.lower()
    plain = low.translate(LEET) if len(low) == n else value
    low = low if len(low) == n else value
    brute = math.log10(_pool(value))
    # best[b][k]: least cost of value[:b] whose last segment is brute force (k = 1) or not (k = 0); brute
    # force that goes on pays for no further cut, so both have to be kept.
    best, back = [[math.inf, math.inf] for _ in range(n + 1)], [[("", 0, 0), ("", 0, 0)] for _ in range(n + 1)]
    best[0][0] = 0.0
    cut = math.log10(2)
    # Ends of the run of one character and of the walk from each place, and turns of walks before each place.
    run, walk, turned = [n] * n, [n] * n, [0] * (n + 1)
    for a in range(n - 2, -1, -1):
        run[a] = run[a + 1] if value[a + 1] == value[a] else a + 1
        walk[a] = walk[a + 1] if low[a + 1] in NEAR.get(low[a], ()) else a + 1
    for b in range(n):
        turned[b + 1] = turned[b] + (b > 1 and low[b] == low[b - 2])
    copied = copies(value)

    def offer(kind: str, a: int, b: int, cost: float) -> None:
        to = kind == "brute"
        for k in (0, 1):
            total = best[a][k] + cost + (0 if to and k else cut)
            if total < best[b][to]:
                best[b][to], back[b][to] = total, (kind, a, k)

    for a in range(n):
        offer("brute", a, a + 1, brute)
        for b in range(a + 3, min(n, a + longest) + 1):
            rank = ranks.get(low[a:b]) or (ranks.get(plain[a:b], 0) * 4)
            if rank:
                case = 0 if value[a:b] == low[a:b] else math.log10(2 if value[a + 1 : b] == low[a + 1 : b] else 2 ** (b - a))
                offer("word", a, b, math.log10(rank) + case)
        if value[a].isdigit() and (m := DATE.match(value, a)):
            offer("date", a, m.end(), math.log10(365 * 120 if m.end() - a > 4 else 120))
        if (b := run[a]) - a >= 3:
            offer("repeat", a, b, brute + math.log10(b - a))
        if (b := walk[a]) - a >= 4:
            offer("walk", a, b, math.log10(47 * (b - a)) + (1 + turned[b] - turned[a + 2]) * math.log10(3))
        for b, unit in copied.get(a, ()):
            offer("repeat", a, b, math.log10(unit + b - a))
    parts, at, k = [], n, int(best[n][1] < best[n][0])
    least = best[n][k]
    while at:
        kind, a, before = back[at][k]
        if kind == "brute" and parts and parts[-1][0] == "brute":
            parts[-1] = ("brute", a, parts[-1][2])
        else:
            parts.append((kind, a, at))
        at, k = a, before
    return least, parts[::-1]


def is_secret(value: str, cost: float, prose: bool) -> bool:
    """Whether a value in credential context is one that an attacker would not guess; prose: the context may be a sentence."""
    if len(value) < LEAST_CHARS or cost < LEAST_LOG10 or (prose and "://" in value):
        return False
    letters = value.replace("-", "").replace("\u2019", "").isalpha()
    return not letters or (not prose and cost >= LEAST_LETTERS)


def scan(text: str | None, vocabulary: str | None = None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], list[tuple[int, int, float]]]:
    """Base spans, guess spans, and (start, end, cost) of each value in credential context; places in code points."""
    text = text or ""
    base = [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    low = text.lower()
    more, costs = [], {}
    if any(h in low for h in HINTS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_CHARS:
                base.append(("assign", m.start(), m.end()))
                costs[m.span(2)] = guess_cost(m[2], vocabulary)[0]
        for m in CONTEXT.finditer(text):
            value = m[3].rstrip(".:!?)]}#*$%&")
            a = m.start(3)
            b = a + len(value)
            if (a, b) not in costs:
                costs[a, b] = guess_cost(value, vocabulary)[0]
            if is_secret(value, costs[a, b], bool(m[1] or m[2])) and not any(x <= a and b <= y for _, x, y in base):
                more.append(("guess", a, b))
    return base, more, [(a, b, c) for (a, b), c in sorted(costs.items())]


def listed(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then kind as listed, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def redact(text: str | None, vocabulary: str | None = None) -> str | None:
    """The text with each secret replaced by a mark of its kind; spans that overlap become one."""
    if text is None:
        return None
    base, more, _ = scan(text, vocabulary)
    out, at = [], 0
    end, kind = -1, ""
    for k, a, b in sorted(base + more, key=lambda s: (s[1], -s[2])):
        if a >= end:
            if end >= 0:
                out.append(f"[{kind}]")
                at = end
            out.append(text[at:a])
            kind, end = k, b
        else:
            end = max(end, b)
    if end >= 0:
        out.append(f"[{kind}]")
        at = end
    return "".join(out) + text[at:]


def secret_scan(df: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None) -> DataFrame:
    """A row for each row of df: the columns carry, and OUT. vocabulary is a file for dictionary().

    Null texts count as empty; texts without a secret have an empty list of spans and the
    digest of the empty string. A guess span is listed only where no base span covers it. costs lists
    start:end:cost of every value in credential context, those of base spans too, in powers of ten of guesses.
    Rows that occur twice come out twice; other columns are ignored, whatever their names.
    Nothing is shuffled, and a text's work is linear in its length.
    """

    def run(texts: list) -> dict[str, list]:
        got: dict[str, list] = {x.split()[0]: [] for x in OUT.split(", ")}
        for t in texts:
            base, more, costs = scan(t, vocabulary)
            for kind in KINDS:
                got[f"n_{kind}"].append(sum(k == kind for k, _, _ in base + more))
            got["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
            got["spans"].append(listed(base + more))
            got["max_log10_guesses"].append(max((c for _, _, c in costs), default=None))
            got["costs"].append(",".join(f"{a}:{b}:{c:.2f}" for a, b, c in costs))
        return got

    return map_texts(df, carry, text, run, OUT)


def redact_secrets(df: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """df with its secrets replaced by marks such as [assign]; all columns and rows stay, in df's order of columns.

    Null texts stay null and empty ones empty; repeated rows stay repeated; an empty table gives no rows.
    """
    others = [c for c in df.columns if c != text]
    kept = [F.struct(*[c for c, n in zip(columns(df), df.columns, strict=True) if n != text]).alias("row")] if others else []
    src = df.select(*kept, F.col(f"`{text}`").alias("own_text"))
    done = map_texts(src, ["row"] if others else [], "own_text", lambda ts: {"clean": [redact(t, vocabulary) for t in ts]}, "clean string")
    field = lambda n: F.col("row").getField(n)
    return done.select(*[F.col("clean").alias(n) if n == text else field(n).alias(n) for n in df.columns])
