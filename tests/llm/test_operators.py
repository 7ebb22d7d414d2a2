"""Operators on training data against brute force and exact round trips, with the odd rows in each fixture."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankframe.llm import (
    common,
    components,
    embedding_dedup,
    html_extract,
    mixing,
    ngram_join,
    packing,
    quality_classifier,
    quality_rules,
    queries,
    secret_scan,
    url_filter,
    warc,
)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, rank string, length int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ta", "re", "mo", "li", "su", "ne", "ka", "do"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls, empties, repeats, a very long text, and columns whose names clash with the operators' own."""
    texts = [None, "", "   \n", "one", "Two words", prose(1, 400), prose(1, 400), prose(1, 400).upper(), prose(1, 397) + " x y z", prose(2, 60) * 1, prose(3, 30000), "été Ö\x1f\xa0x"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), i, "r", 3) for i, t in enumerate(texts)]
    rows += [rows[5], (None, prose(1, 400), None, "s1", None, None, None, None), (99, prose(9, 300), None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def brute_components(rows, words, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    part = {i: i for i in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                part[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("words", "num", "den"), [(3, 9, 10), (5, 8, 10), (2, 1, 2)])
def test_ngram_join(spark, odd, words, num, den):
    got = ngram_join.jaccard_components(odd, words=words, num=num, den=den).collect()
    assert len(got) == 15
    want = brute_components([(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None], words, num, den)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert ngram_join.jaccard_components(odd.limit(0)).count() == 0


@pytest.mark.parametrize("part", [8, 256])
def test_ngram_join_large_families(spark, monkeypatch, part):
    """Near copies that link only in part, dealt into many parts."""
    monkeypatch.setattr(ngram_join, "PART", part)
    monkeypatch.setattr(ngram_join, "ACROSS", part)
    base, rows, r = prose(5, 120).split(), [], random.Random(3)
    for i in range(90):
        w = list(base)
        for _ in range(i % 5):
            w[r.randrange(len(w))] = f"new{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 3, 9, 10)
    assert {x["doc_id"]: x["component_id"] for x in ngram_join.jaccard_components(df).collect()} == {i: c for i, (_, c) in want.items()}


def test_ngram_query_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute_components([tuple(r) for r in docs], 3, 9, 10)
    got = queries.op2_ngram_jaccard_join(spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_keep_one(spark, odd):
    got = ngram_join.keep_one(odd)
    assert got.columns == odd.columns
    ids = Counter(r["doc_id"] for r in got.collect())
    assert set(ids) == {None, 0, 1, 2, 3, 4, 5, 9, 10, 11, 99}
    assert max(ids.values()) == 1


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7)]
    part = {}

    def find(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            part[y] = x
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {x["node"]: x["root"] for x in got} == {x: find(x) for x in part}
    assert len(got) == len(part)


@pytest.mark.parametrize(("together", "alone"), [(1, -1), (1, 1 << 18), (50, -1), (1 << 18, 1 << 18)])
def test_components_in_one_task_and_by_rounds(spark, monkeypatch, together, alone):
    monkeypatch.setattr(components, "TOGETHER", together)
    monkeypatch.setattr(components, "ALONE", alone)
    written = []
    monkeypatch.setattr(components, "save_at", lambda df, tag, kept=components.save_at: written.append(tag) or kept(df, tag))
    links = [(i + 1, i) for i in range(60)] + [(200, 30), (200, 300), (7, 7), (None, 5), (5, None), (900, 800), (800, 900)]
    want = {**{i: 0 for i in (*range(61), 200, 300)}, 800: 800, 900: 800}
    got = components.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert len(got) == len(want) and {x["node"]: x["root"] for x in got} == want
    assert len(written) == 2 if alone > 0 else len(written) > 5  # few links need no rounds, each of four shuffles
    assert components.components(spark.createDataFrame([(7, 7)], "a long, b long")).count() == 0


def test_embedding_dedup(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((300, 24))
    x[100:180] = x[5] + 0.12 * r.standard_normal((80, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    rows += [(300, rows[7][1]), (301, rows[7][1]), (302, None), (303, [0.0] * 24), (304, [float("nan")] * 24), (305, [None] * 24), (306, [float("inf")] * 24), (307, []), (308, [1.0, 2.0]), (300, rows[7][1])]
    rows.append((310, [2 * v for v in rows[7][1]]))
    df = spark.createDataFrame([(i, v, 1, "w") for i, v in rows], "vec_id long, embedding array<float>, id int, w string")
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    links = defaultdict(int)
    part = {i: i for i, _ in rows}

    def find(a):
        while part[a] != a:
            a = part[a]
        return a

    for a in range(len(good)):
        for b in range(len(good)):
            u, v = good[a][1], good[b][1]
            if a != b and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.9:
                links[good[a][0], a] += 1
                p, q = sorted((find(good[a][0]), find(good[b][0])))
                part[q] = p
    got = embedding_dedup.near_duplicates(df).collect()
    want = sorted([(i, links[i, k], find(i)) for k, (i, _) in enumerate(good)] + [(i, 0, i) for i in (302, 303, 304, 305, 306, 307)])
    assert sorted((g["vec_id"], g["n_links"], g["component_id"]) for g in got) == want
    assert all(g["kept"] == (g["vec_id"] == g["component_id"]) for g in got)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [2_000, 100_000, 200_000, 1_000_000, 10_000_000])
def test_embedding_lists_at_every_size(n):
    r = np.random.default_rng(2)
    x, u = r.standard_normal((2, 400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u -= (u * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * u / np.linalg.norm(u, axis=1, keepdims=True)
    drawn = embedding_dedup.codes(n, 64)
    a, b = embedding_dedup.filters(x, drawn), embedding_dedup.filters(y, drawn)
    assert all(len(set(p)) >= embedding_dedup.LISTED for p in a)
    assert np.mean([bool(set(p) & set(q)) for p, q in zip(a, b, strict=True)]) >= 0.985


@pytest.mark.parametrize("dim", [1, 2, 5, 24, 64])
def test_embedding_dedup_by_filters(spark, dim):
    r = np.random.default_rng(dim)
    x = r.standard_normal((900 if dim > 5 else 500, dim))
    x = np.concatenate([x, x[:300] + 0.3 * r.standard_normal((300, dim))])
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(x)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    found = np.array([g["n_links"] for g in sorted(got)])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum() > 0


def test_secret_scan(spark, odd):
    hexes, key = "0123456789abcdef" * 2, "AKIA" + "A1B2" * 5
    text = f"é password = 'short' Password: \"longer_1\" x {hexes} {key} AKIA123 pwd: zK9#vQ2!mT7 login: password123 TOKEN={hexes}"
    base, more, most = secret_scan.scan(text)
    kinds = Counter(k for k, _, _ in base)
    assert kinds == {"assign": 2, "access": 1, "hex": 2}
    assert [text[a:b] for _, a, b in more] == ["zK9#vQ2!mT7"]
    got = secret_scan.secret_scan(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0]["base_sha256"] == hashlib.sha256(secret_scan.listed(base).encode()).hexdigest()
    assert got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[0]["n_assign"] == 2
    assert secret_scan.secret_scan(odd).count() == 15
    clean = secret_scan.redact(text)
    assert hexes not in clean and key not in clean and "zK9" not in clean and "password123" in clean
    assert secret_scan.redact("nothing here") == "nothing here"
    assert secret_scan.redact_secrets(odd).columns == odd.columns


def brute_cost(value: str) -> float:
    """All segmentations of a short value by recursion, from the same segment costs."""
    single = {}
    for a in range(len(value)):
        for b in range(a + 1, len(value) + 1):
            cost, parts = secret_scan.guess_cost(value[a:b])
            if len(parts) == 1:
                single[a, b] = cost
    best = [0.0] + [float("inf")] * len(value)
    for b in range(1, len(value) + 1):
        best[b] = min(best[a] + single[a, b] for a in range(b) if (a, b) in single)
    return best[-1]


@pytest.mark.parametrize("value", ["password", "qwerty2019", "aaaa1111", "dragonmonkey", "1999-12-31x", "asdfghj"])
def test_guess_cost(value):
    cost, parts = secret_scan.guess_cost(value)
    assert [p[1] for p in parts] == [0, *[p[2] for p in parts[:-1]]]
    assert parts[-1][2] == len(value)
    assert cost < secret_scan.guess_cost("xK9#mQ2v!tZ8")[0]
    assert cost <= brute_cost(value) + 2  # character classes of parts are no larger than the whole's


@pytest.mark.parametrize("text", [
    "The password is required.", "the secret is patience", "login: required", "Its password is complicated, and the token is mandatory.",
    "token: abcabcabcabcabcabc", "pwd: " + "asdf" * 30, "pwd: " + "a" * 500, "password: " + "xy7xy7" * 40, "bearer instruments and bearer securities",
    "You login with friends. Log in with Password: required",
])
def test_clean_text_has_no_guess_span(text):
    assert not [s for s in secret_scan.scan(text)[1]]
    assert "[guess]" not in secret_scan.redact(text)


@pytest.mark.parametrize("text", [
    "Authorization: Bearer %s", "header Bearer %s here", "please login with %s.", "Log in with %s", "Authorization: Basic %s", "pwd: %s", "login with password: %s",
])
def test_credentials_in_context(text):
    base, more, _ = secret_scan.scan(text % "zK9#vQ2!mT7")
    found = [(text % "zK9#vQ2!mT7")[a:b] for _, a, b in base + more]
    assert any("zK9" in f for f in found) and [f for f in found if f == "zK9#vQ2!mT7"]


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    got = packing.pack(odd, path).collect()
    ids = {r["doc_id"]: [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in odd.collect()}
    covered, spans = Counter(), defaultdict(list)
    for r in got:
        doc = ids[r["doc_id"]]
        part = np.array(doc[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()
        assert zlib.crc32(part) == r["ids_crc32"]
        assert r["doc_tokens"] == len(doc)
        covered[r["doc_id"]] += r["length"]
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    assert covered[5] == 2 * len(ids[5])  # a repeated row is a document of its own
    assert all(covered[i] == len(d) for i, d in ids.items() if i != 5)
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(odd.limit(0), path).count() == 0


def test_token_bytes_are_the_tokenizers():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    texts = ["<|endoftext|> A<|startoftext|>b", "it's O'Neil's \"x\".", "a\x01b \x01", "１２ ½ Σας İx ﬁ", "é É. …. x y", "..a..b''c'' \U0001f600!", prose(4, 500)]
    texts += [t.upper() for t in texts]
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert packing.token_bytes(texts, path) == want


def test_plan_uses_every_piece():
    r = np.random.default_rng(2)
    for n in (0, 1, 5, 3000):
        counts = np.bincount(r.integers(1, 2049, n), minlength=2049)
        used = np.zeros(2049, dtype=int)
        plan = packing.plan(counts)
        for lengths, k in plan:
            assert sum(lengths) <= 2048
            for v in lengths:
                used[v] += k
        assert (used == counts).all()
    assert sum(k for _, k in plan) <= 1.03 * (counts * np.arange(2049)).sum() / 2048 + 1


@pytest.mark.parametrize("seed", range(6))
def test_knapsack(seed):
    r = np.random.default_rng(seed)
    lengths, counts = np.unique(r.integers(3, 40, 6)), None
    counts = r.integers(0, 4, len(lengths))
    budget = int(r.integers(1, 120))
    sums = {0}
    for v, n in zip(lengths.tolist(), counts.tolist(), strict=True):
        sums = {s + k * v for s in sums for k in range(n + 1)}
    take = mixing.knapsack(lengths, counts, budget)
    assert (take <= counts).all()
    assert (take * lengths).sum() == max(s for s in sums if s <= budget)


def test_mixing(spark, odd):
    got = mixing.mix(odd).collect()
    assert len(got) == 15
    sizes = defaultdict(int)
    for r in odd.collect():
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0d]+", r["text"] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight, cap, target = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {s: 3 * sizes[s] for s in order}, {}
    left, open_ = float(sum(sizes.values())), set(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if cap[s] <= share * weight[s]}
        for s in full or open_:
            target[s] = cap[s] if full else share * weight[s]
        left -= sum(cap[s] for s in full)
        open_ = open_ - full if full else set()
    taken = defaultdict(int)
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6
        assert r["source_size"] == sizes[r["source"]]
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert sorted(got, key=str) == sorted(mixing.mix(odd.repartition(5)).collect(), key=str)
    docs = queries.op7_mixing(spark, "/root/testdata/sf0.01").groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k")).collect()
    assert all(abs(r["t"] - r["k"]) <= 2 for r in docs)
    assert mixing.mix(odd.limit(0)).count() == 0
    copies = mixing.mix_documents(odd)
    assert copies.columns == odd.columns
    assert copies.select(F.sum(mixing.word_count("text"))).first()[0] == sum(taken.values())


def test_html_rules():
    show = html_extract.render
    assert show("<p>a<p>b<script>x</script><!-- c --><div hidden>no</div>") == "a\n\nb"
    assert show("<ul><li>a<li>b<ol><li>c</ol></ul>") == "- a\n- b\n  1. c"
    assert show("<table><tr><td>aa<td>b<tr><td>c<td>dd</table>") == "aa  b\nc   dd"
    assert show("<style>.x{display:none}</style><i class='x'>n</i>y &amp; z &lt;") == "y & z <"
    assert show("<div style='visibility:hidden'>a<b style='visibility: visible'>b</b></div>") == "b"
    assert show("<pre>a\n  b</pre>") == "a\n  b"
    assert show("a<br>b") == "a\nb"
    assert show(None) == show("") == show("<p") == ""
    assert show("1 < 2 and <b") == "1 < 2 and"
    assert "deep" in show("<div>" * 5000 + "deep")
    assert show("<td>x</td>") == "x"


def test_html_visibility():
    show = html_extract.render
    assert show("<p>Let <math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></semantics></math> hold") == "Let x=2 hold"
    svg = "<svg><defs/><title>t</title><path d='M0'/><defs><text>no</text></defs><text x='1'>Label</text><text>Two<tspan>!</tspan></text></svg>"
    assert show(f"a{svg}b") == "a\nLabel\nTwo!\nb"
    assert show("<style>@media print { nav, .article { display: none } }</style><nav>n</nav><div class=article>text</div>") == "n\ntext"
    assert show("<style>@media screen { .x { display: none } } .y{display:none}</style><i class=x>n</i><i class=y>m</i>k") == "k"
    assert show("<style>@media (max-width: 600px) { .x { display: none } }</style><i class=x>yes</i>") == "yes"
    assert show("<style>@media screen and (min-width: 40em) { .x { display: none } }</style><i class=x>no</i>k") == "k"
    assert show("<style media=print>.x{display:none}</style><i class=x>yes</i>") == "yes"
    assert show("<style>@import 'a.css'; @font-face{src:url(x)} .x{display:none}</style><i class=x>no</i>k") == "k"
    assert show("<style>.x{display:none} .x{display:block}</style><i class=x>yes</i>") == "yes"
    assert show("<style>.x{display:none}</style><i class=x style='display:inline'>yes</i>") == "yes"
    assert show("<style>.x{display:none!important}</style><i class=x style='display:inline'>no</i>k") == "k"
    assert show("<style>.b{display:block}.a{display:none}</style><i class='a b'>no</i>k") == "k"
    assert show("<dialog>no</dialog>a<dialog open>yes</dialog>") == "a\nyes"
    assert show("<style>#x{display:block}</style><p hidden>no<p hidden id=x>yes") == "yes"


def test_html_rowspan():
    show = html_extract.render
    assert show("<table><tr><td rowspan=2>aa<td>b<tr><td>c<tr><td>d<td>e</table>") == "aa  b\n    c\nd   e"
    assert show("<table><tr><td>a<td rowspan=0 colspan=2>b<td>c<tr><td>d<td>e</table>").splitlines() == ["a  b    c", "d       e"]
    assert show("<table><tbody><tr><td rowspan=3>aa<td>b</tbody><tbody><tr><td>c<td>d</table>") == "aa  b\nc   d"


def test_html_query(spark):
    got = queries.op1_html_extraction(spark, SF).collect()
    assert len(got) == 50
    for r in got:
        assert "track(" not in r["text"] and "margin:0" not in r["text"]
        assert r["n_chars"] == len(r["text"])


def test_url_filter(spark):
    changes = [("a", "bad.com", "add", 3), ("a", "bad.com", "remove", 6), ("b", "x.bad.com", "add", 1), ("b", "x.bad.com", "add", 2), ("c", "ok.org/p", "add", 1), (None, "bad.com", "add", 1), ("d", "bad.com", "add", None)]
    rows = [(1, "http://BAD.com/", 2), (2, "http://bad.com./", 3), (3, "https://u@x.bad.com:80/q", 6), (4, "http://x.bad.com", 5), (5, "http://notbad.com/", 4), (6, "http://ok.org/p/q?r", 9), (7, "http://ok.org/pq", 9), (8, None, 4), (9, "junk", 4), (2, "http://bad.com./", 3), (10, "http://bad.com/", None)]
    day = F.when(F.col("d").isNotNull(), F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")))
    c = spark.createDataFrame(changes, "list string, entry string, action string, d int").withColumn("day", day).drop("d")
    p = spark.createDataFrame(rows, "page_id long, url string, d int").withColumn("fetched", day).withColumn("entry", F.lit("clash"))
    got = sorted((r["page_id"], r["blocked"], r["n_lists"], r["entry"]) for r in url_filter.filter_urls(p, c).collect())
    assert got == [
        (1, False, 0, None), (2, True, 1, "bad.com"), (2, True, 1, "bad.com"), (3, True, 1, "x.bad.com"), (4, True, 2, "x.bad.com"), (5, False, 0, None),
        (6, True, 1, "ok.org/p"), (7, False, 0, None), (8, False, 0, None), (9, False, 0, None), (10, False, 0, None),
    ]
    assert url_filter.filter_urls(p, c.limit(0)).where("blocked").count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "x\r\n\r\nWARC/1.1\r\n" * 9000 + "é"
    pages = [(3, "u3", "a" * 200), (1, "u 1\n", "a" * 200), (2, "u2", big), (4, "u4", None), (5, None, ""), (6, "u6", "short"), (7, "u7", "short"), (2, "u2", big), (None, "n", "a" * 200)]
    df = spark.createDataFrame([(*p, 1, "d") for p in pages], "page_id long, url string, html string, n int, digest string")
    for compression in ("none", "gzip"):
        path = f"file://{tmp_path}/{compression}"
        warc.write_archives(df, path, segment=5000, compression=compression)
        got = warc.read_archives(spark, path).collect()
        assert all(r["complete"] for r in got)
        seen = sorted(((r["page_id"], r["record_type"], r["refers_to"], bytes(r["payload"]).decode() if r["payload"] is not None else None) for r in got), key=str)
        want = sorted([(3, "revisit", 1, None), (1, "response", None, "a" * 200), (2, "response", None, big), (2, "response", None, big), (4, "response", None, ""), (5, "response", None, ""), (6, "response", None, "short"), (7, "response", None, "short"), (None, "revisit", 1, None)], key=str)
        assert seen == want


def test_warc_missing_segment():
    parts = list(warc.records(1, "u", b"z" * 1000, hashlib.sha256(b"z" * 1000).hexdigest(), None, None, "d", "n", 300))
    assert len(parts) == 4
    raw = b"".join(p + warc.END for p in parts)
    assert [f.get(b"warc-segment-number") for f, _ in warc.parse(raw)] == [b"1", b"2", b"3", b"4"]
    assert warc.dechunked(warc.chunked(b"q" * 30000)) == b"q" * 30000
    with pytest.raises(ValueError):
        warc.dechunked(warc.chunked(b"q" * 30000)[:-20])


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, odd):
    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    texts = [r["text"] for r in docs.collect()] + ["a b c d e f g h " * 5, "x\nx\n\n \nx", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8"]
    for t in texts:
        assert quality_rules.base_counts(t) == brute_rules(t)
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == 215
    assert all(not r["kept"] or not r["base_failed"] for r in got)
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in got)
    noise = "".join(random.Random(1).choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/ ") for _ in range(9000))
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    assert quality_rules.compression(prose(1, 900).encode(), z)[-1]
    assert not quality_rules.compression(random.Random(1).randbytes(9000), z)[-1]
    assert not quality_rules.compression(b"spam " * 3000, z)[-1]
    assert len(noise) == 9000


@pytest.mark.parametrize("n", [240, 380, 500, 700, 1000, 1500, 2000, 3000, 4096, 6000, 9000, 60000])
def test_quality_rules_reject_random_text(spark, n):
    r = random.Random(n)
    encoded = base64.b64encode(r.randbytes(n)).decode()
    step = min(60, n // 24)
    texts = [
        " ".join(encoded[i : i + step - 1] for i in range(0, n, step))[:n],
        "".join(r.choice("".join(map(chr, range(33, 127))) + " " * 12) for _ in range(n)),
        prose(n, n // 5)[:n],
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert not any(g["base_failed"] for g in got)
    assert [g["kept"] for g in got] == [False, False, True]


def test_quality_classifier(spark, odd):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = quality_classifier.classify(docs, train).join(held, "doc_id").select("kept", "quality").toPandas()
    assert ((got["kept"]) == (got["quality"] == 1)).mean() > 0.95
    assert got[got["quality"] == 1]["kept"].mean() > 0.98
    none = labels.limit(0)
    assert quality_classifier.classify(odd, none).where("kept").count() == 15
    assert quality_classifier.classify(odd.limit(0), train).count() == 0
    kept = quality_classifier.keep_quality(odd, none)
    assert kept.columns == odd.columns and kept.count() == 15


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for _, stage in p.STAGES[:-1]:
        at = stage(spark, at, SF)
        assert at.columns == docs.columns
        assert dict(at.dtypes) == dict(docs.dtypes)
    assert p.run(spark, SF).count() > 0


def test_counts_of_ngrams_tell_common_ones_in_full_tables(spark):
    """A table that grows with the rows, and levels that tell 130 from 200, of one binary magnitude."""
    n = np.arange(1, 1 << 20)
    got = ngram_join.level(n)
    assert (np.diff(got.astype(int)) >= 0).all() and (got >> ngram_join.FINE == np.frexp(n.astype(float))[1]).all() and ngram_join.level(np.zeros(1))[0] == 0
    assert ngram_join.level(np.array([130]))[0] < ngram_join.level(np.array([200]))[0]
    assert 1 << ngram_join.MOST_COUNTS > 1 << 22
    rows = [(i, f"every text has this w{i}") for i in range(300)]
    levels = ngram_join._profiles(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 0)[1]
    want = np.zeros(len(levels), dtype=np.int64)
    for _, t in rows:
        np.add.at(want, ngram_join.bucket(ngram_join.shingle_set(t, 3), len(levels)), 1)
    assert (levels == ngram_join.level(want)).all()


def test_words_of_latin_letters_go_to_the_model_at_once(monkeypatch):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    common._caches.clear()
    words = ["Straße", "über", "ÉCOLE", "łódź", "Ångström", "naïve", "unbelievable", "a", "ŒUVRE"]
    texts = [" ".join(words), "über, (école) naïve!\x0bA", " outer  space\t", *words]
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    odd = ["İI", "ſK", "Σς", "e\u0301a", "it's", "x1", "ǅ", "<|endoftext|>", ""]
    for t in (*odd, *(f"a{chr(c)}b" for c in range(256) if chr(c) not in "\x1c\x1d\x1e\x1f\x85\xa0")):
        assert packing.token_bytes([t], path) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()]
    assert packing.token_bytes(texts, path) == want
    common._caches.clear()
    monkeypatch.setattr(packing, "_encode_any", lambda words, kept: [b""] * len(words) if not any(words) else 1 / 0)
    assert packing.token_bytes([" ".join(words)], path) == want[:1]


def test_packing_puts_batches_together(monkeypatch):
    monkeypatch.setattr(packing, "TOGETHER", 200)
    batches = [pa.record_batch({"id": [2 * i, 2 * i + 1], "text": ["x" * 30, "y"]}) for i in range(9)]
    got = list(packing._gathered(iter(batches)))
    assert 1 < len(got) < 9 and pa.concat_tables(got) == pa.Table.from_batches(batches)
    assert list(packing._gathered(iter([]))) == []


def test_fetching_sets_takes_one_python_worker_a_task(spark):
    rows = [(i, prose(700 + i, 30)) for i in range(300)] + [(7, prose(707, 30)), (None, prose(707, 30)), (301, None)]
    name = lambda t: (ngram_join.xxhash.xxh3_128_intdigest(ngram_join.shingle_set(t, 3).tobytes(), 0) & (2**64 - 1)) - 2**63
    wanted = [(name(t), i) for i, t in rows[:300:20]]
    got = ngram_join._fetch(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(wanted, "set long, holder long"), 3, 0)
    assert len(re.findall("ArrowEvalPython|MapInArrow", got._jdf.queryExecution().executedPlan().toString())) == 1
    assert {(r["set"], bytes(r["columns"])) for r in got.collect()} == {(name(t), ngram_join.shingle_set(t, 3).tobytes()) for _, t in rows[:300:20]}


def test_packing_starts_no_other_kind_of_python_workers(spark, odd):
    for df in (odd, odd.limit(0)):
        got = packing.pack(df, queries.tokenizer_path())
        assert "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()  # rows of a list come through a Python worker
        assert got.count() == packing.cut(df, queries.tokenizer_path(), "text", "doc_id").count()
