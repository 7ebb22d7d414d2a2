"""What the operators promise on hard inputs: depth, length, breakage, ties, clashing names; each against an independent form."""

import gzip
import hashlib
import html
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rankframe.llm import common, embedding_dedup, html_extract, mixing, ngram_join, packing, quality_classifier, quality_rules, queries, secret_scan, url_filter, warc

SF = "/root/testdata/sf0.001"


def text(v) -> str:
    return "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(set(queries.oracle_sql()) - {"pipeline"}))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df().astype(object)
    got = queries.queries()[name](spark, SF).toPandas().astype(object)
    assert sorted(got.columns) == sorted(want.columns)
    lines = lambda d: sorted("|".join(map(text, r)) for r in d[sorted(d.columns)].where(d[sorted(d.columns)].notna(), None).itertuples(index=False, name=None))
    assert lines(got) == lines(want)


# ---- op1


def test_html_at_any_depth():
    show = html_extract.render
    assert show("<div>" * 200 + "<div hidden>leak</div>") == ""
    assert show("<div>" * 30000 + "<p style='display:none'>leak</p>seen") == "seen"
    assert show("<ul><li>" * 400 + "<table><tr><td>a<td>b</table>").strip().endswith("a  b")
    assert "x" in show("<table><tr><td>" * 500 + "x")
    assert len(show("<blockquote>" * 5000 + "a<br>" * 50)) < 50 * 100


def test_html_table_sizes():
    show = html_extract.render
    wide = "<table><tr><td>" + "w" * 200_000 + "<td>x" + "".join("<tr><td>a<td>b" for _ in range(300)) + "</table>"
    assert 200_000 < len(show(wide)) < 203_000
    assert show("<table><tr><td colspan=99999999999999999999>a<td>b<tr><td>c<td>d</table>").split() == ["a", "b", "c", "d"]
    assert show("<table><tr><td rowspan=2 colspan=2>a<td>b<tr><td>c</table>").splitlines() == ["a    b", "     c"]


def brute_words(node, hidden: bool) -> list[str]:
    if isinstance(node, str):
        return [] if hidden else node.split()
    _, gone, children = node
    return [w for c in children for w in brute_words(c, hidden or gone)]


@pytest.mark.parametrize("seed", range(30))
def test_html_words_of_random_trees(seed):
    r = random.Random(seed)

    def tree(depth):
        tag = r.choice(["div", "span", "b", "section", "ul", "em", "article", "main"])
        children = [tree(depth - 1) if depth and r.random() < 0.6 else "".join(r.choice("abc<&> ") for _ in range(6)) for _ in range(r.randrange(4))]
        return tag, r.random() < 0.2, children

    def write(node):
        if isinstance(node, str):
            return f" {html.escape(node)} "
        tag, gone, children = node
        mark = r.choice([" hidden", " style='display: none'", " class='gone x'"]) if gone else ""
        return f"<{tag}{mark}>{''.join(map(write, children))}</{tag}>"

    made = tree(5)
    shown = html_extract.render("<style>.gone { display: none }</style>" + write(made))
    assert shown.split() == brute_words(made, False)


def test_html_tables_of_rows(spark):
    rows = [(1, "u", "<p>a", "x", 5), (2, None, None, "y", 6), (2, "v", "", None, None), (None, "w", "<p>a", "z", 1), (1, "u", "<p>a", "x", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html_extract.extract_html(df).collect()
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"], r["n_lines"]) for r in got) == sorted([("1", "a", 1, 1)] * 2 + [("2", "", 0, 0)] * 2 + [("None", "a", 1, 1)])
    assert html_extract.extract_html(df.limit(0)).count() == 0


# ---- op2


def test_column_names_of_any_kind(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, t, {"k": i}, 1.5, "s", "en") for i, t in enumerate([base, base, base + " x", "other words here", None, ""])] + [(0, base, {"k": 9}, 2.5, "s", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.map` map<string,int>, __id double, source string, lang string")
    got = ngram_join.keep_one(df)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == [0, 3, 4, 5]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    kept = quality_classifier.keep_quality(df, labels)
    assert kept.columns == df.columns and kept.count() == 7
    assert mixing.mix_documents(df).columns == df.columns
    clean = secret_scan.redact_secrets(df)
    assert clean.columns == df.columns and clean.count() == 7
    assert secret_scan.redact_secrets(df.limit(0)).count() == mixing.mix_documents(df.limit(0)).count() == ngram_join.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize(("num", "den"), [(9, 10), (8, 10), (1, 2)])
def test_rare_columns_of_linked_sets_meet(num, den):
    """Whatever the counts say, two sets at the threshold share a column among their first ones."""
    r = np.random.default_rng(num)
    for _ in range(300):
        n = int(r.integers(1, 200))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < r.uniform(0.5, 1)], r.integers(0, 2**63, int(r.integers(0, 20))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both and den * both >= num * (len(a) + len(b) - both):
            magnitudes = r.integers(0, 30, 1 << 12).astype(np.uint8)
            x, y = (ngram_join.rarest(s, magnitudes, num, den)[0] for s in (a, b))
            assert len(np.intersect1d(x, y))
            bands = ngram_join.Bands(num, den)
            assert abs(bands.of(len(a)) - bands.of(len(b))) <= 1


def test_columns_dealt_by_salt(spark, monkeypatch):
    """Columns that count as hot are dealt by salt, and bring the same sets together."""
    base, r = [f"w{i}" for i in range(40)], random.Random(1)
    rows = [(i, " ".join(base[:20] + [f"x{r.randrange(6)}" for _ in range(2)] + base[20:])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {x["doc_id"]: x["component_id"] for x in ngram_join.jaccard_components(df, words=1, num=8, den=10).collect()}
    monkeypatch.setattr(ngram_join, "HOT", 0)
    monkeypatch.setattr(np, "median", lambda *a, **k: -3)
    assert {x["doc_id"]: x["component_id"] for x in ngram_join.jaccard_components(df, words=1, num=8, den=10).collect()} == want


# ---- op3


def test_classifier_posteriors(spark):
    """The posteriors once more, in plain loops."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(docs.limit(7)).union(spark.createDataFrame([(None, None, None, None, None), (-5, "", "en", "lonely", 0)], docs.schema))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_classifier.classify(docs, labels).collect()
    model = quality_classifier.train(docs, labels)
    rows = [(r["doc_id"], r["source"], r["lang"], model.logits([r["text"]])[0]) for r in docs.collect()]
    p = [1 / (1 + math.exp(-x[3])) for x in rows]
    hosts, paths = defaultdict(list), defaultdict(list)
    for x, q in zip(rows, p, strict=True):
        hosts[x[1]].append(q)
        paths[x[1], x[2]].append(q)
    mean = sum(p) / len(p)

    def strength(groups):
        n, k = sum(map(len, groups)), len(groups)
        within = sum(sum(v * v for v in g) - sum(g) ** 2 / len(g) for g in groups) / max(1, n - k)
        within = max(1e-9, within)
        spread = (sum(len(g) * (sum(g) / len(g) - mean) ** 2 for g in groups) - (k - 1) * within) / n
        return min(1e4, max(1.0, within / spread)) if spread > 0 else 1e4

    hp, pp = strength(list(hosts.values())), strength(list(paths.values()))
    logit = lambda v: math.log(min(max(v, 1e-4), 1 - 1e-4) / (1 - min(max(v, 1e-4), 1 - 1e-4)))
    want = []
    for (i, h, lang, own), q in zip(rows, p, strict=True):
        mu = (hp * mean + sum(hosts[h]) - q) / (hp + len(hosts[h]) - 1)
        mu = (pp * mu + sum(paths[h, lang]) - q) / (pp + len(paths[h, lang]) - 1)
        lo = own + 0.5 * (logit(mu) - logit(mean))
        want.append((str(i), round(q, 6), round(mu, 6), round(1 / (1 + math.exp(-lo)), 6)))
    assert sorted((str(r["doc_id"]), round(r["own"], 6), round(r["site"], 6), round(r["posterior"], 6)) for r in got) == sorted(want)


def test_classifier_sample(spark):
    """Labels of no document do not use up the sample, repeated documents count once, and reruns agree."""
    good, bad = "A calm sentence, with words. " * 8, "#### $$$$ 1234 %%%% | " * 8
    docs = spark.createDataFrame([(i, good if i % 2 else bad, "s", "en") for i in range(40)] + [(3, bad, "s", "en")] * 30, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(i, 0) for i in range(1000, 4000)] + [(None, 1), (7, None)], "doc_id long, quality int")
    a, b = (quality_classifier.train(d, labels, rows=40) for d in (docs, docs.repartition(7)))
    assert a == b and a.logits([good])[0] > 2 > -2 > a.logits([bad])[0]


# ---- op4


def test_embeddings_at_the_threshold(spark):
    rows = [(0, [1.0, 0.0, 0.0, 0.0]), (1, [9.0, 3.0, 3.0, 1.0]), (2, [9.0, -3.0, 3.0, 1.0]), (3, [8.999999999, 3.0, 3.0, 1.0]), (4, [1e200, 0.0, 0.0, 1e190]), (5, [1e-200, 0.0, 0.0, 0.0])]
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = Counter()
    for (i, a), (j, b) in itertools.permutations(rows, 2):
        x, y = (np.array(v) * (1e-200 if max(v) > 1e100 else 1e200 if max(v) < 1e-100 else 1.0) for v in (a, b))
        want[i] += math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y)) >= 0.9
    assert got == {i: want[i] for i, _ in rows} and got[0] == 4  # both at 0.9 exactly, and both of its direction


def test_tiles_agree_near_the_threshold():
    r = np.random.default_rng(0)
    raw = r.integers(-4, 5, (200, 6)).astype(float) + 0.5
    x = embedding_dedup.unit_rows(raw)
    at = np.arange(200)
    whole = embedding_dedup.linked(raw, x, at, at, 0.9)
    for i in range(0, 200, 23):
        some = at[i : i + 23]
        assert (embedding_dedup.linked(raw, x, some, at, 0.9) == whole[some]).all()
        assert (embedding_dedup.linked(raw, x, at, some, 0.9) == whole[:, some]).all()


def test_embedding_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df).collect()}
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect() if r["embedding"] and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and any(r["embedding"])]
    x = embedding_dedup.unit_rows([v for _, v in rows])
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    found = np.array([got[i] for i, _ in rows])
    assert (found <= want).all() and found.sum() >= 0.995 * want.sum()


# ---- op5


def brute_spans(t: str) -> str:
    """The base spans by hand: characters walked one by one."""
    spans, n = [], len(t)
    word = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    at = 0
    while at < n:
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if "".join(c.lower() if c.isascii() else c for c in t[at : at + len(name)]) != name:
                continue
            i = at + len(name)
            i += i < n and t[i] in "\"'"
            while i < n and t[i] == " ":
                i += 1
            if i < n and t[i] in ":=":
                i += 1
                while i < n and t[i] == " ":
                    i += 1
                i += i < n and t[i] in "\"'"
                end = i
                while end < n and t[end] in word:
                    end += 1
                if end > i:
                    if end - i >= 6:
                        spans.append((at, 0, end, "assign"))
                    at = end - 1
                    break
        at += 1
    for kind, rank, start, chars, least in (("access", 1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), ("hex", 2, "", "0123456789abcdef", 24)):
        at = 0
        while at < n:
            if t.startswith(start, at) and (start or t[at] in chars):
                end = at + len(start)
                while end < n and t[end] in chars:
                    end += 1
                if end > at + len(start) or not start:
                    if end - at >= least:
                        spans.append((at, rank, end, kind))
                    at = end
                    continue
            at += 1
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


def test_base_spans_by_hand(spark):
    r = random.Random(5)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", ":", "=", " ", "  ", '"', "'", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "xY9", "é", "\n", "abc.def", "=", "-", ": "]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(400)] + [x["text"] for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for g in got:
        spans = brute_spans(texts[g["doc_id"]] or "")
        assert g["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert [g["n_assign"], g["n_access"], g["n_hex"]] == [spans.count(k) for k in ("assign", "access", "hex")]
    assert secret_scan.secret_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_cost(value: str) -> float:
    """The cheapest cut by trying all; segment costs written anew."""
    ranks, _ = secret_scan.dictionary(None)
    leet = str.maketrans("4@3106$57", "aaeiogsst")
    pool = max(10, 10 * any(c.isdigit() for c in value) + 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 33 * any(not c.isalnum() for c in value))
    near = lambda a, b: any(abs(row.index(a) - row.index(b)) <= 1 for row in ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./") if a in row and b in row)

    def single(a, b):
        s, costs = value[a:b], [(b - a) * math.log10(pool)]
        low = s.lower()
        if len(s) >= 3 and (rank := ranks.get(low) or 4 * ranks.get(low.translate(leet), 0)):
            costs.append(math.log10(rank) + (0 if s == low else math.log10(2) if s[1:] == low[1:] else len(s) * math.log10(2)))
        if (m := secret_scan.DATE.match(value, a)) and m.end() == b:
            costs.append(math.log10(365 * 120 if len(s) > 4 else 120))
        if len(s) >= 3 and len(set(s)) == 1 and (b == len(value) or value[b] != s[0]):
            costs.append(math.log10(pool) + math.log10(len(s)))
        if len(s) >= 4 and all(near(x, y) for x, y in zip(low, low[1:], strict=False)) and (b == len(value) or not near(low[-1], value[b].lower())):
            turns = 1 + sum(low[i] == low[i - 2] for i in range(2, len(s)))
            costs.append(math.log10(47 * len(s)) + turns * math.log10(3))
        for unit in range(2, min(a, len(s)) + 1):  # one more unit or several, with or without the part of one at the end
            if all(value[i] == value[i - unit] for i in range(a, b)):
                first, run = a, b
                while first > unit and value[first - 1] == value[first - 1 - unit]:
                    first -= 1
                while run < len(value) and value[run] == value[run - unit]:
                    run += 1
                if a < first + unit and (b == run or (b - a) == (run - a) // unit * unit):
                    costs.append(math.log10(unit + b - a))
        return min(costs)

    best = [0.0] + [math.inf] * len(value)
    for b in range(1, len(value) + 1):
        best[b] = min(best[a] + single(a, b) + math.log10(2) for a in range(b))
    return best[-1]


@pytest.mark.parametrize("seed", range(25))
def test_guess_cost_by_trying_all(seed):
    r = random.Random(seed)
    bits = ["password", "monkey", "Dragon", "p4ssw0rd", "1999", "2019-12-31", "qwerty", "asdf", "aaaa", "111", "xyxyxy", "zK9#v", "Q!", "abcabc", "7"]
    value = "".join(r.choice(bits) for _ in range(r.randrange(1, 4)))
    cost, parts = secret_scan.guess_cost(value)
    assert abs(cost - brute_cost(value)) < 1e-9, (value, parts)
    assert [p[1] for p in parts] == [0, *[p[2] for p in parts[:-1]]] and parts[-1][2] == len(value)


@pytest.mark.parametrize("sentence", [
    "The password is required for entry.", "The secret is simple.", "A token is expired.", "auth: kerberos", "The password is perspicacity.", "The token is https://example.com/a9X#b2Q",
])
def test_prose_stays(sentence):
    assert secret_scan.redact(sentence, secret_scan.vocabulary_path()) == sentence


def test_costs_are_reported(spark):
    got = secret_scan.secret_scan(spark.createDataFrame([(1, "token: hunter22 pwd: zK9#vQ2!mT7")], "doc_id long, text string"), vocabulary=secret_scan.vocabulary_path()).first()
    assert [c.split(":")[:2] for c in got["costs"].split(",")] == [["7", "15"], ["21", "32"]]
    assert got["max_log10_guesses"] > 15 and got["n_guess"] == 1


# ---- op6


def histograms():
    r = np.random.default_rng(0)
    every = np.r_[0, r.integers(1, 10001, 2048)]
    few = np.r_[0, r.integers(1, 51, 2048)]
    docs = np.bincount(np.minimum(2048, r.exponential(500, 3000).astype(int) + 1), minlength=2049)
    return {"all": every, "few": few, "docs": docs, "many docs": docs * 1000, "one": np.bincount([700], minlength=2049), "same": np.bincount([9] * 5000, minlength=2049)}


@pytest.mark.parametrize("name", list(histograms()))
def test_plan_fills_like_best_fit(name):
    counts = histograms()[name]
    used, windows = np.zeros(2049, dtype=int), 0
    for lengths, k in packing.plan(counts):
        assert sum(lengths) <= 2048
        windows += k
        for v in lengths:
            used[v] += k
    assert (used == counts).all()
    best, left = 0, counts.copy()  # best fit decreasing, a window at a time, all alike at once
    while left.any():
        room, pieces = 2048, Counter()
        for v in np.flatnonzero(left)[::-1].tolist():
            if (k := min(int(left[v]), room // v)) > 0:
                pieces[v], room = k, room - k * v
        n = min(int(left[v]) // k for v, k in pieces.items())
        for v, k in pieces.items():
            left[v] -= n * k
        best += n
    tokens = int((counts * np.arange(2049)).sum())
    assert tokens / windows >= 0.99 * tokens / best


@pytest.mark.parametrize("name", ["all", "few", "docs", "many docs"])
def test_fit_places_most_pieces(name):
    counts = histograms()[name].copy()
    counts[2048] = 0
    columns = packing.combinations(counts, 2048)
    x = packing.nnls(columns, counts, 2048)
    got = np.zeros(2049)
    for used, n in zip(columns, x, strict=True):
        for v, k in used:
            got[v] += k * n
    assert min(x) >= 0 and np.abs(got - counts).sum() <= 0.05 * counts.sum()


# ---- op7


def test_choose_with_long_documents():
    for lengths, counts, budget, want in (([70_000, 90_001], [5, 5], 300_000, 280_000), ([30_000, 40_001, 55_000], [9, 9, 9], 250_000, 250_000), ([3_000_000], [7], 9_500_000, 9_000_000)):
        a, n = np.array(lengths), np.array(counts)
        take = mixing.choose(a, n, budget)
        assert (take <= n).all() and int((take * a).sum()) == want


@pytest.mark.parametrize("seed", range(4))
def test_choose_large_budgets(seed):
    r = np.random.default_rng(seed)
    lengths = np.unique(r.integers(1, 20_000, 400))
    counts = r.integers(1, 200, len(lengths))
    budget = int((lengths * counts).sum() * r.uniform(0.1, 0.9))
    take = mixing.choose(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all() and int((take * lengths).sum()) == budget


def test_mixed_texts_are_those_of_the_mix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.union(docs.where("doc_id % 3 = 0")).union(docs.limit(20))
    words = mixing.word_count("text")
    want = {(r["source"], r["size"]): r["t"] for r in mixing.mix(docs).groupBy("source", "size").agg(F.sum("taken").alias("t")).where("t > 0").collect()}
    got = {(r["source"], r["size"]): r["t"] for r in mixing.mix_documents(docs).groupBy("source", words.alias("size")).agg(F.sum(words).alias("t")).collect()}
    assert got == want


# ---- op8


def test_url_entries_of_any_depth(spark):
    path = "/".join(f"s{i}" for i in range(20))
    changes = spark.createDataFrame([("a", f"x.org/{path}", "add"), ("b", "x.org/s0/s1", "add"), ("c", "y.org", "add")], "list string, entry string, action string").withColumn("day", F.lit("2024-01-01").cast("date"))
    rows = [(1, f"http://x.org/{path}"), (2, f"http://x.org/{path}/more/of/it?q"), (3, "http://x.org/s0"), (None, f"http://x.org/{path}"), (None, f"http://x.org/{path}")]
    caps = spark.createDataFrame([(*r, 7, "k") for r in rows], "page_id long, url string, n_lists int, list string").withColumn("fetched", F.lit("2024-05-05").cast("date"))
    got = sorted((str(r["page_id"]), r["n_lists"], r["entry"]) for r in url_filter.filter_urls(caps, changes).collect())
    assert got == sorted([("1", 2, f"x.org/{path}"), ("2", 2, f"x.org/{path}"), ("3", 0, None), ("None", 2, f"x.org/{path}"), ("None", 2, f"x.org/{path}")])
    assert url_filter.filter_urls(caps.limit(0), changes).count() == 0


# ---- op9


def archive(n: int = 6) -> list[bytes]:
    out = []
    for i in range(n):
        body = (b"x%d\r\n\r\n" % i) * 500
        out += [p + warc.END for p in warc.records(i, f"http://u/{i}", body, hashlib.sha256(body).hexdigest(), None, None, "2024-01-01T00:00:00Z", f"n{i}", 800)]
    return out


def test_archives_of_other_writers(spark, tmp_path):
    """A gzip member per record, files of any name, in folders, and records without this writer's fields."""
    parts = archive()
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    plain = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://z\r\nWARC-Record-ID: <urn:y>\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Length: 24\r\n\r\nHTTP/1.1 200 OK\r\n\r\npaged\r\n\r\n"
    (tmp_path / "two.warc").write_bytes(info + plain)
    (tmp_path / "empty.warc").write_bytes(b"")
    got = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert len(got) == 8 and all(r["complete"] for r in got)
    mine = {r["page_id"]: bytes(r["payload"]) for r in got if r["page_id"] is not None}
    assert mine == {i: (b"x%d\r\n\r\n" % i) * 500 for i in range(6)}
    assert {r["record"]: bytes(r["payload"]) for r in got if r["page_id"] is None} == {"<urn:x>": b"hello", "<urn:y>": b"paged"}


def test_broken_archives_fail_no_others(spark, tmp_path):
    parts = archive()
    plain, members = b"".join(parts), b"".join(map(gzip.compress, parts))
    flipped = bytearray(members)
    flipped[len(members) // 2] ^= 0xFF
    cases = {
        "cut.warc": plain[:-100], "cut.warc.gz": members[:-50], "flip.warc.gz": bytes(flipped), "length.warc": plain.replace(b"Content-Length: 800", b"Content-Length: 900", 1),
        "number.warc": plain.replace(b"WARC-Segment-Number: 2", b"WARC-Segment-Number: two", 1), "id.warc": plain.replace(b"WARC-Record-ID", b"WARC-Record-No", 1), "junk.warc": b"junk" * 50,
    }
    for name, raw in cases.items():
        folder = tmp_path / name.replace(".", "_")
        folder.mkdir()
        (folder / name).write_bytes(raw)
        got = warc.read_archives(spark, f"file://{folder}").collect()
        whole = {r["page_id"] for r in got if r["complete"]}
        assert any(not r["complete"] for r in got), name
        assert all(r["payload"] is None for r in got if not r["complete"])
        assert len(whole) >= (0 if name == "junk.warc" else 5), (name, whole)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(empty, f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none", pattern="part-*").count() == 0


# ---- op10, and all


def test_rules_beside_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, True, "k"), (2, "a b " * 40, False, "l"), (2, "a b " * 40, False, "l")], "doc_id long, text string, kept boolean, n_words string")
    got = sorted((r["doc_id"], r["n_words"], r["kept"]) for r in quality_rules.quality_rules(df).collect())
    assert got == [(1, 0, False), (2, 80, False), (2, 80, False)]
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


def test_batch_bound_is_one(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for have, want in (("10000", "400"), ("0", "400"), ("7", "7")):
        spark.conf.set(key, have)
        common.bounded_batches(spark)
        assert spark.conf.get(key) == want
    spark.conf.set(key, before)


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empties, repeats and an empty table go through all stages."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None, None, None, None), (None, "two words", "en", None, 9), (5, "", "en", "s", 0), (5, "", "en", "s", 0), (6, "pwd: zK9#vQ2!mT7 " + "calm words, and more. " * 30, "en", "s", 1)]
    odd = spark.createDataFrame(odd, docs.schema)
    for i, table in enumerate((odd, odd.union(docs.limit(60)), docs.limit(0))):
        at = str(tmp_path / str(i))
        table.write.parquet(f"{at}/documents.parquet")
        spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{at}/labels.parquet")
        got = p.run(spark, at)
        pieces = got.collect()
        assert (len(pieces) == 0) == (i == 2)
        spans = defaultdict(list)
        for r in pieces:
            spans[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in spans.values():
            ends = list(itertools.accumulate(n for _, n in sorted(parts)))
            assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048


def brute_pipeline(spark, p):
    """The stages that have an independent form, on what their predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in quality_classifier.classify(docs, labels).where("kept").collect()}
    first = p.quality_stage(spark, docs, SF)
    return docs, kept, first


def test_pipeline_stages_by_brute_force(spark):
    import corpus_pipeline as p

    docs, kept, first = brute_pipeline(spark, p)
    rows = {r["doc_id"]: r["text"] for r in first.collect()}
    assert set(rows) == kept
    sets = {}
    for i, t in rows.items():
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    second = p.near_duplicate_stage(spark, first, SF)
    assert {r["doc_id"] for r in second.collect()} == {i for i in sets if find(i) == i}
    third = p.secret_stage(spark, second, SF)
    vocabulary = secret_scan.vocabulary_path()
    assert {r["doc_id"]: r["text"] for r in third.collect()} == {r["doc_id"]: secret_scan.redact(r["text"], vocabulary) for r in second.collect()}
    assert all(r["n_chars"] == len(r["text"] or "") for r in third.collect())
    fourth = p.mixing_stage(spark, third, SF)
    took = {(r["source"], r["size"]): r["t"] for r in mixing.mix(third).groupBy("source", "size").agg(F.sum("taken").alias("t")).where("t > 0").collect()}
    size = mixing.word_count("text")
    assert {(r["source"], r["size"]): r["t"] for r in fourth.groupBy("source", size.alias("size")).agg(F.sum(size).alias("t")).collect()} == took
    copies = Counter(r["doc_id"] for r in fourth.collect())
    tokens = Counter()
    for r in p.packing_stage(spark, fourth, SF).collect():
        tokens[r["doc_id"]] += r["length"]
        assert r["length"] <= 2048
    ids = {r["doc_id"]: len(packing.token_bytes([r["text"]], queries.tokenizer_path())[0]) // 4 + 1 for r in fourth.collect()}
    assert tokens == {i: copies[i] * n for i, n in ids.items()}


@pytest.mark.parametrize("seed", range(4))
def test_words_with_punctuation_are_the_tokenizers(seed):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    r = random.Random(seed)
    bits = ["word", "É", "ß", "Σ", "ΑΣ", "9", "½", "…", "'s", "'", "***", ",", ".", "#$%", "!?", "|", "||", "é", "é", "中", "İ", "ﬁ", "­", "-", "_", "<|endoftext|>", "\x01", "\U0001f600", "…,"]
    texts = [" ".join("".join(r.choice(bits) for _ in range(r.randrange(1, 5))) for _ in range(40)) for _ in range(60)]
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert packing.token_bytes(texts, path) == want
    assert packing.token_bytes([t.encode() for t in texts], path, cache_words=50) == want
