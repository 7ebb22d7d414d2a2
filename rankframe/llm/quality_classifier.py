"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic model gives each document's own evidence. Documents of one site share its quality:
the mean posterior of a host is shrunk toward the global mean, that of a path toward its host,
each by a prior whose strength the spread between sites decides. A document's final posterior
replaces the global prior in its evidence by its path's, without its own contribution, so that
a sparse site stays near the global prior and a document is not counted twice.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from rankframe.llm.common import columns, map_texts, save

#: Labelled documents the model is fitted on, at most; those with the least hash of their id.
TRAINING_ROWS = 20_000
#: Documents whose posterior is below this are rejected.
LEAST = 0.5
#: Share of the site's evidence that enters a document's log-odds.
SITE_WEIGHT = 0.5

FEATURES = (
    "log_words", "mean_word", "upper", "digit", "symbol", "pipe", "bang", "comma_stop", "high_bytes", "unique_words",
    "short_lines", "dup_lines", "upper_words", "symbol_words",
)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&<>@^~=_{}[]\\+")] = True


def features(text: str | None) -> list[float]:
    """Surface statistics of one text; an empty one has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars, lines = max(1, len(raw) - int(n[9:14].sum() + n[32])), [x for x in raw.split(b"\n") if x.strip()]
    letters = max(1, int(n[65:91].sum() + n[97:123].sum()))
    return [
        math.log(len(words)),
        chars / len(words) / 10,
        int(n[65:91].sum()) / letters,
        10 * int(n[48:58].sum()) / chars,
        10 * int(n[_SYMBOLS].sum()) / chars,
        10 * int(n[124]) / chars,
        10 * int(n[33]) / chars,
        10 * int(n[44] + n[46]) / chars,
        int(n[128:].sum()) / chars,
        len(set(words)) / len(words),
        sum(len(x) < 40 for x in lines) / len(lines),
        1 - len(set(lines)) / len(lines),
        sum(w.isupper() and len(w) > 1 for w in words) / len(words),
        sum(w[-1] in b"#*$%&|!" for w in words) / len(words),
    ]


@dataclass(frozen=True)
class Model:
    """Weights on standardised features, and the mean label they were fitted to."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float

    def logits(self, texts: list) -> list[float]:
        if not texts:
            return []
        x = (np.array([features(t) for t in texts]) - np.array(self.mean)) / np.array(self.scale)
        return (np.clip(x, -6, 6) @ np.array(self.weights) + self.bias).tolist()


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> Model:
    """Ridge logistic regression by Newton's method. Without labels the model accepts everything."""
    if len(y) == 0:
        return Model((0.0,) * len(FEATURES), (1.0,) * len(FEATURES), (0.0,) * len(FEATURES), 5.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.c_[np.clip((x - mean) / scale, -6, 6), np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penalty = ridge * len(y) * np.r_[np.ones(z.shape[1] - 1), 1e-3]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + penalty * w
        move = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), slope)
        w = w - move
        if np.abs(move).max() < 1e-8:
            break
    return Model(tuple(mean), tuple(scale), tuple(w[:-1]), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAINING_ROWS) -> Model:
    """Fit on labelled documents. Of repeated labels the least counts, and so it is of documents that repeat an id: one
    of them, with the least features.

    The sample is bounded by ``rows``, the labelled ids with the least hashes; labels that are null or of no document
    do not count. So what is broadcast and what reaches the driver has ``rows`` rows at most.
    """
    i, y = F.col(f"`{doc_id}`"), F.col(f"`{label}`")
    clean = labels.where(i.isNotNull() & y.isNotNull()).groupBy(i.alias("id")).agg(F.min(y).alias("y"))
    known = docs.where(i.isNotNull()).select(i.alias("id"))
    sample = clean.join(known, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(rows)
    src = docs.select(i.alias("id"), F.col(f"`{text}`").alias("text"))
    picked = src.join(F.broadcast(save(sample, "sample")), "id")  # rows bounds the broadcast
    made = map_texts(picked, ["id", "y"], "text", lambda ts: {"x": [features(t) for t in ts]}, "x array<double>")
    got = made.groupBy("id").agg(F.first("y").alias("y"), F.min("x").alias("x")).orderBy("id").toArrow()
    x = np.array(got["x"].to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return fit_logistic(x, np.array(got["y"].to_pylist(), dtype=float))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def _strength(table: DataFrame, mean: float) -> float:
    """Pseudo-count of the prior: from the variance between sites, by moments."""
    got = table.where("n > 0").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.lit(mean), 2)).alias("between"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("own"),
    ).first()
    if not got["n"] or got["k"] < 2:
        return 1e4
    within = max(1e-9, (got["q"] - got["own"]) / max(1.0, got["n"] - got["k"]))
    spread = (got["between"] - (got["k"] - 1) * within) / got["n"]
    return float(min(1e4, max(1.0, within / spread))) if spread > 0 else 1e4


@dataclass(frozen=True)
class Sites:
    """Sums per path, with those of the host: (host, path, n, s, hn, hs); the global mean and prior strengths."""

    table: DataFrame
    mean: float
    host_prior: float
    path_prior: float


def site_posteriors(scored: DataFrame) -> Sites:
    """Group scored (host, path, p) into sums per path and host; a null host or path is a site."""
    per = save(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "paths")
    hosts = save(per.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")), "hosts")
    total = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    mean = min(1 - 1e-4, max(1e-4, 0.5 if total is None else float(total)))
    h = hosts.select(F.col("host").alias("hh"), F.col("n").alias("hn"), F.col("s").alias("hs"))
    table = per.join(h, per["host"].eqNullSafe(h["hh"])).select(
        F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("n").alias("__n"), F.col("s").alias("__s"), F.col("hn").alias("__hn"), F.col("hs").alias("__hs")
    )
    return Sites(save(table, "sites"), mean, _strength(hosts, mean), _strength(per, mean))


def score(docs: DataFrame, model: Model, host: str, path: tuple[str, ...], text: str, **carry: Column) -> DataFrame:
    """carry, host, path, own log-odds and p of each document."""
    sites = {"host": F.col(f"`{host}`").cast("string"), "path": F.to_json(F.struct(*[F.col(f"`{c}`") for c in path]))}
    src = docs.select(*[c.alias(n) for n, c in (carry | sites).items()], F.col(f"`{text}`").alias("own_text"))
    made = map_texts(src, [*carry, *sites], "own_text", lambda ts: {"logit": model.logits(ts)}, "logit double")
    return made.withColumn("p", 1 / (1 + F.exp(-F.col("logit"))))


def posterior(scored: DataFrame, sites: Sites) -> DataFrame:
    """scored with site and posterior: own evidence, and the path's prior without the document's own part.

    The site table was written first, so Spark knows its size and broadcasts it only if small;
    else the join shuffles, and adaptive execution splits a hot site.
    """
    m, hp, pp = F.lit(sites.mean), F.lit(sites.host_prior), F.lit(sites.path_prior)
    t = sites.table
    mu_host = (hp * m + F.col("__hs") - F.col("p")) / (hp + F.col("__hn") - 1)
    mu_path = (pp * mu_host + F.col("__s") - F.col("p")) / (pp + F.col("__n") - 1)
    lo = F.col("logit") + F.lit(SITE_WEIGHT) * (_logit(mu_path) - _logit(m))
    joined = scored.join(t, scored["host"].eqNullSafe(t["__host"]) & scored["path"].eqNullSafe(t["__path"]))
    return joined.withColumn("site", mu_path).withColumn("posterior", 1 / (1 + F.exp(-lo)))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: tuple[str, ...] = ("source", "lang"), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, own, site, posterior, kept for each row of docs.

    own is the model's probability, site the prior of the document's path, kept whether
    posterior >= LEAST. Null and empty texts are scored as texts of no words; a null host or path is a site;
    repeated rows count and come out repeatedly; an empty table gives no rows, and without labels all is
    kept; other columns are ignored, whatever their names.
    """
    model = train(docs, labels, doc_id, text)
    scored = save(score(docs, model, host, path, text, id=F.col(f"`{doc_id}`")), "scored")
    done = posterior(scored, site_posteriors(scored))
    return done.select(F.col("id").alias(doc_id), F.col("p").alias("own"), "site", "posterior", (F.col("posterior") >= LEAST).alias("kept"))


def keep_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: tuple[str, ...] = ("source", "lang"), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that classify() keeps, with all their columns; texts are not shuffled unless the sites are many.

    Nulls, empty texts, repeats and empty tables count as classify() says; a kept row comes out as often as it occurs.
    """
    model = train(docs, labels, doc_id, text)
    sites = site_posteriors(score(docs, model, host, path, text))
    done = posterior(score(docs, model, host, path, text, row=F.struct(*columns(docs))), sites)
    return done.where(F.col("posterior") >= LEAST).select("row.*")
