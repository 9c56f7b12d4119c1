"""Quality classifier: document evidence combined with host- and path-level posteriors, by hierarchical empirical Bayes.

1. Two logistic models on a dozen numbers per document are fitted on a bounded sample of labelled rows
   (``max_labelled``, the rows whose id hashes lowest): one for quality, one for toxicity.  The toxic model's main input
   is a lexicon that the sample gives: words that are nearly absent from other texts and together cover the toxic ones.
2. Every document gets its probability of being good (of quality, not toxic).
3. Grouped sums of these give the rate of each host and of each path in it.  Rates shrink: a path's towards its host's,
   a host's towards the global one, by a prior strength estimated from how much rates differ (method of moments), so
   a site with few documents stays near the prior.  Paths are compared with others of their host, hosts with the whole.
4. A document's site is judged by the other documents there (its own evidence is taken out of the sums).  The site's log-odds, less the global ones, times ``site_weight``, are added to the document's own.

Only numbers and candidate words of the sample reach the driver, so their bound is the sample's; sites are aggregated and
joined.

Defined results: a null text is empty and judged by the same models; a null source is a site of its own; repeated rows
are scored each; of several label rows of one id the worse verdicts count, and of several documents of one labelled id the
smallest text is learned from; without labels, or with labels of one kind, the model in question has no say (probability 1 of quality,
about 6e-06 of toxicity) and documents are kept; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import cut, settle

_WORD = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"[^\w\s.,;:'\"()?-]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
N_DENSE = 9


def dense_features(text: str, words: list[str]) -> list[float]:
    """Scale-free numbers of a text; all 0 for an empty one."""
    if not text:
        return [0.0] * N_DENSE
    n, chars = max(1, len(words)), len(text)
    counts = Counter(words)
    raw = text.encode()
    return [
        math.log1p(len(words)),
        len(_UPPER.findall(text)) / chars,
        len(_ODD.findall(text)) / n,
        text.count("|") / n,
        text.count("!") / n,
        len(zlib.compress(raw, 1)) / len(raw),
        math.log1p(len(counts)) / math.log1p(n),
        max(counts.values(), default=0) / n,
        sum(map(len, words)) / n,
    ]


@dataclass(frozen=True)
class Logistic:
    """Weights of standardised inputs; ``weights`` is None where there was nothing to learn."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None

    def logit(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(x))
        return np.clip(self.weights[0] + ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights[1:], -12, 12)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> Logistic:
    """Newton's method with a ridge penalty."""
    if not len(y) or y.min() == y.max():
        return Logistic(np.zeros(0), np.ones(0), None)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([np.ones((len(x), 1)), ((x - mean) / scale).clip(-8, 8)])
    w, penalty = np.zeros(z.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(mean, scale, w)


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _inputs(texts: list[str | None], lexicon: frozenset[str]) -> np.ndarray:
    rows = np.zeros((len(texts), N_DENSE + 3))
    for k, text in enumerate(texts):
        words = _words(text or "")
        hits = sum(1 for w in words if w in lexicon)
        rows[k] = [*dense_features(text or "", words), float(hits > 0), math.log1p(hits), hits / max(1, len(words))]
    return rows


def cover(texts: list[list[str]], least: int = 3) -> list[str]:
    """Greedy set cover: again and again the word that most texts have of which no word is chosen yet, down to ``least``.

    Words that merely come along with a chosen one, as in copies of one text, add nothing and are left out.
    """
    gain, where = Counter(w for t in texts for w in t), {}
    for k, t in enumerate(texts):
        for w in t:
            where.setdefault(w, []).append(k)
    open_, chosen = set(range(len(texts))), []
    while gain:
        word = min(gain, key=lambda w: (-gain[w], w))
        if gain[word] < least:
            break
        chosen.append(word)
        for k in where[word]:
            if k in open_:
                open_.discard(k)
                gain.subtract(texts[k])
        del gain[word]
    return chosen


def learn_lexicon(known: DataFrame, least: int = 4, share: float = 0.8, often: float = 0.08) -> frozenset[str]:
    """Words that mark toxic texts, from distinct sample rows (text, toxic); languages each have their own.

    Candidates are words of at least ``least`` toxic texts that make up a ``share`` of those that have it, one more clean one
    added; of these a greedy cover of the toxic texts is taken, and besides it every word that is ``often`` in toxic texts.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sorted(set(_words(t or ""))) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.string())), batch.column(1)], names=["words", "toxic"])

    each = known.select("text", "toxic").mapInArrow(words, "words array<string>, toxic int")
    counts = each.select(F.explode("words").alias("word"), "toxic").groupBy("word").agg(F.sum("toxic").alias("hits"), F.count("*").alias("texts"))
    found = sorted(counts.where((F.col("hits") >= least) & (F.col("hits") >= share * (F.col("texts") + 1))).collect(), key=lambda r: (-r["hits"], r["word"]))
    candidates = frozenset(r["word"] for r in found)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(candidates.intersection(_words(t or ""))) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))], names=["words"])

    toxic = known.where("toxic = 1").select("text").mapInArrow(present, "words array<string>")
    texts = sorted(r["words"] for r in toxic.collect())
    common = [r["word"] for r in found if r["hits"] >= max(least + 2, often * len(texts))]
    return frozenset([*common, *cover(texts)])


def site(source: Column) -> tuple[Column, Column]:
    """Host and first path segment of ``host/path...`` or a URL; the path is empty where there is none."""
    bare = F.regexp_replace(F.coalesce(source, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.lower(F.regexp_extract(bare, r"^[^/?#]*", 0)), F.regexp_extract(bare, r"^[^/?#]*/([^/?#]*)", 1)


def _strength(groups: DataFrame, spread: float) -> float:
    """Prior strength by moments: how far the rates s/n of groups differ within their parents (of totals ``pn``, ``ps``) beyond what
    their sizes explain, the usual estimate of a one-way layout."""
    n, s, pn, ps = map(F.col, ("n", "s", "pn", "ps"))
    got = groups.agg(F.count("*").alias("k"), F.sum(n / pn).alias("parents"), F.sum(n * F.pow(s / n - ps / pn, 2)).alias("ss"), F.sum(n - n * n / pn).alias("free")).first()
    if not got["k"] or got["free"] < 1e-9:
        return 100.0
    between = (got["ss"] - spread * (got["k"] - got["parents"])) / got["free"] if spread else 0.0
    return float(min(1e6, max(1.0, spread / between - 1))) if between > 1e-9 else 1e6


def score(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, site_weight: float = 0.5, max_sites: int = 200_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, host, path, quality_probability, toxic_probability, site_rate, score, keep) of every row."""
    settle(docs.sparkSession)
    host, path = site(F.col(source_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), host.alias("host"), path.alias("path"))
    sample = (
        labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
        .where("id is not null and quality is not null and toxic is not null")
        .groupBy("id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    )
    # the sample is bounded by max_labelled, so it may be broadcast
    known = rows.select("id", "text").join(F.broadcast(sample), "id").groupBy("id", "quality", "toxic").agg(F.min("text").alias("text")).select("id", "text", "quality", "toxic")
    quality_model, toxic_model, lexicon = _train(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _inputs(batch.column(1).to_pylist(), lexicon)
            q = quality_model.logit(x[:, :N_DENSE])
            t = toxic_model.logit(x[:, N_DENSE:]) if toxic_model.weights is not None else np.full(len(x), -12.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(q), pa.array(t)], names=["id", "host", "path", "q", "t"])

    kind = rows.schema[0].dataType.simpleString()
    scored = cut(rows.mapInArrow(run, f"id {kind}, host string, path string, q double, t double"))
    sigmoid = lambda c: 1 / (1 + F.exp(-c))
    trained = quality_model.weights is not None
    likely = sigmoid(F.col("q")) if trained else F.lit(1.0)
    good = scored.withColumn("good", likely * (1 - sigmoid(F.col("t"))))
    paths = good.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("good").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = min(1 - 1e-6, max(1e-6, total["s"] / total["n"])) if total["n"] else 0.5
    # of each path its own sums and its host's; both strengths come from this table
    rates = cut(paths.join(hosts.withColumnsRenamed({"n": "host_n", "s": "host_s"}), "host").select("host", "path", "n", "s", "host_n", "host_s"))
    spread = rate * (1 - rate)
    a_path = _strength(rates.select("n", "s", F.col("host_n").alias("pn"), F.col("host_s").alias("ps")), spread)
    a_host = _strength(hosts.select("n", "s", F.lit(total["n"]).alias("pn"), F.lit(total["s"]).alias("ps")), spread)
    # a host may hold a third of all rows: they stay where they are, unless there are very many sites
    rates = F.broadcast(rates) if rates.count() <= max_sites else rates
    odds = lambda p: F.log(p / (1 - p))
    bounded = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("good")))
    # what the others on its host and path say of a document's site
    on_host = (F.col("host_s") - F.col("good") + a_host * rate) / (F.col("host_n") - 1 + a_host)
    on_path = (F.col("s") - F.col("good") + a_path * on_host) / (F.col("n") - 1 + a_path)
    inside = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("site_rate")))
    final = sigmoid(odds(bounded) + site_weight * (odds(inside) - math.log(rate / (1 - rate))))
    out = good.join(rates, ["host", "path"]).withColumn("site_rate", on_path).withColumn("score", final if trained else F.col("good"))
    return out.select(F.col("id").alias(id_col), "host", "path", likely.alias("quality_probability"), sigmoid(F.col("t")).alias("toxic_probability"), "site_rate", "score", (F.col("score") >= 0.5).alias("keep"))


def _train(known: DataFrame) -> tuple[Logistic, Logistic, frozenset[str]]:
    """Both models and the lexicon, from the labelled sample."""

    lexicon = learn_lexicon(known.select("text", "toxic").dropDuplicates(["text"]))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _inputs(batch.column(1).to_pylist(), lexicon)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(2), batch.column(3)], names=["x", "quality", "toxic"])

    got = known.mapInArrow(features, "x array<double>, quality int, toxic int").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, N_DENSE + 3)
    quality = fit(x[:, :N_DENSE], got["quality"].to_numpy(float))
    toxic = fit(x[:, N_DENSE:], got["toxic"].to_numpy(float))
    return quality, toxic, lexicon


def kept(docs: DataFrame, scores: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id was not rejected, all columns as they were; a null id is kept."""
    return docs.join(scores.where(~F.col("keep")).select(id_col).distinct(), id_col, "left_anti").select(*docs.columns)
