"""Language identification by the nearest of several centroids per language.

A text becomes lower-case letters with one blank for each run of anything else, and its n-grams of ``orders`` characters are
counted in ``buckets`` hashed places.  A vector has ``(1 + ln count) * idf`` in each place, normalised; the distance of two
vectors is 1 less their cosine.

1. Document frequencies come from all learning rows, added up inside tasks: a row of ``buckets`` numbers for each task.
2. Centroids come from at most about ``per_language`` learning rows of each language (a documented bound of the fit, chosen by
   hash) by spherical k-means, all languages as groups of their own; ``clusters`` centroids each.
3. A language's rejection distance is what ``reach`` of its sample lies within, and a margin more.  A text that is farther
   from its nearest centroid than that centroid's language allows is marked ``rejected``; it keeps the nearest language as
   its label, for callers who need one.

Defined results: a null text and one without a letter are ``und`` with score 0, never learned from; without learning rows every
text is ``und``; a null language is not learned; a text of any length is read whole, in pieces; ties go to the language that
sorts first; repeated rows count each; only the id, text and language columns are read, the latter only of learning rows;
an empty table gives an empty result.  The score is ``1 / (1 + exp(-sharpness * (own - other)))`` of the nearest centroid's cosine
and that of the best other language (0 if there is none), so between 0 and 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import settle, stored

_LETTER: list[np.ndarray] = []
_MUL = np.uint32(0x01000193)
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Whether each code point is a letter (general categories L*)."""
    if not _LETTER:
        import unicodedata

        _LETTER.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


class Grams:
    """Counts of hashed character n-grams."""

    def __init__(self, orders: tuple[int, ...] = (1, 2, 3, 4), buckets: int = 1 << 14):
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self.orders, self.buckets = orders, buckets
        self.shift = np.uint32(32 - (buckets.bit_length() - 1))

    def counts(self, text: str | None, piece: int = 1 << 18) -> np.ndarray | None:
        """Of one text, or None if it has no letter; read in pieces that overlap by what an n-gram needs."""
        if not text:
            return None
        out, tail, seen = np.zeros(self.buckets, np.int64), np.full(1, 32, np.uint32), False
        for at in range(0, len(text), piece):
            points = np.frombuffer(text[at : at + piece].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            letter = _letters()[points]
            seen = seen or bool(letter.any())
            points = np.where(letter, points, np.uint32(32))
            # one blank for a run, over the border between pieces as well
            points = points[letter | np.append(tail[-1] != 32, letter[:-1])]
            if at + piece >= len(text) and (points[-1] if len(points) else tail[-1]) != 32:
                points = np.append(points, np.uint32(32))
            line = np.concatenate([tail, points])
            h = np.zeros(len(line), np.uint32)
            for n in range(1, max(self.orders) + 1):
                # h[i] is the hash of the n characters that end at i
                h = (h[:-1] if n > 1 else h) * _MUL + line[n - 1 :] * np.uint32(0x9E3779B1)
                if n in self.orders:
                    fresh = h[max(0, len(tail) - n + 1) :]  # those that end in this piece
                    mixed = (fresh ^ (fresh >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
                    out += np.bincount(mixed >> self.shift, minlength=self.buckets)
            tail = line[-max(self.orders) :]
        return out if seen else None


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The normalised TF-IDF vector."""
    v = np.log1p(np.maximum(counts, 1) - 1) + 1
    v = np.where(counts > 0, v * idf, 0.0)
    size = np.sqrt((v**2).sum())
    return v / size if size else v


def cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far seeds; deterministic.  Empty clusters vanish."""
    chosen = [int((vectors @ vectors.mean(0)).argmax())]
    near = vectors @ vectors[chosen[0]]
    while len(chosen) < min(k, len(vectors)) and near.min() < 1 - 1e-9:
        # a seed in the middle of what is far, not the farthest outlier
        chosen.append(int(np.argsort(near, kind="stable")[len(near) // (2 * k)]))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    centers = vectors[chosen]
    for _ in range(rounds):
        which = (vectors @ centers.T).argmax(1)
        new = np.stack([vectors[which == c].sum(0) for c in range(len(centers)) if (which == c).any()])
        new /= np.maximum(np.sqrt((new**2).sum(1, keepdims=True)), 1e-300)
        if new.shape == centers.shape and np.allclose(new, centers):
            break
        centers = new
    return centers


class Model:
    """Centroids with their languages, and the distance within which a language is believed."""

    def __init__(self, grams: Grams, idf: np.ndarray, languages: list[str], owner: np.ndarray, centers: np.ndarray, limit: np.ndarray, sharpness: float = 30.0):
        self.grams, self.idf, self.languages, self.owner, self.limit, self.sharpness = grams, idf, languages, owner, limit, sharpness
        self.centers = np.ascontiguousarray(centers.T)

    def predict(self, text: str | None) -> tuple[str, float, bool, float | None]:
        """Language, score, whether rejected, distance."""
        counts = self.grams.counts(text) if self.languages else None
        if counts is None:
            return UNKNOWN, 0.0, True, None
        v = weighted(counts, self.idf)
        at = np.flatnonzero(v)
        cosine = v[at] @ self.centers[at]
        each = np.full(len(self.languages), -1.0)
        np.maximum.at(each, self.owner, cosine)
        best = int(each.argmax())
        other = float(np.delete(each, best).max()) if len(each) > 1 else 0.0
        return self.languages[best], float(1 / (1 + np.exp(-self.sharpness * (each[best] - other)))), bool(1 - each[best] > self.limit[best]), float(1 - each[best])


def document_frequencies(texts: DataFrame, grams: Grams) -> tuple[int, np.ndarray]:
    """Number of texts with a letter, and of those that have each place; added up in tasks, then over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(grams.buckets, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts = grams.counts(text)
                if counts is not None:
                    total += counts > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(grams.buckets), -1), pa.int32()), pa.array(np.append(total, n), pa.int64())], names=["place", "n"])

    found = {r["place"]: r["n"] for r in texts.mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()}
    return found.get(-1, 0), np.array([found.get(k, 0) for k in range(grams.buckets)], np.int64)


def fit(learning: DataFrame, id_col: str, text_col: str, lang_col: str, clusters: int = 4, per_language: int = 1500, reach: float = 0.99, margin: float = 0.1, grams: Grams | None = None) -> Model:
    """From (id, text, language) of the learning rows."""
    grams = grams or Grams()
    rows = learning.select(id_col, F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    total, frequency = document_frequencies(rows.select("text"), grams)
    idf = np.log((1 + total) / (1 + frequency)) + 1
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not total or not sizes:
        return Model(grams, idf, [], np.zeros(0, np.int64), np.zeros((0, grams.buckets)), np.zeros(0))
    # of each language, the share of rows that gives about per_language of them
    share = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, per_language / n))))
    at = (F.xxhash64(id_col, "text") % 1_000_000 + 1_000_000) % 1_000_000 / 1_000_000.0
    sample = rows.where(at < share[F.col("lang")]).select("lang", "text", F.xxhash64(id_col, "text").alias("at"))
    sent = learning.sparkSession.sparkContext.broadcast(idf)

    def learn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = (grams.counts(t) for t in pdf.sort_values(["at", "text"], kind="stable")["text"])
        vectors = np.array([weighted(c, sent.value) for c in found if c is not None], np.float32)
        if not len(vectors):
            return pd.DataFrame({"lang": [], "part": [], "center": [], "far": []})
        centers = cluster(vectors, clusters)
        far = float(np.quantile(1 - (vectors @ centers.T).max(1), reach))
        return pd.DataFrame({"lang": key[0], "part": range(len(centers)), "center": [c.astype(np.float64).tolist() for c in centers], "far": far})

    found = sample.groupBy("lang").applyInPandas(learn, "lang string, part int, center array<double>, far double").collect()
    found.sort(key=lambda r: (r["lang"], r["part"]))
    languages = sorted({r["lang"] for r in found})
    limit = {r["lang"]: min(1.0, r["far"] + margin) for r in found}
    owner = np.array([languages.index(r["lang"]) for r in found], np.int64)
    return Model(grams, idf, languages, owner, np.array([r["center"] for r in found]).reshape(len(found), grams.buckets), np.array([limit[x] for x in languages]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected, distance) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*map(sent.value.predict, batch.column(1).to_pylist()), strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.bool_(), pa.float64()), strict=True))], names=["id", "lang_pred", "score", "rejected", "distance"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean, distance double")
    return found.withColumnRenamed("id", id_col)


def held_out(ident: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id's text leaves this remainder; a null id is not held out."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fitting) -> DataFrame:
    """Learns from the rows that are not ``held`` (a condition on the id) and predicts all: (id, held_out, lang_pred, score, rejected, distance)."""
    settle(docs.sparkSession)
    model = fit(docs.where(~held), id_col, text_col, lang_col, **fitting)
    out = predict(docs, model, id_col, text_col)
    return out.select(id_col, held.alias("held_out"), "lang_pred", "score", "rejected", "distance")
