"""Nearest-centroid language identification over hashed byte n-grams.

Texts become normalised TF-IDF vectors of byte 2- and 3-grams; every language has several
centroids, found by spherical k-means; a text takes the language of the centroid with the
largest cosine, and counts as rejected when that cosine is lower than almost all training
texts of the centroid have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tabulyze.llm.words import bytes_of, row_chunks

DIMENSIONS = 4096
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[:65] = 32          # blanks, digits and ASCII punctuation all end a word
_FOLD[91:97] = 32
_FOLD[123:128] = 32


def gram_counts(column: pa.Array, dimensions: int = DIMENSIONS) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row, counts) of whole texts, a block of rows at a time."""
    data, offsets = bytes_of(column)
    # blocks of rows are also bounded by their count, since each row has a vector
    for first, last in row_chunks(offsets):
        for a in range(first, last, 256):
            b = min(last, a + 256)
            part = _FOLD[data[offsets[a]:offsets[b]]]
            ends = offsets[a + 1:b + 1] - offsets[a]
            row = np.repeat(np.arange(b - a, dtype=np.int64), np.diff(offsets[a:b + 1]))
            counts = np.zeros((b - a) * dimensions, np.float32)
            for width in (2, 3):
                n = len(part) - width + 1
                if n <= 0:
                    continue
                code = part[:n].astype(np.uint32)
                for k in range(1, width):
                    code = code * np.uint32(257) + part[k:k + n]
                code = (code * np.uint32(2654435761)) >> np.uint32(8)
                place = row[:n] * dimensions + (code % np.uint32(dimensions)).astype(np.int64)
                inside = np.arange(n) + width <= ends[row[:n]]
                inside &= ~((part[:n] == 32) & (part[width - 1:] == 32))
                counts += np.bincount(place[inside], minlength=len(counts)).astype(np.float32)
            yield a, b, counts.reshape(b - a, dimensions)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(counts) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per task: how many texts have each feature, and the number of texts last."""
    total = np.zeros(DIMENSIONS + 1, np.int64)
    for batch in batches:
        for first, last, counts in gram_counts(batch.column("text")):
            total[:-1] += np.count_nonzero(counts, axis=0)
            total[-1] += last - first
    yield pa.RecordBatch.from_pydict({"feature": pa.array(np.arange(DIMENSIONS + 1), pa.int32()), "n": pa.array(total, pa.int64())})


def _centroids(per_language: int, clusters: int):
    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("mixed").head(per_language)
        points = np.stack([np.frombuffer(v, np.float32) for v in rows["vector"]])
        picked = [0]                      # farthest-first start: no chance in it
        near = points @ points[0]
        for _ in range(min(clusters, len(points)) - 1):
            picked.append(int(np.argmin(near)))
            near = np.maximum(near, points @ points[picked[-1]])
        centres = points[picked]
        for _ in range(12):
            own = np.argmax(points @ centres.T, axis=1)
            centres = np.stack([points[own == k].sum(0) if np.any(own == k) else centres[k] for k in range(len(centres))])
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        similar = points @ centres.T
        own = np.argmax(similar, axis=1)
        floor = [float(np.quantile(similar[own == k, k], 0.001)) if np.any(own == k) else 1.0 for k in range(len(centres))]
        return pd.DataFrame({"lang": key[0], "floor": floor, "centre": [c.astype(np.float32).tobytes() for c in centres]})
    return fit


def fit_languages(rows: DataFrame, per_language: int = 500, clusters: int = 4) -> dict:
    """A model from (doc_id, text, lang) rows, all of which may be learned from.

    Document frequencies come from all rows; centroids from at most ``per_language`` texts
    of each language, drawn by the hash of the id, clustered in one task per language.
    """
    counted = rows.select("text").mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    freq = np.zeros(DIMENSIONS + 1)
    for r in counted.collect():           # DIMENSIONS + 1 rows
        freq[r["feature"]] = r["n"]
    idf = (np.log((1 + freq[-1]) / (1 + freq[:-1])) + 1).astype(np.float32)
    first = Window.partitionBy("lang").orderBy("mixed", "doc_id")
    ids = rows.select("doc_id", "lang", F.xxhash64(F.lit("lang"), "doc_id").alias("mixed")).where("doc_id is not null").distinct()
    ids = ids.select("*", F.row_number().over(first).alias("place")).where(F.col("place") <= per_language)
    # at most per_language small rows for each language
    chosen = rows.join(F.broadcast(ids.select("doc_id", "lang", "mixed")), ["doc_id", "lang"]).select("lang", "mixed", "text")

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, counts in gram_counts(batch.column("text")):
                found = vectors(counts, idf)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang")[a:b], batch.column("mixed")[a:b],
                     pa.array([v.astype(np.float32).tobytes() for v in found], pa.binary())], ["lang", "mixed", "vector"])
    fitted = chosen.mapInArrow(embed, "lang string, mixed long, vector binary").groupBy("lang").applyInPandas(
        _centroids(per_language, clusters), "lang string, floor double, centre binary").collect()
    fitted.sort(key=lambda r: (r["lang"], r["centre"]))
    return {"idf": idf, "langs": [r["lang"] for r in fitted], "floors": np.array([r["floor"] for r in fitted]),
            "centres": np.stack([np.frombuffer(r["centre"], np.float32) for r in fitted]) if fitted else np.zeros((0, DIMENSIONS), np.float32)}


def predict_languages(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, cosine, rejected) for every row.

    ``und`` with score 0 where the text is null, has no letter, or nothing was learned.
    ``score`` is the share of the best language in a soft maximum over languages; it does
    not depend on other rows, so repeated rows agree. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                       F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = np.array(model["langs"], object)
        names = sorted(set(model["langs"]))
        for batch in batches:
            for a, b, counts in gram_counts(batch.column("text")):
                letters = np.array(batch.column("letters")[a:b].to_pylist(), bool)
                if not names:
                    label, score, cosine, rejected = ["und"] * (b - a), np.zeros(b - a), np.zeros(b - a), [True] * (b - a)
                else:
                    similar = vectors(counts, model["idf"]) @ model["centres"].T
                    best = np.argmax(similar, axis=1)
                    top = np.stack([similar[:, langs == name].max(axis=1) for name in names], axis=1)
                    soft = np.exp(30.0 * (top - top.max(axis=1, keepdims=True)))
                    cosine = np.where(letters, similar.max(axis=1), 0.0)
                    score = np.where(letters, 1.0 / soft.sum(axis=1), 0.0)
                    rejected = ~letters | (cosine < model["floors"][best])
                    label = np.where(letters, langs[best], "und")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], pa.array(list(label), pa.string()), pa.array(score, pa.float64()),
                     pa.array(cosine, pa.float64()), pa.array(list(rejected), pa.bool_())],
                    ["doc_id", "lang_pred", "score", "cosine", "rejected"])
    return rows.mapInArrow(predicted, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, cosine double, "
                                      "rejected boolean")
