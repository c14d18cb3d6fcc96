"""Toxic passages as maximum-scoring segments of token log-odds.

Fit: token counts of labelled documents give log-odds under an informative Dirichlet prior;
tokens that stand out become scores, all others a small penalty. Score: one linear scan
finds every maximal segment of a text; its score becomes an expected number of chance
segments (extreme-value law), and the evidence of all significant ones a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TOKEN = re.compile(r"[^\W_]+")
STEMS = (7, 5, 4)
MEMO = 50_000
COUNTED_ROWS = 250    # texts whose tokens are counted before the counts leave the task


@dataclass
class ToxicityModel:
    tokens: dict[str, float] = field(default_factory=dict)   # scores of tokens, and of stems with a trailing "*"
    penalty: float = 0.5
    decay: float = 1.0           # lambda of the extreme-value law
    scale: float = 1.0           # K of the extreme-value law
    offset: float = -20.0        # logistic map of the evidence
    slope: float = 1.0
    most_expected: float = 0.05  # a segment with fewer chance segments than this is significant


def stems(word: str) -> list[str]:
    """The word's beginnings, longest first, by which inflected forms are known."""
    return [word[:n] + "*" for n in STEMS if len(word) >= n]


def hits(text: str, tokens: dict[str, float], memo: dict[str, float]) -> tuple[list[tuple[int, float]], int]:
    """(place, score) of the scored tokens, and the number of tokens. ``memo`` keeps the
    scores of words already met, at most ``MEMO`` of them."""
    words = TOKEN.findall(text.lower())
    found = []
    for place, word in enumerate(words):
        score = memo.get(word)
        if score is None:
            score = next((tokens[w] for w in (word, *stems(word)) if w in tokens), 0.0)
            if len(memo) < MEMO:
                memo[word] = score
        if score:
            found.append((place, score))
    return found, len(words)


def segments(found: list[tuple[int, float]], penalty: float) -> list[tuple[int, int, float]]:
    """Every maximal segment (first, last, score), in one pass.

    ``found`` are the places with a positive score; every place between costs ``penalty``.
    The stack holds candidates with the running sum before and after them, and for each the
    nearest earlier one that begins lower, so that no candidate is passed over twice.
    """
    stack: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, -1
    for place, score in found:
        total -= penalty * (place - last - 1)
        low, total, last = total, total + score, place
        first = place
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= low:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= total:
                break
            first, low = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((first, place, low, total, k))
    return [(a, b, high - low) for a, b, low, high, _ in stack]


def judge(text: str, model: ToxicityModel, memo: dict[str, float]) -> tuple[float, list[tuple[int, int, float, float]]]:
    """The document's evidence and its significant segments (first, last, score, expected)."""
    found, n = hits(text, model.tokens, memo)
    kept, evidence = [], 0.0
    for first, last, score in segments(found, model.penalty):
        expected = model.scale * max(n, 1) * math.exp(-model.decay * score)
        if expected <= model.most_expected:
            kept.append((first, last, score, expected))
            evidence -= math.log(max(expected, 1e-300))
    return evidence, kept


def probability(evidence: float, model: ToxicityModel) -> float:
    return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, model.offset + model.slope * evidence))))


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, COUNTED_ROWS):
            part, counts = batch.slice(start, COUNTED_ROWS), (Counter(), Counter())
            for text, toxic in zip(part.column("text"), part.column("toxic").to_pylist(), strict=True):
                # a document counts once for each token, so one long document cannot make a word toxic
                seen = set(TOKEN.findall((text.as_py() or "").lower()))
                seen |= {stem for w in seen for stem in stems(w)}
                counts[1 if toxic else 0].update(seen)
                counts[1 if toxic else 0][""] += 1
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_pydict({
                "token": names, "clean": pa.array([counts[0][w] for w in names], pa.int64()),
                "toxic": pa.array([counts[1][w] for w in names], pa.int64())})


def training_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, text, label, part): at most ``max_rows`` labelled rows, drawn by the hash of
    their id. A repeated label counts as 1 if any row says so; part 0 to 3 splits the sample."""
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(label).cast("int").alias(label))
    ids = ids.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    mixed = F.xxhash64(F.lit("sample"), "doc_id")
    ids = ids.orderBy(mixed, "doc_id").limit(max_rows).select("doc_id", label, F.pmod(mixed, F.lit(4)).alias("part"))
    rows = docs.select("doc_id", "text").where("text is not null")
    return rows.join(F.broadcast(ids), "doc_id")   # at most max_rows small rows


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_tokens: int = 20_000,
                 prior: float = 50.0, least_z: float = 3.0,
                 least_odds: float = 2.0) -> ToxicityModel:
    """Learn from at most ``max_rows`` labelled documents; three quarters give the token
    scores, the rest the extreme-value law and the logistic map. Without both labels in the
    sample, the model gives every text the share of toxic rows."""
    sample = training_sample(docs, labels, "toxic", max_rows)
    counted = sample.where("part < 3").select("text", "toxic").mapInArrow(
        _token_counts, "token string, clean long, toxic long")
    summed = counted.groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    size = summed.where("token = ''").first()
    n_clean, n_toxic = (size["clean"], size["toxic"]) if size else (0, 0)
    model = ToxicityModel()
    if not n_clean or not n_toxic:
        model.slope, model.offset = 0.0, (20.0 if n_toxic else -20.0)
        return model
    # the prior spreads ``prior`` documents by the token's share of all documents
    share = (F.col("clean") + F.col("toxic")) / F.lit(float(n_clean + n_toxic)) * prior

    def log_odds(count, n):
        return F.log((count + share) / (F.lit(n + prior + 0.5) - count - share))
    ranked = summed.where("token <> '' and toxic >= 2").select(
        "token", "clean", (log_odds(F.col("toxic"), n_toxic) - log_odds(F.col("clean"), n_clean)).alias("odds"),
        F.sqrt(1 / (F.col("toxic") + share) + 1 / (F.col("clean") + share)).alias("sd"))
    best = ranked.where((F.col("odds") > F.col("sd") * least_z) & (F.col("odds") > least_odds))
    best = best.orderBy((F.col("odds") / F.col("sd")).desc(), "token").limit(max_tokens)
    model.tokens = {r["token"]: float(r["odds"]) for r in best.collect()}

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in batches:
            rows = [hits(t.as_py(), model.tokens, memo) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({
                "n": pa.array([n for _, n in rows], pa.int64()), "n_hits": pa.array([len(f) for f, _ in rows], pa.int64()),
                "scores": pa.array([[s for *_, s in segments(f, model.penalty)] for f, _ in rows], pa.list_(pa.float64())),
                "weights": pa.array([[s for _, s in f] for f, _ in rows], pa.list_(pa.float64())), "toxic": batch.column("toxic")})
    held = sample.where("part = 3").select("text", "toxic").mapInArrow(
        judged, "n long, n_hits long, scores array<double>, weights array<double>, toxic int").collect()
    clean = [r for r in held if not r["toxic"]]
    model.decay = _decay(clean, model.penalty)
    tops = np.array([max(r["scores"], default=0.0) for r in clean] or [0.0])
    sizes = np.array([max(r["n"], 1) for r in clean] or [1])
    model.scale = min(1.0, float(len(tops) / np.sum(sizes * np.exp(-model.decay * tops))))
    evidence, toxic = [], []
    for r in held:
        expected = [model.scale * max(r["n"], 1) * math.exp(-model.decay * s) for s in r["scores"]]
        evidence.append(-sum(math.log(max(e, 1e-300)) for e in expected if e <= model.most_expected))
        toxic.append(r["toxic"])
    model.offset, model.slope = _logistic(np.array(evidence), np.array(toxic, float), n_toxic / (n_toxic + n_clean))
    return model


def _decay(clean: list, penalty: float) -> float:
    """The positive root of E[exp(x s)] = 1 over the tokens of clean documents."""
    words = sum(r["n"] for r in clean)
    weights = np.array([w for r in clean for w in r["weights"]] or [1.0])
    # half a hit is added: no hit among the clean words does not prove that none can be
    shares = np.full(len(weights), 1.0 / max(words + 1, 1)) if clean and any(r["n_hits"] for r in clean) else np.array(
        [0.5 / max(words + 1, 1)])
    rest = 1.0 - shares.sum()
    low, high = 1e-6, 50.0
    for _ in range(80):
        x = (low + high) / 2
        if rest * math.exp(-x * penalty) + float(np.sum(shares * np.exp(np.minimum(x * weights, 700)))) < 1:
            low = x
        else:
            high = x
    return low


def _logistic(x: np.ndarray, y: np.ndarray, base: float) -> tuple[float, float]:
    """Offset and slope by Newton steps, with a little shrinkage so that separable data end."""
    if len(x) == 0 or y.min() == y.max():
        return math.log(max(base, 1e-3) / (1 - min(base, 0.999))) - 1.0, 0.2
    unit = max(float(x.max()), 1.0)
    a, b, x = 0.0, 0.0, x / unit
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-6
        grad = np.array([np.sum(p - y), np.sum((p - y) * x) + 1e-3 * b])
        hess = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -50, 50))
    return a, b / unit


def score_toxicity(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, segments) for every row; segments count tokens from 0.

    Null, empty and tokenless texts have no segment and the score of no evidence; repeated
    rows are scored again; an empty table gives no rows; other columns are not read.
    """
    kind = "array<struct<first:int,last:int,score:double,expected:double>>"
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        struct = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])
        for batch in batches:
            scores, found = [], []
            for value in batch.column("text"):
                evidence, kept = judge(value.as_py() or "", model, memo)
                scores.append(probability(evidence, model))
                found.append([{"first": a, "last": b, "score": s, "expected": e} for a, b, s, e in kept])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()),
                                              pa.array(found, pa.list_(struct))], ["doc_id", "score", "segments"])
    return rows.mapInArrow(scored, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, segments {kind}")


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows whose score stays below ``threshold``, with all their columns; nothing is joined."""
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in batches:
            keep = [probability(judge(t.as_py() or "", model, memo)[0], model) < threshold for t in batch.column(text)]
            yield batch.filter(pa.array(keep, pa.bool_()))
    return docs.mapInArrow(clean, docs.schema)
