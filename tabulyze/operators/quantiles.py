"""Exact quantiles whose memory does not grow with the table.

A sketch of every column brackets each wanted rank, whatever the distribution. While a
bracket may hold too many values, one scan counts the values of all brackets of all columns
on fine grids and keeps the step that holds the rank; a last scan counts the values inside
the brackets one by one. The number of scans depends on the number of rows only (two up to
some million cells a column, three up to some thousand million, four beyond), not on how
many columns and ranks are wanted. A sketch may err: what decides is the count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabulyze.functions.columns import literal, number_sql

ACCURACY = 1500           # a sketch's rank error is about the column's size divided by this, 99 times in 100
MARGIN = 2                # half width of a bracket, in such errors
PICK_ROWS = 20_000        # values of a bracket counted one by one
GRID = 1000               # steps into which a scan divides a bracket
SLOTS = 64                # places where the sketches of all tasks are merged first
WIDE_COLUMNS = 32         # columns sketched in one scan; more take further scans of other columns

_SIGN = np.int64(-1 << 63)


def ordered_key(values: np.ndarray) -> np.ndarray:
    """Doubles as 64-bit integers in the same order; both zeros are one."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits ^ _SIGN, bits)


def key_values(keys: np.ndarray) -> np.ndarray:
    return np.where(keys < 0, ~keys ^ _SIGN, keys).view(np.float64)


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], pick_rows: int | None = None,
                    accuracy: int | None = None, sizes: dict[str, int] | None = None,
                    sketches: dict | None = None) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column, ``None`` for an empty column.

    ``sizes`` names the filled cells per column where the caller has them; empty columns
    are then not read. ``sketches`` hands in, per column, n, min, max and the ``sketch`` at
    ``sketch_cuts`` of the same ranks and accuracy, which saves the first scan.
    """
    pick_rows = PICK_ROWS if pick_rows is None else pick_rows
    accuracy = ACCURACY if accuracy is None else accuracy
    found: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    filled = [c for c in columns if sizes is None or sizes[c]]
    size, brackets, ranks = {}, {}, {}
    known = {c: s for c, s in (sketches or {}).items() if c in filled}
    rest = [c for c in filled if c not in known]
    for start in range(0, len(rest), WIDE_COLUMNS):
        known |= _sketches(df, rest[start:start + WIDE_COLUMNS], probs, accuracy)
    for c in filled:
        size[c] = known[c]["n"]
        if size[c]:
            _bracket(c, known[c], probs, pick_rows, accuracy, brackets, ranks)
    targets = [(c, p) for c in filled if size[c] for p in probs]
    values = _at_ranks(df, {t: brackets[t] for t in targets}, {t: ranks[t] for t in targets}, pick_rows) if targets else {}
    for c in {c for c, _ in targets}:
        for i, p in enumerate(probs):
            low, high = values[c, p]
            part = p * (size[c] - 1) - math.floor(p * (size[c] - 1))
            found[c][i] = low if part == 0 or low == high else low + (high - low) * part
    return found


def sketch_cuts(probs: list[float], accuracy: int = ACCURACY) -> list[float]:
    """The shares at which a sketch brackets the ranks of ``probs``."""
    return sorted({min(1.0, max(0.0, p + s * MARGIN / accuracy)) for p in probs for s in (-1, 1)})


def _sketch_size(accuracy: int) -> int:
    """Items of a KLL sketch of this accuracy, by the published bound of its rank error."""
    return min(65_535, max(8, round((2.296 * accuracy) ** (1 / 0.9021))))


def _cuts_sql(sketch: str, filled: str, probs: list[float], accuracy: int) -> str:
    cuts = ", ".join(map(literal, sketch_cuts(probs, accuracy)))
    return f"case when {filled} > 0 then kll_sketch_get_quantile_double({sketch}, array({cuts})) end"


def sketch_sql(v: str, probs: list[float], accuracy: int = ACCURACY) -> str:
    return _cuts_sql(f"kll_sketch_agg_double({v}, {_sketch_size(accuracy)})", f"count({v})", probs, accuracy)


def _sketches(df: DataFrame, columns: list[str], probs: list[float], accuracy: int) -> dict:
    """n, min, max and sketch per column, from one scan; a sketch knows its size and extremes. The
    sketches of many tasks are merged in ``SLOTS`` places before one task merges these."""
    size, every = _sketch_size(accuracy), range(len(columns))
    cuts = ", ".join(map(literal, [0.0, *sketch_cuts(probs, accuracy), 1.0]))
    cells = df.selectExpr(f"pmod(spark_partition_id(), {SLOTS}) as slot", *[f"{number_sql(df, c)} as v{i}" for i, c in enumerate(columns)])
    parts = cells.groupBy("slot").agg(*[F.expr(f"kll_sketch_agg_double(v{i}, {size}) as s{i}") for i in every])
    whole = parts.agg(*[F.expr(f"kll_merge_agg_double(s{i}, {size}) as s{i}") for i in every])
    row = whole.selectExpr(*[e for i in every for n in (f"coalesce(kll_sketch_get_n_double(s{i}), 0L)",) for e in (
        n, f"case when {n} > 0 then kll_sketch_get_quantile_double(s{i}, array({cuts})) end")]).first()
    found = {}
    for i, c in enumerate(columns):
        n, at = row[2 * i], row[2 * i + 1] or [None, None]
        found[c] = {"n": n, "min": at[0], "max": at[-1], "sketch": at[1:-1]}
    return found


def _bracket(c: str, known, probs: list[float], pick_rows: int, accuracy: int, brackets: dict, ranks: dict) -> None:
    """The wanted ranks of a column and the brackets that should hold them."""
    size, least, most = known["n"], known["min"], known["max"]
    at = dict(zip(sketch_cuts(probs, accuracy), known["sketch"]))
    for p in probs:
        below = math.floor(p * (size - 1))
        ranks[c, p] = (below, min(below + 1, size - 1))
        expected = math.ceil(size * 2 * (MARGIN + 1) / accuracy)
        low, high = at[min(1.0, max(0.0, p - MARGIN / accuracy))], at[min(1.0, max(0.0, p + MARGIN / accuracy))]
        # bracket, values expected in it, and what is sure to hold the ranks
        brackets[c, p] = (low, high, expected, least, most) if size > pick_rows else (least, most, size, least, most)


def _at_ranks(df: DataFrame, brackets: dict, ranks: dict, pick_rows: int) -> dict:
    """The values at both ranks of every target. A bracket is narrowed while it may hold more
    than ``pick_rows`` values, all of them in one scan; a sketch that erred by more than it
    promises starts again from the whole range of its column."""
    at: dict[tuple, float] = {}       # (column, rank): value
    wanted: dict[tuple, tuple] = {}   # (column, rank): bracket
    for (c, p), pair in ranks.items():
        for rank in pair:
            wanted[c, rank] = brackets[c, p]
    while wanted:
        # a bracket of one value needs no narrowing however many equal ones it holds
        wide = [t for t, b in wanted.items() if b[2] > pick_rows and b[0] != b[1]]
        step = {t: wanted[t] for t in wide} if wide else dict(wanted)
        found = (_narrowed if wide else _picked)(df, step)
        for t, (_, _, _, least, most) in step.items():
            if t not in found:
                wanted[t] = (least, most, math.inf, least, most)
            elif wide:
                wanted[t] = (*found[t], least, most)
            else:
                at[t] = found[t][0]
                del wanted[t]
    return {(c, p): tuple(at[c, rank] for rank in pair) for (c, p), pair in ranks.items()}


def _intervals(df: DataFrame, wanted: dict) -> tuple[DataFrame, list[tuple[int, float, float]], dict]:
    """The columns as doubles, the different brackets by column position, and the interval
    of each target."""
    columns = sorted({c for c, _ in wanted})
    different = sorted({(c, b[0], b[1]) for (c, _), b in wanted.items()})
    number = {i: k for k, i in enumerate(different)}
    cells = df.selectExpr(*[f"{number_sql(df, c)} as c{k}" for k, c in enumerate(columns)])
    return (cells, [(columns.index(c), low, high) for c, low, high in different],
            {(c, rank): number[c, b[0], b[1]] for (c, rank), b in wanted.items()})


def _covering(counts: DataFrame, place: str, of: dict) -> list:
    """(interval, place, n, upto) of the counted places that hold a wanted rank; place null counts what
    lies below the interval. An interval has a bounded number of places."""
    total = F.sum("n").over(Window.partitionBy("interval").orderBy(F.col(place).asc_nulls_first()))
    by_interval: dict[int, list[int]] = {}
    for (_, rank), i in of.items():
        by_interval.setdefault(i, []).append(rank)
    lists = ", ".join(f"array({', '.join(f'{r}L' for r in sorted(set(by_interval[i])))})" for i in range(len(by_interval)))
    held = counts.withColumn("upto", total).filter(F.col(place).isNotNull())
    return held.filter(f"exists(element_at(array({lists}), interval + 1), r -> r >= upto - n and r < upto)").collect()


def _matched(rows: list, wanted: dict, of: dict, result) -> dict:
    """For each target the ``result`` of the row that holds its rank, if one does."""
    by_interval: dict[int, list] = {}
    for r in rows:
        by_interval.setdefault(r["interval"], []).append(r)
    return {t: result(r) for t in wanted for r in by_interval.get(of[t], []) if r["upto"] - r["n"] <= t[1] < r["upto"]}


def _narrowed(df: DataFrame, wanted: dict) -> dict:
    """A narrower (low, high, values inside) per target, from one scan: a task counts the values of
    every bracket on a grid that is even in the order of doubles, so no distribution defeats
    it. A step is as narrow as the values found in it, so a value that many cells share is one."""
    cells, intervals, of = _intervals(df, wanted)
    steps = []
    for k, low, high in intervals:
        first, last = (int(x) for x in ordered_key(np.array([low, high])))
        steps.append((k, first, last, -(-(last - first + 1) // GRID)))
    top = np.iinfo(np.int64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (len(steps), GRID)
        below, inside = np.zeros(len(steps), np.int64), np.zeros(shape, np.int64)
        least, most = np.full(shape, top.max), np.full(shape, top.min)
        for batch in batches:
            for k in range(batch.num_columns):
                values = batch.column(k).drop_null().to_numpy(zero_copy_only=False)
                keys = np.sort(ordered_key(values)) if len(values) else np.zeros(0, np.int64)
                for i, (column, first, last, width) in enumerate(steps):
                    if column == k:
                        a, b = np.searchsorted(keys, first), np.searchsorted(keys, last, "right")
                        below[i] += a
                        own = keys[a:b]
                        # differences of far keys do not fit a signed integer
                        places = ((own.view(np.uint64) - np.uint64(first % (1 << 64))) // np.uint64(width)).astype(np.int64)
                        heads = np.flatnonzero(np.diff(places, prepend=-1))
                        ends = np.append(heads[1:], len(places))
                        at = places[heads]
                        inside[i, at] += ends - heads
                        least[i, at] = np.minimum(least[i, at], own[heads])
                        most[i, at] = np.maximum(most[i, at], own[ends - 1] if len(own) else own)
        at, step = np.nonzero(inside)
        under = np.flatnonzero(below)
        nothing = [None] * len(under)
        yield pa.RecordBatch.from_pydict({
            "interval": pa.array(np.concatenate((under, at)).astype(np.int32)),
            "step": pa.array(nothing + step.tolist(), pa.int32()),
            "n": pa.array(np.concatenate((below[under], inside[at, step]))),
            "low": pa.array(nothing + key_values(least[at, step]).tolist(), pa.float64()),
            "high": pa.array(nothing + key_values(most[at, step]).tolist(), pa.float64())})
    counts = cells.mapInArrow(counted, "interval int, step int, n long, low double, high double").groupBy("interval", "step").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return _matched(_covering(counts, "step", of), wanted, of, lambda r: (r["low"], r["high"], r["n"]))


def _picked(df: DataFrame, wanted: dict) -> dict:
    """The value at each target's rank where its bracket holds it, from one scan. A task adds up
    equal values, and what lies below a bracket, before it sends them."""
    cells, intervals, of = _intervals(df, wanted)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = np.zeros(len(intervals), np.int64)
        for batch in batches:
            at, held, times = [], [], []
            for k in range(batch.num_columns):
                values = batch.column(k).drop_null().to_numpy(zero_copy_only=False)
                values = np.sort(values + 0.0)
                for i, (column, low, high) in enumerate(intervals):
                    if column == k:
                        a, b = np.searchsorted(values, low), np.searchsorted(values, high, "right")
                        below[i] += a
                        own = values[a:b]
                        new = np.flatnonzero(np.concatenate((np.ones(min(len(own), 1), bool), own[1:] != own[:-1])))
                        at.append(np.full(len(new), i, np.int32))
                        held.append(own[new])
                        times.append(np.diff(np.append(new, len(own))))
            if at:
                yield pa.RecordBatch.from_pydict({"interval": pa.array(np.concatenate(at)), "v": pa.array(np.concatenate(held)),
                                                  "n": pa.array(np.concatenate(times).astype(np.int64))})
        under = np.flatnonzero(below)
        yield pa.RecordBatch.from_pydict({"interval": pa.array(under.astype(np.int32)), "v": pa.nulls(len(under), pa.float64()),
                                          "n": pa.array(below[under])})
    counts = cells.mapInArrow(counted, "interval int, v double, n long").groupBy("interval", "v").agg(F.sum("n").alias("n"))
    return _matched(_covering(counts, "v", of), wanted, of, lambda r: (r["v"],))


def fences_of(quartiles: dict[str, list], multiplier: float = 1.5) -> dict[str, tuple[float, float, float, float] | None]:
    """(q1, q3, lower fence, upper fence) per column, ``None`` for an empty column."""
    return {c: None if q[0] is None else
            (q[0], q[1], q[0] - multiplier * (q[1] - q[0]), q[1] + multiplier * (q[1] - q[0])) for c, q in quartiles.items()}


def iqr_fences(df: DataFrame, columns: list[str], multiplier: float = 1.5,
               sizes: dict[str, int] | None = None) -> dict[str, tuple[float, float, float, float] | None]:
    return fences_of(exact_quantiles(df, columns, [0.25, 0.75], sizes=sizes), multiplier)
