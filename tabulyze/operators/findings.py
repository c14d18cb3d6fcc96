"""Findings of several stages brought together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def merged(stages: dict[str, DataFrame], keys: list[str], overlay: bool = True) -> DataFrame:
    """One row per key: what the first stage that has the key says, with its name as ``source``,
    and the names of all stages that have it as ``also``.

    ``stages`` are in order of precedence. They may have different columns; with ``overlay`` a
    field that the winning stage leaves null, or has not, is taken from the next one that fills
    it, otherwise the row is the winner's alone. Null keys are equal to each other. A stage that
    repeats a key counts with its smallest row, so reruns agree. Every stage is reduced
    before the stages meet, so a key has at most one row per stage.
    """
    if not stages:
        raise ValueError("there is no stage to merge")
    fields: dict[str, str] = {}
    for frame in stages.values():
        for f in frame.schema.fields:
            if f.name not in keys:
                fields.setdefault(f.name, f.dataType.simpleString())
    rows = []
    for place, (name, frame) in enumerate(stages.items()):
        held = [F.col(f"`{c}`") if c in frame.columns else F.lit(None).cast(t) for c, t in fields.items()]
        values = F.struct(*[h.cast(t).alias(c) for h, (c, t) in zip(held, fields.items())])
        own = frame.select(*[F.col(f"`{k}`").alias(k) for k in keys], values.alias("__values"))
        own = own.groupBy(*keys).agg(F.min("__values").alias("__values"))
        rows.append(own.select("*", F.lit(place).alias("__place"), F.lit(name).alias("__stage")))
    every = reduce(DataFrame.unionByName, rows)
    # at most one row per stage is listed
    listed = every.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__place", "__stage", "__values"))).alias("__all"))

    def field(name):
        first = F.element_at("__all", 1)["__values"][name]
        filled = F.filter(F.transform("__all", lambda s: s["__values"][name]), lambda v: v.isNotNull())
        return (F.get(filled, F.lit(0)) if overlay else first).alias(name)
    return listed.select(*keys, *[field(c) for c in fields], F.element_at("__all", 1)["__stage"].alias("source"),
                         F.transform("__all", lambda s: s["__stage"]).alias("also"))


def first_filled(*frames: DataFrame | None) -> DataFrame:
    """The first frame that has rows; earlier findings are taken over whole. The last one is not tested."""
    given = [f for f in frames if f is not None]
    for frame in given[:-1]:
        if not frame.isEmpty():
            return frame
    return given[-1]
