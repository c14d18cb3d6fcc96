"""Mixing sources to target weights by Pareto order sampling.

A document's expected copies grow with its weight, by default the logarithm of its length,
up to a cap, and add up to the target of its source. Whole copies are certain. What is left
is the document's inclusion probability: documents rank by random odds over inclusion odds,
and the sample is of fixed size in words: it ends where these reach the rest of the target.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tabulyze.llm.quality import NOT_SPACE

CYCLE = (5.0, 2.0, 1.0)
BUCKETS = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE + "+")), F.lit(0)).cast("long")


def weight_of(size: Column) -> Column:
    """Binary digits of the size: a long document is wanted more often than a short one, but
    by no more than the logarithm of its length."""
    return F.length(F.bin(size)).cast("double")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on key and seed only."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, cycle: tuple[float, ...] = CYCLE, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): ``share`` of all sizes dealt by weight, no target above
    ``most`` times its source. One row per source throughout.

    Resharing the excess until none is above ends at one common level, target = min(cap,
    level x weight). Sources sorted by cap over weight are full as long as that quotient is
    at most what the level would be without the full ones before them.
    """
    one = Window.partitionBy(F.lit(0))
    ranked = sizes.select("source", "source_size", (F.row_number().over(
        one.orderBy(F.col("source").isNull(), F.col("source"))) - 1).alias("place"))
    weight = F.array(*[F.lit(float(w)) for w in cycle])[F.col("place") % len(cycle)]
    dealt = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(most)).alias("cap"),
                          (F.sum("source_size").over(one) * F.lit(share)).alias("total"), F.sum(weight).over(one).alias("weights"),
                          "place")
    # sums of whole and half numbers are exact, so every engine finds the same level
    order = one.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    full = dealt.select("*", F.coalesce(F.sum("cap").over(order), F.lit(0.0)).alias("used"),
                        F.coalesce(F.sum("weight").over(order), F.lit(0.0)).alias("gone"))
    level = (F.col("total") - F.col("used")) / (F.col("weights") - F.col("gone"))
    tested = full.select("*", level.alias("level"), (F.col("cap") / F.col("weight") <= level).alias("is_full"))
    shared = tested.select("*", F.min(F.when(~F.col("is_full"), F.struct(F.col("cap") / F.col("weight"), "place", "level")))
                           .over(one)["level"].alias("common"))
    return shared.select("source", "source_size", F.when(F.col("is_full"), F.col("cap"))
                         .otherwise(F.col("common") * F.col("weight")).alias("target"))


def expected_copies(docs: DataFrame, most: float = 2.0, **shares) -> DataFrame:
    """(source, weight, n, source_size, target, rest, expected, whole, part): one row per source
    and weight of ``docs`` (source, size, weight).

    ``expected`` is min(most, level x weight), with one level per source, so that the sizes
    times their expected copies give the target. ``rest`` is what whole copies leave of it.
    Weights go from the heaviest down: they are full as long as the level without the full
    ones before them lifts them to ``most``.
    """
    kinds = docs.groupBy("source", "weight").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    goals = targets(kinds.groupBy("source").agg(F.sum("words").alias("source_size")), most=most, **shares)
    k, g = kinds.alias("k"), goals.alias("g")
    rows = k.join(g, F.col("k.source").eqNullSafe(F.col("g.source"))).select(
        "k.source", "weight", "words", "n", "source_size", "target")
    source = Window.partitionBy("source")
    heavier = source.orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)
    pull = F.col("words") * F.col("weight")
    rows = rows.select("*", F.coalesce(F.sum(F.col("words") * F.lit(most)).over(heavier), F.lit(0.0)).alias("used"),
                       (F.sum(pull).over(source) - F.coalesce(F.sum(pull).over(heavier), F.lit(0.0))).alias("pull"))
    left = F.col("target") - F.col("used")
    # products of whole numbers decide, so every engine fills the same weights
    rows = rows.select("*", (left / F.nullif("pull", F.lit(0.0))).alias("level"),
                       ((F.col("target") > 0) & (F.col("pull") * F.lit(most) <= left * F.col("weight"))).alias("is_full"))
    rows = rows.select("*", F.min(F.when(~F.col("is_full"), F.struct(-F.col("weight"), "level"))).over(source)["level"].alias("common"))
    rows = rows.select("*", F.when(F.col("is_full"), F.lit(most)).otherwise(
        F.coalesce("common", F.lit(0.0)) * F.col("weight")).alias("expected"))
    rows = rows.select("*", F.floor("expected").cast("int").alias("whole"), (F.col("expected") - F.floor("expected")).alias("part"))
    return rows.select("source", "weight", "n", "source_size", "target",
                       (F.col("target") - F.sum(F.col("whole") * F.col("words")).over(source)).alias("rest"), "expected", "whole", "part")


def drawn(docs: DataFrame, plan: DataFrame, seed: int, buckets: int = BUCKETS) -> DataFrame:
    """(source, key, size, rest, rank, bucket) of every row with a fraction of a copy to draw.

    A bucket is a range of ranks. It is cut from the share of the source's rows that the draw
    puts below a rank, so each holds about as many rows, whatever the probabilities are.
    """
    odds = F.col("part") / (1 - F.col("part"))
    law = plan.where("part > 0").groupBy("source").agg(F.array_sort(F.collect_list(F.struct(odds.alias("odds"), "n"))).alias("law"),
                                                       F.sum("n").alias("rows"))
    a, p, w = docs.alias("a"), plan.where("part > 0").alias("p"), law.alias("w")
    p = p.join(w, F.col("p.source").eqNullSafe(F.col("w.source"))).select("p.source", "weight", "rest", "part", "law", "rows").alias("p")
    ranked = a.join(p, F.col("a.source").eqNullSafe(F.col("p.source")) & (F.col("a.weight") == F.col("p.weight"))).select(
        "a.source", "a.key", "a.size", "p.rest", "p.law", "p.rows", pareto_rank(uniform(F.col("a.key"), seed), F.col("p.part")).alias("rank"))
    # every step rises with the rank in floating point too, so buckets keep its order
    below = F.aggregate("law", F.lit(0.0), lambda sum_, x: sum_ + x["n"] * (1 - 1 / (1 + F.col("rank") * x["odds"]))) / F.col("rows")
    return ranked.select("source", "key", "size", "rest", "rank", F.floor(below * buckets).alias("bucket"))


def mixing_plan(docs: DataFrame, seed: int = 42, buckets: int = BUCKETS, **shares) -> DataFrame:
    """One row per source and weight: target, whole copies, inclusion probability of one more
    and the last rank that the source's sample takes.

    ``docs`` has source, key, size and weight (see ``keyed``). Ranks are added up in ``buckets``
    parts of each source, so a source with most of the rows is spread over many tasks.
    """
    plan = expected_copies(docs, **shares)
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    ranked = drawn(docs, plan, seed, buckets)
    parts = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("rank", "key").rowsBetween(Window.unboundedPreceding, -1)
    r, b = ranked.select("*", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("own")).alias("r"), parts.alias("b")
    placed = r.join(b, same("r", "b") & (F.col("r.bucket") == F.col("b.bucket")))
    taken = placed.where(F.expr("b.before + r.own + r.size / 2 < r.rest"))
    cut = taken.groupBy("r.source").agg(F.max(F.struct("rank", "key")).alias("cut")).alias("c")
    p = plan.alias("p")
    return p.join(cut, same("p", "c"), "left").select(
        "p.source", "p.weight", "p.source_size", "p.target", "p.expected", "p.whole", "p.part", "c.cut")


def pareto_rank(u: Column, inclusion: Column) -> Column:
    """Random odds over inclusion odds."""
    return (u / (1 - u)) / (inclusion / (1 - inclusion))


def keyed(docs: DataFrame, doc_id: str, text: str, source: str, weigh: Callable[[Column], Column] = weight_of) -> DataFrame:
    body = F.col(f"`{text}`")
    key = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.md5(F.coalesce(body, F.lit("")).cast("binary")))
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"),
                       key.alias("key"), size_of(body).alias("size"))
    return rows.select("*", weigh(F.col("size")).alias("weight"))


def mix_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42,
               weigh: Callable[[Column], Column] = weight_of, **shares) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, expected, copies): how often each row is
    taken, and how often it is over many seeds.

    ``weigh`` gives a positive weight for a size; it should take few values, since one row per
    source and weight is planned.

    Null texts have size 0; a null source is a source of its own, last in order; rows with a
    null id are drawn by their text; repeated rows are drawn together; a source without
    words has target 0; an empty table gives no rows; the input row is carried whole in
    ``row``, so clashing names do no harm. The sample ends within half a document of the
    target.
    """
    rows = keyed(docs, doc_id, text, source, weigh)
    plan = mixing_plan(rows.select("source", "key", "size", "weight"), seed, **shares).alias("p")
    d = rows.alias("d")
    joined = d.join(plan, F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.weight") == F.col("p.weight")))
    rank = F.struct(pareto_rank(uniform(F.col("d.key"), seed), F.col("p.part")).alias("rank"), F.col("d.key").alias("key"))
    extra = F.coalesce((F.col("p.part") > 0) & (rank <= F.col("p.cut")), F.lit(False)).cast("int")
    return joined.select("d.row", "d.doc_id", "d.source", "d.size", "p.source_size", "p.target", "p.expected",
                         (F.col("p.whole") + extra).alias("copies"))


MIXING_SQL = f"""
with base as (select doc_id, source, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) as key,
  len(regexp_extract_all(coalesce(text, ''), '{NOT_SPACE}+'))::BIGINT as size from documents),
sizes as (select source, sum(size)::BIGINT as source_size from base group by source),
ranked as (select *, row_number() over (order by source is null, source) - 1 as place from sizes),
dealt as (select *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][place % 3 + 1] as weight, source_size * 2.0::DOUBLE as cap,
  (sum(source_size) over ())::BIGINT * 1.5::DOUBLE as total from ranked),
summed as (select *, sum(weight) over () as weights,
  coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0.0) as used,
  coalesce(sum(weight) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0.0) as gone
  from dealt),
tested as (select *, (total - used) / (weights - gone) as level, cap / weight <= (total - used) / (weights - gone) as is_full
  from summed),
common as (select level as common from tested where not is_full order by cap / weight, place limit 1),
target as (select source, source_size, case when is_full then cap else (select common from common) * weight end as target
  from tested),
kinds as (select source, length(bin(size))::DOUBLE as weight, sum(size)::BIGINT as words from base group by all),
pulled as (select k.*, source_size, target, coalesce(sum(words * 2.0::DOUBLE) over heavier, 0.0) as used,
  sum(words * weight) over (partition by k.source) - coalesce(sum(words * weight) over heavier, 0.0) as pull
  from kinds k join target t on k.source is not distinct from t.source
  window heavier as (partition by k.source order by weight desc rows between unbounded preceding and 1 preceding)),
levels as (select *, (target - used) / nullif(pull, 0) as level, target > 0 and pull * 2.0::DOUBLE <= (target - used) * weight as is_full
  from pulled),
expected as (select *, case when is_full then 2.0::DOUBLE else coalesce(arg_max(level, weight) filter (where not is_full)
  over (partition by source), 0.0) * weight end as expected from levels),
plan as (select *, floor(expected) as whole, expected - floor(expected) as part,
  target - sum(floor(expected) * words) over (partition by source) as rest from expected),
drawn as (select b.doc_id, b.key, b.size, p.*,
  (('0x' || substr(md5('42:' || b.key), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496 as u
  from base b join plan p on b.source is not distinct from p.source and length(bin(b.size)) = p.weight),
odds as (select *, (u / (1 - u)) / nullif(part / (1 - part), 0) as rank from drawn),
cum as (select *, coalesce(sum(case when part > 0 then size else 0 end) over (partition by source order by rank nulls last, key
  rows between unbounded preceding and 1 preceding), 0) as before from odds)
select doc_id, size, source_size, target,
  (size * (whole + case when part > 0 and before + size / 2.0 < rest then 1 else 0 end))::BIGINT as taken from cum"""


def mixed_rows(docs: DataFrame, **rules) -> DataFrame:
    """Every row as often as the mix takes it, with all its columns."""
    taken = mix_copies(docs, **rules).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
