"""Mixing sources to target weights by Pareto order sampling. DataFrame operations only.

Targets: each source's share of all words by its weight, but at most ``cap`` times its own words; the
excess goes to the other sources by weight. That water level is found exactly from one row per source
in order of cap over weight, without iteration.

Within a source a document expects f copies, f = min(cap, c * g): g grows with the logarithm of its
length, and c, found the same way from one row per (source, length class), makes the expected words
meet the target. The whole part of f is taken for certain. What is left, p = f - floor(f), is an
inclusion probability: documents are ranked by (u / (1 - u)) / (p / (1 - p)), u a hash of the key, and
taken in that order up to the words still wanted, so the sample has a fixed size in words. The next
document does not fit; what is still missing, less than its words, is filled with untaken documents,
longest first and those of one length in order of rank, until none that is left would fit.

The cut in each source's ranking comes from word counts by rank interval, refined twice, so that a hot
source is never sorted in one task: only distinct documents inside one interval of 2**-20 of a source are
ordered. The filling takes whole lengths by their counts, and of a length that it needs in part the first
ones by a cut of the same kind, over counts. Rows that repeat key and size draw the same number and are
one entry of the order with their count; where a cut ends inside such an entry, just as many of its rows
are taken as fit, numbered within each partition of the input and then across them.

Edge cases: null text has no words; null source is a source of its own, last in order; the empty
source is a source; documents without words are taken zero times; ties in rank are ordered by key and
size; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.session import written

WORD = r"[^\x20\x09-\x0D]+"
SPLIT = 1 << 10  # rank intervals of each refinement


def word_count(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _level(parts: DataFrame, by: list, total: str, words: str, weight: str, cap: float, name: str) -> DataFrame:
    """Adds ``name``: the level c at which sum(words * min(cap, c * weight)) over ``by`` equals ``total``.

    Rows in order of 1 / weight reach the cap first at large weights; for each prefix of capped rows the
    level of the rest follows, and the right prefix is the first whose next row stays below the cap.
    """
    w = Window.partitionBy(*by).orderBy(F.desc(weight)).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    capped = F.coalesce(F.sum(F.col(words) * cap).over(w), F.lit(0.0))
    rest = F.sum(F.col(words) * F.col(weight)).over(whole) - F.coalesce(F.sum(F.col(words) * F.col(weight)).over(w), F.lit(0.0))
    step = parts.withColumn("_c", F.when(rest > 0, F.greatest(F.lit(0.0), F.col(total) - capped) / rest))
    fits = F.when(F.col("_c") * F.col(weight) <= cap, F.col("_c"))
    # The first prefix that fits has the largest level among those that fit; none: all rows at the cap.
    return step.withColumn(name, F.coalesce(F.max(fits).over(whole), F.lit(cap) / F.min(weight).over(whole))).drop("_c")


def source_targets(sizes: DataFrame, weights: list[float], cap: float = 3.0) -> DataFrame:
    """source, source_size, target. ``sizes``: source, source_size; weights repeat by source order."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("i", F.row_number().over(order) - 1).withColumn("w", w)
    every = Window.partitionBy()
    by_cap = Window.orderBy(F.col("source_size") / F.col("w"), "i").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every)
    left = total - cap * F.coalesce(F.sum("source_size").over(by_cap), F.lit(0))
    open_ = F.sum("w").over(every) - F.coalesce(F.sum("w").over(by_cap), F.lit(0.0))
    s = s.withColumn("_l", left / open_).withColumn("_top", cap * F.col("source_size") / F.col("w"))
    # Source k and later stay open at the first k whose own ceiling is not below the level reached.
    s = s.withColumn("_level", F.min(F.when(F.col("_l") <= F.col("_top"), F.struct(F.col("source_size") / F.col("w"), "i", "_l"))).over(every).getField("_l"))
    target = F.least(F.coalesce(F.col("_level"), F.lit(float("inf"))) * F.col("w"), cap * F.col("source_size"))
    return s.select("source", F.col("source_size").cast("long").alias("source_size"), target.cast("double").alias("target"))


def _prepared(df: DataFrame, source: str, size: str, seed: int) -> DataFrame:
    """Adds the source's id, the length class and the row's random number."""
    kind = F.floor(F.log2(F.col(size) + 1)).cast("int")
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return df.withColumns({"sid": F.xxhash64(F.col(source).isNull(), source), "kind": kind, "u": u})


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds certain copies, and rank and rank intervals of rows that can be drawn once more."""
    rows = rows.join(plan, ["sid", "kind"])
    whole = F.floor(F.col("f") + 1e-9)
    p = F.greatest(F.lit(0.0), F.col("f") - whole)
    odds = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    rows = rows.withColumns({"whole": whole.cast("long"), "rank": F.when(p > 1e-9, odds / (1 + odds))})
    rows = rows.withColumn("b1", F.least(F.floor(F.col("rank") * SPLIT), F.lit(SPLIT - 1)))
    return rows.withColumn("b2", F.least(F.floor((F.col("rank") * SPLIT - F.col("b1")) * SPLIT), F.lit(SPLIT - 1)))


HERE = ("rank", "doc_id", "size")


def _cut(rows: DataFrame, by: list[str], amount: str) -> DataFrame:
    """Where ``want`` (a column, alike within ``by``) of ``amount`` is reached in order of rank.

    One row per ``by`` that has more: rank intervals c1 and c2, the last entry that fits (null: none there), what is
    missing after it (gap), and the entry after it with its rows (next, m)."""

    def inside(sums: DataFrame, bucket: str, more: list) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        at = sums.withColumn("before", F.coalesce(F.sum("sum").over(w), F.lit(0))).where("before <= want and before + sum > want")
        return at.groupBy(*by).agg(F.min(bucket).alias(bucket), F.min(F.col("want") - F.col("before")).alias("want"), *more)

    sums = [F.sum(amount).alias("sum"), F.first("want").alias("want")]
    cut1 = inside(rows.groupBy(*by, "b1").agg(*sums), "b1", [])
    rows = rows.drop("want")
    cut2 = inside(rows.join(cut1, [*by, "b1"]).groupBy(*by, "b2").agg(*sums, F.first("b1").alias("b1")), "b2", [F.min("b1").alias("b1")])
    edge = rows.join(cut2, [*by, "b1", "b2"]).groupBy(*by, "b1", "b2", *[c for c in HERE if c not in by]).agg(F.count("*").alias("m"), F.sum(amount).alias("sum"), F.first("want").alias("want"))
    order = Window.partitionBy(*by).orderBy(*HERE)
    edge = edge.withColumns({"upto": F.sum("sum").over(order), "here": F.struct(*HERE)})
    fits, beyond = F.col("upto") <= F.col("want"), F.col("upto") > F.col("want")
    found = edge.groupBy(*by).agg(
        F.first("b1").alias("c1"), F.first("b2").alias("c2"), F.max(F.when(fits, F.col("here"))).alias("last"),
        (F.first("want") - F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0))).alias("gap"), F.min(F.when(beyond, F.struct("here", "m"))).alias("next"),
    )
    return found.select(*by, "c1", "c2", "last", "gap", F.col("next.here").alias("next"), F.col("next.m").alias("m"))


def _reached(c1: str, c2: str, last: str) -> Column:
    """Whether a row that can be drawn lies before a cut. No cut: it does."""
    here = F.struct(*HERE)
    inside = F.coalesce(here <= F.col(last), F.lit(False))
    b1, b2 = F.col("b1"), F.col("b2")
    return F.when(F.col(c1).isNull(), True).when(b1 != F.col(c1), b1 < F.col(c1)).when(b2 != F.col(c2), b2 < F.col(c2)).otherwise(inside)


def _within() -> Column:
    """Whether a row lies before its source's cut."""
    return F.col("rank").isNotNull() & (F.col("want") > 0) & _reached("c1", "c2", "last")


def _cuts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per source: words wanted and the cut in its ranking. One row per source and size that fills what is
    missing after it: how many rows (n), and where they are not all (m), the cut in their ranking."""
    certain = rows.groupBy("sid").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"), F.first("target").alias("target"))
    wanted = written(certain.select("sid", F.greatest(F.lit(0.0), F.col("target") - F.col("certain")).alias("want")), "mix-wanted")
    drawn = rows.where("rank is not null").join(wanted, "sid")
    cuts = written(wanted.join(_cut(drawn, ["sid"], "size").drop("next", "m"), "sid", "left"), "mix-cuts")
    beyond = rows.where("rank is not null and size > 0").join(cuts.where("gap >= 1"), "sid").where(~_within() & (F.col("size") <= F.col("gap")))
    sizes = beyond.groupBy("sid", "size").agg(F.count("*").alias("m"), F.first("gap").alias("gap"))
    # At most one source's distinct sizes below the gap, which is below one document's words.
    sizes = sizes.groupBy("sid").agg(F.first("gap").alias("gap"), F.reverse(F.array_sort(F.collect_list(F.struct("size", "m")))).alias("sizes"))
    take = "least(x.m, cast(floor(a.gap / x.size) as bigint))"
    step = f"""aggregate(sizes, named_struct('gap', gap, 'out', cast(array() as array<struct<size:bigint,n:bigint,m:bigint>>)), (a, x) ->
        IF(x.size <= a.gap, named_struct('gap', a.gap - {take} * x.size, 'out', array_append(a.out, named_struct('size', x.size, 'n', {take}, 'm', x.m))), a)).out"""
    fills = written(sizes.select("sid", F.explode(F.expr(step)).alias("x")).select("sid", "x.*"), "mix-fills")
    some = fills.where("n < m").select("sid", "size", F.col("n").cast("double").alias("want"))
    found = _cut(beyond.drop("want", "c1", "c2", "last", "gap").withColumn("one", F.lit(1)).join(some, ["sid", "size"]), ["sid", "size"], "one")
    found = found.select("sid", "size", *[F.col(c).alias(f"f_{c}") for c in ("c1", "c2", "last", "next")], F.col("gap").cast("long").alias("f_n"))
    return cuts, written(fills.select("sid", "size", F.lit(True).alias("filled")).join(found, ["sid", "size"], "left"), "mix-fills")


def _decided(docs: DataFrame, weights: list[float], cap: float, seed: int, key: str, text: str, source: str) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame]]:
    """Slim rows of all documents, the plan per source and length class, the cuts per source and the sizes that fill."""
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), F.spark_partition_id().alias("part"))
    base = written(_prepared(base, "source", "size", seed), "mix-base")
    kinds = base.groupBy("source", "sid", "kind").agg(F.sum("size").alias("words"))
    targets = source_targets(kinds.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    targets = targets.withColumn("sid", F.xxhash64(F.col("source").isNull(), "source")).drop("source")
    parts = kinds.drop("source").withColumn("g", F.col("kind") + 1.0)
    parts = _level(parts.join(targets, "sid"), ["sid"], "target", "words", "g", cap, "c")
    f = F.least(F.lit(cap), F.col("c") * F.col("g"))
    plan = written(parts.select("sid", "kind", "source_size", "target", f.alias("f")), "mix-plan")
    base = base.drop("source")
    return base, plan, _cuts(_ranked(base, plan))


def _copied(rows: DataFrame, cuts: tuple[DataFrame, DataFrame], part: str) -> DataFrame:
    """``rows`` (of :func:`_ranked`) with ``copies``. Rows alike of which only some are taken are numbered:
    within each value of ``part``, a partition of the input, and from how many the others before it hold."""
    names = rows.columns
    rows = rows.join(cuts[0], "sid").join(cuts[1], ["sid", "size"], "left")
    filling = F.coalesce(F.col("filled"), F.lit(False)) & F.col("rank").isNotNull() & ~_within()
    own = F.col("whole") + (_within() | (filling & _reached("f_c1", "f_c2", "f_last"))).cast("long")
    if cuts[1].where("f_n > 0").isEmpty():
        return rows.select(*names, own.alias("copies"))
    next_ = F.col("f_next")
    same = (next_["rank"] == F.col("rank")) & next_["doc_id"].eqNullSafe(F.col("doc_id")) & (F.col("f_n") > 0)
    some = filling & F.coalesce(same, F.lit(False))
    alike = rows.where(some)
    counts = alike.groupBy("sid", *HERE, part).agg(F.count("*").alias("_held"))
    before = F.coalesce(F.sum("_held").over(Window.partitionBy("sid", *HERE).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(c).alias(f"_{c}") for c in ("sid", *HERE, part)], before.alias("_before"))
    number = F.col("_before") + F.row_number().over(Window.partitionBy("sid", *HERE, part).orderBy("size"))
    alike = alike.join(counts, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("sid", *HERE, part)])).select(*names, (F.col("whole") + (number <= F.col("f_n")).cast("long")).alias("copies"))
    return rows.where(~some).select(*names, own.alias("copies")).unionByName(alike)


def mix(docs: DataFrame, weights: list[float], cap: float = 3.0, seed: int = 17, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: one row per row of ``docs``."""
    base, plan, cuts = _decided(docs, weights, cap, seed, key, text, source)
    out = _copied(_ranked(base, plan), cuts, "part")
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights: list[float], cap: float = 3.0, seed: int = 17, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` itself in the mix: rows not taken go, rows taken several times are repeated.

    Every row is decided from its own columns and its source's few rows of plan and cuts, so the texts
    are not exchanged while those tables are small enough to be sent (Spark decides by their size). Only
    rows alike at a source's cut are, to be numbered.
    """
    _, plan, cuts = _decided(docs, weights, cap, seed, key, text, source)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(source).alias("_source"), word_count(text).alias("size"), F.spark_partition_id().alias("part"))
    taken = _copied(_ranked(_prepared(rows, "_source", "size", seed), plan), cuts, "part").where("copies > 0 and size > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
