"""Mixing sources to target weights by entropy balancing.

Each document gets a rate; among all rates that give every source its target of words, the
ones nearest to the base rates in relative entropy are an exponential tilt of them,
rate = min(cap, base * exp(lambda of its source)). The lambdas solve a convex dual; a Newton
iteration is one grouped sum over the documents' histogram. Rates are then rounded into whole
copies: the histogram of a source (distinct sizes, largest first) carries its rounding error
along, so that a source ends within half of its smallest document or so, and which documents
of one size get the further copy goes by a hash of their id, found by counts, so that no
group of equal documents has to be in one task.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating; they share all words by
weight, stop at `cap` times their source's words, and the excess is shared again.

Defined results: null or empty texts have size 0 and take nothing; rows that repeat an id are
rows of their own; of equal rows as many get one copy more as their source needs, so equal rows
may take different copies; a null source is a source, the last one; no rows, no result. A kept
column with the name of a result column is called keep_ and that name; rows that differ in
columns of map type alone count as equal.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, kept_names

#: A bucket of equal documents that is ranked in one task has about so many.
RANKED = 2000


def word_count(text):
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_order(sources: DataFrame, parts: int = 32) -> DataFrame:
    """source, rank from 0 by code point, null last; ranges are ranked apart and then moved up."""
    spread = sources.repartitionByRange(parts, F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    placed = cut(spread.withColumn("part", F.spark_partition_id()))
    counts = {r.part: r["count"] for r in placed.groupBy("part").count().collect()}  # `parts` rows at most
    before, moved = 0, []
    for p in sorted(counts):
        moved += [F.lit(p), F.lit(before)]
        before += counts[p]
    up = F.create_map(*moved)[F.col("part")] if moved else F.lit(0)
    w = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    return placed.withColumn("rank", (F.row_number().over(w) - 1 + up).cast("long")).select("source", "rank")


def targets(sources: DataFrame, cap: float = 3.0, weights: tuple = (1, 2, 3)) -> DataFrame:
    """source, source_size, target: shares by weight that stop at cap * source_size."""
    order = source_order(sources.select("source")).withColumnRenamed("source", "s2")
    ranked = cut(sources.join(order, F.col("source").eqNullSafe(F.col("s2"))).drop("s2").withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:  # words a unit of weight gets; more sources reach their cap as it rises
        full = F.col("w") * level >= F.col("source_size") * cap if level else F.lit(False)
        capped, open_w, n = ranked.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size") * cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0)),
            F.count("*"),
        ).first()
        rise = (total - capped) / open_w if open_w else level
        if not n or rise <= level * (1 + 1e-15):
            break
        level = rise
    return ranked.withColumn("target", F.least(F.col("w") * level, F.col("source_size") * cap)).select("source", "source_size", "target")


def balance(hist: DataFrame, goal: DataFrame, cap: float, tolerance: float = 1e-9, rounds: int = 60) -> DataFrame:
    """source, lam: Newton on the dual; hist has source, size, base, n, and goal source, target."""
    state = goal.filter("target > 0").withColumn("lam", F.lit(0.0))
    for _ in range(rounds):
        rated = hist.join(state.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).withColumn("e", F.col("base") * F.exp("lam"))
        words = F.col("n") * F.col("size")
        sums = rated.groupBy("source", "target", "lam").agg(
            F.sum(words * F.least("e", F.lit(cap))).alias("got"),
            F.sum(words * F.when(F.col("e") < cap, F.col("e")).otherwise(0.0)).alias("slope"),
        )
        off = F.abs(F.col("target") - F.col("got")) > F.col("target") * tolerance
        newton = (F.col("target") - F.col("got")) / F.col("slope")
        # where every rate is at the cap, the dual is flat: scale back below it
        step = F.when(off & (F.col("slope") > 0), newton).when(off & (F.col("got") > F.col("target")), F.log(F.col("target") / F.col("got"))).otherwise(0.0)
        sums = cut(sums.select("source", "target", (F.col("lam") + F.greatest(F.lit(-3.0), F.least(F.lit(3.0), step))).alias("lam"), F.abs(step).alias("moved")))
        moved = sums.agg(F.max("moved")).first()[0] or 0.0
        state = sums.drop("moved")
        if moved < 1e-9:
            break
    return state.select("source", "lam")


def mix(docs: DataFrame, cap: float = 3.0, weights: tuple = (1, 2, 3), base: str | None = None, keep: tuple = (), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, rate, copies, taken; and the columns in `keep`."""
    held = [F.col(c).alias(f"keep_{c}") for c in keep]
    kinds = dict(docs.dtypes)
    plain = [c for c in keep if "map<" not in kinds[c] and "variant" not in kinds[c]]
    # the order of documents does not depend on what is kept; only rows that repeat an id and text are told apart by it
    apart = F.xxhash64(*[F.col(c) for c in plain]).bitwiseAND(F.lit(0xFFFF)) if plain else F.lit(0).cast("long")
    order = F.xxhash64(F.col(doc_id), F.lit("mix"), F.col(text)).bitwiseAND(F.lit(-65536)).bitwiseOR(apart)
    one = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"),
        (F.col(base).cast("double") if base else F.lit(1.0)).alias("base"), order.alias("h"), *held,
    )
    light = cut(one.drop(*[f"keep_{c}" for c in keep]))
    hist = cut(light.groupBy("source", "size", "base").agg(F.count("*").alias("n")))
    sizes = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goal = cut(targets(sizes, cap, weights))
    lam = balance(hist.filter("size > 0"), goal, cap)
    rated = (
        hist.join(goal.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
        .join(lam.withColumnRenamed("source", "s3"), F.col("source").eqNullSafe(F.col("s3")), "left").drop("s3")
        .withColumn("rate", F.when(F.col("size") > 0, F.least(F.col("base") * F.exp("lam"), F.lit(cap))).otherwise(0.0)).fillna(0.0, ["rate"])
    )

    most = math.floor(cap)

    def rounded(pdf: pd.DataFrame) -> pd.DataFrame:
        """The error so far, in words, is passed on from larger to smaller documents of a source."""
        pdf = pdf.sort_values(["size", "base"], ascending=[False, True], kind="stable").reset_index(drop=True)
        carried, low, extra = 0.0, [], []
        for size, n, rate in zip(pdf["size"], pdf["n"], pdf["rate"]):
            floor = min(int(rate + 1e-9), most)
            frac = max(0.0, rate - floor)
            upper = n if floor < most else 0
            k = min(upper, max(0, round(n * frac + carried / size))) if size else 0
            carried += size * (n * frac - k)
            low.append(floor)
            extra.append(k)
        return pdf.assign(low=low, extra=extra)[["source", "size", "base", "n", "source_size", "target", "rate", "low", "extra"]]

    plan = cut(rated.select("source", "size", "base", "n", "source_size", "target", "rate").groupBy("source").applyInPandas(
        rounded, "source string, size long, base double, n long, source_size long, target double, rate double, low long, extra long"))

    # -- which of the documents of one size get one copy more: the `extra` smallest hashes of n, by counts of hash buckets and of hashes
    p = plan.select(F.col("source").alias("s2"), F.col("size").alias("z2"), F.col("base").alias("b2"), "n", "source_size", "target", "rate", "low", "extra")
    like = lambda s, z, b: F.col("source").eqNullSafe(F.col(s)) & (F.col("size") == F.col(z)) & F.col("base").eqNullSafe(F.col(b))
    bucket = F.floor((F.shiftrightunsigned("h", 1) / F.lit(float(1 << 63))) * F.ceil(F.col("n") / RANKED)).cast("long")
    group = ["s2", "z2", "b2"]
    split = light.join(p.filter("extra > 0 and extra < n").select(*group, "n", "extra"), like(*group)).withColumn("bucket", bucket)
    counts = cut(split.groupBy(*group, "extra", "bucket").agg(F.count("*").alias("m")))
    upto = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    at = counts.withColumn("before", F.coalesce(F.sum("m").over(upto), F.lit(0))).filter("before < extra and before + m >= extra")
    at = cut(at.select(F.col("s2").alias("s4"), F.col("z2").alias("z4"), F.col("b2").alias("b4"), F.col("bucket").alias("edge"), (F.col("extra") - F.col("before")).alias("left")))
    in_edge = split.join(at, like("s4", "z4", "b4") & (F.col("bucket") == F.col("edge")))
    # equal rows share a hash: they are one row with a count here
    hashes = in_edge.groupBy("s4", "z4", "b4", "edge", "left", "h").agg(F.count("*").alias("m"))
    here = F.sum("m").over(Window.partitionBy("s4", "z4", "b4").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    limit = hashes.withColumn("upto", here).filter("upto >= left and upto - m < left")
    limit = cut(limit.select("s4", "z4", "b4", "edge", F.col("h").alias("limit"), (F.col("left") - F.col("upto") + F.col("m")).alias("of_equal"), F.col("m").alias("equal")))
    out = one.join(p, like(*group)).drop(*group).join(limit, like("s4", "z4", "b4"), "left").drop("s4", "z4", "b4").withColumn("bucket", bucket)
    some = F.col("extra").between(F.lit(1), F.col("n") - 1)
    part = F.coalesce(some & (F.col("h") == F.col("limit")) & (F.col("of_equal") < F.col("equal")), F.lit(False))
    chosen = F.when(~some, F.col("extra") > 0).otherwise((F.col("bucket") < F.col("edge")) | ((F.col("bucket") == F.col("edge")) & (F.col("h") <= F.col("limit"))))
    out = out.withColumn("part", part)
    result = lambda rows, more: rows.select(
        "doc_id", "size", "source_size", "target", "rate", (F.col("low") + more.cast("long")).alias("copies"), ((F.col("low") + more.cast("long")) * F.col("size")).alias("taken"),
        *[F.col(f"keep_{c}").alias(name) for c, name in kept_names(keep, _RESULT)],
    )
    whole = result(out.filter("not part"), F.coalesce(chosen, F.lit(False)))
    if limit.filter("of_equal < equal").isEmpty():
        return whole
    # -- of equal rows a number gets one more: each part of them is told how many came before it, then gives its rows out again
    fixed = ["doc_id", "source", "size", "base", "h", "source_size", "target", "rate", "low", "of_equal", "task"]
    tied = out.filter("part").withColumn("task", F.spark_partition_id())
    same = [f"keep_{c}" for c in plain]
    tied = cut(tied.groupBy(*fixed, *same).agg(F.count("*").alias("times"), *[F.any_value(f"keep_{c}").alias(f"keep_{c}") for c in keep if c not in plain]))
    before = F.sum("times").over(Window.partitionBy("source", "size", "base", "h").orderBy("task", F.xxhash64(F.lit(0), *same)).rowsBetween(Window.unboundedPreceding, -1))
    tied = tied.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return whole.unionByName(result(tied, F.col("before") + F.col("k") <= F.col("of_equal")))


_RESULT = ("doc_id", "size", "source_size", "target", "rate", "copies", "taken")
