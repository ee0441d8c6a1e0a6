"""Exact joins of names by edit similarity, 1 - distance / longer length.

Two names of similarity ``theta`` or more, the longer of n letters, have at least n - (q - 1) - q * (1 - theta) * n grams of
q letters in common (a repeated gram counts as often as it occurs). So in an order that is the same for all names, the rarest
gram first, their prefixes share a gram, and an equi-join on prefix grams finds every pair. Grams of two
letters are used where that number is positive for both names, grams of one letter for shorter names and low similarities. The length filter and the
rule that a pair is taken at its first common gram are in the join's condition, so a pair comes out once and is verified once.

Names are compared as given (normalize them first). A null or empty name is similar to none. Repeated names are pairs
of their own ids. An empty side gives no pairs. Very long names work, at a cost that grows with the square of their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Grams that are broadcast at most (two letters of the 37 that normalized names have, counted up to 30 times each).
FEW = 37 * 37 * 30
SLACK = 1e-9


def grams(name: Column, q: int) -> Column:
    """The grams of ``q`` letters, each with ``q`` and the number of its occurrence: ``2an1``, ``2an2``."""
    plain = F.when(F.length(name) >= q, F.transform(F.sequence(F.lit(1), F.length(name) - q + 1), lambda i: F.substring(name, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))
    seen = lambda all_, g, i: F.size(F.filter(F.slice(all_, F.lit(1), i + 1), lambda x: x == g)).cast("string")
    # one array, named by a lambda, so that it isn't made anew for each gram
    return F.flatten(F.transform(F.array(plain), lambda all_: F.transform(all_, lambda g, i: F.concat(F.lit(str(q)), g, seen(all_, g, i)))))


def ordered_grams(names: DataFrame) -> DataFrame:
    """name and its grams of one and of two letters (g1, g2), the rarest first, for the distinct names of a column ``name``."""
    names = names.select("name").where("name <> ''").distinct()
    every = names.select("name", F.explode(F.concat(grams(F.col("name"), 1), grams(F.col("name"), 2))).alias("gram"))
    counts = every.groupBy("gram").agg(F.count("*").alias("n"))
    counts = F.broadcast(counts) if counts.limit(FEW + 1).count() <= FEW else counts
    ranked = every.join(counts, "gram").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("all"))
    return ranked.select("name", *(F.array_intersect(F.transform("all", lambda s: s["gram"]), grams(F.col("name"), q)).alias(f"g{q}") for q in (1, 2)))


def needed(length: Column, theta: Column, q: int) -> Column:
    """Grams that a name of this length has in common with any name as similar as ``theta``; no bound if not positive."""
    return F.ceil(length * (1 - q * (1 - theta)) - (q - 1) - SLACK)


def prefixes(side: DataFrame, order: DataFrame) -> DataFrame:
    """Rows of (id, name, block, theta) with their prefix for grams of one and of two letters, as ``kind``."""
    x = side.where("name <> ''").join(order, "name").withColumn("len", F.length("name"))
    two = needed(F.col("len"), F.col("theta"), 2)
    # the longest name that has no bound for two letters; longer partners of such names need single letters too
    short = F.when(F.col("theta") > 0.5 + SLACK, F.floor(1 / (2 * F.col("theta") - 1) + SLACK)).otherwise(F.lit(1 << 30))
    by_two = F.when(F.col("len") > short, F.slice("g2", F.lit(1), F.size("g2") - two.cast("int") + 1))
    by_one = F.when(F.col("len") * F.col("theta") <= short + SLACK, F.slice("g1", F.lit(1), F.size("g1") - needed(F.col("len"), F.col("theta"), 1).cast("int") + 1))
    kinds = F.array(F.struct(F.lit(1).alias("kind"), by_one.alias("prefix")), F.struct(F.lit(2).alias("kind"), by_two.alias("prefix")))
    x = x.withColumn("short", short).withColumn("k", F.explode(kinds)).where("k.prefix is not null")
    return x.select("id", "name", "block", "theta", "len", "short", "k.kind", "k.prefix", F.explode("k.prefix").alias("gram"))


def edit_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct pairs (left_id, right_id) of rows of (id, name, block, theta) that are similar in a block.

    ``theta``, over 0 and at most 1, is the same for all rows of a block.
    """
    order = ordered_grams(left.select("name").unionByName(right.select("name")))
    a, b = prefixes(left, order).alias("a"), prefixes(right, order).alias("b")
    near = F.least("a.len", "b.len") >= F.greatest("a.len", "b.len") * F.col("a.theta") - SLACK
    # a pair with a short name meets by single letters only, any other by two
    kind = F.col("a.kind") == F.when(F.least("a.len", "b.len") <= F.col("a.short"), 1).otherwise(2)
    first = F.get(F.array_intersect("a.prefix", "b.prefix"), F.lit(0)) == F.col("a.gram")
    keys = (F.col("a.block") == F.col("b.block")) & (F.col("a.kind") == F.col("b.kind")) & (F.col("a.gram") == F.col("b.gram"))
    pairs = a.join(b, keys & kind & near & first)
    most = F.floor((1 - F.col("a.theta")) * F.greatest("a.len", "b.len") + SLACK).cast("int")
    similar = F.expr("levenshtein(a.name, b.name)") <= most
    return pairs.where(similar).select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id")).distinct()
