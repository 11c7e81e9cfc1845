"""Mixing of sources to target weights by hierarchical budgeting.

The rows form a tree (for example domain, language, source). A node's weight is its share of
its parent. Budgets go down the tree: among siblings each takes min(capacity, level * weight),
where the level is the one that spends the parent's budget. So what one child cannot supply
goes to its siblings first, and only what a whole subtree lacks goes to the siblings of its
ancestor. Capacity is tokens times the greatest number of epochs.

A leaf with budget b and t tokens takes b div t whole epochs and, of one more epoch in a
seeded order, the documents up to the token where the rest is spent. The prefix is found from
sums per hash bucket; only the bucket in which it ends is sorted, so no task holds a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dexspark.llm.common import materialise

#: Rows that a bucket of the seeded order holds about, and most buckets of a leaf.
PER_BUCKET, MOST_BUCKETS = 2048, 1 << 20


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(right, match).drop(*[f"_r_{k}" for k in keys])


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, DataFrame], total: Column, epochs: int) -> DataFrame:
    """(levels..., tokens, budget): the tokens to draw from each leaf (levels..., tokens).

    weights may hold, for a level, a table (level, weight) with one row per value; other values
    weigh 1, and weights of 0 or less get nothing. total is an aggregate over the leaves.
    """
    leaves = leaves.select(*levels, "tokens", (F.col("tokens") * epochs).alias("_cap"))
    down = leaves.agg(F.floor(F.coalesce(total, F.lit(0))).cast("long").alias("_budget"))
    for depth, level in enumerate(levels):
        parents, path = levels[:depth], levels[: depth + 1]
        nodes = leaves.groupBy(*path).agg(F.sum("_cap").alias("_cap"))
        weight = F.lit(None).cast("double")
        if level in weights:
            given = weights[level].select(F.col(level).alias("_value"), F.col("weight").cast("double").alias("_given"))
            nodes, weight = nodes.join(given, F.col(level).eqNullSafe(F.col("_value")), "left"), F.col("_given")
        nodes = nodes.select(*path, "_cap", F.greatest(F.coalesce(weight, F.lit(1.0)), F.lit(0.0)).alias("_w"))
        nodes = _join(nodes, down, parents) if parents else nodes.crossJoin(F.broadcast(down))  # down is one row
        sibling = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
        filled = sibling.orderBy((F.col("_w") == 0).cast("int"), F.col("_cap") / F.when(F.col("_w") > 0, F.col("_w")), level)
        before = F.coalesce(F.sum("_cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        after = F.sum("_w").over(filled.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        nodes = nodes.withColumn("_level", (F.col("_budget") - before) / F.when(after > 0, after))
        full = F.col("_cap") <= F.col("_w") * F.col("_level")
        nodes = nodes.withColumn("_open", F.max(F.when(~full & (F.col("_w") > 0), F.col("_level"))).over(sibling))
        share = F.when(F.col("_w") <= 0, F.lit(0)).when(full | F.col("_open").isNull(), F.col("_cap")).otherwise(F.floor(F.col("_w") * F.col("_open")))
        # written, as every level is planned on the one above it
        down = materialise(nodes.select(*path, F.greatest(F.least(share, F.col("_cap")), F.lit(0)).cast("long").alias("_budget")))
    return _join(leaves, down, levels).select(*levels, "tokens", F.col("_budget").alias("budget"))


def mix(docs: DataFrame, levels: list[str], weights: dict[str, DataFrame], share: float, epochs: int = 1, seed: int = 0) -> DataFrame:
    """(doc_id, levels..., tokens, whole_epochs, last_tokens) of the rows of docs that are drawn.

    docs has doc_id, the level columns and tokens; other columns are ignored. share is the
    budget as a part of all tokens. last_tokens is how many of the row's tokens the last, partial
    epoch takes. Rows that are drawn neither way are left out. A null level value is a node of
    its own; null or negative token counts are 0, and rows without tokens are never drawn. Ties
    of the seeded order go to the smaller doc_id; repeated rows are drawn one by one. An empty table
    gives no rows.
    """
    count = F.greatest(F.coalesce(F.col("tokens").cast("long"), F.lit(0)), F.lit(0))
    keys = [f"_k{n}" for n in range(len(levels))]
    docs = docs.select("doc_id", *[F.col(c).alias(k) for c, k in zip(levels, keys, strict=True)], count.alias("_t")).filter("_t > 0")
    leaves = materialise(docs.groupBy(*keys).agg(F.sum("_t").alias("tokens"), F.count("*").alias("_rows")))
    named = {k: weights[c].withColumnRenamed(c, k) for c, k in zip(levels, keys, strict=True) if c in weights}
    plan = materialise(_join(budgets(leaves, keys, named, F.sum("tokens") * F.lit(share), epochs), leaves.select(*keys, "_rows"), keys).select(
        *keys,
        F.expr("cast(budget div tokens as int)").alias("whole_epochs"),
        (F.col("budget") % F.col("tokens")).alias("_rest"),
        F.least(F.greatest(F.ceil(F.col("_rows") / PER_BUCKET), F.lit(1)), F.lit(MOST_BUCKETS)).cast("long").alias("_buckets"),
    ))
    rows = _join(docs, plan, keys).filter("whole_epochs > 0 or _rest > 0")
    # 48 bits of a hash that other engines have too give the order of the partial epoch
    spread = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole_epochs"), F.col("doc_id"))), 1, 12), 16, 10).cast("long")
    rows = materialise(rows.withColumn("_at", spread).withColumn("_bucket", F.shiftright(F.shiftright("_at", 16) * F.col("_buckets"), 32)))
    run = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("_t").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(run), F.lit(0)))
    rows = _join(rows, sums, [*keys, "_bucket"])
    cut = (F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_sum") > F.col("_rest"))
    whole = rows.filter(~cut).withColumn("last_tokens", F.when(F.col("_before") < F.col("_rest"), F.col("_t")).otherwise(F.lit(0)))
    order = Window.partitionBy(*keys, "_bucket").orderBy("_at", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.col("_rest") - F.col("_before") - F.coalesce(F.sum("_t").over(order), F.lit(0))
    parted = rows.filter(cut).withColumn("last_tokens", F.greatest(F.least(taken, F.col("_t")), F.lit(0)))
    drawn = whole.unionByName(parted).filter("whole_epochs > 0 or last_tokens > 0")
    return drawn.select("doc_id", *[F.col(k).alias(c) for c, k in zip(levels, keys, strict=True)], F.col("_t").alias("tokens"), "whole_epochs", F.col("last_tokens").cast("long").alias("last_tokens"))
