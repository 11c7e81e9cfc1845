"""Allow and block rules on urls by a sort-merge range join, in DataFrame functions only.

Method: a host becomes its labels in reverse with a dot after each, so that a rule's host is a
prefix of the keys of all its subdomains, and a prefix is an interval. Where an interval opens,
its rules lie on top of those of the intervals around it; where it closes, they come off. Rules
and urls are sorted together by key over the range partitions of the cluster; the last event
before a url has the stack of rules whose hosts hold it, and the longest of them whose path
starts the url's path judges it.

A partition begins with the stack that the partitions before it leave: one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dexspark.llm.common import materialise

#: Rows of a range partition, about.
PER_PARTITION = 1_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def host_key(host: Column) -> Column:
    """Labels in reverse with a dot after each; the empty host has the empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rule_events(rules: DataFrame) -> DataFrame:
    """(key, stack): where an interval of rules opens or closes, and the rules active from there.

    rules has rule (text such as ``example.com/en/``) and verdict. Of rules of the same text
    the verdict first in the alphabet counts; null and empty rules are left out.
    """
    rules = rules.filter("rule is not null and rule <> '' and verdict is not null").groupBy("rule").agg(F.min("verdict").alias("verdict"))
    host = F.translate(F.substring_index("rule", "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = rules.select(host_key(host).alias("key"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("path"), "rule", "verdict").filter("key <> ''")
    hosts = parts.select("key").distinct()
    # hosts around a host are its shorter prefixes: found by key, as there are as many as labels
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.")
    prefix = F.transform(F.sequence(F.lit(1), F.size("_l")), lambda n: F.concat(F.array_join(F.slice(F.col("_l"), 1, n), "."), F.lit(".")))
    around = hosts.withColumn("_l", labels).select(F.col("key").alias("inner"), F.explode(prefix).alias("key"))
    rule = F.struct(F.length("rule").alias("size"), "rule", "path", "verdict")
    held = around.join(parts, "key").groupBy("inner").agg(F.sort_array(F.collect_list(rule)).alias("stack"))
    outer = around.join(hosts, "key").filter("key <> inner").groupBy("inner").agg(F.max_by("key", F.length("key")).alias("outer"))
    below = held.select(F.col("inner").alias("outer"), F.col("stack").alias("_below"))
    closing = held.join(outer, "inner", "left").join(below, "outer", "left")
    empty = F.expr("filter(stack, x -> false)")
    # '/' follows '.', so it is the first key behind all keys that start with this one
    ends = closing.select(F.concat(F.expr("substring(inner, 1, length(inner) - 1)"), F.lit("/")).alias("key"), F.coalesce("_below", empty).alias("stack"))
    return held.select(F.col("inner").alias("key"), "stack").union(ends)


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict) for every row of urls (key, url).

    The longest rule that fits gives rule and verdict; of equally long ones the last in the
    alphabet. Without one, rule is null and verdict is the default. Hosts are matched by whole
    labels. Null urls have an empty host and path. Urls are judged whole, however long. Repeated rows are judged one by one; other
    columns are ignored. An empty table gives no rows; without rules all have the default.
    """
    host, path = host_and_path(F.col("url"))
    own = urls.select(F.col(key).alias("_id"), host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    events = rule_events(rules).select("key", F.lit(0).alias("kind"), "stack", F.lit(None).cast(dict(own.dtypes)["_id"]).alias("_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    rows = events.unionByName(own.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    count = int(urls.count() // PER_PARTITION) + 1
    parts = max(count, urls.sparkSession.sparkContext.defaultParallelism)
    # kept as written: the partition of a row must not change between the two uses below
    dealt = materialise(rows.repartitionByRange(parts, "key", "kind", "_id").withColumn("part", F.spark_partition_id()))
    left = dealt.filter("kind = 0").groupBy("part").agg(F.max_by("stack", "key").alias("stack"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    every = dealt.groupBy("part").agg(F.lit(1).alias("_one"))
    carried = every.join(left, "part", "left").select("part", F.last("stack", ignorenulls=True).over(before).alias("_carried"))
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = dealt.withColumn("_active", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1")
    active = F.coalesce("_active", "_carried")
    fits = F.filter(active, lambda r: F.startswith(F.col("path"), r["path"]))
    found = swept.join(F.broadcast(carried), "part", "left").withColumn("_rule", F.array_max(fits))
    return found.select(F.col("_id").alias(key), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", F.lit(default)).alias("verdict"))
