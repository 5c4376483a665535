"""URL filters: allow and block rules for hosts with their subdomains and for paths, by a sort-merge range join.

A rule (host, path, verdict) fits its host and all subdomains where the url's path starts with the rule's path. Hosts are
reversed by label, so that a rule is one prefix, that is, one interval of canonical keys (``net.example.//en/``), and intervals
either nest or are apart. A sweep over the sorted keys keeps the stack of the nested rules that are open; a url, entered with one
key per level of its host (as deep as rules go), finds its innermost rule of that level on top of the stack. The longest wins: the longest host first, then the longest path.

Null urls and urls without ``://`` have an empty host and path. Null hosts and paths of rules count as empty. Of rules with the same
host and path ``block`` wins over ``allow``. Repeated urls are judged once and keep their rows. Without rules every url gets the
default verdict; an empty table of urls gives no rows.

Everything here is DataFrame functions. Different urls only are swept; a url that holds many rows is joined back by broadcast (at most
``HOT`` such), and equal keys that would fill a range are dealt over several, with the stack carried from range to range.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeline.llm.common import Scratch

#: rules whose stacks are made in one fold
BLOCK = 512
#: urls with more than this share of all rows are joined back by broadcast, so there are at most as many
HOT = 1000
#: keys of one range of the sweep
RANGE = 1_000_000


def lowered(text: Column) -> Column:
    """Only A-Z are lowered."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered. Path: then up to ``?``, ``#`` or the end."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, parts, k), F.lit(""))
    return lowered(part(1)), part(2)


def _levels(host: Column, deepest: Column | int) -> Column:
    """Reversed names from the top to the host, at most ``deepest``: net./, net.example./, … A path follows the ``/``, which no host holds."""
    labels = F.reverse(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))), lambda k: F.concat(F.array_join(F.slice(labels, 1, k), "."), F.lit("./")))


def rule_stacks(rules: DataFrame, scratch: Scratch) -> DataFrame:
    """key, stack for every different rule: the open rules, outermost first, right behind the rule's start.

    Blocks of sorted rules are folded with one stack each. What is open at the start of a block are those rules that are
    prefixes of its first key, found by an equality join.
    """
    clean = rules.select(lowered(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("verdict"))
    key = F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit("./"), "path").alias("key")
    # "block" sorts behind "allow"
    one = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(key, F.concat("host", "path").alias("rule"), "verdict")
    parts = one.count() // BLOCK + 1
    blocks = scratch.keep(one.repartitionByRange(parts, "key").select(F.struct("key", "rule", "verdict").alias("e"), F.spark_partition_id().alias("block")))
    lists = blocks.groupBy("block").agg(F.array_sort(F.collect_list("e")).alias("es"))
    first = F.col("es")[0]["key"]
    prefixes = F.transform(F.sequence(F.lit(1), F.length(first)), lambda k: F.substr(first, F.lit(1), k))
    above = (lists.select("block", first.alias("first"), F.explode(prefixes).alias("key")).filter("key <> first")
             .join(blocks.select(F.col("e.key").alias("key"), "e"), "key").groupBy("block").agg(F.array_sort(F.collect_list("e")).alias("opened")))

    def push(state: Column, e: Column) -> Column:
        stack = F.concat(F.filter(state["stack"], lambda s: F.startswith(e["key"], s["key"])), F.array(e))
        return F.struct(stack.alias("stack"), F.concat(state["out"], F.array(F.struct(e["key"].alias("key"), stack.alias("stack")))).alias("out"))

    entry = "struct<key:string,rule:string,verdict:string>"
    opened = F.coalesce("opened", F.array().cast(f"array<{entry}>"))
    start = F.struct(opened.alias("stack"), F.array().cast(f"array<struct<key:string,stack:array<{entry}>>>").alias("out"))
    folded = lists.join(above, "block", "left").select(F.explode(F.aggregate("es", start, push, lambda s: s["out"])).alias("o"))
    return folded.select("o.key", "o.stack")


def sweep(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """``keys`` (key and more columns) with ``hit``: the innermost rule (key, rule, verdict) that is a prefix of the key, or null.

    Rules and keys are sorted together by range. Within a range the stack of the rule last passed stands at every key; at the start of a
    range it is the last one of the ranges before.
    """
    scratch = Scratch(keys.sparkSession)
    stacks = scratch.keep(rule_stacks(rules, scratch))
    starts = stacks.select("key", F.lit(0).alias("kind"), "stack")
    both = keys.withColumn("kind", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    parts = max(keys.sparkSession.sparkContext.defaultParallelism, keys.count() // RANGE + 1)
    order = ["key", "kind", *[c for c in keys.columns if c != "key"]]
    dealt = scratch.keep(both.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()))
    # one row per range
    last = dealt.groupBy("range").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("stack"))
    carried = last.select("range", F.last("stack", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("stack"))
    events = dealt.unionByName(carried.filter("stack IS NOT NULL").withColumn("kind", F.lit(-1)).withColumn("key", F.lit("")), allowMissingColumns=True)
    running = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    innermost = F.try_element_at(F.filter("stack", lambda e: F.startswith(F.col("key"), e["key"])), F.lit(-1))
    return events.withColumn("stack", F.last("stack", ignorenulls=True).over(running)).filter("kind = 1").withColumn("hit", innermost).drop("kind", "range", "stack")


def judged(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All columns of ``urls`` as struct ``row``, with host, path, rule (host and path, null if none fits) and verdict."""
    scratch = Scratch(urls.sparkSession)
    host, path = host_and_path(F.col("u"))
    rows = urls.select(F.struct("*").alias("row"), F.col(f"`{url}`").cast("string").alias("u")).select("row", host.alias("host"), path.alias("path"))
    deepest = rules.agg(F.max(F.size(F.split(F.coalesce("host", F.lit("")), r"\.")))).first()[0] or 0
    different = scratch.keep(rows.groupBy("host", "path").agg(F.count("*").alias("n")))
    keys = (different.select("host", "path", F.posexplode(_levels(F.col("host"), max(deepest, 1))).alias("level", "name"))
            .select(F.concat("name", "path").alias("key"), "host", "path", "level"))
    hits = sweep(keys, rules).filter("hit IS NOT NULL").groupBy("host", "path").agg(F.max_by("hit", "level").alias("hit"))
    verdicts = scratch.keep(different.join(hits, ["host", "path"], "left").select("host", "path", "n", "hit.rule", "hit.verdict"))
    total = verdicts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(verdicts.filter(F.col("n") * HOT > total).drop("n"))  # fewer than HOT rows
    many = rows.join(hot, ["host", "path"])
    few = rows.join(hot, ["host", "path"], "left_anti").join(verdicts.filter((F.col("n") * HOT <= total) & F.col("rule").isNotNull()).drop("n"), ["host", "path"], "left")
    return many.unionByName(few).select("row", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
