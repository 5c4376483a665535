"""Mixing sources to target weights by minimum-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern; tokens flow from patterns to source
quotas, where the first pass over a pattern's tokens is free and each repetition costs more (convex costs, as one arc per
pass). The flow network has one node per pattern and source, never one per document. Inside a pattern the documents stand in
a seeded hash order; the flow takes that line of tokens from its start, once per pass, and each document is taken as often
as it fits. What is still short of the flow by the end of the line is filled by single documents of the nearest sizes.

Defined results: a null source is a source of its own, after all others; a null text has size 0; documents of size 0 are
taken 0 words. Repeated rows are documents of their own. An empty table gives no rows. Reruns agree (ties go by doc_id, then
by text and row fields, and fully equal rows are interchangeable).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from gaugeline.llm.common import WORD_BREAK, Scratch, columns_of

#: passes over a pattern; the cost of one more pass grows by one
PASSES = 3
#: patterns and sources that the flow on the driver may have; beyond it the operator raises
NODES = 50_000
#: single documents added to a pattern at most; each at least halves what is short where sizes allow
FILL_ROUNDS = 8


def words(text) -> F.Column:
    """Number of words of ``text``; 0 if null."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WORD_BREAK, " "))
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.translate(t, " ", "")) + 1).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = PASSES) -> list[float]:
    """Share ``total`` by weight; none gets more than ``most`` times its size, the excess is shared again by weight."""
    out, open_, rest = [0.0] * len(sizes), [i for i, w in enumerate(weights) if w > 0], float(total)
    while open_:
        share = rest / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * share > most * sizes[i]]
        for i in full or open_:
            out[i] = float(most * sizes[i]) if full else weights[i] * share
        if not full:
            break
        rest -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def route(supply: Sequence[int], members: Sequence[Sequence[int]], quota: Sequence[int], passes: int = PASSES) -> list[dict[int, int]]:
    """Minimum-cost flow of tokens from patterns to sources: per pattern, tokens by source.

    Successive shortest paths; all costs sit on the arcs into patterns, so a shortest path is the cheapest open pass that
    reaches a source with quota left, by way of other patterns if those can be relieved.
    """
    flow: list[dict[int, int]] = [{} for _ in supply]
    used, left = [0] * len(supply), list(quota)
    users: list[set[int]] = [set() for _ in quota]

    def path(start: int) -> list[int] | None:
        """pattern, source, pattern, source … to a source with quota left."""
        seen, todo = {("p", start): None}, deque([("p", start)])
        while todo:
            node = todo.popleft()
            kind, i = node
            if kind == "s" and left[i] > 0:
                out = []
                while node:
                    out.append(node[1])
                    node = seen[node]
                return out[::-1]
            for nxt in ([("s", s) for s in members[i]] if kind == "p" else [("p", p) for p in users[i]]):
                if nxt not in seen:
                    seen[nxt] = node
                    todo.append(nxt)
        return None

    for level in range(passes):
        for p, size in enumerate(supply):
            while used[p] < size * (level + 1) and (way := path(p)):
                steps = list(zip(way[::2], way[1::2]))
                back = [(way[k + 1], way[k]) for k in range(1, len(way) - 1, 2)]
                amount = min([size * (level + 1) - used[p], left[way[-1]], *(flow[q][s] for q, s in back)])
                for q, s in steps:
                    flow[q][s] = flow[q].get(s, 0) + amount
                    users[s].add(q)
                for q, s in back:
                    flow[q][s] -= amount
                    if not flow[q][s]:
                        users[s].discard(q)
                used[p] += amount
                left[way[-1]] -= amount
    return flow


def _line(docs: DataFrame, blocks: int) -> DataFrame:
    """Adds ``before``: the tokens of the same pattern that stand before a row in hash order.

    Sums by block of the hash, then by block of blocks, so no window holds a pattern: one runs over a block's rows, one over
    the blocks of a super-block, one over the super-blocks of a pattern.
    """
    wide = max(1, int(blocks ** 0.5))
    docs = docs.withColumn("b", F.pmod(F.col("h"), F.lit(blocks))).withColumn("sb", F.floor(F.col("b") / wide))
    sums = docs.groupBy("pattern", "sb", "b").agg(F.sum("size").alias("n"))
    tops = sums.groupBy("pattern", "sb").agg(F.sum("n").alias("n"))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("pattern", "sb", F.coalesce(F.sum("n").over(before("pattern", "sb")), F.lit(0)).alias("t0"))
    sums = sums.select("pattern", "sb", "b", F.coalesce(F.sum("n").over(before("pattern", "sb", "b")), F.lit(0)).alias("b0"))
    offsets = sums.join(tops, ["pattern", "sb"]).select("pattern", "b", (F.col("b0") + F.col("t0")).alias("o"))
    inside = Window.partitionBy("pattern", "b").orderBy("h", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    return (docs.withColumn("w", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["pattern", "b"])
            .withColumn("before", F.col("w") + F.col("o")).drop("w", "o", "b", "sb"))


def mix(documents: DataFrame, sources=None, weights: Sequence[float] | None = None, share: float = 1.0, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and ``tie`` (a hash of text and sources) per row of ``documents``.

    ``sources`` is an array column of a document's sources, ``array(source)`` by default. ``weights`` go by source in code
    point order, null last; 1, 2, 3, repeating, by default. ``share`` is the mix's size against the corpus.
    source_size and target are those of the document's first source.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    lean = scratch.keep(_named(documents, sources).select("doc_id", words(F.col("text")).alias("size"), "sources", "tie")
                        .withColumn("pattern", F.to_json(F.struct("sources"), {"ignoreNullFields": "false"})).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "tie")))
    patterns = lean.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("size"), F.count("*").alias("n")).limit(NODES + 1).collect()
    if len(patterns) > NODES:
        raise ValueError(f"more than {NODES} membership patterns")
    patterns.sort(key=lambda r: r.pattern)
    names = sorted({s for r in patterns for s in r.sources}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    source_size = [0] * len(names)
    for r in patterns:
        for s in r.sources:
            source_size[number[s]] += r["size"]
    weights = [k % 3 + 1 for k in range(len(names))] if weights is None else list(weights)
    goal = targets(source_size, weights, sum(r["size"] for r in patterns) * share)
    flow = route([r["size"] for r in patterns], [[number[s] for s in r.sources] for r in patterns], [round(g) for g in goal])

    # one row per pattern, at most NODES: a proven bound for the broadcast
    plan = spark.createDataFrame([(r.pattern, sum(f.values()), r["size"], *((source_size[number[r.sources[0]]], goal[number[r.sources[0]]]) if r.sources else (0, 0.0)))
                                  for r, f in zip(patterns, flow)], "pattern string, flow long, supply long, source_size long, target double")
    # pass k puts a document at before + k * supply; it is taken if it ends within the flow
    whole = F.floor((F.col("flow") - F.col("before") - F.col("size")) / F.col("supply")) + 1
    line = scratch.keep(_line(lean, sum(r.n for r in patterns) // 256 + 1).join(F.broadcast(plan), "pattern").withColumn(
        "copies", F.when(F.col("size") == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(PASSES), whole))).cast("long")))
    scratch.release(lean)
    # what is short of the flow is filled by single documents, each the nearest in size among those this pass left out
    extra: dict[tuple[str, int], int] = {}
    for k in range(FILL_ROUNDS + 1):
        added = spark.createDataFrame([(p, b, 1) for p, b in extra], "pattern string, before long, extra int")
        copies = F.col("copies") + F.when(F.col("size") > 0, F.coalesce(F.col("extra"), F.lit(0))).otherwise(0)
        filled = line.join(F.broadcast(added), ["pattern", "before"], "left").withColumn("copies", copies)
        if k == FILL_ROUNDS:
            break
        short = filled.groupBy("pattern").agg((F.first("flow") - F.sum(F.col("copies") * F.col("size"))).alias("short")).filter("short > 0")
        best = (filled.filter((F.col("copies") < PASSES) & (F.col("copies") <= F.floor(F.col("flow") / F.col("supply"))) & (F.col("size") > 0))
                .join(F.broadcast(short), "pattern").filter("size < 2 * short")
                .groupBy("pattern").agg(F.min(F.struct(F.abs(F.col("size") - F.col("short")).alias("off"), F.col("before"))).alias("best"))
                .select("pattern", "best.before").collect())
        if not best:
            break
        extra |= {(r.pattern, r.before): 1 for r in best}
    return scratch.finish(filled.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "tie"))


def _named(documents: DataFrame, sources) -> DataFrame:
    sources = F.array(F.col("source").cast("string")) if sources is None else sources
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.array_sort(F.array_distinct(sources)).alias("sources"),
                            F.struct("*").alias("row")).withColumn("tie", F.xxhash64("text", "sources"))


def mixed_documents(documents: DataFrame, sources=None, **options) -> DataFrame:
    """The mix itself: the rows of ``documents`` with their columns, each as often as it is taken."""
    taken = mix(documents, sources, **options).groupBy("doc_id", "tie").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).filter("copies > 0")
    rows = _named(documents, sources).select("row", F.col("doc_id").alias("d"), F.col("tie").alias("t"))
    joined = rows.join(taken, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("tie")))
    # equal rows share their copies
    k = F.row_number().over(Window.partitionBy("t", "d").orderBy("t"))
    own = F.floor(F.col("copies") / F.col("rows")) + F.when(k <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    return joined.withColumn("own", own.cast("int")).select("row", F.explode(F.array_repeat(F.lit(1), F.col("own")))).select("row.*")
