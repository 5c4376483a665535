"""Source divergence audit: how far the term shares of each source are from those of the other sources of its language.

Kept terms of a language (in at least ``min_docs`` of its documents) are numbered in byte order; the counts of a group (language, source)
are the leaves of a segment tree over these numbers. Trees are hash-consed: equal subtrees of counts are one node, whichever group they
come from. Two trees are walked together from their roots, level by level; pairs of nodes that were met before are merged with their
number of occurrences, so that each pair is priced once, at the end per pair of counts. Walking a group's tree along the language's
tree, without the empty subtrees, gives the terms that the group overuses.

A task holds one segment of ``SEGMENT`` term numbers for two blocks of about ``GROUPS`` sources, never a whole language; sums of segments
are added up by Spark. Prices are exact integers.

Null text, lang and source count as ''. Texts without terms and repeated rows count as documents. Groups without terms are compared
with zero counts; a language without kept terms has distance 0 everywhere. An empty table gives no rows. Ties rank by the bytes of the item.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from gaugeline.llm.common import Scratch, ranked
from gaugeline.llm.importance import pieces

SCALE = 1_000_000_000
#: term numbers of one task, a power of two
SEGMENT = 4096
#: sources of a block, on average
GROUPS = 24
#: rows that a task collects before it passes counts on
HELD = 400_000
#: everything but letters is a separator; what is outside ASCII is a letter
_TABLE = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in bytes(range(256)).lower())


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term (null: the group itself), n occurrences, docs with the term; several rows each."""
    rows = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
                            F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def count(batches: Iterable) -> Iterator:
        import pyarrow as pa

        groups: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def flush():
            keys = [(*g, t, n, docs[t]) for g, (all_, docs) in groups.items() for t, n in all_.items()] + [(*g, None, 0, 0) for g in groups]
            cols = list(zip(*keys)) if keys else [()] * 5
            groups.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()))],
                                              ["lang", "source", "term", "n", "docs"])

        held = 0
        for batch in batches:
            for lang, source, text in zip(*batch.columns):
                all_, docs = groups[lang.as_py(), source.as_py()]
                words: Counter = Counter()
                for piece in pieces(text.as_py(), _TABLE):
                    words.update(piece.split())
                before = len(all_)
                all_.update(words)
                docs.update(words.keys())
                held += len(all_) - before
                if held > HELD:
                    yield flush()
                    held = 0
        yield flush()

    return rows.mapInArrow(count, "lang string, source string, term binary, n long, docs long")


def consed(leaves: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Hash-consed trees of all rows of ``leaves`` (a power of two wide): their roots, the nodes of each level from the top down, a node
    being (left child, right child) in one number, and the leaf values. Equal subtrees have one number per level."""
    values, ids = np.unique(leaves, return_inverse=True)
    ids = ids.reshape(leaves.shape).astype(np.int64)
    levels = []
    while ids.shape[1] > 1:
        pair = ids[:, 0::2] << 32 | ids[:, 1::2]
        nodes, ids = np.unique(pair, return_inverse=True)
        ids = ids.reshape(pair.shape).astype(np.int64)
        levels.append(nodes)
    return ids[:, 0], levels[::-1], values


def children(nodes: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.concatenate([nodes[at] >> 32, nodes[at] & 0xFFFFFFFF])


def walked(roots_a: np.ndarray, roots_b: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Walk the trees of many pairs together: (pair, leaf of a, leaf of b, how often) for the different pairs of leaves of each pair."""
    pair, a, b, times = np.arange(len(roots_a)), roots_a, roots_b, np.ones(len(roots_a), dtype=np.int64)
    for nodes in levels:
        pair, a, b, times = np.tile(pair, 2), children(nodes, a), children(nodes, b), np.tile(times, 2)
        wide = int(max(a.max(initial=0), b.max(initial=0))) + 1
        _, first, back = np.unique((pair * wide + a) * wide + b, return_index=True, return_inverse=True)
        times = np.bincount(back, weights=times).astype(np.int64)
        pair, a, b = pair[first], a[first], b[first]
    return pair, a, b, times


def overused(root: int, base: int, levels: list[np.ndarray], values: np.ndarray, p: np.ndarray, q: np.ndarray, top: int) -> list[tuple[int, int]]:
    """(place, price) of the ``top`` leaves whose share is above that of tree ``base``; empty subtrees are not entered."""
    some = [values > 0]
    for nodes in levels[::-1]:
        some.append(some[-1][nodes >> 32] | some[-1][nodes & 0xFFFFFFFF])
    a, b, place = np.array([root]), np.array([base]), np.zeros(1, dtype=np.int64)
    for k, nodes in enumerate(levels):
        a, b, place = children(nodes, a), children(nodes, b), np.concatenate([place * 2, place * 2 + 1])
        go = some[len(levels) - 1 - k][a]
        a, b, place = a[go], b[go], place[go]
    over = some[0][a] & (p[a] > q[b])
    a, b, place = a[over], b[over], place[over]
    worth = price(p[a], q[b])
    best = np.lexsort((place, -worth))[:top]
    return list(zip(place[best].tolist(), worth[best].tolist()))


def shares(values: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / (N + 2 V)) of the leaf values, exact at any size; -1, the padding, has no meaning."""
    return np.array([1 + SCALE * (v + 2) // (total + 2 * kept) if kept else 1 for v in values.tolist()], dtype=np.int64)


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _task(key: tuple, cells: pd.DataFrame, top: int, size: int) -> pd.DataFrame:
    """A segment's part of all distances between two blocks of sources, and in a diagonal task the overused terms of each source."""
    lang, segment, lo, hi = key
    kept, start = int(cells["kept"].iloc[0]), int(segment) * size
    width = min(size, max(kept - start, 0))
    leaves = np.full((len(cells), 1 << max(width - 1, 0).bit_length()), -1, dtype=np.int64)
    leaves[:, :width] = 0
    for k, (ids, counts) in enumerate(zip(cells["ids"], cells["counts"])):
        if ids is not None and len(ids):
            leaves[k, np.asarray(ids)] = counts
    roots, levels, values = consed(leaves)
    p = np.array([shares(values, n, kept) for n in cells["total"].tolist()])
    p[:, values < 0] = 1
    block, whole, source = cells["block"].to_numpy(), cells["whole"].to_numpy(dtype=bool), cells["source"].tolist()
    first, second = np.flatnonzero(~whole & (block == lo)), np.flatnonzero(~whole & (block == hi))
    out = []
    for i in first:
        others = second[second > i] if lo == hi else second
        pair, a, b, times = walked(np.repeat(roots[i], len(others)), roots[others], levels)
        worth = np.zeros(len(others), dtype=np.int64)
        np.add.at(worth, pair, price(p[i][a], p[others[pair], b]) * times)
        out += [(lang, source[i], source[j], None, w) for j, w in zip(others, worth.tolist())]
    if lo == hi and width:
        base = np.flatnonzero(whole)[0]
        for i in first:
            out += [(lang, source[i], None, start + at, w) for at, w in overused(roots[i], roots[base], levels, values, p[i], p[base], top)]
    return pd.DataFrame(out, columns=["lang", "source", "other", "id", "value"]).astype({"id": "Int64"})


def audit(documents: DataFrame, min_docs: int = 10, top: int = 10, segment_size: int = SEGMENT, block_size: int = GROUPS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank: distances to the other sources of the language, and overused terms."""
    scratch = Scratch(documents.sparkSession)
    counts = scratch.keep(term_counts(documents).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    found = counts.filter("term IS NOT NULL")
    vocabulary = found.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("lang", "term", "n")
    numbered = scratch.keep(ranked(vocabulary, scratch, [F.col("lang"), F.col("term")], "place"))
    langs = numbered.groupBy("lang").agg(F.count("*").alias("kept"), F.min("place").alias("head"), F.sum("n").alias("lang_total"))
    terms = scratch.keep(numbered.join(langs.select("lang", "head"), "lang").select("lang", "term", (F.col("place") - F.col("head")).alias("id"), "n"))

    entries = F.sort_array(F.collect_list(F.struct((F.col("id") % segment_size).cast("int").alias("i"), "n")))
    lists = [F.col("e.i").alias("ids"), F.col("e.n").alias("counts")]
    segment = F.floor(F.col("id") / segment_size).alias("segment")
    cells = scratch.keep(found.drop("docs").join(terms.drop("n"), ["lang", "term"]).groupBy("lang", "source", segment).agg(entries.alias("e"), F.sum("n").alias("n"))
                         .select("lang", "source", "segment", "n", *lists))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term IS NULL").select("lang", "source")
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / block_size).alias("blocks"))
    langs = scratch.keep(blocks.join(langs, "lang", "left").select("lang", "blocks", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("lang_total", F.lit(0)).alias("lang_total")))

    grid = (groups.join(langs, "lang").join(totals, ["lang", "source"], "left")
            .select("lang", "source", "kept", F.coalesce("total", F.lit(0)).alias("total"), "blocks", F.pmod(F.xxhash64("source"), "blocks").alias("block"),
                    F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("kept") / segment_size) - 1, F.lit(0)))).alias("segment"))
            .join(cells.drop("n"), ["lang", "source", "segment"], "left")
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("lang", "segment", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "source", "kept", "total", "ids", "counts", F.lit(False).alias("whole")))
    whole = (terms.groupBy("lang", segment).agg(entries.alias("e")).join(langs, "lang")
             .select("lang", "segment", "kept", F.col("lang_total").alias("total"), *lists, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
             .select("lang", "segment", F.col("block").alias("lo"), F.col("block").alias("hi"), "block", F.lit(None).cast("string").alias("source"), "kept", "total", "ids", "counts", F.lit(True).alias("whole")))
    parts = scratch.keep(grid.unionByName(whole).groupBy("lang", "segment", "lo", "hi")
                         .applyInPandas(lambda key, cells: _task(key, cells, top, segment_size), "lang string, source string, other string, id long, value long"))

    here = Window.partitionBy("lang", "source")
    sums = parts.filter("other IS NOT NULL").groupBy("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b")).agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    pairs = both.withColumn("rank", F.row_number().over(here.orderBy(F.col("value").desc(), "item"))).withColumn("part", F.lit("pair"))
    over = parts.filter("id IS NOT NULL").withColumn("rank", F.row_number().over(here.orderBy(F.col("value").desc(), "id"))).filter(F.col("rank") <= top)
    named = over.join(terms.select("lang", "id", F.col("term").cast("string").alias("item")), ["lang", "id"]).withColumn("part", F.lit("term"))
    shown = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*shown).unionByName(named.select(*shown))
