"""N-gram Jaccard join: documents link when their sets of five-word shingles overlap by three quarters of their union.

1. Equal sets are one class, known by hash and size, so copies never meet each other.
2. A sketch counts shingles by hash bucket over all documents. Frequent shingles stand last in the order of all shingles.
3. Two linked sets share one of the first n - ceil(3n/4) + 1 shingles in that order. These meet in tiles, one per shingle,
   sorted by set size; a tile of one set is dropped as it is read.
4. Each set is first compared with one centre. A tile proposes the set whose shingles are the most frequent ones: of near
   copies that is the least edited one, to which most others link. That joins nearly all groups.
5. What is left are tiles whose sets are in different groups. In small tiles, pairs are counted: two sets that link share
   more than a few of their first shingles. In large ones, sets go whose place allows no link to a set of another group. A
   set only meets sets of at least three quarters of its size: large tiles are cut into size bands, and bands into blocks.
   The bit counts of hashed bitmaps bound each overlap from above, and only pairs that can still link go on to the exact
   intersection of sorted arrays. A first pass names each set's likeliest mate only; the second all that are still in other
   groups, each pair in the first large tile that both share.

Defined results: null, empty and blank texts have no shingles and link with nothing; a text of fewer than five words is one
shingle. Rows with a null id take part; they show the smallest id they reach, null if none. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from gaugeline.llm.common import Scratch, columns_of, connected, text_mb, tree_sum
from gaugeline.llm.shingles import bitmap, mixed, shingle_sets, signature

CHUNK = 1 << 14
#: shingles that a task holds before it deals them out
HELD = 1 << 20
#: megabytes of text whose first shingles meet in one task
TEXT_MB = 16
#: sets of one tile and band that one task compares with all smaller ones
BLOCK = 1024
#: sets of a tile up to which its pairs are told apart by size and place before bitmaps are fetched
SMALL = 64


def _facts(bits: int):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = np.zeros(1 << bits, dtype=np.int32)

        def count(sets: list[np.ndarray]) -> None:
            places = np.sort((np.concatenate(sets).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int32))
            first = np.flatnonzero(np.concatenate([places[:1] == places[:1], places[1:] != places[:-1]]))
            sketch[places[first]] += np.diff(np.append(first, len(places))).astype(np.int32)

        for frame in frames:
            out, held, size = [], [], 0
            for doc, key, s in zip(frame["doc_id"], frame["key"], shingle_sets(frame["text"])):
                out.append((doc, key, len(s), signature(s), bitmap(s)))
                held.append(s)
                size += len(s)
                if size > HELD:
                    count(held)
                    held, size = [], 0
            if held:
                count(held)
            yield pd.DataFrame(out, columns=["doc_id", "key", "n", "sig", "bits"]).astype({"doc_id": "Int64", "key": "Int64"}).assign(
                chunk=pd.Series([None] * len(out), dtype="Int32"), values=None)
        parts = sketch.reshape(-1, CHUNK)
        held = [k for k in range(len(parts)) if parts[k].any()]
        yield pd.DataFrame({"doc_id": pd.Series([None] * len(held), dtype="Int64"), "key": pd.Series([None] * len(held), dtype="Int64"), "n": 0, "sig": 0, "bits": None,
                            "chunk": pd.Series(held, dtype="Int32"), "values": [zlib.compress(parts[k].tobytes(), 1) for k in held]})
    return run


def _levels(chunks: DataFrame, bits: int) -> np.ndarray:
    """For each hash bucket: 0 for a usual count, else a level that grows with the logarithm of the count."""
    counts, total = np.zeros((1 << bits) // CHUNK * CHUNK, dtype=np.uint32).reshape(-1, CHUNK), 0
    for r in tree_sum(chunks, "<i4", deflated=True).toLocalIterator():
        values = np.frombuffer(r["values"], dtype="<i8")
        total += int(values.sum())
        counts[r.chunk] = np.minimum(values, (1 << 32) - 1)
    mean = total / counts.size
    usual = max(16.0, 3 * mean ** 0.5)  # above the mean: by chance few buckets get there, also those of many shingles
    levels = np.zeros(counts.shape, dtype=np.int8)
    for level, c in zip(levels, counts):  # chunk by chunk: the driver never holds all counts as doubles
        more = c - mean
        level[:] = np.where(more > usual, np.minimum(120, 1 + np.floor(4 * np.log2(np.maximum(more, 1) / usual))), 0)
    return levels.ravel()


ENTRY = {"token": "<i8", "sig": "<i8", "n": "<i4", "p": "<i4", "weight": "<i2"}


def _prefixes(levels: np.ndarray, bits: int, parts: int):
    """The first shingles of each set with their places, dealt by shingle: a row has those of many sets, a column each as bytes."""
    def dealt(tokens, sigs, sizes, weights):
        many = [len(t) for t in tokens]
        token = np.concatenate(tokens)
        columns = [token, np.repeat(sigs, many), np.repeat(sizes, many), np.concatenate([np.arange(m) for m in many]), np.repeat(weights, many)]
        part = ((token & 0xFFFFFFFF) * parts) >> 32
        order = np.argsort(part.astype(np.uint16 if parts < 1 << 16 else np.int64), kind="stable")
        columns = [c[order].astype(kind) for c, kind in zip(columns, ENTRY.values())]
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [(k, *(c[a:b].tobytes() for c in columns)) for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if a < b]
        return pd.DataFrame(rows, columns=["part", *ENTRY])

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = ([], [], [], []), 0
        for frame in frames:
            for s in shingle_sets(frame["text"]):
                n = len(s)
                if not n:
                    continue
                first = n - (3 * n + 3) // 4 + 1
                rank = levels[s.view(np.uint64) >> np.uint64(64 - bits)]
                for column, x in zip(held, (s[np.argsort(rank, kind="stable")[:first]] if rank.any() else s[:first].copy(), signature(s), n, 256 * int(rank.sum(dtype=np.int64)) // n)):
                    column.append(x)
                size += first
                if size > HELD:
                    yield dealt(*held)
                    held, size = ([], [], [], []), 0
        if size:
            yield dealt(*held)
    return run


def _tiles(frame: pd.DataFrame) -> pd.DataFrame:
    """Drops tiles without two sets of fitting size; adds a mate of fitting size to each set.

    That is the tile's set of the greatest weight, or the smallest mate for sets that it does not fit.
    """
    token, sig, n, p, weight = (np.frombuffer(b"".join(frame[c]), dtype=kind) for c, kind in ENTRY.items())
    order = np.lexsort((sig, n, token))
    token, sig, n, p, weight = token[order], sig[order], n[order].astype(np.int64), p[order], weight[order]
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (n[1:] != n[:-1]) | (sig[1:] != sig[:-1])
    token, n, sig, p, weight = token[new], n[new], sig[new], p[new], weight[new]
    run = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]]).astype(np.int64))
    place = (run << 33) + n
    mate = np.searchsorted(place, (run << 33) + (3 * n + 3) // 4)
    paired = np.zeros(int(run[-1]) + 1, dtype=bool)
    paired[run[mate != np.arange(len(mate))]] = True
    centre = np.lexsort((-np.arange(len(run)), weight, run))[np.append(run[1:] != run[:-1], True)][run]
    fits = (4 * np.minimum(n, n[centre]) >= 3 * np.maximum(n, n[centre])) & (centre != np.arange(len(run)))
    mate = np.where(fits, centre, mate)
    k = np.flatnonzero(paired[run])
    return pd.DataFrame({"token": token[k], "sig": sig[k], "n": n[k], "p": p[k], "csig": sig[mate[k]], "cn": n[mate[k]]})


def _items(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sorted shingles of wanted sets; of rows with one id, only those of the wanted set count."""
    for frame in frames:
        out = [(sig, n, s.tobytes()) for sig, n, s in zip(frame["sig"], frame["n"], shingle_sets(frame["text"])) if len(s) == n and signature(s) == sig]
        yield pd.DataFrame(out, columns=["sig", "n", "items"])


@F.pandas_udf(T.BooleanType())
def _linked(a: pd.Series, b: pd.Series) -> pd.Series:
    """Exact: sorted arrays are merged and equal neighbours counted."""
    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x, dtype=np.int64), np.frombuffer(y, dtype=np.int64)
        both = np.sort(np.concatenate([x, y]), kind="stable")
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        out.append(100 * common >= 75 * (len(x) + len(y) - common))
    return pd.Series(out, dtype=bool)


def _whole_tiles(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by token, in frames that never part a tile."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        token = frame["token"].to_numpy()
        cut = int(np.searchsorted(token, token[-1])) if len(token) else 0
        if cut:
            yield frame.iloc[:cut]
        rest = frame.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def _small_pairs(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of small tiles, sorted by token: pairs whose sizes fit and whose groups differ, and whether their places allow the overlap.

    The first shared shingle of a pair stands at p and q of their orders; at most min(n - p, m - q) are shared from there on.
    """
    for frame in _whole_tiles(frames):
        token, n, sig = frame["token"].to_numpy(), frame["n"].to_numpy(np.int64), frame["sig"].to_numpy()
        group, p = frame["component"].to_numpy(), frame["p"].to_numpy(np.int64)
        end, i, found = np.searchsorted(token, token, side="right"), np.arange(len(token)), []
        for step in range(1, len(token)):  # each row with the one so many rows on, as long as that is of its tile
            i = i[end[i] > i + step]
            if not len(i):
                break
            j = i + step
            fits = (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j])) & (group[i] != group[j])
            found.append((i[fits], j[fits]))
        if found:
            i, j = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            swap = (n[i] < n[j]) | ((n[i] == n[j]) & (sig[i] < sig[j]))
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            yield pd.DataFrame({"sig": sig[i], "n": n[i], "csig": sig[j], "cn": n[j], "near": 7 * np.minimum(n[i] - p[i], n[j] - p[j]) >= 3 * (n[i] + n[j])})


def _with_mates(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of large tiles, sorted by token and size: those that size, place and group allow to link to another row of the tile."""
    for frame in _whole_tiles(frames):
        token, n, p, group = (frame[c].to_numpy(np.int64) for c in ("token", "n", "p", "component"))
        keep = np.zeros(len(token), dtype=bool)
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        for a, b in zip(starts, np.append(starts[1:], len(token))):
            names, of, many = np.unique(group[a:b], return_inverse=True, return_counts=True)
            # every pair of two groups has a set outside of the largest one
            for rows in np.array_split(a + np.flatnonzero(of != np.argmax(many)), max(1, (b - a) * (b - a) >> 20)):
                if len(rows):
                    low, high = a + np.searchsorted(n[a:b], [(3 * n[rows[0]] + 3) // 4, 4 * n[rows[-1]] // 3 + 1])
                    x, y = rows[:, None], slice(low, high)
                    may = (group[x] != group[y]) & (7 * np.minimum(n[x] - p[x], n[y] - p[y]) >= 3 * (n[x] + n[y]))
                    keep[rows] |= may.any(axis=1)
                    keep[low:high] |= may.any(axis=0)
        if keep.any():
            yield frame[keep]


_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """A wider bitmap as one of ``width`` bytes: its halves laid over each other."""
    return np.bitwise_or.reduce(bits.reshape(-1, width), axis=0)


@F.pandas_udf(T.BooleanType())
def _may_link(n: pd.Series, bits: pd.Series, m: pd.Series, others: pd.Series) -> pd.Series:
    """Every bit in which two bitmaps differ is a member of only one set; that bounds the overlap."""
    out = []
    for a, x, b, y in zip(n, bits, m, others):
        x, y = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
        width = min(len(x), len(y))
        most = (a + b - int(_ONES[fold(x, width) ^ fold(y, width)].sum(dtype=np.int64))) // 2
        out.append(100 * most >= 75 * (a + b - most))
    return pd.Series(out, dtype=bool)


def _band_pairs(every: bool):
    """Pairs of a band of a tile that may link: sizes fit, groups differ, and the bitmaps allow the overlap.

    Of each set (side 1) only the likeliest pair, or ``every`` one, but each only in the first of the tiles (``tokens``)
    that both sets have.
    """
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n", "sig"], kind="stable").reset_index(drop=True)
        n, group, sig = frame["n"].to_numpy(np.int64), frame["component"].to_numpy(), frame["sig"].to_numpy()
        token = frame["token"].iloc[0]
        tiles_of = [frozenset(t) for t in frame["tokens"]] if every else None
        left = frame.index[frame["side"] == 0].to_numpy()
        raw = [np.frombuffer(b, dtype=np.uint8) for b in frame["bits"]]
        width = min(len(b) for b in raw)
        maps = np.stack([fold(b, width) for b in raw])
        out = []
        for i in frame.index[frame["side"] == 1]:
            j = left[(4 * n[left] >= 3 * n[i]) & ((n[left] < n[i]) | ((n[left] == n[i]) & (sig[left] < sig[i]))) & (group[left] != group[i])]
            if not len(j):
                continue
            apart = _ONES[maps[j] ^ maps[i]].sum(axis=1, dtype=np.int64)
            most = (n[j] + n[i] - apart) // 2  # every differing bit is a member of only one set
            may = 100 * most >= 75 * (n[j] + n[i] - most)
            j, most = j[may], most[may]
            likely = most / (n[j] + n[i] - most)
            if tiles_of is not None:
                first = [min(tiles_of[i] & tiles_of[x]) == token for x in j]
                j, likely = j[first], likely[first]
            elif len(j):
                best = [int(np.argmax(likely))]
                j, likely = j[best], likely[best]
            if len(j):
                out.append(pd.DataFrame({"sig": sig[i], "n": n[i], "csig": sig[j], "cn": n[j], "likely": likely}))
        return pd.concat(out) if out else pd.DataFrame({"sig": [], "n": [], "csig": [], "cn": [], "likely": []}).astype({"sig": "int64", "n": "int64", "csig": "int64", "cn": "int64", "likely": "float64"})
    return run


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``documents``."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    docs = columns_of(documents, doc_id="doc_id:long", text="text").withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))
    # about four shingles a bucket, up to 2**23 buckets (a fixed bound for what reaches driver and tasks)
    mb = text_mb(documents)
    bits = int(min(23, max(14, np.ceil(np.log2(max(1.0, mb * 1e6 / 24))))))
    mixed_rows = scratch.keep(docs.mapInPandas(_facts(bits), "doc_id long, key long, n int, sig long, bits binary, chunk int, values binary"))
    facts = mixed_rows.filter("chunk is null").select("doc_id", "key", "n", "sig", "bits")
    levels = _levels(mixed_rows.filter("chunk is not null").select("chunk", "values"), bits)
    classes = facts.filter("n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"))

    # rows of many shingles: far fewer pass through Spark than one row a shingle
    entries = docs.select("text").mapInPandas(_prefixes(levels, bits, int(mb / TEXT_MB) + 1), "part int, token binary, sig binary, n binary, p binary, weight binary")
    tiles = scratch.keep(entries.groupBy("part").applyInPandas(_tiles, "token long, sig long, n int, p int, csig long, cn int"))
    # one centre for each set: the one it shares most tiles with
    proposals = (tiles.filter("sig <> csig or n <> cn").groupBy("sig", "n", "csig", "cn").agg(F.count("*").alias("shared"))
                 .groupBy("sig", "n").agg(F.max(F.struct("shared", "csig", "cn")).alias("best")).select("sig", "n", "best.csig", "best.cn"))
    members = tiles.select("sig", "n").distinct()
    bits_of = scratch.keep(facts.select("sig", "n", "bits").join(members, ["sig", "n"]).dropDuplicates(["sig", "n"]))

    def possible(pairs: DataFrame, *more: str) -> DataFrame:
        """Pairs (sig, n, csig, cn and ``more``) that their bitmaps allow."""
        other = bits_of.select(F.col("sig").alias("csig"), F.col("n").alias("cn"), F.col("bits").alias("cbits"))
        return pairs.join(bits_of, ["sig", "n"]).join(other, ["csig", "cn"]).filter(_may_link("n", "bits", "cn", "cbits")).select("sig", "n", "csig", "cn", *more)

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs whose sets link. Only sets of such pairs are made again from their texts."""
        pairs = scratch.keep(pairs)
        asked = pairs.select("sig", "n").union(pairs.select("csig", "cn")).distinct().join(classes, ["sig", "n"]).select("sig", "n", "key")
        sets = scratch.keep(docs.select("key", "text").join(asked, "key").mapInPandas(_items, "sig long, n int, items binary"))
        other = sets.select(F.col("sig").alias("csig"), F.col("n").alias("cn"), F.col("items").alias("other"))
        return pairs.join(sets, ["sig", "n"]).join(other, ["csig", "cn"]).filter(_linked("items", "other")).select("sig", "n", "csig", "cn")

    near_centre = scratch.keep(possible(proposals))
    # groups are named by document; a class without any id gets a number behind all ids
    named = scratch.keep(tiles.select("sig", "n").distinct().join(classes, ["sig", "n"]).select(
        "sig", "n", F.coalesce("doc_id", F.lit((1 << 63) - 1) - F.pmod("sig", F.lit(1 << 40))).alias("id")))

    def by_name(links: DataFrame) -> DataFrame:
        return (links.join(named.withColumnRenamed("id", "a"), ["sig", "n"])
                .join(named.select(F.col("sig").alias("csig"), F.col("n").alias("cn"), F.col("id").alias("b")), ["csig", "cn"]).select("a", "b"))

    links = scratch.keep(by_name(verified(near_centre)))
    groups = scratch.keep(named.join(connected(links), "id", "left").select("sig", "n", "id", F.coalesce("component", "id").alias("component")))

    placed = tiles.select("token", "sig", "n", "p").join(groups, ["sig", "n"])
    open_ = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("sets")).filter("lo <> hi").select("token", "sets")
    placed = scratch.keep(placed.join(open_, "token").select("token", "sig", "n", "p", "component", "sets"))
    large = scratch.keep(placed.filter(F.col("sets") > SMALL).select("token", "sig", "n", "p"))
    # of the first shingles of both, two linked sets share all of the overlap but what the rest of one of them has room for;
    # those of large tiles are not counted but all taken for shared
    overlap, most = F.ceil(F.expr("3 * (n + cn) / 7")), F.greatest(F.expr("(3 * n + 3) div 4 - 1"), F.expr("(3 * cn + 3) div 4 - 1"))
    uncounted = large.groupBy("sig", "n").agg(F.count("*").alias("large"))
    shared = (placed.filter(F.col("sets") <= SMALL).repartition("token").sortWithinPartitions("token")
              .mapInPandas(_small_pairs, "sig long, n long, csig long, cn long, near boolean")
              .groupBy("sig", "n", "csig", "cn").agg(F.count("*").alias("shared"), F.max("near").alias("near")).filter("near")
              .join(uncounted, ["sig", "n"], "left").filter(F.col("shared") + F.coalesce("large", F.lit(0)) >= overlap - most))
    few = scratch.keep(possible(shared.select(F.col("sig"), F.col("n").cast("int").alias("n"), "csig", F.col("cn").cast("int").alias("cn"),
                                              (F.col("shared") / (F.least("n", "cn") + 1)).alias("likely")), "likely"))
    # large tiles in size bands: a set is compared (side 1) in its own, and is there to be compared with (side 0) in that and the next
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(4 / 3))).cast("int")

    def banded(now: DataFrame, every: bool) -> DataFrame:
        """Pairs (sig, n, csig, cn, likely) of the large tiles that are in several groups of ``now``."""
        at = scratch.keep(large.join(now.select("sig", "n", "component"), ["sig", "n"]).repartition("token").sortWithinPartitions("token", "n")
                          .mapInPandas(_with_mates, "sig long, n int, token long, p int, component long").select("token", "sig", "n", "component", band.alias("band")))
        rows = at.select("*", F.lit(1).alias("side")).union(at.select("*", F.lit(0).alias("side"))).union(
            at.withColumn("band", F.col("band") + 1).select("*", F.lit(0).alias("side")))
        blocks = at.groupBy("token", "band").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
        rows = rows.join(blocks, ["token", "band"]).withColumn("block", F.explode(F.when(F.col("side") == 1, F.array(F.pmod("sig", F.col("blocks"))))
                                                                                  .otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
        known = bits_of
        if every:
            known = at.groupBy("sig", "n").agg(F.collect_set("token").alias("tokens")).join(bits_of, ["sig", "n"])
        return scratch.keep(rows.join(known, ["sig", "n"]).groupBy("token", "band", "block").applyInPandas(
            _band_pairs(every), "sig long, n int, csig long, cn int, likely double"))

    def in_groups(found: DataFrame, of: DataFrame) -> DataFrame:
        """Adds ca and cb, the groups of both sets."""
        return (found.join(of.select("sig", "n", F.col("component").alias("ca")), ["sig", "n"])
                .join(of.select(F.col("sig").alias("csig"), F.col("n").alias("cn"), F.col("component").alias("cb")), ["csig", "cn"]))

    def merged(found: DataFrame, now: DataFrame) -> DataFrame:
        """``now`` with the groups that linked pairs of ``found`` join."""
        waiting = in_groups(found.select("sig", "n", "csig", "cn"), now).filter("ca <> cb").select("sig", "n", "csig", "cn").distinct()
        linked = in_groups(verified(waiting), now).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        top = connected(scratch.keep(linked))
        return scratch.keep(now.join(top.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left").select(
            "sig", "n", "id", F.coalesce("top", "component").alias("component")))

    # the likeliest pair of each set first; it joins most of what belongs together, and only pairs still apart follow
    likeliest = few.union(banded(groups, False)).groupBy("sig", "n").agg(F.max(F.struct("likely", "csig", "cn")).alias("best")).select("sig", "n", "best.csig", "best.cn")
    groups = merged(likeliest, groups)
    groups = merged(few.union(banded(groups, True)), groups)
    final = groups.select("sig", "n", "component")
    # a class shows its group's smallest id, or its own
    shown = (classes.join(final, ["sig", "n"], "left").select("sig", "n", F.coalesce("component", "doc_id").alias("c"))
             .select("sig", "n", F.when(F.col("c") < (1 << 63) - 1 - (1 << 40), F.col("c")).alias("component_id")))
    return scratch.finish(facts.join(shown, ["sig", "n"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def first_of_each_group(documents: DataFrame) -> DataFrame:
    """The rows of ``documents``, one of each near-duplicate group: that of the smallest id. Of rows equal in id and text one stays."""
    found = near_duplicates(documents).filter("n_shingles = 0 or doc_id is null or doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t"))
    return rows.join(found, F.col("d").eqNullSafe(F.col("kept")), "left_semi").dropDuplicates(["d", "t"]).select("row.*")
