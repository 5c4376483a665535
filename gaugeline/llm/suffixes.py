"""Suffix-array dedup: bytes that lie in a string of ``LENGTH`` bytes that also starts anywhere else are removed.

Only suffixes at anchors are sorted. The anchor of a window of ``LENGTH`` bytes is its smallest hashed k-mer, the leftmost of
equal ones, so two equal windows have anchors at the same place; anchors are a few of every thousand positions. An anchor's
context is all that windows around it can reach. Equal contexts are one class, counted before anything is shuffled on; the
anchors of one k-mer form a group, and groups of a single occurrence are dropped.

Where a group has several classes, their suffixes from the anchor on and their reversed prefixes are sorted deep-shallow:
multikey quicksort on eight-byte steps down to a shallow depth, then a blind trie for each set of suffixes still equal
there. Two members share a window if their common prefix and common reversed prefix add up to ``LENGTH``. Clusters of equal
reversed prefixes are merged from long to short; each member then only meets its neighbours in suffix order, which hold the
longest match, so no pairs within a group are listed.

Defined results: a null text is empty; texts shorter than ``LENGTH`` bytes lose nothing. Repeated rows are occurrences of
their own, so all windows of both go. Rows with null ids take part. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gaugeline.llm.common import Scratch
from gaugeline.llm.shingles import _POWERS, mixed

LENGTH = 400
KMER = 32
SHALLOW = 64
#: bytes of text hashed together; a longer document is a block of its own
BLOCK = 400_000
#: window starts whose minimum is taken together
SLICE = 1 << 22


# ---- deep-shallow sorting ----

def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    apart = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (apart.bit_length() + 7) // 8


class _Node:
    __slots__ = ("depth", "children", "leaf")

    def __init__(self, depth: int, leaf: int):
        self.depth, self.leaf, self.children = depth, leaf, None


def blind_trie(strings: list[bytes], members: list[int]) -> list[int]:
    """Sorted order of distinct strings with a long common prefix.

    Inner nodes know only the depth at which their strings part and the byte there (-1 behind an end). A new string is led
    down blindly by those bytes; one comparison with the leaf it meets tells where it really parts.
    """
    byte = lambda i, d: strings[i][d] if d < len(strings[i]) else -1
    root = _Node(1 << 60, members[0])
    for i in members[1:]:
        node = root
        while node.children:
            node = node.children.get(byte(i, node.depth)) or next(iter(node.children.values()))
        depth = common(strings[i], strings[node.leaf])
        above, node = None, root
        while node.children and node.depth < depth:
            above, node = node, node.children[byte(i, node.depth)]
        if node.children and node.depth == depth:
            node.children[byte(i, depth)] = _Node(1 << 60, i)
            continue
        split = _Node(depth, node.leaf)
        split.children = {byte(node.leaf, depth): node, byte(i, depth): _Node(1 << 60, i)}
        if above is None:
            root = split
        else:
            above.children[byte(i, above.depth)] = split
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.children:
            stack.extend(node.children[c] for c in sorted(node.children, reverse=True))
        else:
            out.append(node.leaf)
    return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Sorted order of distinct strings."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        members, depth = stack.pop()
        if len(members) < 2:
            out.extend(members)
        elif depth >= shallow:
            out.extend(blind_trie(strings, members))
        else:
            keys = [strings[i][depth: depth + 8] for i in members]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            low, same, high = [], [], []
            for i, k in zip(members, keys):
                (low if k < pivot else high if k > pivot else same).append(i)
            stack.append((high, depth))
            # keys shorter than eight bytes are ends: equal ones are equal strings, of which there is only one
            stack.append((same, depth + 8))
            stack.append((low, depth))
    return out


def sorted_classes(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of possibly equal strings and the common prefix of each with the one before (0 for the first)."""
    where: dict[bytes, list[int]] = {}
    for i, s in enumerate(strings):
        where.setdefault(s, []).append(i)
    distinct = list(where)
    order, prefix, last = [], [], None
    for d in deep_shallow(distinct):
        s = distinct[d]
        for k, i in enumerate(where[s]):
            order.append(i)
            prefix.append(0 if last is None else len(s) if k else common(last, s))
            last = s
    return order, prefix


class _Lowest:
    """Minimum of ``values`` over any range."""

    def __init__(self, values: list[int]):
        self.rows = [np.asarray(values, dtype=np.int32)]
        while 2 * (1 << (len(self.rows) - 1)) <= len(values):
            half, last = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, a: int, b: int) -> int:
        k = (b - a).bit_length() - 1
        return int(min(self.rows[k][a], self.rows[k][b - (1 << k)]))


def reach(left: list[bytes], right: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each member: bytes before and behind its anchor that shared windows cover (0, 0 if it shares none).

    ``left`` are the reversed bytes before the anchor, ``right`` the bytes from the anchor on.
    """
    n = len(left)
    before, behind = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order, prefix = sorted_classes(right)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    lowest = _Lowest(prefix) if n > 2 else None
    left_order, left_prefix = sorted_classes(left)
    cluster, held = list(range(n)), [[rank[i]] for i in left_order]

    def find(x: int) -> int:
        while cluster[x] != x:
            cluster[x] = cluster[cluster[x]]
            x = cluster[x]
        return x

    for k in sorted(range(1, n), key=lambda k: -left_prefix[k]):
        shared = left_prefix[k]
        a, b = find(k - 1), find(k)
        if len(held[a]) < len(held[b]):
            a, b = b, a
        big, small = held[a], held[b]
        cluster[b], held[b] = a, []
        for r in small:
            at = bisect_left(big, r)
            for o in big[max(0, at - 1): at + 1]:
                lo, hi = (o, r) if o < r else (r, o)
                behind_both = lowest(lo + 1, hi + 1) if lowest else prefix[hi]
                if shared + behind_both >= length:
                    for i in (order[o], order[r]):
                        before[i], behind[i] = max(before[i], shared), max(behind[i], behind_both)
            big.insert(at, r)
    return before, behind


# ---- anchors ----

def anchors(texts: list[bytes], length: int = LENGTH, kmer: int = KMER) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: positions of its anchors, their k-mers' hashes and their contexts' hashes."""
    line = np.frombuffer(b"".join(texts), dtype=np.uint8)
    cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    n, wide = len(line), length - kmer + 1
    empty = np.zeros(0, np.int64)
    if n < length:
        for _ in texts:
            yield empty, empty, empty
        return
    up, down = _POWERS.upto(n + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((line.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    h = mixed((total[kmer:] - total[:-kmer]) * down[: n - kmer + 1])
    owner_end = np.repeat(cuts[1:], np.diff(cuts))
    won = []
    for a in range(0, n - length + 1, SLICE):
        b = min(n - length + 1, a + SLICE)  # window starts a .. b - 1
        low = (h[a: b + wide - 1] & ~np.uint64((1 << 23) - 1)) | np.arange(b + wide - 1 - a, dtype=np.uint64)
        span = 1
        while 2 * span <= wide:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[: b - a], low[wide - span: wide - span + b - a])
        inside = np.arange(a, b) + length <= owner_end[a:b]
        place = (low[inside] & np.uint64((1 << 23) - 1)).astype(np.int64) + a
        won.append(place[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else place)
    place = np.unique(np.concatenate(won))
    text = np.searchsorted(cuts, place, side="right") - 1
    start, end = np.maximum(cuts[text], place - (wide - 1)), np.minimum(cuts[text + 1], place + length)
    context = mixed(mixed((total[end] - total[start]) * down[start]) + ((place - start) * 1024 + (end - place)).astype(np.uint64))
    parts = np.searchsorted(place, cuts)
    for i, (a, b) in enumerate(zip(parts[:-1], parts[1:])):
        yield place[a:b] - cuts[i], h[place[a:b]].view(np.int64), context[a:b].view(np.int64)


def _blocks(texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    block, size = [], 0
    for t in texts:
        t = (t or "").encode("utf-8", "surrogatepass")
        if block and size + len(t) > BLOCK:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block


def _anchors(length: int, kmer: int):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at, keys = 0, frame["k"].to_numpy()
            for block in _blocks(frame["text"]):
                found = list(anchors(block, length, kmer))
                many = [len(f[0]) for f in found]
                yield pd.DataFrame({"akey": np.concatenate([f[1] for f in found]), "context": np.concatenate([f[2] for f in found]),
                                    "k": np.repeat(keys[at: at + len(block)], many), "pos": np.concatenate([f[0] for f in found])})
                at += len(block)
    return run


def _contexts(length: int, kmer: int):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text, wanted in zip(frame["text"], frame["wanted"]):
                t, out = (text or "").encode("utf-8", "surrogatepass"), []
                for w in wanted:
                    p = w["pos"]
                    out.append((w["akey"], w["context"], t[max(0, p - (length - kmer)): p][::-1], t[p: p + length]))
                yield pd.DataFrame(out, columns=["akey", "context", "before", "behind"])
    return run


def _solve(length: int):
    def one(group: pd.DataFrame) -> pd.DataFrame:
        l, r = reach(group["before"].tolist(), group["behind"].tolist(), length)
        return pd.DataFrame({"akey": group["akey"].to_numpy(), "context": group["context"].to_numpy(), "l": l, "r": r})

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by akey; a group may go over from one batch to the next."""
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            keys = frame["akey"].to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()]
            rest = frame.iloc[cuts[-1]:]
            if len(cuts) > 1:
                yield pd.concat([one(frame.iloc[a:b]) for a, b in zip(cuts[:-1], cuts[1:])])
        if rest is not None and len(rest):
            yield one(rest)
    return run


def _cut(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for doc, text, spans in zip(frame["doc_id"], frame["text"], frame["spans"]):
            t = (text or "").encode("utf-8", "surrogatepass")
            kept, at, removed, runs, last = hashlib.sha256(), 0, 0, 0, -1
            for s in sorted((x["start"], x["end"]) for x in (spans if spans is not None else ())):
                a, b = max(s[0], at), s[1]
                if b <= at:
                    continue
                runs += not runs or s[0] > last
                kept.update(t[at:a])
                removed += b - a
                at = last = b
            kept.update(t[at:])
            out.append((doc, len(t), removed, runs, kept.hexdigest()))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})


def repeated_spans(documents: DataFrame, length: int = LENGTH, kmer: int = KMER) -> DataFrame:
    """k (hash of doc_id and text) and spans, an array of (start, end) in bytes that may overlap, where anything repeats."""
    scratch = Scratch(documents.sparkSession)
    docs = documents.select(F.col("text"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("k"))
    found = scratch.keep(docs.mapInPandas(_anchors(length, kmer), "akey long, context long, k long, pos long"))
    classes = found.groupBy("akey", "context").agg(F.count("*").alias("n"), F.first("k").alias("k"), F.first("pos").alias("pos"))
    groups = classes.groupBy("akey").agg(F.count("*").alias("classes"), F.sum("n").alias("occurrences")).filter("occurrences > 1").drop("occurrences")
    classes = scratch.keep(classes.join(groups, "akey"))
    wanted = classes.filter("classes > 1").groupBy("k").agg(F.collect_list(F.struct("akey", "context", "pos")).alias("wanted"))
    # repeated rows hold the same bytes; one of them is enough
    bytes_of = docs.join(wanted, "k").dropDuplicates(["k"]).select("text", "wanted").mapInPandas(_contexts(length, kmer), "akey long, context long, before binary, behind binary")
    solved = bytes_of.repartition("akey").sortWithinPartitions("akey").mapInPandas(_solve(length), "akey long, context long, l long, r long")
    # a context that occurs twice is covered as far as it reaches
    whole = classes.filter("n > 1").select("akey", "context", F.lit(length).cast("long").alias("l"), F.lit(length).cast("long").alias("r"))
    result = scratch.keep(solved.filter("r > 0").union(whole).groupBy("akey", "context").agg(F.max("l").alias("l"), F.max("r").alias("r")))
    spans = found.join(result, ["akey", "context"]).select("k", F.struct(F.greatest(F.lit(0).cast("long"), F.col("pos") - F.least(F.col("l"), F.lit(length - kmer))).alias("start"), (F.col("pos") + F.col("r")).alias("end")).alias("span"))
    return scratch.finish(spans.groupBy("k").agg(F.collect_set("span").alias("spans")))


def without_repeats(documents: DataFrame, length: int = LENGTH, kmer: int = KMER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    spans = repeated_spans(documents, length, kmer)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("k"))
    # a span behind the end of the text ends with it
    size = F.octet_length(F.coalesce("text", F.lit("")))
    rows = rows.join(spans, "k", "left").withColumn("spans", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.least(s["end"], size).alias("end"))))
    return rows.select("doc_id", "text", "spans").mapInPandas(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
