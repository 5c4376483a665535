"""Best-fit packing by bin completion.

Tokenised documents become pieces of at most ``capacity`` tokens; only longer documents are cut, and then only their first
piece may be shorter. Pieces are dealt by a hash into groups of bounded size, and each group is packed by branch and bound:
take the largest piece left, enumerate undominated fillings of the rest of its sequence, best fit first, and prune a branch
whose waste can no longer beat the incumbent. The incumbent starts as the best-fit-decreasing packing. Group sizes do not
depend on sources, copies or ids, so no hot key exists; a group wastes less than one sequence more than it must.

Defined results: a null text is empty and gives a piece of one token (the end id); repeated rows are packed as often as they
come; null ids are carried along. An empty table gives no pieces.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gaugeline.llm.common import Scratch, columns_of

#: pieces that are packed together; the rest of one sequence per group is the price of bounded tasks
GROUP = 16_384
#: search steps of branch and bound in a group after which the incumbent stands
STEPS = 2_000
END = 0


@lru_cache(maxsize=2)
def encoder(path: str):
    """Token ids as the ``tokenizers`` library gives them for the byte-level file at ``path``.

    The merges of that file are run by ``tiktoken``, which gives the same ids several times faster; a text that holds a
    special token's string goes to ``tokenizers`` itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    spec = json.load(open(path, encoding="utf-8"))
    special = [t["content"] for t in spec["added_tokens"]]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    as_byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    ranks = {bytes(as_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(fast.encode_ordinary(text), dtype="<u4")

    return ids


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces behind a first one that may be shorter."""
    first = length % capacity or capacity
    starts = [0, *range(first, length, capacity)]
    return [(s, (first if s == 0 else capacity)) for s in starts]


def pieces(documents: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and ``deal``, a number that spreads pieces over groups."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = encoder(tokenizer)
        deal = 0
        for frame in frames:
            out = []
            for doc, text in zip(frame["doc_id"], frame["text"]):
                own = np.append(ids(text or ""), np.uint32(END)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(own), capacity)):
                    deal += 1
                    out.append((doc, k, start, length, zlib.crc32(own[start: start + length].tobytes()), deal))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "deal"]).astype({"doc_id": "Int64"})

    # whole texts in small Arrow batches are not needed: a batch is released before the next is read
    return columns_of(documents, doc_id="doc_id:long", text="text").mapInPandas(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, deal long")


# ---- the search in one group, on counts by length ----

def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing. The open room sizes are the bits of one integer, so the tightest fit is one bit operation."""
    rooms: dict[int, list[int]] = {}
    open_bits = 0
    bins: list[list[int]] = []
    for n in sorted(lengths, reverse=True):
        fits = open_bits >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_bits &= ~(1 << room)
        else:
            b, room = len(bins), capacity
            bins.append([])
        bins[b].append(n)
        if room > n:
            rooms.setdefault(room - n, []).append(b)
            open_bits |= 1 << (room - n)
    return bins


class Counts:
    """How many pieces of each length are left, with the lengths present as bits."""

    def __init__(self, lengths: Iterable[int], capacity: int):
        self.n = np.bincount(np.asarray(list(lengths), dtype=np.int64), minlength=capacity + 1).tolist()
        self.bits = sum(1 << i for i, k in enumerate(self.n) if k)

    def take(self, length: int) -> None:
        self.n[length] -= 1
        if not self.n[length]:
            self.bits ^= 1 << length

    def put(self, length: int) -> None:
        if not self.n[length]:
            self.bits ^= 1 << length
        self.n[length] += 1

    def largest(self, most: int) -> int:
        """The largest length left that is at most ``most``; 0 if none."""
        return (self.bits & ((2 << most) - 1)).bit_length() - 1 if most > 0 and self.bits & ((2 << most) - 1) else 0


def fillings(left: Counts, room: int, keep: int = 4, tries: int = 48) -> list[tuple[int, tuple[int, ...]]]:
    """Undominated fillings of ``room``, the tightest first, at most ``keep``: (waste, lengths).

    A filling is dominated if one of its pieces, or two together, could be swapped for a longer piece that is left and
    still fits: whatever the rest needs, it is easier with the shorter pieces free.
    """
    found: dict[tuple[int, ...], int] = {}
    tried = 0

    def grow(chosen: tuple[int, ...], rest: int, most: int) -> bool:
        nonlocal tried
        n = left.largest(min(rest, most))
        if not n:
            if not _dominated(left, chosen, rest):
                found[chosen] = rest
            return rest == 0
        while n and tried < tries:
            tried += 1
            left.take(n)
            done = grow((*chosen, n), rest - n, n)
            left.put(n)
            if done and len(found) >= 1:
                return True
            n = left.largest(n - 1)
            if n and len(chosen) >= 1 and 2 * n < rest and len(found) >= keep:
                break
        return False

    grow((), room, room)
    # a perfect partner of one piece, tried first by every best fit, may sit beside many looser ones: look pairs up
    if not any(w == 0 for w in found.values()):
        bits, n = left.bits, left.largest(room)
        while n and 2 * n >= room:
            other = room - n
            if other and bits >> other & 1 and (other != n or left.n[n] > 1):
                found[(n, other)] = 0
                break
            n = left.largest(n - 1)
    if not found:
        found[()] = room
    return [(w, c) for c, w in sorted(found.items(), key=lambda x: (x[1], len(x[0])))[:keep]]


def _dominated(left: Counts, chosen: tuple[int, ...], rest: int) -> bool:
    if not rest:
        return False
    sums = {n for n in chosen} | {a + b for i, a in enumerate(chosen) for b in chosen[i + 1:]}
    for s in sums:
        n = left.largest(s + rest)
        if n > s and n not in chosen:
            return True
    return False


def complete(lengths: list[int], capacity: int, steps: int = STEPS) -> list[list[int]]:
    """Pack ``lengths`` into as few bins as the search finds."""
    best = best_fit(lengths, capacity)
    total = sum(lengths)
    least = -(-total // capacity)
    if len(best) == least:
        return best
    left, path, used = Counts(lengths, capacity), [], 0
    waste = 0
    remaining = len(lengths)
    stack: list[tuple[int, list[tuple[int, tuple[int, ...]]]]] = []
    while used < steps + len(best):
        used += 1
        room = None
        # waste so far plus all that is left cannot take fewer bins than this
        bound = -(-(total + waste) // capacity)
        if remaining and bound < len(best):
            top = left.largest(capacity)
            left.take(top)
            stack.append((top, fillings(left, capacity - top)))
            left.put(top)
            room = stack[-1]
        elif not remaining and len(path) < len(best):
            best = [list(b) for b, _ in path]
            if len(best) == least:
                break
        # go on with the next filling of the deepest node that has one
        while stack and not stack[-1][1]:
            stack.pop()
            if len(path) > len(stack) - 1 and path and len(path) >= len(stack):
                b, w = path.pop()
                waste -= w
                remaining += len(b)
                for n in b:
                    left.put(n)
        if not stack:
            break
        if room is None:
            if len(path) == len(stack):
                b, w = path.pop()
                waste -= w
                remaining += len(b)
                for n in b:
                    left.put(n)
            if not stack[-1][1]:
                continue
        top, options = stack[-1]
        w, chosen = options.pop(0)
        b = [top, *chosen]
        for n in b:
            left.take(n)
        remaining -= len(b)
        waste += w
        path.append((b, w))
    return best


def pack_group(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """sequence (number in the group) and offset for the pieces of one group."""
    lengths = frame["length"].to_numpy()
    order = np.lexsort((frame["deal"].to_numpy(), frame["ids_crc32"].to_numpy(), lengths))
    queues: dict[int, list[int]] = {}
    for i in order[::-1]:
        queues.setdefault(int(lengths[i]), []).append(int(i))
    sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
    for b, own in enumerate(complete([int(n) for n in lengths], capacity)):
        at = 0
        for n in own:
            i = queues[n].pop()
            sequence[i], offset[i] = b, at
            at += n
    return frame.assign(sequence=sequence, offset=offset)


def pack(table: DataFrame, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """``table`` (doc_id, piece, start, length, ids_crc32, deal), already written, with sequence_id and offset.

    Full pieces fill a sequence alone. The rest is dealt into ``ceil(rows / group)`` groups by a hash of the row.
    """
    groups = max(1, -(-table.filter(F.col("length") < capacity).count() // group))
    key = F.xxhash64("doc_id", "piece", "ids_crc32", "deal")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = pack_group(frame, capacity)
        # a group holds about ``group`` rows, so its sequence numbers stay far below the step between groups
        return out.assign(sequence_id=2 * (out["g"] * 64 * group + out["sequence"]))[[*names, "sequence_id", "offset"]]

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    shorter = table.filter(F.col("length") < capacity).withColumn("g", F.pmod(key, F.lit(groups))).groupBy("g").applyInPandas(run, kinds)
    # full pieces get odd numbers, packed sequences even ones
    full = table.filter(F.col("length") >= capacity).select(*names, (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.union(shorter)


def packed_documents(documents: DataFrame, tokenizer: str | None = None, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    # tokenised once, also if a later task is run again
    table = Scratch(documents.sparkSession).keep(pieces(documents, tokenizer, capacity))
    return pack(table, capacity, group)
