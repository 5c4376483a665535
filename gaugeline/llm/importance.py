"""Importance resampling towards a target distribution on hashed word n-grams.

A 256-byte table lower-cases A-Z and blanks the separators of the UTF-8 bytes, ``bytes.split`` gives the words, and a crc32 that starts
from the crc32 of the run before extends each run by a word. Counters of buckets are summed over all documents and over all target
texts; a bucket's gain is the logarithm of the ratio of the two, a document's weight is the sum of the gains of its features. Gumbel
noise from a keyed hash of the id turns weights into scores whose highest ``percent`` are a sample without replacement.

Null and empty texts have no features and weight 0 and are not drawn. A null id is hashed as an empty one and comes last among equal
scores. Repeated rows are scored alike and drawn one by one. An empty table gives no rows; an empty target counts nothing.

Texts of any length are taken in pieces, and only the buckets reach the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain
from zlib import crc32

from pyspark.sql import Column, DataFrame, functions as F

from gaugeline.llm.common import Scratch, ranked

BUCKETS = 10_000
#: digits, a-z and everything outside ASCII stay
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())
PIECE = 1 << 18


def pieces(text: bytes, table: bytes = _TABLE) -> Iterator[bytes]:
    """The translated text, cut at blanks into pieces of about ``PIECE`` bytes."""
    text = text.translate(table)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def hashes(text: bytes) -> Iterator[tuple[int, Iterable[int]]]:
    """(words, crc32 of all runs of one to three words that end in them) for each piece of a text."""
    one: list[int] = []
    two: list[int] = []
    for piece in pieces(text):
        words = piece.split()
        if not words:
            continue
        spaced = [b" " + w for w in words]
        # the last runs of the piece before are continued
        seeds_two, seeds_three = one[-1:], two[-1:]
        one = list(map(crc32, words))
        seeds_two += one[:-1]
        grown = list(map(crc32, spaced[len(words) - len(seeds_two):], seeds_two))
        seeds_three += grown[:-1]
        three = list(map(crc32, spaced[len(words) - len(seeds_three):], seeds_three))
        two = grown
        yield len(words), chain(one, two, three)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How many features of all rows of ``texts`` (column text) fall into each bucket; the driver sees one number a bucket."""
    def count(batches: Iterable) -> Iterator:
        import pyarrow as pa

        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                for _, found in hashes(text.as_py()):
                    total.update([h % buckets for h in found])
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(total), pa.int32()), "n": pa.array(list(total.values()), pa.int64())})

    bytes_only = texts.filter("text IS NOT NULL").select(F.col("text").cast("string").cast("binary").alias("text"))
    sums = bytes_only.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = [0] * buckets
    for row in sums:
        counts[row["bucket"]] = row["n"]
    return counts


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """floor(1000 * ln of the ratio of the smoothed shares) by bucket, in doubles."""
    m, s_all, t_all = float(len(corpus)), float(sum(corpus)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + m) / ((s + 1.0) * (t_all + m)))) for s, t in zip(corpus, target)]


def weighed(documents: DataFrame, gain: list[int]) -> DataFrame:
    """``documents`` (doc_id, text) as doc_id, n_words, n_features, weight."""
    def weigh(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table = np.array(gain, dtype=np.int64)
        for batch in batches:
            out = []
            for text in batch.column(1):
                n_words = n_features = weight = 0
                for words, found in hashes(text.as_py() or b""):
                    h = np.fromiter(found, dtype=np.uint32)
                    n_words, n_features = n_words + words, n_features + len(h)
                    weight += int(table[h % np.uint32(len(table))].sum())
                out.append((n_words, n_features, weight))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[k] for o in out], pa.int64()) for k in range(3))], ["doc_id", "n_words", "n_features", "weight"])

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int, ident: Column) -> Column:
    """floor(1000 * Gumbel noise) from the first 8 hexadecimal digits of sha256(``seed:id``)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(documents: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every document; rank is null where the document is not drawn.

    Drawn are the ``percent`` of those with at least ``min_words`` words that score highest, ties to smaller ids.
    """
    scratch = Scratch(documents.sparkSession)
    gain = gains(bucket_counts(documents, buckets), bucket_counts(target, buckets))
    scored = scratch.keep(weighed(documents, gain).withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id"))))
    fit = scored.filter(F.col("n_words") >= min_words)
    drawn = F.lit(fit.count() * percent // 100)
    places = ranked(fit, scratch, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")], "rank")
    shown = places.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank").cast("long")))
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return shown.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def drawn_documents(documents: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """The drawn rows with all their columns as struct ``row``, and their rank; rows that share an id are drawn together."""
    ranks = resampled(documents, target, percent, min_words, seed).filter("rank IS NOT NULL").groupBy("doc_id").agg(F.min("rank").alias("rank"))
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    return rows.join(ranks, rows["doc_id"].eqNullSafe(ranks["doc_id"])).select("row", "rank")
