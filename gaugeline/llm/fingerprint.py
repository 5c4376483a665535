"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A document's terms are its lower-cased words, weighted by how often they occur. For each of ``samples`` positions k every
term draws r and c from Gamma(2, 1) and b uniform, all fixed by a hash of term and k. With t = floor(ln(w) / r + b) the term
scores ln(c) - r * (t - b) - r, and the smallest score's (term, t) is the sample at k. Two documents agree at k with a
probability equal to their generalised Jaccard similarity, sum of smaller over sum of larger weights.

The smallest score of a text of W words is ln(X / W), X exponential with mean 1. Only terms whose score may be below
ln(``DEPTH`` / W), by a bound without logarithms, are scored; a text with a position where none is (X above ``DEPTH``)
has all its terms scored in a second pass, so the samples are those of all terms.

Defined results: a null text is empty; a text without words has an empty fingerprint, which is like another empty one
(likeness 1) and unlike any other (0). Rows of the same doc_id share their neighbour; the next document of an id is the
next larger id (of equal ids, the row of the smallest text), after the last the first; null ids count as the smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeline.llm.common import WORD_BREAK, Scratch, parts_for

SAMPLES = 64
#: one text of e**12 / 64, about 2,500, needs the second pass
DEPTH = 12.0
#: a bound above all scores
ALL = 1e30
LEAST = -(1 << 63)


def _product(h: Column) -> Column:
    """A product of two uniforms from the halves of a hash; minus its logarithm is a draw from Gamma(2, 1)."""
    high = (F.shiftrightunsigned(h, 32).cast("double") + 0.5) / float(1 << 32)
    low = (h.bitwiseAND(F.lit((1 << 32) - 1)).cast("double") + 0.5) / float(1 << 32)
    return high * low


def _place(score: Column) -> Column:
    """Order-preserving bits of a score: scores lie between -100 and 20; 24 bits behind the point."""
    return ((score + 100.0) * float(1 << 24)).cast("long")


def successors(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """id, next_id for the distinct ids (null as the smallest number), the first after the last. Ids are dealt out by range, whatever gaps they have."""
    ids = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("id")).distinct()
    parts = max(documents.sparkSession.sparkContext.defaultParallelism, ids.count() // 1_000_000 + 1)
    dealt = scratch.keep(ids.repartitionByRange(parts, "id").withColumn("range", F.spark_partition_id()))
    heads = dealt.groupBy("range").agg(F.min("id").alias("head"))
    # one row per range
    follow = heads.select("range", F.coalesce(F.lead("head").over(Window.orderBy("range")), F.min("head").over(Window.partitionBy())).alias("follow"))
    here = F.lead("id").over(Window.partitionBy("range").orderBy("id"))
    return dealt.withColumn("next", here).join(F.broadcast(follow), "range").select("id", F.coalesce("next", "follow").alias("next_id"))


def _samples(rows: DataFrame, place: str, key: str, first: str, second: str, samples: int, depth: float) -> DataFrame:
    """place, key, k, m0, m1: the smallest (score, hash of term and t) of either text as a long: the score's order-preserving bits
    above, the hash below. Null where no score is below the bound that ``depth`` sets, or the text has no word."""
    split = lambda c: F.split(F.lower(c), WORD_BREAK)
    texts = F.array(F.struct(F.lit(0).alias("v"), F.col("x0").alias("t")), F.struct(F.lit(1).alias("v"), F.col("x1").alias("t")))
    words = (rows.select(place, key, split(first).alias("x0"), split(second).alias("x1"))
             .select(place, key, F.size("x0").alias("n0"), F.size("x1").alias("n1"), F.explode(texts).alias("x"))
             .select(place, key, "n0", "n1", "x.v", F.explode("x.t").alias("word"))
             .filter("word <> ''").select(place, key, "n0", "n1", "v", F.xxhash64("word").alias("term")))
    weights = words.groupBy(place, key, "n0", "n1", "term").agg(F.count_if(F.col("v") == 0).alias("w0"), F.count_if(F.col("v") == 1).alias("w1"))
    # which texts a sample is for: 1, 2 or both; the bound is that of the shorter text
    one = lambda w, n, which: F.struct(F.log(F.col(w).cast("double")).alias("lw"), (F.lit(depth) * F.col(w) / n).alias("bound"), F.lit(which).alias("which"))
    n0, n1 = F.col("n0"), F.col("n1")
    uses = F.when(F.col("w0") == F.col("w1"), F.array(one("w0", F.least(n0, n1), 3))).when(F.col("w1") == 0, F.array(one("w0", n0, 1))) \
        .when(F.col("w0") == 0, F.array(one("w1", n1, 2))).otherwise(F.array(one("w0", n0, 1), one("w1", n1, 2)))
    # a score is at least ln(c) - lw - r: with r = -ln(q) and c = -ln(p) >= 2 (1 - p) / (1 + p) that is ln(2 (1 - p) q / (1 + p) / weight) or more
    # the partition's number, which adds nothing, keeps the optimiser from copying the hash to each place of the filter that uses it
    drawn = (weights.select(place, key, "n0", "n1", "term", F.explode(uses).alias("u"))
             .select(place, key, "n0", "n1", "term", "u.*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("k"))
             .withColumn("h", F.xxhash64("term", F.shiftright("k", 3), F.col("k").bitwiseAND(7)) + 0 * F.spark_partition_id())
             .withColumn("q", _product(F.col("h"))).withColumn("p", _product(F.xxhash64("h", F.lit(1))))
             .filter(2.0 * F.col("q") * (1.0 - F.col("p")) < F.col("bound") * (1.0 + F.col("p")))
             .withColumn("r", -F.log("q")).withColumn("b", (F.shiftrightunsigned(F.xxhash64("h", F.lit(2)), 11).cast("double") + 0.5) / float(1 << 53))
             .withColumn("t", F.floor(F.col("lw") / F.col("r") + F.col("b")))
             .withColumn("score", F.log(-F.log("p")) - F.col("r") * (F.col("t").cast("double") - F.col("b")) - F.col("r"))
             .withColumn("s", F.shiftleft(_place(F.col("score")), 31).bitwiseOR(F.xxhash64("h", "t").bitwiseAND(F.lit((1 << 31) - 1)))))
    least = drawn.groupBy(place, key, "n0", "n1", "k").agg(*[F.min(F.when(F.col("which") != other, F.col("s"))).alias(f"m{v}") for v, other in ((0, 2), (1, 1))])
    # what was left out scores the bound or more; the margin is far above the rounding of doubles
    sure = lambda m, n: F.when(F.shiftright(m, 31) < _place(F.log(F.lit(depth) / F.col(n)) - 1e-6), F.col(m))
    return least.select(place, key, "k", sure("m0", "n0").alias("m0"), sure("m1", "n1").alias("m1"))


def signatures(rows: DataFrame, place: str, key: str, first: str, second: str, samples: int = SAMPLES, depth: float = DEPTH) -> DataFrame:
    """One row per ``key``: fp0 and fp1, the hexadecimal fingerprints of the texts ``first`` and ``second``; shorter where a
    position has no score below the bound of ``depth``, and empty without words.

    ``rows`` must be partitioned by ``place``, which ``key`` determines: splitting, counting and taking minima stay where
    the rows are. A term that both texts have equally often is sampled once. A key without any sample has no row.
    """
    part = lambda v: F.lpad(F.hex(F.col(f"m{v}").bitwiseAND(F.lit(0xFFFF))), 4, "0")
    found = _samples(rows, place, key, first, second, samples, depth).groupBy(place, key).agg(F.array_sort(F.collect_list(F.struct("k", part(0).alias("p0"), part(1).alias("p1")))).alias("b"))
    return found.select(place, key, F.array_join("b.p0", "").alias("fp0"), F.array_join("b.p1", "").alias("fp1"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of positions at which two fingerprints agree."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.substr(a, i * 4 + 1, F.lit(4)) == F.substr(b, i * 4 + 1, F.lit(4))))
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(same.cast("double") / samples)


def fingerprints(documents: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    Texts are dealt out by id once; of the next document only the head that the edit needs is sent to its predecessor.
    """
    scratch = Scratch(documents.sparkSession)
    parts = parts_for(documents, 6)
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    sizes = docs.select("id", half.alias("half")).groupBy("id").agg(F.max("half").alias("half"), F.count("*").alias("c"))
    needs = scratch.keep(sizes.join(successors(documents, scratch), "id"))
    repeated = needs.filter("c > 1").limit(1).count() > 0
    # a join on all it could be on would deal the fingerprints out again
    keys = ["id", "tie"] if repeated else ["id"]
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))

    any_word = r"[^\x20\x09-\x0D]"

    def following(rows: DataFrame) -> DataFrame:
        return rows.groupBy("id").agg(F.min("text").alias("text")) if repeated else rows

    def made(docs: DataFrame, nexts: DataFrame | None, needs: DataFrame, depth: float) -> DataFrame:
        """id, tie, n_chars, edited_sha256 and both fingerprints; ``open`` where a fingerprint lacks samples."""
        dealt = docs.repartition(parts, "id")
        # two columns only, so that both uses of the heads are one exchange
        heads = (following(dealt if nexts is None else nexts.repartition(parts, "id")).withColumnRenamed("id", "next_id")
                 .join(needs.select(F.col("id").alias("before"), "next_id", "half"), "next_id")
                 .select(F.col("before").alias("id"), F.substring("text", F.lit(1), F.col("half")).alias("head")).repartition(parts, "id"))
        edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("head", F.lit(1), half))
        rows = dealt.join(heads, "id").select("id", F.xxhash64("text").alias("tie"), "text", edited.alias("edited"))
        facts = rows.select("id", "tie", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                            F.col("text").rlike(any_word).alias("a"), F.col("edited").rlike(any_word).alias("b"))
        # equal rows are fingerprinted once
        once = rows.dropDuplicates(["id", "tie"]) if repeated else rows
        found = signatures(once.select("id", "tie", "text", "edited"), "id", "tie", "text", "edited", samples, depth)
        lacks = lambda c: F.length(blank(c)) < 4 * samples
        return facts.join(found if repeated else found.drop("tie"), keys, "left").select(
            "id", "tie", "n_chars", "edited_sha256", blank("fp0").alias("fingerprint"), blank("fp1").alias("edited_fingerprint"),
            ((F.col("a") & lacks("fp0")) | (F.col("b") & lacks("fp1"))).alias("open"))

    table = scratch.keep(made(docs, None, needs, DEPTH))
    again = table.filter("open").select("id", "tie").distinct()
    if not again.isEmpty():
        few = scratch.keep(needs.join(again.select("id").distinct(), "id", "left_semi"))
        whole = made(docs.join(few, "id", "left_semi"), docs.join(few.select(F.col("next_id").alias("id")), "id", "left_semi"), few, ALL)
        table = table.filter("not open").union(scratch.keep(whole.join(again, ["id", "tie"], "left_semi")))
    other = table.select("id", "tie", F.col("fingerprint").alias("nfp"))
    if repeated:
        other = other.dropDuplicates(["id", "tie"]).join(following(docs).select("id", F.xxhash64("text").alias("tie")), ["id", "tie"])
    other = other.select(F.col("id").alias("next_id"), "nfp")
    shown = table.join(needs.select("id", "next_id"), "id").join(other, "next_id")
    return shown.select(F.when(F.col("id") != LEAST, F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"), likeness(F.col("fingerprint"), F.col("nfp"), samples).alias("near_next"))
