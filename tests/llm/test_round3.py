"""Source divergence, importance resampling and URL filters against plain Python, and on awkward tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from gaugeline.llm import divergence, importance, urls
from gaugeline.llm.common import Scratch, ranked
from test_operators import SCHEMA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeÉé") for _ in range(rng.randint(1, 3))) for _ in range(150)]
    say = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "7"]) for _ in range(n))
    out = [(i, say(rng.randint(0, 60)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None, "é"])) for i in range(160)]
    out += [(200, None, "en", "a"), (201, "", "xx", "lonely"), (202, " 12 -- ", "xx", None), (203, "word " * 60_000, "fr", "long"), (204, "x" * 400_000, "fr", "long"),
            (None, "no id here", "en", "a"), (3, out[3][1], out[3][2], out[3][3]), (205, "one two three " * 20, "zz", "only")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, 1, "r", "h", 2, 3) for i, t, lang, s in rows], SCHEMA).repartition(4)


# ---- 11 ----

def plain_audit(rows, min_docs=10, top=10):
    texts = [((lang or ""), (s or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for _, t, lang, s in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in texts:
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = set()
    for lang in {g[0] for g in counts}:
        kept = sorted((t for t, n in docs[lang].items() if n >= min_docs), key=lambda t: t.encode())
        v, sources = len(kept), [s for x, s in counts if x == lang]

        def p_of(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * v) for t in kept}
        p = {s: p_of(counts[lang, s]) for s in sources}
        q = p_of(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            found = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            over = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, cut in (("pair", found, None), ("term", over, top)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:cut]):
                    out.add((lang, s, part, item, value, k + 1))
    return out


@pytest.mark.parametrize("segment,block", [(4096, 24), (8, 2)])
def test_audit_equals_plain_python(docs, rows, segment, block):
    found = divergence.audit(docs, segment_size=segment, block_size=block).select("lang", "source", "part", "item", "value", "rank").collect()
    assert {tuple(r) for r in found} == plain_audit(rows) and len(found) == len(plain_audit(rows))


def test_audit_is_exact_beyond_64_bits():
    import numpy as np
    p = divergence.shares(np.array([0, 10**13]), 10**13, 2)
    assert p.tolist() == [1 + 10**9 * 2 // (10**13 + 4), 1 + 10**9 * (10**13 + 2) // (10**13 + 4)]


def test_equal_subtrees_are_one_node():
    import numpy as np
    leaves = np.array([[1, 2, 1, 2, 0, 0, 0, 0], [1, 2, 0, 0, 0, 0, 1, 2]])
    roots, levels, values = divergence.consed(leaves)
    assert roots.tolist() != [roots[0]] * 2 and [len(n) for n in levels] == [2, 4, 2] and values.tolist() == [0, 1, 2]
    pair, a, b, times = divergence.walked(roots[:1], roots[1:], levels)
    assert sorted(zip(values[a].tolist(), values[b].tolist(), times.tolist())) == [(0, 0, 2), (0, 1, 1), (0, 2, 1), (1, 0, 1), (1, 1, 1), (2, 0, 1), (2, 2, 1)]


# ---- 12 ----

def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def test_hashes_run_on_over_pieces(rows, monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 5)
    for text in [t for _, t, *_ in rows if t and len(t) < 3000] + ["a", "a b", "aaaaaaaa b", "a bbbbbbbbbb c dddddd e f", "  a  "]:
        n, found = features(text)
        pieces = list((w, list(h)) for w, h in importance.hashes(text.encode()))
        assert sum(w for w, _ in pieces) == n and sorted(h for _, hs in pieces for h in hs) == sorted(crc32(f.encode()) for f in found)


def test_resampling_equals_plain_python(spark, docs, rows):
    target = [(0, "one two three four"), (1, None), (2, "Éa be, é 7 one"), (3, "word word")]
    m = 1000
    bucket = lambda f: crc32(f.encode()) % m
    s, t = Counter(), Counter()
    for _, text, *_ in rows:
        s.update(map(bucket, features(text)[1]))
    for _, text in target:
        t.update(map(bucket, features(text)[1]))
    gain = [math.floor(1000 * math.log((t[k] + 1.0) * (s.total() + m) / ((s[k] + 1.0) * (t.total() + m)))) for k in range(m)]
    expected = []
    for i, text, *_ in rows:
        n_words, found = features(text)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        expected.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    fit = sorted((e for e in expected if e[5] >= 20), key=lambda e: (-e[3], e[0] is None, e[0], e[1], e[2]))
    for k, e in enumerate(fit[: len(fit) * 30 // 100]):
        e[4] = k + 1
    target_df = spark.createDataFrame(target, "item_id long, text string")
    out = importance.resampled(docs, target_df, percent=30, buckets=m)
    assert sorted(map(str, (tuple(e[:5]) for e in expected))) == sorted(map(str, (tuple(r) for r in out.collect())))
    drawn = importance.drawn_documents(docs, target_df, percent=30).select("row.doc_id", "row.h", "rank").collect()
    assert all(r["h"] == "h" for r in drawn) and len(drawn) >= len(fit) * 30 // 100 > 10


def test_ranks_over_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 1000).alias("v"), "id")
    out = ranked(df, Scratch(spark), [F.col("v").desc(), F.col("id")], "place", rows_a_part=100).toPandas().sort_values("place")
    assert out.place.tolist() == list(range(1, 5001))
    assert out[["v", "id"]].values.tolist() == sorted(out[["v", "id"]].values.tolist(), key=lambda r: (-r[0], r[1]))


# ---- 13 ----

def split_url(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


def test_filters_equal_plain_python(spark, monkeypatch):
    monkeypatch.setattr(urls, "BLOCK", 32)
    rng = random.Random(4)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(200)]
    path = lambda: rng.choice(["", "/" + "".join(rng.choice("/ab") for _ in range(rng.randint(0, 5)))])
    rules = [(rng.choice(hosts), path(), rng.choice(["allow", "block"])) for _ in range(500)] + [("A.b", None, "block"), (None, "/zz", "block")]
    addresses = [f"http://{rng.choice(hosts)}{path()}{rng.choice(['', '?x=://c', '#top', '/'])}" for _ in range(1500)]
    addresses += [None, "", "abc", "://", "x://A.B.", "http://a\nb/c", "http:///zz", "http://" + "a." * 9000 + "b/a", "http://a.b/" + "é" * 50_000] + ["http://a.b/aa"] * 900
    out = urls.judged(spark.createDataFrame([(i, u, "host", "rule") for i, u in enumerate(addresses)], "page_id int, url string, host string, rule string"),
                      spark.createDataFrame(rules, "host string, path string, verdict string")).select("row.page_id", "row.rule", *[F.col(c).alias(c + "_") for c in ("host", "path", "rule", "verdict")])
    merged = {}
    for h, p, v in rules:
        k = (h or "").translate(LOWER), p or ""
        merged[k] = max(v, merged.get(k, ""))
    seen = {r["page_id"]: tuple(r)[2:] for r in out.collect()}
    assert len(seen) == out.count() == len(addresses)
    for i, u in enumerate(addresses):
        h, p = split_url(u)
        fits = [(len(a), len(b), a, b) for a, b in merged if ("." + h).endswith("." + a) and p.startswith(b)]
        best = max(fits, default=None)
        assert seen[i] == (h, p, best and best[2] + best[3], merged[best[2], best[3]] if best else "allow"), u


# ---- empty tables ----

def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    pages = spark.createDataFrame([], "page_id long, url string")
    some = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert divergence.audit(none).count() == 0
    assert importance.resampled(none, none).count() == 0
    assert urls.judged(pages, rules).count() == 0
    assert [tuple(r) for r in urls.judged(some, rules).select("host", "path", "rule", "verdict").collect()] == [("a.b", "/c", None, "allow")]


# ---- 4 ----

def test_fingerprints_of_sparse_ids(spark):
    from gaugeline.llm import fingerprint
    rng = random.Random(8)
    ids = [rng.randint(-2**62, 2**62) for _ in range(60)]
    rows = {i: " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 40))) for i in ids}
    out = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)).collect()}
    order = sorted(ids)
    prints = {}
    for i, nxt in zip(order, order[1:] + order[:1]):
        text, r = rows[i], out[i]
        edited = text[:len(text) - len(text) // 2] + rows[nxt][:len(text) // 2]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(text)
        assert (r.near_edited == 1) if edited.lower().split() == text.lower().split() else True
        for t, f in ((text, r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(" ".join(sorted(t.lower().split())), f) == f
    assert len(out) == 60
