"""The training-data operators against brute force, and on awkward tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import fingerprint, html, lines, mixing, neighbours, packing, shingles, similarity, suffixes, surrogates, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, `row` string, h string, sig int, size int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 1, "r", "h", 2, 3) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rng():
    return random.Random(5)


@pytest.fixture(scope="module")
def corpus(rng):
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = say(90)
    rows = [(i, "\n".join(say(rng.randint(8, 30)) for _ in range(rng.randint(1, 5))), f"s{i % 3}") for i in range(80)]
    for i in range(80, 110):  # near copies with a few words changed
        words = rows[rng.randrange(20)][1].split(" ")
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words), None if i % 7 == 0 else "s0"))
    rows += [(i, say(rng.randint(10, 60)) + "\n" + passage + " " + say(12), "s1") for i in range(110, 125)]
    rows += [(125, None, "s1"), (126, "", None), (127, " \n ", "s2"), (128, "one two", "s2"), (129, "One TWO", "s2"), (130, "é" * 300 + "\n" + "ab " * 3000, "s0"),
             (131, rows[3][1], "s2"), (None, rows[4][1], "s0"), (3, rows[3][1], "s0")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return table(spark, corpus).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def groups(rows, links):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(len(rows))]


# ---- 1 ----

def test_surrogates_are_keyed_distinct_and_of_the_same_format(spark):
    rows = [(1, "Mrs. Anna Müller met Herr Müller and г-н Иван Петров.", "a"), (2, "Write to a.b@x.example.com or A.B@x.example.com, c.d@x.example.com", "a"),
            (3, "Call +1 (017) 555-7713 or 017 555 7713; card 4111 1111 1111 1111, 4111111111111111", "a"), (4, "10.0.0.1 and 123-45-6789, DE89 3704 0044 0532 0130 00", "a"), (5, None, "a"), (6, "clean", "a")]
    got = {r.doc_id: r for r in surrogates.with_surrogates(table(spark, rows), b"k").select("row.doc_id", "text", "n_entities", "n_distinct").collect()}
    for i, t, _ in rows[:4]:
        assert all(t[s:e] not in got[i].text for s, e, *_ in surrogates.finds(t))
    female, surname, other = re.match(r"Mrs\. (\w+) (\w+) met Herr (\w+) and", got[1].text).groups()
    assert surname == other and female.endswith("a") and re.search(r"[а-яй]", got[1].text.split("г-н")[1])
    a, b, c = re.findall(r"\S+@[\w.]+\w", got[2].text)
    assert a == b != c and a.split("@")[1] == c.split("@")[1]
    assert got[3].text[5:8] == "+1 " and re.sub(r"\D", "", got[3].text[8:22]) == re.sub(r"\D", "", got[3].text[26:38])
    card = re.sub(r"\D", "", got[3].text.split("card ")[1].split(",")[0])
    assert card[0] == "4" and surrogates.luhn(card[:-1]) == int(card[-1])
    assert (got[5].text, got[5].n_entities, got[6].text) == (None, 0, "clean")


def test_all_mentions_of_a_name_and_phones_in_groups_of_two(spark):
    rows = [(1, "Mrs Ana Lopez came. Lopez said so; ANA LOPEZ agreed, and Lopez's sister met Ana. The lopez and Lopezia stay.", "a"),
            (2, "Dr Ana Maria Lopez, Dr J. R. Petersen and Prof. Eva M. Strand's team; Petersen left with Strand and Maria.", "a"),
            (3, "Call 06 12 34 56 78, 06.12.34.56.78, +33 6 12 34 56 78 or 91 234 56 78 and 612 34 56 78.", "a"), (4, "Lopez without a title", "a")]
    got = {r.doc_id: r for r in surrogates.with_surrogates(table(spark, rows), b"k").select("row.doc_id", "text", "n_entities", "n_distinct").collect()}
    given, surname, again, upper, own, alone = re.match(r"Mrs (\w+) (\w+) came\. (\w+) said so; (\w+ \w+) agreed, and (\w+)'s sister met (\w+)\. The lopez and Lopezia stay\.$", got[1].text).groups()
    assert surname == again == own and upper == f"{given} {surname}".upper() and alone == given and "Lopez" not in {given, surname}
    assert (got[1].n_entities, got[1].n_distinct) == (5, 3)
    for name in ("Ana", "Maria", "Lopez", "Petersen", "Eva", "Strand"):
        assert name not in got[2].text
    a, b, c, d, e, f, g = re.match(r"Dr (\w+) (\w+) (\w+), Dr J\. R\. (\w+) and Prof\. (\w+) M\. (\w+)'s team; (\w+) left", got[2].text).groups()
    assert c == surname and g == d and got[2].text.endswith(f" with {f} and {b}.")
    first, second, third, fourth, fifth = re.match(r"Call (0[\d ]{13}), (0[\d.]{13}), (\+33 [\d ]{13}) or (\d\d \d{3} \d\d \d\d) and (\d{3} \d\d \d\d \d\d)\.$", got[3].text).groups()
    assert first.replace(" ", ".") == second and third == "+33 " + first[1:] and first != "06 12 34 56 78" and fourth != "91 234 56 78" and fifth != "612 34 56 78"
    assert got[4].text == rows[3][1]


def test_colliding_surrogates_are_drawn_again(spark):
    # only 80 first octets and few digits: a thousand short numbers must still stay apart
    found = spark.createDataFrame([("SSN", f"{i:04d}") for i in range(2000)], "kind string, normal string")
    done = surrogates.settled(found, b"k").collect()
    new = [surrogates.surrogate(b"k", r.kind, r.normal, r.attempt) for r in done]
    assert len(set(new)) == 2000 and not set(new) & {f"{i:04d}" for i in range(2000)} and any(r.attempt for r in done)


# ---- 2 ----

def test_toxicity_is_learned_and_never_from_held_out_rows(spark, rng):
    say = lambda bad: " ".join(rng.choice(["lamp", "tree", "house", "river", "stone"]) for _ in range(20)) + (" idiot" if bad else "")
    rows = [(i, say(i % 5 == 0), "a") for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(table(spark, rows), labels).toPandas()
    held = got[got.held_out]
    assert 100 < len(held) < 200 and (held.predicted == (held.doc_id % 5 == 0)).mean() > 0.98 and got.score.between(0, 1).all()
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.toxicity_scores(table(spark, rows), turned).toPandas()
    assert np.allclose(got.sort_values("doc_id").score, again.sort_values("doc_id").score)
    kept = toxicity.clean_documents(table(spark, rows), labels)
    assert kept.columns == table(spark, rows).columns and kept.count() == (got.predicted == 0).sum()


# ---- 3 ----

def test_bin_completion_finds_the_fewest_bins(rng):
    def fewest(sizes, room):
        best = [len(sizes)]

        def place(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] >= sizes[i]:
                    bins[k] -= sizes[i]
                    place(i + 1, bins)
                    bins[k] += sizes[i]
            bins.append(room - sizes[i])
            place(i + 1, bins)
            bins.pop()
        place(0, [])
        return best[0]
    for _ in range(150):
        room = rng.choice([20, 50])
        sizes = sorted((rng.randint(1, room) for _ in range(rng.randint(0, 9))), reverse=True)
        bins = packing.complete(sizes, room)
        assert sorted(x for b in bins for x in b) == sorted(sizes) and all(sum(b) <= room for b in bins) and len(bins) == fewest(sizes, room)


def test_packing_round_trip(docs, corpus):
    import public_tokenizers
    import zlib
    from tokenizers import Tokenizer
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.packed_documents(docs, capacity=512, group=64).toPandas()
    texts = defaultdict(list)
    for i, t, _ in corpus:
        texts[i].append(t or "")
    for (doc,), own in got.groupby(["doc_id"], dropna=False):
        doc = None if pd.isna(doc) else int(doc)
        ids = np.array([*exact.encode(texts[doc][0], add_special_tokens=False).ids, 0], dtype="<u4")
        assert own.length.sum() == len(ids) * len(texts[doc])
        for r in own.itertuples():
            assert zlib.crc32(ids[r.start: r.start + r.length].tobytes()) == r.ids_crc32 and (r.length == 512 or r.piece == 0)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 512 and (s.length.cumsum() - s.length == s.offset).all()
    assert got.sequence_id.nunique() <= 1.05 * got.length.sum() / 512 + 4


def test_special_token_strings_are_read_as_the_tokenizer_reads_them():
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer
    for t in ("a <|endoftext|> b", "naïve 東京 \t\n  x", ""):
        assert packing.encoder(path)(t).tolist() == Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids


# ---- 4 ----

def test_fingerprints_estimate_generalised_jaccard(docs, corpus):
    got = {(r.doc_id, r.n_chars): r for r in fingerprint.fingerprints(docs).collect()}
    smallest = {}
    for i, t, _ in corpus:
        smallest[i] = min(smallest.get(i, t or ""), t or "")
    ids = sorted(smallest, key=lambda i: (i is not None, i or 0))
    off = []
    for i, t, _ in corpus:
        t = t or ""
        nxt = smallest[ids[(ids.index(i) + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = got[i, len(t)]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, r.near_edited), (nxt, r.near_next)):
            a, b = (Counter(w for w in re.split(r"[\x20\x09-\x0D]+", x.lower()) if w) for x in (t, other))
            true = sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0
            off.append(near - true)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.07
    assert got[3, len(corpus[3][1])].fingerprint == got[131, len(corpus[3][1])].fingerprint


@pytest.mark.parametrize("depth", [0.5, 4.0])
def test_terms_left_out_never_are_the_sample(docs, monkeypatch, depth):
    """Scoring all terms, and few of them with a second pass for the texts that lack samples, gives the same rows."""
    monkeypatch.setattr(fingerprint, "DEPTH", fingerprint.ALL)
    want = sorted(map(str, fingerprint.fingerprints(docs).collect()))
    monkeypatch.setattr(fingerprint, "DEPTH", depth)
    assert sorted(map(str, fingerprint.fingerprints(docs).collect())) == want


# ---- 5 ----

def _sets(corpus):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for _, t, _ in corpus:
        w = WORDS.findall((t or "").translate(low))
        out.append({tuple(w[k: k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("small", [64, 1])
def test_near_duplicates_equal_brute_force(docs, corpus, monkeypatch, small):
    monkeypatch.setattr(similarity, "SMALL", small)
    monkeypatch.setattr(similarity, "BLOCK", 4)
    sets = _sets(corpus)
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    of = groups(sets, links)
    low = {}
    for i, g in enumerate(of):
        if corpus[i][0] is not None:
            low[g] = min(low.get(g, 1 << 60), corpus[i][0])
    want = sorted((str(corpus[i][0]), len(sets[i]), low[g] if sets[i] else corpus[i][0]) for i, g in enumerate(of))
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in similarity.near_duplicates(docs).collect())
    assert got == want and len(set(of)) < len(of) - 20


def test_pairs_of_a_family_do_not_grow_with_its_square(rng):
    """Near copies that meet in two tiles: one pair a set first; later each pair once, not once a tile."""
    base = np.unique(np.array([rng.randrange(10**9) for _ in range(200)], dtype=np.int64))
    sets = [np.unique(np.append(base, np.arange(k, dtype=np.int64) + 10**10 * (k + 1))) for k in range(60)]
    rows = [(1, token, len(s), shingles.signature(s), k, k, shingles.bitmap(s), [7, 9], side)
            for token in (7, 9) for k, s in enumerate(sets) for side in (0, 1)]
    frame = pd.DataFrame(rows, columns=["kind", "token", "n", "sig", "component", "family", "bits", "tokens", "side"])
    first, every = ([run(frame[frame.token == t].copy()) for t in (7, 9)] for run in (similarity._band_pairs(False), similarity._band_pairs(True)))
    assert all(0 < len(f) < 60 for f in first)
    assert len(every[0]) > 1000 and not len(every[1])
    assert set(zip(first[0].sig, first[0].csig)) <= set(zip(every[0].sig, every[0].csig))


def test_bit_counts_bound_the_overlap(rng):
    for _ in range(200):
        a, b = (np.unique(np.array([rng.randrange(10**6) for _ in range(rng.randint(1, 300))], dtype=np.int64)) for _ in (0, 1))
        b = np.unique(np.concatenate([b, a[: rng.randint(0, len(a))]]))
        x, y = (np.frombuffer(shingles.bitmap(s), dtype=np.uint8) for s in (a, b))
        w = min(len(x), len(y))
        apart = int(similarity._ONES[similarity.fold(x, w) ^ similarity.fold(y, w)].sum())
        assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - apart) // 2


# ---- 6 ----

def _page(k, article, extra=""):
    return (f"<!DOCTYPE html><html><head><title>T{k}</title><script>var t=\"</p>\";</script></head><body><header>Site {k % 3}</header><nav><ul><li><a href=/>m{k % 3}</a></li></ul></nav>"
            f"<div class=\"ad\">buy {k % 3}</div><div id=content>{article}<div class=box>Subscribe now</div></div>{extra}<aside>side</aside><div class='comments'><p>Nice {k}!</p></div><footer>&copy; x</footer>")


def test_main_text_of_pages(spark):
    rows = [(k, f"http://h{k % 2}.example.com/{k}", _page(k, f"<h1>Title {k}</h1><p>First &amp; {k}<br>line<p><b>Second {k} &eacute;<p>Third   {k}</p>")) for k in range(80)]
    rows += [(200, None, None), (201, "http://h0.example.com/", ""), (202, "nonsense", "plain &lt;text"), (203, "http://h1.example.com/q", "<p>" * 3000 + "deep"), (5, "http://h1.example.com/5", rows[5][2])]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).toPandas()
    by = got.drop_duplicates("page_id").set_index("page_id").text
    for k in range(80):
        assert by[k] == f"Title {k}\nFirst & {k} line\nSecond {k} é\nThird {k}"
    assert len(got) == len(rows) and by[200] == "" and by[201] == "" and by[202] == "plain <text" and by[203] == "deep" and (got.n_chars == got.text.str.len()).all()


@pytest.mark.parametrize("stamp", ["", "<p>Served at {}</p>"])
def test_main_text_of_a_host_of_copies(spark, stamp):
    page = lambda k: f"<body><div><h2>News</h2></div><article><h1>Title {k}</h1><p>First of {k}</p><p>Second of {k}</p></article>"
    rows = [(i, "http://h.example.com/", page(0 if i < 270 else i) + stamp.format(i)) for i in range(300)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(300):
        k = 0 if i < 270 else i
        assert f"Title {k}\nFirst of {k}\nSecond of {k}" in got[i], i


def test_main_text_behind_deep_elements(spark):
    deep = lambda k, n: f"<body><div><h2>News</h2></div><div id=content><article><h1>Title {k}</h1>{'<div>' * n}<p>Inner {k}{'</div>' * n}<p>First of {k}<p>Second of {k}</article></div><footer>x</footer>"
    rows = [(k, "http://h.example.com/", deep(k, {40: 300, 41: 5000}.get(k, 1))) for k in range(42)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for k in range(42):
        assert got[k] == f"Title {k}\nInner {k}\nFirst of {k}\nSecond of {k}"


def test_texts_of_all_elements():
    for page in ("<div> a<b>b </b>c<br>d<p>e</p><p> </p></div> f<i></i>", _page(1, "<p>x<b> y</b>z<p>w"), "<div>" * 50 + "x</div> y" * 50, "", "<p>" * 3, "a\u00a0<b>\u2003b</b>"):
        tree = html.parse(page)
        found = dict((id(n), t) for n, t in html.texts(tree))
        assert found == {id(n): html.text_of(n) for n in html.numbered(tree)}


def test_tree_matching_is_largest(rng):
    def tree(depth):
        n = html.Node(rng.choice("ab"))
        n.children = [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []
        return n

    def best(a, b):
        if a.tag != b.tag:
            return 0
        x, y = a.children, b.children
        m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + best(x[i], y[j]))
        return m[-1][-1] + 1
    for _ in range(200):
        a, b = tree(3), tree(3)
        if a.tag == b.tag:
            html.numbered(a)
            html.align(a, b)
            matched = []
            stack = [b]
            while stack:
                n = stack.pop()
                matched += [n.slot] if n.slot is not None else []
                stack.extend(n.children)
            assert len(matched) == len(set(matched)) == best(a, b)


# ---- 7 ----

def test_mix_meets_targets(docs, corpus):
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(corpus) and (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].where(got["size"] > 0, 1) == 0).all()
    sizes = Counter()
    for _, t, s in corpus:
        sizes[s] += len(WORDS.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([sizes[s] for s in names], [k % 3 + 1 for k in range(len(names))], sum(sizes.values()))))
    taken = got.groupby("target").taken.sum()
    assert sorted(round(v, 6) for v in goal.values()) == sorted(round(v, 6) for v in taken.index)
    assert all(abs(n - t) <= 0.03 * t + 30 for t, n in taken.items())
    again = mixing.mix(docs.repartition(3)).toPandas()
    key = lambda d: sorted(map(tuple, d[["doc_id", "size", "taken"]].fillna(-1).values.tolist()))
    assert key(got) == key(again)
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns and copies.count() == got.copies.sum()


def test_flow_is_cheapest(rng):
    def cost(flow, supply):
        return sum(sum(k * max(0, min(sum(f.values()) - k * s, s)) for k in range(3)) for f, s in zip(flow, supply))
    for _ in range(5):
        supply = [rng.randint(1, 3) for _ in range(3)]
        members = [sorted(rng.sample(range(2), rng.randint(1, 2))) for _ in supply]
        quota = [rng.randint(0, 6) for _ in range(2)]
        flow = mixing.route(supply, members, quota)
        best = None
        for x in range(3 ** 0 * 10 ** 3):
            use = [x // 10 ** i % 10 for i in range(3)]
            if any(u > 3 * s for u, s in zip(use, supply)):
                continue
            for y in range(8 ** 3):
                first = [y // 8 ** i % 8 for i in range(3)]
                split = [{m[0]: f, m[-1]: u - f} if len(m) == 2 else {m[0]: u} for m, f, u in zip(members, first, use)]
                if any(len(m) == 1 and f for m, f in zip(members, first)) or any(v < 0 for s in split for v in s.values()):
                    continue
                got = [sum(s.get(k, 0) for s in split) for k in range(2)]
                if all(g <= q for g, q in zip(got, quota)):
                    key = (-sum(got), cost(split, supply))
                    best = min(best, key) if best else key
        assert (-sum(sum(f.values()) for f in flow), cost(flow, supply)) == best


def test_targets_share_the_excess():
    assert mixing.targets([10, 100, 100], [3, 1, 1], 150) == pytest.approx([30, 60, 60])
    assert mixing.targets([], [], 0) == [] and mixing.targets([5], [1], 5) == [5]


# ---- 8 ----

def test_suffix_dedup_equals_brute_force(docs, corpus):
    length, texts = 60, [(i, (t or "").encode()) for i, t, _ in corpus]
    seen = Counter(t[s: s + length] for _, t in texts for s in range(len(t) - length + 1))
    want = []
    for i, t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for s in range(len(t) - length + 1):
            if seen[t[s: s + length]] > 1:
                gone[s: s + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((str(i), len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without_repeats(docs, length, 12).collect()]
    assert sorted(got) == sorted(want) and sum(w[2] for w in want) > 3000


def test_deep_shallow_sorts_and_reach_is_exact(rng):
    draw = lambda n: bytes(rng.choice(b"ab") if rng.random() < 0.15 else 97 for _ in range(n))
    for _ in range(100):
        s = list({draw(rng.randint(0, 60)) for _ in range(rng.randint(1, 40))})
        assert [s[i] for i in suffixes.deep_shallow(s, 16)] == sorted(s)
        n = rng.randint(2, 12)
        left, right = [draw(rng.randint(8, 16)) for _ in range(n)], [draw(rng.randint(10, 20)) for _ in range(n)]
        before, behind = suffixes.reach(left, right, 20)
        for i in range(n):
            q = [(suffixes.common(left[i], left[j]), suffixes.common(right[i], right[j])) for j in range(n) if j != i]
            q = [x for x in q if sum(x) >= 20]
            assert (before[i], behind[i]) == ((max(x[0] for x in q), max(x[1] for x in q)) if q else (0, 0))


# ---- 9 ----

def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_line_dedup_equals_brute_force(spark, rng):
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 40))) for _ in range(25)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(rng.randint(1, 5)):
            line = rng.choice(base)
            if rng.random() < 0.4:
                p = rng.randrange(len(line))
                line = line[:p] + rng.choice("abcdefgh!") + line[p + rng.randint(0, 1):]
            own.append(rng.choice([line, line.upper() + ".", "", "***"]))
        rows.append((i, "\n".join(own), "a"))
    rows += [(60, None, "a"), (61, "", "b"), (0, rows[0][1], "a")]
    docs = table(spark, rows)
    norm = lambda x: re.sub(r"[\W_]+", " ", x.lower()).strip()
    classes = sorted({norm(x) for _, t, _ in rows if t for x in t.split("\n")} - {""})
    # every pair of like lines, whatever their SimHashes
    like = [(a, b) for a in range(len(classes)) for b in range(a) if _distance(classes[a], classes[b]) <= int(0.1 * max(len(classes[a]), len(classes[b])) + 1e-9)]
    assert len(like) > 3
    group = dict(zip(classes, groups(classes, like)))
    seen, want = {}, {}
    for i, t, _ in sorted(rows[:-1], key=lambda r: r[0]):
        kept = []
        for x in (t.split("\n") if t is not None else []):
            g = group.get(norm(x))
            if g is None or g not in seen:
                kept.append(x)
                seen[g] = i
        want[i] = None if t is None else "\n".join(kept)
    got = lines.without_lines(docs).select("row.doc_id", "row.text", "kept_text", "n_removed").collect()
    assert len(got) == len(rows)
    removable = removed = 0
    for r in got:  # nothing goes but what a plain search for like lines takes as well, and nearly all of that
        if r.text is None:
            assert r.kept_text is None
            continue
        gone, may = Counter(r.text.split("\n")) - Counter(r.kept_text.split("\n")), Counter(r.text.split("\n")) - Counter(want[r.doc_id].split("\n"))
        assert gone <= may and r.n_removed == gone.total()
        removable, removed = removable + may.total(), removed + gone.total()
    assert removed >= 0.9 * removable > 50
    left = lines.deduplicated_lines(docs)
    assert left.columns == docs.columns and left.filter("doc_id in (60, 61)").count() == 2


@pytest.mark.parametrize("n_words,edits,least", [(5, 1, 0.5), (10, 1, 0.65), (27, 1, 0.85), (60, 3, 0.75), (200, 2, 0.9), (500, 10, 0.85)])
def test_line_dedup_recall_against_edit_similarity_alone(spark, n_words, edits, least):
    """Pairs of lines with edited words: which share of the second ones goes, whatever their SimHashes."""
    rng = random.Random(n_words)
    word = lambda: "".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 9)))
    rows = []
    for i in range(150):
        words = [word() for _ in range(n_words)]
        other = list(words)
        for k in rng.sample(range(n_words), edits):
            other[k] = other[k][:-1] + rng.choice("xyzq")
        rows += [(2 * i, " ".join(words), "a"), (2 * i + 1, " ".join(other), "a")]
    got = {r.doc_id: r.n_removed for r in lines.without_lines(table(spark, rows)).select("row.doc_id", "n_removed").collect()}
    assert not any(got[2 * i] for i in range(150)) and sum(got[2 * i + 1] for i in range(150)) >= least * 150


def test_large_families_of_lines_keep_one(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 9))) for _ in range(40)]
    rows = []
    for i in range(400):
        own = list(words)
        own[rng.randrange(40)] = "x" * rng.randint(1, 5)
        rows.append((i, " ".join(own), "a"))
    got = lines.without_lines(table(spark, rows)).agg(F.sum("n_removed")).first()[0]
    assert 395 <= got <= 399


def test_only_pairs_of_a_family_that_are_still_apart_are_compared(spark, monkeypatch):
    """Lines of one family: less than half of the pairs that share a block are compared."""
    tried, plain = spark.sparkContext.accumulator(0), lines._unsettled

    def counted(similarity):
        def seen(batches):
            for batch in batches:
                tried.add(len(batch))
                yield batch
        return lambda batches: plain(similarity)(seen(batches))

    monkeypatch.setattr(lines, "_unsettled", counted)
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 9))) for _ in range(80)]
    rows = []
    for i in range(300):
        own = list(words)
        own[rng.randrange(80)] = "x" * rng.randint(1, 9)
        rows.append((i, " ".join(own), "a"))
    assert lines.without_lines(table(spark, rows)).agg(F.sum("n_removed")).first()[0] == 299
    assert 150 <= tried.value <= 5000  # 8,912 when every pair was compared


def test_counts_of_characters_bound_the_edit_distance(rng):
    draw = lambda n: "".join(rng.choice("abcdefghijklmnop é漢") for _ in range(n))
    pairs = []
    for _ in range(150):
        a = draw(rng.randint(1, 60))
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            p = rng.randrange(len(b) + 1)
            b[p: p + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
        pairs += [(a, "".join(b) or "x"), (a, draw(rng.randint(1, 60)))]
    pairs += [("a" * 40, "a" * 23), ("a" * 16, "b" * 16)]
    least = lines._edits(lines.bags([a for a, _ in pairs]), lines.bags([b for _, b in pairs]))
    assert all(k <= 2 * _distance(a, b) for k, (a, b) in zip(least.tolist(), pairs)) and least.max() > 30


def test_pairs_that_counts_of_characters_rule_out_are_not_listed():
    """Two SimHashes of a block that differ in few bits, of lines with other characters: no text has to be fetched for them."""
    import pyarrow as pa
    same, other = lines.bags(["abcdefghij " * 5] * 2), lines.bags(["abcdefghij " * 5, "klmnopqrst " * 5])
    key, h, n, sh = np.zeros(2, dtype=np.int64), np.array([1, 2]), np.array([55, 55], dtype=np.int32), np.array([0, 1])
    for bag, found in ((same, 1), (other, 0)):
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in (key, h, n, sh, bag)], ["key", "h", "n", "sh", "bag"])
        assert sum(len(b) for b in lines._bucket_pairs(0.9)([batch])) == found


def test_followers_of_different_rows_of_a_large_bucket_meet():
    import pyarrow as pa
    from itertools import combinations
    ones = lambda k: (1 << k) - 1
    # 0 leads 2, 1 leads 3; 2 and 3 are near each other but not to the other's lead
    sh, n = [0, ones(30), ones(10), ones(20)], [100] * 4
    rng = np.random.default_rng(4)
    far = rng.integers(0, 1 << 62, 60)
    sh, n = np.array(sh + [int(v) for v in far] + [int(far[0]) ^ ones(k % 13) for k in range(40)]), np.array(n + [100] * 100)
    h = np.arange(len(sh)) + 1000
    key = np.zeros(len(sh), dtype=np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in (key, h, n, sh, h)], ["key", "h", "n", "sh", "g"])
    met, owned = set(), {}
    for out in lines._bucket_pairs(0.9)([batch]):
        for a, b, first in zip(*(c.to_pylist() for c in out.columns)):
            met.add((min(a, b), max(a, b)))
            if first:
                owned.setdefault(b, set()).add(a)
    assert (1002, 1003) in met
    for i, j in combinations(range(len(sh)), 2):
        if int(sh[i] ^ sh[j]).bit_count() <= lines.MOST:
            a, b = 1000 + i, 1000 + j
            assert (a, b) in met or owned[a] & owned[b]


# ---- 10 ----

def test_neighbours_are_found_ranked_and_exact(spark, rng):
    g = np.random.default_rng(1)
    x = g.normal(size=(1500, 16)).astype(np.float32) * g.uniform(0.5, 2, size=(1500, 1)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1500 + i, x[7].tolist()) for i in range(40)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0]), (None, x[0].tolist()), (2080, [None] * 16), (7, x[7].tolist())]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=10).toPandas()
    ids = np.array(list(range(1540)))
    full = np.concatenate([x, np.repeat(x[7:8], 40, 0)]).astype(np.float64)
    hits = 0
    queries = [i for i in range(1540) if i % 20 == 0]
    assert set(got.query_id) == set(queries)
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        s = full @ full[q]
        assert own["rank"].tolist() == list(range(1, 11)) and q not in set(own.vec_id) and np.allclose(own.score, s[own.vec_id], rtol=1e-12)
        assert [tuple(v) for v in own[["score", "vec_id"]].values] == sorted((tuple(v) for v in own[["score", "vec_id"]].values), key=lambda v: (-v[0], v[1]))
        s[q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -s))][:10]) & set(own.vec_id))
    assert hits / len(queries) / 10 > 0.95


def test_curves_grow_with_the_number_of_points(spark, monkeypatch):
    assert neighbours.curves_for(10_256) == neighbours.curves_for(100_000) == 40 and neighbours.curves_for(1_000_000) == 72
    x = np.random.default_rng(2).normal(size=(3000, 32))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "CURVES", 6)
    monkeypatch.setattr(neighbours, "STEADY", 1)  # stands for a table 3,000 times as large as the one the curves were chosen for
    got = neighbours.nearest(vectors, F.col("vec_id") % 100 == 0, k=10).toPandas()
    hits = 0
    for q, own in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:10]) & set(own.vec_id))
    assert hits / 300 > 0.9


def test_hilbert_curves_are_continuous():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        keys = neighbours.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells))) and (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


# ---- awkward tables ----

def _all(docs, spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), "k", "h", "row")
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.col("n_chars").cast("float"), F.lit(1.0)).alias("embedding"), "row")
    return {"surrogates": surrogates.with_surrogates(docs), "toxicity": toxicity.score_documents(docs, labels), "fingerprints": fingerprint.fingerprints(docs),
            "near": similarity.near_duplicates(docs), "html": html.main_text(pages), "mix": mixing.mix(docs), "suffixes": suffixes.without_repeats(docs),
            "lines": lines.without_lines(docs), "packing": packing.packed_documents(docs).filter("piece = 0"), "vectors": neighbours.nearest(vectors, F.col("vec_id") % 20 == 0)}


def test_awkward_rows_keep_their_place(spark):
    rows = [(None, None, None), (1, "", "a"), (1, "", "a"), (2, "x" * 200_000, "a"), (3, "w " * 60_000, None), (4, "\n\n", "b"), (None, "tie tie tie", "b"), (20, "퟿ \U0001F600", "b")]
    for name, got in _all(table(spark, rows), spark).items():
        assert got.count() == (len(rows) if name != "vectors" else 4), name


def test_empty_tables_give_no_rows(spark, nothing):
    for name, got in _all(nothing, spark).items():
        assert got.count() == 0, name
