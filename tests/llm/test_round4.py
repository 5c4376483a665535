"""Near duplicates of large families: exact, and without a row for each pair."""

import itertools
import random

import numpy as np
import pandas as pd

from gaugeline.llm import similarity


def _components(sets):
    """The smallest index that each set reaches by links, by brute force."""
    low = list(range(len(sets)))

    def top(k):
        while low[k] != k:
            k = low[k]
        return k

    for a, b in itertools.combinations(range(len(sets)), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            low[y] = x
    return [top(k) for k in range(len(sets))]


def test_edited_copies_of_one_text_link_without_a_row_a_pair(spark, monkeypatch):
    """A family of 150 copies with up to 6 % of the words edited, and pairs of texts about the threshold: tables of pairs have rows like the sets."""
    rng, fresh = random.Random(5), itertools.count()
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = [[f"x{next(fresh)}" if rng.random() < rate else w for w in base] for rate in (rng.uniform(0.003, 0.06) for _ in range(150))] + [base]
    for k in range(60):
        a = [f"y{next(fresh)}" for _ in range(rng.randint(30, 90))]
        cut = rng.randint(0, len(a) // 4)
        b = a[: len(a) - cut] + [f"y{next(fresh)}" for _ in range(rng.randint(0, len(a) // 4 - cut))]
        texts += [a, [*b[:2], "z", *b[3:]] if k % 4 == 0 else b]
    want = _components([{tuple(t[k: k + 5]) for k in range(len(t) - 4)} for t in texts])
    rows, keep = [], similarity.Scratch.keep

    def counted(self, df, *more):
        kept = keep(self, df, *more)
        if {"sig", "csig"} <= set(df.columns) and "token" not in df.columns:
            rows.append(kept.count())
        return kept

    monkeypatch.setattr(similarity.Scratch, "keep", counted)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in similarity.near_duplicates(docs).collect()}
    assert got == dict(enumerate(want))
    assert 50 < len(set(want)) < len(texts) - 100
    assert len(rows) >= 5 and max(rows) < 2 * len(texts), rows


def test_sets_of_a_large_tile_stay_exactly_if_one_of_another_group_may_link():
    rng = np.random.default_rng(4)
    for groups in (1, 2, 40):
        many = 300
        frame = pd.DataFrame({"token": np.sort(rng.integers(0, 4, many)), "n": rng.integers(20, 60, many), "component": rng.integers(0, groups, many), "sig": np.arange(many)})
        frame["p"] = (frame.n * rng.random(many) / 4).astype(int)
        frame = frame.sort_values(["token", "n"], ignore_index=True)
        may = {a.sig for a, b in itertools.permutations(frame.itertuples(), 2) if a.token == b.token and a.component != b.component
               and 7 * min(a.n - a.p, b.n - b.p) >= 3 * (a.n + b.n)}
        cuts = [frame.iloc[k: k + 70] for k in range(0, many, 70)]
        got = [sig for kept in similarity._with_mates(cuts) for sig in kept.sig]
        assert sorted(got) == sorted(may) and (groups == 1) == (not may)
