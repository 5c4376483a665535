"""The corpus pipeline: stage by stage on a small folder, with planted cases."""

import random

import corpus_pipeline
from test_operators import table


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, say(60) + (" worthless idiot" if i % 6 == 0 else ""), f"s{i % 2}") for i in range(300)]
    passage = say(70)
    rows += [(400 + i, say(50) + "\n" + passage, "s0") for i in range(5)]
    rows += [(500, rows[1][1], "s1"), (501, rows[2][1].replace(" ", "  ", 3), "s1"), (502, None, "s1"), (503, "", None)]
    long = say(300).split(" ")
    for i in range(6):  # near copies that line dedup leaves: one line each, a tenth of the words changed in one place
        rows.append((600 + i, " ".join([*long[:270], *(rng.choice(words) for _ in range(30))]), "s1"))
    folder = str(tmp_path)
    table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{k}")
        before, docs = docs, spark.read.parquet(f"{folder}/{k}")
        if k < 4:
            assert docs.columns == before.columns
            seen.append(docs.toPandas())
    toxic, lined, near, mixed = seen
    assert not set(range(0, 300, 6)) & set(toxic.doc_id) and len(toxic) > len(rows) - 55
    assert not {500, 501} & set(lined.doc_id) and {502, 503} <= set(lined.doc_id)
    assert sum(passage in (t or "") for t in lined.text) == 1
    assert len(set(range(600, 606)) & set(lined.doc_id)) > len(set(range(600, 606)) & set(near.doc_id)) == 1 or len(set(range(600, 606)) & set(near.doc_id)) == 1
    assert set(mixed.doc_id) <= set(near.doc_id) and mixed.groupby("doc_id").size().max() <= 3
    packed = docs.toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048 and set(packed.doc_id) == set(mixed.doc_id)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100
