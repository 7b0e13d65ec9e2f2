import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "salo mire tavo kelu nori beda".split() for b in "an er os it el".split()]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(60)
    rows = [(i, text(80)) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[4][1] + " salo"), (102, text(30) + " " + passage), (103, passage + " " + text(20)), (104, passage), (105, None), (106, ""), (107, "123 456"), (108, text(40)[:20])]
    data = [(i, t, "aa", "s", len(t or ""), "extra") for i, t in rows]
    path = tmp_path_factory.mktemp("docs")
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, rejected string").write.parquet(f"{path}/documents.parquet")
    return str(path), dict(rows)


def test_stages_take_effect(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{path}/out{k}")
        docs = spark.read.parquet(f"{path}/out{k}")
        kept.append(docs.collect())
        if k < 3:
            assert docs.columns == pipeline.COLUMNS
    ids = [{r.doc_id for r in x} for x in kept]
    assert ids[0] == set(rows) - {105, 106, 107}
    assert ids[1] == ids[0] - {100, 101}
    assert ids[2] == ids[1] - {104}
    text = {r.doc_id: r.text for r in kept[2]}
    assert all(text[i] == rows[i] for i in ids[2] - {103})
    assert text[103] == " ".join(rows[103].split()[60:])
    assert ids[3] == ids[2] and all(r.length <= 1024 for r in kept[3])


def test_run_and_empty(spark, folder, tmp_path):
    path, _ = folder
    assert pipeline.run(spark, path).count() > 0
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
