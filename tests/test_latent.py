"""Text vectors reduced by a distributed SVD."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from flowlog.operators.knn import knn_search
from flowlog.operators.latent import LatentModel, embed_latent, fit_latent, term_columns


def texts(spark):
    """Two subjects; words of one occur together, but not every pair of words in one text."""
    rng = np.random.default_rng(3)
    words = [[f"{s}{i}" for i in range(30)] for s in ("net", "disk")]
    rows = [(i, " ".join(rng.choice(words[i % 2], 6, replace=False)) + f" id{i}") for i in range(600)]
    return spark.createDataFrame([*rows, (600, None), (601, ""), (602, "net1 net1 net1")], "id long, document string").repartition(4)


def dense(df, model):
    rows = df.where("document is not null").orderBy("id").select(term_columns("document", len(model.weights)).alias("t")).collect()
    table = np.zeros((len(rows), len(model.weights)))
    for row, r in zip(table, rows, strict=True):
        for t in r.t:
            row[t] += model.weights[t]
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-300)


def test_basis_is_that_of_a_dense_svd(spark):
    df = texts(spark)
    model = fit_latent(df, rank=2, size=512)
    table = dense(df, model)
    right = np.linalg.svd(table, full_matrices=False)[2][:2]
    # cosines of the angles between both subspaces
    assert np.linalg.svd(right @ model.basis)[1].min() > 0.999
    got = {r.id: np.array(r.embedding) for r in embed_latent(df, model).collect()}
    assert set(got) == {*range(600), 601, 602}
    want = table @ model.basis
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    ids = sorted(got)
    assert np.allclose(np.stack([got[i] for i in ids]), want, atol=1e-5) and not got[601].any()


def test_words_of_one_subject_are_near(spark, tmp_path):
    df = texts(spark)
    model = fit_latent(df, rank=4, size=512)
    model.save(f"{tmp_path}/model.npz")
    model = LatentModel.load(f"{tmp_path}/model.npz")
    # a word that is in no text of the neighbours it must find
    asked = spark.createDataFrame([("net", "net5"), ("disk", "disk5")], "query_id string, query string")
    stored = embed_latent(df.where("document not rlike '(net|disk)5 '"), model)
    hits = knn_search(stored, embed_latent(asked, model, "query").drop("query"), 20).collect()
    assert len(hits) == 40 and all(h.document.startswith(h.query_id) for h in hits)


def test_edges(spark):
    df = texts(spark)
    none = fit_latent(df.where("id = 600"), rank=3, size=64)
    assert none.basis.shape == (64, 3)
    assert embed_latent(df.where("id < 5"), none).count() == 5
    model = fit_latent(df, rank=3, size=64)
    assert embed_latent(df.limit(0), model).count() == 0
    clash = embed_latent(df.withColumns({"terms": F.lit(1), "i": F.lit(2)}), model)
    assert clash.columns == ["id", "document", "terms", "i", "embedding"] and clash.where("size(embedding) <> 3").count() == 0
