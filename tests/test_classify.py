"""The classifier against plain numpy, and a model that is kept."""

import numpy as np
import pytest

from proselake.operators import classify, shallow


def test_training_equals_numpy(spark, tmp_path):
    texts = [(i, ("The old river quietly carried seven stones, and rested. " * (1 + i % 3) if i % 2 else "Go now. They went there because it rained. ") + "Ok " * (i % 5)) for i in range(24)] + [(90, ""), (91, None)]
    docs = classify.features(shallow.parses(spark.createDataFrame(texts, "doc_id long, text string")))
    docs = docs.withColumn("label", (docs.doc_id % 2).cast("int")).persist()
    assert docs.count() == 24
    model = classify.fit_vectors(docs)
    rows = classify.vectors(docs, model, "label").persist()
    trained = classify.train(rows, model, l2=0.5, rate=0.3, epochs=15)

    got = {r.doc_id: r for r in rows.collect()}
    raw = {r.doc_id: r for r in docs.collect()}
    df = {}
    for r in raw.values():
        for t in set(r.terms):
            df[t] = df.get(t, 0) + 1
    vocab = sorted(t for t, n in df.items() if n >= 2)
    assert set(model.idf) == set(vocab)
    ids = sorted(raw)
    tf = np.array([[raw[d].terms.count(t) * (np.log(25 / (1 + df[t])) + 1) for t in vocab] for d in ids])
    norm = np.sqrt((tf**2).sum(1))
    tf = tf / np.where(norm > 0, norm, 1)[:, None]
    sc = np.array([[raw[d][c] for c in classify.SCALARS] for d in ids], float)
    sd = sc.std(0)
    sc = (sc - sc.mean(0)) / np.where(sd > 0, sd, 1)
    x, y = np.hstack([tf, sc]), np.array([raw[d].label for d in ids], float)
    names = [*vocab, *classify.SCALARS]
    for k, d in enumerate(ids):
        have = dict(zip(got[d]["names"], got[d]["values"], strict=True))
        assert np.allclose([have.get(n, 0.0) for n in names], x[k], atol=1e-6)
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(15):
        err = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - 0.3 * (x.T @ err / len(y) + 0.5 * w / len(y)), b - 0.3 * err.sum() / len(y)
    assert np.allclose([trained.weights.get(n, 0.0) for n in names], w, atol=1e-6) and trained.bias == pytest.approx(b, abs=1e-6)

    trained.save(spark, str(tmp_path / "model"))
    again = classify.Model.load(spark, str(tmp_path / "model"))
    assert again == trained
    want = {d: int(np.floor(100 / (1 + np.exp(-(x[k] @ w + b))) + 0.5)) for k, d in enumerate(ids)}
    assert {r.doc_id: r.score for r in classify.predict(rows, again).collect()} == want
    assert classify.train(rows.limit(0), model).weights == {}
