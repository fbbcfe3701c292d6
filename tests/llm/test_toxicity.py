import random

import numpy as np
from pyspark.sql import functions as F

from vecloom.llm import toxicity as X


def corpus(n=700, seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        insult, threat = rng.random() < 0.3, False
        if insult:
            threat = rng.random() < 0.5
            for _ in range(2):
                words[rng.randrange(len(words))] = "zkunt" + rng.choice(["en", "ig", "er"])
            if threat:
                words[rng.randrange(len(words))] = "Qwill"
        docs.append((i, " ".join(words)))
        labels.append((i, int(insult), int(threat)))
    return docs, labels


def test_chain_on_held_out_rows(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels[:450], "doc_id long, insult int, threat int")
    model = X.train(d, lab, {"insult": F.col("insult"), "threat": F.col("threat")})
    p = model.predict([t for _, t in docs[450:]])
    want = np.array([x[1:] for x in labels[450:]])
    assert ((p > 0.5) == want).mean(axis=0).min() > 0.97
    w = model.steps[1][0]
    assert len(w) == len(model.features) + 1 and w[-1] > 0  # the later model uses the earlier probability
    assert any(f in set(model.features.tolist()) for f in X.word_features("zkuntq")[1:])


def test_later_models_learn_from_out_of_fold_probabilities(monkeypatch):
    docs, labels = corpus(200)
    rows, y = [X.text_features(t) for _, t in docs], np.array([x[1:] for x in labels], dtype=float)
    fits = []
    real = X.train_svm
    monkeypatch.setattr(X, "train_svm", lambda x, t, **o: fits.append((x.copy(), o.get("use"))) or real(x, t, **o))
    model = X.fit(rows, y, ["a", "b"])
    w, bias, slope, shift = model.steps[0]
    whole = next(x for x, use in fits if use is None)
    in_fold = X.sigmoid((whole.astype(float) @ w + bias) * slope + shift)
    fed = fits[-1][0][:, -1]
    fold, target = np.arange(200) % X.FOLDS, np.where(y[:, 0] > 0, 1, -1)
    own = np.zeros(200)
    for k in range(X.FOLDS):  # nothing of a fold is seen: neither for choosing features nor for weights
        seen = X.select_features([r for r, f in zip(rows, fold) if f != k], y[fold != k], 2048)
        z, _ = X.presence_matrix(rows, seen, 0)
        v, b = real(z, target, reg=1e-5, steps=200, use=fold != k)
        own[fold == k] = z[fold == k] @ v + b
    assert np.allclose(fed, X.sigmoid(own * slope + shift), atol=1e-5) and not np.allclose(fed, in_fold, atol=1e-3)


def test_predictions_against_a_plain_loop():
    docs, labels = corpus(240, seed=9)
    rows, y = [X.text_features(t) for _, t in docs[:160]], np.array([x[1:] for x in labels[:160]], dtype=float)
    model = X.fit(rows, y, ["a", "b"])
    got = model.predict([t for _, t in docs[160:]] + [None])
    for text, p in zip([t for _, t in docs[160:]] + [None], got):
        held, earlier = set(X.text_features(text).tolist()), []
        for w, bias, slope, shift in model.steps:
            margin = bias + sum(float(w[k]) * float(model.scale[k]) for k, f in enumerate(model.features.tolist()) if f in held) + sum(float(v) * q for v, q in zip(w[len(model.features) :], earlier))
            earlier.append(1 / (1 + np.exp(-(margin * slope + shift))))
        assert np.allclose(p, earlier, atol=1e-5)


def test_capitals_are_counted_by_one_rule_at_every_length():
    for n in (4090, 4095, 4096, 4100, 20_000):
        text = ("\u041f\u0440\u0418" * n)[:n]  # two of three letters are Cyrillic capitals
        assert X.zlib.crc32(b"upper 6") in X.shape_features(text)


def test_query_nulls_repeats_and_clashes(spark):
    docs, labels = corpus(300)
    odd = [(900, None), (901, ""), (902, "zkuntig " + "la " * 80_000), (5, docs[5][1]), (None, "x")]
    d = spark.createDataFrame([(i, t, "z") for i, t in docs + odd], "doc_id long, text string, Toxic string")
    lab = spark.createDataFrame([(i, 1 - b, a) for i, a, b in labels] + [(5, None, 1), (None, 1, 1), (7, 5, 0)], "doc_id long, quality int, toxic int")
    out = X.document_toxicity(d, lab).collect()
    assert len(out) == 305 and sum(r.doc_id == 5 for r in out) == 2
    by = {r.doc_id: r for r in out}
    truth = {i: a for i, a, _ in labels}
    assert np.mean([by[i].toxic == bool(truth[i]) for i in truth]) > 0.97
    assert by[902].toxic and not by[900].toxic and by[900].p_toxic == by[901].p_toxic
    again = {r.doc_id: r.p_toxic for r in X.document_toxicity(d.repartition(3), lab.repartition(2)).collect()}
    assert all(abs(again[r.doc_id] - r.p_toxic) < 1e-4 for r in out)


def test_no_labels_one_class_and_empty(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.p_low_quality, r.p_toxic, r.toxic) for r in X.document_toxicity(d, none).collect()} == {(0.0, 0.0, False)}
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert {(r.p_low_quality, r.p_toxic) for r in X.document_toxicity(d, one).collect()} == {(0.0, 1.0)}
    assert X.document_toxicity(d.where("false"), one).collect() == []


def test_sample_is_bounded(spark):
    docs, labels = corpus(500)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, insult int, threat int")
    sample = X.training_sample(d, lab, {"a": F.col("insult"), "b": F.col("threat")}, 20, "doc_id", "text")
    assert 40 <= sample.count() <= 80
