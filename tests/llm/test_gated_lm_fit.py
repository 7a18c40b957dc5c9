"""The language model's weights are fitted on every training token."""

import numpy as np

from tabloom.llm import gated_lm


def test_every_training_token_is_fitted(spark, monkeypatch):
    monkeypatch.setattr(gated_lm.fit_sample, "__defaults__", (2, 50))
    fitted, whole = [], gated_lm.fit_blocks
    monkeypatch.setattr(gated_lm, "fit_blocks", lambda *a: fitted.append(whole(*a)))
    docs = spark.createDataFrame([(k, "x y " * 40 if k % 2 else "a b c d " * 20) for k in range(300)], "doc_id long, text string")
    got = gated_lm.score_documents(docs, block=2000).collect()
    train = sum(r["n_tokens"] for r in got if not r["held_out"])
    assert fitted == [train]


def test_a_long_document_is_not_fetched_whole(spark):
    docs = spark.createDataFrame([(k, "word " * 100_000) for k in range(3)], "doc_id long, text string")
    assert all(len(w) <= gated_lm.FIT_CHARS for w in gated_lm.fit_sample(docs))


def test_scores_whatever_the_window():
    """A document far longer than the others, so that windows widen as lanes end; unbounded weights too."""
    rng = np.random.default_rng(4)
    v = gated_lm.Vocabulary([("a", 50), ("b", 30), ("\n", 20)], [("x", 4)])
    classes = np.concatenate([v.head_class, np.arange(v.classes)])
    for size in (0.5, 60.0):
        m = gated_lm.Gru(v, 6)
        for k in ("C", "c", "W", "w"):
            m.p[k] = (rng.standard_normal(m.p[k].shape) * size).astype(np.float32)
        documents = [np.append(rng.integers(0, v.inputs, n), 2) for n in (700, 3, 0, 40, 41, 5, 90, 1)]
        shares = rng.standard_normal(v.inputs)
        got = m.score(np.concatenate(documents), np.arange(v.inputs), classes, shares, np.array([len(d) for d in documents]), lanes=5, steps=4)
        for d, total in zip(documents, got, strict=True):
            h, want = np.zeros((1, 6), np.float32), 0.0
            for before, word in zip(np.append(2, d[:-1]), d, strict=True):
                h = m.step(m.p["X"][[before]], h)
                want += m.log_probs(h, np.array([word]), classes[[word]], shares[[word]])[0]
            assert abs(total - want) <= 1e-4 * abs(want)
