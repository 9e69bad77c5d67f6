import itertools
import math
import zlib

import numpy as np
import pytest
from helpers import ODD, SF, given, table

from lodestone.llm.queries import op8_quality_crf
from lodestone.llm.quality_crf import FEATURES, OWN, SHARED, LineCRF, fit_quality, score_quality, text_features

SF2 = SF.replace("0.001", "0.01")


def enumerated(model, x):
    """Marginals of good, pairwise sums and the log partition by the weights of all label paths."""
    good = x @ model.weights + model.bias
    marginal, pair, total = np.zeros(len(x)), np.zeros((2, 2)), 0.0
    for path in itertools.product((0, 1), repeat=len(x)):
        score = model.start[path[0]] + sum(good[t] for t, y in enumerate(path) if y) + sum(model.moves[a, b] for a, b in itertools.pairwise(path))
        weight = math.exp(score)
        total += weight
        marginal += weight * np.array(path)
        for a, b in itertools.pairwise(path):
            pair[a, b] += weight
    return marginal / total, pair / total, math.log(total)


def chosen(seed=0):
    rng = np.random.default_rng(seed)
    return LineCRF(rng.normal(0, 0.5, FEATURES), 0.3, rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2))


def test_forward_backward_by_all_label_paths():
    rng = np.random.default_rng(1)
    model = chosen()
    texts = [rng.normal(0, 1, (n, FEATURES)).astype(np.float32) for n in (3, 1, 9, 1, 5, 9)]
    marginal, pair, first, total = model.chains(texts)
    want = [enumerated(model, x) for x in texts]
    assert np.allclose(marginal, np.concatenate([w[0] for w in want])) and np.allclose(pair, sum(w[1] for w in want))
    assert np.allclose(total, [w[2] for w in want]) and np.allclose(first, [sum(1 - w[0][0] for w in want), sum(w[0][0] for w in want)])


def test_gradient_step_raises_the_likelihood():
    rng = np.random.default_rng(2)
    labels = np.array([0, 1] * 10)
    texts = [(rng.normal(0, 1, (4, FEATURES)) + (1 if y else -1)).astype(np.float32) for y in labels]
    model = LineCRF.fit(texts, labels, steps=30)
    p = model.chains(texts)[0].reshape(-1, 4).mean(axis=1)
    assert (p[labels == 1] > 0.9).all() and (p[labels == 0] < 0.1).all() and np.abs(model.moves).max() <= 1.5


def test_neighbours_are_features():
    x = text_features(b"one two\n### $$$\nTHE END NOW!!")
    assert (x[1, OWN : OWN + SHARED] == x[0, :SHARED]).all() and (x[1, OWN + SHARED :] == x[2, :SHARED]).all()
    assert not x[0, OWN : OWN + SHARED].any() and not x[2, OWN + SHARED :].any()


def test_scores_are_length_weighted_marginals(spark):
    model = chosen(3)
    got = sorted(map(tuple, score_quality(given(spark, ODD[:7] + ODD[9:]), model, keep=("text",)).select("doc_id", "text", "score", "n_lines", "n_bad_lines").collect()), key=str)
    want = []
    for i, t in ODD[:7] + ODD[9:]:
        lines = (t or "").encode().split(b"\n")
        p = enumerated(model, text_features((t or "").encode()))[0]
        w = np.array([len(x) + 1 for x in lines])
        want.append((i, t, float((p * w).sum() / w.sum()), len(lines), int((p < 0.5).sum())))
    assert [(r[0], r[1], *r[3:]) for r in got] == [(r[0], r[1], *r[3:]) for r in sorted(want, key=str)]
    assert np.allclose([r[2] for r in got], [r[2] for r in sorted(want, key=str)])


def test_held_out_documents(spark):
    got = {r["doc_id"]: r for r in op8_quality_crf(spark, SF2).collect()}
    docs = {r["doc_id"] for r in table("documents", SF2)}
    assert set(got) == docs and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    labels = [(r["doc_id"], r["quality"]) for r in table("labels", SF2) if got[r["doc_id"]]["held_out"] and r["quality"] is not None]
    good, bad = ([got[i]["predicted"] for i, q in labels if q == v] for v in (1, 0))
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.1


def label_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_labels_of_the_held_out_fold_are_not_read(spark):
    rows = [(i, "good words stand here.\nand here." if i % 2 else "### $$$\n!!! |||") for i in range(40)]
    right = [(i, i % 2, 0, "x") for i, _ in rows]
    wrong = [(i, q if zlib.crc32(str(i).encode()) % 5 else 1 - q, t, x) for i, q, t, x in right]
    a, b = (fit_quality(given(spark, rows), label_rows(spark, x)) for x in (right, wrong))
    assert np.allclose(a.weights, b.weights) and a.bias == b.bias


@pytest.mark.parametrize("labels", [[], [(None, 1, 0, "x"), (77, 1, 0, "x")], [(4, None, 0, "x"), (5, 7, 1, "x")]])
def test_without_usable_labels_every_score_is_a_half(spark, labels):
    model = fit_quality(given(spark, ODD), label_rows(spark, labels))
    got = score_quality(given(spark, ODD), model).collect()
    assert len(got) == len(ODD) and all(abs(r["score"] - 0.5) < 1e-12 for r in got)


def test_one_class_repeats_long_texts_and_bounds(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5][:6]
    long = "\n".join(f"a line of words {i}." for i in range(1500))
    rows = [(i, "plain words.\nmore words.") for i in ids[:5]] + [(ids[0], "again the same id.")] + [(ids[5], long)]
    one = fit_quality(given(spark, rows), label_rows(spark, [(i, 1, 0, "x") for i in ids] * 2))
    assert all(r["score"] > 0.9 for r in score_quality(given(spark, rows), one).collect())
    mixed = label_rows(spark, [(i, i % 2, 0, "x") for i in ids])
    # The long document is over the bound of lines and is not sampled; the others still are.
    assert np.isfinite(fit_quality(given(spark, rows), mixed, fit_lines=20).weights).all()
    assert (fit_quality(given(spark, rows), mixed, fit_lines=0).weights == 0).all()


def test_all_lines_of_a_long_document_are_fitted(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(LineCRF, "fit", classmethod(lambda cls, texts, labels: seen.append((texts, labels)) or cls.blank()))
    i = next(i for i in range(10) if zlib.crc32(str(i).encode()) % 5)
    text = "\n".join(f"line {n} of it" for n in range(1001))
    fit_quality(given(spark, [(i, text)]), label_rows(spark, [(i, 1, 0, "x")]))
    (texts, labels), = seen
    assert [len(x) for x in texts] == [400, 400, 201] and list(labels) == [1, 1, 1]
    assert (np.concatenate(texts) == text_features(text.encode())).all()


def test_empty_tables(spark):
    model = fit_quality(given(spark, []), label_rows(spark, []))
    assert score_quality(given(spark, []), model, keep=("text",)).collect() == []
