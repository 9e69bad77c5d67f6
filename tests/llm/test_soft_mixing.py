import math
import re
from collections import Counter

import numpy as np
import pytest
from helpers import ODD, SF, given, table
from pyspark.sql import functions as F

from lodestone.llm.queries import MIX_WEIGHTS, op9_soft_mixing
from lodestone.llm.soft_mixing import _rate, descend, fit_domains, fit_rates, mix

SF2 = SF.replace("0.001", "0.01")


def seen(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text.lower()) if w]
    n = max(1, len(text))
    marks = [" symbols"] * (len(re.findall(r"[#*$%&|<>]", text)) / n > 0.02) + [" upper"] * (sum("A" <= c <= "Z" for c in text) / n > 0.3)
    return words, {*words, *marks, *([" repeats"] if len(words) >= 20 and len(set(words)) < 0.3 * len(words) else [])}


def moved(p, steps, top=np.inf):
    r = np.ones(len(p))
    for g in steps:
        r = np.clip(r - p @ np.array(g), 0, top)
    return r


def evaluated(n, p, top=np.inf):
    """The sums of ``fit_rates`` in numpy."""

    def evaluate(steps, tries):
        base = moved(p, steps, top)
        out = []
        for t in tries:
            r = np.clip(base - p @ np.array(t), 0, top)
            x = p * n[:, None]
            out.append(np.concatenate((x.T @ r, ((x * ((r > 0) & (r < top))[:, None]).T @ p).ravel())))
        return np.array(out)

    return evaluate


def least_squares(n, p, targets, rounds=6_000):
    """An independent solver: accelerated projected gradient with a fixed small step and restarts; the least gap length."""
    x = p * n[:, None]
    r = y = np.ones(len(n))
    length, t = np.linalg.eigvalsh(x.T @ p)[-1], 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - p @ (x.T @ y - targets) / length)
        if ((y - new) * n * (new - r)).sum() > 0:
            t, y = 1.0, new
        else:
            later = (1 + math.sqrt(1 + 4 * t * t)) / 2
            y, t = new + (t - 1) / later * (new - r), later
        if np.abs(new - r).max(initial=0) < 1e-12:
            break
        r = new
    return np.linalg.norm(x.T @ r - targets)


def test_descent_reaches_the_least_squares():
    """Random problems, reachable or not: never worse than rate 1, and as close as an independent solver comes."""
    rng = np.random.default_rng(0)
    unmet = 0
    for turn in range(250):
        k, docs = rng.integers(2, 5), rng.choice([4, 10, 40, 200])
        p, n = rng.dirichlet([rng.choice([0.05, 0.3, 1])] * k, docs), rng.integers(0, 200, docs).astype(float)
        targets = rng.dirichlet([rng.choice([0.2, 1])] * k) * n.sum() * rng.choice([0.5, 1, 2])
        if not n.sum():
            continue
        found = descend(evaluated(n, p), targets.tolist())
        x, budget = p * n[:, None], max(targets.sum(), 1)
        left = np.linalg.norm(x.T @ moved(p, found.steps) - targets) / budget
        assert abs(left - found.lengths[-1]) < 1e-9 and found.lengths == sorted(found.lengths, reverse=True)
        assert left <= np.linalg.norm(x.sum(0) - targets) / budget + 1e-12
        assert found.met == (np.abs(found.gaps).max() <= 1e-4)
        if not found.met:
            unmet += 1
            if turn % 16 == 0:
                assert left <= least_squares(n, p, targets) / budget + 1e-3
    assert 25 < unmet < 225


def test_four_documents_and_weights_far_apart():
    rng = np.random.default_rng(5)
    for _ in range(50):
        p, n = rng.dirichlet([0.3] * 3, 4), rng.integers(1, 100, 4).astype(float)
        targets = n.sum() * np.array([0.0004, 0.022, 0.977])
        for top in (np.inf, 3.0):
            found = descend(evaluated(n, p, top), targets.tolist())
            assert found.lengths[-1] <= found.lengths[0] <= 2 and moved(p, found.steps, top).max() <= top
        if not found.met:
            assert descend(evaluated(n, p), targets.tolist()).lengths[-1] <= least_squares(n, p, targets) / n.sum() + 1e-3


def test_given_documents_meet_the_targets(spark):
    docs = {r["doc_id"]: r["text"] for r in table("documents", SF2)}
    got = op9_soft_mixing(spark, SF2).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    assert all(r["n_tokens"] == len(seen(docs[r["doc_id"]])[0]) for r in got)
    p = np.array([[r[f"p_{d}"] for d in MIX_WEIGHTS] for r in got])
    n, rate = np.array([r["n_tokens"] for r in got]), np.array([r["rate"] for r in got])
    assert np.allclose(p.sum(1), 1) and (rate >= 0).all()
    targets = n.sum() * np.array(list(MIX_WEIGHTS.values()))
    assert np.allclose(p.T @ (n * rate), targets, atol=2e-4 * n.sum())
    found = descend(evaluated(n.astype(float), p), targets.tolist())
    assert found.met and np.allclose(rate, moved(p, found.steps), atol=1e-6)
    labels = {r["doc_id"]: r for r in table("labels", SF2)}
    toxic = [r["p_toxic"] > 0.5 for r in got if labels.get(r["doc_id"], {}).get("toxic") == 1 and labels[r["doc_id"]]["quality"] == 1]
    clean = [r["p_good"] > 0.5 for r in got if (labels.get(r["doc_id"], {}).get("quality"), labels.get(r["doc_id"], {}).get("toxic")) == (1, 0)]
    assert np.mean(toxic) > 0.8 and np.mean(clean) > 0.98
    assert abs(sum(r["copies"] for r in got) - rate.sum()) < 0.05 * len(got)


def test_posteriors_are_bernoulli(spark):
    rows = [(i, t) for i, t in enumerate(["red red fish", "red blue sky", "blue sea #### $$$$", "green tree", "red green", "blue blue"] * 4)]
    labels = spark.createDataFrame([(i, "a" if "red" in t else "b") for i, t in rows if i < 18], "doc_id long, domain string")
    docs = given(spark, rows)
    model = fit_domains(docs, labels, ["a", "b"])
    known = {i: "a" if "red" in t else "b" for i, t in rows if i < 18}
    n = Counter(known.values())
    counts = {d: Counter(w for i, t in rows if known.get(i) == d for w in seen(t)[1]) for d in "ab"}
    assert {"red", " symbols"} <= set(model.shifts) and "blue" not in model.shifts and "fish" in model.shifts
    for r in model.scored(docs.select("doc_id", F.split("text", " ").alias("kinds"), F.array().cast("array<string>").alias("marks"))).collect():
        words = set(rows[r["doc_id"]][1].split(" "))
        logs = []
        for d in "ab":
            p = {w: (counts[d][w] + 0.5) / (n[d] + 1) for w in model.shifts}
            logs.append(math.log((n[d] + 1) / 20) + sum(math.log(p[w] if w in words else 1 - p[w]) for w in p))
        odds = np.exp(np.array(logs) - max(logs))
        assert np.allclose(r["p"], odds / odds.sum())


@pytest.mark.parametrize("targets", [[10.0, 90.0], [0.0, 50.0], [500.0, 1.0]])
def test_rates_against_brute_force(spark, targets):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3, 0.3], 80)
    n = rng.integers(0, 9, 80)
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    found = fit_rates(df, targets)
    x, r = p * n[:, None], moved(p, found.steps)
    assert np.allclose((x.T @ r - targets) / sum(targets), found.gaps, atol=1e-9)
    again = descend(evaluated(n.astype(float), p), targets)
    assert np.allclose(r[n > 0], moved(p, again.steps)[n > 0], atol=1e-6)
    assert np.linalg.norm(x.T @ r - targets) <= least_squares(n.astype(float), p, np.array(targets)) + 1e-3 * sum(targets)
    assert found.met == (np.abs(found.gaps).max() <= 1e-4)
    assert fit_rates(df, targets, top=1.5).lengths[-1] >= found.lengths[-1] - 1e-3


def test_code_of_a_rate_does_not_grow_with_the_steps(spark):
    """The driver compiles one code for all steps of a descent, however many came before."""
    x = np.arange(8) / 8
    df = spark.range(8).select((F.col("id") / 8).alias("p0"), (1 - F.col("id") / 8).alias("p1"))
    codes = set()
    for n in (2, 9, 60):
        steps = [[0.02 * (-1) ** i, 0.003 * i] for i in range(n)]
        out = df.select(_rate([F.col("p0"), F.col("p1")], steps, 1.5).alias("rate"))
        assert np.allclose([r[0] for r in out.collect()], moved(np.stack([x, 1 - x], 1), steps, 1.5), atol=1e-12)
        codes.add(out._jdf.queryExecution().debug().codegenToSeq().apply(0)._2())
    assert len(codes) == 1


def test_equal_posteriors_are_one_row_of_the_descent(spark, monkeypatch):
    """Steps read a row for each posterior, and lead where all rows would lead."""
    from lodestone.llm import soft_mixing

    rows = [(n, [0.25 * (n % 4), 1 - 0.25 * (n % 4)]) for n in range(200)]
    read = []
    monkeypatch.setattr(soft_mixing, "written", lambda df, at: read.append(df.count()) or df, raising=False)
    found = fit_rates(spark.createDataFrame(rows, "n_tokens long, p array<double>"), [5000.0, 9000.0])
    again = descend(evaluated(np.array([float(r[0]) for r in rows]), np.array([r[1] for r in rows])), [5000.0, 9000.0])
    assert read == [4] and found.met == again.met and np.allclose(found.steps, again.steps)


def test_targets_out_of_reach_are_named(spark):
    """A domain that no document belongs to cannot have tokens: the fit ends, and says so."""
    df = spark.createDataFrame([(5, [1.0, 0.0]), (7, [1.0, 0.0])], "n_tokens long, p array<double>")
    found = fit_rates(df, [6.0, 6.0])
    assert not found.met and abs(found.gaps[0]) < 1e-3 and abs(found.gaps[1] + 0.5) < 1e-6
    report = {}
    with pytest.warns(UserWarning, match="no nonnegative rates"):
        mix(given(spark, ODD), spark.createDataFrame([], "doc_id long, domain string"), {"a": 0.9, "b": 0.1}, report=report)
    assert abs(report["a"] + report["b"]) < 1e-3 and report["b"] > 0.3


def test_copies_are_right_on_average(spark):
    docs = spark.createDataFrame([(i, f"w{i % 5} two three") for i in range(4000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, domain string")
    for total, slack in ((12000 * 0.013, 0.0), (12000 * 0.99, 0.0), (12000 * 0.013, 0.02), (12000 * 1.4, 0.02)):
        got = mix(docs, none, {"a": 1.0}, total=total, slack=slack).agg(F.sum("copies"), F.sum("rate")).first()
        assert abs(got[0] - got[1]) < 4 * (got[1] + 1) ** 0.5
    assert mix(docs, none, {"a": 1.0}, total=12000 * 0.99, slack=0.02).where("copies = 1").count() == 4000


def test_odd_rows_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, domain string")
    got = mix(given(spark, ODD), none, {"a": 0.5, "b": 0.5}).collect()
    assert len(got) == len(ODD) and all(r["rate"] == 1 and r["copies"] == 1 and r["p"] == [0.5, 0.5] for r in got)
    labels = spark.createDataFrame([(4, "a"), (5, "b"), (None, "a"), (7, None), (4, "b")], "doc_id long, domain string")
    got = mix(given(spark, ODD), labels, {"a": 0.5, "b": 0.5}, keep=("text",)).collect()
    assert sorted(r["text"] or "" for r in got) == sorted(t or "" for _, t in ODD)
    assert mix(given(spark, []), labels, {"a": 1.0}).collect() == []
