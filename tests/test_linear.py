"""Distributed linear fits against plain dense ones."""

import inspect
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.operators import halving, linear
from tallywright.operators.classifiers import grid_cv
from tallywright.plans import model_queries

WORDS = [f"w{i}x" for i in range(14)]


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(5)
    made = []
    for i in range(90):
        label = "abc"[i % 3]
        own = [WORDS["abc".index(label) * 4 + k] for k in draw.integers(0, 4, 4)]
        made.append((i, " ".join([*own, *draw.choice(WORDS, 5)]), label, int(draw.integers(0, 3))))
    # A rare label, a row without words and one without a label.
    return [*made, (90, "rare word rare", "d", 1), (91, "rare word once", "d", 2), (92, "", "a", 1), (93, "w1x", None, 0)]


def dense(rows, problem):
    """Features, codes and the training mask of a problem, by plain loops."""
    def terms(text):
        words = text.split()
        return Counter(words + ([f"{a} {b}" for a, b in zip(words, words[1:])] if problem.max_n == 2 else []))

    train = [r[2] is not None and r[3] != problem.fold for r in rows]
    df = Counter(t for r, used in zip(rows, train) if used for t in terms(r[1]))
    names = sorted(df)
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        for t, n in terms(r[1]).items():
            if t in df:
                x[i, names.index(t)] = n * (math.log((1 + sum(train)) / (1 + df[t])) + 1)
        x[i] /= np.linalg.norm(x[i]) or 1
    labels = sorted({r[2] for r in rows if r[2]})
    y = np.array([labels.index(r[2]) if r[2] else -1 for r in rows])
    return names, x, y, np.array(train)


def minimum(kind, x, y, train, c, k):
    """Weights and intercepts by plain gradient descent with a step that halves."""
    x, y, penalty = x[train], y[train], 0.0 if kind == "softmax" else 1.0

    def value(w, b):
        loss, slope = linear.losses(kind, (x @ w + b)[:, None, :], y)
        total = c * loss.sum() + ((w * w).sum() + penalty * (b * b).sum()) / 2
        return total, w + c * x.T @ slope[:, 0], penalty * b + c * slope[:, 0].sum(axis=0)

    w, b, step = np.zeros((x.shape[1], k)), np.zeros(k), 1.0
    now, gw, gb = value(w, b)
    for _ in range(6000):
        after = value(w - step * gw, b - step * gb)
        if after[0] > now - step * ((gw**2).sum() + (gb**2).sum()) / 4:
            step /= 2
            continue
        w, b, step = w - step * gw, b - step * gb, step * 1.5
        now, gw, gb = after
    return now, w, b


@pytest.mark.parametrize("kind", ["softmax", "squared_hinge"])
def test_fits_equal_dense_ones(spark, rows, kind):
    df = spark.createDataFrame(rows, "id long, text string, label string, fold int").repartition(5)
    problems = [linear.Problem(n, f, c) for n, f, c in ((1, 0, 0.3), (2, 1, 5.0))]
    plan, labels, blocks = linear.prepare(df, "id", "text", "label", "fold", problems, kind, linear.Weighting())
    fitted = linear.fit(plan, labels, blocks, tol=3e-4)
    assert fitted.converged.all() and fitted.steps < 100
    found = {(r["problem"], int(r["doc"])): r["code"] for r in linear.predictions(fitted).collect()}
    for number, problem in enumerate(problems):
        names, x, y, train = dense(rows, problem)
        least, w, b = minimum(kind, x, y, train, problem.c, len(labels))
        terms, classes = linear.stored_model(fitted, number)
        own = np.zeros_like(w)
        for r in terms.collect():
            own[names.index(r["term"])] = r["weights"]
        loss, _ = linear.losses(kind, (x[train] @ own + fitted.intercept[number])[:, None, :], y[train])
        penalty = (own**2).sum() + (0 if kind == "softmax" else (fitted.intercept[number] ** 2).sum())
        assert problem.c * loss.sum() + penalty / 2 <= least * 1.001
        best = (x @ w + b).argmax(axis=1)
        margins = np.sort(x @ w + b, axis=1)
        for i, r in enumerate(rows):
            if r[3] == problem.fold and margins[i, -1] - margins[i, -2] > 0.05:
                assert found[number, r[0]] == best[i]
        fresh = df.where(F.col("fold") == problem.fold)
        scored = linear.score(terms, classes, fresh, "id", "text", problem.max_n).collect()
        assert {r["id"]: r["pred"] for r in scored} == {i: labels[c] for (n, i), c in found.items() if n == number}


def test_search_returns_scores_and_steps(spark, rows):
    df = spark.createDataFrame(rows, "id long, text string, label string, fold int")
    found = grid_cv(df, "text", "label", "fold", "LinearSVC", max_ngrams=(1,), cs=(0.01, 2.0)).collect()
    assert [r["C"] for r in found] == [2.0, 0.01] and found[0]["mean_score"] > 0.5
    assert {r["n_folds"] for r in found} == {3} and found[0]["n_steps"] < 100


def test_bounds_binary_counts_and_norms(spark):
    df = spark.createDataFrame([(1, "aa aa bb", "x", 1), (2, "aa cc", "y", 1), (3, "aa dd dd", "x", 0)], "id long, text string, label string, fold int")
    weighting = linear.Weighting(min_df=2, binary=True, use_idf=False, norm=None)
    plan, labels, blocks = linear.prepare(df, "id", "text", "label", "fold", [linear.Problem(1, 0, 1.0)], "softmax", weighting)
    terms, _ = linear.stored_model(linear.fit(plan, labels, blocks))
    assert [(r["term"], r["scale"]) for r in terms.collect()] == [("aa", 1.0)]
    with pytest.raises(ValueError, match="norm"):
        linear.Weighting(norm="l3")


def test_a_rare_label_is_learned(spark):
    made = [(i, f"{'even' if i % 2 else 'odd'} filler{i % 11}", str(i % 2), 1) for i in range(2000)]
    df = spark.createDataFrame([*made, (-1, "special words", "2", 1), (-2, "special words", "2", 0)], "id long, text string, label string, fold int")
    plan, labels, blocks = linear.prepare(df, "id", "text", "label", "fold", [linear.Problem(1, 0, 15.0)], "softmax", linear.Weighting())
    found = linear.predictions(linear.fit(plan, labels, blocks)).collect()
    assert [labels[r["code"]] for r in found] == ["2"]


def test_empty_and_unlabelled_tables(spark):
    df = spark.createDataFrame([(1, "aa", None, 0)], "id long, text string, label string, fold int")
    blank = df.unionByName(spark.createDataFrame([(2, "", "x", 1), (3, None, "y", 1), (4, "", None, 0)], df.schema)).where("id > 1")
    for rows in (df, df.limit(0), blank):
        plan, labels, blocks = linear.prepare(rows, "id", "text", "label", "fold", [linear.Problem(1, 0, 1.0)], "softmax", linear.Weighting())
        fitted = linear.fit(plan, labels, blocks)
        assert labels == ["x", "y"][: 2 * (rows is blank)]
        assert linear.predictions(fitted).count() == rows.where("fold = 0").count()
        assert linear.stored_model(fitted)[0].count() == 0


def test_halving_equals_plain_halving(spark, rows):
    df = spark.createDataFrame([(*r[:3], r[3] % 3) for r in rows if r[2]], "id long, text string, label string, fold int")
    draws = spark.createDataFrame([(f"d{i}", 1 + i % 2, 0.1 * 3**i) for i in range(7)], "draw string, max_n int, C double")
    seen = []

    def scores(some_rows, some):
        ids = {r["id"] for r in some_rows.collect()}
        seen.append((ids, [d[0] for d in some]))
        return {d[0]: round((d[2] * len(ids)) % 1.7, 1) for d in some}

    got = halving.successive_halving(df, draws, "id", "text", "label", scores=scores).collect()
    assert [len(names) for _, names in seen] == [7, 4, 2]
    fold_0 = {r[0] for r in rows if r[2] and r[3] % 3 == 0}
    assert fold_0 < seen[0][0] < seen[1][0] < seen[2][0] == {r[0] for r in rows if r[2]}
    left = [f"d{i}" for i in range(7)]
    c = {f"d{i}": 0.1 * 3**i for i in range(7)}
    for number, (ids, names) in enumerate(seen, 1):
        assert names == left or sorted(names) == sorted(left)
        score = {d: round((c[d] * len(ids)) % 1.7, 1) for d in left}
        left = sorted(left, key=lambda d: (-score[d], d))[: 1 if number == 3 else -(-len(left) // 2)]
        mine = [r for r in got if r["round"] == number]
        assert {r["draw"]: r["score"] for r in mine} == score
        assert {r["draw"] for r in mine if r["survives"]} == set(left)
    assert all(0.05 <= r["C"] <= 50 and r["max_n"] in (1, 2) for r in halving.linear_draws(spark.range(40), "id").collect())


def test_full_report_searches_words_and_pairs(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"w{i % 3}x", "ab"[i % 2], ("train", "holdout")[i % 5 == 0]) for i in range(30)], "doc_id long, text string, lang string, part string")
    records = spark.createDataFrame([("m", "a", "a")], "modelo_id string, classificacao_real string, classificacao_limpa string")
    asked = []

    def search(*args, **kwargs):
        asked.append(tuple(inspect.signature(grid_cv).bind(*args, **kwargs).arguments.get("max_ngrams", (1, 2))))
        return spark.createDataFrame([(2, 1.0)], "max_n int, C double")

    monkeypatch.setattr(model_queries, "_parts", lambda *a: (rows.where("part = 'train'"), rows.where("part = 'holdout'")))
    monkeypatch.setattr(model_queries.classifiers, "grid_cv", search)
    monkeypatch.setattr(model_queries.classifiers, "fit_predict", lambda *a, **k: records)
    monkeypatch.setattr(model_queries.bayes, "nb_grid_cv", lambda *a, **k: spark.createDataFrame([(1, 0.5, 0.9)], "max_n int, alpha double, mean_score double"))
    assert model_queries.holdout_report_full(spark, "").count() > 0
    assert asked == [(1, 2), (1, 2)]


def test_a_step_goes_back_until_it_is_short_enough(spark, rows):
    df = spark.createDataFrame([r for r in rows if r[2]], "id long, text string, label string, fold int")
    plan, labels, blocks = linear.prepare(df, "id", "text", "label", "fold", [linear.Problem(1, 1, 2.0)], "squared_hinge", linear.Weighting())
    fitted = linear.fit(plan, labels, blocks)
    # Going back twice went forth again, and the fit of the rare label took all 200 steps.
    assert fitted.converged.all() and fitted.steps < 40
