"""Classifiers of texts, their search and their evaluation.

Linear models are fitted by ``linear.py`` on distributed terms, all
configurations of a search at once. Embedding classifiers average word vectors.
"""

from __future__ import annotations

import json
import time
import warnings
from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.ml.base import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import hit_flag
from ..functions.text import bigrams, word_tokens
from ..session import written
from . import embeddings, linear
from .bayes import nb_predictions
from .metrics import class_report, confusion, cv_mean_score, macro_scores
from .unions import union_results

#: Limits of the optimiser that trains on embeddings: relative change of the loss, and steps.
TOLERANCE, MAX_ITERATIONS = 1e-4, 1_000
# The loss that each linear model minimises.
LOSSES = {"LogisticRegression": "softmax", "SVM": "squared_hinge", "LinearSVC": "squared_hinge"}
# Parameters of other optimisers that have no counterpart here and do not change what is fitted.
WITHOUT_EFFECT = {"solver", "dual", "random_state", "n_jobs", "thread", "verbose", "lrUpdateRate"}
# Parameters with a single supported value.
ONLY = {"penalty": ("l2",), "class_weight": (None,), "fit_prior": (True,), "class_prior": (None,), "fit_intercept": (True,)}
# The same for one model. Embeddings are of whole words, without hash buckets, subsampling or negative samples.
ONLY_OF = {
    "LogisticRegression": {"multi_class": ("auto", "multinomial")},
    "SVM": {"loss": ("squared_hinge",), "multi_class": ("ovr",)},
    "FastText": {"loss": ("softmax",), "minn": (0,), "maxn": (0,), "neg": (0,), "t": (0,), "bucket": (0,), "minCountLabel": (0, 1)},
}


@dataclass(frozen=True)
class Features:
    """The feature side of a configuration."""

    max_n: int = 1
    min_df: float = 1
    max_df: float | None = None
    binary: bool = False
    use_idf: bool = True
    norm: str | None = "l2"
    stop_words: tuple[str, ...] = ()


def _value(value):
    """A parameter's value; stored configurations spell lists, numbers and booleans as text."""
    if not isinstance(value, str):
        return value
    try:
        return json.loads(value.replace("(", "[").replace(")", "]"))
    except ValueError:
        return {"None": None, "True": True, "False": False}.get(value, value)


def split_configuration(model: str, params: Mapping) -> tuple[Features, dict]:
    """Features and classifier parameters of a stored configuration.

    ``step__`` prefixes are dropped. A parameter that no part of the model
    knows, or a value that it cannot honour, is an error.
    """
    bare = {key.split("__")[-1]: _value(value) for key, value in params.items()}
    known = {
        "LogisticRegression": {"C", "max_iter", "tol"},
        "SVM": {"C", "max_iter", "tol"},
        "NaiveBayes": {"alpha"},
        # Windows of neighbours (ws) and parts are of training without labels; they do not change what is fitted.
        "FastText": {"lr", "dim", "epoch", "wordNgrams", "ws", "minCount", "C", "partitions"},
    }
    kind = {"LinearSVC": "SVM", "MultinomialNB": "NaiveBayes"}.get(model, model)
    if kind not in known:
        raise ValueError(f"unknown model {model!r}")
    if "kernel" in bare and bare.pop("kernel") != "linear":
        raise ValueError("only linear kernels are supported")
    features, chosen = {}, {}
    for key, value in bare.items():
        if key == "ngram_range":
            low, high = value
            if low != 1:
                raise ValueError(f"unsupported n-gram range {value}")
            features["max_n"] = high
        elif key == "max_df" and value == 1.0 and isinstance(value, float):
            continue
        elif key == "stop_words":
            features[key] = tuple(value or ())
        elif key in Features.__dataclass_fields__:
            features[key] = value
        elif key in known[kind]:
            chosen[key] = value
        elif key in (only := ONLY | ONLY_OF.get(kind, {})):
            if value not in only[key]:
                raise ValueError(f"unsupported value {value!r} of {key!r} for {model}")
        elif key not in WITHOUT_EFFECT:
            raise ValueError(f"unknown parameter {key!r} of {model}")
    if kind in ("NaiveBayes", "FastText") and set(features) - {"max_n"}:
        raise ValueError(f"{model} does not support {sorted(set(features) - {'max_n'})}")
    return Features(**features), chosen


@contextmanager
def cached(df: DataFrame):
    """Rows that an optimiser passes over many times."""
    data = df.cache()
    try:
        yield data
    finally:
        data.unpersist()


def logistic_regression(
    c: float, n_rows: int, max_iter: int = MAX_ITERATIONS, tol: float = TOLERANCE, features: str = "features"
) -> LogisticRegression:
    """Penalised as C is meant elsewhere: the loss is summed, so regParam = 1 / (C * rows)."""
    return LogisticRegression(
        labelCol="label_code",
        featuresCol=features,
        regParam=1.0 / (c * n_rows),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=tol,
    )


def warn_unconverged(model: Model, max_iter: int, what: str) -> None:
    """Say so if an optimiser stopped at its last step."""
    summary = model.summary if not callable(model.summary) else model.summary()
    if summary.totalIterations >= max_iter:
        warnings.warn(f"{what} did not converge in {max_iter} steps", stacklevel=2)


def word_ngrams(text: str | Column, n: int) -> Column:
    """Words and, up to ``n`` (at most 3), their sequences, as tokens of an embedding."""
    if n not in (1, 2, 3):
        raise ValueError("wordNgrams must be 1, 2 or 3")
    words = word_tokens(text)

    def joined(w: Column) -> Column:
        parts = [w] + ([bigrams(w)] if n >= 2 else [])
        if n == 3:
            size = F.greatest(F.size(w) - 2, F.lit(0))
            pairs = F.slice(bigrams(w), 1, size)
            parts.append(F.zip_with(pairs, F.slice(w, 3, size), lambda a, b: F.concat_ws(" ", a, b)))
        return F.concat(*parts)

    return F.get(F.transform(F.array(words), joined), 0)


def _embedding_predictions(
    train: DataFrame, holdout: DataFrame, doc_id: str, text: str, label: str, params: Mapping
) -> DataFrame:
    """``doc, pred`` for the holdout rows: averaged word vectors, learned with the labels, and a linear classifier on top."""
    rows = train.select(doc_id, text, label, F.lit(1).alias("_fold")).unionByName(
        holdout.select(doc_id, text, F.lit(None).cast(train.schema[label].dataType).alias(label), F.lit(0).alias("_fold"))
    )
    named = (("lr", "lr", float), ("dim", "dim", int), ("epoch", "epoch", int), ("minCount", "min_count", int))
    limits = {new: kind(params[k]) for k, new, kind in named if k in params}
    words = word_ngrams(text, int(params.get("wordNgrams", 1)))
    labels, found = embeddings.document_vectors(rows, doc_id, words, label, "_fold", **limits)
    vectors = found.select("doc", "trained", F.col("y").cast("double").alias("label_code"), array_to_vector("features").alias("features"))
    with cached(vectors.where("trained")) as fitting:
        fitted = logistic_regression(float(params.get("C", 1000.0)), fitting.count()).fit(fitting)
    warn_unconverged(fitted, MAX_ITERATIONS, "FastText")
    codes = train.sparkSession.createDataFrame(list(enumerate(labels)), ["code", "pred"])
    # Rows to predict have no label here.
    scored = fitted.transform(vectors.where("label_code < 0")).select("doc", F.col("prediction").cast("long").alias("code"))
    return scored.join(F.broadcast(codes), "code").select("doc", "pred")


def _weighting(features: Features) -> linear.Weighting:
    kept = asdict(features)
    kept.pop("max_n")
    return linear.Weighting(**kept)


def _linear_predictions(
    train: DataFrame, holdout: DataFrame, doc_id: str, text: str, label: str, model: str, features: Features, params: Mapping
) -> DataFrame:
    """``doc, pred`` for the holdout rows, ``doc`` as text."""
    rows = train.select(doc_id, text, label, F.lit(1).alias("_fold")).unionByName(
        holdout.select(doc_id, text, label, F.lit(0).alias("_fold"))
    )
    problem = linear.Problem(features.max_n, 0, float(params.get("C", 1.0)))
    plan, labels, blocks = linear.prepare(rows, doc_id, text, label, "_fold", [problem], LOSSES[model], _weighting(features), names=False)
    limits = {new: kind(params[k]) for k, new, kind in (("max_iter", "max_steps", int), ("tol", "tol", float)) if k in params}
    fitted = linear.fit(plan, labels, blocks, **limits)
    codes = train.sparkSession.createDataFrame(list(enumerate(labels)), ["code", "pred"])
    found = linear.predictions(fitted).select("doc", "code")
    return found.join(F.broadcast(codes), "code").select("doc", "pred")


def fit_predict(
    train: DataFrame,
    holdout: DataFrame,
    doc_id: str,
    text: str,
    label: str,
    model: str,
    params: Mapping | None = None,
    origin: str = "Baseline",
    run_id: str | None = None,
) -> DataFrame:
    """Fit on ``train`` and predict ``holdout``: one prediction record per holdout row.

    Training rows without a label are left out. ``doc_id`` is unique. The
    predictions are stored; ``tempo_resposta_s`` is the time that took, per row.
    """
    features, chosen = split_configuration(model, params or {})
    train = train.where(F.col(label).isNotNull())
    start = time.perf_counter()
    if model in ("NaiveBayes", "MultinomialNB"):
        rows = train.select(doc_id, text, label, F.lit(1).alias("_fold")).unionByName(
            holdout.select(doc_id, text, F.coalesce(F.col(label), F.lit("")).alias(label), F.lit(0).alias("_fold"))
        )
        found = nb_predictions(
            rows, doc_id, text, label, "_fold", [0], [features.max_n], [float(chosen.get("alpha", 1.0))]
        ).select(F.col("doc").cast("string"), "pred")
        stored = written(found, "predictions")
    else:
        if model == "FastText":
            found = _embedding_predictions(train, holdout, doc_id, text, label, chosen)
        else:
            found = _linear_predictions(train, holdout, doc_id, text, label, model, features, chosen)
        start = time.perf_counter()
        stored = written(found, "predictions")
    seconds = (time.perf_counter() - start) / max(stored.count(), 1)
    records = holdout.select(F.col(doc_id).cast("string").alias("doc"), label, text).join(stored, "doc", "left")
    return records.select(
        F.col("doc").alias("demanda_id"),
        F.col(label).alias("classificacao_real"),
        F.lit(f"ML_{origin}").alias("prompt_id"),
        F.lit(model).alias("modelo_id"),
        F.col("pred").alias("classificacao_limpa"),
        hit_flag("pred", label).alias("acertou"),
        F.col(text).alias("demanda_texto"),
        F.col("pred").alias("classificacao_raw"),
        F.lit(seconds).alias("tempo_resposta_s"),
        F.lit(None).cast("string").alias("erro"),
        F.lit(1).alias("try_count"),
        F.lit(run_id).cast("string").alias("run_id"),
        F.lit(origin).alias("origin"),
    )


def fit_registry(
    entries: DataFrame, train: DataFrame, holdout: DataFrame, doc_id: str, text: str, label: str
) -> DataFrame:
    """Train every entry of a registry (``run_id, model, params, origin``; params as JSON text) and stack the records."""
    tables = [
        fit_predict(
            train, holdout, doc_id, text, label, e["model"], json.loads(e["params"] or "{}"), e["origin"], e["run_id"]
        )
        for e in entries.select("run_id", "model", "params", "origin").orderBy("run_id", "model").collect()
    ]
    return union_results(*tables)


def holdout_report(predictions: DataFrame) -> DataFrame:
    """Class report of prediction records, per model."""
    counts = confusion(predictions, "classificacao_real", "classificacao_limpa", ["modelo_id"])
    return class_report(counts, ["modelo_id"])


def macro_f1(predictions: DataFrame, true: str, pred: str) -> float:
    return float(macro_scores(confusion(predictions, true, pred)).first()["macro_f1"])


def majority_f1(df: DataFrame, label: str) -> float:
    """Macro F1 of always predicting the most frequent label."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    labels, total, most = counts.agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).first()
    return 2 * most / (total + most) / labels


def grid_cv(
    df: DataFrame,
    text: str,
    label: str,
    fold: str,
    model: str,
    max_ngrams: Sequence[int] = (1, 2),
    cs: Sequence[float] = (0.1, 1.0, 10.0),
    max_steps: int = linear.MAX_STEPS,
    tol: float = linear.TOLERANCE,
) -> DataFrame:
    """Mean macro F1 over the folds of every (n-gram range, C), best first: ``model, max_n, C, mean_score, n_folds, n_steps``.

    All configurations and folds are one optimisation: a step is one pass over
    the terms for all of them, and ``n_steps`` is the number of steps. Weights
    of terms come from each training fold, where unseen terms get none. Folds
    come from a column, so they can be stratified. Rows without a label are
    left out.
    """
    spark = df.sparkSession
    rows = df.where(F.col(label).isNotNull()).select(text, label, F.col(fold).cast("int").alias("fold"))
    rows = rows.withColumn("doc", F.monotonically_increasing_id())
    folds = [r["fold"] for r in rows.select("fold").distinct().orderBy("fold").collect()]
    problems = [linear.Problem(n, f, float(c)) for n in max_ngrams for c in cs for f in folds]
    plan, labels, blocks = linear.prepare(rows, "doc", text, label, "fold", problems, LOSSES[model], linear.Weighting(), names=False)
    fitted = linear.fit(plan, labels, blocks, max_steps, tol)
    numbered = [(i, p.max_n, p.c) for i, p in enumerate(problems)]
    config = spark.createDataFrame(numbered, "problem long, max_n int, C double")
    scores = macro_scores(confusion(linear.predictions(fitted), "y", "code", ["problem"]), ["problem"])
    ranked = cv_mean_score(scores.join(F.broadcast(config), "problem"), ["max_n", "C"])
    return ranked.select(
        F.lit(model).alias("model"), "max_n", "C", "mean_score", F.col("n_folds").cast("int"), F.lit(fitted.steps).alias("n_steps")
    ).orderBy(F.col("mean_score").desc(), "max_n", "C")
