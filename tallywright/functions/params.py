"""Hyper-parameter maps: routing keys to the feature or the classifier side, decoding genes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _column

# Parameters of the feature step.
FEATURE_KEYS = ["ngram_range", "min_df", "max_df", "use_idf", "binary", "stop_words", "norm"]
# Parameters each classifier accepts.
CLASSIFIER_KEYS = {
    "LogisticRegression": [
        "C", "solver", "penalty", "max_iter", "tol", "class_weight", "random_state", "n_jobs",
    ],
    "NaiveBayes": ["alpha", "fit_prior", "class_prior"],
    "SVM": [
        "C", "penalty", "loss", "dual", "tol", "multi_class", "fit_intercept", "class_weight",
        "random_state", "max_iter",
    ],
    "FastText": [
        "lr", "dim", "ws", "epoch", "minCount", "minCountLabel", "minn", "maxn", "neg",
        "wordNgrams", "loss", "bucket", "thread", "lrUpdateRate", "t",
    ],
}
DEFAULT_NGRAM_RANGE = "[1,1]"


def bare_params(params: str | Column) -> Column:
    """Drop the ``step__`` prefix from every key of a string map."""
    return F.transform_keys(_column(params), lambda k, _: F.element_at(F.split(k, "__"), -1))


def _only(params: Column, keys: Sequence[str]) -> Column:
    allowed = F.array(*[F.lit(k) for k in keys])
    return F.map_filter(params, lambda k, _: F.array_contains(allowed, k))


def feature_params(params: str | Column) -> Column:
    """The feature side of a parameter map, with the default n-gram range filled in."""
    found = _only(bare_params(params), FEATURE_KEYS)
    missing = F.create_map(F.lit("ngram_range"), F.lit(DEFAULT_NGRAM_RANGE))
    return F.when(F.map_contains_key(found, "ngram_range"), found).otherwise(F.map_concat(found, missing))


def classifier_params(params: str | Column, model: str | Column) -> Column:
    """The classifier side of a parameter map: only keys the model type accepts."""
    bare = bare_params(params)
    model = _column(model)
    return F.coalesce(*[F.when(model == name, _only(bare, keys)) for name, keys in CLASSIFIER_KEYS.items()])


def decode_gene(gene: str | Column, values: Sequence) -> Column:
    """The parameter value an integer gene stands for."""
    return F.get(F.array(*[F.lit(v) for v in values]), _column(gene).cast("int"))


def decode_config(genes: str | Column, space: Mapping[str, Sequence]) -> list[Column]:
    """One named column per gene of an individual (an integer array), in the order of ``space``."""
    genes = _column(genes)
    return [decode_gene(F.get(genes, i), values).alias(name) for i, (name, values) in enumerate(space.items())]
