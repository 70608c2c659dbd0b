"""Averaged word vectors that are learned with the labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.functions.text import word_tokens
from tallywright.operators import classifiers, embeddings


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(4)
    made = [(i, " ".join(f"w{w}x" for w in draw.integers(i % 3 * 5, i % 3 * 5 + 9, 10)), "abc"[i % 3]) for i in range(180)]
    return spark.createDataFrame(made, "id long, text string, label string").repartition(3)


def vectors(rows, **options):
    folded = rows.withColumn("fold", (F.col("id") % 4).cast("int"))
    args = dict(lr=0.5, dim=8, epoch=3) | options
    labels, found = embeddings.document_vectors(folded, "id", word_tokens("text"), "label", "fold", **args)
    return labels, {r["doc"]: (r["y"], r["trained"], np.array(r["features"])) for r in found.collect()}


def test_vectors_follow_the_labels(rows):
    """Training without labels could not tell which of the words go together in a label."""
    labels, found = vectors(rows)
    assert labels == ["a", "b", "c"] and len(found) == 180
    assert all(trained == (int(doc) % 4 != 0) for doc, (_, trained, _) in found.items())
    middle = [np.mean([x for y, trained, x in found.values() if trained and y == k], axis=0) for k in range(3)]
    held = [(y, x) for y, trained, x in found.values() if not trained]
    assert np.mean([np.argmin([np.linalg.norm(x - m) for m in middle]) == y for y, x in held]) > 0.8
    _, again = vectors(rows)
    assert all(np.allclose(found[d][2], again[d][2], atol=1e-6) for d in found)


def test_blocks_of_any_size_learn(rows):
    """Words meet over blocks; a word that only rows to predict have has no part."""
    odd = rows.unionByName(rows.sparkSession.createDataFrame([(400, "nowhere", None), (401, None, "a"), (404, "w0x nowhere", "a"), (408, "w0x", "a")], rows.schema))
    for size in (10_000, 20):
        _, found = vectors(odd, block_rows=size)
        assert len(found) == 184 and not found["400"][2].any() and not found["401"][2].any()
        assert np.allclose(found["404"][2], found["408"][2]) and found["408"][2].any()
    _, counted = vectors(odd.unionByName(rows.sparkSession.createDataFrame([(501, "twice twice once", "a")], rows.schema)), min_count=2, epoch=1)
    assert counted["501"][2].any()


def test_embedding_classifier_predicts(rows):
    train, holdout = rows.where("id < 120"), rows.where("id >= 120")
    params = {"lr": 0.5, "dim": 8, "epoch": 3, "wordNgrams": 2, "minCount": 2, "ws": 5}
    records = classifiers.fit_predict(train, holdout, "id", "text", "label", "FastText", params)
    found = records.agg(F.avg("acertou"), F.count("classificacao_limpa")).first()
    assert found[0] > 0.8 and found[1] == 60


def test_one_label(rows):
    labels, found = vectors(rows.where("label = 'a'"))
    assert labels == ["a"] and len(found) == 60
