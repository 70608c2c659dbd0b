"""Scoring, attempts, streams and classifiers."""

import uuid

import pytest
from pyspark.sql import functions as F

from tallywright.operators import classifiers, ledger, scoring
from tallywright.operators.joins import cross_prompt_model, disagreement_pairs, with_catalogue
from tallywright.session import scratch_path
from tallywright.streaming import results


def test_score_batch_turns_failures_into_rows(spark):
    def scorer(model, prompt, attempt):
        if prompt == "down":
            raise RuntimeError("boom")
        if prompt == "busy" and attempt < 4:
            raise RuntimeError("429")
        if prompt == "off":
            raise ValueError("Cliente X não inicializado.")
        return None if prompt == "nothing" else f" {model} {prompt} "

    rows = [(p,) for p in ("ok", "down", "busy", "off", "nothing")]
    calls = spark.createDataFrame(rows, "prompt string").withColumn("model_id", F.lit("m"))
    scored = {r["prompt"]: r for r in scoring.score_batch(calls, scorer, base_backoff=0.0).collect()}
    outcome = {p: (r["raw_text"], r["erro"], r["try_count"]) for p, r in scored.items()}
    assert outcome == {
        "ok": ("m ok", None, 1),
        "down": (None, "boom", 5),
        "busy": ("m busy", None, 4),
        "off": (None, "Cliente X não inicializado.", 1),
        "nothing": (None, None, 1),
    }
    assert all(r["tempo_s"] >= 0 for r in scored.values())


def test_collapse_attempts(spark):
    rows = (
        [("a", i, "429", 1.0) for i in range(7)]
        + [("b", 0, "timeout", 1.0), ("b", 1, None, 2.0), ("b", 2, "late", 9.0)]
        + [("c", 0, "não inicializado", 0.5), ("c", 1, None, 1.0)]
        + [("d", 0, None, 0.25)]
    )
    log = spark.createDataFrame(rows, "item string, at int, error string, s double")
    found = {
        r["item"]: (r["succeeded"], r["try_count"], r["erro"], r["busy_s"], r["wait_s"])
        for r in scoring.collapse_attempts(log, "item", ["at"], "error", "s").collect()
    }
    assert found == {
        "a": (0, 5, "429", 5.0, 15.0),
        "b": (1, 2, None, 3.0, 1.0),
        "c": (0, 1, "não inicializado", 0.5, 0.0),
        "d": (1, 1, None, 0.25, 0.0),
    }


def test_stream_continues_from_its_checkpoint(spark, tmp_path):
    source = str(tmp_path / "in")
    sink, checkpoint = scratch_path(spark, "sink"), scratch_path(spark, "cp")
    state, state_checkpoint = scratch_path(spark, "state"), scratch_path(spark, "state-cp")
    batches = [[("m", "a", "a", 1.0), ("m", "a", "b", 2.0)], [("m", "b", "b", 3.0)], [("m", "b", "a", None)]]
    schema = "model string, true_label string, pred_label string, latency_s double"
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = results.read_incoming(spark, source, spark.createDataFrame([], schema).schema, files_per_batch=1)
        results.append_incoming(stream, sink, checkpoint)
        results.count_incoming(stream, ["model"], "true_label", "pred_label", "latency_s", state, state_checkpoint)
    assert spark.read.parquet(sink).count() == 4
    row = results.running_leaderboard(spark, state, ["model"]).first()
    assert (row["n"], row["accuracy"], row["macro_f1"], row["mean_latency_s"]) == (4, 0.5, 0.5, 2.0)


def test_a_job_that_dies_does_not_repeat_its_calls(spark, tmp_path):
    calls, log = str(tmp_path / "ledger"), tmp_path / "calls"
    rows = [(i, f"m{i % 2}", f"prompt {i // 2 % 40}") for i in range(200)] + [(200, None, "p"), (201, "m1", None)]
    df = spark.createDataFrame(rows, "id long, model_id string, prompt string").repartition(4)
    log.mkdir()

    def scorer(model, prompt, attempt):
        with open(log / str(uuid.uuid4()), "w") as out:
            out.write(f"{model}/{prompt}")
        return f"{model}: {prompt}"

    commit, committed = ledger._commit, []

    def dies(spark, table, path):
        if len(committed) == 2:
            table.count()  # the calls of the third batch are made, but it is not committed
            raise RuntimeError("killed")
        committed.append(1)
        commit(spark, table, path)

    ledger._commit = dies
    try:
        with pytest.raises(RuntimeError, match="killed"):
            ledger.score_once(df, scorer, calls, base_backoff=0.0, calls_in_a_batch=20)
    finally:
        ledger._commit = commit
    kept = {r["call_key"] for r in ledger.answered(spark, calls).collect()}
    before = [p.read_text() for p in log.iterdir()]
    for p in log.iterdir():
        p.unlink()
    done = ledger.score_once(df, scorer, calls, base_backoff=0.0, calls_in_a_batch=20).collect()
    again = [p.read_text() for p in log.iterdir()]
    assert len(done) == 202 and all(r["raw_text"] == f"{r['model_id']}: {r['prompt']}" for r in done)
    assert 0 < len(kept) < 82 and len(again) == len(set(again)) == 82 - len(kept)
    assert len(set(before)) > len(kept)
    assert ledger.score_once(df.limit(0), scorer, calls).count() == 0 and len(list(log.iterdir())) == len(again)


def test_catalogues_of_any_length(spark):
    with pytest.raises(ValueError, match="at least one"):
        with_catalogue(spark.range(1), [])
    long = with_catalogue(spark.range(3), [{"x": i, "y": f"t{i}"} for i in range(1500)])
    assert long.columns == ["id", "x", "y"] and long.distinct().count() == 4500
    prompts = [{"id": "p", "template": "t"}, {"id": "q", "template": "u"}]
    assert cross_prompt_model(spark.range(3), prompts, ["m", "n"]).distinct().count() == 12


def test_disagreement_counts_copies(spark):
    schema = "text string, label string, pred string, run string"
    llm = spark.createDataFrame([("t", "a", "x", "l1")] * 3 + [("u", "a", "x", "l1")], schema)
    local = spark.createDataFrame([("t", "a", "y", "k1")] * 2 + [("t", "a", "x", "k2"), ("u", "a", "x", "k1")], schema)
    rows = disagreement_pairs(llm, local, "text", "label", "pred", "run").collect()
    assert [(r["text"], r["llm_pred"], r["local_pred"], r["local_run"], r["n_pairs"]) for r in rows] == [
        ("t", "x", "y", "k1", 6)
    ]


def test_classifiers_learn(spark):
    words = {"A": "gato cachorro pato", "B": "carro moto trem"}
    rows = [(i, f"{words[c]} {i % 7}x", c) for i, c in enumerate("AB" * 30)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    train, holdout = df.where("id < 40"), df.where("id >= 40")
    unlabelled = train.unionByName(spark.createDataFrame([(99, "gato", None)], df.schema))
    for model, params in (
        ("LogisticRegression", {"clf__C": 2.0, "tfidf__ngram_range": "(1, 2)", "tfidf__use_idf": "False"}),
        ("SVM", {"tfidf__norm": None, "tfidf__min_df": 2}),
        ("NaiveBayes", {"nb__alpha": "0.5"}),
    ):
        records = classifiers.fit_predict(unlabelled, holdout, "id", "text", "label", model, params, "grid", "r1")
        assert records.columns[:6] == [
            "demanda_id", "classificacao_real", "prompt_id", "modelo_id", "classificacao_limpa", "acertou",
        ]
        assert records.agg(F.min("acertou"), F.count("*")).first()[:] == (1, 20)
        row = records.first()
        assert row["tempo_resposta_s"] > 0 and (row["run_id"], row["origin"]) == ("r1", "grid")
    best = classifiers.grid_cv(
        df.withColumn("fold", (F.col("id") / 2 % 3).cast("int")), "text", "label", "fold", "LogisticRegression",
        max_ngrams=(1,), cs=(1.0,),
    ).first()
    assert (best["mean_score"], best["n_folds"]) == (1.0, 3)
    assert classifiers.majority_f1(df, "label") == pytest.approx(1 / 3)


@pytest.mark.parametrize(
    ("model", "params", "message"),
    [
        ("nope", {}, "unknown model"),
        ("SVM", {"svm__gamma": 1}, "unknown parameter"),
        ("SVM", {"kernel": "rbf"}, "linear kernels"),
        ("SVM", {"penalty": "l1"}, "unsupported value"),
        ("NaiveBayes", {"tfidf__min_df": 2}, "does not support"),
        ("SVM", {"ngram_range": "[2,2]"}, "n-gram range"),
    ],
)
def test_unsupported_parameters_are_refused(model, params, message):
    with pytest.raises(ValueError, match=message):
        classifiers.split_configuration(model, params)


@pytest.mark.parametrize(
    ("model", "key", "refused", "honoured"),
    [
        ("SVM", "loss", "hinge", "squared_hinge"),
        ("FastText", "loss", "hs", "softmax"),
        ("FastText", "minn", 2, 0),
        ("FastText", "maxn", "5", "0"),
        ("FastText", "neg", 5, 0),
        ("FastText", "t", 1e-4, 0),
        ("FastText", "bucket", 2_000_000, 0),
        ("FastText", "minCountLabel", 3, 1),
        ("LogisticRegression", "multi_class", "ovr", "multinomial"),
    ],
)
def test_parameters_that_change_the_fit_are_not_ignored(model, key, refused, honoured):
    assert classifiers.split_configuration(model, {key: honoured}) == (classifiers.Features(), {})
    with pytest.raises(ValueError, match="unsupported value"):
        classifiers.split_configuration(model, {key: refused})


def test_stored_parameters_are_decoded():
    features, chosen = classifiers.split_configuration(
        "LogisticRegression",
        {"tfidf__ngram_range": "[1,2]", "tfidf__binary": "true", "tfidf__max_df": 1.0, "clf__C": 10, "clf__solver": "lbfgs"},
    )
    assert features == classifiers.Features(max_n=2, binary=True) and chosen == {"C": 10}
