"""Queries: classifiers, their search and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import TOKEN
from ..operators import bayes, classifiers, halving, linear, unions, windows
from ..operators.metrics import leaderboard
from ..operators.sampling import stratified_folds, stratified_split
from ..session import scratch_path, written
from ..sources import runs
from . import derived
from .derived import FOLDS, SPLIT, sql_scores
from .registry import query, rounded, table


def sql_naive_bayes(docs: str, folds: str, ngrams: str, alphas: str) -> str:
    """CTEs ending in ``predicted``: naive Bayes over ``docs(doc_id, label, fold, text)``."""
    return f"""tok AS (SELECT doc_id, label, fold, regexp_extract_all(lower(text), '{TOKEN}') AS w FROM {docs}),
terms AS (SELECT doc_id, label, fold, 1 AS n, unnest(w) AS term FROM tok
  UNION ALL SELECT doc_id, label, fold, 2, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM tok),
post AS (SELECT doc_id, label, fold, n, term, count(*) AS tf FROM terms GROUP BY ALL),
ev AS (SELECT * FROM (VALUES {folds}) t(f)), gs AS (SELECT * FROM (VALUES {ngrams}) t(g)),
al AS (SELECT CAST(a AS DOUBLE) AS a FROM (VALUES {alphas}) t(a)),
ntr AS (SELECT f, count(*) AS ndocs FROM {docs} JOIN ev ON fold <> f GROUP BY f),
idf AS (SELECT f, n, term, ln((1.0 + ndocs) / (1.0 + count(*))) + 1 AS idf
  FROM post JOIN ev ON fold <> f JOIN ntr USING (f) GROUP BY f, n, term, ndocs),
w0 AS (SELECT f, g, doc_id, label, fold, term, tf * idf AS r FROM post JOIN idf USING (n, term) JOIN gs ON n <= g),
wt AS (SELECT *, r / sqrt(sum(r * r) OVER (PARTITION BY f, g, doc_id)) AS wt FROM w0),
cls AS (SELECT f, g, label AS c, term, sum(wt) AS s FROM wt WHERE fold <> f GROUP BY ALL),
tot AS (SELECT f, g, c, sum(s) AS t FROM cls GROUP BY ALL),
voc AS (SELECT f, g, count(*) AS v FROM idf JOIN gs ON n <= g GROUP BY ALL),
prior AS (SELECT f, label AS c, ln(count(*) / CAST(ndocs AS DOUBLE)) AS lp
  FROM {docs} JOIN ev ON fold <> f JOIN ntr USING (f) GROUP BY f, label, ndocs),
gain AS (SELECT wt.f, wt.g, a, doc_id, c, sum(wt * (ln(s + a) - ln(a))) AS gain
  FROM wt JOIN cls ON wt.f = cls.f AND wt.g = cls.g AND wt.term = cls.term CROSS JOIN al WHERE fold = wt.f GROUP BY ALL),
mass AS (SELECT f, g, doc_id, sum(wt) AS m FROM wt WHERE fold = f GROUP BY ALL),
ranked AS (SELECT d.doc_id, d.label, ev.f AS fold, gs.g AS max_n, al.a AS alpha, p.c AS pred,
    lp + coalesce(m, 0) * (ln(al.a) - ln(t + al.a * v)) + coalesce(gain, 0) AS score
  FROM {docs} d JOIN ev ON d.fold = ev.f CROSS JOIN gs CROSS JOIN al JOIN prior p ON p.f = ev.f
  JOIN tot ON tot.f = ev.f AND tot.g = gs.g AND tot.c = p.c JOIN voc ON voc.f = ev.f AND voc.g = gs.g
  LEFT JOIN mass ON mass.f = ev.f AND mass.g = gs.g AND mass.doc_id = d.doc_id
  LEFT JOIN gain ON gain.f = ev.f AND gain.g = gs.g AND gain.a = al.a AND gain.doc_id = d.doc_id AND gain.c = p.c),
predicted AS (SELECT * FROM ranked
  QUALIFY row_number() OVER (PARTITION BY fold, max_n, alpha, doc_id ORDER BY score DESC, pred) = 1)"""


@query(
    "naive_bayes",
    f"""WITH {SPLIT}, docs AS (SELECT doc_id, lang AS label, CASE part WHEN 'holdout' THEN 0 ELSE 1 END AS fold, text FROM split),
{sql_naive_bayes('docs', '(0)', '(1)', '(1.0)')}
SELECT doc_id, label, pred, round(score, 6) AS score FROM predicted""",
)
def naive_bayes(spark, sf_dir):
    split = stratified_split(derived.split_documents(spark, sf_dir), "doc_id", "lang")
    folded = split.withColumn("fold", F.when(F.col("part") == "holdout", 0).otherwise(1))
    found = bayes.nb_predictions(folded, "doc_id", "text", "lang", "fold", [0])
    return rounded(found.select(F.col("doc").alias("doc_id"), "label", "pred", "score"), "score")


@query(
    "nb_grid_cv",
    f"""WITH {FOLDS}, docs AS (SELECT doc_id, lang AS label, fold, text FROM folds),
{sql_naive_bayes('docs', '(0), (1), (2), (3), (4)', '(1), (2)', '(0.1), (0.5), (1.0)')},
{sql_scores('predicted', 'max_n, alpha, fold', 'label', 'pred')},
fold_scores AS (SELECT max_n, alpha, fold, avg(f1) AS macro_f1 FROM scores GROUP BY ALL)
SELECT max_n, alpha, round(avg(macro_f1), 6) AS mean_score, count(*) AS n_folds FROM fold_scores GROUP BY ALL""",
)
def nb_grid_cv(spark, sf_dir):
    folded = derived.fold_documents(spark, sf_dir)
    return rounded(bayes.nb_grid_cv(folded, "doc_id", "text", "lang", "fold"), "mean_score")


def sql_outcome(model: str) -> str:
    """What SQL can state of a fit: the rows it must give, and that it learned something."""
    return f"""WITH {SPLIT} SELECT CAST(doc_id AS VARCHAR) AS demanda_id, lang AS classificacao_real, '{model}' AS modelo_id,
  1 AS try_count, true AS complete, true AS beats_majority FROM split WHERE part = 'holdout'"""


def _parts(spark, sf_dir):
    split = stratified_split(derived.split_documents(spark, sf_dir), "doc_id", "lang")
    return split.where("part = 'train'"), split.where("part = 'holdout'")


def _beats(records) -> bool:
    """Whether predictions have a higher macro F1 than the most frequent label would."""
    found = classifiers.macro_f1(records, "classificacao_real", "classificacao_limpa")
    return found > classifiers.majority_f1(records, "classificacao_real")


def _outcome(spark, sf_dir, model, params):
    """The records' keys; ``complete`` says that prediction and time are there, ``beats_majority`` uses all predictions."""
    records = classifiers.fit_predict(*_parts(spark, sf_dir), "doc_id", "text", "lang", model, params)
    complete = F.col("classificacao_limpa").isNotNull() & (F.col("tempo_resposta_s") > 0)
    return records.select(
        "demanda_id",
        "classificacao_real",
        "modelo_id",
        "try_count",
        complete.alias("complete"),
        F.lit(_beats(records)).alias("beats_majority"),
    )


@query("logistic_regression", sql_outcome("LogisticRegression"))
def logistic_regression(spark, sf_dir):
    return _outcome(spark, sf_dir, "LogisticRegression", {"clf__C": 10.0, "tfidf__ngram_range": "[1,1]"})


@query("linear_svm", sql_outcome("SVM"))
def linear_svm(spark, sf_dir):
    return _outcome(spark, sf_dir, "SVM", {"clf__C": 1.0, "tfidf__ngram_range": "[1,1]"})


@query("embedding_classifier", sql_outcome("FastText"))
def embedding_classifier(spark, sf_dir):
    return _outcome(spark, sf_dir, "FastText", {"lr": 0.05, "dim": 50, "epoch": 5, "wordNgrams": 1})


@query("fit_predict", sql_outcome("LogisticRegression"))
def fit_predict(spark, sf_dir):
    params = {"clf__C": 1.0, "tfidf__ngram_range": "[1,2]", "tfidf__min_df": 2, "tfidf__max_df": 0.9, "tfidf__binary": True}
    return _outcome(spark, sf_dir, "LogisticRegression", params)


@query(
    "holdout_report",
    f"""WITH {SPLIT} SELECT 'NaiveBayes' AS modelo_id, lang AS label, count(*) AS support, true AS beats_majority
FROM split WHERE part = 'holdout' GROUP BY lang""",
)
def holdout_report(spark, sf_dir):
    """The configuration that ranks first in a search over the training rows, fitted again and reported."""
    train, holdout = _parts(spark, sf_dir)
    folded = stratified_folds(train.drop("part"), "doc_id", "lang")
    ranked = bayes.nb_grid_cv(folded, "doc_id", "text", "lang", "fold")
    best = ranked.orderBy(F.col("mean_score").desc(), "max_n", "alpha").first()
    params = {"alpha": best["alpha"], "ngram_range": [1, best["max_n"]]}
    records = classifiers.fit_predict(train, holdout, "doc_id", "text", "lang", "NaiveBayes", params)
    report = classifiers.holdout_report(records).where("kind = 'label'")
    return report.select("modelo_id", "label", "support", F.lit(_beats(records)).alias("beats_majority"))


@query(
    "stored_model",
    f"""WITH {SPLIT} SELECT CAST(doc_id AS VARCHAR) AS doc_id, true AS as_fitted FROM split WHERE part = 'holdout'""",
)
def stored_model(spark, sf_dir):
    """A fit written as tables of terms and classes, read back, and applied to documents that it predicted when fitted."""
    split = stratified_split(derived.split_documents(spark, sf_dir), "doc_id", "lang")
    rows = split.withColumn("fold", (F.col("part") == "train").cast("int"))
    problem = linear.Problem(1, 0, 1.0)
    plan, labels, blocks = linear.prepare(rows, "doc_id", "text", "lang", "fold", [problem], "squared_hinge", linear.Weighting())
    fitted = linear.fit(plan, labels, blocks)
    terms, classes = (written(t, "model") for t in linear.stored_model(fitted))
    holdout = rows.where("fold = 0").select(F.col("doc_id").cast("string"), "text")
    scored = linear.score(terms, classes, holdout, "doc_id", "text", problem.max_n)
    direct = linear.predictions(fitted).join(F.broadcast(classes), "code").select(F.col("doc").alias("doc_id"), "label")
    return scored.join(direct, "doc_id").select("doc_id", (F.col("pred") == F.col("label")).alias("as_fitted"))


@query("holdout_report_full")
def holdout_report_full(spark, sf_dir):
    """Precision, recall, F1 and averages of the best configuration of each model, searched on the training rows."""
    train, holdout = _parts(spark, sf_dir)
    folded = stratified_folds(train.drop("part"), "doc_id", "lang")
    records = []
    for model in ("LogisticRegression", "LinearSVC"):
        best = classifiers.grid_cv(folded, "text", "lang", "fold", model).first()
        params = {"C": best["C"], "ngram_range": [1, best["max_n"]]}
        records.append(classifiers.fit_predict(train, holdout, "doc_id", "text", "lang", model, params))
    ranked = bayes.nb_grid_cv(folded, "doc_id", "text", "lang", "fold")
    best = ranked.orderBy(F.col("mean_score").desc(), "max_n", "alpha").first()
    params = {"alpha": best["alpha"], "ngram_range": [1, best["max_n"]]}
    records.append(classifiers.fit_predict(train, holdout, "doc_id", "text", "lang", "NaiveBayes", params))
    return classifiers.holdout_report(unions.union_results(*records))


def sql_search(model: str) -> str:
    return f"""SELECT '{model}' AS model, n AS max_n, c AS "C", 5 AS n_folds, true AS beats_majority
FROM (VALUES (1), (2)) a(n), (VALUES (CAST(0.1 AS DOUBLE)), (1), (10)) b(c)"""


def _search(spark, sf_dir, model):
    folded = derived.fold_documents(spark, sf_dir)
    found = classifiers.grid_cv(folded, "text", "lang", "fold", model)
    floor = classifiers.majority_f1(folded, "lang")
    return found.select("model", "max_n", "C", "n_folds", (F.col("mean_score") > floor).alias("beats_majority"))


@query("successive_halving")
def successive_halving(spark, sf_dir):
    """Draws of linear SVMs, one per region, halved on growing shares of the training rows."""
    folded = derived.fold_documents(spark, sf_dir)
    draws = halving.linear_draws(table(spark, sf_dir, "region"), "r_regionkey")
    return halving.successive_halving(folded, draws, "doc_id", "text", "lang", model_loss="squared_hinge")


@query("grid_cv_ranking")
def grid_cv_ranking(spark, sf_dir):
    """The whole result of the search: mean scores, their order, and the steps that all fits together took."""
    return classifiers.grid_cv(derived.fold_documents(spark, sf_dir), "text", "lang", "fold", "LogisticRegression")


@query("grid_cv", sql_search("LogisticRegression"))
def grid_cv(spark, sf_dir):
    return _search(spark, sf_dir, "LogisticRegression")


@query("grid_cv_svm", sql_search("LinearSVC"))
def grid_cv_svm(spark, sf_dir):
    return _search(spark, sf_dir, "LinearSVC")


@query(
    "registry_leaderboard",
    f"""WITH {SPLIT} SELECT m AS model, count(*) AS n, true AS timed, true AS beats_majority
FROM split, (VALUES ('LogisticRegression'), ('NaiveBayes'), ('SVM')) t(m) WHERE part = 'holdout' GROUP BY m""",
)
def registry_leaderboard(spark, sf_dir):
    """Result files of searches, merged to a registry; its champion per model trained, scored and ranked."""
    root = scratch_path(spark, "registry")
    kinds = F.array(F.lit("SVM"), F.lit("NaiveBayes"), F.lit("LogisticRegression"))
    model = F.get(kinds, (F.col("p_partkey") % 3).cast("int"))
    grams = F.array(F.lit(1), F.lit(1) + (F.col("p_size") % 2).cast("int")).alias("tfidf__ngram_range")
    strength = ((F.col("p_size") % 10) + 1).cast("double")
    params = F.when(model == "NaiveBayes", F.to_json(F.struct((strength / 10).alias("clf__alpha"), grams))).otherwise(
        F.to_json(F.struct(strength.alias("clf__C"), grams, F.lit("lbfgs").alias("clf__solver")))
    )
    entries = table(spark, sf_dir, "part").select(
        F.translate("p_brand", "#", "").alias("run"),
        F.struct(
            model.alias("model"),
            (F.col("p_retailprice") / 1e5 + F.col("p_partkey") / 1e9).alias("f1_holdout"),
            F.from_json(params, "clf__alpha double, clf__C double, clf__solver string, tfidf__ngram_range array<int>").alias(
                "best_params"
            ),
        ).alias("entry"),
    )
    listed = entries.groupBy("run").agg(F.to_json(F.collect_list("entry")).alias("value"))
    listed.repartition("run").write.partitionBy("run").text(f"{root}/gridsearch_optuna")
    found = runs.scan_run_results(spark, root, "part-*", every_element=True).withColumn(
        "run_id", F.regexp_extract("source_file", "run=([^/]+)", 1)
    )
    keyed = found.withColumn("key", unions.registry_key("run_id", "model", "origin")).withColumn("params", F.col("params"))
    registry = unions.registry_merge([keyed], "key", ["f1", "params"])
    best = windows.champions(registry, ["model"], "f1", ["run_id", "params"])
    records = classifiers.fit_registry(best, *_parts(spark, sf_dir), "doc_id", "text", "lang")
    floor = classifiers.majority_f1(records.where("modelo_id = 'SVM'"), "classificacao_real")
    board = leaderboard(records, ["modelo_id"], "classificacao_real", "classificacao_limpa", "tempo_resposta_s")
    return board.select(
        F.col("modelo_id").alias("model"),
        "n",
        (F.col("mean_latency_s") > 0).alias("timed"),
        (F.col("macro_f1") > floor).alias("beats_majority"),
    )
