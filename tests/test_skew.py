"""The paths for hot groups must give what the plain operators give."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallywright.operators import aggregates, bayes, features, filters, ranking, sampling, sizing, windows
from tallywright.plans.derived import fold_documents


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    """A third of the rows in group 0, and many equal values."""
    group = F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", "ts", group.alias("g"), F.round("value", 0).alias("v")).cache()


def same(actual, expected):
    return actual.exceptAll(expected).count() == 0 and expected.exceptAll(actual).count() == 0


def order():
    return Window.partitionBy("g").orderBy("ts", "event_id")


@pytest.mark.parametrize("cap", [20, 100, 10**6])
def test_number_rows(events, cap):
    numbered = ranking.number_rows(events, ["g"], ["ts", "event_id"], "n", cap).select("event_id", "n")
    expected = events.select("event_id", F.row_number().over(order()).cast("long").alias("n"))
    assert same(numbered, expected)


@pytest.mark.parametrize("cap", [50, 10**6])
def test_number_all_rows(events, cap):
    numbered = ranking.number_rows(events, [], ["v", "event_id"], "n", cap).select("event_id", "n")
    expected = events.select("event_id", F.row_number().over(Window.orderBy("v", "event_id")).cast("long").alias("n"))
    assert same(numbered, expected)


def test_cells_split_ties(events):
    tied = events.withColumn("v", F.lit(1.0))
    celled, cut = ranking.with_cells(tied, ["g"], ["v", "event_id"], 20)
    assert cut
    assert celled.where("g = 0").groupBy("_cell").count().agg(F.max("count")).first()[0] < 120


@pytest.mark.parametrize("cap", [20, 10**6])
@pytest.mark.parametrize("current", [True, False])
def test_running_max(events, cap, current):
    span = order().rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    actual = ranking.running_max(events, ["g"], ["ts", "event_id"], "v", "m", current, cap).select("event_id", "m")
    assert same(actual, events.select("event_id", F.max("v").over(span).alias("m")))


@pytest.mark.parametrize("cap", [20, 10**6])
def test_previous_value(events, cap):
    with_nulls = events.withColumn("v", F.when(F.col("event_id") % 4 != 0, F.col("v")))
    actual = ranking.previous_value(with_nulls, ["g"], ["ts", "event_id"], "v", "p", cap).select("event_id", "p")
    assert same(actual, with_nulls.select("event_id", F.lag("v").over(order()).alias("p")))


@pytest.mark.parametrize(("max_rows", "hot_keys"), [(10**6, 10), (3, 10), (3, 1000), (0, 1)])
def test_join_key_stats(events, max_rows, hot_keys):
    stats = events.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    joined = sizing.join_key_stats(events, stats, ["g"], "n", max_rows, hot_keys)
    assert same(joined.select("event_id", "top"), events.join(stats, "g").select("event_id", "top"))


def test_empty_key_stats(events):
    stats = events.where("g < 0").groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    assert sizing.join_key_stats(events, stats, ["g"], "n").count() == 0


def test_pareto_golden(spark):
    rows = [(1.0, 0.5), (2.0, 0.5), (3.0, 0.4), (3.0, 0.6), (0.0, 0.9), (None, 1.0)]
    df = spark.createDataFrame(rows, "time double, score double")
    kept = windows.pareto_frontier(df, "time", "score").select("time", "score")
    assert sorted(map(tuple, kept.collect())) == [(1.0, 0.5), (2.0, 0.5), (3.0, 0.6)]
    untimed = windows.pareto_frontier(df.dropna(), "time", "score", keep_untimed=True).select("time", "score")
    assert sorted(map(tuple, untimed.collect())) == [(0.0, 0.9)]


def test_pareto_cut(events):
    timed = events.select("g", "event_id", (F.col("event_id") / 7).alias("t"), "v")
    plain = windows.pareto_frontier(timed, "t", "v", ["g"])
    assert same(windows.pareto_frontier(timed, "t", "v", ["g"], max_group_rows=20), plain)


def test_champions_keep_first_on_ties(spark):
    df = spark.createDataFrame([("m", 1.0, "b"), ("m", 1.0, "a"), ("n", None, "c")], "m string, s double, k string")
    assert sorted(r["k"] for r in windows.champions(df, ["m"], "s", ["k"]).collect()) == ["a", "c"]


def test_nan_never_wins(spark):
    nan = float("nan")
    df = spark.createDataFrame([("m", 1.0, 0.5, "a"), ("m", 2.0, nan, "b"), ("m", 3.0, 0.95, "c")], "m string, t double, s double, k string")
    assert [r["k"] for r in windows.champions(df, ["m"], "s", ["k"]).collect()] == ["c"]
    assert sorted(r["k"] for r in windows.pareto_frontier(df, "t", "s", ["m"]).collect()) == ["a", "c"]
    assert [r["k"] for r in windows.best_overall(df, "s", "s", ["k"]).collect()] == ["c"]
    assert filters.valid_scores(df, "s").count() == 2
    assert aggregates.best_per_strategy(df, ["m"], "s").first()["best_score"] == 0.95
    share = df.agg(filters.high_quality_share(F.col("s") * 10)).first()[0]
    assert share == pytest.approx(200 / 3)


def test_unlabelled_rows_are_split_and_dealt(spark):
    df = spark.range(100).withColumn("label", F.when(F.col("id") < 50, "x"))
    split = sampling.stratified_split(df, "id", "label")
    counts = {(r["label"], r["part"]): r["count"] for r in split.groupBy("label", "part").count().collect()}
    assert counts == {("x", "train"): 40, ("x", "holdout"): 10, (None, "train"): 40, (None, "holdout"): 10}
    folded = sampling.stratified_folds(df, "id", "label")
    assert {r["count"] for r in folded.groupBy("label", "fold").count().collect()} == {10}


def test_hot_group_in_a_narrow_range_is_cut(spark):
    hot = spark.range(9000).select(F.lit(0).alias("g"), (F.col("id") / 1e6).alias("v"), "id")
    rest = spark.range(9000, 10000).select((F.col("id") % 50 + 1).cast("int").alias("g"), F.col("id").cast("double").alias("v"), "id")
    celled, cut = ranking.with_cells(hot.unionByName(rest), ["g"], ["v", "id"], 500)
    assert cut and celled.groupBy("g", "_cell").count().agg(F.max("count")).first()[0] <= 1000


def test_top_rows_are_limited_before_the_shuffle(events, capsys):
    ranking.top_rows(events, ["g"], [F.col("v").desc(), F.col("event_id")], 3).explain()
    plan = capsys.readouterr().out
    assert "Partial" in plan[plan.index("WindowGroupLimit") :]


@pytest.mark.parametrize("digits", [1, 4])
@pytest.mark.parametrize("max_rows", [0, 1000])
def test_split_sizes(events, digits, max_rows):
    sized = events.withColumn("label", F.col("g") % 7)
    split = sampling.stratified_split(sized, "event_id", "label", 0.2, digits=digits, max_rows=max_rows)
    rows = split.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("part") == "train").cast("int")).alias("train")
    )
    assert split.count() == events.count()
    for row in rows.collect():
        assert row["train"] == int(row["n"] * 0.8 + 0.5)


@pytest.mark.parametrize("digits", [1, 4])
def test_folds_are_balanced(events, digits):
    folded = sampling.stratified_folds(events, "event_id", "g", 5, digits=digits)
    sizes = folded.groupBy("g", "fold").count().groupBy("g").pivot("fold", list(range(5))).sum("count").fillna(0)
    for row in sizes.collect():
        counts = [row[str(f)] for f in range(5)]
        assert max(counts) - min(counts) <= 1


def test_sampling_edges(events):
    per_class = sampling.sample_per_class(events, "event_id", "g", 2)
    assert per_class.groupBy("g").count().where("count > 2").count() == 0
    assert sampling.sample_per_class(events, "event_id", None).count() == 48
    assert sampling.row_ids(events.limit(12), "event_id").agg(F.max("row_id")).first()[0] == "0012"


def test_large_samples_equal_small_ones(events, monkeypatch):
    def samples():
        per_class = sampling.sample_per_class(events, "event_id", "g", 30).select("event_id")
        return per_class, sampling.sample_n(events, "event_id", 100).select("event_id")

    limited = [df.collect() for df in samples()]
    monkeypatch.setattr(sampling, "LIMIT_IN_MAP", 0)
    assert [df.collect() for df in samples()] == limited


def test_tfidf_beyond_broadcast(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = features.tfidf(documents, "doc_id", "text").select("doc_id", "term", F.round("weight", 9))
    shuffled = features.tfidf(documents, "doc_id", "text", max_rows=10).select("doc_id", "term", F.round("weight", 9))
    assert same(shuffled, plain)


def test_tfidf_options(spark):
    docs = spark.createDataFrame([(1, "aa aa bb"), (2, "aa cc"), (3, "bb dd")], "id int, text string")
    raw = {(r["id"], r["term"]): r["weight"] for r in features.tfidf(docs, "id", "text", use_idf=False, norm=None).collect()}
    assert raw[(1, "aa")] == 2.0
    flat = features.tfidf(docs, "id", "text", binary=True, use_idf=False, norm="l1").collect()
    assert {(r["id"], r["term"]): r["weight"] for r in flat}[(1, "aa")] == 0.5
    kept = features.tfidf(docs, "id", "text", min_df=2, stop_words=["bb"])
    assert {r["term"] for r in kept.collect()} == {"aa"}


def test_bayes_beyond_broadcast(spark, sf_dir):
    folded = fold_documents(spark, sf_dir)
    args = (folded, "doc_id", "text", "lang", "fold", [0, 1])
    plain = bayes.nb_predictions(*args).select("doc", "fold", "pred", F.round("score", 6))
    shuffled = bayes.nb_predictions(*args, max_rows=10).select("doc", "fold", "pred", F.round("score", 6))
    assert same(shuffled, plain)
