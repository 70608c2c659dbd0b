"""Work that must not grow faster than the input: blocks, what a step stores, batches of calls, files of shuffles."""

import pickle
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tallywright.operators import bayes, features, ledger, linear, parts
from tallywright.session import CLEANUP, written


def documents(spark, n=240):
    draw = np.random.default_rng(3)
    made = [(i, " ".join(f"w{w}x" for w in draw.integers(i % 3 * 6, i % 3 * 6 + 14, 12)), "abc"[i % 3], i % 4) for i in range(n)]
    return spark.createDataFrame(made, "id long, text string, label string, fold int").repartition(3)


def test_blocks_of_any_size_give_the_same_fit(spark):
    df = documents(spark)
    problems = [linear.Problem(2, 0, 2.0)]
    found = []
    for size in (10_000, 25):
        plan, labels, blocks = linear.prepare(df, "id", "text", "label", "fold", problems, "softmax", linear.Weighting(), block_rows=size)
        fitted = linear.fit(plan, labels, blocks, tol=1e-2)
        terms, _ = linear.stored_model(fitted)
        found.append((blocks.count(), fitted, {r["term"]: (r["df"], *np.round(r["weights"], 4)) for r in terms.collect()}))
    (few, one, a), (many, other, b) = found
    assert few <= 3 < 9 <= many and a == b and one.steps == other.steps
    # A position is three vectors, however many steps came before it.
    state = pickle.loads(other.state.first()["data"])
    assert sorted(state) == ["a", "am", "gm"] and other.steps > 2


def test_naive_bayes_in_many_blocks(spark):
    df = documents(spark).unionByName(spark.createDataFrame([(900, "", "a", 0), (901, None, "b", 1), (902, "w1x", None, 0)], "id long, text string, label string, fold int"))
    args = (df, "id", "text", "label", "fold", [0, 1], [1, 2], [0.5, 1.0])
    one, many = (bayes.nb_predictions(*args, max_rows=n).select("max_n", "alpha", "fold", "doc", "pred", F.round("score", 7).alias("s")) for n in (10_000, 20))
    rows = sorted(map(tuple, one.collect()))
    assert rows == sorted(map(tuple, many.collect())) and len(rows) == 4 * 122


def test_open_calls_are_found_once(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, "m", f"prompt {i}") for i in range(90)], "id long, model_id string, prompt string")
    read = []
    answered = ledger.answered
    monkeypatch.setattr(ledger, "answered", lambda *a: read.append(1) or answered(*a))
    done = ledger.score_once(df, lambda model, prompt, attempt: prompt, str(tmp_path / "ledger"), base_backoff=0.0, calls_in_a_batch=10)
    assert done.where("raw_text = prompt").count() == 90
    # Once for what is open, once for the result, however many batches there are.
    assert len(list(Path(tmp_path / "ledger").glob("batch-*"))) == 9 and len(read) == 2


def test_cleanup_leaves_the_setting_as_it_was(spark):
    before = spark.conf.get(CLEANUP, None)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert written(rows).count() == 7 and spark.conf.get(CLEANUP, None) == before


def test_tfidf_moves_no_row_for_each_word_of_a_document(spark):
    rows = [(i, " ".join(f"w{(i * k) % 23}x" for k in range(1, 9)), i % 3) for i in range(60)] + [(60, None, 0), (61, "", 1)]
    df = spark.createDataFrame(rows, "id long, text string, other long").repartition(3)
    found = features.tfidf(df, "id", "text", max_n=2, max_rows=7)
    plan = found._jdf.queryExecution().toString()
    assert "Window" not in plan and "Exchange" not in plan.split("== Physical Plan ==")[1] and dict(found.dtypes)["id"] == "bigint"
    counts = {}
    for i, text, _ in rows:
        words = (text or "").split()
        for term in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
            counts.setdefault(i, {}).setdefault(term, 0)
            counts[i][term] += 1
    dfs = {t: sum(t in c for c in counts.values()) for c in counts.values() for t in c}
    wanted = {}
    for i, c in counts.items():
        raw = {t: n * (np.log((1 + 62) / (1 + dfs[t])) + 1) for t, n in c.items()}
        size = np.sqrt(sum(r * r for r in raw.values()))
        wanted |= {(i, t): (c[t], dfs[t], round(raw[t] / size, 9)) for t in c}
    assert {(r["id"], r["term"]): (r["tf"], r["df"], round(r["weight"], 9)) for r in found.collect()} == wanted


def test_fits_in_groups_equal_fits_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(linear, "scratch_path", lambda s, name: str(tmp_path / f"{name}-{len(list(tmp_path.iterdir()))}"))
    problems = [linear.Problem(n, f, 2.0) for n in (1, 2) for f in (0, 1)]
    plan, labels, held = linear.prepare(documents(spark), "id", "text", "label", "fold", problems, "squared_hinge", linear.Weighting(), names=False)
    one, many = (linear.fit(plan, labels, held, tol=1e-2, cells=cells) for cells in (10**6, 240 * 3))
    assert len(one.groups) == 1 and len(many.groups) == 4 and one.converged.all() and many.converged.all()
    found = [sorted(map(tuple, linear.predictions(f).collect())) for f in (one, many)]
    assert found[0] == found[1] and len(found[0]) == 4 * 60
    # Of each group the last position is left.
    assert one.steps > 2 and all(len(list(folder.iterdir())) == 1 for folder in tmp_path.iterdir())


def test_parts_exchange_numbers_of_documents_only(spark):
    sent = []
    for n_words in (20, 2000):
        draw = np.random.default_rng(1)
        made = [(i, " ".join(f"w{w}x" for w in draw.integers(0, n_words, 60)), "ab"[i % 2], 1) for i in range(50)]
        df = spark.createDataFrame(made, "id long, text string, label string, fold int").coalesce(2)
        plan, _, held = linear.prepare(df, "id", "text", "label", "fold", [linear.Problem(2, 0, 1.0)], "softmax", linear.Weighting())
        tasks, named = parts.to_tasks(held, "payload")
        # Two labels: the second one's numbers follow from the first one's.
        columns = linear.sent_columns(plan, np.arange(2))
        ones = held.docs.select("block").collect()
        sizes = dict(held.sizes)
        numbers = spark.createDataFrame([(r["block"], np.ones(sizes[r["block"]]).tobytes()) for r in ones], "block long, data binary")
        pairs = tasks.groupBy("bundle").cogroup(parts.to_bundles(numbers, named).groupBy("bundle"))
        found = pairs.applyInArrow(parts.products(plan, columns, held.sizes), "block long, data binary").collect()
        sent.append({len(r["data"]) // sizes[r["block"]] for r in found})
    assert sent == [{8}, {8}]


def test_prompts_are_stored_for_some_batches_at_a_time(spark, tmp_path, monkeypatch):
    made = [(i, "m", f"prompt {i % 60}") for i in range(120)] + [(200, None, "p"), (201, "m", None), (202, "m", None)]
    df = spark.createDataFrame(made, "id long, model_id string, prompt string")
    monkeypatch.setattr(ledger, "WINDOW_CHARS", 100)
    monkeypatch.setattr(ledger, "scratch_path", lambda s, name: str(tmp_path / f"{name}-{len(list(tmp_path.iterdir()))}"))
    folders, most, commit = [], [], ledger._commit

    def watched(spark, table, path):
        now = [p for p in tmp_path.iterdir() if p.name.startswith("call-batches")]
        folders.extend(p.name for p in now if p.name not in folders)
        most.append(len(now))
        commit(spark, table, path)

    monkeypatch.setattr(ledger, "_commit", watched)
    done = ledger.score_once(df, lambda model, prompt, attempt: f"{model} {prompt}", str(tmp_path / "ledger"), base_backoff=0.0, calls_in_a_batch=7)
    assert done.count() == 123 and done.where("raw_text = concat(coalesce(model_id, 'None'), ' ', coalesce(prompt, 'None'))").count() == 123
    assert ledger.answered(spark, str(tmp_path / "ledger")).count() == 62
    # Never two windows at once, and none is left.
    assert len(most) > len(folders) - 1 and set(most) == {1} and not [p for p in tmp_path.iterdir() if p.name.startswith("call-batches")]
    again = ledger.score_once(df.unionByName(df.limit(1).withColumn("prompt", F.lit("new"))), lambda *a: "second", str(tmp_path / "ledger"), base_backoff=0.0)
    assert again.where("raw_text = 'second'").count() == 1 and again.count() == 124
