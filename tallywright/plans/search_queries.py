"""Queries: frontiers, champions, samples, splits, unions, configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grids, sampling, unions, windows
from ..operators.joins import runtime_lookup
from ..operators.sizing import join_key_stats
from ..session import scratch_path
from ..sources.store import load_or_create
from . import derived
from .derived import GENERATIONS, RUNS, SPLIT, sql_hash
from .registry import query, rounded, six, table, whole
from .text_queries import sql_flatten


@query(
    "pareto_frontier",
    f"""WITH {RUNS}, w AS (SELECT *, max(score) OVER (PARTITION BY model ORDER BY runtime_s, score DESC, run_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM runs WHERE runtime_s > 0.01)
SELECT model, run_id, runtime_s, score FROM w WHERE before IS NULL OR score >= before""",
)
def pareto_frontier(spark, sf_dir):
    runs = derived.runs(spark, sf_dir).select("model", "run_id", "runtime_s", "score")
    return windows.pareto_frontier(runs, "runtime_s", "score", ["model"])


@query(
    "pareto_frontier_overall",
    """WITH w AS (SELECT event_id, ts, value, max(value) OVER (ORDER BY ts, value DESC
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events)
SELECT event_id, value FROM w WHERE before IS NULL OR value >= before""",
)
def pareto_frontier_overall(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return windows.pareto_frontier(events, "ts", "value", keep_untimed=True).select("event_id", "value")


@query(
    "convergence_point",
    f"""WITH {GENERATIONS}, top AS (SELECT user_id, max(value) AS best_value FROM generations GROUP BY user_id)
SELECT user_id, best_value, min(gen) AS convergence_gen FROM generations JOIN top USING (user_id)
WHERE value >= best_value - 1e-9 GROUP BY ALL""",
)
def convergence_point(spark, sf_dir):
    return windows.convergence_point(derived.generations(spark, sf_dir), ["user_id"], "gen", "value")


@query(
    "best_generation",
    f"""WITH {GENERATIONS} SELECT user_id, gen, value FROM generations
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, gen) = 1""",
)
def best_generation(spark, sf_dir):
    logs = derived.generations(spark, sf_dir).select("user_id", "gen", "value")
    return windows.best_generation(logs, ["user_id"], "gen", "value")


@query(
    "best_so_far",
    f"""WITH {GENERATIONS} SELECT user_id, gen, value AS gen_best,
  max(value) OVER (PARTITION BY user_id ORDER BY gen) AS best_so_far FROM generations""",
)
def best_so_far(spark, sf_dir):
    return windows.best_so_far(derived.generations(spark, sf_dir), ["user_id"], "gen", "value")


@query(
    "champions",
    f"""WITH {RUNS} SELECT model, strategy AS origin, run_id, score FROM runs
QUALIFY row_number() OVER (PARTITION BY model ORDER BY score DESC, run_id) = 1""",
)
def champions(spark, sf_dir):
    runs = derived.runs(spark, sf_dir).select("model", F.col("strategy").alias("origin"), "run_id", "score")
    return windows.champions(runs, ["model"], "score", ["run_id"])


@query(
    "best_per_group",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""",
)
def best_per_group(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return windows.champions(orders, ["o_custkey"], "o_totalprice", ["o_orderkey"])


@query(
    "best_overall",
    f"WITH {RUNS} SELECT model, strategy, run_id, score FROM runs ORDER BY score DESC, run_id LIMIT 1",
)
def best_overall(spark, sf_dir):
    runs = derived.runs(spark, sf_dir).select("model", "strategy", "run_id", "score")
    return windows.best_overall(runs, "f1_holdout", "score", ["run_id"])


@query(
    "elite_topk",
    f"""WITH {RUNS}, best AS (SELECT model, max(score) AS top FROM runs GROUP BY model),
pool AS (SELECT model, run_id, score, 'candidate' AS source FROM runs
  UNION ALL SELECT model, run_id, score, 'carried' FROM runs JOIN best USING (model) WHERE score = top)
SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY model ORDER BY score DESC, run_id, source) <= 5""",
)
def elite_topk(spark, sf_dir):
    runs = derived.runs(spark, sf_dir).select("model", "run_id", "score")
    best = runs.groupBy("model").agg(F.max("score").alias("top"), F.count(F.lit(1)).alias("n"))
    carried = join_key_stats(runs, best, ["model"], "n").where("score = top").select("model", "run_id", "score")
    return windows.elite_topk(
        runs.withColumn("source", F.lit("candidate")),
        carried.withColumn("source", F.lit("carried")),
        ["model"],
        "score",
        ["run_id", "source"],
        5,
    )


@query(
    "run_duration",
    f"""WITH {GENERATIONS} SELECT user_id, gen,
  round(event_id / CAST(10 AS DOUBLE) - coalesce(lag(event_id / CAST(10 AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY gen), 0), 6)
  AS own_seconds FROM generations""",
)
def run_duration(spark, sf_dir):
    logs = derived.generations(spark, sf_dir).select("user_id", "gen", (F.col("event_id") / 10).alias("clock"))
    own = windows.run_duration(logs, ["user_id"], ["gen"], "clock")
    return own.select("user_id", "gen", six("own_seconds", "own_seconds"))


@query("stratified_split", f"WITH {SPLIT} SELECT doc_id, lang, part FROM split")
def stratified_split(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.stratified_split(documents, "doc_id", "lang").select("doc_id", "lang", "part")


@query(
    "stratified_split_nested",
    f"""WITH {SPLIT}, inner_split AS (SELECT doc_id, lang,
  CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {sql_hash('doc_id', 'inner-42')})
    <= round(CAST(0.8 AS DOUBLE) * count(*) OVER (PARTITION BY lang)) THEN 'train' ELSE 'validation' END AS part
  FROM split WHERE part = 'train')
SELECT * FROM inner_split UNION ALL SELECT doc_id, lang, part FROM split WHERE part = 'holdout'""",
)
def stratified_split_nested(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    outer = sampling.stratified_split(documents, "doc_id", "lang")
    inner = sampling.stratified_split(outer.where("part = 'train'").drop("part"), "doc_id", "lang", seed="inner-42")
    inner = inner.withColumn("part", F.when(F.col("part") == "holdout", "validation").otherwise("train"))
    return inner.unionByName(outer.where("part = 'holdout'")).select("doc_id", "lang", "part")


@query("stratified_folds", f"WITH {derived.FOLDS} SELECT doc_id, lang, fold FROM folds")
def stratified_folds(spark, sf_dir):
    folds = derived.fold_documents(spark, sf_dir).select("doc_id", "lang", "fold")
    return whole(folds, "fold")


@query(
    "sample_per_class",
    f"""SELECT doc_id, source FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY {sql_hash('doc_id', 'sample-42')}, doc_id) <= 8""",
)
def sample_per_class(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.sample_per_class(documents, "doc_id", "source")


@query(
    "sample_n",
    f"SELECT doc_id, lang FROM documents ORDER BY {sql_hash('doc_id', 'sample-42')}, doc_id LIMIT 48",
)
def sample_n(spark, sf_dir):
    return sampling.sample_n(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 48)


@query(
    "review_sheet",
    f"""SELECT doc_id AS "ID_Original", source AS "Categoria_Original", {sql_flatten('text')} AS "Texto_Manifestacao",
  '' AS rotulo, '' AS realismo, '' AS vazamento, '' AS complexidade, '' AS obs FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY {sql_hash('doc_id', 'sample-42')}, doc_id) <= 8""",
)
def review_sheet(spark, sf_dir):
    sheet = sampling.review_sheet(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    short = dict(zip(sampling.REVIEW_COLUMNS, ["rotulo", "realismo", "vazamento", "complexidade", "obs"]))
    return sheet.withColumnsRenamed(short)


@query(
    "shuffled_ranks",
    f"""SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {sql_hash('doc_id', 'rank-42')}, doc_id) AS rank
FROM documents""",
)
def shuffled_ranks(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.shuffled_ranks(documents, "doc_id", "lang", "rank-42")


@query(
    "union_results",
    f"""WITH {derived.PREDICTIONS}
SELECT item_id, model, pred_label, strategy, CAST(NULL AS DOUBLE) AS latency_s FROM predictions WHERE kind = 'ML'
UNION ALL SELECT item_id, model, pred_label, NULL, latency_s FROM predictions WHERE kind = 'LLM'""",
)
def union_results(spark, sf_dir):
    rows = derived.predictions(spark, sf_dir)
    local = rows.where("kind = 'ML'").select("item_id", "model", "pred_label", "strategy")
    llm = rows.where("kind = 'LLM'").select("item_id", "model", "pred_label", "latency_s")
    return unions.union_results(local, llm)


@query(
    "registry_merge",
    """WITH entries AS (
  SELECT 0 AS source, p_partkey AS written, p_brand || '__SVM__' || 'evolutionary' AS key, CAST(p_size AS DOUBLE) AS score FROM part
  UNION ALL
  SELECT 1, p_partkey, p_brand || CASE WHEN p_size % 2 = 0 THEN '__SVM__' ELSE '__NaiveBayes__' END ||
    CASE WHEN p_size % 3 = 0 THEN 'evolutionary' ELSE 'grid_optuna' END, p_retailprice FROM part)
SELECT key, score, written FROM entries QUALIFY row_number() OVER (PARTITION BY key ORDER BY source DESC, written DESC) = 1""",
)
def registry_merge(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    evolved = part.select(
        F.col("p_brand").alias("run"),
        F.lit("SVM").alias("model"),
        F.lit("evolutionary").alias("origin"),
        F.col("p_size").cast("double").alias("score"),
        F.col("p_partkey").alias("written"),
    )
    searched = part.select(
        F.col("p_brand").alias("run"),
        F.when(F.col("p_size") % 2 == 0, "LinearSVC").otherwise("MultinomialNB").alias("model"),
        F.when(F.col("p_size") % 3 == 0, "evolutionary").otherwise("grid_optuna").alias("origin"),
        F.col("p_retailprice").alias("score"),
        F.col("p_partkey").alias("written"),
    )
    keyed = [t.select(unions.registry_key("run", "model", "origin").alias("key"), "score", "written") for t in (evolved, searched)]
    return unions.registry_merge(keyed, "key", ["written"])


@query(
    "runtime_lookup",
    """WITH logs AS (SELECT user_id, sum(value) AS logged FROM events WHERE event_type <> 'signup' GROUP BY user_id),
evals AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN value END) AS runtime FROM events
  WHERE event_type IN ('purchase', 'signup') AND user_id % 2 = 0 GROUP BY user_id)
SELECT c.c_custkey AS user_id, c.c_acctbal AS f1,
  round(CASE WHEN e.user_id IS NOT NULL THEN coalesce(e.runtime, 0) ELSE coalesce(l.logged, 0) END, 6) AS runtime_seconds
FROM customer c LEFT JOIN evals e ON c.c_custkey = e.user_id LEFT JOIN logs l ON c.c_custkey = l.user_id""",
)
def runtimes(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    summary = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("f1"))
    evaluations = (
        events.where("event_type IN ('purchase', 'signup') AND user_id % 2 = 0")
        .groupBy("user_id")
        .agg(F.max(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("runtime_seconds"))
    )
    logs = events.where("event_type <> 'signup'").select("user_id", F.col("value").alias("time"))
    return rounded(runtime_lookup(summary, evaluations, logs, "user_id"), "runtime_seconds")


@query(
    "config_grid",
    """WITH sets AS (SELECT source, lang, count(*) AS n_rows FROM documents GROUP BY ALL)
SELECT source, lang, n_rows, row_number() OVER (PARTITION BY source, lang ORDER BY max_n, C) - 1 AS config_id, max_n, C
FROM sets CROSS JOIN (VALUES (1), (2)) a(max_n) CROSS JOIN (VALUES (CAST(0.1 AS DOUBLE)), (1), (10)) b(C)""",
)
def config_grid(spark, sf_dir):
    sets = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_rows"))
    return whole(grids.config_grid(sets, grids.GRIDS["LogisticRegression"]), "config_id")


@query(
    "decode_config",
    """WITH g AS (SELECT vec_id, CAST(floor(abs(CAST(embedding[1] AS DOUBLE)) * 1000) AS BIGINT) % 5 AS a,
  CAST(floor(abs(CAST(embedding[2] AS DOUBLE)) * 1000) AS BIGINT) % 3 AS b,
  CAST(floor(abs(CAST(embedding[3] AS DOUBLE)) * 1000) AS BIGINT) % 2 AS c FROM embeddings)
SELECT vec_id, CAST([0.1, 1, 10, 50, 100][1 + a] AS DOUBLE) AS "C", ['linear', 'rbf', 'sigmoid'][1 + b] AS kernel,
  ['[1,1]', '[1,2]'][1 + c] AS ngram_range FROM g""",
)
def decode_config(spark, sf_dir):
    def gene(i: int, size: int):
        return F.floor(F.abs(F.col("embedding")[i].cast("double")) * 1000) % size

    genes = F.array(gene(0, 5), gene(1, 3), gene(2, 2))
    individuals = table(spark, sf_dir, "embeddings").select("vec_id", genes.alias("genes"))
    return grids.decode_individuals(individuals, "genes", "SVM").drop("genes")


def _sql_uniform(name: str) -> str:
    return f"(CAST(('0x' || substr({sql_hash('p_partkey', 'draw-' + name)}, 1, 12)) AS BIGINT) / CAST(281474976710656 AS DOUBLE))"


@query(
    "random_configs",
    f"""SELECT p_partkey,
  round(exp(ln(CAST(0.01 AS DOUBLE)) + {_sql_uniform('lr')} * (ln(CAST(0.5 AS DOUBLE)) - ln(CAST(0.01 AS DOUBLE)))), 6) AS lr,
  [50, 100, 200, 300][1 + CAST(floor({_sql_uniform('dim')} * 4) AS BIGINT)] AS dim,
  CAST(floor({_sql_uniform('epoch')} * 26) + 5 AS INT) AS epoch,
  CAST(floor({_sql_uniform('ngrams')} * 3) + 1 AS INT) AS "wordNgrams" FROM part""",
)
def random_configs(spark, sf_dir):
    return rounded(grids.random_configs(table(spark, sf_dir, "part"), "p_partkey"), "lr")


@query(
    "search_comparison",
    """WITH searched AS (SELECT p_brand AS model, 'Grid/Optuna' AS approach, p_partkey AS run_id, p_size / CAST(50 AS DOUBLE) AS f1,
  p_retailprice AS runtime_seconds FROM part WHERE p_size % 2 = 0),
own AS (SELECT p_brand, p_partkey, p_size, p_retailprice FROM part WHERE p_size % 2 = 1),
evolved AS (SELECT p_brand, 'Evolutionary', p_partkey, p_size / CAST(50 AS DOUBLE),
  CASE WHEN p_size > 25 OR p_size <= 15 THEN p_retailprice ELSE 0 END FROM own),
runs AS (SELECT * FROM searched UNION ALL SELECT * FROM evolved),
w AS (SELECT *, max(f1) OVER (PARTITION BY approach ORDER BY runtime_seconds, f1 DESC, run_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM runs WHERE runtime_seconds > 0.01)
SELECT approach, model, run_id, f1, runtime_seconds FROM w WHERE before IS NULL OR f1 >= before""",
)
def search_comparison(spark, sf_dir):
    """Both kinds of search, with looked-up runtimes, in one stored table and its frontier per approach."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("model"),
        F.col("p_partkey").alias("run_id"),
        (F.col("p_size") / 50).alias("f1"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("price"),
    )

    def build():
        searched = part.where("size % 2 = 0").select(
            "model", F.lit("Grid/Optuna").alias("approach"), "run_id", "f1", F.col("price").alias("runtime_seconds")
        )
        own = part.where("size % 2 = 1")
        summary = own.select("model", F.lit("Evolutionary").alias("approach"), "run_id", "f1")
        evaluations = own.where("size > 25").select("run_id", F.col("price").alias("runtime_seconds"))
        logs = own.where("size <= 15").select("run_id", F.col("price").alias("time"))
        return unions.union_results(searched, runtime_lookup(summary, evaluations, logs, "run_id"))

    runs = load_or_create(spark, scratch_path(spark, "comparison"), build, ["f1", "runtime_seconds"])
    return windows.pareto_frontier(runs, "runtime_seconds", "f1", ["approach"]).select(
        "approach", "model", "run_id", "f1", "runtime_seconds"
    )
