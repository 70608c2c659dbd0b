"""Edge cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from tallywright.functions import attempts, labels, params, text


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize(
    ("raw", "label"),
    [
        (None, "ERRO_API"),
        ("razão...\nCategoria Final: Denúncia", "Denúncia"),
        ("categoria: Elogio", "Elogio"),
        ("**Crítica**.", "Crítica"),
        ("denúncia ou elogio", "Elogio"),
        ("xyz", "NAO_MAPEADO"),
        ("  \n ", "NAO_MAPEADO"),
        ("", "NAO_MAPEADO"),
        ("Elogio\n\n\t", "Elogio"),
        ("CATEGORIA::  Sugestão\r\n", "Sugestão"),
        ("É um pedido de lai, sem dúvida", "Pedido de LAI"),
    ],
)
def test_clean_answer(spark, raw, label):
    assert values(spark, [(raw,)], labels.clean_answer("x")) == [label]


def test_yes_no_flag(spark):
    rows = [(None,), ("Sim",), (" s ",), ("1",), ("Não",), ("",), ("Sempre",), ("\tSIM",), ("10",)]
    assert values(spark, rows, labels.yes_no_flag("x")) == [0, 1, 1, 1, 0, 0, 1, 1, 0]


def test_preprocess_text(spark):
    rows = [(None,), (" Crítica! ação_x 12 ",), ("veja http://a.b/c?d=1 já",), ("123",)]
    assert values(spark, rows, text.preprocess_text("x")) == ["", "crítica ação_x", "veja  já", ""]


def test_token_filter(spark):
    rows = [("o serviço ab não3 funciona  bem",)]
    assert values(spark, rows, text.token_filter("x", ["bem"])) == ["serviço funciona"]


def test_flatten_text(spark):
    assert values(spark, [(" a\r\nb | c   d\n",)], text.flatten_text("x")) == ["a b / c d"]


def test_ngrams(spark):
    assert values(spark, [("A casa é azul, já!",)], text.ngram_tokens("x", 2)) == [
        ["casa", "azul", "já", "casa azul", "azul já"]
    ]
    assert values(spark, [("oi",), ("",)], text.ngram_tokens("x", 2)) == [["oi"], []]
    assert values(spark, [("casa que cai",)], text.ngram_tokens("x", 2, ["que"])) == [["casa", "cai", "casa cai"]]


def test_label_lines(spark):
    rows = [("Pedido de LAI",)]
    line = text.training_line("x", F.lit("uma\nlinha"))
    assert values(spark, rows, line) == ["__label__Pedido_de_LAI uma linha"]
    assert values(spark, rows, text.spaced_label(text.underscore_label("x"))) == ["Pedido de LAI"]


def test_names(spark):
    rows = [("LinearSVC",), ("MultinomialNB",), ("other",)]
    assert values(spark, rows, labels.model_type("x")) == ["SVM", "NaiveBayes", "other"]
    rows = [("zero_shot_cot",), ("META",), ("few",), ("zero_shot_direto",), ("Otimizado",)]
    assert values(spark, rows, labels.canonical_strategy("x")) == [
        "Zero-Shot-CoT", "Meta-Prompt", "Few-Shot", "Zero-Shot", "Evolucionária",
    ]
    assert values(spark, [("Pedido de Acesso à Informação (LAI)",)], labels.canonical_label("x")) == ["Pedido de LAI"]
    rows = [("gemini-x",), ("gpt-5",), ("mixtral",), ("deepseek",), ("x-gpt",)]
    assert values(spark, rows, attempts.provider_route("x")) == ["gemini", "openai", "groq", "deepseek", "unknown"]


def test_backoff(spark):
    rows = [(kind, k) for kind in ("rate_limit", "other") for k in range(1, 6)]
    waits = values(spark, rows, attempts.planned_backoff("kind", "k"), "kind string, k int")
    assert waits == [1, 2, 4, 8, None, 1, 2, 3, 4, None]


def test_error_kinds(spark):
    rows = [("HTTP 429",), ("Too Many",), ("generate failed",), ("Cliente não inicializado.",), ("boom",), (None,)]
    assert values(spark, rows, attempts.classify_error("x")) == [
        "rate_limit", "rate_limit", "rate_limit", "not_initialised", "other", None,
    ]
    strict = values(spark, rows, attempts.classify_error("x", whole_words=True))
    assert strict[2] == "other"


def test_split_params(spark):
    rows = [({"tfidf__ngram_range": "[1,2]", "clf__C": "1", "kernel": "rbf"},), ({"C": "1"},)]
    schema = "x map<string,string>"
    assert values(spark, rows, params.feature_params("x"), schema) == [
        {"ngram_range": "[1,2]"},
        {"ngram_range": "[1,1]"},
    ]
    assert values(spark, rows, params.classifier_params("x", F.lit("SVM")), schema) == [{"C": "1"}, {"C": "1"}]
    assert values(spark, rows, params.classifier_params("x", F.lit("unknown")), schema) == [None, None]
