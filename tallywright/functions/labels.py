"""Mapping answers, labels, models and strategies to their canonical names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PUNCTUATION, SPACE, _column, strip

# The label catalogue in matching order.
LABELS = ["Elogio", "Crítica", "Sugestão", "Pedido de LAI", "Solicitação", "Denúncia"]
# Labels given to answers that are missing or match nothing.
MISSING_ANSWER = "ERRO_API"
UNMAPPED_ANSWER = "NAO_MAPEADO"
# The long form one label has in the source data.
LABEL_ALIASES = {"Pedido de Acesso à Informação (LAI)": "Pedido de LAI"}
# Search-time estimator names and the model type they stand for.
MODEL_TYPES = {"LinearSVC": "SVM", "MultinomialNB": "NaiveBayes"}
# Names shown in reports.
MODEL_DISPLAY_NAMES = {
    "LogisticRegression": "Log. Reg.",
    "NaiveBayes": "Naive Bayes",
    "SVM": "SVM",
    "FastText": "FastText",
    "gemini-2.5-flash-lite": "Gemini 2.5-Flash-Lite",
    "gpt-5-nano": "GPT-5-NANO",
    "llama-3.1-8b-instant": "Llama-3.1-8b-Instant",
}
# Substring rules for strategies, first match wins.
STRATEGY_RULES = [
    ("cot", "Zero-Shot-CoT"),
    ("meta", "Meta-Prompt"),
    ("few", "Few-Shot"),
    ("zero", "Zero-Shot"),
]
DEFAULT_STRATEGY = "Evolucionária"
# Prompt id to strategy, with the direct prompt named as what it is.
PROMPT_STRATEGIES = {
    "zero_shot_direto": "Zero-Shot",
    "zero_shot_cot": "Zero-Shot-CoT",
    "few_shot_completo": "Few-Shot",
    "meta_prompt_classificacao": "Meta-Prompt",
}
DEFAULT_PROMPT_STRATEGY = "Evolucionário"


def clean_answer(raw: str | Column, labels: Sequence[str] = LABELS) -> Column:
    """The label a free-form answer names, judged by its last non-blank line.

    An exact match wins; otherwise the first label, in catalogue order, that the
    line contains.
    """
    raw = _column(raw)
    # Once trailing whitespace is gone, the last line is the last non-blank one.
    last = strip(F.substring_index(strip(raw), "\n", -1))
    answer = F.regexp_replace(last, f"(?i)^categoria[:{SPACE}]*", "")
    answer = strip(F.lower(F.regexp_replace(answer, PUNCTUATION, "")))

    def mapped(text: Column) -> Column:
        exact = [F.when(text == label.lower(), label) for label in labels]
        inside = [F.when(text.contains(label.lower()), label) for label in labels]
        return F.coalesce(*exact, *inside, F.lit(UNMAPPED_ANSWER))

    # As a lambda variable the cleaned line is computed once, not once per rule.
    found = F.get(F.transform(F.array(answer), mapped), 0)
    return F.when(raw.isNull(), MISSING_ANSWER).otherwise(found)


def hit_flag(predicted: str | Column, actual: str | Column) -> Column:
    """1 where the labels agree, ignoring case and surrounding whitespace."""
    same = strip(F.lower(_column(predicted))) == strip(F.lower(_column(actual)))
    return F.coalesce(same, F.lit(False)).cast("int")


def yes_no_flag(answer: str | Column) -> Column:
    """1 for answers that start with "s" (sim) or equal "1", 0 for all others and for null."""
    text = strip(F.lower(_column(answer).cast("string")))
    return F.coalesce(text.startswith("s") | (text == "1"), F.lit(False)).cast("int")


def lookup(key: str | Column, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """Value of a constant map; an unknown key gives ``default`` or, without one, itself."""
    key = _column(key)
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    fallback = key if default is None else F.lit(default)
    return F.coalesce(F.element_at(F.create_map(*pairs), key), fallback)


def canonical_label(label: str | Column) -> Column:
    return lookup(label, LABEL_ALIASES)


def model_type(model: str | Column) -> Column:
    return lookup(model, MODEL_TYPES)


def model_display_name(model: str | Column) -> Column:
    return lookup(model, MODEL_DISPLAY_NAMES)


def canonical_strategy(strategy: str | Column) -> Column:
    """Strategy family by ordered substring rules."""
    text = F.lower(_column(strategy))
    rules = [F.when(text.contains(part), name) for part, name in STRATEGY_RULES]
    return F.coalesce(*rules, F.lit(DEFAULT_STRATEGY))


def prompt_strategy(prompt_id: str | Column) -> Column:
    return lookup(prompt_id, PROMPT_STRATEGIES, DEFAULT_PROMPT_STRATEGY)
