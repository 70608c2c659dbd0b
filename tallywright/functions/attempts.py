"""Rules about calls to a scorer: provider, error kind, retry delay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _column

# Model-name prefixes and their provider.
PROVIDER_PREFIXES = [
    ("gemini", "gemini"),
    ("gpt", "openai"),
    ("llama", "groq"),
    ("mixtral", "groq"),
    ("deepseek", "deepseek"),
]
# Message parts that mark a rate limit, and the one that forbids a retry.
RATE_LIMIT_PARTS = ["rate", "429", "quota", "too many"]
NO_RETRY_PART = "inicializado"
MAX_ATTEMPTS = 5


def provider_route(model: str | Column) -> Column:
    model = _column(model)
    rules = [F.when(model.startswith(prefix), provider) for prefix, provider in PROVIDER_PREFIXES]
    return F.coalesce(*rules, F.lit("unknown"))


def classify_error(message: str | Column, whole_words: bool = False) -> Column:
    """``not_initialised``, ``rate_limit`` or ``other``; null where there is no error.

    ``whole_words`` keeps "rate" from matching inside words such as "generate".
    """
    message = _column(message)
    lowered = F.lower(message)
    if whole_words:
        limited = lowered.rlike(r"\b(rate|quota|429|too many)\b")
    else:
        limited = F.lit(False)
        for part in RATE_LIMIT_PARTS:
            limited = limited | lowered.contains(part)
    return (
        F.when(message.contains(NO_RETRY_PART), "not_initialised")
        .when(limited, "rate_limit")
        .when(message.isNotNull(), "other")
    )


def planned_backoff(kind: str | Column, attempt: str | Column, base: float = 1.0) -> Column:
    """Seconds to wait after a failed attempt: doubling for rate limits, linear otherwise, null for no retry."""
    kind, attempt = _column(kind), _column(attempt)
    delay = F.when(kind == "rate_limit", base * F.pow(F.lit(2.0), attempt - 1)).when(
        kind == "other", base * attempt.cast("double")
    )
    return F.when(attempt < MAX_ATTEMPTS, delay)
