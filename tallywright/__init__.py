"""Evaluate text classifiers and prompt-based labelers with Spark DataFrames."""

from .session import build_session

__all__ = ["build_session"]
