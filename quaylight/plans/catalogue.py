"""All analytics queries: importing this registers those of every module."""

from . import core, extras, facts, learning, pages, pairs, rankings, storage, texts, vectors  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
