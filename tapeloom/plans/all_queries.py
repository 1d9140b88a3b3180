"""Imports every query module; importing it fills the registry."""

from tapeloom.plans.registry import ORACLES, QUERIES, query
from tapeloom.plans import flagship

query("flagship_rank_ic", flagship.FLAGSHIP_SQL)(lambda t: flagship.label_rank_ic(t.spark, t.sf_dir))

from tapeloom.plans import bar_queries, book_queries, rolling_queries, score_queries, table_queries  # noqa: E402,F401

__all__ = ["ORACLES", "QUERIES"]
