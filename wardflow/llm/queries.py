"""Every text query; importing the operators registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from wardflow.llm import decontaminate, dom_boost, merge_replay, pii, planes, rule_ensemble, simhash, sketch, spelling, suffix_tree, toxicity, url_lists, whitening  # noqa: F401
from wardflow.llm.registry import ORACLES, QUERIES


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**QUERIES, "pipeline": corpus_pipeline.run}


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
