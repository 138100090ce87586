"""Pairwise entity resolution, partition evaluation and training-data operators on Spark DataFrames."""

from pairgraph.api import GroupOutcome, ScoreResult, group_images, group_images_with_resources, score_groups
from pairgraph.plans.config import Config as EvaluationConfig
from pairgraph.plans.config import load_config

__all__ = ["EvaluationConfig", "GroupOutcome", "ScoreResult", "group_images", "group_images_with_resources", "load_config", "score_groups"]
