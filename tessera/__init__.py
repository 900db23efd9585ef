"""Tessera: review-coordination analytics and corpus operators on Spark DataFrames."""

from tessera.config import PipelineConfig

__all__ = ["PipelineConfig"]
