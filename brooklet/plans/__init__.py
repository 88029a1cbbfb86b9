"""Pipelines: steps, the order-demand pass, lowering to DataFrames, terminals."""

from .pipeline import Builder, Pipeline

__all__ = ["Builder", "Pipeline"]
