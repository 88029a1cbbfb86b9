"""brooklet: ordered, lazily evaluated data pipelines on Spark DataFrames."""

from .errors import PipelineBuildError, PipelineStateError
from .functions import Comparator, aio, by, col, py
from .plans import Builder, Pipeline

__all__ = ["Builder", "Comparator", "Pipeline", "PipelineBuildError", "PipelineStateError", "aio", "by", "col", "py"]
