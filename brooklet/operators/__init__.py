"""Collectors: reductions that compile to one aggregate wherever their parts are Column functions."""

from .collectors import (
    Collector,
    averaging_double,
    averaging_int,
    averaging_long,
    collecting_and_then,
    counting,
    grouping_by,
    joining,
    mapping,
    max_by,
    min_by,
    partitioning_by,
    reducing,
    summarizing_double,
    summarizing_int,
    summarizing_long,
    summing_double,
    summing_int,
    summing_long,
    to_collection,
    to_generator,
    to_list,
    to_map,
    to_set,
)

__all__ = [n for n in dir() if not n.startswith("_") and n != "collectors"]
