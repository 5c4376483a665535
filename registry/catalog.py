"""Imports every query module so that all queries are registered."""

from registry import catalogue, experiment, explore, history, series, text  # noqa: F401
from registry.base import ENTRIES

__all__ = ["ENTRIES"]
