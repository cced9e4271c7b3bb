"""Registered queries over the driver's tables; importing this registers all of them."""

from . import headers, science, values
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "headers", "science", "values"]
