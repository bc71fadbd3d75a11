"""Queries over the given tables, one or more per operator."""

from epistride.workload import episodes, evaluation, storage, training  # noqa: F401
from epistride.workload.registry import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES"]
