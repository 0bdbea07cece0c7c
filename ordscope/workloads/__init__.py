"""Bindings of the operators to the driver's tables, with reference SQL per query."""

from ordscope.workloads import (  # noqa: F401
    audits,
    operations,
    relational,
    scalars,
    scans,
    statistics,
    streams,
)
from ordscope.workloads.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
