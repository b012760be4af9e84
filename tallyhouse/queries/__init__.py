"""Named queries over the driver's tables, each with an independent SQL oracle.

Importing this package fills the registry in ``base``.
"""

from . import (  # noqa: F401
    activity,
    alerting,
    by_key,
    joining,
    keys,
    loads,
    marts,
    quality,
    refining,
    scans,
    star,
    streams,
    transforms,
)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
