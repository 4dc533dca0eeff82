"""Query catalogue. Importing the modules below registers their queries."""

from . import auditing, capture, delivering, fleet, reporting, streams  # noqa: F401
from .catalog import ORACLES, QUERIES


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLES)
