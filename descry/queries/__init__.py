"""Operators applied to the driver's tables, each with SQL that checks it.

Importing the topic modules fills ``QUERIES`` and ``SQL``.
"""

from descry.queries import (  # noqa: F401
    archives,
    documents,
    integrity,
    keys,
    listings,
    logs,
    sanitizing,
    scrubbing,
    state,
)
from descry.queries.registry import QUERIES, SQL  # noqa: F401
