"""Named queries over the test tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from tracelet.plans import basics, files, lineages, models  # noqa: F401  adds its queries
from tracelet.plans.catalog import QUERIES, SQL

FLAGSHIP = "knn_space"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
