"""Every registered query of the library's own operators, with SQL that gives the same rows."""

from __future__ import annotations

from quirelab.plans import documents, exports, indexes, layout, library, papers, pieces, records, search, streams, texts, timeseries, views  # noqa: F401  they register
from quirelab.plans.registry import QUERIES, SQL  # noqa: F401

FLAGSHIP = "search_documents"
