"""All runnable queries by name."""

from __future__ import annotations

from docsieve.plans import curation, files, learning, model, sampling, search, streams, text

FLAGSHIP = "prediction_tags"
QUERIES = {**curation.QUERIES, **text.QUERIES, **sampling.QUERIES, **model.QUERIES, **search.QUERIES, **streams.QUERIES, **files.QUERIES, **learning.QUERIES}
SQL = {**curation.SQL, **text.SQL, **sampling.SQL, **model.SQL, **search.SQL, **streams.SQL, **files.SQL}
