"""Every query of the core by name, with its SQL."""

from __future__ import annotations

from weftline.plans import corpus, exactly_once, files, records, runs

QUERIES = {**corpus.QUERIES, **runs.QUERIES, **exactly_once.QUERIES, **files.QUERIES, **records.QUERIES}
SQL = {**corpus.SQL, **runs.SQL, **exactly_once.SQL, **files.SQL, **records.SQL}
