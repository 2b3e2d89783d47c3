"""Named queries, by area."""

from . import documents, evaluation, retrieval

CATALOGS = [retrieval.CATALOG, documents.CATALOG, evaluation.CATALOG]
