"""Results as bytes: VOTable, CSV, TSV, Parquet, JSON; and as files from Spark."""

from .formats import CONTENT_TYPES, content_type, error_document, negotiate, serialize

__all__ = ["CONTENT_TYPES", "content_type", "error_document", "negotiate", "serialize"]
