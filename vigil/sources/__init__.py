"""Sources and sinks: test-table views, native JSON, OTLP JSON, validation, Parquet sinks."""

from vigil.sources.tables import read_table
from vigil.sources.views import doc_logs, logs, metrics, spans

__all__ = ["doc_logs", "logs", "metrics", "read_table", "spans"]
