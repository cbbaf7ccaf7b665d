"""Named queries over the driver's tables with their SQL oracles."""

from . import build_queries, contract_queries, file_queries, index_queries, queries, record_queries, run_queries, settings_queries, stream_queries  # noqa: F401  (registration)
