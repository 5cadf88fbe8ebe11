"""Sources and sinks: the driver's Parquet tables and their file/index views,
the file-tree data source, snapshot JSON and the partitioned index store."""

from quarry.sources.tables import (  # noqa: F401
    documents_as_files, load, pages_as_files, query_turns,
)
