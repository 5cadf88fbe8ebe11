"""Structured Streaming forms of the batch operators."""

from quarry.streaming.ingest import (  # noqa: F401
    dedupe_arrivals, run_available_now, stream_ingest, stream_search,
)
