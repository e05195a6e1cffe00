"""Structured Streaming twins of the keyed operators."""

from .state import (  # noqa: F401
    merge_batch,
    newest_submissions,
    run_keyed_updates,
    stream_favorites_dedup,
    stream_favorites_dedup_bounded,
    stream_progress_latest,
    stream_replace_ratings,
)
