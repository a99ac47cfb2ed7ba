"""Streaming queries; where a batch twin exists its SQL is the oracle."""

from __future__ import annotations

from ..operators import lexical
from ..streaming import events, indexing
from . import analytics, retrieval


def stream_lexical_index(spark, d):
    """The lexical channel over an index that followed a stream of versions."""
    index = retrieval.stored(spark, d, "streamed-index", lambda path: indexing.index_of_versions(spark, d, path))
    return lexical.search(lexical.Segmented(index + "/index", 16), retrieval.questions(spark, d), retrieval.governed(spark, d).select("doc_id"), 30).drop("unit")


QUERIES = {
    "stream_daily_window": events.daily_windows,
    "stream_session_window": events.session_windows,
    "stream_distinct_events": events.distinct_events,
    "stream_gap_ordered_apply": events.gap_ordered_apply,
    "stream_lexical_index": stream_lexical_index,
}

SQL = {
    "stream_daily_window": analytics.SQL["daily_event_windows"],
    "stream_distinct_events": "select event_id, user_id, event_type from events",
    "stream_gap_ordered_apply": analytics.SQL["gap_ordered_apply"],
    "stream_lexical_index": retrieval.SQL["lexical_search"],
}
