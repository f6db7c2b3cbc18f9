"""Names of the events that traversals emit as rows, checked before anything runs."""

from __future__ import annotations

from collections.abc import Iterable

VERTEX_EVENTS = ("initialize_vertex", "discover_vertex", "start_vertex", "examine_vertex", "finish_vertex")
EDGE_EVENTS = ("examine_edge", "edge_relaxed", "edge_not_relaxed", "edge_minimized", "edge_not_minimized", "tree_edge", "back_edge", "forward_or_cross_edge", "finish_edge")


def check_events(events: Iterable[str] | None) -> set[str] | None:
    """The names as a set (None: all); a name that no algorithm has is an error."""
    if events is None:
        return None
    wanted = {events} if isinstance(events, str) else set(events)
    unknown = wanted - {*VERTEX_EVENTS, *EDGE_EVENTS}
    if unknown:
        raise ValueError(f"no such events: {sorted(unknown)}")
    return wanted
