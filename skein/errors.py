"""Errors that operators raise."""


class GraphError(RuntimeError):
    """A graph or an argument does not fit an operator."""


class OutOfRange(GraphError, ValueError):
    """A vertex that is not there, or a weight outside what an algorithm takes."""


class CycleError(GraphError):
    """A graph that should have no cycle has one; ``vertex`` lies on it."""

    def __init__(self, vertex):
        super().__init__(f"vertex {vertex} lies on a cycle")
        self.vertex = vertex
