"""Connected components for the corpus operators: the library's routine under their names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from siftline.operators.resolve import components


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node."""
    return components(edges, a, b, "node", "component")
