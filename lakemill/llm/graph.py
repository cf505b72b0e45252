"""Connected components of large graphs, with this package's tables between the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import graphs
from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """See lakemill.operators.graphs.components."""
    return graphs.components(edges, keep=materialise)
