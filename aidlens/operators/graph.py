"""Signal graph."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def signal_graph_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst, value) with the labels of both ends."""
    ends = nodes.select("id", "label")
    src = ends.withColumnsRenamed({"id": "src", "label": "source_label"})
    dst = ends.withColumnsRenamed({"id": "dst", "label": "target_label"})
    return edges.join(src, "src").join(dst, "dst").select(
        "src", "dst", "source_label", "target_label", F.col("value")
    )
