"""Who talks to whom: edges between processes and peers, and drawings of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fnv1a32


def service_edges(records: DataFrame, keys: list[str], time: str = "ts") -> DataFrame:
    """One row per edge: calls, bytes, first and last time, latest protocol, first label.

    ``records`` has the keys, ``is_call``, ``tx``, ``rx``, ``protocol``, ``label``, the time and ``seq``, which
    breaks ties of time.
    """
    at = F.struct(time, "seq")
    return records.groupBy(*keys).agg(
        F.sum(F.col("is_call").cast("long")).alias("calls"),
        F.sum("tx").alias("tx"),
        F.sum("rx").alias("rx"),
        F.min(time).alias("first_seen"),
        F.max(time).alias("last_seen"),
        F.coalesce(F.max_by("protocol", F.when(F.col("protocol").isNotNull(), at)), F.lit("-")).alias("protocol"),
        F.min_by("label", F.when(F.col("label").isNotNull(), at)).alias("label"),
    )


def protocol_weights(edges: DataFrame) -> DataFrame:
    return edges.groupBy("protocol").agg(F.sum(F.greatest("calls", F.lit(1))).cast("long").alias("weight"))


def vertices(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Distinct ends of edges with their side."""
    ends = F.array(*(F.struct(F.lit(side).alias("side"), F.col(c).cast("string").alias("vertex")) for side, c in (("source", source), ("target", target))))
    return edges.select(F.explode(ends).alias("end")).select("end.side", "end.vertex").distinct()


def ndjson(edges: DataFrame) -> DataFrame:
    return edges.select(F.to_json(F.struct(*edges.columns)).alias("line"))


def dot_lines(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Lines of a Graphviz drawing: vertices, dashed peers named by a hash, and edges."""
    peer = F.col(target).cast("string")
    name = F.concat(F.lit("q_"), F.lpad(F.lower(F.hex(fnv1a32(peer))), 8, "0"))
    own = F.concat(F.lit("p"), F.col(source).cast("string"), F.lit(" [shape=box];"))
    other = F.concat(name, F.lit(' [label="'), peer, F.lit('", style=dashed];'))
    label = F.concat_ws(" ", F.col("protocol"), F.concat(F.col("calls").cast("string"), F.lit("c")), F.concat(F.lit("tx="), F.col("tx").cast("string")), F.concat(F.lit("rx="), F.col("rx").cast("string")))
    arrow = F.concat(F.lit("p"), F.col(source).cast("string"), F.lit(" -> "), name, F.lit(' [label="'), label, F.lit('"];'))
    # One pass over the edges; an edge is one row, so its arrow is distinct already.
    return edges.select(F.explode(F.array(own, other, arrow)).alias("line")).where("line is not null").distinct()
