"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """From rows (a, b) of longs: node, comp. Nodes without an edge are not listed.

    In every round each node moves to its neighbour of least priority (or stays, if its own is least) and edges are redrawn
    between the new places; priorities are the numbers themselves at first, so that stars collapse at once, and then
    hashes, so that chains do. The number of nodes with edges falls by a constant factor a round. Every round is a table
    in the checkpoint folder; nothing is collected."""
    edge = written(edges.where("a <> b").select("a", "b").distinct(), "graph-edges")
    place = None
    number = 0
    while edge.head(1):
        rank = (lambda c: F.col(c)) if number == 0 else (lambda c: F.xxhash64(F.lit(number), F.col(c)))
        both = edge.select("a", "b").unionByName(edge.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("v"))).alias("m"))
        own = F.struct(rank("a").alias("r"), F.col("a").alias("v"))
        move = written(best.select(F.col("a").alias("v"), F.least(own, F.col("m"))["v"].alias("to")), f"graph-moves-{number}")
        if place is None:
            place = move.select(F.col("v").alias("node"), F.col("to").alias("comp"))
        else:
            moved = place.join(move, place["comp"] == move["v"], "left")
            place = moved.select("node", F.coalesce("to", "comp").alias("comp"))
        place = written(place, f"graph-places-{number}")
        step = edge.join(move.select(F.col("v").alias("a"), F.col("to").alias("x")), "a").join(move.select(F.col("v").alias("b"), F.col("to").alias("y")), "b")
        edge = written(step.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"graph-edges-{number}")
        number += 1
    if place is None:
        return edge.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return place
