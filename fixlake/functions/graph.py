"""Connected components of a distributed graph."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage at a reliable checkpoint in the session's shared folder; its own only where none is set."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder. For what is joined round after round: a checkpoint keeps the size that its plan was estimated to have, and each such join squares it, so that in the end planning
    takes longer than the work; a table has the size that it has."""
    folder = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only for a local master, as in tests, whose tasks share it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return named or _own_folder()


_OWN: list[str] = []


def _own_folder() -> str:
    if not _OWN:
        _OWN.append(f"{tempfile.gettempdir()}/fixlake-{uuid.uuid4().hex}")
    return _OWN[0]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) of each node that has an edge; a component is named after its smallest node. Nodes are longs.

    Each round hooks the parent of every node, and the node itself, below the least grandparent among its neighbours, then
    halves all paths. All steps are joins and minima, so no group is ever gathered in one place; the rounds needed grow with the
    logarithm of a component's diameter. Edges with a null end and loops count as absent but for naming their node.
    """
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    both = checkpointed(both.where("u < v").union(both.where("u > v").select("v", "u")).distinct())
    both = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    forest = checkpointed(both.groupBy("u").agg(F.least("u", F.min("v")).alias("f")))
    total = lambda df: df.agg(F.sum(F.col("f").cast("decimal(38,0)")).alias("n")).first()["n"]
    before = total(forest)
    for _ in range(max_rounds):
        up = forest.select(F.col("u").alias("f"), F.col("f").alias("g"))
        grand = forest.join(up, "f", "left").select("u", "f", F.coalesce("g", "f").alias("g"))
        near = both.join(grand.select(F.col("u").alias("v"), "g"), "v").groupBy("u").agg(F.min("g").alias("m"))
        offers = (
            grand.join(near, "u")
            .select(F.explode(F.array(
                F.struct(F.col("u").alias("u"), F.least("f", "g", "m").alias("f")),
                F.struct(F.col("f").alias("u"), F.least("g", "m").alias("f")),
            )).alias("o"))
            .select("o.*")
        )
        new = checkpointed(offers.groupBy("u").agg(F.min("f").alias("f")))
        forest, after = new, total(new)
        if after == before:  # parents only ever fall
            return forest.select(F.col("u").alias("node"), F.col("f").alias("component"))
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

