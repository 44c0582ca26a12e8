"""Components and first-wins selection over edges, with lineage cut by tables in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this process's own only where the session names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir: executors must share the folder of intermediate tables")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="innsight-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return _own["dir"]


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, for loops: with its lineage end the constraints that the optimizer would carry, ever more of them, from round to round."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def greedy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): the first row stays, and each later one that conflicts with none that stays. nodes: (id, key); rows of one key that is not null conflict, as do those of edges (a, b), a < b.

    In rounds: what has no open smaller neighbour stays, its neighbours go. Of a key only the smallest open id counts, so rows of one key never meet pairwise.
    """
    open_, kept = settled(nodes), None
    edges = checkpointed(edges)
    while True:
        live = edges.join(open_.select(F.col("id").alias("a")), "a", "left_semi").join(open_.select(F.col("id").alias("b")), "b", "left_semi")
        later = open_.join(open_.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("first")), "key").where("id > first").select("id")
        stays = settled(open_.join(live.select(F.col("b").alias("id")).unionByName(later).distinct(), "id", "left_anti"))
        kept = stays.select("id") if kept is None else kept.unionByName(stays.select("id"))
        near = live.join(stays.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id"))
        alike = open_.join(stays.where("key IS NOT NULL").select("key").distinct(), "key", "left_semi").select("id")
        open_ = settled(open_.join(stays.select("id").unionByName(near).unionByName(alike).distinct(), "id", "left_anti").select("id", "key"))
        if open_.isEmpty():
            return kept


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each node reaches over edges (a, b). Labels spread and pointers jump until nothing changes."""
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = settled(nodes.select("id", F.col("id").alias("root")))
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("m"))
        step = label.join(near, "id", "left").select("id", F.least("root", F.coalesce("m", "root")).alias("root"), F.col("root").alias("was"))
        jump = step.select(F.col("id").alias("root"), F.col("root").alias("r"))
        fresh = settled(step.join(jump, "root").select("id", F.col("r").alias("root"), "was"))
        label = fresh.select("id", "root")
        if fresh.where("root != was").isEmpty():
            return label
