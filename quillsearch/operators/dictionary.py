"""Term dictionaries: dense ids and a radix tree, built set by set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillsearch.session import stored

#: Terms that are broadcast while they descend in a radix tree.
FEW_ASKED = 100_000


def dense_ids(terms: DataFrame) -> DataFrame:
    """``(term, term_id)``: ids from 0 in the order of the terms, without bringing the terms into one task.

    Terms are range-partitioned and numbered inside the partitions; the offsets are the
    running sums of the partition sizes, a table of one row per partition.
    """
    spark = terms.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = terms.select("term").where("term is not null").distinct().repartitionByRange(n, "term")
    # written once, so that both uses below see the same ranges
    rows = stored(rows.select("term", F.spark_partition_id().alias("part")), "ranges")
    at = F.row_number().over(Window.partitionBy("part").orderBy("term"))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = rows.withColumn("at", at).join(F.broadcast(offsets), "part")
    return numbered.select("term", (F.col("offset") + F.col("at") - 1).alias("term_id"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two strings, by bisection."""
    n = F.least(F.length(a), F.length(b))
    steps = F.transform(F.sequence(F.length(F.bin(n)) - 1, F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftleft", F.lit(1), i))
    same = lambda m: F.substring(a, F.lit(1), m) == F.substring(b, F.lit(1), m)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & same(at + step), at + step).otherwise(at))


def _with_next(ids: DataFrame) -> DataFrame:
    """``(term_id, term, before)`` of stored dense ids: every word and the one before it in sorted order; null for the first."""
    return ids.join(ids.select((F.col("term_id") + 1).alias("term_id"), F.col("term").alias("before")), "term_id", "left")


def radix_nodes(terms: DataFrame) -> DataFrame:
    """``(node, parent, label, is_term)`` of the radix tree of the terms; the root is the empty string without a parent."""
    return _numbered_nodes(stored(dense_ids(terms), "term-ids"))[0].drop("node_id")


def _numbered_nodes(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node_id, node, parent, label, is_term)`` of the radix tree of the terms of stored dense ``ids``, and ``(term, term_id)`` of the nodes, stored.

    The inner nodes of a radix tree are the common prefixes of neighbours in sorted order,
    so the node set needs no insertion. In the sorted order of all nodes, which is the
    order of a walk through the tree, a node's parent is what it has in common with the node before it.
    """
    shared = F.when(F.col("before").isNotNull(), F.substring(F.col("term"), F.lit(1), common_prefix(F.col("term"), F.col("before"))))
    inner = _with_next(ids).where("before is not null").select(shared.alias("node"))
    root = ids.sparkSession.createDataFrame([("",)], "node string")
    nodes = (
        ids.select(F.col("term").alias("node"), F.lit(1).alias("t"))
        .unionByName(inner.unionByName(root).withColumn("t", F.lit(0)))
        .groupBy("node")
        .agg(F.max("t").alias("t"))
    )
    nodes = stored(nodes, "nodes")
    node_ids = stored(dense_ids(nodes.select(F.col("node").alias("term"))), "node-ids")
    parents = _with_next(node_ids).select(F.col("term_id").alias("node_id"), F.col("term").alias("node"), shared.alias("parent"))
    made = nodes.join(parents, "node").select(
        "node_id",
        "node",
        "parent",
        F.when(F.col("parent").isNull(), F.col("node")).otherwise(F.expr("substring(node, length(parent) + 1)")).alias("label"),
        (F.col("t") == 1).alias("is_term"),
    )
    return made, node_ids


def lookup(terms: DataFrame, asked: DataFrame) -> DataFrame:
    """``(term, term_id)`` for every asked term; -1 for terms that aren't in the dictionary."""
    found = asked.select("term").distinct().join(dense_ids(terms), "term", "left")
    return found.select("term", F.coalesce("term_id", F.lit(-1)).cast("long").alias("term_id"))


@dataclass(frozen=True)
class IdMap:
    """Term dictionary as a table ``(term, term_id)`` ordered by term."""

    table: DataFrame

    @staticmethod
    def build(terms: DataFrame, ids: DataFrame | None = None) -> IdMap:
        """Of ``terms (term)``; ``ids``: their stored dense ids, where they are known."""
        return IdMap(stored(dense_ids(terms), "idmap") if ids is None else ids)

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> IdMap:
        return IdMap(spark.read.parquet(path))

    def all(self) -> DataFrame:
        """``(term, term_id)`` of all terms."""
        return self.table

    def ids_of(self, asked: DataFrame) -> DataFrame:
        """``(term, term_id)`` for every asked term, once; -1 for terms that aren't in the dictionary."""
        found = asked.select("term").distinct().join(self.table, "term", "left")
        return found.select("term", F.coalesce("term_id", F.lit(-1)).cast("long").alias("term_id"))


@dataclass(frozen=True)
class RadixTree:
    """Term dictionary as the nodes of a radix tree: ``(node_id, parent_id, first, label, term_id)``.

    Only labels are stored, ``first`` is a label's first character. Node ids follow the sorted
    order, so the root is 0; ``term_id`` is null for nodes that are no term.
    """

    nodes: DataFrame

    @staticmethod
    def build(terms: DataFrame, ids: DataFrame | None = None) -> RadixTree:
        """Of ``terms (term)``; ``ids``: their stored dense ids, where they are known."""
        ids = stored(dense_ids(terms), "term-ids") if ids is None else ids
        nodes, node_ids = _numbered_nodes(ids)
        rows = nodes.join(node_ids.toDF("parent", "parent_id"), "parent", "left").join(ids.toDF("node", "term_id"), "node", "left")
        return RadixTree(stored(rows.select("node_id", "parent_id", F.substring("label", 1, 1).alias("first"), "label", "term_id"), "tree"))

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> RadixTree:
        return RadixTree(spark.read.parquet(path))

    def all(self) -> DataFrame:
        """``(term, term_id)`` of all terms, put together from the labels on the way down, one level of the tree a round."""
        level = self.nodes.where("parent_id is null").select("node_id", F.col("label").alias("text"), "term_id")
        out = level
        below = self.nodes.where("parent_id is not null").select(F.col("parent_id").alias("up"), F.col("node_id").alias("to"), "label", F.col("term_id").alias("id"))
        while not level.isEmpty():
            level = level.join(below, F.col("node_id") == F.col("up"))
            level = stored(level.select(F.col("to").alias("node_id"), F.concat("text", "label").alias("text"), F.col("id").alias("term_id")), "level")
            out = out.unionByName(level)
        return out.where("term_id is not null").select(F.col("text").alias("term"), "term_id")

    def ids_of(self, asked: DataFrame) -> DataFrame:
        """``(term, term_id)`` for every asked term, once; -1 for terms that aren't in the dictionary.

        All terms descend together, one edge a round: the edge is found by the node and the next
        character, and followed where its whole label comes next in the term.
        """
        words = asked.select("term").where("term is not null").distinct()
        root = self.nodes.where("parent_id is null").select(F.col("node_id").alias("at"), F.col("term_id").alias("id"))
        going = stored(words.crossJoin(F.broadcast(root)).withColumn("n", F.lit(0)), "descent")
        edges = self.nodes.where("parent_id is not null")
        done = going
        while n := going.count():
            step = going.drop("id").withColumn("first", F.substring(F.col("term"), F.col("n") + 1, F.lit(1)))
            # few terms go to the edges, so that the tree isn't shuffled every round
            step = (F.broadcast(step) if n <= FEW_ASKED else step).join(edges, (F.col("at") == F.col("parent_id")) & (step["first"] == edges["first"]))
            step = step.where(F.substring(F.col("term"), F.col("n") + 1, F.length("label")) == F.col("label"))
            going = stored(step.select("term", F.col("node_id").alias("at"), F.col("term_id").alias("id"), (F.col("n") + F.length("label")).alias("n")), "descent")
            done = done.unionByName(going)
        found = done.where((F.col("n") == F.length("term")) & F.col("id").isNotNull()).select("term", F.col("id").alias("term_id"))
        return words.join(found, "term", "left").select("term", F.coalesce("term_id", F.lit(-1)).cast("long").alias("term_id"))
