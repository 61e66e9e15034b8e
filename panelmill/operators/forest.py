"""Fitted trees as a table, and scores of many models in one scan.

A forest is one row per node: (modelo, arbol, peso, hondo, nodo, columna, corte, izquierda, derecha, valor). Nodes of a tree are numbered
from 0, its root; `columna` is a position of the feature vector, from 0; a value up to `corte` goes to `izquierda`. A leaf has -1 there.
`hondo` is the longest way from the root to a leaf. The score of a row is 1 / (1 + exp(-2 m)), with m the weighted sum of its leaves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.session import BROADCAST_BYTES, checkpoint
from panelmill.sources.files import shared_folder

#: What a node takes when trees are broadcast.
NODE_BYTES = 64


def forest_of(models: Mapping[object, GBTClassificationModel], spark) -> DataFrame:
    """The nodes of fitted models, read from their stored form. Every split is on a number."""
    parts = []
    for name, model in models.items():
        path = shared_folder(spark, "forest")
        model.write().save(path)
        facts = [(i, float(w), tree.depth) for i, (w, tree) in enumerate(zip(model.treeWeights, model.trees))]  # one per tree
        trees = spark.createDataFrame(facts, "arbol int, peso double, hondo int")
        node = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("arbol"), "nodeData.*")
        cut = F.get("split.leftCategoriesOrThreshold", F.lit(0))
        number = F.when(F.col("split.numCategories") == -1, cut).otherwise(F.raise_error(F.lit("a split by categories")).cast("double"))
        parts.append(node.join(F.broadcast(trees), "arbol").select(
            F.lit(name).alias("modelo"), "arbol", "peso", "hondo", F.col("id").alias("nodo"), F.col("split.featureIndex").alias("columna"),
            number.alias("corte"), F.col("leftChild").alias("izquierda"), F.col("rightChild").alias("derecha"), F.col("prediction").alias("valor"),
        ))
    return checkpoint(reduce(DataFrame.unionByName, parts))


def _trees(forest: DataFrame) -> DataFrame:
    """(modelo, arboles): per model its trees, each with its nodes as arrays in the order of their numbers."""
    nodes = F.array_sort(F.collect_list(F.struct("nodo", "columna", "corte", "izquierda", "derecha", "valor")))
    trees = forest.groupBy("modelo", "arbol", "peso", "hondo").agg(nodes.alias("n"))
    each = F.struct("arbol", "peso", "hondo", *[F.col(f"n.{c}").alias(c) for c in ("columna", "corte", "izquierda", "derecha", "valor")])
    return trees.groupBy("modelo").agg(F.array_sort(F.collect_list(each)).alias("_arboles"))


def _leaf(tree: Column, features: str) -> Column:
    def step(node: Column, _: Column) -> Column:
        left, cut = F.get(tree["izquierda"], node), F.get(tree["corte"], node)
        goes_left = F.get(features, F.get(tree["columna"], node)) <= cut
        return F.when(left < 0, node).when(goes_left, left).otherwise(F.get(tree["derecha"], node))

    return F.get(tree["valor"], F.aggregate(F.sequence(F.lit(0), tree["hondo"]), F.lit(0), step))


def forest_scores(forest: DataFrame, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., modelo, score) of every row and model. `rows` has a feature vector.

    Trees are broadcast. Models whose nodes together pass the bound of a broadcast are dealt into groups that keep it, each with a
    scan of its own; a single model is never divided.
    """
    sizes = {r.modelo: r.n * NODE_BYTES for r in forest.groupBy("modelo").agg(F.count(F.lit(1)).alias("n")).collect()}  # one per model
    groups, room = [], 0
    for name, size in sorted(sizes.items(), key=lambda x: str(x[0])):
        if not groups or size > room:
            groups, room = [*groups, []], BROADCAST_BYTES
        groups[-1].append(name)
        room -= size
    return reduce(DataFrame.unionByName, [_scored(forest, rows, keep, g) for g in groups])


def _scored(forest: DataFrame, rows: DataFrame, keep: Sequence[str], models: Sequence[object]) -> DataFrame:
    trees = _trees(forest.filter(F.col("modelo").isin(*models)))
    each = rows.select(*keep, vector_to_array("features").alias("_x")).withColumn("modelo", F.explode(F.array(*[F.lit(m) for m in models])))
    margin = F.aggregate("_arboles", F.lit(0.0), lambda total, tree: total + tree["peso"] * _leaf(tree, "_x"))
    return each.join(F.broadcast(trees), "modelo").select(*keep, "modelo", (1 / (1 + F.exp(-2 * margin))).alias("score"))
