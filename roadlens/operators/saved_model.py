"""A decision tree saved as plain rules, and applied as columns of any select.

MLlib's `transform` is a stage of its own over assembled vectors. A tree written as
rules is an expression: class and confidence become columns of the select that needs
them, in generated code, without a join, and SQL of any engine can say the same.

`python -m roadlens.operators.saved_model FOLDER` trains the default tree on the trips of
a folder and writes it beside this module.
"""

from __future__ import annotations

import json
import sys
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT = Path(__file__).with_name("driver_tree.json")
DEPTH = 6


@dataclass(frozen=True)
class SavedTree:
    """node: a leaf {class, confidence} or {feature, at, low, high}; up to `at` a value goes low."""

    features: list[str]
    classes: list[str]
    node: dict

    def _sql(self, leaf: str, node: dict | None = None) -> str:
        node = node or self.node
        if "class" in node:
            return f"'{node['class']}'" if leaf == "class" else _double(node[leaf])
        low, high = self._sql(leaf, node["low"]), self._sql(leaf, node["high"])
        return low if low == high else f"(CASE WHEN coalesce({node['feature']}, 0) <= {_double(node['at'])} THEN {low} ELSE {high} END)"

    def class_sql(self) -> str:
        """The class of a row; a missing feature is 0."""
        return self._sql("class")

    def confidence_sql(self) -> str:
        """The share of the class in its leaf, in percent with two digits."""
        return self._sql("confidence")

    def columns(self) -> tuple[Column, Column]:
        return F.expr(self.class_sql()), F.expr(self.confidence_sql())


def _double(x: float) -> str:
    return (s := repr(float(x))) + ("" if "e" in s else "e0")


def exported(model: PipelineModel, features: list[str]) -> SavedTree:
    """The rules of a pipeline (`classify.pipeline` with scaled=False) that ends in a decision tree."""
    classes, tree = list(model.stages[0].labels), model.stages[-1]

    def walk(node) -> dict:
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            best = max(range(len(stats)), key=lambda k: (stats[k], -k))
            return {"class": classes[best], "confidence": round(100 * stats[best] / sum(stats), 2)}
        split = node.split()
        return {"feature": features[split.featureIndex()], "at": split.threshold(), "low": walk(node.leftChild()), "high": walk(node.rightChild())}

    return SavedTree(list(features), classes, walk(tree._java_obj.rootNode()))


def saved(tree: SavedTree, spark: SparkSession, path: str) -> None:
    """Writes the tree to a new folder that all machines see."""
    spark.createDataFrame([(json.dumps(asdict(tree)),)], "value string").coalesce(1).write.text(path)


def loaded(spark: SparkSession, path: str) -> SavedTree:
    return SavedTree(**json.loads(spark.read.text(path, wholetext=True).first()[0]))


def default() -> SavedTree:
    """The tree that comes with the library."""
    return SavedTree(**json.loads(DEFAULT.read_text()))


def applied(trips: DataFrame, tree: SavedTree | None = None) -> DataFrame:
    """id, prediction, confidence of every trip; a missing feature is 0."""
    label, confidence = (tree or default()).columns()
    return trips.select("id", label.alias("prediction"), confidence.alias("confidence"))


def train(spark: SparkSession, sf_dir: str) -> SavedTree:
    from pyspark.ml.classification import DecisionTreeClassifier

    from ..sources import views
    from . import classify

    grower = DecisionTreeClassifier(maxDepth=DEPTH, minInstancesPerNode=50, seed=42, featuresCol="features", labelCol="label_index")
    data = classify.prepared(views.trips(spark, sf_dir))
    return exported(classify.pipeline(grower, scaled=False).fit(data), classify.FEATURES)


if __name__ == "__main__":
    from ..session import session

    DEFAULT.write_text(json.dumps(asdict(train(session("train"), sys.argv[1])), indent=1) + "\n")
