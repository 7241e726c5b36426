"""The registry of classifiers, their training and their votes (survey C1 to C11, S13, S14)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.operators import fits, fuzzy, sampling
from lexispark.operators.fits import Rows, rows_of, softmax, sparse

SEED = 786


def _argmax(scores):
    """(place, value) of the largest entry, the first among equals."""
    top = F.array_max(scores)
    return F.array_position(scores, top).cast("int") - 1, top


class OneVsRestModel:
    """One binary model for each class; probabilities are the sigmoids of their margins, scaled to sum 1."""

    def __init__(self, models, labels):
        self.models, self.labels = models, labels

    def predict(self, df: DataFrame, features: str) -> DataFrame:
        out = df
        for i, m in enumerate(self.models):
            m = m.copy().setFeaturesCol(features).setRawPredictionCol(f"_r{i}").setPredictionCol(f"_p{i}")
            if hasattr(m, "setProbabilityCol"):
                m.setProbabilityCol(f"_q{i}")
            out = m.transform(out)
        sure = F.array(*(1 / (1 + F.exp(-F.get(vector_to_array(f"_r{i}"), F.lit(1)))) for i in range(len(self.models))))
        total = F.aggregate(sure, F.lit(0.0), lambda a, x: a + x)
        place, top = _argmax(sure)
        out = out.withColumn("prediction", F.get(F.array(*map(F.lit, self.labels)), place)).withColumn("prob", top / total)
        return out.drop(*(c for c in out.columns if c[:2] in ("_r", "_p", "_q") and c[2:].isdigit()))


    def save(self, path: str) -> None:
        PipelineModel(self.models).write().overwrite().save(f"{path}/models")
        _put(path, {"labels": self.labels})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> OneVsRestModel:
        return cls(PipelineModel.load(f"{path}/models").stages, _got(spark, path)["labels"])


def _put(path: str, facts: dict) -> None:
    """Facts about a model as one row of JSON beside its files."""
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(facts),)], "facts string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def _got(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/facts").first()[0])


def one_vs_rest(binary) -> Callable:
    def train(df: DataFrame, features: str, label: str) -> OneVsRestModel:
        labels = sorted(r[0] for r in df.select(label).distinct().collect())
        df = df.cache()
        models = [binary.copy().setFeaturesCol(features).setLabelCol("_y").fit(df.withColumn("_y", (F.col(label) == name).cast("double"))) for name in labels]
        df.unpersist()
        return OneVsRestModel(models, labels)

    return train


class ProbabilityModel:
    """A fitted model with class probabilities."""

    def __init__(self, index, model):
        self.index, self.model = index, model

    def predict(self, df: DataFrame, features: str) -> DataFrame:
        out = self.model.setFeaturesCol(features).transform(df)
        place, top = _argmax(vector_to_array("probability"))
        names = F.array(*map(F.lit, self.index.labels))
        return out.withColumn("_class", F.get(names, place)).withColumn("prob", top).drop("prediction", "probability", "rawPrediction").withColumnRenamed("_class", "prediction")


    def save(self, path: str) -> None:
        PipelineModel([self.index, self.model]).write().overwrite().save(f"{path}/models")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ProbabilityModel:
        return cls(*PipelineModel.load(f"{path}/models").stages)


def multiclass(make: Callable) -> Callable:
    """make(number of features, number of classes) -> estimator."""

    def train(df: DataFrame, features: str, label: str) -> ProbabilityModel:
        index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(df)
        width = df.select(features).first()[0].size
        model = make(width, len(index.labels)).setFeaturesCol(features).setLabelCol("_y").fit(index.transform(df))
        return ProbabilityModel(index, model)

    return train


class TextModel:
    """The class of the most similar training text; the similarity is the probability."""

    def __init__(self, train: DataFrame, text: str, label: str, order: str, measure: str):
        self.args = (train, text, label, order)
        self.measure = measure

    def predict(self, df: DataFrame, features: str) -> DataFrame:
        out = fuzzy.nearest(df, *self.args, measure=self.measure, by_text=self.measure != "jaro")
        return out.withColumnRenamed("similarity", "prob")

    def save(self, path: str) -> None:
        train, text, label, order = self.args
        train.select(text, label, order).write.mode("overwrite").parquet(f"{path}/texts")
        _put(path, {"columns": [text, label, order], "measure": self.measure})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextModel:
        facts = _got(spark, path)
        return cls(spark.read.parquet(f"{path}/texts"), *facts["columns"], facts["measure"])


class LinearScores:
    """A linear score for each class, and the softmax of the scores as probabilities; features are vectors."""

    def __init__(self, labels: list[str], weights: np.ndarray, bias: np.ndarray):
        self.labels, self.weights, self.bias = labels, weights, bias

    @property
    def sent(self):
        """What each task needs of the model."""
        return self.weights, self.bias

    def shares(self, col: pd.DataFrame, model) -> np.ndarray:
        return softmax(scores(rows_of(col), *model))

    def predict(self, df: DataFrame, features: str) -> DataFrame:
        model = df.sparkSession.sparkContext.broadcast(self.sent)
        shares = type(self).shares
        bare = type(self).__new__(type(self))  # without weights, which are sent once
        bare.labels = self.labels

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for col in batches:
                share = shares(bare, col, model.value)
                place = share.argmax(axis=1) if len(share) else np.zeros(0, int)
                yield pd.DataFrame({"place": place.astype("int32"), "prob": share[np.arange(len(share)), place]})

        said = F.pandas_udf(run, "place int, prob double")(sparse(features))
        out = df.withColumn("_said", said)
        return out.withColumn("prediction", F.get(F.array(*map(F.lit, self.labels)), F.col("_said.place"))).withColumn("prob", F.col("_said.prob")).drop("_said")


    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        rows = [(name, float(b), w.tolist()) for name, b, w in zip(self.labels, self.bias, self.weights)]
        spark.createDataFrame(rows, "label string, bias double, weights array<double>").write.mode("overwrite").parquet(f"{path}/scores")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearScores:
        rows = sorted(spark.read.parquet(f"{path}/scores").collect())
        return cls([r.label for r in rows], np.array([r.weights for r in rows]), np.array([r.bias for r in rows]))


class SigmoidScores(LinearScores):
    """A logistic regression of each class against the rest; probabilities are the sigmoids, scaled to sum 1."""

    def shares(self, col: pd.DataFrame, model) -> np.ndarray:
        sure = 1 / (1 + np.exp(-np.clip(scores(rows_of(col), *model), -500, 500)))
        return sure / sure.sum(axis=1, keepdims=True)


def logistic_of_all(**options) -> Callable:
    """C3, all classes fitted in the same passes."""

    def train(df: DataFrame, features: str, label: str, weight: str | None = None) -> SigmoidScores:
        return SigmoidScores(*fits.logistic_of_all(df, features, label, weight=weight, **options))

    return train


class Network(LinearScores):
    """C4: one layer of tanh units over sparse features, and a softmax."""

    def __init__(self, labels: list[str], layers: list[np.ndarray]):
        self.labels, self.layers = labels, layers

    @property
    def sent(self):
        return self.layers

    def shares(self, col: pd.DataFrame, model) -> np.ndarray:
        row, place, value, n = rows_of(col)
        every = fits.damped(Rows(row, place, value, np.zeros(n, dtype=int)))
        return np.concatenate([np.zeros((0, len(self.labels))), *(fits.forward(part, *model)[1] for part in every.parts())])

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        rows = [(i, k, r.astype(float).tolist()) for i, layer in enumerate(self.layers) for k, r in enumerate(np.atleast_2d(layer))]
        spark.createDataFrame(rows, "layer int, row int, weights array<double>").write.mode("overwrite").parquet(f"{path}/layers")
        _put(path, {"labels": self.labels})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Network:
        rows = sorted(spark.read.parquet(f"{path}/layers").collect(), key=lambda r: (r.layer, r.row))
        layers = [np.array([r.weights for r in rows if r.layer == i], dtype=np.float32) for i in range(4)]
        return cls(_got(spark, path)["labels"], [x[0] if i % 2 else x for i, x in enumerate(layers)])


def network_of_words(**options) -> Callable:
    def train(df: DataFrame, features: str, label: str, weight: str | None = None) -> Network:
        return Network(*fits.network_of_words(df, features, label, weight=weight, **options))

    return train


MODELS = {c.__name__: c for c in (OneVsRestModel, ProbabilityModel, TextModel, LinearScores, SigmoidScores, Network)}


def scores(rows, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    row, place, value, n = rows
    out = np.tile(bias, (n, 1))
    for k in range(len(bias)):
        out[:, k] += np.bincount(row, weights=value * weights[k, place], minlength=n)
    return out


def boosted_linear(rounds: int = 20, rate: float = 0.5, ridge: float = 1.0) -> Callable:
    """A boosted linear model of the softmax loss. Each round is one pass over the rows, which gives the gradient
    and curvature of every weight; all weights take their Newton step at once, scaled by `rate` and by how many entries
    a row has, so that steps of features that stand together do not add up beyond the loss. A task sends two numbers
    for each feature and class."""

    def train(df: DataFrame, features: str, label: str) -> LinearScores:
        data = fits.packed(df, features, label)
        labels, width = data.labels, data.width
        weights, bias = np.zeros((len(labels), width)), np.zeros(len(labels))
        for _ in range(rounds):
            model = df.sparkSession.sparkContext.broadcast((weights, bias))

            def sums(batches: Iterator[Rows], model=model) -> np.ndarray:
                w, b = model.value
                grad, curve, ends = np.zeros_like(w), np.zeros_like(w), np.zeros((2, len(b)))
                for x in batches:
                    share = softmax(scores((x.row, x.place, x.value, len(x)), w, b))
                    entries = np.maximum(1, np.bincount(x.row, minlength=len(x)))
                    off = share - np.eye(len(b))[x.y]
                    bend = share * (1 - share)
                    ends += off.sum(axis=0), bend.sum(axis=0)
                    for k in range(len(b)):
                        grad[k] += np.bincount(x.place, weights=x.value * off[x.row, k], minlength=w.shape[1])
                        curve[k] += np.bincount(x.place, weights=x.value**2 * (bend[:, k] * entries)[x.row], minlength=w.shape[1])
                return np.concatenate([grad.ravel(), curve.ravel(), ends.ravel()])

            found = fits.summed(data, sums, 16 * weights.size)
            grad, curve = found[: 2 * weights.size].reshape(2, *weights.shape)
            ends = found[2 * weights.size :].reshape(2, -1)
            weights = weights - rate * (grad + ridge * weights) / (curve + ridge)
            bias = bias - rate * ends[0] / (ends[1] + ridge)
            model.unpersist()
        data.close()
        return LinearScores(labels, weights, bias)

    return train


def discriminant(shrink: float = 1e-3, widest: int = 1000) -> Callable:
    """Linear discriminant analysis: class means and one covariance for all classes, by one pass of sums; a share
    `shrink` of the mean variance is added to the diagonal. For dense features, `widest` of them at most, as a task sends
    the square of their number."""

    def train(df: DataFrame, features: str, label: str) -> LinearScores:
        width = df.select(features).first()[0].size
        if width > widest:
            raise ValueError(f"{width} features; {widest} are the most for a covariance matrix")
        data = fits.packed(df, features, label)
        labels, classes = data.labels, len(data.labels)

        def sums(batches: Iterator[Rows]) -> np.ndarray:
            number, first, second = np.zeros(classes), np.zeros((classes, width)), np.zeros((width, width))
            for rows in batches:
                x = np.zeros((len(rows), width))
                x[rows.row, rows.place] = rows.value
                second += x.T @ x
                number += np.bincount(rows.y, minlength=classes)
                np.add.at(first, rows.y, x)
            return np.concatenate([number, first.ravel(), second.ravel()])

        found = fits.summed(data, sums, 8 * width * (width + classes))
        data.close()
        number, first, second = found[:classes], found[classes : classes * (1 + width)].reshape(classes, width), found[classes * (1 + width) :].reshape(width, width)
        total = number.sum()
        means = first / number[:, None]
        within = (second - (means.T * number) @ means) / max(1, total - classes)
        within += np.eye(width) * (shrink * np.trace(within) / width + 1e-12)
        weights = np.linalg.solve(within, means.T).T
        bias = np.log(number / total) - 0.5 * (weights * means).sum(axis=1)
        return LinearScores(labels, weights, bias)

    return train


@dataclass
class Classifier:
    name: str
    train: Callable
    on_text: bool = False
    weighted: bool = False  # whether train() takes the column that says how many times a row counts


def registry(live: bool = True) -> list[Classifier]:
    """The classifiers in their order, which the vote depends on. Not live: the ones that are kept for trials."""
    found = [
        Classifier("Jaro", lambda df, text, label, order: TextModel(df, text, label, order, "jaro"), True),
        Classifier("DLevenshtein", lambda df, text, label, order: TextModel(df, text, label, order, "dl"), True),
        Classifier("Logistic_OvR", logistic_of_all(ridge=0.001, rounds=50), weighted=True),
        Classifier("DeepNN", network_of_words(units=209, seed=SEED), weighted=True),
    ]
    if not live:
        found += [
            Classifier("BoostedLinear", boosted_linear()), Classifier("Multinomial", multiclass(lambda w, k: LogisticRegression(family="multinomial", regParam=0.01, elasticNetParam=0.1, maxIter=50))),
            Classifier("Discriminant", discriminant()),
            Classifier("LinearSVC", one_vs_rest(LinearSVC(maxIter=30, regParam=0.01))), Classifier("NaiveBayes", multiclass(lambda w, k: NaiveBayes())),
            Classifier("RandomForest", multiclass(lambda w, k: RandomForestClassifier(numTrees=50, seed=SEED))),
            Classifier("BoostedTrees", one_vs_rest(GBTClassifier(maxIter=10, seed=SEED))),
        ]
    return found


def trained(df: DataFrame, text: str, features: str, label: str, order: str, which: list[Classifier] | None = None, texts: DataFrame | None = None, copies: str | None = None) -> dict[str, object]:
    """Each classifier of the registry fitted on the training rows alone. `texts`, if given, has these rows once for each
    text and class, with the first in `order` and in `copies` how many they are; classifiers that can learn from it do."""
    few = df if texts is None else texts

    def fitted(c: Classifier):
        if c.on_text:
            return c.train(few, text, label, order)
        return c.train(df, features, label) if texts is None or not c.weighted else c.train(few, features, label, copies)

    return {c.name: fitted(c) for c in (which or registry())}


def votes(models: dict[str, object], df: DataFrame, features: str, row: str) -> DataFrame:
    """Long votes: row_id, clf_idx, clf, prediction, prob."""
    out = None
    for i, (name, model) in enumerate(models.items()):
        one = model.predict(df, features).select(F.col(row).alias("row_id"), F.lit(i).alias("clf_idx"), F.lit(name).alias("clf"), "prediction", F.col("prob").cast("double").alias("prob"))
        out = one if out is None else out.unionByName(one)
    return out


def knn(train: DataFrame, new: DataFrame, features: str, label: str, row: str, k: int = 10, block: int = 2000) -> DataFrame:
    """The most frequent class among the k nearest training vectors (dense array column), by blocks of training
    rows against blocks of new ones; each pair of blocks sends its k best alone. new is the stated query set against
    all rows."""
    t = train.select(F.col(features).alias("t_v"), F.col(label).alias("t_c"), F.xxhash64(features, label).alias("t_h"))
    blocks, turns = 1 + t.count() // block, 1 + new.count() // block
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    t = t.withColumn("b", F.pmod("t_h", F.lit(blocks))).withColumn("turn", every(turns))
    q = new.select(F.col(row).alias("row_id"), F.col(features).alias("q_v"))
    q = q.withColumn("turn", F.pmod(F.xxhash64("row_id"), F.lit(turns))).withColumn("b", every(blocks))

    def near(a, b):
        import pandas as pd

        if not len(a) or not len(b):
            return pd.DataFrame({"row_id": [], "d": [], "c": []}).astype({"row_id": "int64", "d": "float64", "c": "object"})
        x, y = np.stack(a["t_v"]), np.stack(b["q_v"])
        d = np.maximum((y * y).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * y @ x.T, 0)
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(y)), best.shape[1])
        return pd.DataFrame({"row_id": b["row_id"].to_numpy()[rows], "d": d[rows, best.ravel()], "c": a["t_c"].to_numpy()[best.ravel()]})

    some = t.groupBy("b", "turn").cogroup(q.groupBy("b", "turn")).applyInPandas(near, "row_id long, d double, c string")
    top = some.groupBy("row_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "c"))), 1, k).alias("n"))
    counts = top.select("row_id", F.explode("n.c").alias("c")).groupBy("row_id", "c").agg(F.count("*").alias("n"))
    return counts.groupBy("row_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "c")).alias("s"), F.sum("n").alias("all")).select("row_id", F.col("s.c").alias("prediction"), (-F.col("s.m") / F.col("all")).alias("prob"))


def stacked(long_votes: DataFrame, labels: DataFrame, row: str = "row_id", label: str = "label"):
    """A forest over the classifiers' predictions. Returns a function from long votes to (row_id, prediction)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler

    names = [r.clf for r in long_votes.groupBy("clf").agg(F.min("clf_idx").alias("i")).orderBy("i").collect()]

    def wide(v: DataFrame) -> DataFrame:
        return v.groupBy(row).agg(*(F.coalesce(F.max(F.when(F.col("clf") == n, F.col("prediction"))), F.lit("")).alias(f"v_{n}") for n in names))

    data = wide(long_votes).join(labels.select(row, label), row)
    index = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep").fit(data)
    parts = [StringIndexer(inputCol=f"v_{n}", outputCol=f"i_{n}", handleInvalid="keep") for n in names]
    hot = OneHotEncoder(inputCols=[f"i_{n}" for n in names], outputCols=[f"h_{n}" for n in names], handleInvalid="keep")
    forest = RandomForestClassifier(featuresCol="f", labelCol="y", numTrees=50, seed=SEED)
    model = Pipeline(stages=[*parts, hot, VectorAssembler(inputCols=[f"h_{n}" for n in names], outputCol="f"), forest]).fit(index.transform(data))
    back = IndexToString(inputCol="prediction", outputCol="said", labels=index.labels)
    return lambda v: back.transform(model.transform(wide(v))).select(row, F.col("said").alias("prediction"))


def cross_validated(df: DataFrame, train: Callable, features: str, label: str, key: str, number: int = 5) -> DataFrame:
    """Each row's prediction by a model that was fitted without its fold: key, label, prediction, fold."""
    split, out = sampling.folds(df, label, key, number), None
    for i in range(number):
        model = train(split.where(F.col("fold") != i), features, label)
        one = model.predict(split.where(F.col("fold") == i), features).select(key, label, "prediction", "fold")
        out = one if out is None else out.unionByName(one)
    return out


def units_tree(df: DataFrame, features: str, label: str, depth: int = 4):
    """A shallow decision tree; its toDebugString is the printed tree."""
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(df)
    return DecisionTreeClassifier(featuresCol=features, labelCol="_y", maxDepth=depth, seed=SEED).fit(index.transform(df))


def important_features(model: ProbabilityModel, names: list[str], number: int | None = None) -> list[tuple[str, float]]:
    """(feature, importance) of a fitted forest or tree, the most important first, by name among equals; features of
    no importance are left out."""
    weights = model.model.featureImportances
    found = sorted(((names[i], float(w)) for i, w in zip(weights.indices, weights.values) if w > 0), key=lambda x: (-x[1], x[0]))
    return found[:number]


def network_weights(model: Network | ProbabilityModel) -> list[np.ndarray]:
    """C11: the weight matrix of each layer of a network, inputs and a bias (last row) by outputs."""
    if isinstance(model, Network):
        return [np.vstack([w, b]) for w, b in zip(model.layers[::2], model.layers[1::2])]
    layers, flat, out, at = model.model.getLayers(), model.model.weights.toArray(), [], 0
    for a, z in zip(layers, layers[1:]):
        inner, bias = flat[at : at + a * z].reshape(z, a, order="F").T, flat[at + a * z : at + (a + 1) * z]
        out.append(np.vstack([inner, bias]))
        at += (a + 1) * z
    return out


def coefficients(model: OneVsRestModel | LinearScores, names: list[str]) -> list[tuple[str, str, float]]:
    """C11: (class, feature, weight) of linear models."""
    if isinstance(model, LinearScores):
        return [(label, name, float(w)) for label, row in zip(model.labels, model.weights) for name, w in zip(names, row)]
    return [(label, name, float(w)) for label, m in zip(model.labels, model.models) for name, w in zip(names, m.coefficients.toArray())]
