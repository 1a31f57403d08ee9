"""Classifiers on pyspark.ml, their tuning and evaluation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breathlake.session import cut

SEED = 42


@dataclass
class Classifier:
    """A named model with its parameters: ``logistic, forest, boosting, svm, network``.

    ``svm`` with ``kernel='rbf'`` is a linear machine on random Fourier
    features, which scales where an exact kernel machine does not.
    """

    kind: str
    features: list[str]
    label: str = "label"
    params: dict = field(default_factory=dict)
    model: PipelineModel | None = None
    head: object = None

    def _stages(self, df: DataFrame) -> list:
        p, k = self.params, df.select(self.label).distinct().count()
        common = {"labelCol": self.label, "featuresCol": "features"}
        if self.kind == "logistic":
            n = max(1, df.count())
            m = LogisticRegression(regParam=1.0 / (p.get("C", 1.0) * n), standardization=False, maxIter=p.get("max_iter", 1000), **common)
        elif self.kind == "forest":
            m = RandomForestClassifier(numTrees=p.get("n_estimators", 100), maxDepth=p.get("max_depth", 10), seed=SEED, weightCol="_weight", **common)
        elif self.kind == "boosting":
            m = GBTClassifier(maxIter=p.get("n_estimators", 100), stepSize=p.get("learning_rate", 0.1), maxDepth=p.get("max_depth", 3), seed=SEED, **common)
        elif self.kind == "svm":
            m = LinearSVC(regParam=1.0 / (p.get("C", 1.0) * max(1, df.count())), maxIter=p.get("max_iter", 100), **common)
        elif self.kind == "network":
            m = MultilayerPerceptronClassifier(layers=[len(self.features), *p.get("hidden", [100]), k], seed=SEED, maxIter=p.get("max_iter", 500), **common)
        else:
            raise ValueError(f"unknown classifier {self.kind}")
        if self.kind in ("boosting", "svm") and k > 2:
            m = OneVsRest(classifier=m, labelCol=self.label, featuresCol="features")
        return [VectorAssembler(inputCols=self.features, outputCol="_raw"), StandardScaler(withMean=True, inputCol="_raw", outputCol="features"), m]

    def _rows(self, df: DataFrame) -> DataFrame:
        """Features as doubles, missing ones 0, with random Fourier features for an rbf kernel."""
        df = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in self.features else F.col(c) for c in df.columns])
        return df

    def fit(self, df: DataFrame) -> Classifier:
        df = self._rows(df).filter(F.col(self.label).isNotNull()).withColumn(self.label, F.col(self.label).cast("double"))
        stages = self._stages(df)
        if self.kind == "forest":
            w = df.groupBy(self.label).agg(F.count("*").alias("_c"))
            total, k = w.agg(F.sum("_c"), F.count("*")).first()
            df = df.join(F.broadcast(w.select(self.label, (F.lit(float(total)) / (k * F.col("_c"))).alias("_weight"))), self.label)  # one row a class
        if self.kind == "svm" and self.params.get("kernel", "rbf") == "rbf":
            self.model = Pipeline(stages=stages[:2]).fit(df)
            ready = fourier_features(self.model.transform(df), len(self.features), self.params)
            last = stages[2].setFeaturesCol("rff") if hasattr(stages[2], "setFeaturesCol") else stages[2]
            self.head = last.fit(ready)
        else:
            self.model, self.head = Pipeline(stages=stages).fit(df), None
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """The rows with ``prediction`` and, where the model gives them, ``scores`` of the classes in order and ``score`` of class 1."""
        if self.model is None:
            raise ValueError("not fitted")
        out = self.model.transform(self._rows(df))
        if self.head is not None:
            out = self.head.transform(fourier_features(out, len(self.features), self.params))
        if "probability" in out.columns:
            out = out.withColumn("scores", vector_to_array("probability"))
        elif "rawPrediction" in out.columns:
            out = out.withColumn("scores", F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-x))))
        if "scores" in out.columns:
            out = out.withColumn("score", F.get("scores", F.lit(1)))
        return out.drop("_raw", "features", "rff", "rawPrediction", "probability")

    def importances(self, df: DataFrame | None = None) -> dict[str, float]:
        """Of the features: impurity for trees, absolute coefficients for linear models.

        An rbf machine and a network have neither; for them it is the accuracy
        lost on ``df`` when a feature is replaced by its mean.
        """
        m = self.model.stages[-1]
        if self.head is None and hasattr(m, "featureImportances"):
            v = m.featureImportances.toArray()
        elif self.head is None and hasattr(m, "coefficientMatrix"):
            v = np.abs(m.coefficientMatrix.toArray()).sum(axis=0)
        elif self.head is None and (parts := getattr(m, "models", [m])) and all(hasattr(x, "featureImportances") for x in parts):
            v = np.mean([x.featureImportances.toArray() for x in parts], axis=0)
        elif self.head is None and all(hasattr(x, "coefficients") for x in parts):
            v = np.sum([np.abs(x.coefficients.toArray()) for x in parts], axis=0)
        else:
            if df is None:
                raise ValueError(f"importances of {self.kind} need rows")
            hit = F.avg((F.col("prediction") == F.col(self.label).cast("double")).cast("double"))
            mean = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in self.features]).first()  # one row
            score = lambda d: self.predict(d).agg(hit).first()[0] or 0.0
            whole = score(df)
            v = np.array([whole - score(df.withColumn(c, F.lit(mean[c] or 0.0))) for c in self.features])
        return dict(zip(self.features, v.tolist()))

    def save(self, path: str) -> None:
        """The scaled model under ``path/model``, and the machine on random features, if any, under ``path/head``."""
        self.model.write().overwrite().save(f"{path}/model")
        head = PipelineModel([self.head] if self.head is not None else [])
        head.write().overwrite().save(f"{path}/head")

    def load(self, path: str) -> Classifier:
        self.model = PipelineModel.load(f"{path}/model")
        stages = PipelineModel.load(f"{path}/head").stages
        self.head = stages[0] if stages else None
        return self


def fourier_features(df: DataFrame, n: int, params: dict) -> DataFrame:
    """``rff``: random cosines whose inner products approach an rbf kernel of width ``gamma``."""
    rng = np.random.default_rng(SEED)
    size = params.get("components", 200)
    w = rng.normal(scale=np.sqrt(2 * params.get("gamma", 1.0 / n)), size=(n, size))
    b = rng.uniform(0, 2 * np.pi, size)

    @F.pandas_udf("array<double>")
    def map_(x):
        import pandas as pd

        z = np.stack(x.to_numpy()) if len(x) else np.zeros((0, n))
        return pd.Series(list(np.sqrt(2 / size) * np.cos(z @ w + b)))

    return df.withColumn("rff", array_to_vector(map_(vector_to_array("features"))))


# --- evaluation: aggregations over predictions -------------------------------------------


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.groupBy(label, prediction).agg(F.count("*").alias("n"))


def class_scores(cells: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall and F1 of each class, from confusion counts; 0 where undefined."""
    t = cells.groupBy(F.col(label).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0)).alias("hit"))
    p = cells.groupBy(F.col(prediction).alias("class")).agg(F.sum("n").alias("predicted"))
    j = t.join(p, "class", "full").fillna(0, ["support", "hit", "predicted"])
    pr, rc = F.coalesce(F.try_divide("hit", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    return j.select("class", "support", pr.alias("precision"), rc.alias("recall"), F.coalesce(F.try_divide(2 * pr * rc, pr + rc), F.lit(0.0)).alias("f1"))


def summary(cells: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, macro F1 and support-weighted precision, recall and F1: one row."""
    c = class_scores(cells, label, prediction)
    n = F.sum("support")
    w = lambda x: F.sum(F.col(x) * F.col("support")) / n
    return c.agg(w("recall").alias("accuracy"), F.avg("f1").alias("macro_f1"), w("precision").alias("precision"), w("recall").alias("recall"), w("f1").alias("f1"))


def binary_rates(cells: DataFrame, label: str = "label", prediction: str = "prediction", positive: float = 1) -> DataFrame:
    """Accuracy, sensitivity and specificity of ``positive`` against the rest, from confusion counts: one row, NULL where undefined."""
    y, hit = F.col(label) == positive, (F.col(label) == positive) == (F.col(prediction) == positive)
    share = lambda rows: F.try_divide(F.sum(F.when(rows & hit, F.col("n")).otherwise(0)), F.sum(F.when(rows, F.col("n")).otherwise(0)))
    return cells.agg(share(F.lit(True)).alias("accuracy"), share(y).alias("sensitivity"), share(~y).alias("specificity"))


def roc(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One point per distinct score, from high to low: rates of false and true positives.

    Scores are counted first; cumulative counts come from tie-averaged ranks per class.
    """
    from breathlake.operators.stats import ranks

    d = pred.select(F.col(label).cast("int").alias("y"), (-F.col(score).cast("double")).alias("value")).dropna()
    r = ranks(d.withColumn("all", F.lit(1)), ["all"])
    c = d.groupBy("value").agg(F.sum("y").alias("pos"), F.count("*").alias("n_v"))
    total = d.agg(F.sum("y").alias("p"), (F.count("*") - F.sum("y")).alias("q")).first()
    p, q = float(total["p"] or 0), float(total["q"] or 0)
    pos = ranks(d.filter("y = 1").withColumn("all", F.lit(1)), ["all"]).select("value", (F.col("rank") + (F.col("n") - 1) / 2).alias("tp_at"))
    pts = r.select("value", (F.col("rank") + (F.col("n") - 1) / 2).alias("upto")).join(c, "value").join(pos, "value", "left")
    # scores without a positive take the count of the one before: ranges of scores keep the window short
    w = Window.partitionBy("_r").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    pts = pts.withColumn("_r", F.floor(F.col("upto") / 65536))
    first = pts.groupBy("_r").agg(F.max("tp_at").alias("m"))
    carry = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row for 65536 scores
    first = first.select("_r", F.max("m").over(carry).alias("carry"))
    pts = pts.join(first, "_r").withColumn("tp", F.coalesce(F.max("tp_at").over(w), "carry", F.lit(0.0)))
    return pts.select((-F.col("value")).alias("threshold"), F.try_divide(F.col("upto") - F.col("tp"), F.lit(q)).alias("fpr"), F.try_divide(F.col("tp"), F.lit(p)).alias("tpr"))


def auc(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the curve from rank sums: one row."""
    from breathlake.operators.stats import mann_whitney

    long = pred.select(F.lit("score").alias("feature"), F.col(label).cast("int").alias("label"), F.col(score).cast("double").alias("value"))
    u = mann_whitney(long, 1, 0)
    return u.select(F.try_divide(F.col("statistic"), F.col("n1") * F.col("n2")).alias("auc"))


def auc_by_class(pred: DataFrame, label: str = "label", scores: str = "scores") -> DataFrame:
    """``class, n, auc`` of each class against the rest; labels are 0, 1, ... and number the entries of ``scores``.

    A class without rows, or with all of them, has a NULL area. Their average is
    the area over several classes.
    """
    from breathlake.operators.stats import mann_whitney

    d = pred.select(F.col(label).cast("int").alias("_y"), F.posexplode(scores).alias("_c", "value")).dropna()
    u = mann_whitney(d.select(F.col("_c").cast("string").alias("feature"), (F.col("_y") == F.col("_c")).cast("int").alias("label"), "value"), 1, 0)
    return u.select(F.col("feature").cast("int").alias("class"), F.col("n1").alias("n"), F.try_divide("statistic", F.col("n1") * F.col("n2")).alias("auc"))


def auc_macro(pred: DataFrame, label: str = "label", scores: str = "scores") -> DataFrame:
    """The plain average of the areas of all classes against the rest: one row."""
    return auc_by_class(pred, label, scores).agg(F.avg("auc").alias("auc"))


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5) -> DataFrame:
    """``fold`` 0..k-1, even within each label: rows of a label lie in hash order and are dealt in turn.

    Ordering is by ranges of the hash, so one label may hold any share of the rows.
    """
    h = F.xxhash64(F.col(key), F.lit(SEED))
    d = df.withColumn("_h", h).withColumn("_b", F.shiftright("_h", 56))
    n = d.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    off = F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.select(F.col(label).alias("_l"), "_b", off.alias("_off"))
    rn = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key))
    d = d.withColumn("_rn", rn)
    j = d.join(n, [d[label].eqNullSafe(n["_l"]), d["_b"] == n["_b"]]).drop(n["_b"])
    return j.withColumn("fold", F.pmod(F.col("_off") + F.col("_rn") - 1, F.lit(k)).cast("int")).drop("_h", "_b", "_rn", "_off", "_l")


def grid_search(df: DataFrame, base: Classifier, grid: list[dict], key: str, folds: int = 5, together: bool = True) -> tuple[Classifier, DataFrame]:
    """Every parameter set by stratified cross-validation; the best is refitted on all rows.

    Equal scores go to the set listed first. Logistic models of two classes that
    differ in ``C`` alone are fitted for all sets and folds ``together``, others
    one by one. Only one accuracy for each fold and set comes to the driver.
    """
    if together and base.kind == "logistic" and all(set(p) <= {"C"} for p in grid):
        g, sizes = _blocked(df, key, base.label, base.features)
        if sorted(sizes) == [0.0, 1.0]:
            c = np.repeat([p.get("C", base.params.get("C", 1.0)) for p in grid], folds)
            plan = Folds(sizes, folds, len(grid))
            scores = _accuracy(_tally(g, plan, *_logistic_rounds(g, plan, len(base.features), c, base.params.get("max_iter", 1000)))).reshape(len(grid), folds)
            return _refitted(df, base, grid, scores)
    d = stratified_folds(df.filter(F.col(base.label).isNotNull()), key, base.label, folds).persist()
    scores = np.full((len(grid), folds), np.nan)
    for i, p in enumerate(grid):
        for f in range(folds):
            c = Classifier(base.kind, base.features, base.label, base.params | p).fit(d.filter(F.col("fold") != f))
            hit = F.avg((F.col("prediction") == F.col(base.label).cast("double")).cast("double"))
            got = c.predict(d.filter(F.col("fold") == f)).agg(hit).first()[0]
            scores[i, f] = np.nan if got is None else got
    d.unpersist()
    return _refitted(df, base, grid, scores)


def _refitted(df: DataFrame, base: Classifier, grid: list[dict], scores: np.ndarray) -> tuple[Classifier, DataFrame]:
    """The best parameter set fitted on all rows, and mean and deviation of every set over its folds with rows."""
    mean, sd = np.nanmean(scores, axis=1), np.nanstd(scores, axis=1)
    fitted = Classifier(base.kind, base.features, base.label, base.params | grid[int(np.argmax(mean))]).fit(df)
    rows = [(i, str(sorted(p.items())), float(mean[i]), float(sd[i])) for i, p in enumerate(grid)]
    return fitted, df.sparkSession.createDataFrame(rows, "candidate int, params string, mean_score double, std_score double")


class Draws:
    """Stratified bootstrap: each label's share of ``(1 - test_size) * n`` rows, drawn with replacement within the label.

    ``sizes`` has the rows of each block of each label. A round's draws of a label
    fall on its blocks by one multinomial and on the rows of a block by another, so
    any block finds its own rows' counts from the seed. A row of no draw is out of
    the bag; a round with fewer than 10 of those is a stratified split instead.
    """

    def __init__(self, sizes: dict[float, list[int]], rounds: int, test_size: float = 0.2, seed: int = SEED) -> None:
        self.labels, self.sizes, self.rounds, self.seed = sorted(sizes), sizes, rounds, seed
        n = sum(map(sum, sizes.values()))
        train = n - int(n * test_size)
        share = [sum(sizes[c]) / n * train for c in self.labels]
        take = [int(x) for x in share]
        for i in sorted(range(len(take)), key=lambda i: take[i] - share[i])[: train - sum(take)]:
            take[i] += 1
        self.take = dict(zip(self.labels, take))
        self.blocks = {c: np.array([self._rng(r, c, 0).multinomial(self.take[c], np.array(sizes[c]) / sum(sizes[c])) for r in range(rounds)], dtype=np.int32) for c in self.labels}
        self.split: set[int] = set()
        if n <= 1000:  # beyond, fewer than 10 of some 45 % do not happen
            out = sum((self.times(c, b, range(rounds)) == 0).sum(0) for c in self.labels for b in range(len(sizes[c])))
            self.split = set(np.flatnonzero(out < 10).tolist())

    def _rng(self, r: int, label: float, block: int) -> np.random.Generator:
        return np.random.default_rng([self.seed, r, self.labels.index(label), block])

    def times(self, label: float, block: int, rounds: range) -> np.ndarray:
        """How often each row of a block is drawn, by round."""
        n = self.sizes[label][block]
        out = np.zeros((n, len(rounds)))
        for i, r in enumerate(rounds):
            rng = self._rng(r, label, block + 1)
            if r in self.split:  # few rows: the label is one block
                out[rng.permutation(n)[: self.take[label]], i] = 1
            else:
                out[:, i] = np.bincount(rng.integers(0, n, self.blocks[label][r, block]), minlength=n)
        return out


class Folds:
    """Stratified cross-validation in the form of ``Draws``: ``repeats`` times ``k`` rounds, each without one fold of every label.

    ``whole`` adds a round of all rows. Rows lie in hash order within their
    blocks and are dealt to the folds in turn.
    """

    def __init__(self, sizes: dict[float, list[int]], k: int, repeats: int = 1, whole: bool = False) -> None:
        self.labels, self.k, self.rounds = sorted(sizes), k, k * repeats + whole
        self.last = k * repeats
        self.at = {c: np.r_[0, np.cumsum(n)] for c, n in sizes.items()}

    def times(self, label: float, block: int, rounds: range) -> np.ndarray:
        fold = np.arange(self.at[label][block], self.at[label][block + 1]) % self.k
        r = np.array(rounds)
        return ((fold[:, None] != r[None] % self.k) | (r[None] >= self.last)).astype(float)


def _blocked(df: DataFrame, key: str, label: str, features: list[str], block: int = 1024) -> tuple[DataFrame, dict[float, list[int]]]:
    """Rows of each label in blocks by the key's hash, at most 2048 a label: ``y, b, x``, and the blocks' sizes."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    d = df.filter(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), F.xxhash64(F.col(key), F.lit(SEED)).alias("h"), F.col(key).cast("string").alias("k"), x.alias("x"))
    parts = {r["y"]: max(1, min(2048, r["n"] // block)) if r["n"] > 1000 else 1 for r in d.groupBy("y").agg(F.count("*").alias("n")).collect()}  # one row a class
    n = F.lit(1)
    for c, m in parts.items():
        n = F.when(F.col("y") == c, m).otherwise(n)
    g = d.groupBy("y", F.pmod("h", n).cast("int").alias("b")).agg(F.sort_array(F.collect_list(F.struct("h", "k", "x"))).alias("r"))
    g = cut(g.select("y", "b", F.col("r.x").alias("x")).repartition(min(sum(parts.values()), 4 * df.sparkSession.sparkContext.defaultParallelism), "y", "b"))
    sizes = {c: [0] * m for c, m in parts.items()}
    for r in g.select("y", "b", F.size("x").alias("n")).collect():  # one row a block
        sizes[r["y"]][r["b"]] = r["n"]
    return g, sizes


def _per_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[float, int, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            x = batch.column(2)[i].values
            yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _sums(g: DataFrame, run, keys: str) -> list:
    """One row for each of ``keys`` with the sum of its vectors ``v``, combined before the shuffle."""
    names = [k.split()[0] for k in keys.split(", ")]
    rows = g.mapInArrow(run, keys + ", v array<double>").select(*names, array_to_vector("v").alias("v"))
    return rows.groupBy(*names).agg(Summarizer.sum(F.col("v")).alias("v")).collect()


def _vectors(total: np.ndarray, **keys: np.ndarray) -> pa.RecordBatch:
    """Rows of ``keys`` and one vector each."""
    n, width = total.shape
    v = pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), pa.array(total.ravel()))
    return pa.RecordBatch.from_arrays([*map(pa.array, keys.values()), v], names=[*keys, "v"])


def _logistic_rounds(g: DataFrame, draws: Draws | Folds, p: int, c: float | np.ndarray, max_iter: int, active: np.ndarray | None = None, chunk: int = 250) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (intercept first) of the penalised logistic fit of every round, all rounds in the same passes.

    A pass sums gradients and curvatures by round; Newton's step, halved where the
    loss rose, is taken on the driver. Same objective as ``Classifier('logistic')``.
    ``c`` may differ by round, and ``active`` names the features (columns) each
    round (row) may use. Also returned: mean and deviation of a round's linear
    predictor over its own rows.
    """
    upper = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    rounds = draws.rounds

    def passed(width: int, kernel) -> np.ndarray:
        def run(batches):
            total = np.zeros((rounds, width))
            for y, b, x in _per_block(batches):
                a = np.c_[np.ones(len(x)), x]
                aa = np.stack([a[:, i] * a[:, j] for i, j in upper], axis=1)
                for at in range(0, rounds, chunk):
                    r = range(at, min(rounds, at + chunk))
                    total[r.start : r.stop] += kernel(y, a, aa, draws.times(y, b, r), r)
            yield _vectors(total, round=np.arange(rounds))

        out = np.zeros((rounds, width))
        for r in _sums(g, run, "round bigint"):  # one row a round
            out[r["round"]] = r["v"].toArray()
        return out

    def full(tri: np.ndarray) -> np.ndarray:
        h = np.zeros((rounds, p + 1, p + 1))
        for q, (i, j) in enumerate(upper):
            h[:, i, j] = h[:, j, i] = tri[:, q]
        return h

    m = full(passed(len(upper), lambda y, a, aa, t, r: t.T @ aa))
    n = np.maximum(m[:, 0, 0], 1)
    mean = m[:, 0, 1:] / n[:, None]
    var = np.einsum("rjj->rj", m[:, 1:, 1:]) / n[:, None] - mean**2
    sd = np.sqrt(np.where(var > 1e-12 * np.maximum(mean**2, 1e-300), var, 0) * (n / np.maximum(n - 1, 1))[:, None])
    inv = np.divide(1, sd, out=np.zeros_like(sd), where=sd > 0)  # a constant feature counts for nothing, as in StandardScaler
    if active is not None:
        inv = np.where(active, inv, 0.0)
    jac = np.zeros((rounds, p + 1, p + 1))
    jac[:, 0, 0], jac[:, 0, 1:] = 1, -mean * inv
    jac[:, range(1, p + 1), range(1, p + 1)] = inv
    ridge = np.c_[np.zeros(rounds), np.repeat(1 / np.broadcast_to(c, rounds)[:, None], p, axis=1)]
    theta, before, loss_before = np.zeros((rounds, p + 1)), None, np.full(rounds, np.inf)
    for _ in range(max_iter):
        coef = np.einsum("rij,rj->ri", jac, theta)

        def kernel(y, a, aa, t, r, coef=coef):
            eta = a @ coef[r.start : r.stop].T
            pr = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
            return np.c_[(t * (np.logaddexp(0, eta) - y * eta)).sum(0), (t * (pr - y)).T @ a, (t * pr * (1 - pr)).T @ aa]

        s = passed(1 + p + 1 + len(upper), kernel)
        loss = s[:, 0] + (ridge * theta**2).sum(1) / 2
        rose = loss > loss_before * (1 + 1e-12)
        if before is not None and rose.any():
            theta[rose] = (theta[rose] + before[rose]) / 2
        grad = np.einsum("rji,rj->ri", jac, s[:, 1 : p + 2]) + ridge * theta
        hess = np.einsum("rji,rjk,rkl->ril", jac, full(s[:, p + 2 :]), jac) + (ridge + 1e-12)[:, :, None] * np.eye(p + 1)
        step = np.linalg.solve(hess, grad[:, :, None])[:, :, 0]
        ok = ~rose
        if ok.all() and (np.einsum("ri,ri->r", grad, step) <= 1e-9 * np.maximum(loss, 1)).all():
            break
        before = theta.copy() if before is None else np.where(ok[:, None], theta, before)
        loss_before = np.where(ok, loss, loss_before)
        theta = np.where(ok[:, None], theta - step, theta)
    coef = np.einsum("rij,rj->ri", jac, theta)
    cov = m[:, 1:, 1:] / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    spread = np.sqrt(np.maximum(np.einsum("ri,rij,rj->r", coef[:, 1:], cov, coef[:, 1:]), 0))
    return coef, coef[:, 0] + (coef[:, 1:] * mean).sum(1), spread


#: Bins of a round's scores, about even over a bell-shaped spread; pairs within one count half for the area under the curve.
BINS = 256


def _tally(g: DataFrame, draws: Draws | Folds, coef: np.ndarray, centre: np.ndarray, spread: np.ndarray, chunk: int = 250) -> np.ndarray:
    """Of the rows a round was not fitted on, by round and label: counts by bin of the score, then predicted 0 and 1."""
    rounds = draws.rounds
    scale = np.where(spread > 0, spread, 1.0)

    def count(batches):
        total = np.zeros((rounds, 2, BINS + 2))
        for y, b, x in _per_block(batches):
            for at in range(0, rounds, chunk):
                r = slice(at, min(rounds, at + chunk))
                k = r.stop - r.start
                eta, out = coef[r, 0] + x @ coef[r, 1:].T, draws.times(y, b, range(r.start, r.stop)) == 0
                z = np.clip((eta - centre[r]) / scale[r], -20, 20)
                bin = np.minimum(BINS / (1 + np.exp(-1.702 * z)), BINS - 1).astype(np.int64)
                total[r, int(y), :BINS] += np.bincount((np.arange(k) * BINS + bin)[out], minlength=k * BINS).reshape(k, BINS)
                total[r, int(y), BINS] += ((eta <= 0) & out).sum(0)
                total[r, int(y), BINS + 1] += ((eta > 0) & out).sum(0)
        yield _vectors(total.reshape(2 * rounds, -1), round=np.repeat(np.arange(rounds), 2), y=np.tile([0, 1], rounds))

    out = np.zeros((rounds, 2, BINS + 2))
    for r in _sums(g, count, "round bigint, y bigint"):  # two rows a round
        out[r["round"], r["y"]] = r["v"].toArray()
    return out


def _accuracy(tally: np.ndarray) -> np.ndarray:
    cells = tally[:, :, BINS:]
    n = cells.sum((1, 2))
    return np.divide(cells[:, 0, 0] + cells[:, 1, 1], n, out=np.full(len(n), np.nan), where=n > 0)


def _area(tally: np.ndarray) -> float | None:
    """Area under the curve of one round, None without rows of both labels."""
    q, p = tally[:, :BINS]
    return float((p * (np.cumsum(q) - q / 2)).sum() / (p.sum() * q.sum())) if p.sum() and q.sum() else None


METRICS = ("accuracy", "f1", "precision", "recall", "sensitivity", "specificity", "auc")


def bootstrap(df: DataFrame, base: Classifier, key: str, rounds: int = 1000, test_size: float = 0.2, together: bool = True) -> DataFrame:
    """Metric means, population deviations and 95 % percentile intervals over the out-of-bag rows of stratified draws.

    Logistic models of two classes are fitted for all rounds ``together``, others
    one by one. ``f1``, ``precision`` and ``recall`` are weighted by support;
    ``sensitivity`` and ``specificity`` need the labels 0 and 1 and are NULL
    otherwise; ``auc`` is the average over classes where there are more than
    two, and that of ``BINS`` bins of the scores for models fitted together. Rounds without
    rows of both labels have no area.
    """
    g, sizes = _blocked(df, key, base.label, base.features)
    draws, p = Draws(sizes, rounds, test_size), len(base.features)
    by: dict[int, dict] = {}
    area: dict[int, float | None] = {}
    if together and base.kind == "logistic" and draws.labels == [0.0, 1.0]:
        for i, t in enumerate(_tally(g, draws, *_logistic_rounds(g, draws, p, base.params.get("C", 1.0), base.params.get("max_iter", 1000)))):
            by[i] = {(float(y), float(k)): int(t[y, BINS + k]) for y in (0, 1) for k in (0, 1) if t[y, BINS + k]}
            area[i] = _area(t)
    else:
        names, cells, areas = base.features, None, None
        for i in range(rounds):
            def rows(batches, i=i):
                for y, b, x in _per_block(batches):
                    t = draws.times(y, b, range(i, i + 1))[:, 0].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), y)), pa.array(t), *[pa.array(x[:, q]) for q in range(p)]], names=["_y", "times", *names])

            d = g.mapInArrow(rows, "_y double, times int, " + ", ".join(f"`{c}` double" for c in names))
            train = d.filter("times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "times"))).drop("_copy", "times")
            pred = Classifier(base.kind, names, "_y", base.params).fit(train).predict(d.filter("times = 0"))
            one = confusion(pred, "_y").select(F.lit(i).alias("round"), "_y", "prediction", "n")
            cells = one if cells is None else cells.unionByName(one)
            if "scores" in pred.columns:
                one = (auc(pred, "_y") if draws.labels == [0.0, 1.0] else auc_macro(pred, "_y")).select(F.lit(i).alias("round"), "auc")
                areas = one if areas is None else areas.unionByName(one)
        for r in cells.collect():  # counts of rounds and classes
            by.setdefault(r["round"], {})[r["_y"], r["prediction"]] = r["n"]
        area = {r["round"]: r["auc"] for r in areas.collect()} if areas is not None else {}  # one row a round
    two = draws.labels == [0.0, 1.0]
    out = [(*_weighted(c), *(_sides(c) if two else (None, None)), area.get(i)) for i, c in sorted(by.items()) if c]
    return bootstrap_summary(df.sparkSession.createDataFrame(out, ", ".join(f"{m} double" for m in METRICS)), list(METRICS))


def _sides(cells: dict[tuple[float, float], int]) -> tuple[float | None, float | None]:
    """Sensitivity and specificity of one table of counts of the labels 0 and 1."""
    n = {y: sum(v for (t, _), v in cells.items() if t == y) for y in (1.0, 0.0)}
    return tuple(cells.get((y, y), 0) / n[y] if n[y] else None for y in (1.0, 0.0))


def _weighted(cells: dict[tuple[float, float], int]) -> tuple[float, float, float, float]:
    """Accuracy and support-weighted F1, precision and recall of one table of counts."""
    n, f1, pr, rc = sum(cells.values()), 0.0, 0.0, 0.0
    for c in {y for y, _ in cells}:
        hit, support, predicted = cells.get((c, c), 0), sum(v for (y, _), v in cells.items() if y == c), sum(v for (_, k), v in cells.items() if k == c)
        f1, pr, rc = f1 + support * 2 * hit / (support + predicted), pr + (support * hit / predicted if predicted else 0.0), rc + hit
    return rc / n, f1 / n, pr / n, rc / n


def bootstrap_summary(rounds: DataFrame, metrics: list[str]) -> DataFrame:
    long = rounds.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], metrics, "metric", "value")
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.percentile("value", F.lit(0.025)).alias("ci_lower_95"), F.percentile("value", F.lit(0.975)).alias("ci_upper_95"))


def ablation(df: DataFrame, base: Classifier, subsets: dict[str, list[str]], key: str, folds: int = 3) -> DataFrame:
    """Cross-validated accuracy of each named feature subset: one row each."""
    rows = []
    for name, features in subsets.items():
        _, r = grid_search(df, Classifier(base.kind, features, base.label, base.params), [{}], key, folds)
        m = r.first()
        rows.append((name, len(features), m["mean_score"], m["std_score"]))
    return df.sparkSession.createDataFrame(rows, "experiment string, dimension int, accuracy double, accuracy_std double")


def experiments(df: DataFrame, base: Classifier, significant: list[str], grid: list[dict], key: str, folds: int = 5, rounds: int = 1000) -> tuple[DataFrame, dict[str, Classifier]]:
    """All features, the significant ones, and these without one each: tuned, evaluated by bootstrap, refitted on all rows.

    One row for each subset, with the means of the bootstrap rounds, and the
    refitted models by name. There are at most as many folds as the rarest
    label has rows, and at least 2. Subsets without features are left out.
    """
    subsets = {"All Features": list(base.features), "Significant Features": list(significant)}
    if len(significant) > 1:
        subsets |= {f"LOO: -{f}": [x for x in significant if x != f] for f in significant}
    rarest = df.filter(F.col(base.label).isNotNull()).groupBy(base.label).count().agg(F.min("count")).first()[0]
    if rarest is None:
        raise ValueError("no labelled rows")
    rows, models = [], {}
    for name, features in subsets.items():
        if not features:
            continue
        best, _ = grid_search(df, Classifier(base.kind, features, base.label, base.params), grid, key, max(2, min(folds, rarest)))
        m = {r["metric"]: r["mean"] for r in bootstrap(df, best, key, rounds).collect()}
        rows.append((name, len(features), str(sorted(best.params.items())), m["accuracy"], m["sensitivity"], m["specificity"], m["auc"], ", ".join(features)))
        models[name] = best
    return df.sparkSession.createDataFrame(rows, "experiment string, dimension int, hyperparameters string, accuracy double, sensitivity double, specificity double, auc double, features_used string"), models


def elimination_cv(df: DataFrame, features: list[str], label: str, key: str, keep: int = 1, step: int = 1, folds: int = 5, c: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """How many features serve best out of sample, by elimination within every fold: ``feature, rank, selected`` and ``n_features, mean_score, std_score``.

    The ``step`` features with the smallest standardised coefficients leave each
    time; those of all rows set the ranks, those of each fold its scores. Equal
    scores go to fewer features, equal coefficients leave in order of name. Labels
    are 0 and 1; missing values count as 0. All folds are fitted together.
    """
    g, sizes = _blocked(df, key, label, features)
    if sorted(sizes) != [0.0, 1.0]:
        raise ValueError("labels must be 0 and 1")
    p, plan = len(features), Folds(sizes, folds, whole=True)
    active = np.ones((plan.rounds, p), bool)
    sd = np.array([r or 0.0 for r in df.filter(F.col(label).isNotNull()).agg(*[F.stddev_samp(F.coalesce(F.col(f).cast("double"), F.lit(0.0))) for f in features]).first()])
    by_name = np.argsort(np.argsort(features))
    left, scores = p, []
    gone = np.zeros(p, int)  # the number of features at which one of them leaves the fit of all rows
    while True:
        coef, centre, spread = _logistic_rounds(g, plan, p, c, 1000, active)
        acc = _accuracy(_tally(g, plan, coef, centre, spread))[:folds]
        scores.append((left, float(np.nanmean(acc)), float(np.nanstd(acc))))
        if left <= max(keep, 1):
            break
        drop = min(step, left - max(keep, 1))
        for r in range(plan.rounds):
            order = [i for i in np.lexsort((by_name, np.abs(coef[r, 1:]) * sd)) if active[r, i]][:drop]
            active[r, order] = False
            if r == folds:
                gone[order] = left
        left -= drop
    best = max(scores, key=lambda s: (s[1], -s[0]))[0]
    stays = sorted({int(x) for x in gone if x})
    rank = {0: 1} | {x: i + 2 for i, x in enumerate(stays)}
    spark = df.sparkSession
    rows = [(f, rank[int(gone[i])], bool(gone[i] == 0 or gone[i] <= best)) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "feature string, rank int, selected boolean"), spark.createDataFrame(scores, "n_features int, mean_score double, std_score double")


# --- nearest neighbours ---------------------------------------------------------------------


def nearest(base: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = 2048) -> DataFrame:
    """Exact k nearest rows of each query: ``query_id, neighbor_id, label, distance, rank``.

    A stated query set meets all rows in blocks: each pair of blocks is one
    matrix product that leaves k candidates a query, and candidates are merged
    per query. A row is no neighbour of itself; ties go to the smaller id, however
    many rows of a block are equally near.
    """
    def blocked(df: DataFrame, name: str, cols: list[str]) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // block))
        return df.groupBy(F.pmod(F.xxhash64(id), F.lit(n)).cast("int").alias(name)).agg(F.collect_list(F.struct(*cols)).alias(f"{name}_rows")), n

    b, parts = blocked(base.select(id, label, F.col(vector).cast("array<double>").alias(vector)), "b", [id, label, vector])
    q, _ = blocked(queries.select(id, F.col(vector).cast("array<double>").alias(vector)), "q", [id, vector])
    q = q.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))  # each block of queries goes to every block of rows
    schema = pa.schema([("query_id", pa.int64()), ("neighbor_id", pa.int64()), ("label", pa.int64()), ("distance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qs, bs = (batch.column(c)[i].values for c in (0, 1))
                qi, bi = qs.field(0).to_numpy(), bs.field(0).to_numpy()
                qv, bv = (np.stack(v.to_numpy(zero_copy_only=False)) for v in (qs.field(1), bs.field(2)))
                lab = bs.field(1).to_numpy(zero_copy_only=False)
                near = (qv**2).sum(1)[:, None] + (bv**2).sum(1)[None] - 2 * qv @ bv.T
                near[qi[:, None] == bi[None]] = np.inf
                at = min(k, len(bi)) - 1
                slack = 8 * (qv.shape[1] + 2) * np.finfo(float).eps * ((qv**2).sum(1) + (bv**2).sum(1).max())  # twice what rounding may shift a distance
                far = near > (np.partition(near, at, axis=1)[:, at] + slack)[:, None]
                for r in range(len(qi)):
                    c = np.flatnonzero(~far[r])  # all that may be among the k nearest, copies included
                    d = np.sqrt(((bv[c] - qv[r]) ** 2).sum(1))  # exact for the few that count
                    o = [j for j in np.lexsort((bi[c], d)) if bi[c][j] != qi[r]][:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(o), qi[r])), pa.array(bi[c][o]), pa.array(lab[c][o].astype(np.int64)), pa.array(d[o])], schema=schema)

    pairs = q.join(b, "b").select("q_rows", "b_rows")
    cand = pairs.mapInArrow(run, "query_id bigint, neighbor_id bigint, label bigint, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")  # k for each block
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def vote(neighbors: DataFrame, weights: str = "uniform") -> DataFrame:
    """Predicted label of each query; ties go to the smaller label."""
    w = F.lit(1.0) if weights == "uniform" else 1 / F.greatest("distance", F.lit(1e-12))
    v = neighbors.groupBy("query_id", "label").agg(F.sum(w).alias("v"))
    return v.groupBy("query_id").agg(F.max_by("label", F.struct("v", (-F.col("label")).alias("l"))).alias("prediction"))
