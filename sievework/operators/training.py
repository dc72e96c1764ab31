"""Heads: grouped-fold ensembles of boosted trees as an Estimator and a Model, trained together, saved, loaded and reported on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as seq
from ..session import kept, spread
from .alignment import identity_clusters
from .learning import grouped_folds
from .scoring import auroc, regression_report
from .similarity import composition_vector


def _param(name: str, doc: str, converter) -> Param:
    return Param(Params._dummy(), name, doc, converter)


class _HeadParams(Params):
    """What the estimator and its model share."""

    featuresCol = _param("featuresCol", "vector of features", TypeConverters.toString)
    labelCol = _param("labelCol", "what is learnt, a double", TypeConverters.toString)
    weightCol = _param("weightCol", "weight of a row", TypeConverters.toString)
    foldCol = _param("foldCol", "fold of a row, from 0", TypeConverters.toString)
    predictionCol = _param("predictionCol", "mean of the folds' predictions, or of their probabilities of 1", TypeConverters.toString)
    classify = _param("classify", "whether labels are 0 and 1", TypeConverters.toBoolean)
    folds = _param("folds", "number of folds", TypeConverters.toInt)
    depth = _param("depth", "depth of a tree", TypeConverters.toInt)
    rounds = _param("rounds", "trees of a fold's model", TypeConverters.toInt)
    rate = _param("rate", "learning rate", TypeConverters.toFloat)
    least = _param("least", "rows that a fold's model needs to learn from", TypeConverters.toInt)
    seed = _param("seed", "seed of the folds' models", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="y", weightCol="weight", foldCol="fold", predictionCol="prediction", classify=False, folds=5, depth=5, rounds=60, rate=0.05, least=64, seed=0)


class HeadEnsemble(Estimator, _HeadParams, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees for each fold, fitted on the rows of all other folds.

    A fold without rows, or with fewer than ``least`` to learn from, has no model.
    """

    def __init__(self, **params) -> None:
        super().__init__()
        self._set(**params)

    def _fit(self, df: DataFrame) -> HeadEnsembleModel:
        get = self.getOrDefault
        fold, models = F.col(get(self.foldCol)), {}
        sizes = {r[0]: r[1] for r in df.groupBy(fold).count().collect()}
        make = GBTClassifier if get(self.classify) else GBTRegressor
        for f in range(get(self.folds)):
            if sizes.get(f, 0) and sum(sizes.values()) - sizes[f] >= get(self.least):
                trees = make(featuresCol=get(self.featuresCol), labelCol=get(self.labelCol), weightCol=get(self.weightCol), maxDepth=get(self.depth), maxIter=get(self.rounds), stepSize=get(self.rate), seed=100 * get(self.seed) + f)
                models[f] = trees.fit(df.where(fold != f))
        return self._copyValues(HeadEnsembleModel(models))


class HeadEnsembleModel(Model, _HeadParams, MLReadable, MLWritable):
    """The folds' models. New rows get the mean of all; rows that were learnt from can get their own fold's, which never saw them."""

    def __init__(self, models: dict[int, Model] | None = None) -> None:
        super().__init__()
        self.models = models or {}

    def _with(self, df: DataFrame, f: int, out: str) -> DataFrame:
        """``df`` with one fold's prediction."""
        model = self.models[f].copy()
        temporary = [f"__{out}_{x}" for x in ("prediction", "raw", "probability")]
        model.setFeaturesCol(self.getOrDefault(self.featuresCol))
        model.setPredictionCol(temporary[0])
        if self.getOrDefault(self.classify):
            model.setRawPredictionCol(temporary[1])
            model.setProbabilityCol(temporary[2])
        found = model.transform(df)
        value = vector_to_array(temporary[2])[1] if self.getOrDefault(self.classify) else F.col(temporary[0])
        return found.withColumn(out, value).drop(*temporary)

    def _transform(self, df: DataFrame) -> DataFrame:
        out, names = df, [f"__fold{f}" for f in sorted(self.models)]
        for f, name in zip(sorted(self.models), names, strict=True):
            out = self._with(out, f, name)
        mean: Column = sum((F.col(n) for n in names), F.lit(0.0)) / len(names) if names else F.lit(None).cast("double")
        return out.withColumn(self.getOrDefault(self.predictionCol), mean).drop(*names)

    def out_of_fold(self, df: DataFrame, out: str = "guess") -> DataFrame:
        """``df`` with each row's prediction by the model that was fitted without its fold; null where there is none."""
        fold = F.col(self.getOrDefault(self.foldCol))
        found = df.where(F.coalesce(~fold.isin(list(self.models)), F.lit(True))).withColumn(out, F.lit(None).cast("double"))
        for f in self.models:
            found = found.unionByName(self._with(df.where(fold == f), f, out))
        return found

    def write(self) -> MLWriter:
        return _EnsembleWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _EnsembleReader()


class _EnsembleWriter(MLWriter):
    def __init__(self, model: HeadEnsembleModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"fitted": sorted(self.model.models)})
        for f, trees in self.model.models.items():
            trees.write().session(self.sparkSession).save(f"{path}/fold-{f}")


class _EnsembleReader(MLReader):
    def load(self, path: str) -> HeadEnsembleModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        kind = GBTClassificationModel if meta["paramMap"].get("classify", False) else GBTRegressionModel
        model = HeadEnsembleModel({f: kind.load(f"{path}/fold-{f}") for f in meta["fitted"]})
        DefaultParamsReader.getAndSetParams(model, meta)
        model._resetUid(meta["uid"])
        return model


@dataclass
class Target:
    """What a head learns: rows (sequence, amidated, y, n); with ``active``, the report also says how well it finds y at most that."""

    rows: DataFrame
    classify: bool = False
    active: float | None = None


def _of_sequence(sequence: str) -> Column:
    """The features that a sequence alone has: the descriptors and the 400 pairs' shares."""
    own = [F.coalesce(c.cast("double"), F.lit(0.0)) for c in seq.descriptors(F.col(sequence)).values()]
    pairs = F.coalesce(F.slice(composition_vector()(F.col(sequence)), 21, 400), F.array_repeat(F.lit(0.0), 400))
    return F.concat(F.array(*own), pairs)


def _flagged(own: Column, amidated: str) -> Column:
    """The vector of a sequence's own features and the amidation flag (unknown counts as none)."""
    flag = F.greatest(F.coalesce(F.col(amidated), F.lit(0)), F.lit(0)).cast("double")
    return array_to_vector(F.concat(own, F.array(flag)))


def with_features(df: DataFrame, sequence: str = "sequence", amidated: str = "amidated", out: str = "features") -> DataFrame:
    """``df`` with the vector of the descriptors, the 400 pairs' shares and the amidation flag (unknown counts as none)."""
    return df.withColumn(out, _flagged(_of_sequence(sequence), amidated))


def train_heads(targets: dict[str, Target], folder: str, *, least: int = 0, identity: float = 0.5, **params) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(report, out-of-fold predictions by head) of all heads, each saved under ``folder``.

    Folds go by clusters of identity over all heads' sequences, so that no sequence alike to a
    held-out one is learnt from. A row weighs ln(1 + n), and its own amidation flag is learnt from. ``params`` go to
    ``HeadEnsemble``. The report has a row for each head: head, n, spearman, rmse, r2 of regressions, and auroc of
    classifiers or of finding the active rows (null with ten or fewer of either kind). A head whose folds have too few rows
    to learn from is reported and saved too, with nulls and without models. Only who asks for ``least`` rows goes without heads of fewer.
    """
    spark = next(iter(targets.values())).rows.sparkSession
    # each head's rows are made once, and so are the sequences: whatever makes them may be a join of all measurements
    learnt, sequences = {name: kept(t.rows.select("sequence", "amidated", "y", "n")) for name, t in targets.items()}, None
    for rows in learnt.values():
        named = rows.select("sequence")
        sequences = named if sequences is None else sequences.union(named)
    sequences = kept(sequences.where("sequence is not null").distinct())
    named = sequences.withColumn("row_id", F.col("sequence"))
    folded = kept(grouped_folds(identity_clusters(named, identity=identity), "cluster", params.get("folds", 5), params.get("seed", 0)).select(F.col("row_id").alias("sequence"), "fold"))
    own = kept(spread(sequences).select("sequence", _of_sequence("sequence").alias("own")))
    report, guesses, saved = None, {}, []
    for name, t in targets.items():
        rows = learnt[name].where("y is not null").join(folded, "sequence").join(own, "sequence").withColumns({"y": F.col("y").cast("double"), "weight": F.log1p(F.col("n").cast("double")), "features": _flagged(F.col("own"), "amidated")}).drop("own")
        # trees choose among equal splits by the last bits of sums, so rows go in an order of their own, however they were joined
        rows = kept(rows.repartition("sequence").sortWithinPartitions("sequence", "amidated", "y", "n"))
        n = rows.count()
        if n < least:
            continue
        model = HeadEnsemble(classify=t.classify, **params).fit(rows)
        model.write().overwrite().save(f"{folder}/{name}")
        saved.append((name,))
        guess = kept(model.out_of_fold(rows).drop("features"))
        guesses[name] = guess
        met = guess.where("guess is not null")
        nothing = F.lit(None).cast("double")
        if t.classify:
            row = auroc(met, "y", "guess").select(nothing.alias("spearman"), nothing.alias("rmse"), nothing.alias("r2"), "auroc")
        else:
            row = regression_report(met, "y", "guess").select("spearman", "rmse", "r2")
            marked = met.select((F.col("y") <= F.lit(t.active)).cast("int").alias("hit"), (-F.col("guess")).alias("score"))
            sure = marked.agg(F.sum("hit").alias("ones"), F.count("*").alias("all")).select(((F.col("ones") > 10) & (F.col("all") - F.col("ones") > 10)).alias("sure"))
            row = row.join(auroc(marked, "hit", "score").join(sure).select(F.when(F.col("sure"), F.col("auroc")).alias("auroc")))
        row = row.select(F.lit(name).alias("head"), F.lit(n).cast("long").alias("n"), "spearman", "rmse", "r2", "auroc")
        report = row if report is None else report.unionByName(row)
    spark.createDataFrame(saved, "head string").write.mode("overwrite").json(f"{folder}/heads")
    return report if report is not None else spark.createDataFrame([], "head string, n bigint, spearman double, rmse double, r2 double, auroc double"), guesses


def load_heads(spark: SparkSession, folder: str) -> dict[str, HeadEnsembleModel]:
    """The heads that ``train_heads`` saved."""
    return {r.head: HeadEnsembleModel.load(f"{folder}/{r.head}") for r in spark.read.schema("head string").json(f"{folder}/heads").collect()}


def score_heads(df: DataFrame, heads: dict[str, HeadEnsembleModel], sequence: str = "sequence", amidated: str = "amidated") -> DataFrame:
    """``df`` with a column for each head: its folds' mean. Row-local, no shuffle; features are computed once."""
    out = with_features(df, sequence, amidated, "__features")
    for name, model in heads.items():
        out = model.copy({model.featuresCol: "__features", model.predictionCol: name}).transform(out)
    return out.drop("__features")
