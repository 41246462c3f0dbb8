"""Training, choosing and versioning the recommendation model with Spark ML.

Rows never leave the executors: class counts, medians and metrics are small
aggregates, fitting and scoring are distributed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, OneVsRestModel, RandomForestClassifier
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.columns import ref
from ledgerloom.functions.encoding import one_hot
from ledgerloom.operators import profile
from ledgerloom.operators.ranking import resolve_version, stratified_split
from ledgerloom.operators.sizes import settle
from ledgerloom.schemas import FEATURES, LABEL_CLASSES
from ledgerloom.session import shared_dir
from ledgerloom.sinks import tables
from ledgerloom.sources.queries import scan

RUNS_DDL = "run_name string, algorithm string, macro_f1 double, n_train bigint, n_test bigint, params string, logged_at timestamp"


@dataclass(frozen=True)
class Spec:
    """Training parameters (fixed values of the two contestants)."""

    classes: Sequence[str] = LABEL_CLASSES
    features: Sequence[str] = FEATURES
    key: str = "party_id"
    label: str = "next_best_product"
    seed: int = 42
    test_share: float = 0.2
    trees: int = 200
    tree_depth: int = 20
    boost_rounds: int = 300
    boost_depth: int = 6
    boost_step: float = 0.05
    boost_sample: float = 0.8
    early_stop_tol: float = 0.01


@dataclass
class Run:
    name: str
    algorithm: str
    model: PipelineModel
    metrics: DataFrame
    macro_f1: float
    params: dict = field(default_factory=dict)
    n_train: int = 0
    n_test: int = 0


def top_up(rows: DataFrame, spec: Spec) -> DataFrame:
    """Add two median rows for every class that has none, so that each class can be split."""
    absent = (
        rows.sparkSession.range(1)
        .select(F.explode(F.array(*[F.lit(c) for c in spec.classes])).alias("_class"))
        .join(rows.select(ref(spec.label).alias("_class")).distinct(), "_class", "left_anti")
    )
    names = {c: f"m{i}" for i, c in enumerate(spec.features)}
    middle = profile.medians(rows, list(spec.features)).groupBy(F.lit(1).alias("_one")).agg(
        *[F.max(F.when(F.col("column_name") == c, F.col("median"))).alias(n) for c, n in names.items()]
    )
    twice = absent.select(F.lit(1).alias("_one"), "_class", F.explode(F.array(F.lit(0), F.lit(1))).alias("_copy"))
    filler = twice.join(middle, "_one")
    types = dict(rows.dtypes)
    made = {
        spec.key: F.concat(F.lit("filler-"), "_class", F.lit("-"), F.col("_copy").cast("string")).try_cast(types[spec.key]),
        spec.label: F.col("_class"),
        **{c: F.col(n).cast(types[c]) for c, n in names.items()},
    }
    return rows.unionByName(filler.select(*[v.alias(k) for k, v in made.items()]))


def split(rows: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """Stratified train and test rows; the split depends on the key and seed only.

    Runs jobs: the marked rows are written once, for every fit and evaluation.
    """
    shared_dir(rows.sparkSession)
    marked = stratified_split(rows, [spec.key], spec.label, spec.test_share, spec.seed).checkpoint()
    return tuple(marked.where(F.col("split") == part).drop("split") for part in ("train", "test"))  # type: ignore[return-value]


def balanced(train: DataFrame, spec: Spec) -> DataFrame:
    """Weight n / (classes * n_class) per row; the counts have one row per class."""
    counts = train.groupBy(ref(spec.label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    share = counts.agg((F.sum("_n") / F.count("_n")).alias("s")).scalar()
    weights = settle(counts.select("_l", (share / F.col("_n")).alias("weight")))
    return train.join(weights, ref(spec.label) == F.col("_l")).drop("_l")


def _stages(spec: Spec) -> list:
    index = StringIndexerModel.from_labels(list(spec.classes), inputCol=spec.label, outputCol="label", handleInvalid="error")
    return [index, VectorAssembler(inputCols=list(spec.features), outputCol="features")]


def _vectors(rows: DataFrame, spec: Spec) -> DataFrame:
    return rows.select(spec.key, spec.label, *[ref(c).cast("double").alias(c) for c in spec.features], *(["weight"] if "weight" in rows.columns else []))


def fit_forest(train: DataFrame, spec: Spec) -> PipelineModel:
    forest = RandomForestClassifier(
        numTrees=spec.trees, maxDepth=spec.tree_depth, weightCol="weight", seed=spec.seed, labelCol="label", featuresCol="features"
    )
    return Pipeline(stages=[*_stages(spec), forest]).fit(_vectors(balanced(train, spec), spec))


def fit_boosted(train: DataFrame, spec: Spec, early_stop: bool = False) -> PipelineModel:
    """One boosted tree ensemble per class against the rest.

    Spark boosts two classes only, so the class scores are combined by softmax
    and are not calibrated probabilities. With ``early_stop`` a tenth of the
    rows, chosen by key hash, decides when to stop.
    """
    rows, stages = _vectors(train, spec), _stages(spec)
    boost = GBTClassifier(
        maxIter=spec.boost_rounds,
        maxDepth=spec.boost_depth,
        stepSize=spec.boost_step,
        subsamplingRate=spec.boost_sample,
        seed=spec.seed,
        validationTol=spec.early_stop_tol,
    )
    if not early_stop:
        return Pipeline(stages=[*stages, OneVsRest(classifier=boost, labelCol="label", featuresCol="features")]).fit(rows)
    boost = boost.setValidationIndicatorCol("held_out")
    # OneVsRest hands on label and features only, so the held-out mark needs a fit per class here.
    marked = rows.withColumn("held_out", F.pmod(F.xxhash64(ref(spec.key), F.lit(spec.seed)), F.lit(10)) == 0)
    ready = PipelineModel(stages).transform(marked).select("label", "features", "held_out")
    each = [boost.fit(ready.withColumn("label", (F.col("label") == F.lit(i)).cast("double"))) for i in range(len(spec.classes))]
    rest = OneVsRestModel(each)
    rest.set(rest.classifier, boost)
    return PipelineModel([*stages, rest])


def probabilities(scored: DataFrame, size: int) -> Column:
    """Class probabilities of a scored frame, whatever the model kind returns."""
    if "probability" in scored.columns:
        return vector_to_array("probability")
    if "rawPrediction" in scored.columns:
        powers = F.transform(vector_to_array("rawPrediction"), F.exp)
        total = F.aggregate(powers, F.lit(0.0), lambda a, b: a + b)
        return F.transform(powers, lambda x: x / total)
    return one_hot(F.col("prediction"), size)


def evaluate(model: PipelineModel, test: DataFrame, spec: Spec) -> DataFrame:
    """Per-class precision, recall, F1 and support; all classes listed."""
    scored = model.transform(_vectors(test, spec))
    names = F.array(*[F.lit(c) for c in spec.classes])
    guess = F.try_element_at(names, F.col("prediction").cast("int") + F.lit(1))
    matrix = profile.confusion(scored.select(ref(spec.label).alias("_y"), guess.alias("_p")), "_y", "_p")
    return profile.class_metrics(matrix, list(spec.classes))


def train(rows: DataFrame, spec: Spec = Spec(), early_stop: bool = False) -> tuple[Run, list[Run]]:
    """Fit both contestants; the higher macro F1 wins, a tie goes to the boosted model, which may stop early."""
    training, test = split(top_up(rows, spec), spec)
    sizes = {"n_train": training.count(), "n_test": test.count()}
    runs = []
    boosted = partial(fit_boosted, early_stop=early_stop)
    for name, algorithm, fit in (("rf_baseline", "random_forest", fit_forest), ("boosted_challenger", "boosted_one_vs_rest", boosted)):
        model = fit(training, spec)
        metrics = evaluate(model, test, spec)
        score = profile.macro_f1(metrics).first()["macro_f1"]
        runs.append(Run(name, algorithm, model, metrics, score, {"seed": spec.seed, "features": len(spec.features)}, **sizes))
    winner = max(runs, key=lambda r: (r.macro_f1, r.algorithm == "boosted_one_vs_rest"))
    return winner, runs


def importances(model: PipelineModel, spec: Spec) -> list[tuple[str, float]]:
    """Features of a forest by falling importance."""
    values = model.stages[-1].featureImportances
    return sorted(((c, float(values[i])) for i, c in enumerate(spec.features)), key=lambda x: (-x[1], x[0]))


def _places(rows: DataFrame, key: str, seed: int, slices: int) -> DataFrame:
    """The rows with ``_place``, 1 to n in an order by hash: ranks inside a hash slice, after all earlier slices.

    Only the sizes of the slices meet in one task.
    """
    sliced = rows.withColumn("_slice", F.pmod(F.xxhash64(ref(key), F.lit(seed)), F.lit(slices)))
    sizes = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(F.col("_slice").alias("_s"), (F.sum("_n").over(W.orderBy("_slice")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(W.partitionBy("_slice").orderBy(F.xxhash64(ref(key), F.lit(seed)), ref(key)))
    ranked = sliced.withColumn("_rank", rank).join(before, F.col("_slice") == F.col("_s"))
    return ranked.withColumn("_place", F.col("_before") + F.col("_rank")).drop("_slice", "_s", "_rank", "_before")


def shuffled(rows: DataFrame, key: str, column: str, seed: int, slices: int = 4096) -> DataFrame:
    """The frame with one column permuted among all rows; ``slices`` are those of the sort."""
    left = _places(rows, key, seed + 1, slices).drop(column)
    right = _places(rows.select(ref(key), ref(column)), key, seed + 2, slices).select("_place", ref(column))
    return left.join(right, "_place").select(*[ref(c) for c in rows.columns])


def permutation_importance(model: PipelineModel, test: DataFrame, spec: Spec, columns: Sequence[str] | None = None) -> list[tuple[str, float]]:
    """Loss of macro F1 when a feature is permuted; works for any model kind."""
    base = profile.macro_f1(evaluate(model, test, spec)).first()["macro_f1"]
    drops = []
    for c in columns or spec.features:
        score = profile.macro_f1(evaluate(model, shuffled(test, spec.key, c, spec.seed), spec)).first()["macro_f1"]
        drops.append((c, base - score))
    return sorted(drops, key=lambda x: (-x[1], x[0]))


def log_run(spark: SparkSession, run: Run, table: str, n_train: int, n_test: int) -> None:
    row = spark.range(1).select(
        F.lit(run.name).alias("run_name"),
        F.lit(run.algorithm).alias("algorithm"),
        F.lit(float(run.macro_f1)).alias("macro_f1"),
        F.lit(n_train).cast("long").alias("n_train"),
        F.lit(n_test).cast("long").alias("n_test"),
        F.lit(str(run.params)).alias("params"),
        F.current_timestamp().alias("logged_at"),
    )
    tables.create_empty(spark, table, RUNS_DDL)
    tables.append(row, table)


def top_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    return runs.orderBy(F.desc("macro_f1"), "run_name").limit(n)


VERSIONS_DDL = "model string, version int, alias string, path string, registered_at timestamp"


def publish(spark: SparkSession, fitted: PipelineModel, root: str, name: str, version: int, table: str, alias: str | None = None) -> str:
    """Save a fitted model below ``root`` and list it, with an optional alias, in the version table."""
    path = f"{root}/{name}/v{version}"
    fitted.write().overwrite().save(path)
    tables.create_empty(spark, table, VERSIONS_DDL)
    row = spark.range(1).select(
        F.lit(name).alias("model"),
        F.lit(version).alias("version"),
        F.lit(alias).cast("string").alias("alias"),
        F.lit(path).alias("path"),
        F.current_timestamp().alias("registered_at"),
    )
    tables.append(row, table)
    return path


def resolve(spark: SparkSession, table: str, name: str) -> tuple[int, PipelineModel]:
    """The champion, else the dev, else the latest version of a model, loaded."""
    versions = scan(spark, table).where(F.col("model") == name)
    found = resolve_version(versions, "model", "version", "alias").join(versions, ["model", "version"]).select("version", "path").first()
    if found is None:
        raise LookupError(f"no version of model {name!r} in {table}")
    return found["version"], PipelineModel.load(found["path"])
