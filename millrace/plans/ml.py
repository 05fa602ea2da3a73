"""Model planning and leak-free training with pyspark.ml."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, Imputer, Normalizer, OneHotEncoder, RegexTokenizer, SQLTransformer, StandardScaler, StopWordsRemover, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.dates import classify_date, date_features
from millrace.functions.text import text
from millrace.operators.missing import is_numeric, is_temporal, is_text
from millrace.operators.profile import distinct_counts
from millrace.operators.rows import null_counts
from millrace.operators.types import text_evidence
from millrace.plans import boosting
from millrace.stable import shared_folder, written

# Names of likely targets.
TARGETS = ["target", "label", "price", "churn", "salary", "revenue", "class", "outcome", "survived", "status", "score"]
REFERENCE_DAY = "2025-01-01"
#: Fits that run at a time: each is many small jobs, one after another, whose plans the driver holds.
AT_A_TIME = 3
#: Rows to a partition while models are fitted: each fit runs many jobs over them, each with a task for a partition.
ROWS_A_PART = 20_000


def task_type(df: DataFrame, target: str) -> str:
    n = df.filter(F.col(target).isNotNull()).count()
    unique = distinct_counts(df.select(target))[target]
    if unique == 2:
        return "binary_classification"
    if not is_numeric(df, target) or (unique <= 15 and unique / max(n, 1) < 0.05):
        return "multiclass_classification"
    return "regression"


#: Classes of a target that are reported with their counts; `unique` tells how many there are.
CLASSES = 1_000


def target_quality(df: DataFrame, target: str) -> dict[str, Any]:
    """Whether a target can be learned: it exists, has ten values or more and some variation."""
    if target not in df.columns:
        return {"valid": False, "reason": f"no such column: {target}"}
    x = F.col(target)
    n, k, unique = df.agg(F.count(F.lit(1)), F.count(x), F.count_distinct(x)).first()
    spread = df.agg(F.var_samp(target)).first()[0] if is_numeric(df, target) else None
    reason = "fewer than 10 values" if k < 10 else "only one value" if unique <= 1 else "no variance" if spread == 0 else None
    counted = df.filter(x.isNotNull()).groupBy(target).count().orderBy(F.desc("count"), target).limit(CLASSES)
    top = {str(r[0]): r["count"] for r in counted.collect()} if unique <= 20 or not is_numeric(df, target) else {}
    return {"valid": reason is None, "reason": reason, "missing": n - k, "valid_count": k, "unique": unique, "classes": top}


def feature_roles(df: DataFrame, target: str) -> dict[str, Any]:
    """numeric, categorical, datetime and text features; and what is dropped, with why."""
    columns = [c for c in df.columns if c != target]
    n, nulls = null_counts(df)
    unique = distinct_counts(df.select(*columns)) if columns else {}
    evidence = text_evidence(df, [c for c in columns if is_text(df, c)])
    roles: dict[str, Any] = {"numeric": [], "categorical": [], "datetime": [], "text": [], "dropped": {}}
    for c in columns:
        e, known = evidence.get(c), max(n - nulls[c], 1)
        if unique[c] <= 1:
            roles["dropped"][c] = "constant"
        elif is_temporal(df, c) or (e and e["n"] and (e["dates"] + e["ambiguous"]) / e["n"] >= 0.5):
            roles["datetime"].append(c)
        elif is_numeric(df, c) or (e and e["n"] and _plain_numbers(df, c) / e["n"] >= 0.75):
            roles["numeric"].append(c)
        elif n >= 20 and (unique[c] / known > 0.95 or any(k in c.lower() for k in ("id", "uuid", "guid", "index", "key", "code"))):
            roles["dropped"][c] = "identifier"
        elif e and unique[c] > 50 and (e["length"] > 30 or e["words"] > 3):
            roles["text"].append(c)
        else:
            roles["categorical"].append(c)
    return roles


def _plain_numbers(df: DataFrame, c: str) -> int:
    return df.filter(F.regexp_replace(text(c), "[$,%]", "").try_cast("double").isNotNull()).count()


def suggest_targets(df: DataFrame) -> list[str]:
    unique, (n, nulls) = distinct_counts(df), null_counts(df)
    good = [c for c in df.columns if n - nulls[c] >= 10 and unique[c] > 1]
    good = [c for c in good if not (unique[c] / (n - nulls[c]) > 0.95 and n - nulls[c] > 20 and any(k in c.lower() for k in ("id", "uuid", "guid", "key")))]
    return sorted(good, key=lambda c: not any(k in c.lower() for k in TARGETS))


def readiness(df: DataFrame, target: str) -> dict[str, Any]:
    quality, roles = target_quality(df, target), feature_roles(df, target)
    usable = sum(len(roles[k]) for k in ("numeric", "categorical", "datetime", "text"))
    return {"target": target, "task": task_type(df, target) if quality["valid"] else None, "quality": quality, "roles": roles, "ready": quality["valid"] and usable > 0}


@dataclass
class Plan:
    """What to model and how: from a provider if it proposes something usable, else by rule."""

    task: str
    target: str | None
    features: list[str]
    excluded: dict[str, str]
    models: list[str]
    metric: str
    confidence: float
    reasoning: str = ""
    risks: list[str] = field(default_factory=list)


# Parts of names that targets have; the confidence of a plan by rule and of a provider's.
TARGET_NAMES = ["target", "label", "churn", "price", "sales", "salary", "outcome", "status", "class", "default"]
BY_RULE, BY_PROVIDER = 0.80, 0.90


def candidate_target(df: DataFrame) -> str | None:
    """The first column that is named like a target, else the last column."""
    return next((c for c in df.columns if any(x in c.lower() for x in TARGET_NAMES)), df.columns[-1] if df.columns else None)


def fallback_plan(df: DataFrame, target: str | None = None) -> Plan:
    """The plan by rule: features are the other columns that vary; candidates and metric follow the task."""
    target = target or candidate_target(df)
    task = task_type(df, target) if target else "binary_classification"
    unique = distinct_counts(df) if df.columns else {}
    excluded = {c: "the target" if c == target else "has one value at most" for c in df.columns if c == target or unique[c] <= 1}
    models = ["random_forest", "gradient_boosting", "ridge" if task == "regression" else "logistic_regression"]
    return Plan(task, target, [c for c in df.columns if c not in excluded], excluded, models, "r2" if task == "regression" else "accuracy", BY_RULE, f"target {target} by name or place", ["features must be known when the model is used"])


def plan(df: DataFrame, target: str | None = None, propose: Callable[[dict], dict] | None = None) -> Plan:
    """A plan for the table. propose gets the fallback as a dict and returns what it would change; features and targets
    that don't exist are left out, and the fallback stands if it fails or leaves no feature."""
    base = fallback_plan(df, target)
    if propose is None:
        return base
    try:
        said = propose(asdict(base))
        goal = said.get("target") if said.get("target") in df.columns else base.target
        chosen = said.get("features")
        features = base.features if chosen is None else [c for c in chosen if c in df.columns and c != goal]
        if not features:
            return base
        excluded = {str(k): str(v) for k, v in dict(said.get("excluded", base.excluded)).items() if k in df.columns}
        return Plan(str(said.get("task", base.task)), goal, features, excluded, [str(m) for m in said.get("models", base.models)], str(said.get("metric", base.metric)), BY_PROVIDER, str(said.get("reasoning", "")), [str(r) for r in said.get("risks", base.risks)])
    except Exception:  # whatever a provider answers, there is a plan
        return base


#: Slices of the hash in which ranks are counted: no slice of a class has more than a small part of its rows.
SLICE_BITS = 14


def class_ranks(df: DataFrame, key: str, label: str | None, seed: int) -> DataFrame:
    """Add __rank (from 1, in order of a hash of the key) and __total of each row's class, so that reruns agree.

    Classes are cut into slices of the hash: ranks are counted inside of slices, and the rows of the slices before are
    added from a small table, so no class is one task.
    """
    work = df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("__c", F.coalesce(text(label), F.lit("")) if label else F.lit(""))
    work = work.withColumn("__s", F.shiftright("__h", 64 - SLICE_BITS))
    counts = work.groupBy("__c", "__s").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__c").orderBy("__s")
    counts = counts.select("__c", "__s", (F.sum("__n").over(w) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy("__c")).alias("__total"))
    ranked = work.withColumn("__r", F.row_number().over(Window.partitionBy("__c", "__s").orderBy("__h", key))).join(counts, ["__c", "__s"])
    return ranked.withColumn("__rank", F.col("__before") + F.col("__r")).drop("__h", "__c", "__s", "__r", "__before")


def split(df: DataFrame, key: str, label: str | None = None, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add is_test: the first rows of each class in order of a hash of the key."""
    ranked = class_ranks(df, key, label, seed)
    return ranked.withColumn("is_test", F.col("__rank") <= F.ceil(F.lit(share) * F.col("__total"))).drop("__rank", "__total")


def assign_folds(df: DataFrame, key: str, label: str | None = None, folds: int = 5, seed: int = 7, name: str = "fold") -> DataFrame:
    """Add each row's fold, dealt in turns along the hash inside of each class: a class's folds differ by one row at most."""
    return class_ranks(df, key, label, seed).withColumn(name, ((F.col("__rank") - 1) % folds).cast("int")).drop("__rank", "__total")


@dataclass
class Candidate:
    name: str
    baseline: bool
    metrics: dict[str, float] = field(default_factory=dict)
    cross_validation: list[float] = field(default_factory=list)
    seconds: float = 0.0
    error: str | None = None


@dataclass
class Trained:
    task: str
    target: str
    primary: str
    leaderboard: list[Candidate]
    best: str
    model: PipelineModel | None
    importances: list[tuple[str, float]]
    warnings: list[str]
    labels: list[str]


def _numbers(df: DataFrame, roles: dict[str, Any]) -> DataFrame:
    exprs = {c: F.regexp_replace(text(c), "[$,%]", "").try_cast("double") if is_text(df, c) else F.col(c).cast("double") for c in roles["numeric"]}
    exprs |= {c: classify_date(c)["ts"] for c in roles["datetime"] if is_text(df, c)}
    exprs |= {c: text(c) for c in roles["categorical"]} | {c: F.coalesce(text(c), F.lit("")) for c in roles["text"]}
    return df.withColumns(exprs) if exprs else df


class ModeFill(Estimator):
    """Fill missing categories with the most frequent one of the rows it is fitted on, the smallest of equally frequent ones."""

    def __init__(self, columns: list[str]) -> None:
        super().__init__()
        self.columns = columns

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        modes = dataset.agg(*[F.hex(F.encode(F.mode(F.col(f"`{c}`"), deterministic=True), "UTF-8")) for c in self.columns]).first()
        filled = [f"coalesce(`{c}`, decode(unhex('{m or ''}'), 'UTF-8')) AS `__m_{c}`" for c, m in zip(self.columns, modes, strict=True)]
        return SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__")


def prepare(train: DataFrame, roles: dict[str, Any]) -> tuple[list[Estimator], dict[str, F.Column]]:
    """Stages of the preprocessor, all fitted on training rows only, and the date features' expressions."""
    stages: list = []
    numbers, extra = list(roles["numeric"]), {}
    for c in roles["datetime"]:
        last = train.agg(F.max(c)).first()[0]
        reference = F.lit(last) if last else F.lit(REFERENCE_DAY).cast("timestamp")
        for k, e in date_features(c, reference).items():
            extra[f"{c}__{k}"] = e.cast("double")
            numbers.append(f"{c}__{k}")
    parts = []
    if numbers:
        filled = [f"__f_{c}" for c in numbers]
        stages += [Imputer(strategy="median", inputCols=numbers, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__numbers", handleInvalid="keep"), StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=True)]
        parts.append("__scaled")
    if roles["categorical"]:
        stages.append(ModeFill(roles["categorical"]))
    for c in roles["categorical"]:
        stages += [StringIndexer(inputCol=f"__m_{c}", outputCol=f"__i_{c}", handleInvalid="keep"), OneHotEncoder(inputCols=[f"__i_{c}"], outputCols=[f"__o_{c}"], handleInvalid="keep")]
        parts.append(f"__o_{c}")
    for c in roles["text"]:
        stages += [RegexTokenizer(inputCol=c, outputCol=f"__t_{c}", pattern=r"\W+"), StopWordsRemover(inputCol=f"__t_{c}", outputCol=f"__s_{c}"), CountVectorizer(inputCol=f"__s_{c}", outputCol=f"__v_{c}", vocabSize=30), IDF(inputCol=f"__v_{c}", outputCol=f"__d_{c}"), Normalizer(inputCol=f"__d_{c}", outputCol=f"__n_{c}")]
        parts.append(f"__n_{c}")
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep")], extra


def candidates(task: str, trees: int = 100, weighted: bool = False) -> dict[str, Estimator]:
    w = {"weightCol": "__weight"} if weighted else {}
    if task == "regression":
        return {"ridge": LinearRegression(regParam=1.0, elasticNetParam=0.0), "random_forest": RandomForestRegressor(numTrees=trees, seed=42), "gradient_boosting": GBTRegressor(maxIter=trees, seed=42), "histogram_boosting": GBTRegressor(maxIter=trees, maxBins=255, seed=42), "decision_tree": DecisionTreeRegressor(seed=42)}
    boost = lambda bins: GBTClassifier(maxIter=trees, maxBins=bins, seed=42) if task.startswith("binary") else OneVsRest(classifier=GBTClassifier(maxIter=trees, maxBins=bins, seed=42))
    return {"logistic_regression": LogisticRegression(maxIter=1000, **w), "random_forest": RandomForestClassifier(numTrees=trees, seed=42, **w), "gradient_boosting": boost(32), "histogram_boosting": boost(255), "decision_tree": DecisionTreeClassifier(seed=42, **w)}


def evaluate(scored: DataFrame, task: str, only: str | None = None) -> dict[str, float]:
    """All metrics, or one alone (r2 or accuracy). Classes' metrics read the predictions anew for each, numbers' read them once."""
    if task == "regression":
        y, off = F.col("label"), F.col("label") - F.col("prediction")
        n, spread, squares, absolute = scored.agg(F.count(y), F.var_pop(y), F.avg(off * off), F.avg(F.abs(off))).first()
        if not n:
            raise ValueError("no rows to measure on")
        out = {"r2": 1 - squares / spread if spread else math.nan, "rmse": math.sqrt(squares), "mae": absolute}
        return {only: out[only]} if only else out
    if only:
        return {only: MulticlassClassificationEvaluator(metricName=only).evaluate(scored)}
    of = lambda m, **kw: MulticlassClassificationEvaluator(metricName=m, **kw).evaluate(scored)
    present = [r[0] for r in scored.select("label").distinct().collect()]  # one number a class
    out = {"accuracy": of("accuracy"), "f1": of("f1"), "precision": of("weightedPrecision"), "recall": of("weightedRecall"), "balanced_accuracy": sum(of("recallByLabel", metricLabel=x) for x in present) / max(len(present), 1)}
    if task.startswith("binary") and "rawPrediction" in scored.columns:
        out["roc_auc"] = BinaryClassificationEvaluator().evaluate(scored)
    elif len(present) > 1 and "rawPrediction" in scored.columns:  # each class against the rest, weighted by its rows
        values = vector_to_array("probability" if "probability" in scored.columns else "rawPrediction")
        size = {r["label"]: r["count"] for r in scored.groupBy("label").count().collect()}
        against = lambda x: scored.select(values[int(x)].alias("rawPrediction"), (F.col("label") == x).cast("double").alias("label"))
        out["roc_auc"] = sum(n * BinaryClassificationEvaluator(numBins=0).evaluate(against(x)) for x, n in size.items()) / sum(size.values())
    return out


def importances(model: PipelineModel, scored: DataFrame, most: int = 30) -> list[tuple[str, float]]:
    """Tree importances or mean absolute coefficients, by cleaned feature name."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else last.coefficients.toArray() if hasattr(last, "coefficients") and getattr(last, "numClasses", 2) == 2 else abs(last.coefficientMatrix.toArray()).mean(axis=0) if hasattr(last, "coefficientMatrix") else []
    meta = scored.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a.get("name", f"f{a['idx']}") for group in meta.values() for a in group}
    numbers = [c for st in model.stages if isinstance(st, VectorAssembler) and st.getOutputCol() == "__numbers" for c in st.getInputCols()]
    names |= {i: numbers[int(n.removeprefix("__scaled_"))] for i, n in names.items() if n.startswith("__scaled_")}  # the scaler drops names
    clean = lambda n: n.removeprefix("__").removeprefix("f_").removeprefix("o_").removeprefix("n_")
    out = [(clean(names.get(i, f"feature_{i}")), abs(float(v))) for i, v in enumerate(values)]
    return sorted(out, key=lambda x: -x[1])[:most]


def train(df: DataFrame, target: str, key: str, trees: int = 100, folds: int = 5, only: list[str] | None = None) -> Trained:
    """Prepare, split, fit all candidates, compare on the held-out rows. Everything is fitted on training rows only."""
    quality = target_quality(df, target)
    if not quality["valid"]:
        raise ValueError(quality["reason"])
    df = df.filter(F.col(target).isNotNull())
    task, roles = task_type(df, target), feature_roles(df.drop(key) if key != target else df, target)
    _collect_garbage(df)
    work, warnings, labels = _numbers(df, roles), [], []
    if task == "regression":
        work = work.withColumn("label", F.col(target).cast("double"))
    else:
        indexer = StringIndexer(inputCol="__label", outputCol="label", stringOrderType="alphabetAsc").fit(work.withColumn("__label", text(target)))
        work, labels = indexer.transform(work.withColumn("__label", text(target))), list(indexer.labels)
    stratified = weighted = False
    if task != "regression":
        sizes = work.groupBy("label").agg(F.count(F.lit(1)).alias("__n"))
        least, most, total, classes = sizes.agg(F.min("__n"), F.max("__n"), F.sum("__n"), F.count(F.lit(1))).first()
        stratified, weighted = least >= 2, most > 4 * least
    if weighted:
        warnings.append("classes are imbalanced: rows are weighted")
        work = work.join(sizes.select("label", (F.lit(total / classes) / F.col("__n")).alias("__weight")), "label")
    parted = split(work, key, "label" if stratified else None)
    stages, extra = prepare(parted.filter("not is_test"), roles)
    parted = parted.withColumns(extra) if extra else parted
    # Folds are dealt once, by class if the split is, and shared by all candidates.
    learning = parted.filter("not is_test")
    learning = assign_folds(learning, key, "label" if stratified else None, folds, name="__fold") if folds > 1 else learning
    # Both sides are written: the hundred and more plans of the fits would each hold the ranking of rows.
    shared_folder(df.sparkSession)
    with written(learning) as learning, written(parted.filter("is_test")) as tested:
        # Partitions follow the rows, not the shuffle's setting. Classifiers' boosting checkpoints where there is a folder for it.
        packed = lambda x: x.repartition(max(1, math.ceil(quality["valid_count"] / ROWS_A_PART)), key).persist()
        fit_rows, test_rows = packed(learning), packed(tested)
        primary = "r2" if task == "regression" else "f1" if weighted else "accuracy" if task.startswith("binary") else "balanced_accuracy"
        board, models = [], {}
        if task == "regression":
            mean = fit_rows.agg(F.avg("label")).first()[0]
            board.append(Candidate("baseline", True, evaluate(test_rows.withColumn("prediction", F.lit(float(mean))), task)))
        else:
            top = fit_rows.groupBy("label").count().orderBy(F.desc("count"), "label").first()[0]
            board.append(Candidate("baseline", True, evaluate(test_rows.withColumn("prediction", F.lit(float(top))), task)))
        # A preprocessor for the learning rows (-1) and one without each fold, which all candidates share.
        parts = range(-1, folds if folds > 1 else 0)
        without = lambda k: fit_rows if k < 0 else fit_rows.filter(F.col("__fold") != k)
        prepared = _together(df, {k: (lambda k=k: Pipeline(stages=[x.copy() for x in stages]).fit(without(k))) for k in parts})
        if isinstance(prepared[-1], Exception):
            raise prepared[-1]
        ready, ready_tests = prepared[-1].transform(fit_rows), prepared[-1].transform(test_rows)
        chosen = {k: e for k, e in candidates(task, trees, weighted).items() if not only or k in only}
        boosted = {k: e for k, e in chosen.items() if isinstance(e, GBTRegressor)}

        def fit(name: str) -> tuple[Any, Candidate]:
            began = time.monotonic()
            model = chosen[name].copy().fit(ready)
            return model, Candidate(name, False, evaluate(model.transform(ready_tests), task), seconds=round(time.monotonic() - began, 3))

        def fold(name: str, k: int) -> float:
            if isinstance(prepared[k], Exception):
                raise prepared[k]
            return cross_validate(fit_rows, prepared[k].stages, chosen[name], task, k)

        def boost() -> dict[str, tuple[Any, Candidate]]:
            """All boosting, of all folds, at once: the seconds are those of all."""
            began = time.monotonic()
            if error := next((x for x in prepared.values() if isinstance(x, Exception)), None):
                raise error
            order = F.xxhash64(key).alias("key")
            tables = {k: prepared[k].transform(fit_rows).select("features", "label", (F.col("__fold") == k if k >= 0 else F.lit(False)).alias("held"), order) for k in parts}
            tables[-1] = tables[-1].union(ready_tests.select("features", "label", F.lit(True).alias("held"), order))
            rows = {k: quality["valid_count"] * (0.8 if k >= 0 else 1) for k in parts}
            fits = boosting.boost(tables, boosted, rows)
            spent = round(time.monotonic() - began, 3)
            return {n: (fits[n, -1], Candidate(n, False, fits[n, -1].metrics, [fits[n, k].metrics["r2"] for k in parts if k >= 0], spent)) for n in boosted}

        tasks: dict[Any, Callable] = {"boosted": boost} if boosted else {}
        tasks |= {(name, k): (lambda name=name, k=k: fit(name) if k < 0 else fold(name, k)) for name in chosen if name not in boosted for k in parts}
        done = _together(df, tasks)
        for name in chosen:
            if name in boosted:
                got = [done["boosted"]] if isinstance(done["boosted"], Exception) else [done["boosted"][name]]
            else:
                got = [done[name, k] for k in parts]
            error = next((x for x in got if isinstance(x, Exception)), None)
            if error:
                board.append(Candidate(name, False, {}, error=str(error)[:200]))
            else:
                models[name], c = got[0]
                c.cross_validation += got[1:]
                board.append(c)
        value = lambda c: c.metrics.get(primary, -math.inf)
        board.sort(key=lambda c: (c.baseline, -value(c)))
        best = board[0]
        if value(best) <= value(next(c for c in board if c.baseline)) + 0.02:
            warnings.append("weak signal: hardly better than the baseline")
        model = models.get(best.name)
        model = boosting.spark_model(model) if isinstance(model, boosting.Fit) else model
        boosting.forget(x for x in models.values() if isinstance(x, boosting.Fit))
        full = PipelineModel([*prepared[-1].stages, model]) if model else None
        scored = full.transform(test_rows) if full else test_rows
        out = Trained(task, target, primary, board, best.name, full, importances(full, scored) if full else [], warnings, labels)
        fit_rows.unpersist()
        test_rows.unpersist()
        return out


def _collect_garbage(df: DataFrame) -> None:
    """Broadcasts and shuffle files of ended fits go when the driver's JVM collects its garbage."""
    df.sparkSession._jvm.System.gc()


def _together(df: DataFrame, tasks: dict[Any, Callable]) -> dict[Any, Any]:
    """Each task's result or exception, some at a time."""

    def run(f: Callable) -> Any:
        try:
            return f()
        except Exception as e:
            return e
        finally:
            _collect_garbage(df)

    with ThreadPool(AT_A_TIME) as pool:
        return dict(zip(tasks, pool.map(inheritable_thread_target(df.sparkSession)(run), tasks.values(), chunksize=1), strict=True))


def cross_validate(placed: DataFrame, stages: list, estimator: Estimator, task: str, fold: int) -> float:
    """r2 or accuracy on a fold (column __fold), the preprocessor being fitted without it, here or before."""
    model = Pipeline(stages=[x.copy() for x in (*stages, estimator)]).fit(placed.filter(F.col("__fold") != fold))
    metric = "r2" if task == "regression" else "accuracy"
    return evaluate(model.transform(placed.filter(F.col("__fold") == fold)), task, metric)[metric]


def leaderboard(trained: Trained, df: DataFrame) -> DataFrame:
    rows = [(i + 1, c.name, c.baseline, c.metrics.get(trained.primary), trained.primary) for i, c in enumerate(trained.leaderboard)]
    return df.sparkSession.createDataFrame(rows, "rank int, model string, is_baseline boolean, value double, metric string")
