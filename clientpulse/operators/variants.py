"""Models of many feature subsets of one pair of snapshots, from shared work.

Missing values are imputed and features assembled once for the pair. A variant is a
slice of the assembled vector: its fit reads the kept vectors, fits run side by side as
their jobs are short, and one pass over the validation rows scores all of them into one
long table (variant, client, label, score). Its metrics come from one score index with
the variants as groups. Each variant's model is that of a fit on its own."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import Imputer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientpulse.config import MAX_ITER
from clientpulse.operators.metrics import ranking_metrics
from clientpulse.operators.model import WEIGHT, as_doubles, with_class_weight
from clientpulse.operators.score_index import build_index

#: Fits that run at the same time.
PARALLEL_FITS = 4
FEATURES = "features"


@dataclass(frozen=True)
class Vectors:
    """Assembled train and validation rows of one order of columns."""

    columns: tuple[str, ...]
    train: DataFrame  # label, weight, features
    validation: DataFrame  # client_id, label, features and what was asked to be kept

    def positions(self, columns: Sequence[str]) -> list[int]:
        at = {c: i for i, c in enumerate(self.columns)}
        return [at[c] for c in columns]


@contextmanager
def vectors(
    train: DataFrame, validation: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), weighted: bool = True
) -> Iterator[Vectors]:
    """Impute and assemble ``columns`` of both frames once; the vectors stay on executor
    storage, and lost blocks are rebuilt."""
    names = [f"{c}__imputed" for c in columns]
    prepared = as_doubles(with_class_weight(train) if weighted else train.withColumn(WEIGHT, F.lit(1.0)), columns)
    imputer = Imputer(inputCols=list(columns), outputCols=names, strategy="median").fit(prepared)
    assembler = VectorAssembler(inputCols=names, outputCol=FEATURES)
    fitted = assembler.transform(imputer.transform(prepared)).select("label", WEIGHT, FEATURES)
    # kept columns stay under their own type; the model sees double copies
    inputs = validation.select("client_id", F.struct("label", *keep).alias("__kept"), *columns)
    assembled = assembler.transform(imputer.transform(as_doubles(inputs, columns)))
    judged = assembled.select("client_id", *(F.col(f"__kept.{c}").alias(c) for c in ("label", *keep)), FEATURES)
    frames = [df.persist(StorageLevel.MEMORY_AND_DISK) for df in (fitted, judged)]
    try:
        yield Vectors(tuple(columns), *frames)
    finally:
        for df in frames:
            df.unpersist()


def slicer(of: Vectors, columns: Sequence[str], output: str) -> VectorSlicer:
    return VectorSlicer(inputCol=FEATURES, outputCol=output, indices=of.positions(columns))


def fit_variants(
    of: Vectors, variants: Mapping[str, Sequence[str]], max_iter: int = MAX_ITER, parallel: int = PARALLEL_FITS
) -> dict[str, LogisticRegressionModel]:
    """A model for each named list of columns."""

    def fit_one(columns: Sequence[str]) -> LogisticRegressionModel:
        rows = slicer(of, columns, "slice").transform(of.train).select("label", WEIGHT, "slice")
        return LogisticRegression(
            featuresCol="slice", labelCol="label", weightCol=WEIGHT, maxIter=max_iter, standardization=True
        ).fit(rows)

    spark = of.train.sparkSession
    of.train.count()  # the vectors are computed once, not by each of the first fits
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        runs = {name: pool.submit(inheritable_thread_target(spark)(fit_one), columns) for name, columns in variants.items()}
        return {name: run.result() for name, run in runs.items()}


def score_side_by_side(
    of: Vectors, variants: Mapping[str, Sequence[str]], models: Mapping[str, LogisticRegressionModel], keep: Sequence[str] = ()
) -> DataFrame:
    """client_id, label, the columns kept, and a score column for each variant."""
    rows, scores = of.validation, []
    for i, (name, columns) in enumerate(variants.items()):
        sliced, probability = f"__slice_{i}", f"__probability_{i}"
        model = models[name].copy()
        model.setFeaturesCol(sliced).setProbabilityCol(probability).setRawPredictionCol("").setPredictionCol("")
        rows = model.transform(slicer(of, columns, sliced).transform(rows))
        scores.append(vector_to_array(probability)[1].alias(name))
    return rows.select("client_id", "label", *keep, *scores)


def score_variants(
    of: Vectors, variants: Mapping[str, Sequence[str]], models: Mapping[str, LogisticRegressionModel]
) -> DataFrame:
    """(variant, client_id, label, prediction_score) of all variants in one pass."""
    pairs = F.array(*(F.struct(F.lit(n).alias("variant"), F.col(f"`{n}`").alias("prediction_score")) for n in variants))
    return score_side_by_side(of, variants, models).select("client_id", "label", F.inline(pairs))


def evaluate_each(long: DataFrame) -> dict[str, dict[str, Any]]:
    """Rows, classes, exact AUCs and top-K metrics of each variant of a long score table."""
    found = ranking_metrics(build_index(long, by=["variant"])).collect()
    return {r.variant: {k: v for k, v in r.asDict().items() if k != "variant"} for r in found}


def run_variants(
    train: DataFrame, validation: DataFrame, variants: Mapping[str, Sequence[str]], max_iter: int = MAX_ITER
) -> dict[str, dict[str, Any]]:
    """Fit and judge every variant; equal lists of columns share one fit."""
    columns = list(dict.fromkeys(c for listed in variants.values() for c in listed))
    distinct: dict[tuple[str, ...], str] = {}
    for name, listed in variants.items():
        distinct.setdefault(tuple(listed), name)
    named = {name: listed for listed, name in distinct.items()}
    with vectors(train, validation, columns) as of:
        models = fit_variants(of, named, max_iter)
        scored = score_variants(of, named, models).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            found = evaluate_each(scored)
        finally:
            scored.unpersist()
    return {name: found[distinct[tuple(listed)]] for name, listed in variants.items()}
