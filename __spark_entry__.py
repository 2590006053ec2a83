"""Queries over the test tables and the SQL they are checked against.

Every query reads whole tables. Fits run when a query is called; the returned table
is lazy. Doubles are rounded on both sides.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from functools import reduce, wraps
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from strayrow.functions import columns as fc
from strayrow.operators import (
    autoencoder,
    forest,
    frame,
    gaussian,
    kmeans,
    knn,
    lof,
    neighbours,
    pca,
    scale,
    score_sketch,
    stats,
    svm,
    threshold,
)
from strayrow.plans import requests as request_jobs
from strayrow.plans import versions
from strayrow.plans.pipeline import FittedPipeline, Pipeline, load_detector, save_detector
from strayrow.session import cleaned_up, materialize, new_path, ship_package
from strayrow.sources import csv, predictions, split_json
from strayrow.streaming import scoring

# the training-data operators may be absent
try:
    import corpus_pipeline
    from strayrow.llm import queries as llm
except ImportError:
    corpus_pipeline = llm = None

PART = ["p_size", "p_retailprice"]
EVENTS = ["value", "k"]
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CUSTOMER = ["acctbal", "nation"]
WIDTH = 64
EMBEDDING = [f"f{i}" for i in range(WIDTH)]
CELLS = ["a", "b", "c", "d"]
# Lines whose orders are averaged at once where the averages are stored.
SLICE_LINES = 16_000_000


# Tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", *PART)


def with_k(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k")
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_k(table(spark, sf_dir, "events"))


def labelled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.when(F.col("event_type") == "error", 1).otherwise(0)
    return table(spark, sf_dir, "events").select(
        "event_id",
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        y.alias("y"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return frame.spread_array(rows, "embedding", WIDTH)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_acctbal").alias("acctbal"),
        F.col("c_nationkey").alias("nation"),
    )


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_acctbal").alias("acctbal"),
        F.col("s_nationkey").alias("nation"),
    )


def order_averages(spark: SparkSession, sf_dir: str, some: Column | None = None) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return (
        (lines if some is None else lines.where(some))
        .groupBy("l_orderkey")
        .agg(*[F.avg(c).alias(c) for c in LINE])
    )


def stored_order_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The averages, written once: means that are summed up again can differ in the last bit.

    Lines move slice by slice of the orders, so that the shuffle holds a bounded number of them.
    """
    slices = max(1, math.ceil(table(spark, sf_dir, "lineitem").count() / SLICE_LINES))
    place = F.pmod(F.xxhash64("l_orderkey"), F.lit(slices))
    stored = [
        materialize(order_averages(spark, sf_dir, place == i if slices > 1 else None), "order-averages")
        for i in range(slices)
    ]
    return reduce(DataFrame.unionByName, stored)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a request of sixteen rows with four cells; odd ones name them backwards."""
    names = F.array(*[F.lit(c) for c in CELLS])
    cells = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(
        F.to_json(
            F.struct(
                F.col("vec_id").cast("string").alias("id"),
                F.when(F.col("vec_id") % 2 == 0, names).otherwise(F.reverse(names)).alias("columns"),
                F.transform(
                    F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice(cells, i * 4 + 1, 4)
                ).alias("data"),
            )
        ).alias("value")
    )


def faulty_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests with faults planted by ``vec_id``: none, columns, no rows, ragged, too wide."""
    kind = F.col("request_id").cast("long") % 7
    names = F.array(*[F.lit(c) for c in CELLS])
    columns = (
        F.when(kind == 1, F.slice(names, 1, 3))
        .when(kind == 2, F.concat(names, F.array(F.lit("e"))))
        .otherwise(F.col("columns"))
    )
    ragged = F.transform(F.col("data"), lambda row, i: F.slice(row, 1, F.when(i == 3, 2).otherwise(4)))
    wide = F.transform(F.col("data"), lambda row: F.concat(row, F.array(F.lit(0.0))))
    data = (
        F.when(kind == 3, F.slice("data", 1, 0))
        .when(kind == 4, ragged)
        .when(kind == 5, wide)
        .otherwise(F.col("data"))
    )
    return split_json.parse(requests(spark, sf_dir)).select(
        "request_id", columns.alias("columns"), data.alias("data")
    )


def mixed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faulty requests as texts; the seventh kind is no JSON."""
    text = F.to_json(F.struct(F.col("request_id").alias("id"), "columns", "data"))
    broken = F.col("request_id").cast("long") % 7 == 6
    return faulty_requests(spark, sf_dir).select(
        F.when(broken, F.concat(F.lit("request "), "request_id")).otherwise(text).alias("value")
    )


# Shared shapes of results


def shipped(query: Callable[[SparkSession, str], DataFrame]):
    """The query, run after the executors were given the package."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def r(col: Column | str, name: str, places: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, places).alias(name)


def cells(features: list[str]) -> list[Column]:
    return [F.col(f).cast("double") for f in features]


def score_and_flag(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, r("score", "score"), "flag")


def distance_columns(df: DataFrame, key: str, k: int) -> DataFrame:
    d = neighbours.distances()
    return df.select(key, *[r(F.element_at(d, i), f"d{i}") for i in range(1, k + 1)])


# Queries


def scaled_part(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = part(spark, sf_dir)
        scaled = scale.fit_scaler(rows, PART, kind).transform(rows)
        return scaled.select("p_partkey", *[r(f, f) for f in PART])

    return query


def contamination_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("value")
    cut = threshold.contamination_threshold(rows, "value", 0.1)
    return rows.agg(
        F.count_if(F.col("value") > cut).alias("above"), r(F.lit(cut), "threshold")
    )


def threshold_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_discount")
    cuts = threshold.quantiles(
        rows, {"l_extendedprice": 0.9, "l_discount": 0.9}, method="refine"
    )
    return rows.agg(
        *[r(F.lit(cut), f"{c}_threshold") for c, cut in cuts.items()],
        *[F.count_if(F.col(c) > cut).alias(f"{c}_above") for c, cut in cuts.items()],
    )


def threshold_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_extendedprice")
    cut = threshold.contamination_threshold(rows, "l_extendedprice", 0.1, method="approx")
    return rows.agg(
        F.count_if(F.col("l_extendedprice") > cut).alias("above"), r(F.lit(cut), "threshold")
    )


def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part(spark, sf_dir)
    scaled = scale.fit_scaler(rows, PART).transform(rows)
    axes = pca.fit_pca(scaled, PART, 2).columns(cells(PART))
    return scaled.select(
        "p_partkey", *[r(F.abs(a), f"pc{i}") for i, a in enumerate(axes, 1)]
    )


def mahalanobis_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part(spark, sf_dir)
    found = stats.collect_stats(rows, PART, with_cov=True)
    return rows.select("p_partkey", r(pca.mahalanobis_column(cells(PART), found), "distance"))


def flag_pca_mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part(spark, sf_dir)
    return score_and_flag(pca.fit_pca_mahalanobis(rows, PART).flag(rows, "p_partkey"), "p_partkey")


def flag_pca_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    model = pca.fit_pca_mahalanobis(rows, EMBEDDING, n_components=0.5)
    return score_and_flag(model.flag(rows, "vec_id"), "vec_id")


def gaussian_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(*LINE)
    scaled = scale.fit_scaler(rows, LINE).transform(rows)
    return scaled.agg(
        *[r(F.avg(c), f"mean_{c}") for c in LINE], *[r(F.var_pop(c), f"var_{c}") for c in LINE]
    )


def gaussian_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    model = gaussian.from_stats(stats.collect_stats(rows, EVENTS), EVENTS)
    return rows.select(
        "event_id",
        r(model.log_score_column(cells(EVENTS)), "log_p"),
        r(model.score_column(cells(EVENTS)), "p", 12),
    )


def flag_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    flags = gaussian.fit_gaussian(rows, EVENTS).flag(rows, "event_id")
    return flags.select("event_id", r("score", "p", 12), "flag")


def labelled_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_events(spark, sf_dir)
    model = gaussian.from_stats(stats.collect_stats(rows, EVENTS), EVENTS)
    return rows.select("event_id", "y", model.score_column(cells(EVENTS)).alias("p"))


def gaussian_epsilon_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_probabilities(spark, sf_dir).persist()
    epsilon, f1 = gaussian.search_epsilon(rows, "p", "y")
    return gaussian.confusion(rows, "p", "y", epsilon).select(
        r(F.lit(epsilon), "epsilon", 12), r(F.lit(f1), "best_f1"), "fp", "fn", "tp"
    )


def confusion_at_epsilon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_probabilities(spark, sf_dir)
    return gaussian.confusion(rows, "p", "y", 1e-5).select(
        "fp", "fn", "tp", r("precision", "precision"), r("recall", "recall"), r("f1", "f1")
    )


def flag_gaussian_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_events(spark, sf_dir)
    flags = gaussian.fit_gaussian(rows, EVENTS, "y", epsilon_candidates=1000).flag(rows, "event_id")
    return flags.select("event_id", r("score", "p", 12), "flag")


def kmeans_distance_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part(spark, sf_dir)
    model = kmeans.fit_centroids(rows, PART, 1)
    return rows.select("p_partkey", r(model.score_column(cells(PART)), "distance"))


def flag_kmeans_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part(spark, sf_dir)
    return score_and_flag(kmeans.fit_kmeans(rows, PART, 1).flag(rows, "p_partkey"), "p_partkey")


def flag_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_averages(spark, sf_dir)
    scaled = scale.fit_scaler(rows, LINE).transform(rows)
    return score_and_flag(
        kmeans.fit_kmeans(scaled, LINE, 4).flag(scaled, "l_orderkey"), "l_orderkey"
    )


def elbow_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = (
        table(spark, sf_dir, "events")
        .groupBy(F.to_date("ts").alias("day"))
        .agg(F.sum("value").alias("score"))
    )
    k = (F.datediff("day", F.lit("2024-01-01").cast("date")) + 1).alias("k")
    return kmeans.elbow_pick(days.select(k, "score")).select("k", r("distance", "distance"))


def kmeans_elbow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part(spark, sf_dir)
    scaled = scale.fit_scaler(rows, PART).transform(rows)
    curve = kmeans.elbow_distances(kmeans.elbow_curve(scaled, PART, 10))
    return curve.select("k", r("score", "score", 3), r("distance", "distance", 3))


def knn_self(**index_settings):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = embeddings(spark, sf_dir)
        index = neighbours.build_index(rows, EMBEDDING, "vec_id", **index_settings)
        found = neighbours.self_neighbours(index, 5)
        return distance_columns(neighbours.per_row(rows, "vec_id", index, found), "vec_id", 5)

    return query


def knn_join_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = customers(spark, sf_dir)
    scaler = scale.fit_scaler(known, CUSTOMER)
    index = neighbours.build_index(scaler.transform(known), CUSTOMER, "id")
    new = scaler.transform(suppliers(spark, sf_dir))
    return distance_columns(neighbours.neighbours(new, "id", index, 5), "id", 5)


def knn_join_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part(spark, sf_dir)
    scaled = scale.fit_scaler(rows, PART).transform(rows)
    index = neighbours.build_index(scaled, PART, "p_partkey", cell_points=512)
    found = neighbours.neighbours(scaled, "p_partkey", index, 5, method="pivot")
    return distance_columns(found, "p_partkey", 5)


def knn_self_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part(spark, sf_dir)
    scaled = scale.fit_scaler(rows, PART).transform(rows)
    index = neighbours.build_index(scaled, PART, "p_partkey", cell_points=512)
    found = neighbours.self_neighbours(index, 5, method="pivot")
    return distance_columns(neighbours.per_row(scaled, "p_partkey", index, found), "p_partkey", 5)


def knn_score(how: str, k: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = embeddings(spark, sf_dir)
        index = neighbours.build_index(rows, EMBEDDING, "vec_id")
        found = neighbours.per_row(rows, "vec_id", index, neighbours.self_neighbours(index, k))
        score = fc.neighbour_score(neighbours.distances(), k, how)
        return found.select("vec_id", r(score, "score"))

    return query


def flag_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    return score_and_flag(knn.fit_knn(rows, EMBEDDING, "vec_id").flag(rows, "vec_id"), "vec_id")


def flag_knn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    scaled = scale.fit_scaler(rows, EVENTS).transform(rows)
    model = knn.fit_knn(scaled, EVENTS, "event_id", method="pivot")
    return score_and_flag(model.flag(scaled, "event_id"), "event_id")


def flag_lof_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_order_averages(spark, sf_dir)
    scaled = scale.fit_scaler(rows, LINE).transform(rows)
    model = lof.fit_lof(scaled, LINE, "l_orderkey", method="pivot")
    return score_and_flag(model.flag(scaled, "l_orderkey"), "l_orderkey")


def lof_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    model = lof.fit_lof(rows, EMBEDDING, "vec_id")
    return model.training_scores(rows, "vec_id").select("vec_id", r("score", "score"))


def flag_lof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    return score_and_flag(lof.fit_lof(rows, EMBEDDING, "vec_id").flag(rows, "vec_id"), "vec_id")


def flag_new_lof(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = customers(spark, sf_dir)
    scaler = scale.fit_scaler(known, CUSTOMER)
    model = lof.fit_lof(scaler.transform(known), CUSTOMER, "id")
    return score_and_flag(model.flag(scaler.transform(suppliers(spark, sf_dir)), "id"), "id")


def reconstruction_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding")
    )
    mean = stats.collect_stats(embeddings(spark, sf_dir), EMBEDDING).mean
    centre = F.array(*[F.lit(float(m)) for m in mean])
    return rows.select("vec_id", r(fc.mean_absolute_error(F.col("embedding"), centre), "mae"))


def flag_autoencoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    model = autoencoder.fit_autoencoder(
        rows, EMBEDDING, "vec_id", hidden_neurons=[16, 8, 16], epochs=20
    )
    return score_and_flag(model.flag(rows, "vec_id"), "vec_id")


def flag_one_class_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    scaled = scale.fit_scaler(rows, EVENTS).transform(rows)
    return score_and_flag(
        svm.fit_one_class_svm(scaled, EVENTS).flag(scaled, "event_id"), "event_id"
    )


def flag_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    model = forest.fit_isolation_forest(rows, EVENTS, "event_id")
    return score_and_flag(model.flag(rows, "event_id"), "event_id")


def split_json_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = split_json.parse(requests(spark, sf_dir))
    rows = split_json.unpack(documents, CELLS)
    return rows.select("request_id", "pos", *[r(c, c) for c in CELLS])


def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "csv")
    part(spark, sf_dir).withColumnRenamed("p_partkey", "").write.csv(path, header=True)
    rows = csv.read(spark, path, PART, "p_partkey", "bigint")
    return rows.select("p_partkey", *[r(f, f) for f in PART])


def validate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = frame.validate_documents(faulty_requests(spark, sf_dir), CELLS)
    return errors.filter("error_columns <> ''").select("request_id", "error_columns")


def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = frame.validate_documents(faulty_requests(spark, sf_dir), CELLS)
    return errors.filter("error_data <> ''").select("request_id", "error_data")


def rejected_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_json.sort_out(split_json.parse(mixed_requests(spark, sf_dir)), CELLS)[1]


def predict_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, stored = new_path(spark, "request-model"), new_path(spark, "request-flags")
    pipeline = Pipeline("standard").add("kmeans", n_clusters=1)
    request_jobs.train_on_requests(requests(spark, sf_dir), pipeline, CELLS, model, "007")
    request_jobs.predict_requests(
        mixed_requests(spark, sf_dir), model, stored, "007", "1", datetime(2024, 2, 1)
    )
    found = predictions.read(spark, stored, "007", "1")
    return found.select(
        "model_id", "prediction_id", "request_id", "pos", "detector", r("score", "score"), "flag"
    )


def feature_null_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = part(spark, sf_dir).withColumn("p_size", F.nullif("p_size", F.lit(10)))
    model = kmeans.fit_kmeans(gaps, PART, 1, on_null="skip")
    return score_and_flag(model.flag(gaps, "p_partkey", on_null="skip"), "p_partkey")


def state_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part(spark, sf_dir)
    path = new_path(spark, "state")
    save_detector(spark, gaussian.fit_gaussian(rows, PART), path, "parts")
    flags = load_detector(spark, path).flag(rows, "p_partkey")
    return flags.select("p_partkey", r("score", "p", 12), "flag")


def prediction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    fitted = (
        Pipeline("standard")
        .add("gaussian_distribution")
        .add("kmeans", n_clusters=1)
        .fit(rows, EVENTS, "event_id")
    )
    path = new_path(spark, "predictions")
    when = datetime(2024, 2, 1)
    predictions.write(fitted.flag(rows, "long"), path, "events", "first", when)
    stored = predictions.read(spark, path, "events", "first")
    return stored.select(
        "model_id", "prediction_id", "event_id", "detector", r("score", "score"), "flag"
    )


def all_detectors() -> Pipeline:
    return (
        Pipeline()
        .add("pca_mahalanobis")
        .add("kmeans", n_clusters=1)
        .add("gaussian_distribution")
        .add("knearest_neighbors")
        .add("local_outlier_factor")
    )


def flag_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers(spark, sf_dir)
    return all_detectors().fit(rows, CUSTOMER, "id").flag(rows)


def pipeline_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers(spark, sf_dir)
    path = new_path(spark, "pipeline")
    all_detectors().fit(rows, CUSTOMER, "id").save(spark, path, "customers")
    return FittedPipeline.load(spark, path).flag(rows)


def flag_eight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight detectors, fitted and applied together."""
    rows = part(spark, sf_dir)
    return (
        Pipeline("standard")
        .add("pca_mahalanobis")
        .add("autoencoder", hidden_neurons=[4, 2, 2, 4])
        .add("kmeans", n_clusters=3)
        .add("one_class_svm")
        .add("gaussian_distribution")
        .add("isolation_forest")
        .add("knearest_neighbors")
        .add("local_outlier_factor")
        .fit(rows, PART, "p_partkey")
        .flag(rows)
    )


def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    fitted = (
        Pipeline()
        .add("gaussian_distribution")
        .add("pca_mahalanobis")
        .fit(rows, EVENTS, "event_id")
    )
    arriving = (
        spark.readStream.schema(table(spark, sf_dir, "events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    path, log = new_path(spark, "stream"), new_path(spark, "stream-log")
    scoring.write_stream(with_k(arriving), fitted, path, "events", log).awaitTermination()
    stored = predictions.read(spark, path, "events")
    return stored.select("event_id", "detector", r("score", "score"), "flag")


def knn_self_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of the embeddings, searched by short codes."""
    rows = embeddings(spark, sf_dir)
    index = neighbours.build_index(rows, EMBEDDING, "vec_id", cell_points=128)
    found = neighbours.self_neighbours(index, 5, method="axes")
    return distance_columns(neighbours.per_row(rows, "vec_id", index, found), "vec_id", 5)


def knn_self_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of the parts in a tree whose nodes have eight pivots."""
    rows = part(spark, sf_dir)
    scaled = scale.fit_scaler(rows, PART).transform(rows)
    index = neighbours.build_index(scaled, PART, "p_partkey", cell_points=16, max_pivots=8)
    found = neighbours.self_neighbours(index, 5, method="pivot")
    return distance_columns(neighbours.per_row(scaled, "p_partkey", index, found), "p_partkey", 5)


def kmeans_elbow_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 99 fits of the elbow: their rows, and what the sums of squares within and between make together.

    That is the sum of squares of the table if, and only if, centroids are the means of their rows.
    """
    rows = part(spark, sf_dir)
    scaled = scale.fit_scaler(rows, PART).transform(rows)
    fits = kmeans.fit_every_k(scaled, PART, range(1, 100), tol=0.0)
    found = [
        (k, int(f.counts.sum()), float(f.inertia + (f.counts @ (f.centroids**2)).sum()), f.converged)
        for k, f in fits.items()
    ]
    table = spark.createDataFrame(found, "k int, rows long, squares double, rests boolean")
    return table.select("k", "rows", r("squares", "squares", 4), "rests")


def flag_summary(flags: DataFrame, again: DataFrame, key: str) -> DataFrame:
    """Rows, flagged ones, whether those score highest, and whether a fit of the table cut otherwise flags the same."""
    both = flags.join(again.select(key, F.col("score").alias("score2"), F.col("flag").alias("flag2")), key)
    return both.agg(
        F.count("*").alias("n_rows"),
        F.count_if("flag").alias("flagged"),
        (F.min(F.when(F.col("flag"), F.col("score"))) > F.max(F.when(~F.col("flag"), F.col("score")))).alias("highest"),
        F.every((F.col("score") == F.col("score2")) & (F.col("flag") == F.col("flag2"))).alias("same_again"),
    )


def fit_invariants(source, features: list[str], key: str, fit):
    """A detector fitted on its table and on the same rows in other partitions, as one row of invariants."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = source(spark, sf_dir)
        scaled = scale.fit_scaler(rows, features).transform(rows)
        # the two fits do not wait for each other's jobs
        with ThreadPoolExecutor(2) as pool:
            one, other = pool.map(lambda n: fit(scaled.repartition(n), features, key), (1, 13))
        return flag_summary(one.flag(scaled, key), other.flag(scaled, key), key)

    return query


def threshold_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cut from sketches of the lines' prices by line number, and whether its rank is within the bound."""
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_extendedprice")
    sketches = rows.groupBy("l_linenumber").agg(score_sketch.sketch_column(F.col("l_extendedprice")).alias("s"))
    sketch = score_sketch.merged_column(sketches, "s")
    cut = score_sketch.cut(spark, sketch, 0.1)
    off = F.abs(F.count_if(F.col("l_extendedprice") > cut) - 0.1 * F.count("*"))
    return rows.agg(F.lit(sketch.n).alias("n_rows"), (off <= 2 * sketch.rank_error).alias("within"))


def pca_share_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The axes that explain more than half of the variance of two features: the first one."""
    rows = part(spark, sf_dir)
    scaled = scale.fit_scaler(rows, PART).transform(rows)
    model = pca.fit_pca_mahalanobis(scaled, PART, n_components=0.5)
    return score_and_flag(model.flag(scaled, "p_partkey"), "p_partkey")


def merged_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariances of all embeddings, merged from those of the even and of the odd labels."""
    rows = table(spark, sf_dir, "embeddings")
    halves = [rows.where(F.col("label") % 2 == k).select("vec_id", "embedding") for k in range(2)]
    found = [stats.collect_stats(frame.spread_array(h, "embedding", WIDTH), EMBEDDING, with_cov=True) for h in halves]
    both = found[0].merge(found[1])
    cells = [(f"f{i}", f"f{j}", float(both.cov[i, j]), both.n) for i in range(WIDTH) for j in range(i, WIDTH)]
    merged = spark.createDataFrame(cells, "a string, b string, c double, n_rows long")
    return merged.select("a", "b", r("c", "cov", 9), "n_rows")


def stream_score_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers flagged as they arrive, against the neighbours among all of them."""
    path, log = new_path(spark, "stream"), new_path(spark, "stream-log")
    with cleaned_up(spark):
        rows = customers(spark, sf_dir)
        model = Pipeline().add("knearest_neighbors", method="pivot").add("local_outlier_factor", method="pivot")
        fitted = model.fit(rows, CUSTOMER, "id")
        arriving = (
            spark.readStream.schema(table(spark, sf_dir, "customer").schema)
            .option("pathGlobFilter", "customer.parquet")
            .parquet(sf_dir)
            .select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nation"))
        )
        scoring.write_stream(arriving, fitted, path, "customers", log).awaitTermination()
    name = scoring.compact_stream(spark, path, "customers", 0)
    stored = predictions.read(spark, path, "customers", name)
    return stored.select("id", "detector", r("score", "score"), "flag")


def state_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts scored by a reader of a model's first version and by one of the version that replaced it."""
    rows = part(spark, sf_dir)
    path = new_path(spark, "versions")
    first = versions.save_version(spark, Pipeline("standard").add("kmeans", n_clusters=1).fit(rows, PART, "p_partkey"), path, "parts")
    old = versions.load_newest(spark, path)
    second = versions.save_version(spark, Pipeline("minmax").add("kmeans", n_clusters=1).fit(rows, PART, "p_partkey"), path, "parts")
    new = versions.load_newest(spark, path)
    kept = versions.metadata(spark, path)["created"] == versions.versions(spark, path)[0]["created"]
    scored = [m.score(rows).select("p_partkey", r("kmeans_score", s), F.col("kmeans").alias(f)) for m, s, f in ((old, "old", "old_flag"), (new, "new", "new_flag"))]
    number = F.lit(second["number"] - first["number"]).cast("int")
    return scored[0].join(scored[1], "p_partkey").withColumn("created_kept", F.lit(kept)).withColumn("later", number)


def fit_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of detectors that were fitted at once, and whether their cuts are those of a fit one by one."""
    rows = part(spark, sf_dir)
    model = Pipeline().add("pca_mahalanobis").add("kmeans", n_clusters=2).add("isolation_forest").add("one_class_svm")
    seen: list = []
    many = model.fit(rows, PART, "p_partkey", parallel=4, progress=seen.append)
    one = model.fit(rows, PART, "p_partkey")
    found = [(p.detector, p.total, one.models[p.detector].threshold == many.models[p.detector].threshold) for p in seen]
    done = spark.createDataFrame(found, "detector string, total int, same boolean")
    return done.crossJoin(F.broadcast(many.flag(rows).agg(F.count("*").alias("n_rows"))))


def entry(spark: SparkSession) -> DataFrame:
    """Parts flagged by several detectors after min-max scaling."""
    ship_package(spark)
    rows = part(spark, "/root/testdata/sf0.001")
    return (
        Pipeline()
        .add("pca_mahalanobis")
        .add("kmeans", n_clusters=3)
        .add("gaussian_distribution")
        .add("knearest_neighbors")
        .fit(rows, PART, "p_partkey")
        .flag(rows)
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = {
        "scale_minmax": scaled_part("minmax"),
        "scale_standard": scaled_part("standard"),
        "contamination_threshold": contamination_threshold,
        "threshold_refined": threshold_refined,
        "threshold_approx": threshold_approx,
        "pca_project": pca_project,
        "mahalanobis_score": mahalanobis_score,
        "flag_pca_mahalanobis": flag_pca_mahalanobis,
        "flag_pca_share": flag_pca_share,
        "gaussian_params": gaussian_params,
        "gaussian_score": gaussian_score,
        "flag_gaussian": flag_gaussian,
        "gaussian_epsilon_labelled": gaussian_epsilon_labelled,
        "confusion_at_epsilon": confusion_at_epsilon,
        "flag_gaussian_labelled": flag_gaussian_labelled,
        "kmeans_distance_k1": kmeans_distance_k1,
        "flag_kmeans_k1": flag_kmeans_k1,
        "flag_kmeans": flag_kmeans,
        "elbow_pick": elbow_pick,
        "kmeans_elbow": kmeans_elbow,
        "knn_join_self": knn_self(),
        "knn_join_new": knn_join_new,
        "knn_metric_p1": knn_self(p=1),
        "knn_metric_p3": knn_self(p=3),
        "knn_metric_chebyshev": knn_self(metric="chebyshev"),
        "knn_join_pivot": knn_join_pivot,
        "knn_self_pivot": knn_self_pivot,
        "knn_score_max": knn_score("max_distance", 5),
        "knn_score_average": knn_score("average", 5),
        "knn_score_median": knn_score("median", 6),
        "flag_knn": flag_knn,
        "flag_knn_events": flag_knn_events,
        "flag_lof_orders": flag_lof_orders,
        "lof_score": lof_score,
        "flag_lof": flag_lof,
        "flag_new_lof": flag_new_lof,
        "reconstruction_mae": reconstruction_mae,
        "flag_autoencoder": flag_autoencoder,
        "flag_one_class_svm": flag_one_class_svm,
        "flag_isolation_forest": flag_isolation_forest,
        "split_json_source": split_json_source,
        "csv_source": csv_source,
        "validate_columns": validate_columns,
        "validate_rows": validate_rows,
        "rejected_requests": rejected_requests,
        "predict_requests": predict_requests,
        "feature_null_skip": feature_null_skip,
        "state_round_trip": state_round_trip,
        "prediction_table": prediction_table,
        "flag_all": flag_all,
        "pipeline_round_trip": pipeline_round_trip,
        "flag_eight": flag_eight,
        "stream_score": stream_score,
        "knn_self_wide": knn_self_wide,
        "knn_self_deep": knn_self_deep,
        "kmeans_elbow_all": kmeans_elbow_all,
        "kmeans_default": fit_invariants(customers, CUSTOMER, "id", lambda df, f, key: kmeans.fit_kmeans(df, f)),
        "svm_invariants": fit_invariants(events, EVENTS, "event_id", lambda df, f, key: svm.fit_one_class_svm(df, f)),
        "forest_invariants": fit_invariants(events, EVENTS, "event_id", forest.fit_isolation_forest),
        "autoencoder_invariants": fit_invariants(
            embeddings, EMBEDDING, "vec_id",
            lambda df, f, key: autoencoder.fit_autoencoder(df, f, key, hidden_neurons=[16, 8, 16], epochs=5),
        ),
        "threshold_merged": threshold_merged,
        "pca_share_two": pca_share_two,
        "merged_statistics": merged_statistics,
        "stream_score_joins": stream_score_joins,
        "state_replaced": state_replaced,
        "fit_side_by_side": fit_side_by_side,
    }
    more = llm.QUERIES | {"pipeline": corpus_pipeline.run} if llm else {}
    return {name: shipped(query) for name, query in every.items()} | more


# SQL for the comparison

GAUSS_EVENTS = """
    e AS (SELECT event_id, event_type, value AS x, CAST(json_extract(props, '$.k') AS DOUBLE) AS y
          FROM events),
    m AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy FROM e),
    g AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
                 -0.5 * ln(2 * pi() * vx) - (x - mx) * (x - mx) / (2 * vx)
                 - 0.5 * ln(2 * pi() * vy) - (y - my) * (y - my) / (2 * vy) AS lp
          FROM e, m),
    p AS (SELECT event_id, label, lp, exp(lp) AS p FROM g)
"""

PART_XY = "x AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part)"
PART_SCALED = """
    raw AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part),
    b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM raw),
    x AS (SELECT p_partkey, (x - x0) / (x1 - x0) AS x, (y - y0) / (y1 - y0) AS y FROM raw, b)
"""
CUSTOMER_SCALED = """
    craw AS (SELECT c_custkey AS id, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer),
    b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM craw),
    c AS (SELECT id, (x - x0) / (x1 - x0) AS x, (y - y0) / (y1 - y0) AS y FROM craw, b),
    s AS (SELECT s_suppkey AS id, (s_acctbal - x0) / (x1 - x0) AS x,
                 (s_nationkey - y0) / (y1 - y0) AS y FROM supplier, b)
"""


def mahalanobis_cte(rows: str, key: str) -> str:
    return f"""
    q AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, var_samp(y) AS b,
                 covar_samp(x, y) AS c FROM {rows}),
    maha AS (SELECT {key}, sqrt((b * (x - mx) ** 2 - 2 * c * (x - mx) * (y - my)
                 + a * (y - my) ** 2) / (a * b - c * c)) AS score FROM {rows}, q)
    """


def centre_cte(rows: str, key: str) -> str:
    return f"""
    ctr AS (SELECT avg(x) AS cx, avg(y) AS cy FROM {rows}),
    km AS (SELECT {key}, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS score FROM {rows}, ctr)
    """


def flagged(scores: str, key: str, at: float = 0.9) -> str:
    return f"""
    SELECT {key}, round(score, 6) AS score,
           score > (SELECT quantile_cont(score, {at}) FROM {scores}) AS flag
    FROM {scores}
    """


EMB = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
EMB_DISTANCE = {
    "p2": "list_distance(a.e, b.e)",
    "p1": "list_sum(list_transform(list_zip(a.e, b.e), lambda z: abs(z[1] - z[2])))",
    "p3": "list_sum(list_transform(list_zip(a.e, b.e), lambda z: abs(z[1] - z[2]) ** 3)) ** (1.0 / 3)",
    "inf": "list_max(list_transform(list_zip(a.e, b.e), lambda z: abs(z[1] - z[2])))",
}


def emb_pairs(metric: str = "p2", with_self: bool = False) -> str:
    """Ranked neighbours of the embeddings among themselves."""
    where = "" if with_self else "WHERE a.vec_id <> b.vec_id"
    name = "nn_all" if with_self else "nn"
    return f"""
    {name} AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS k FROM
          (SELECT a.vec_id AS id, b.vec_id AS other, {EMB_DISTANCE[metric]} AS d
           FROM v a, v b {where}))
    """


def xy_pairs(left: str, right: str, name: str, without_self: bool = False) -> str:
    where = "WHERE a.id <> b.id" if without_self else ""
    return f"""
    {name} AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS k FROM
          (SELECT a.id AS id, b.id AS other,
                  sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d
           FROM {left} a, {right} b {where}))
    """


def wide_distances(pairs: str, key: str, k: int = 5) -> str:
    columns = ", ".join(f"round(max(d) FILTER (WHERE k = {i}), 6) AS d{i}" for i in range(1, k + 1))
    return f"SELECT id AS {key}, {columns} FROM {pairs} WHERE k <= {k} GROUP BY id"


def lof_ctes(train: str, new: str = "", k: int = 20) -> str:
    """Factor of the training rows, and of new rows against them."""
    sql = f"""
    kd AS (SELECT id, d AS kd FROM {train} WHERE k = {k}),
    lrd AS (SELECT n.id, 1.0 / (avg(greatest(kd.kd, n.d)) + 1e-10) AS lrd
            FROM {train} n JOIN kd ON kd.id = n.other WHERE n.k <= {k} GROUP BY n.id),
    lof AS (SELECT n.id, avg(o.lrd) / max(s.lrd) AS score
            FROM {train} n JOIN lrd o ON o.id = n.other JOIN lrd s ON s.id = n.id
            WHERE n.k <= {k} GROUP BY n.id)
    """
    if new:
        sql += f""",
    lrdn AS (SELECT n.id, 1.0 / (avg(greatest(kd.kd, n.d)) + 1e-10) AS lrd
             FROM {new} n JOIN kd ON kd.id = n.other WHERE n.k <= {k} GROUP BY n.id),
    lofn AS (SELECT n.id, avg(o.lrd) / max(s.lrd) AS score
             FROM {new} n JOIN lrd o ON o.id = n.other JOIN lrdn s ON s.id = n.id
             WHERE n.k <= {k} GROUP BY n.id)
    """
    return sql


def knn_score_sql(expression: str, k: int) -> str:
    return f"""WITH {EMB}, {emb_pairs()}
    SELECT id AS vec_id, round({expression}, 6) AS score FROM nn WHERE k <= {k} GROUP BY id"""


REQUESTS_SQL = """
    req AS (SELECT CAST(vec_id AS VARCHAR) AS request_id, vec_id % 7 AS kind,
                   ['a', 'b', 'c', 'd'] AS names,
                   list_transform(range(0, 16), lambda i: embedding[i * 4 + 1 : i * 4 + 4]) AS rows
            FROM embeddings),
    bad AS (SELECT request_id,
                   CASE kind WHEN 1 THEN names[1:3] WHEN 2 THEN list_append(names, 'e')
                             ELSE names END AS columns,
                   CASE kind WHEN 3 THEN rows[1:0]
                             WHEN 4 THEN list_transform(rows, lambda w, i:
                                         CASE WHEN i = 4 THEN w[1:2] ELSE w END)
                             WHEN 5 THEN list_transform(rows, lambda w: list_append(w, 0.0))
                             ELSE rows END AS data
            FROM req),
    chk AS (SELECT request_id, len(columns) AS width,
                   list_sort(columns) = ['a', 'b', 'c', 'd'] AS same,
                   list_distinct(list_transform(data, lambda w: len(w))) AS lengths
            FROM bad)
"""


def flag_all_sql() -> str:
    return f"""WITH {CUSTOMER_SCALED}, {mahalanobis_cte("c", "id")}, {centre_cte("c", "id")},
    gm AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy FROM c),
    gp AS (SELECT id, exp(-0.5 * ln(2 * pi() * vx) - (x - mx) * (x - mx) / (2 * vx)
                  - 0.5 * ln(2 * pi() * vy) - (y - my) * (y - my) / (2 * vy)) AS p FROM c, gm),
    {xy_pairs("c", "c", "tr", True)}, {xy_pairs("c", "c", "nw")},
    kt AS (SELECT id, d AS score FROM tr WHERE k = 5), kn AS (SELECT id, d AS score FROM nw WHERE k = 5),
    {lof_ctes("tr", "nw")}
    SELECT c.id,
           maha.score > (SELECT quantile_cont(score, 0.9) FROM maha) AS pca_mahalanobis,
           km.score > (SELECT quantile_cont(score, 0.9) FROM km) AS kmeans,
           gp.p < (SELECT min(p) + (max(p) - min(p)) / 100000000 FROM gp) AS gaussian_distribution,
           kn.score > (SELECT quantile_cont(score, 0.9) FROM kt) AS knearest_neighbors,
           lofn.score > (SELECT quantile_cont(score, 0.9) FROM lof) AS local_outlier_factor
    FROM c JOIN maha USING (id) JOIN km USING (id) JOIN gp USING (id) JOIN kn USING (id)
         JOIN lofn USING (id)"""


def epsilon_sql(candidates: int) -> str:
    """Best cut by running counts over the grid positions where rows start to be flagged."""
    return f"""
    s AS (SELECT min(p) AS lo, (max(p) - min(p)) / {candidates} AS step, sum(label) AS total FROM p),
    t AS (SELECT label, p, lo, step, CAST(floor((p - lo) / step) AS BIGINT) AS i FROM p, s),
    u AS (SELECT label, CASE WHEN lo + (i - 1) * step > p THEN i - 1 WHEN lo + i * step > p THEN i
                             WHEN lo + (i + 1) * step > p THEN i + 1 ELSE i + 2 END AS i FROM t),
    h AS (SELECT i, sum(label) AS pos, count(*) AS n FROM u WHERE i < {candidates} GROUP BY i),
    run AS (SELECT i, sum(pos) OVER (ORDER BY i) AS tp, sum(n) OVER (ORDER BY i) AS n FROM h),
    pr AS (SELECT i, tp, n, tp / n AS pre, tp / total AS rec FROM run, s WHERE tp > 0),
    best AS (SELECT i, 2 * pre * rec / (pre + rec) AS f1, lo + i * step AS epsilon FROM pr, s
             ORDER BY f1 DESC, i LIMIT 1)
    """


def invariants_sql(name: str) -> str:
    """A tenth of the rows lies above the interpolated percentile, if their scores differ."""
    return f"""SELECT count(*) AS n_rows, count(*) - 1 - CAST(floor(0.9 * (count(*) - 1)) AS BIGINT) AS flagged,
                      true AS highest, true AS same_again FROM {name}"""


def oracle_sql() -> dict[str, str]:
    split_cells = ", ".join(
        f"round(CAST(embedding[pos * 4 + CASE WHEN vec_id % 2 = 0 THEN {i} ELSE {5 - i} END] AS DOUBLE), 6)"
        f" AS {c}"
        for i, c in enumerate(CELLS, 1)
    )
    exact_cells = ", ".join(
        f"CAST(embedding[pos * 4 + CASE WHEN vec_id % 2 = 0 THEN {i} ELSE {5 - i} END] AS DOUBLE) AS {c}"
        for i, c in enumerate(CELLS, 1)
    )
    scaled_line = ", ".join(
        f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS {c}" for c in LINE
    )
    line_stats = ", ".join(
        [f"round(avg({c}), 6) AS mean_{c}" for c in LINE]
        + [f"round(var_pop({c}), 6) AS var_{c}" for c in LINE]
    )
    more = llm.ORACLE_SQL if llm else {}
    if llm and corpus_pipeline.ORACLE_SQL:
        more = more | {"pipeline": corpus_pipeline.ORACLE_SQL}
    return more | {
        "scale_minmax": f"WITH {PART_SCALED} SELECT p_partkey, round(x, 6) AS p_size, round(y, 6) AS p_retailprice FROM x",
        "scale_standard": f"""WITH {PART_XY}
            SELECT p_partkey, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) AS p_size,
                   round((y - avg(y) OVER ()) / stddev_pop(y) OVER (), 6) AS p_retailprice FROM x""",
        "contamination_threshold": """
            WITH t AS (SELECT quantile_cont(value, 0.9) AS cut FROM events)
            SELECT count(*) FILTER (WHERE value > cut) AS above, round(max(cut), 6) AS threshold
            FROM events, t""",
        "threshold_refined": """
            WITH t AS (SELECT quantile_cont(l_extendedprice, 0.9) AS a, quantile_cont(l_discount, 0.9) AS b
                       FROM lineitem)
            SELECT round(max(a), 6) AS l_extendedprice_threshold, round(max(b), 6) AS l_discount_threshold,
                   count(*) FILTER (WHERE l_extendedprice > a) AS l_extendedprice_above,
                   count(*) FILTER (WHERE l_discount > b) AS l_discount_above
            FROM lineitem, t""",
        "pca_project": f"""WITH {PART_SCALED},
            q AS (SELECT avg(x) AS mx, avg(y) AS my,
                         0.5 * atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) AS t FROM x)
            SELECT p_partkey, round(abs((x - mx) * cos(t) + (y - my) * sin(t)), 6) AS pc1,
                   round(abs((y - my) * cos(t) - (x - mx) * sin(t)), 6) AS pc2 FROM x, q""",
        "mahalanobis_score": f"""WITH {PART_XY}, {mahalanobis_cte("x", "p_partkey")}
            SELECT p_partkey, round(score, 6) AS distance FROM maha""",
        "flag_pca_mahalanobis": f"""WITH {PART_XY}, {mahalanobis_cte("x", "p_partkey")}
            {flagged("maha", "p_partkey")}""",
        "gaussian_params": f"WITH s AS (SELECT {scaled_line} FROM lineitem) SELECT {line_stats} FROM s",
        "gaussian_score": f"WITH {GAUSS_EVENTS} SELECT event_id, round(lp, 6) AS log_p, round(p, 12) AS p FROM p",
        "flag_gaussian": f"""WITH {GAUSS_EVENTS},
            s AS (SELECT min(p) + (max(p) - min(p)) / 100000000 AS eps FROM p)
            SELECT event_id, round(p, 12) AS p, p < eps AS flag FROM p, s""",
        "gaussian_epsilon_labelled": f"""WITH {GAUSS_EVENTS}, {epsilon_sql(100_000_000)}
            SELECT round(max(epsilon), 12) AS epsilon, round(max(f1), 6) AS best_f1,
                   count(*) FILTER (WHERE p < epsilon AND label = 0) AS fp,
                   count(*) FILTER (WHERE p >= epsilon AND label = 1) AS fn,
                   count(*) FILTER (WHERE p < epsilon AND label = 1) AS tp FROM p, best""",
        "confusion_at_epsilon": f"""WITH {GAUSS_EVENTS},
            c AS (SELECT count(*) FILTER (WHERE p < 1e-5 AND label = 0) AS fp,
                         count(*) FILTER (WHERE p >= 1e-5 AND label = 1) AS fn,
                         count(*) FILTER (WHERE p < 1e-5 AND label = 1) AS tp FROM p)
            SELECT fp, fn, tp, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
                   round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
        "flag_gaussian_labelled": f"""WITH {GAUSS_EVENTS}, {epsilon_sql(1000)}
            SELECT event_id, round(p, 12) AS p, p < epsilon AS flag FROM p, best""",
        "kmeans_distance_k1": f"""WITH {PART_XY}, {centre_cte("x", "p_partkey")}
            SELECT p_partkey, round(score, 6) AS distance FROM km""",
        "flag_kmeans_k1": f"""WITH {PART_XY}, {centre_cte("x", "p_partkey")} {flagged("km", "p_partkey")}""",
        "elbow_pick": """
            WITH days AS (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS k,
                                 sum(value) AS s FROM events GROUP BY 1),
            ends AS (SELECT min(k) AS k1, max(k) AS k2, arg_min(s, k) AS s1, arg_max(s, k) AS s2 FROM days),
            dist AS (SELECT k, abs((k2 - k1 + 2) * (s1 - s) - (s2 - s1) * (0 - (k - k1)))
                            / sqrt((k2 - k1 + 2) ** 2 + (s2 - s1) ** 2) AS d FROM days, ends)
            SELECT CAST(k AS INTEGER) AS k, round(d, 6) AS distance FROM dist ORDER BY d DESC, k LIMIT 1""",
        "knn_join_self": f"WITH {EMB}, {emb_pairs()} {wide_distances('nn', 'vec_id')}",
        "knn_metric_p1": f"WITH {EMB}, {emb_pairs('p1')} {wide_distances('nn', 'vec_id')}",
        "knn_metric_p3": f"WITH {EMB}, {emb_pairs('p3')} {wide_distances('nn', 'vec_id')}",
        "knn_metric_chebyshev": f"WITH {EMB}, {emb_pairs('inf')} {wide_distances('nn', 'vec_id')}",
        "knn_join_new": f"WITH {CUSTOMER_SCALED}, {xy_pairs('s', 'c', 'nn')} {wide_distances('nn', 'id')}",
        "knn_join_pivot": f"""WITH {PART_SCALED}, p AS (SELECT p_partkey AS id, x, y FROM x),
            {xy_pairs('p', 'p', 'nn')} {wide_distances('nn', 'p_partkey')}""",
        "knn_self_pivot": f"""WITH {PART_SCALED}, p AS (SELECT p_partkey AS id, x, y FROM x),
            {xy_pairs('p', 'p', 'nn', True)} {wide_distances('nn', 'p_partkey')}""",
        "knn_score_max": knn_score_sql("max(d)", 5),
        "knn_score_average": knn_score_sql("avg(d)", 5),
        "knn_score_median": knn_score_sql("median(d)", 6),
        "flag_knn": f"""WITH {EMB}, {emb_pairs()}, {emb_pairs(with_self=True)},
            t AS (SELECT quantile_cont(d, 0.9) AS cut FROM nn WHERE k = 5)
            SELECT id AS vec_id, round(d, 6) AS score, d > cut AS flag FROM nn_all, t WHERE k = 5""",
        "flag_knn_events": """WITH raw AS (SELECT event_id, value AS x,
                    CAST(json_extract(props, '$.k') AS DOUBLE) AS y FROM events),
            w AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM raw),
            x AS (SELECT event_id, (x - x0) / (x1 - x0) AS x, (y - y0) / (y1 - y0) AS y FROM raw, w),
            n AS (SELECT a.event_id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS d
                  FROM x a, x b GROUP BY a.event_id),
            t AS (SELECT quantile_cont(d[6], 0.9) AS cut FROM n)
            SELECT event_id, round(d[5], 6) AS score, d[5] > cut AS flag FROM n, t""",
        "lof_score": f"""WITH {EMB}, {emb_pairs()}, {lof_ctes("nn")}
            SELECT id AS vec_id, round(score, 6) AS score FROM lof""",
        "flag_lof": f"""WITH {EMB}, {emb_pairs()}, {emb_pairs(with_self=True)}, {lof_ctes("nn", "nn_all")},
            t AS (SELECT quantile_cont(score, 0.9) AS cut FROM lof)
            SELECT id AS vec_id, round(score, 6) AS score, score > cut AS flag FROM lofn, t""",
        "flag_new_lof": f"""WITH {CUSTOMER_SCALED}, {xy_pairs("c", "c", "tr", True)},
            {xy_pairs("s", "c", "nw")}, {lof_ctes("tr", "nw")},
            t AS (SELECT quantile_cont(score, 0.9) AS cut FROM lof)
            SELECT id, round(score, 6) AS score, score > cut AS flag FROM lofn, t""",
        "reconstruction_mae": """
            WITH u AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS e,
                              generate_subscripts(embedding, 1) AS j FROM embeddings),
            m AS (SELECT j, avg(e) AS mean FROM u GROUP BY j)
            SELECT vec_id, round(avg(abs(e - mean)), 6) AS mae FROM u JOIN m USING (j) GROUP BY vec_id""",
        "split_json_source": f"""
            SELECT CAST(vec_id AS VARCHAR) AS request_id, CAST(pos AS INTEGER) AS pos, {split_cells}
            FROM embeddings, range(0, 16) t(pos)""",
        "csv_source": """
            SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, round(p_retailprice, 6) AS p_retailprice
            FROM part""",
        "validate_columns": f"""WITH {REQUESTS_SQL}
            SELECT request_id, 'columns are not those of the model' AS error_columns FROM chk WHERE NOT same""",
        "validate_rows": f"""WITH {REQUESTS_SQL}
            SELECT request_id, CASE WHEN len(lengths) = 0 THEN 'no rows'
                        WHEN len(lengths) > 1 THEN 'rows differ in length'
                        ELSE 'rows have ' || lengths[1] || ' cells for ' || width || ' columns' END AS error_data
            FROM chk WHERE len(lengths) <> 1 OR lengths[1] <> width""",
        "rejected_requests": f"""WITH {REQUESTS_SQL}
            SELECT request_id,
                   CASE WHEN same THEN '' ELSE 'columns are not those of the model' END AS error_columns,
                   CASE WHEN len(lengths) = 0 THEN 'no rows'
                        WHEN len(lengths) > 1 THEN 'rows differ in length'
                        WHEN lengths[1] = width THEN ''
                        ELSE 'rows have ' || lengths[1] || ' cells for ' || width || ' columns' END AS error_data
            FROM chk
            WHERE CAST(request_id AS BIGINT) % 7 <> 6 AND (NOT same OR len(lengths) <> 1 OR lengths[1] <> width)
            UNION ALL
            SELECT sha256('request ' || request_id), '', 'not a request'
            FROM chk WHERE CAST(request_id AS BIGINT) % 7 = 6""",
        "predict_requests": f"""WITH
            x AS (SELECT vec_id, CAST(pos AS INTEGER) AS pos, {exact_cells}
                  FROM embeddings, range(0, 16) t(pos)),
            m AS (SELECT {", ".join(f"avg({c}) AS m{c}, stddev_pop({c}) AS s{c}" for c in CELLS)} FROM x),
            d AS (SELECT vec_id, pos, sqrt({" + ".join(f"power(({c} - m{c}) / s{c}, 2)" for c in CELLS)}) AS score
                  FROM x, m)
            SELECT '007' AS model_id, '1' AS prediction_id, CAST(vec_id AS VARCHAR) AS request_id, pos,
                   'kmeans' AS detector, round(score, 6) AS score,
                   score > (SELECT quantile_cont(score, 0.9) FROM d) AS flag
            FROM d WHERE vec_id % 7 = 0""",
        "feature_null_skip": f"""WITH raw AS (SELECT p_partkey, CAST(nullif(p_size, 10) AS DOUBLE) AS x,
                                                  p_retailprice AS y FROM part),
            x AS (SELECT * FROM raw WHERE x IS NOT NULL), {centre_cte("x", "p_partkey")},
            f AS ({flagged("km", "p_partkey")})
            SELECT p_partkey, score, flag FROM raw LEFT JOIN f USING (p_partkey)""",
        "state_round_trip": f"""WITH {PART_XY},
            m AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy FROM x),
            g AS (SELECT p_partkey, exp(-0.5 * ln(2 * pi() * vx) - (x - mx) * (x - mx) / (2 * vx)
                    - 0.5 * ln(2 * pi() * vy) - (y - my) * (y - my) / (2 * vy)) AS p FROM x, m),
            s AS (SELECT min(p) + (max(p) - min(p)) / 100000000 AS eps FROM g)
            SELECT p_partkey, round(p, 12) AS p, p < eps AS flag FROM g, s""",
        "prediction_table": f"""WITH raw AS (SELECT event_id, value AS x,
                    CAST(json_extract(props, '$.k') AS DOUBLE) AS y FROM events),
            w AS (SELECT avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM raw),
            x AS (SELECT event_id, (x - mx) / sx AS x, (y - my) / sy AS y FROM raw, w),
            km AS (SELECT event_id, sqrt(x * x + y * y) AS score FROM x),
            g AS (SELECT event_id, exp(-ln(2 * pi()) - x * x / 2 - y * y / 2) AS score FROM x),
            s AS (SELECT min(score) + (max(score) - min(score)) / 100000000 AS eps FROM g),
            f AS (SELECT event_id, 'gaussian_distribution' AS detector, round(score, 6) AS score,
                         score < eps AS flag FROM g, s
                  UNION ALL SELECT event_id, 'kmeans', score, flag FROM ({flagged("km", "event_id")}))
            SELECT 'events' AS model_id, 'first' AS prediction_id, event_id, detector, score, flag FROM f""",
        "flag_all": flag_all_sql(),
        "pipeline_round_trip": flag_all_sql(),
        "stream_score": f"""WITH raw AS (SELECT event_id, value AS x,
                    CAST(json_extract(props, '$.k') AS DOUBLE) AS y FROM events),
            w AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM raw),
            x AS (SELECT event_id, (x - x0) / (x1 - x0) AS x, (y - y0) / (y1 - y0) AS y FROM raw, w),
            {mahalanobis_cte("x", "event_id")},
            m AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy FROM x),
            g AS (SELECT event_id, exp(-0.5 * ln(2 * pi() * vx) - (x - mx) * (x - mx) / (2 * vx)
                    - 0.5 * ln(2 * pi() * vy) - (y - my) * (y - my) / (2 * vy)) AS score FROM x, m),
            s AS (SELECT min(score) + (max(score) - min(score)) / 100000000 AS eps FROM g)
            SELECT event_id, 'gaussian_distribution' AS detector, round(score, 6) AS score,
                   score < eps AS flag FROM g, s
            UNION ALL SELECT event_id, 'pca_mahalanobis', score, flag FROM ({flagged("maha", "event_id")})""",
        "knn_self_wide": f"WITH {EMB}, {emb_pairs()} {wide_distances('nn', 'vec_id')}",
        "knn_self_deep": f"""WITH {PART_SCALED}, p AS (SELECT p_partkey AS id, x, y FROM x),
            {xy_pairs('p', 'p', 'nn', True)} {wide_distances('nn', 'p_partkey')}""",
        "kmeans_elbow_all": f"""WITH {PART_SCALED}
            SELECT CAST(k AS INTEGER) AS k, count(*) AS rows, round(sum(x * x + y * y), 4) AS squares, true AS rests
            FROM x, range(1, 100) t(k) GROUP BY k""",
        "kmeans_default": invariants_sql("customer"),
        "svm_invariants": invariants_sql("events"),
        "forest_invariants": invariants_sql("events"),
        "autoencoder_invariants": invariants_sql("embeddings"),
        "threshold_merged": "SELECT count(*) AS n_rows, true AS within FROM lineitem",
        "pca_share_two": f"""WITH {PART_SCALED},
            q AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS c,
                         0.5 * atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) AS t FROM x),
            f AS (SELECT p_partkey, abs((x - mx) * cos(t) + (y - my) * sin(t))
                         / sqrt((a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c * c)) AS score FROM x, q)
            {flagged("f", "p_partkey")}""",
        "merged_statistics": """
            WITH u AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS e,
                              generate_subscripts(embedding, 1) - 1 AS j FROM embeddings)
            SELECT 'f' || x.j AS a, 'f' || y.j AS b, round(covar_samp(x.e, y.e), 9) AS cov, count(*) AS n_rows
            FROM u x JOIN u y ON x.vec_id = y.vec_id AND x.j <= y.j GROUP BY x.j, y.j""",
        "stream_score_joins": f"""WITH {CUSTOMER_SCALED}, {xy_pairs("c", "c", "tr", True)}, {xy_pairs("c", "c", "nw")},
            kt AS (SELECT id, d AS score FROM tr WHERE k = 5), kn AS (SELECT id, d AS score FROM nw WHERE k = 5),
            {lof_ctes("tr", "nw")}
            SELECT id, 'knearest_neighbors' AS detector, round(score, 6) AS score,
                   score > (SELECT quantile_cont(score, 0.9) FROM kt) AS flag FROM kn
            UNION ALL SELECT id, 'local_outlier_factor', round(score, 6),
                   score > (SELECT quantile_cont(score, 0.9) FROM lof) FROM lofn""",
        "state_replaced": f"""WITH {PART_SCALED}, {centre_cte("x", "p_partkey")},
            z AS (SELECT p_partkey, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x,
                         (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS y FROM raw),
            o AS (SELECT p_partkey, sqrt(x * x + y * y) AS score FROM z)
            SELECT p_partkey, round(o.score, 6) AS old, o.score > (SELECT quantile_cont(score, 0.9) FROM o) AS old_flag,
                   round(km.score, 6) AS new, km.score > (SELECT quantile_cont(score, 0.9) FROM km) AS new_flag,
                   true AS created_kept, 1 AS later
            FROM o JOIN km USING (p_partkey)""",
        "fit_side_by_side": """
            SELECT detector, 4 AS total, true AS same, (SELECT count(*) FROM part) AS n_rows
            FROM (VALUES ('pca_mahalanobis'), ('kmeans'), ('isolation_forest'), ('one_class_svm')) t(detector)""",
    }
