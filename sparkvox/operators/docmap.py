"""Document map and clusters (group F): unit vectors, k-means for a range
of k, nearest centroid, 2-D coordinates.

Spark ML does the iterative work (KMeans, PCA) over one cached input. The zero
vector has no direction: it takes no part in a fit, and its label and
coordinates are NULL.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvox.functions import lexicon as L
from sparkvox.functions import vectors as V
from sparkvox.session import ship_package


def l2_normalize(df: DataFrame, vec_col: str = "embedding", out_col: str | None = None) -> DataFrame:
    """embedding / |embedding| so that Euclidean distance follows cosine.
    The zero vector gives NULL elements (no NaN)."""
    return df.withColumn(out_col or vec_col, V.l2_normalize(F.col(vec_col)))


def _directed(vec_col: str) -> F.Column:
    """Whether a vector has a direction: not NULL, not zero."""
    return F.coalesce(V.norm(F.col(vec_col)) > 0, F.lit(False))


def _features(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return l2_normalize(df.filter(_directed(vec_col)).select(id_col, vec_col), vec_col).select(
        id_col, array_to_vector(vec_col).alias("features")
    )


def kmeans_fits(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                max_cluster: int = L.MAX_CLUSTER, seed: int = L.KMEANS_SEED,
                parallelism: int = 4) -> dict[int, object]:
    """k-means models for every k in 2..max_cluster on unit vectors (Spark's
    k-means|| initialisation, fixed seed). A model can be saved with
    ``model.save(path)`` and used on documents that come later."""
    if isinstance(max_cluster, bool) or not isinstance(max_cluster, int) or max_cluster < 2:
        raise ValueError("the largest number of groups must be a whole number from 2 up")
    feats = _features(df, id_col, vec_col).persist()
    # The fits are independent Spark jobs: submit them from a few driver
    # threads so small fits share the executors (as CrossValidator's
    # ``parallelism`` does).
    def fit(k: int):
        return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="label").fit(feats)

    ks = list(range(2, max_cluster + 1))
    try:
        with ThreadPoolExecutor(max_workers=min(parallelism, len(ks))) as pool:
            return dict(zip(ks, pool.map(fit, ks), strict=True))
    finally:
        feats.unpersist()


def kmeans_labels(df: DataFrame, models: dict[int, object], id_col: str = "vec_id",
                  vec_col: str = "embedding") -> DataFrame:
    """Long table ``(id, k, label)`` of all models, in one pass over the
    vectors; NULL labels for vectors without a direction."""
    labelled = _features(df, id_col, vec_col)
    for k, model in models.items():
        labelled = model.copy().setPredictionCol(f"_k{k}").transform(labelled)

    def long(rows: DataFrame, label) -> DataFrame:
        each = F.array(*[F.struct(F.lit(k).alias("k"), label(k).cast("int").alias("label")) for k in models])
        return rows.select(id_col, F.explode(each).alias("c")).select(id_col, "c.k", "c.label")

    rest = df.filter(~_directed(vec_col)).select(id_col)
    return long(labelled, lambda k: F.col(f"_k{k}")).unionByName(long(rest, lambda k: F.lit(None)))


def kmeans_all_k(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                 max_cluster: int = L.MAX_CLUSTER, seed: int = L.KMEANS_SEED,
                 parallelism: int = 4) -> DataFrame:
    """Labels for every k in 2..max_cluster: ``(id, k, label)``."""
    return kmeans_labels(df, kmeans_fits(df, id_col, vec_col, max_cluster, seed, parallelism), id_col, vec_col)


def nearest_of_all(df: DataFrame, models: dict[int, object], id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, k, closest)``: the labels of the centres of every model that are
    closest to a row, several where they are equally near up to rounding. One
    pass: one matrix product per batch with the centres of all models."""
    ship_package(df.sparkSession)
    ks = list(models)
    centres = [np.array(models[k].clusterCenters(), dtype=np.float64) for k in ks]
    every = np.vstack(centres)
    ends = np.cumsum([0, *map(len, centres)])

    @F.pandas_udf("array<struct<k:int,closest:array<int>>>")
    def closest(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy()).astype(np.float64)
        d = (x * x).sum(axis=1)[:, None] - 2 * x @ every.T + (every * every).sum(axis=1)
        out = [[] for _ in range(len(x))]
        for k, s, e in zip(ks, ends[:-1], ends[1:], strict=True):
            near = d[:, s:e] <= d[:, s:e].min(axis=1, keepdims=True) + 1e-9
            for row, flags in zip(out, near, strict=True):
                row.append({"k": k, "closest": np.flatnonzero(flags).tolist()})
        return pd.Series(out)

    unit = l2_normalize(df.filter(_directed(vec_col)).select(id_col, vec_col), vec_col)
    return unit.select(id_col, F.explode(closest(F.col(vec_col))).alias("c")).select(id_col, "c.k", "c.closest")


def nearest_centroid(df: DataFrame, centroids: DataFrame, id_col: str = "vec_id",
                     vec_col: str = "embedding") -> DataFrame:
    """Assign every row to its closest centroid (squared Euclidean; the least
    label on ties), NULL for a vector without a direction. The rows of
    ``centroids(label, vector)`` go with each task as one matrix; distances are
    computed a centroid at a time on Arrow batches, so memory does not depend
    on their number."""
    rows = sorted((r[0], r[1]) for r in centroids.select("label", "vector").collect() if None not in r[1])
    labels = np.array([r[0] for r in rows])
    mat = np.array([r[1] for r in rows], dtype=np.float64)
    ship_package(df.sparkSession)

    @F.pandas_udf("long")
    def closest(vectors: pd.Series) -> pd.Series:
        x = np.array([np.asarray(v, dtype=np.float64) for v in vectors]).reshape(len(vectors), mat.shape[1])
        best, at = np.full(len(x), np.inf), np.full(len(x), -1)
        for i, c in enumerate(mat):
            d = ((x - c) ** 2).sum(axis=1)
            nearer = d < best
            best[nearer], at[nearer] = d[nearer], i
        return pd.Series([int(labels[i]) if i >= 0 else None for i in at], dtype="Int64")

    kind = centroids.schema["label"].dataType
    some = _directed(vec_col) & ~F.exists(F.col(vec_col), lambda e: e.isNull())
    found = df.filter(some).select(id_col, closest(F.col(vec_col)).cast(kind).alias("label"))
    return found.unionByName(df.filter(~some).select(id_col, F.lit(None).cast(kind).alias("label")))


def labels_for_k(clusters: DataFrame, k: int) -> DataFrame:
    """The labelling for one k; on a table partitioned by k this prunes to
    one directory."""
    return clusters.filter(F.col("k") == k)


def fit_map(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding"):
    """The PCA model of the map; ``model.save(path)`` keeps it for later documents."""
    return PCA(k=2, inputCol="features", outputCol="pc").fit(_features(df, id_col, vec_col))


def document_map_2d(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", model=None) -> DataFrame:
    """2-D coordinates from a distributed PCA of the unit vectors (a given or
    a new model). Each axis sign is fixed so its largest-magnitude loading is
    positive. NULL for vectors without a direction."""
    model = model or fit_map(df, id_col, vec_col)
    pcs = model.pc.toArray()  # d x 2, bounded by the vector width
    signs = [1.0 if pcs[np.argmax(np.abs(pcs[:, j])), j] >= 0 else -1.0 for j in range(2)]
    out = model.transform(_features(df, id_col, vec_col)).withColumn("xy", vector_to_array("pc"))
    placed = out.select(id_col, (F.col("xy")[0] * signs[0]).alias("x"), (F.col("xy")[1] * signs[1]).alias("y"))
    none = F.lit(None).cast("double")
    return placed.unionByName(df.filter(~_directed(vec_col)).select(id_col, none.alias("x"), none.alias("y")))
