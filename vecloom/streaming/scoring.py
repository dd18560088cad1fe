"""Fitted models over streams: projections and assignments keep no state, so they run on any streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vecloom.operators.cluster import KMeans, predict_kmeans
from vecloom.operators.linalg import Pca, predict_pca


def stream_pca(model: Pca, stream: DataFrame) -> DataFrame:
    """row_id, features of a stream to row_id and scores."""
    return predict_pca(model, stream)


def stream_clusters(model: KMeans, stream: DataFrame) -> DataFrame:
    """row_id, features of a stream to row_id and cluster."""
    return predict_kmeans(model, stream)
