"""vecloom: clustering and vector analytics expressed as Spark DataFrame plans.

Names load on first use, so that a worker that needs one module does not import them all.
"""

from importlib import import_module

_HOME = {
    "AgglomerativeClustering": "agglomerative",
    "CentroidModel": "kmeans",
    "ClusterSnapshot": "snapshot",
    "DBSCAN": "density",
    "EmbeddingCluster": "embedding",
    "EmbeddingReducer": "reduce",
    "HDBSCAN": "density",
    "HierarchicalSnapshot": "hierarchy",
    "KMeans": "kmeans",
    "MiniBatchKMeans": "kmeans",
    "calinski_harabasz_score": "metrics",
    "davies_bouldin_score": "metrics",
    "silhouette_score": "metrics",
}
__all__ = list(_HOME)


def __getattr__(name: str):
    if name in _HOME:
        return getattr(import_module(f"vecloom.operators.{_HOME[name]}"), name)
    raise AttributeError(f"module 'vecloom' has no attribute {name!r}")
