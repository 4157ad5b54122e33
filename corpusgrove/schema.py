"""Corpus and result schemas, plus typed parameter sets (H4)."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

# Roles a loader may map from a source column (text is required).
OPTIONAL_ROLES = ("ts", "ref", "target", "predict", "distance", "set")
VECTOR_ROLES = ("embedding", "reduced", "x", "y", "z")

CORPUS_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType(), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType()), True),
    T.StructField("reduced", T.ArrayType(T.DoubleType()), True),
    T.StructField("x", T.DoubleType(), True),
    T.StructField("y", T.DoubleType(), True),
    T.StructField("ts", T.TimestampNTZType(), True),
    T.StructField("ref", T.StringType(), True),
    T.StructField("target", T.IntegerType(), True),
    T.StructField("predict", T.IntegerType(), True),
    T.StructField("distance", T.DoubleType(), True),
    T.StructField("set", T.StringType(), False),
])

CORPUS_COLUMNS = [f.name for f in CORPUS_SCHEMA.fields]

# Spark type each role is cast to after load.
ROLE_TYPES = {
    "text": T.StringType(),
    "ts": T.TimestampNTZType(),
    "ref": T.StringType(),
    "target": T.IntegerType(),
    "predict": T.IntegerType(),
    "distance": T.DoubleType(),
    "set": T.StringType(),
    "x": T.DoubleType(),
    "y": T.DoubleType(),
    "z": T.DoubleType(),
}

GROUP_SUMMARY_SCHEMA = T.StructType([
    T.StructField("group", T.IntegerType(), False),
    T.StructField("mean", T.ArrayType(T.DoubleType()), True),
    T.StructField("x", T.DoubleType(), True),
    T.StructField("y", T.DoubleType(), True),
    T.StructField("count", T.LongType(), False),
    T.StructField("distance", T.DoubleType(), True),
    T.StructField("max_dist", T.DoubleType(), True),
    T.StructField("rel_size", T.DoubleType(), True),
    T.StructField("repr_id", T.LongType(), True),
    T.StructField("repr_text", T.StringType(), True),
])


@dataclass
class EmbeddingParams:
    """Encoder choice. ``model`` names a plug-in encoder; the default
    ``hashing`` encoder needs no weights."""
    model: str = "hashing"
    num_features: int = 1 << 18
    dim: int = 64
    seed: int = 42
    min_doc_freq: int = 1


@dataclass
class ReductionParams:
    """D4-D6. ``method`` is linear (principal or supervised axes) or graph (spectral
    coordinates of the kNN graph: ``n_neighbors``, ``metric``, ``random_state``)."""
    method: str = "linear"
    n_components: int = 10
    n_neighbors: int = 15
    metric: str = "euclidean"
    target_weight: float = 0.5
    random_state: int = 42


@dataclass
class ClusteringParams:
    """D11 parameters, defaults as offered by the reference's form."""
    min_cluster_size: int = 5
    min_samples: int | None = None
    metric: str = "euclidean"
    cluster_selection_method: str = "eom"
    alpha: float = 1.0
    cluster_selection_epsilon: float = 0.0
    # kNN cells hold at most 4 x this many candidates (hot cells are split)
    knn_block_size: int = 512
    # tree edges that one task finishes by itself when the hierarchy is built
    local_edges: int = 2048


@dataclass
class ModelParams:
    """H4: one parameter set per stage, stored with the bundle."""
    embedding: EmbeddingParams = field(default_factory=EmbeddingParams)
    reduction: ReductionParams = field(default_factory=ReductionParams)
    clustering: ClusteringParams = field(default_factory=ClusteringParams)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> "ModelParams":
        d = d or {}
        return cls(
            embedding=EmbeddingParams(**d.get("embedding", {})),
            reduction=ReductionParams(**d.get("reduction", {})),
            clustering=ClusteringParams(**d.get("clustering", {})),
        )
