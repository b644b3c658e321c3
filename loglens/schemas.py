"""Table schemas and the fixed vocabulary of the log model."""

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
VALID_LEVELS = ["INFO", "WARN", "WARNING", "ERROR", "FATAL", "SEVERE", "FAILURE", "CRITICAL"]
#: Levels that count towards a window's error ratio.
RATIO_LEVELS = ["SEVERE", "ERROR", "FAILURE", "FATAL"]
#: Levels a representative line may fall back to (narrower on purpose).
FALLBACK_LEVELS = ["FATAL", "SEVERE", "ERROR"]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
NO_NODE = "SYSTEM"
NOISE = -1
WINDOW_SECONDS = 3600
# ----------------------------------------------------------------------------


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


_L, _I, _S, _D = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()

PARSED = _struct(
    ("line_id", _L), ("is_anomaly", _I), ("timestamp", _L), ("date", _S), ("node", _S),
    ("level", _S), ("component", _S), ("content", _S), ("event_id", _L), ("template", _S),
)

FEATURES_LONG = _struct(("window_id", _L), ("event_id", _L), ("n", _L))

WINDOWS = _struct(
    ("window_id", _L), ("window_start", _L), ("window_end", _L), ("total_logs", _L),
    ("anomaly_count", _L), ("error_ratio", _D), ("fatal_count", _L), ("severe_count", _L),
    ("unique_nodes", _L), ("unique_templates", _L), ("is_anomaly", _I),
)

SCORES = T.StructType(
    WINDOWS.fields + _struct(("anomaly_score", _D), ("predicted", _I)).fields
)

ALERTS = _struct(
    ("window_id", _L), ("window_start", _L), ("window_end", _L), ("anomaly_score", _D),
    ("anomaly_count", _L), ("total_logs", _L), ("severity", _S), ("top_template", _S),
    ("top_level", _S), ("cluster_id", _I), ("cluster_label", _S),
)

#: Dense (non per-template) inputs of the anomaly model.
DENSE_FEATURES = [
    "total_logs", "error_ratio", "fatal_count", "severe_count", "unique_nodes", "unique_templates",
]
#: Window columns that never enter the model.
META_COLUMNS = ["window_id", "window_start", "window_end", "is_anomaly", "anomaly_count"]

CLUSTERING_DOC = _struct(
    ("tfidf_silhouette", _D), ("minilm_silhouette", _D), ("tfidf_clusters", _L),
    ("tfidf_unique", _L), ("minilm_clusters", _L), ("minilm_unique", _L),
)
