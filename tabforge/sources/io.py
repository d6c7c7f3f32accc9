"""Sources and sinks: CSV with explicit schema, optional external table,
prediction sink, parameter and metadata JSON, model persistence, prediction log."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = ["Time_spent_Alone", "Social_event_attendance", "Going_outside", "Friends_circle_size", "Post_frequency"]
CATEGORICAL = ["Stage_fear", "Drained_after_socializing"]


def survey_schema(with_target: bool = True, id_col: str = "id") -> T.StructType:
    fields = [T.StructField(id_col, T.LongType())]
    fields += [T.StructField(c, T.DoubleType()) for c in NUMERIC]
    fields += [T.StructField(c, T.StringType()) for c in CATEGORICAL]
    if with_target:
        fields.append(T.StructField("Personality", T.StringType()))
    return T.StructType(fields)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV scan with a declared schema (no inference pass); empty fields are NULL.

    Columns are found by their header names, in any order; further columns are ignored, a missing
    one raises. A field that is no value of its column's type raises when it is read.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no columns {missing}")
    return raw.select(*[F.expr(f"CAST(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in schema])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that Spark knows is there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _join(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def read_external(spark: SparkSession, path: str | None, keys: Sequence[str], value: str = "Personality") -> DataFrame | None:
    """External lookup table, or None when no path is given (the enrichment column is
    then all NULL, see ``enrich_missing_source``). A path that is not there raises."""
    if path is None:
        return None
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    schema = T.StructType([f for f in survey_schema(True).fields if f.name in (*keys, value)])
    return read_csv(spark, path, schema)


def write_predictions(df: DataFrame, path: str, id_col: str = "id", label_col: str = "Personality", fmt: str = "csv") -> None:
    out = df.select(id_col, label_col)
    if fmt == "csv":
        out.write.mode("overwrite").option("header", True).csv(path)
    else:
        out.write.mode("overwrite").parquet(path)


def save_params(spark: SparkSession, params: dict, name: str, params_dir: str) -> str:
    """Best parameters of ``name`` as a one-row JSON table (values as strings)."""
    path = _join(params_dir, f"{name}_best_params")
    row = [(name, json.dumps(params, sort_keys=True))]
    spark.createDataFrame(row, "model string, params string").coalesce(1).write.mode("overwrite").json(path)
    return path


def load_params(spark: SparkSession, name: str, params_dir: str) -> dict | None:
    path = _join(params_dir, f"{name}_best_params")
    if not path_exists(spark, path):
        return None
    row = spark.read.schema("model string, params string").json(path).first()
    return None if row is None else json.loads(row["params"])


def model_version(spark: SparkSession, path: str) -> int | None:
    """The latest version under ``path`` whose manifest is written, or None."""
    if not path_exists(spark, _join(path, "manifest")):
        return None
    return spark.read.schema("kind string, version int").json(_join(path, "manifest")).agg(F.max("version")).first()[0]


def save_model(model, path: str) -> int:
    """Save a pyspark.ml pipeline, a stack, a soft vote or a blend as a new version under ``path``.

    The model's files come first and its manifest, which readers follow, last: a reader never sees half
    a model, and a writer that lost a race for a version gets an error. Returns the version.
    """
    spark = SparkSession.getActiveSession()
    version = (model_version(spark, path) or 0) + 1
    folder = _join(path, f"v{version}")
    if hasattr(model, "write"):
        model.write().overwrite().save(folder)
    else:
        model.save(folder)
    row = spark.createDataFrame([(type(model).__name__,)], "kind string")
    row.coalesce(1).write.mode("error").json(_join(path, f"manifest/version={version}"))
    return version


def load_model(path: str, version: int | None = None):
    """The model of ``version`` (the latest by default) under ``path``."""
    from pyspark.ml import PipelineModel

    from tabforge.models.stacking import BlendModel, SoftVoteModel, StackingModel

    spark = SparkSession.getActiveSession()
    latest = model_version(spark, path)
    if latest is None:
        raise FileNotFoundError(f"no saved model under {path}")
    version = version or latest
    kind = spark.read.schema("kind string").json(_join(path, f"manifest/version={version}")).first()["kind"]
    own = {m.__name__: m for m in (BlendModel, SoftVoteModel, StackingModel)}
    folder = _join(path, f"v{version}")
    return own[kind].load(spark, folder) if kind in own else PipelineModel.load(folder)


def model_metadata(
    spark: SparkSession,
    name: str,
    model_type: str,
    n_rows: int,
    features: Sequence[str],
    classes: Sequence[str],
    best_params: dict | None = None,
    estimators: Sequence[str] = (),
) -> DataFrame:
    """One row that describes a model; parameter values are strings."""
    schema = T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("model_type", T.StringType()),
            T.StructField("n_training_rows", T.LongType()),
            T.StructField("features", T.ArrayType(T.StringType())),
            T.StructField("classes", T.ArrayType(T.StringType())),
            T.StructField("label_map", T.MapType(T.StringType(), T.StringType())),
            T.StructField("best_params", T.MapType(T.StringType(), T.StringType())),
            T.StructField("estimators", T.ArrayType(T.StringType())),
        ]
    )
    params = {k: str(v) for k, v in (best_params or {}).items()}
    row = (name, model_type, int(n_rows), list(features), list(classes), {str(i): c for i, c in enumerate(classes)}, params, list(estimators))
    return spark.createDataFrame([row], schema)


def write_metadata(meta: DataFrame, path: str) -> None:
    meta.coalesce(1).write.mode("overwrite").json(path)


def append_prediction_log(scored: DataFrame, path: str, inputs: Sequence[str], result_cols: Sequence[str]) -> None:
    """Append ``{timestamp, input, result}`` rows (nested maps) to a parquet log."""
    log = scored.select(
        F.current_timestamp().alias("timestamp"),
        F.create_map(*[x for c in inputs for x in (F.lit(c), F.col(c).cast("string"))]).alias("input"),
        F.create_map(*[x for c in result_cols for x in (F.lit(c), F.col(c).cast("string"))]).alias("result"),
    )
    log.write.mode("append").parquet(path)


def resolve_model(spark: SparkSession, models_dir: str, name: str = "ensemble") -> str:
    """Model lookup with ordered fallbacks: the name, then stack_A..stack_F; only models with a manifest count."""
    candidates = [name] + [f"stack_{s}" for s in "ABCDEF"]
    for c in candidates:
        p = _join(models_dir, c)
        if model_version(spark, p) is not None:
            return p
    raise FileNotFoundError(f"no model under {models_dir} (tried {candidates})")
