"""Serving-side projections: feature contract, defaults, decoding, tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Serving defaults for missing answers, in feature order.
ANSWER_DEFAULTS = {
    "Time_spent_Alone": 2.0,
    "Social_event_attendance": 4.0,
    "Going_outside": 3.0,
    "Friends_circle_size": 8.0,
    "Post_frequency": 3.0,
}
# Profile dimensions (column, default, scale) and the Stage_fear weights.
DIMENSION_DEFAULTS = {"Time_spent_Alone": 12.0, "Post_frequency": 10.0, "Going_outside": 7.0, "Friends_circle_size": 25.0}
DIMENSION_SCALES = {"Time_spent_Alone": 24.0, "Post_frequency": 20.0, "Going_outside": 15.0, "Friends_circle_size": 50.0}
DECISION_YES, DECISION_NO = 0.8, 0.3
HIGH_ABOVE, MEDIUM_ABOVE = 0.7, 0.5

CONTRACT = [
    "Time_spent_Alone", "Social_event_attendance", "Going_outside", "Friends_circle_size", "Post_frequency",
    "Stage_fear_No", "Stage_fear_Unknown", "Stage_fear_Yes",
    "Drained_after_socializing_No", "Drained_after_socializing_Unknown", "Drained_after_socializing_Yes",
    "match_p_Extrovert", "match_p_Introvert", "match_p_Unknown",
]


def serve_features(raw: DataFrame, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """Raw answers -> the 14-feature contract: numeric defaults, one-hot of the
    two answers (only exact No/Unknown/Yes light up), match_p fixed to Unknown."""
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(v)).alias(c) for c, v in ANSWER_DEFAULTS.items()]
    for c in ("Stage_fear", "Drained_after_socializing"):
        for v in ("No", "Unknown", "Yes"):
            cols.append(F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)).alias(f"{c}_{v}"))
    cols += [F.lit(0.0).alias("match_p_Extrovert"), F.lit(0.0).alias("match_p_Introvert"), F.lit(1.0).alias("match_p_Unknown")]
    return raw.select(*keep, *cols)


def confidence_tier(conf: Column) -> Column:
    return F.when(conf > HIGH_ABOVE, "High").when(conf > MEDIUM_ABOVE, "Medium").otherwise("Low")


def profile_dimensions(df: DataFrame, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    def dim(c):
        return F.lit(1.0) - F.coalesce(F.col(c), F.lit(DIMENSION_DEFAULTS[c])) / F.lit(DIMENSION_SCALES[c])

    decision = F.when(F.coalesce(F.col("Stage_fear_Yes"), F.lit(0.0)) != 0, F.lit(DECISION_YES)).otherwise(F.lit(DECISION_NO))
    return df.select(
        *keep,
        dim("Time_spent_Alone").alias("social_energy"),
        dim("Post_frequency").alias("processing_style"),
        decision.alias("decision_making"),
        dim("Going_outside").alias("lifestyle"),
        dim("Friends_circle_size").alias("communication"),
    )


def score_batch(
    model,
    df: DataFrame,
    features: Sequence[str],
    classes: Sequence[str],
    keep: Sequence[str] = ("row_id",),
    model_name: str | None = None,
    model_version: int | None = None,
) -> DataFrame:
    """Align -> assemble -> predict -> per-class probabilities, confidence, label, tier and, if they are
    given, the model's name and version. A blend's or a vote's probability is that of the second class."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from tabforge.operators.encode import align_features, label_decode

    aligned = align_features(df, features, keep=keep)
    x = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(aligned)
    scored = model.transform(x)
    second = next((c for c in ("p_blend", "vote") if c in scored.columns), None)
    prob = F.array(1 - F.col(second), F.col(second)) if second else vector_to_array("probability")
    out = scored.select(
        *keep,
        *[prob[i].alias(f"probability_{c.lower()}") for i, c in enumerate(classes)],
        F.array_max(prob).alias("confidence"),
        (F.array_position(prob, F.array_max(prob)) - 1).cast("int").alias("prediction"),
    )
    out = label_decode(out, "prediction", classes, out="predicted_label")
    out = out.withColumn("confidence_tier", confidence_tier(F.col("confidence")))
    if model_name is not None:
        out = out.withColumn("model_name", F.lit(model_name)).withColumn("model_version", F.lit(model_version).cast("int"))
    return out
