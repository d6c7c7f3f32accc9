"""Flagship preparation: enrich -> impute -> fill -> one-hot -> label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.operators.encode import domains, label_encode, one_hot
from tabforge.operators.enrich import enrich_match
from tabforge.operators.impute import SURVEY_STEPS, fill_global_median, fill_unknown, impute_chain
from tabforge.session import materialize
from tabforge.sources import fixture

CATEGORICAL_ENCODED = ["Stage_fear", "Drained_after_socializing", "match_p"]


def enriched_survey(spark: SparkSession, sf_dir: str, materialize_base: bool = False) -> DataFrame:
    """Survey ⟕ external lookup on the seven answers (NULL-safe).

    The survey appears twice in the plan (left side and lookup); both read
    the same aggregated-lineitem exchange, so by default it is not written out
    separately -- ``prep`` materializes the enriched table once."""
    base = fixture.survey(spark, sf_dir)
    base = materialize(base, materialize_base)
    ext = fixture.external(spark, sf_dir, base)
    return enrich_match(base, ext, fixture.FEATURES, fixture.TARGET, out="match_p")


def prep(
    df: DataFrame,
    numeric: Sequence[str] = fixture.NUMERIC,
    categorical: Sequence[str] = CATEGORICAL_ENCODED,
    target: str = fixture.TARGET,
    steps=SURVEY_STEPS,
    origin: str = "origin",
    materialize_input: bool = True,
) -> DataFrame:
    """Train and test rows together (``origin``) -> row_id, origin, label, features.

    Statistics use train ∪ test (transductive, as the reference does); the
    label is encoded on training rows only, with sorted classes.
    """
    numeric = [c for c in numeric if c in df.columns]
    categorical = [c for c in categorical if c in df.columns]
    train = F.col(origin) == "train"
    df = df.select("row_id", origin, target, *numeric, *categorical)
    df = materialize(df, materialize_input)
    # label classes (training rows) and one-hot levels (after the Unknown fill)
    # in one pass
    doms = domains(
        df.select(F.when(train, F.col(target)).alias(target), *[F.coalesce(F.col(c), F.lit("Unknown")).alias(c) for c in categorical]),
        [target, *categorical],
    )
    df = label_encode(df, target, classes=doms[target], out="label", where=train)
    df = impute_chain(df, steps)
    df = fill_unknown(df, categorical)
    df = one_hot(df, categorical, domain={c: doms[c] for c in categorical})
    df = fill_global_median(df, numeric)
    feats = [c for c in df.columns if c not in ("row_id", origin, target, "label")]
    return df.select("row_id", origin, "label", *feats)


def prep_survey(spark: SparkSession, sf_dir: str, materialize_input: bool = True) -> DataFrame:
    return prep(enriched_survey(spark, sf_dir), materialize_input=materialize_input)
