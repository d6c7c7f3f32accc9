"""Survey-shaped views derived from the driver tables.

The reference works on a survey table (five numeric answers, two Yes/No
answers, a two-class target) plus an external lookup table. Both are derived
here from ``orders`` and ``lineitem`` so that every query's work grows with
the input tables. The SQL text below is the same definition, used by the
DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.functions.rng import hash_uniform
from tabforge.sources.tables import table

NUMERIC = ["Time_spent_Alone", "Social_event_attendance", "Going_outside", "Friends_circle_size", "Post_frequency"]
CATEGORICAL = ["Stage_fear", "Drained_after_socializing"]
FEATURES = NUMERIC + CATEGORICAL
TARGET = "Personality"
STACKS = ["A", "B", "C", "D", "E", "F"]
#: The account balance from which the lookup calls a respondent an introvert.
ACCOUNT = 4500.0


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, 5 numeric, 2 categorical, origin (train/test), Personality."""
    li = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.sum(F.col("l_quantity").cast("long")).alias("qty"),
            F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("disc"),
            F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("tax"),
            # distinct count over the bounded domain 0..15 as a 16-bit set: one
            # aggregation pass instead of the two-level distinct-aggregate plan
            F.bit_count(F.bit_or(F.expr("shiftleft(1, CAST(l_suppkey % 16 AS INT))"))).cast("long").alias("supp"),
        )
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    raw = o.join(li, o.o_orderkey == li.l_orderkey, "left").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderpriority").alias("pri"),
        F.col("o_orderstatus").alias("st"),
        F.floor(F.col("qty").cast("double") / F.col("n_lines") / 2).cast("double").alias("time_alone"),
        F.floor(F.col("disc").cast("double") / F.col("n_lines")).cast("double").alias("social"),
        F.floor(F.col("tax").cast("double") / F.col("n_lines")).cast("double").alias("going"),
        F.col("n_lines").cast("double").alias("friends"),
        F.col("supp").cast("double").alias("posts"),
    )
    rid = F.col("row_id")
    urgent = F.col("pri").isin("1-URGENT", "2-HIGH")

    def holed(mod, c):
        return F.when(rid % mod == 0, F.lit(None).cast("double")).otherwise(F.col(c))

    return raw.select(
        "row_id",
        holed(7, "time_alone").alias("Time_spent_Alone"),
        holed(11, "social").alias("Social_event_attendance"),
        holed(13, "going").alias("Going_outside"),
        holed(17, "friends").alias("Friends_circle_size"),
        holed(19, "posts").alias("Post_frequency"),
        F.when(rid % 9 == 0, F.lit(None).cast("string")).when(urgent, "Yes").otherwise("No").alias("Stage_fear"),
        F.when(F.col("st") == "F", "Yes").when(F.col("st") == "O", "No").alias("Drained_after_socializing"),
        F.when(rid % 4 == 0, "test").otherwise("train").alias("origin"),
        F.when(
            F.coalesce(F.col("time_alone"), F.lit(12.0)) + F.when(urgent, 3).otherwise(0) + rid % 5 >= 18,
            "Introvert",
        )
        .otherwise("Extrovert")
        .alias("Personality"),
    )


def external(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """External lookup: the answers of all rows as another source has them, 0 where a number is
    missing (so such rows find no match); row_id kept for keep-first. What it says about a
    respondent's type comes from that customer's account, not from the survey's own label."""
    s = base if base is not None else survey(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), "o_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    said = F.when(F.coalesce("c_acctbal", F.lit(0.0)) >= ACCOUNT, "Introvert").otherwise("Extrovert")
    said = o.join(c, "o_custkey", "left").select("row_id", said.alias(TARGET))
    own = s.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in NUMERIC}).select("row_id", *FEATURES)
    return own.join(said, "row_id").select("row_id", *FEATURES, TARGET)


def score_columns(df: DataFrame, id_col: str = "row_id", stacks=STACKS, confident: bool = False) -> DataFrame:
    """Hash-made model scores p_A..p_F in [0, 1) (stand-ins for OOF probabilities)."""
    cols = []
    for s in stacks:
        u = hash_uniform(id_col, s)
        if confident:
            u = F.when(u < 0.5, 2 * u * u).otherwise(1 - 2 * (1 - u) * (1 - u))
        cols.append(u.alias(f"p_{s}"))
    return df.select("*", *cols)


# ---------------------------------------------------------------- SQL (oracle)

SURVEY_SQL = """
li AS (
  SELECT l_orderkey,
         count(*)                                          AS n_lines,
         sum(CAST(l_quantity AS BIGINT))                   AS qty,
         sum(CAST(round(l_discount * 100) AS BIGINT))      AS disc,
         sum(CAST(round(l_tax * 100) AS BIGINT))           AS tax,
         count(DISTINCT l_suppkey % 16)                    AS supp
  FROM lineitem GROUP BY l_orderkey),
raw AS (
  SELECT o.o_orderkey AS row_id, o.o_orderpriority AS pri, o.o_orderstatus AS st,
         CAST(floor(CAST(qty AS DOUBLE) / n_lines / 2) AS DOUBLE) AS time_alone,
         CAST(floor(CAST(disc AS DOUBLE) / n_lines) AS DOUBLE)    AS social,
         CAST(floor(CAST(tax AS DOUBLE) / n_lines) AS DOUBLE)     AS going,
         CAST(n_lines AS DOUBLE)                                  AS friends,
         CAST(supp AS DOUBLE)                                     AS posts
  FROM orders o LEFT JOIN li ON o.o_orderkey = li.l_orderkey),
survey AS (
SELECT row_id,
       CASE WHEN row_id % 7  = 0 THEN NULL ELSE time_alone END AS Time_spent_Alone,
       CASE WHEN row_id % 11 = 0 THEN NULL ELSE social     END AS Social_event_attendance,
       CASE WHEN row_id % 13 = 0 THEN NULL ELSE going      END AS Going_outside,
       CASE WHEN row_id % 17 = 0 THEN NULL ELSE friends    END AS Friends_circle_size,
       CASE WHEN row_id % 19 = 0 THEN NULL ELSE posts      END AS Post_frequency,
       CASE WHEN row_id % 9 = 0 THEN NULL
            WHEN pri IN ('1-URGENT', '2-HIGH') THEN 'Yes' ELSE 'No' END AS Stage_fear,
       CASE st WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'No' END              AS Drained_after_socializing,
       CASE WHEN row_id % 4 = 0 THEN 'test' ELSE 'train' END           AS origin,
       CASE WHEN coalesce(time_alone, 12) + CASE WHEN pri IN ('1-URGENT', '2-HIGH') THEN 3 ELSE 0 END
                 + row_id % 5 >= 18 THEN 'Introvert' ELSE 'Extrovert' END AS Personality
FROM raw),
ext AS (
  SELECT row_id, coalesce(Time_spent_Alone, 0.0) AS Time_spent_Alone,
         coalesce(Social_event_attendance, 0.0) AS Social_event_attendance, coalesce(Going_outside, 0.0) AS Going_outside,
         coalesce(Friends_circle_size, 0.0) AS Friends_circle_size, coalesce(Post_frequency, 0.0) AS Post_frequency,
         Stage_fear, Drained_after_socializing,
         CASE WHEN coalesce(c_acctbal, 0) >= 4500 THEN 'Introvert' ELSE 'Extrovert' END AS Personality
  FROM survey JOIN orders ON o_orderkey = row_id LEFT JOIN customer ON c_custkey = o_custkey)
"""


def sql_uniform(id_expr: str, salt: str) -> str:
    return f"(CAST(('0x' || substr(md5(CAST({id_expr} AS VARCHAR) || ':{salt}'), 1, 8)) AS BIGINT) / 4294967296.0)"


def sql_hash_hex(id_expr: str, salt: str) -> str:
    return f"md5(CAST({id_expr} AS VARCHAR) || ':{salt}')"


def sql_normal(id_expr: str, salt: str) -> str:
    h = sql_hash_hex(id_expr, salt)
    n1 = f"CAST(('0x' || substr({h}, 1, 8)) AS BIGINT)"
    n2 = f"CAST(('0x' || substr({h}, 9, 8)) AS BIGINT)"
    return f"(sqrt(-2.0 * ln(({n1} + 1.0) / 4294967297.0)) * cos(2.0 * pi() * {n2} / 4294967296.0))"


def sql_scores(id_expr: str = "row_id", stacks=STACKS, confident: bool = False) -> str:
    parts = []
    for s in stacks:
        u = sql_uniform(id_expr, s)
        if confident:
            u = f"(CASE WHEN {u} < 0.5 THEN 2 * {u} * {u} ELSE 1 - 2 * (1 - {u}) * (1 - {u}) END)"
        parts.append(f"{u} AS p_{s}")
    return ", ".join(parts)
