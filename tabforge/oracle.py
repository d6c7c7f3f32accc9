"""DuckDB SQL that defines, independently of the Spark code, what each
registered query must return. Used by the correctness gate and the tests."""

from __future__ import annotations

from tabforge.sources.fixture import FEATURES, NUMERIC, SURVEY_SQL

KEYS7 = FEATURES

# Fixed values, written out apart from the code under test: (target, source) of each imputation step.
SURVEY_STEPS = (
    ("Time_spent_Alone", "Social_event_attendance"),
    ("Time_spent_Alone", "Going_outside"),
    ("Social_event_attendance", "Going_outside"),
    ("Friends_circle_size", "Social_event_attendance"),
    ("Post_frequency", "Friends_circle_size"),
    ("Going_outside", "Social_event_attendance"),
    ("Friends_circle_size", "Going_outside"),
    ("Post_frequency", "Going_outside"),
)


def with_survey(body: str, extra_ctes: str = "") -> str:
    ctes = SURVEY_SQL.strip()
    if extra_ctes:
        ctes += ",\n" + extra_ctes.strip()
    return f"WITH {ctes}\n{body}"


DEDUP_CTE = f"""
dedup AS (
  SELECT {', '.join(KEYS7)}, arg_min(row_id, row_id) AS row_id, arg_min(Personality, row_id) AS Personality
  FROM ext GROUP BY ALL),
enriched AS (
  SELECT s.*, d.Personality AS match_p
  FROM survey s LEFT JOIN dedup d ON {' AND '.join(f's.{k} IS NOT DISTINCT FROM d.{k}' for k in KEYS7)})
"""


def bin_case(src: str, e: str) -> str:
    return (
        f"CASE WHEN {src} IS NULL THEN NULL WHEN {src} <= {e}[2] THEN 1 WHEN {src} <= {e}[3] THEN 2 "
        f"WHEN {src} <= {e}[4] THEN 3 ELSE 4 END"
    )


def edges_cte(name: str, src: str, rel: str, force_equal_width: bool = False) -> str:
    q = f"quantile_cont({src}, [0.0, 0.25, 0.5, 0.75, 1.0])"
    ew = f"[mn, mn + 1 * (mx - mn) / 4, mn + 2 * (mx - mn) / 4, mn + 3 * (mx - mn) / 4, mn + 4 * (mx - mn) / 4]"
    sel = ew if force_equal_width else f"CASE WHEN len(list_distinct(qs)) = 5 THEN qs ELSE {ew} END"
    return (
        f"{name} AS (SELECT {sel} AS e FROM "
        f"(SELECT {q} AS qs, min({src}) AS mn, max({src}) AS mx FROM {rel}))"
    )


def impute_ctes(start: str, steps=SURVEY_STEPS, prefix: str = "st") -> tuple[str, str]:
    """Chained CTEs for the sequential imputation; returns (ctes, last relation)."""
    ctes = []
    cur = start
    for i, (t, s) in enumerate(steps):
        e, b, m, nxt = f"{prefix}e{i}", f"{prefix}b{i}", f"{prefix}m{i}", f"{prefix}{i + 1}"
        ctes.append(edges_cte(e, s, cur))
        ctes.append(f"{b} AS (SELECT d.*, {bin_case('d.' + s, e + '.e')} AS __bin FROM {cur} d, {e})")
        ctes.append(f"{m} AS (SELECT __bin, median({t}) AS md FROM {b} WHERE __bin IS NOT NULL GROUP BY __bin)")
        ctes.append(
            f"{nxt} AS (SELECT b.* EXCLUDE (__bin, {t}), coalesce(b.{t}, m.md) AS {t} "
            f"FROM {b} b LEFT JOIN {m} m ON b.__bin = m.__bin)"
        )
        cur = nxt
    return ",\n".join(ctes), cur


def global_median_select(rel: str, cols, passthrough: str) -> str:
    fills = ", ".join(f"coalesce({c}, (SELECT median({c}) FROM {rel})) AS {c}" for c in cols)
    return f"SELECT {passthrough}, {fills} FROM {rel}"


def prep_sql() -> str:
    chain, last = impute_ctes("pin")
    onehot = []
    for c, levels in (
        ("Stage_fear", ["No", "Unknown", "Yes"]),
        ("Drained_after_socializing", ["No", "Unknown", "Yes"]),
    ):
        for v in levels:
            onehot.append(f"CAST(coalesce({c}, 'Unknown') = '{v}' AS DOUBLE) AS {c}_{v}")
    # match_p levels come from the data (sorted distinct after the Unknown fill)
    extra = f"""
{DEDUP_CTE.strip()},
cls AS (SELECT list_sort(list(DISTINCT Personality)) AS c FROM enriched WHERE origin = 'train'),
pin AS (SELECT e.row_id, e.origin,
               CASE WHEN e.origin = 'train' THEN CAST(list_position(cls.c, e.Personality) - 1 AS INTEGER) END AS label,
               {', '.join(NUMERIC)}, Stage_fear, Drained_after_socializing, match_p
        FROM enriched e, cls),
{chain},
fin AS (SELECT * FROM {last})
"""
    med = ", ".join(f"coalesce({c}, (SELECT median({c}) FROM fin)) AS {c}" for c in NUMERIC)
    mp = ", ".join(
        f"CAST(coalesce(match_p, 'Unknown') = '{v}' AS DOUBLE) AS match_p_{v}" for v in ["Extrovert", "Introvert", "Unknown"]
    )
    body = f"SELECT row_id, origin, label, {med}, {', '.join(onehot)}, {mp} FROM fin"
    return with_survey(body, extra)


CAT = ["Stage_fear", "Drained_after_socializing"]


def _unpivot_numeric(rel: str, side_expr: str = "NULL") -> str:
    parts = [
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v, {side_expr} AS side FROM {rel} WHERE {c} IS NOT NULL"
        for c in NUMERIC
    ]
    return " UNION ALL ".join(parts)


def _profile_sql() -> str:
    cols = ["row_id", *FEATURES, "origin", "Personality"]
    parts = [
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, "
        f"count(DISTINCT {c}) AS n_distinct FROM survey"
        for c in cols
    ]
    return with_survey(" UNION ALL ".join(parts))


def _edges_sql() -> str:
    parts = []
    for c in NUMERIC:
        q = f"quantile_cont({c}, [0.0, 0.25, 0.5, 0.75, 1.0])"
        parts.append(
            f"SELECT '{c}' AS feature, " + ", ".join(f"round({q}[{i + 1}], 6) AS e{i}" for i in range(5)) + " FROM survey"
        )
    return with_survey(" UNION ALL ".join(parts))


def _bins_sql(force_equal_width: bool) -> str:
    ctes = [edges_cte(f"e_{c}", c, "survey", force_equal_width) for c in NUMERIC]
    sel = ", ".join(f"{bin_case('s.' + c, f'e_{c}.e')} AS {c}_bin" for c in NUMERIC)
    frm = ", ".join(["survey s"] + [f"e_{c}" for c in NUMERIC])
    return with_survey(f"SELECT s.row_id, {sel} FROM {frm}", ",\n".join(ctes))


def _impute_one_sql() -> str:
    chain, last = impute_ctes("survey", [("Time_spent_Alone", "Social_event_attendance")])
    return with_survey(f"SELECT row_id, Time_spent_Alone FROM {last}", chain)


def _impute_chain_sql() -> str:
    chain, last = impute_ctes("survey")
    return with_survey(f"SELECT row_id, {', '.join(NUMERIC)} FROM {last}", chain)


def _ks_sql() -> str:
    extra = f"""
s AS ({_unpivot_numeric("survey", "CASE WHEN origin = 'train' THEN 1 ELSE 2 END")}),
c AS (SELECT feature, v, count(*) FILTER (WHERE side = 1) AS c1, count(*) FILTER (WHERE side = 2) AS c2
      FROM s GROUP BY feature, v),
cum AS (SELECT feature, v,
               sum(c1) OVER (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r1,
               sum(c2) OVER (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r2,
               sum(c1) OVER (PARTITION BY feature) AS n1, sum(c2) OVER (PARTITION BY feature) AS n2
        FROM c)
"""
    return with_survey(
        "SELECT feature, round(max(abs(r1 / n1 - r2 / n2)), 6) AS ks_stat, "
        "round(1 - max(abs(r1 / n1 - r2 / n2)), 6) AS similarity FROM cum GROUP BY feature",
        extra,
    )


def _diversity_sql() -> str:
    parts = [
        f"SELECT '{c}' AS feature, round(least(stddev_samp({c}) FILTER (WHERE origin = 'test') / "
        f"(stddev_samp({c}) FILTER (WHERE origin = 'train') + 1e-6), 2.0), 6) AS diversity FROM survey"
        for c in NUMERIC
    ]
    return with_survey(" UNION ALL ".join(parts))


def _numeric_stats_sql() -> str:
    parts = [
        f"SELECT '{c}' AS feature, round(median({c}), 6) AS median, round(min({c}), 6) AS min, "
        f"round(max({c}), 6) AS max, round(stddev_samp({c}), 6) AS std FROM survey"
        for c in NUMERIC
    ]
    return with_survey(" UNION ALL ".join(parts))


CLASS_BALANCE_CTE = """
cc AS (SELECT Personality, count(*) AS n FROM survey WHERE origin = 'train' AND Personality IS NOT NULL GROUP BY Personality),
cb AS (SELECT sum(n) AS n_rows, count(*) AS n_classes,
              arg_min(Personality, (n, Personality)) AS minority_class, min(n) AS minority_count,
              (SELECT Personality FROM cc ORDER BY n DESC, Personality LIMIT 1) AS majority_class,
              max(n) AS majority_count, round(min(n) / max(n), 6) AS balance_ratio
       FROM cc),
ch AS (SELECT n_rows AS n_samples, 7 AS n_features, balance_ratio AS class_balance_ratio,
              round(2.0 / 7, 6) AS categorical_ratio, n_rows < 5000 AS is_small_dataset,
              balance_ratio < 0.5 AS is_imbalanced, 2.0 / 7 > 0.3 AS is_highly_categorical FROM cb)
"""


def _scaled_sql(kind: str) -> str:
    med = ", ".join(f"coalesce({c}, (SELECT median({c}) FROM survey)) AS {c}" for c in NUMERIC)
    extra = f"f AS (SELECT row_id, {med} FROM survey)"
    if kind == "standard":
        sel = ", ".join(
            f"round(({c} - (SELECT avg({c}) FROM f)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1.0 "
            f"ELSE stddev_pop({c}) END FROM f), 6) AS {c}"
            for c in NUMERIC
        )
    else:
        sel = ", ".join(
            f"round(({c} - (SELECT quantile_cont({c}, 0.5) FROM f)) / (SELECT CASE WHEN quantile_cont({c}, 0.75) = "
            f"quantile_cont({c}, 0.25) THEN 1.0 ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END FROM f), 6) AS {c}"
            for c in NUMERIC
        )
    return with_survey(f"SELECT row_id, {sel} FROM f", extra)


def queries_sql() -> dict[str, str]:
    cat_cols = ", ".join(CAT)
    out = {
        "scan_profile": _profile_sql(),
        "enrich_missing_source": with_survey("SELECT *, CAST(NULL AS VARCHAR) AS match_p FROM survey"),
        "dedup_keys": with_survey("SELECT * FROM dedup", DEDUP_CTE),
        "enrich_match": with_survey("SELECT * FROM enriched", DEDUP_CTE),
        "match_rate": with_survey(
            "SELECT count(*) AS n_rows, count(match_p) AS n_matched, round(count(match_p) / count(*), 6) AS match_rate "
            "FROM enriched",
            DEDUP_CTE,
        ),
        "match_distribution": with_survey(
            "SELECT match_p, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct "
            "FROM enriched GROUP BY match_p",
            DEDUP_CTE,
        ),
        "quantile_edges": _edges_sql(),
        "quantile_bins": _bins_sql(False),
        "equal_width_bins": _bins_sql(True),
        "impute_by_quantile_group": _impute_one_sql(),
        "impute_chain": _impute_chain_sql(),
        "fill_unknown": with_survey(
            "SELECT row_id, " + ", ".join(f"coalesce({c}, 'Unknown') AS {c}" for c in CAT) + " FROM survey"
        ),
        "fill_global_median": with_survey(
            "SELECT row_id, "
            + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM survey)) AS {c}" for c in NUMERIC)
            + " FROM survey"
        ),
        "one_hot": with_survey(
            "SELECT row_id, "
            + ", ".join(
                f"CAST(coalesce({c} = '{v}', false) AS DOUBLE) AS {c}_{v}" for c in CAT for v in ["No", "Yes"]
            )
            + " FROM survey"
        ),
        "label_encode": with_survey(
            "SELECT row_id, CASE WHEN origin = 'train' THEN CAST(list_position(c, Personality) - 1 AS INTEGER) END AS label "
            "FROM survey, (SELECT list_sort(list(DISTINCT Personality)) AS c FROM survey WHERE origin = 'train')"
        ),
        "prep": prep_sql(),
        "class_balance": with_survey("SELECT * FROM cb", CLASS_BALANCE_CTE),
        "class_domain": with_survey(
            "SELECT "
            + ", ".join(f"list_sort(list(DISTINCT {c}) FILTER (WHERE {c} IS NOT NULL)) AS {c}" for c in [*CAT, "Personality"])
            + " FROM survey"
        ),
        "numeric_stats": _numeric_stats_sql(),
        "data_characteristics": with_survey("SELECT * FROM ch", CLASS_BALANCE_CTE),
        "augmentation_plan": with_survey(
            """SELECT *,
              CASE WHEN is_small_dataset AND is_imbalanced THEN 'smotenc'
                   WHEN is_highly_categorical THEN 'sdv_copula'
                   WHEN n_samples > 10000 AND NOT is_imbalanced THEN 'mixed_ensemble'
                   WHEN class_balance_ratio < 0.3 THEN 'class_balanced'
                   ELSE 'sdv_copula' END AS method,
              round(CAST(CASE WHEN is_small_dataset AND is_imbalanced THEN least(0.05 * 1.5, 0.2)
                   WHEN is_highly_categorical THEN least(0.05 * 0.8, 0.2)
                   WHEN n_samples > 10000 AND NOT is_imbalanced THEN greatest(0.05 * 0.5, 0.01)
                   WHEN class_balance_ratio < 0.3 THEN 0.2
                   ELSE 0.05 END AS DOUBLE), 6) AS ratio
            FROM ch""",
            CLASS_BALANCE_CTE,
        ),
        "ks_similarity": _ks_sql(),
        "diversity_score": _diversity_sql(),
        "standard_scale": _scaled_sql("standard"),
        "robust_scale": _scaled_sql("robust"),
        "balanced_weights": with_survey(
            "SELECT row_id, round(count(*) OVER () / ((SELECT count(DISTINCT Personality) FROM survey WHERE origin = 'train') "
            "* count(*) OVER (PARTITION BY Personality)), 6) AS weight FROM survey WHERE origin = 'train'"
        ),
    }
    del cat_cols
    out.update(queries_sql_2())
    out.update(queries_sql_3())
    out.update(queries_sql_4())
    out["augment_smote"] = smote_sql()
    out.update(queries_sql_5())
    out.update(queries_sql_models())
    return out


def _u(id_expr: str, salt: str) -> str:
    from tabforge.sources.fixture import sql_uniform

    return sql_uniform(id_expr, salt)


STACKS6 = ["A", "B", "C", "D", "E", "F"]
LABELLED_CTE = "lt AS (SELECT row_id, CAST(Personality = 'Introvert' AS INTEGER) AS label FROM survey WHERE origin = 'train')"


def _rank_sql(rel: str, id_col: str, salt: str, part: str = "") -> str:
    from tabforge.sources.fixture import sql_hash_hex

    p = f"PARTITION BY {part} " if part else ""
    return f"row_number() OVER ({p}ORDER BY {sql_hash_hex(id_col, salt)}, {id_col})"


def _oof_cte() -> str:
    from tabforge.sources.fixture import sql_scores

    return f"{LABELLED_CTE},\noof AS (SELECT row_id, label, {sql_scores('row_id')} FROM lt)"


def _trials_cte(n_trials: int = 200, seed: int = 42) -> str:
    raw = ", ".join(f"{_u('t', f'w_{s}{seed}')} AS r{s}" for s in STACKS6)
    tot = " + ".join(f"r{s}" for s in STACKS6)
    norm = ", ".join(f"r{s} / ({tot}) AS w_{s}" for s in STACKS6)
    blend = " + ".join(f"w_{s} * p_{s}" for s in STACKS6)
    return f"""
tr0 AS (SELECT t, {raw} FROM range({n_trials}) r(t)),
tr AS (SELECT t AS trial, {norm} FROM tr0),
acc AS (SELECT trial, avg(CAST(CAST(({blend}) >= 0.5 AS INTEGER) = label AS DOUBLE)) AS accuracy,
               {', '.join(f'any_value(w_{s}) AS w_{s}' for s in STACKS6)}
        FROM tr, oof GROUP BY trial)
"""


def _test_scores_cte() -> str:
    from tabforge.sources.fixture import sql_scores

    return f"ts AS (SELECT row_id, {sql_scores('row_id', confident=True)} FROM survey WHERE origin = 'test')"


def _pseudo_cte() -> str:
    return f"""{LABELLED_CTE},
{_test_scores_cte()},
cand AS (SELECT row_id, 1.0 * p_A AS p_blend, greatest(1.0 * p_A, 1 - 1.0 * p_A) AS confidence FROM ts
         WHERE 1.0 * p_A >= 0.95 OR 1.0 * p_A <= 1 - 0.95),
chosen AS (SELECT * FROM cand ORDER BY confidence DESC, row_id LIMIT (SELECT CAST(floor(count(*) * 0.3) AS BIGINT) FROM lt)),
comb AS (SELECT row_id, label, 'train' AS source, CAST(NULL AS DOUBLE) AS confidence FROM lt
         UNION ALL SELECT row_id, CAST(p_blend >= 0.5 AS INTEGER), 'pseudo', confidence FROM chosen)
"""


def _domains_cte() -> str:
    return f"""
segs AS (SELECT list_sort(list(DISTINCT c_mktsegment)) AS s FROM customer),
cd AS (SELECT c_custkey, c_acctbal, CAST(list_position(segs.s, c_mktsegment) - 1 AS INTEGER) AS domain,
              {_u('c_custkey', 'ref')} AS p_ref, {_u('c_custkey', 'own')} AS p_own FROM customer, segs),
cw0 AS (SELECT *, CASE WHEN domain = 0 THEN 1.0 ELSE p_ref / (p_own + 1e-8) END AS w0 FROM cd),
cw AS (SELECT *, w0 / (avg(w0) OVER (PARTITION BY domain) + 1e-8) AS weight FROM cw0)
"""


def queries_sql_2() -> dict[str, str]:
    from tabforge.sources.fixture import sql_scores

    blend_w = {"A": 1.0, "B": 3.0, "C": 0.5, "D": 2.0, "E": 1.0, "F": 1.5}
    tot = sum(blend_w.values())
    blend = " + ".join(f"{w / tot!r} * p_{s}" for s, w in blend_w.items())
    fold_u = _u("CAST(row_id AS VARCHAR) || '/' || CAST(f AS VARCHAR)", "fold")
    return {
        "stratified_folds": with_survey(
            f"SELECT row_id, label, CAST(({_rank_sql('lt', 'row_id', 'fold42', 'label')} - 1) % 5 AS INTEGER) AS fold FROM lt",
            LABELLED_CTE,
        ),
        "sample_n": with_survey(
            f"SELECT row_id, origin FROM (SELECT row_id, origin, {_rank_sql('survey', 'row_id', 'sample42')} AS r FROM survey) WHERE r <= 1000"
        ),
        "label_noise": with_survey(
            f"SELECT row_id, label, CAST(CASE WHEN r <= (SELECT CAST(floor(count(*) * 0.02) AS BIGINT) FROM lt) THEN 1 - label ELSE label END AS INTEGER) AS noisy_label "
            f"FROM (SELECT *, {_rank_sql('lt', 'row_id', 'noise42')} AS r FROM lt)",
            LABELLED_CTE,
        ),
        "halve_low_diversity": with_survey(
            f"SELECT row_id, quality FROM (SELECT row_id, round({_u('row_id', 'quality')}, 6) AS quality FROM survey WHERE origin = 'test') "
            "ORDER BY quality DESC, row_id LIMIT (SELECT count(*) // 2 FROM survey WHERE origin = 'test')"
        ),
        "blend_scores": with_survey(
            f"SELECT row_id, round(b, 6) AS blended, CAST(b >= 0.5 AS INTEGER) AS blended_class FROM "
            f"(SELECT row_id, {blend} AS b FROM (SELECT row_id, {sql_scores('row_id')} FROM survey))"
        ),
        "blend_trials": with_survey("SELECT trial, round(accuracy, 6) AS accuracy FROM acc", _oof_cte() + ",\n" + _trials_cte()),
        "blend_search": with_survey(
            "SELECT trial, round(accuracy, 6) AS accuracy, "
            + ", ".join(f"round(w_{s}, 6) AS w_{s}" for s in STACKS6)
            + " FROM acc ORDER BY accuracy DESC, trial LIMIT 1",
            _oof_cte() + ",\n" + _trials_cte(),
        ),
        "soft_vote_avg": with_survey(
            "SELECT row_id, round(v, 6) AS vote, CAST(v >= 0.5 AS INTEGER) AS vote_class FROM "
            f"(SELECT row_id, (p_A + p_B + p_C) / 3.0 AS v FROM (SELECT row_id, {sql_scores('row_id', ['A', 'B', 'C'])} FROM survey))"
        ),
        "cv_accuracy": with_survey(
            "SELECT count(*) AS n_folds, round(avg(a), 6) AS cv_accuracy FROM ("
            "SELECT fold, avg(CAST(label = CAST(p_A >= 0.5 AS INTEGER) AS DOUBLE)) AS a FROM ("
            f"SELECT *, ({_rank_sql('oof', 'row_id', 'fold42', 'label')} - 1) % 5 AS fold FROM oof) GROUP BY fold)",
            _oof_cte(),
        ),
        "fold_average": with_survey(
            f"SELECT row_id, round(avg({fold_u}), 6) AS p_mean, count(*) AS n_folds "
            "FROM survey, range(5) r(f) WHERE origin = 'test' GROUP BY row_id"
        ),
        "pseudo_candidates": with_survey(
            "SELECT row_id, round(p_blend, 6) AS p_blend, round(confidence, 6) AS confidence FROM cand", _pseudo_cte()
        ),
        "pseudo_label": with_survey(
            "SELECT row_id, label, source, round(confidence, 6) AS confidence FROM comb", _pseudo_cte()
        ),
        "pseudo_stats": with_survey(
            """SELECT count(*) FILTER (WHERE source = 'pseudo') AS n_pseudo_added,
                      count(*) FILTER (WHERE source = 'pseudo' AND label = 0) AS pseudo_class_0,
                      count(*) FILTER (WHERE source = 'pseudo' AND label = 1) AS pseudo_class_1,
                      round(avg(confidence) FILTER (WHERE source = 'pseudo'), 6) AS mean_confidence,
                      count(*) FILTER (WHERE source <> 'pseudo') AS original_size,
                      count(*) AS final_size FROM comb""",
            _pseudo_cte(),
        ),
        "domain_union": "WITH " + _domains_cte().strip() + "\nSELECT c_custkey, c_acctbal, domain FROM cd",
        "propensity_weights": "WITH " + _domains_cte().strip() + "\nSELECT c_custkey, domain, round(weight, 6) AS weight FROM cw",
        "normalize_weights": "WITH "
        + _domains_cte().strip()
        + ",\nnw AS (SELECT c_custkey, domain, (c_acctbal + 1000.0) / (avg(c_acctbal + 1000.0) OVER (PARTITION BY domain) + 1e-8) AS weight FROM cd)"
        + "\nSELECT c_custkey, domain, round(weight, 6) AS weight FROM nw",
        "domain_filter": "WITH "
        + _domains_cte().strip()
        + "\nSELECT c_custkey, domain, round(weight, 6) AS weight FROM cw WHERE domain = 0 OR weight >= 0.2",
        "domain_weight_summary": "WITH "
        + _domains_cte().strip()
        + """
SELECT domain, count(*) AS n, round(min(weight), 6) AS w_min, round(max(weight), 6) AS w_max,
       round(avg(weight), 6) AS w_mean, round(avg(CAST(weight < 0.5 AS DOUBLE)) * 100, 6) AS pct_below_0_5,
       round(avg(CAST(weight > 2.0 AS DOUBLE)) * 100, 6) AS pct_above_2
FROM cw GROUP BY domain""",
    }


def _jitter_cte(ratio: float = 0.05, seed: int = 42) -> str:
    from tabforge.sources.fixture import sql_hash_hex, sql_normal

    stats = ", ".join(f"stddev_samp({c}) AS s_{c}, min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in NUMERIC)
    lv = ", ".join(f"list_sort(list(DISTINCT {c}) FILTER (WHERE {c} IS NOT NULL)) AS l_{c}" for c in CAT)
    num = ", ".join(
        f"CASE WHEN b.{c} IS NOT NULL THEN least(greatest(b.{c} + {sql_normal('p.syn_id', f'noise_{c}{seed}')} * (st.s_{c} * 0.05), st.lo_{c}), st.hi_{c}) END AS {c}"
        for c in NUMERIC
    )
    cat = ", ".join(
        f"CASE WHEN {_u('p.syn_id', f'flip_{c}{seed}')} < 0.05 AND b.{c} IS NOT NULL AND len(list_filter(lv.l_{c}, lambda v: v <> b.{c})) > 0 "
        f"THEN list_filter(lv.l_{c}, lambda v: v <> b.{c})[CAST(floor({_u('p.syn_id', f'pick_{c}{seed}')} * len(list_filter(lv.l_{c}, lambda v: v <> b.{c}))) AS BIGINT) + 1] "
        f"ELSE b.{c} END AS {c}"
        for c in CAT
    )
    return f"""
tr AS (SELECT row_id, {', '.join(FEATURES)}, Personality FROM survey WHERE origin = 'train'),
tcc AS (SELECT Personality, count(*) AS n FROM tr GROUP BY Personality),
mc AS (SELECT Personality AS minority_class FROM tcc ORDER BY n, Personality LIMIT 1),
jb AS (SELECT *, row_number() OVER (ORDER BY {sql_hash_hex('row_id', f'boot{seed}')}, row_id) AS r
       FROM tr WHERE Personality = (SELECT minority_class FROM mc)),
jm AS (SELECT count(*) AS m FROM jb),
st AS (SELECT {stats} FROM tr),
lv AS (SELECT {lv} FROM tr),
jp AS (SELECT syn_id, CAST(floor({_u('syn_id', f'pick{seed}')} * m) + 1 AS BIGINT) AS r
       FROM (SELECT unnest(range(CAST(floor(m * {ratio}) AS BIGINT))) AS syn_id, m FROM jm)),
jit AS (SELECT p.syn_id, b.row_id AS base_id, {num}, {cat}, b.Personality
        FROM jp p JOIN jb b ON p.r = b.r, st, lv)
"""


def queries_sql_3() -> dict[str, str]:
    ks_parts = []
    for c in NUMERIC:
        ks_parts.append(f"SELECT '{c}' AS feature, {c} AS v, 1 AS side FROM tr WHERE {c} IS NOT NULL")
        ks_parts.append(f"SELECT '{c}' AS feature, {c} AS v, 2 AS side FROM jit WHERE {c} IS NOT NULL")
    ks = f"""
ks_s AS ({' UNION ALL '.join(ks_parts)}),
ks_c AS (SELECT feature, v, count(*) FILTER (WHERE side = 1) AS c1, count(*) FILTER (WHERE side = 2) AS c2 FROM ks_s GROUP BY feature, v),
ks_cum AS (SELECT feature,
                  sum(c1) OVER (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r1,
                  sum(c2) OVER (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r2,
                  sum(c1) OVER (PARTITION BY feature) AS n1, sum(c2) OVER (PARTITION BY feature) AS n2 FROM ks_c),
ks AS (SELECT feature, max(abs(r1 / n1 - r2 / n2)) AS ks FROM ks_cum GROUP BY feature),
sim AS (SELECT avg(1 - ks) AS sim FROM ks)
"""
    conf = f"greatest({_u('syn_id', 'conf')}, 1 - {_u('syn_id', 'conf')})"
    return {
        "augment_jitter": with_survey(
            "SELECT syn_id, base_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in NUMERIC) + f", {', '.join(CAT)}, Personality FROM jit",
            _jitter_cte(),
        ),
        "balance_quota": with_survey(
            """SELECT minority_class, minority_count, majority_count, need,
                      CAST(floor(need * 0.6) AS BIGINT) AS n_smote, CAST(floor(need * 0.4) AS BIGINT) AS n_copula
               FROM (SELECT minority_class, minority_count, majority_count,
                            CAST(greatest(floor(majority_count * 0.7) - minority_count, 0) AS BIGINT) AS need FROM cb)""",
            CLASS_BALANCE_CTE,
        ),
        "balance_before_after": with_survey(
            """SELECT t.Personality, t.n AS n_before, t.n + coalesce(j.n, 0) AS n_after
               FROM tcc t LEFT JOIN (SELECT Personality, count(*) AS n FROM jit GROUP BY Personality) j USING (Personality)""",
            _jitter_cte(),
        ),
        "quality_filter": with_survey(
            f"SELECT syn_id, round(q, 6) AS quality FROM (SELECT syn_id, 0.7 * {conf} + 0.3 * (SELECT sim FROM sim) AS q FROM jit) WHERE q >= 0.75",
            _jitter_cte() + "," + ks,
        ),
    }


def queries_sql_4() -> dict[str, str]:
    defaults = {"Time_spent_Alone": 2.0, "Social_event_attendance": 4.0, "Going_outside": 3.0, "Friends_circle_size": 8.0, "Post_frequency": 3.0}
    sf = ", ".join(f"coalesce(CAST({c} AS DOUBLE), {v}) AS {c}" for c, v in defaults.items())
    oh = ", ".join(
        f"coalesce(CAST({c} = '{v}' AS DOUBLE), 0.0) AS {c}_{v}" for c in CAT for v in ("No", "Unknown", "Yes")
    )
    serve = f"SELECT row_id, {sf}, {oh}, 0.0 AS match_p_Extrovert, 0.0 AS match_p_Introvert, 1.0 AS match_p_Unknown FROM survey"
    u = _u("row_id", "A")
    conf = f"round(greatest({u}, 1 - {u}), 6)"
    contract = [
        *NUMERIC,
        "Stage_fear_No", "Stage_fear_Unknown", "Stage_fear_Yes",
        "Drained_after_socializing_No", "Drained_after_socializing_Unknown", "Drained_after_socializing_Yes",
        "match_p_Extrovert", "match_p_Introvert", "match_p_Unknown",
    ]
    present = set(NUMERIC) | {"Stage_fear_No", "Stage_fear_Yes"}
    align = ", ".join(
        (f"CAST({c} AS DOUBLE) AS {c}" if c in NUMERIC else f"CAST(coalesce(Stage_fear = '{c.split('_')[-1]}', false) AS DOUBLE) AS {c}")
        if c in present
        else f"0.0 AS {c}"
        for c in contract
    )
    return {
        "serve_features": with_survey(serve),
        "confidence_tier": with_survey(
            f"SELECT row_id, c AS confidence, CASE WHEN c > 0.7 THEN 'High' WHEN c > 0.5 THEN 'Medium' ELSE 'Low' END AS tier "
            f"FROM (SELECT row_id, {conf} AS c FROM survey)"
        ),
        "profile_dimensions": with_survey(
            """SELECT row_id, round(1 - coalesce(Time_spent_Alone, 12.0) / 24.0, 6) AS social_energy,
                      round(1 - coalesce(Post_frequency, 10.0) / 20.0, 6) AS processing_style,
                      round(CAST(CASE WHEN coalesce(Stage_fear_Yes, 0.0) <> 0 THEN 0.8 ELSE 0.3 END AS DOUBLE), 6) AS decision_making,
                      round(1 - coalesce(Going_outside, 7.0) / 15.0, 6) AS lifestyle,
                      round(1 - coalesce(Friends_circle_size, 25.0) / 50.0, 6) AS communication FROM sv""",
            f"sv AS ({serve})",
        ),
        "label_decode": with_survey(
            f"SELECT row_id, prediction, coalesce(CASE prediction WHEN 0 THEN 'Extrovert' WHEN 1 THEN 'Introvert' END, "
            f"'Class_' || CAST(prediction AS VARCHAR)) AS predicted_label FROM "
            f"(SELECT row_id, CAST(floor({_u('row_id', 'code')} * 3) AS INTEGER) AS prediction FROM survey)"
        ),
        "align_features": with_survey(f"SELECT row_id, {align} FROM survey"),
        "domain_removal": "WITH "
        + _domains_cte().strip()
        + """
SELECT domain, count(*) AS n_before, count(*) FILTER (WHERE domain = 0 OR weight >= 0.2) AS n_after,
       round((count(*) - count(*) FILTER (WHERE domain = 0 OR weight >= 0.2)) * 100.0 / count(*), 6) AS pct_removed
FROM cw GROUP BY domain""",
        "model_metadata": with_survey(
            "SELECT 'stack_C' AS name, 'stacking' AS model_type, count(*) AS n_training_rows, "
            f"[{', '.join(repr(c) for c in contract)}] AS features, ['Extrovert', 'Introvert'] AS classes, "
            """'{"0":"Extrovert","1":"Introvert"}' AS label_map, '{"meta.kind":"logistic"}' AS best_params, ['depthwise', 'symmetric'] AS estimators """
            "FROM survey WHERE origin = 'train'"
        ),
    }


def _imputed_train_ctes() -> tuple[str, str]:
    chain, last = impute_ctes("survey", prefix="im")
    med = ", ".join(f"coalesce({c}, (SELECT median({c}) FROM {last})) AS {c}" for c in NUMERIC)
    ctes = chain + f",\nimp AS (SELECT row_id, origin, Personality, {med}, {', '.join(CAT)} FROM {last}),\ntr AS (SELECT * FROM imp WHERE origin = 'train')"
    return ctes, "tr"


def smote_sql(k: int = 5, ratio: float = 0.05, seed: int = 42) -> str:
    from tabforge.sources.fixture import sql_hash_hex

    ctes, _ = _imputed_train_ctes()
    feats = NUMERIC + CAT
    dist = " + ".join(f"(b.{c} - y.{c}) * (b.{c} - y.{c})" for c in NUMERIC) + "".join(
        f" + CASE WHEN b.{c} <> y.{c} THEN pen.p ELSE 0.0 END" for c in CAT
    )
    stds = " UNION ALL ".join(f"SELECT stddev_samp({c}) AS s FROM mrows" for c in NUMERIC)
    gap = _u("b.syn_id", f"gap{seed}")
    votes = []
    for c in CAT:
        votes.append(
            f"v_{c} AS (SELECT syn_id, arg_max({c}, (n, -rank_v)) AS {c} FROM ("
            f"SELECT syn_id, {c}, count(*) AS n, dense_rank() OVER (PARTITION BY syn_id ORDER BY {c} ASC) AS rank_v "
            f"FROM knn GROUP BY syn_id, {c}) GROUP BY syn_id)"
        )
    extra = f"""{ctes},
tcc AS (SELECT Personality, count(*) AS n FROM tr GROUP BY Personality),
mc AS (SELECT Personality AS minority_class FROM tcc ORDER BY n, Personality LIMIT 1),
mrows AS (SELECT row_id, {', '.join(NUMERIC)}, {', '.join(f"coalesce({c}, 'Unknown') AS {c}" for c in CAT)}
          FROM tr WHERE Personality = (SELECT minority_class FROM mc)),
vec AS (SELECT *, min(row_id) OVER (PARTITION BY {', '.join(feats)}) AS vid FROM mrows),
jb AS (SELECT *, row_number() OVER (ORDER BY {sql_hash_hex('row_id', f'boot{seed}')}, row_id) AS r FROM vec),
jm AS (SELECT count(*) AS m FROM jb),
jp AS (SELECT syn_id, CAST(floor({_u('syn_id', f'pick{seed}')} * m) + 1 AS BIGINT) AS r
       FROM (SELECT unnest(range(CAST(floor(m * {ratio}) AS BIGINT))) AS syn_id, m FROM jm)),
base AS (SELECT p.syn_id, b.* EXCLUDE (r) FROM jp p JOIN jb b ON p.r = b.r),
pen AS (SELECT median(s) * median(s) AS p FROM ({stds})),
cand AS (SELECT b.syn_id, y.vid, y.row_id AS yid, {dist} AS dist2, {', '.join(f'y.{c}' for c in feats)}
         FROM base b JOIN vec y ON y.row_id <> b.row_id, pen),
ranked AS (SELECT *, row_number() OVER (PARTITION BY syn_id ORDER BY dist2, vid, yid) AS rk FROM cand),
knn AS (SELECT * FROM ranked WHERE rk <= least({k}, (SELECT m - 1 FROM jm))),
nn AS (SELECT k2.* FROM knn k2 JOIN base b ON k2.syn_id = b.syn_id
       WHERE k2.rk = CAST(floor({_u('b.syn_id', f'nn{seed}')} * least({k}, (SELECT m - 1 FROM jm))) + 1 AS BIGINT)),
{', '.join(votes)}
"""
    num = ", ".join(f"round(b.{c} + {gap} * (nn.{c} - b.{c}), 6) AS {c}" for c in NUMERIC)
    cats = ", ".join(f"v_{c}.{c}" for c in CAT)
    joins = " ".join(f"JOIN v_{c} ON v_{c}.syn_id = b.syn_id" for c in CAT)
    body = (
        f"SELECT b.syn_id, b.row_id AS base_id, {num}, {cats}, (SELECT minority_class FROM mc) AS Personality "
        f"FROM base b JOIN nn ON nn.syn_id = b.syn_id {joins}"
    )
    return with_survey(body, extra)


def queries_sql_5() -> dict[str, str]:
    from tabforge.sources.fixture import sql_hash_hex

    docs = "docs AS (SELECT d.doc_id, d.n_chars, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))"
    u = _u("doc_id", "A")
    conf_u = f"(CASE WHEN {u} < 0.5 THEN 2 * {u} * {u} ELSE 1 - 2 * (1 - {u}) * (1 - {u}) END)"
    return {
        "class_balance_docs": f"""WITH {docs},
cc AS (SELECT quality, count(*) AS n FROM docs WHERE quality IS NOT NULL GROUP BY quality)
SELECT sum(n) AS n_rows, count(*) AS n_classes, arg_min(quality, (n, quality)) AS minority_class, min(n) AS minority_count,
       (SELECT quality FROM cc ORDER BY n DESC, quality LIMIT 1) AS majority_class, max(n) AS majority_count,
       round(min(n) / max(n), 6) AS balance_ratio FROM cc""",
        "stratified_folds_embeddings": f"""SELECT vec_id, label,
       CAST((row_number() OVER (PARTITION BY label ORDER BY {sql_hash_hex('vec_id', 'fold42')}, vec_id) - 1) % 5 AS INTEGER) AS fold
FROM embeddings""",
        "pseudo_label_docs": f"""WITH {docs},
lt AS (SELECT doc_id, quality AS label FROM docs WHERE quality IS NOT NULL),
ts AS (SELECT doc_id, {conf_u} AS p FROM docs WHERE quality IS NULL),
cand AS (SELECT doc_id, p, greatest(p, 1 - p) AS confidence FROM ts WHERE p >= 0.95 OR p <= 1 - 0.95),
chosen AS (SELECT * FROM cand ORDER BY confidence DESC, doc_id LIMIT (SELECT CAST(floor(count(*) * 0.3) AS BIGINT) FROM lt))
SELECT doc_id, label, 'train' AS source, CAST(NULL AS DOUBLE) AS confidence FROM lt
UNION ALL SELECT doc_id, CAST(p >= 0.5 AS INTEGER), 'pseudo', round(confidence, 6) FROM chosen""",
        "ks_similarity_docs": f"""WITH {docs},
c AS (SELECT CAST(n_chars AS DOUBLE) AS v, count(*) FILTER (WHERE quality IS NOT NULL) AS c1, count(*) FILTER (WHERE quality IS NULL) AS c2
      FROM docs GROUP BY 1),
cum AS (SELECT sum(c1) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r1,
               sum(c2) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r2,
               sum(c1) OVER () AS n1, sum(c2) OVER () AS n2 FROM c)
SELECT 'n_chars' AS feature, round(max(abs(r1 / n1 - r2 / n2)), 6) AS ks_stat, round(1 - max(abs(r1 / n1 - r2 / n2)), 6) AS similarity FROM cum""",
        "numeric_stats_events": """SELECT 'value' AS feature, round(median(value), 6) AS median, round(min(value), 6) AS min,
       round(max(value), 6) AS max, round(stddev_samp(value), 6) AS std FROM events""",
        "match_distribution_events": """SELECT event_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM events GROUP BY event_type""",
    }


def queries_sql_models() -> dict[str, str]:
    """What scores can't change: which rows have one (and their label), and that it is a probability."""
    test = "FROM survey WHERE origin = 'test'"
    label = "CAST(CASE WHEN Personality = 'Introvert' THEN 1 ELSE 0 END AS DOUBLE)"
    return {
        "oof_rows": with_survey(f"SELECT row_id, {label} AS label, true AS scored FROM survey, (VALUES (1), (2)) AS runs(run) WHERE origin = 'train'"),
        "soft_vote_rows": with_survey(f"SELECT row_id, true AS scored {test}"),
        "score_batch_rows": with_survey(f"SELECT row_id, true AS whole, true AS named, true AS scored {test}"),
        "stack_c_rows": with_survey(f"SELECT row_id, true AS scored {test}"),
    }
