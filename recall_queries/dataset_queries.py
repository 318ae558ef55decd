"""Training sets, next-session frames, splits, encoders and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from recall_queries import history_queries, vocab_queries
from recall_queries.registry import query
from recall_queries.views import (
    LEARNER,
    SESSION_TRIES_SQL,
    SINGLE_SESSION_TRIES_SQL,
    TRIES_SQL,
    VOCAB_SQL,
    marked_session_tries,
    session_tries,
    table,
    tries,
    vocab,
)
from recall_engine.operators import datasets, history, metrics, prep, reports
from recall_engine.operators.global_order import dense_id
from recall_engine.operators.word_state import StateLog, next_session_from_state
from recall_engine.schemas import FEATURES, IMPUTE
from recall_engine.staging import new_path, stage

ID = "id_historical_data"
NOW = "2024-02-10 09:30:00"

# --- D3, J2, T2 -------------------------------------------------------------------------------------

WORDS_SQL = vocab_queries.FEATURES_SQL.replace(VOCAB_SQL + ", ", "", 1)
WORD_COLUMNS = (
    "levenshtein_distance_german_english nb_characters_german nb_characters_english nb_words_german "
    "nb_words_english is_noun is_verb difficulty_category"
).split()
D3_SQL = f"{history_queries.FEATURES_SQL}, {WORDS_SQL}"


def training_set(spark, sf):
    words = vocab_queries.d2(spark, sf).select("id_vocab", *WORD_COLUMNS)
    return datasets.training_set(history_queries.features(spark, sf), words)


def _cast_sql(column):
    if column in FEATURES.numerical + FEATURES.diff_time:
        return f"round(CAST({column} AS DOUBLE), 6) AS {column}"
    return f"CAST({column} AS BOOLEAN) AS {column}" if column in FEATURES.boolean else column


ROLES_SQL = ", ".join(_cast_sql(c) for c in FEATURES.all)


@query(
    "d3_training_set",
    f"WITH {D3_SQL} SELECT id_historical_data, result, {ROLES_SQL} FROM fx_features JOIN fx_vocab_features USING (id_vocab)",
)
def d3(spark, sf):
    return training_set(spark, sf).select(ID, "result", *FEATURES.all)


@query(
    "j2_merge_features",
    f"""WITH {D3_SQL} SELECT id_historical_data, nb_words_session, {', '.join(WORD_COLUMNS)}
    FROM fx_features JOIN fx_vocab_features USING (id_vocab)""",
)
def j2(spark, sf):
    words = vocab_queries.d2(spark, sf).select("id_vocab", *WORD_COLUMNS)
    placed = history.sessionize(tries(spark, sf), LEARNER, position=True)
    return datasets.merge_features(placed, words).select(ID, "nb_words_session", *WORD_COLUMNS)


@query(
    "t2_cast_roles",
    f"""WITH {history_queries.FEATURES_SQL} SELECT id_historical_data, result,
      {', '.join(_cast_sql(c) for c in FEATURES.all if c not in WORD_COLUMNS)} FROM fx_features""",
)
def t2(spark, sf):
    cast = datasets.cast_roles(history_queries.features(spark, sf))
    return cast.select(ID, "result", *[c for c in FEATURES.all if c not in WORD_COLUMNS])


@query(
    "k1_sort_by_time",
    f"WITH {TRIES_SQL} SELECT id_historical_data, datetime FROM fx_tries ORDER BY datetime, id_historical_data",
)
def k1(spark, sf):
    return tries(spark, sf).select(ID, "datetime").orderBy("datetime", ID)


# --- the next session -------------------------------------------------------------------------------

FUTURE_SQL = f"""{SINGLE_SESSION_TRIES_SQL}, fx_future AS (
  SELECT v.id_vocab, german AS german_word, english AS english_word, d.language_asked,
    CAST(CASE d.language_asked WHEN 'german' THEN score_english_german ELSE score_german_english END AS DOUBLE) AS score_before,
    CAST(CASE d.language_asked WHEN 'german' THEN score_german_english ELSE score_english_german END AS DOUBLE)
      AS score_before_other_language,
    '' AS guess, 0.0E0 AS question_time, '' AS write_it_again, 0 AS confused_word, FALSE AS is_it_another_word,
    TIMESTAMP '{NOW}' AS datetime, DATE '{NOW[:10]}' AS day,
    (SELECT max(id_session) FROM fx_session_tries) + 1 AS id_session,
    (SELECT max(id_historical_data) FROM fx_session_tries) + row_number() OVER (PARTITION BY d.language_asked ORDER BY id_vocab)
      AS id_historical_data
  FROM fx_vocab v, (VALUES ('german'), ('english')) d(language_asked))"""


def single_tries(spark, sf):
    return session_tries(spark, sf, [])


def future(spark, sf, log):
    now = F.lit(NOW).cast("timestamp_ntz")
    return datasets.future_tries(vocab(spark, sf), datasets.last_ids(log), now)


@query(
    "d4_future_tries",
    f"""WITH {FUTURE_SQL} SELECT id_vocab, german_word, english_word, language_asked, score_before, score_before_other_language,
      CAST(id_session AS BIGINT) AS id_session, CAST(id_historical_data AS BIGINT) AS id_historical_data FROM fx_future""",
)
def d4(spark, sf):
    return future(spark, sf, single_tries(spark, sf)).select(
        "id_vocab",
        "german_word",
        "english_word",
        "language_asked",
        "score_before",
        "score_before_other_language",
        "id_session",
        ID,
    )


@query(
    "t11_future_constants",
    f"""WITH {FUTURE_SQL} SELECT id_vocab, language_asked, guess, question_time, write_it_again,
      CAST(confused_word AS BIGINT) AS confused_word, is_it_another_word, datetime FROM fx_future""",
)
def t11(spark, sf):
    return future(spark, sf, single_tries(spark, sf)).select(
        "id_vocab", "language_asked", "guess", "question_time", "write_it_again", "confused_word", "is_it_another_word", "datetime"
    )


@query(
    "a2_last_ids",
    f"""WITH {SINGLE_SESSION_TRIES_SQL} SELECT max(id_session) AS max_id_session,
      max(id_historical_data) AS max_id_historical_data FROM fx_session_tries""",
)
def a2(spark, sf):
    return datasets.last_ids(history.sessionize(tries(spark, sf)))


NEXT_COLUMNS = [
    "id_vocab",
    *[c for c in FEATURES.all if c not in WORD_COLUMNS],
]
# The oracle always takes the long way: two copies of the history, future rows appended, windows over all.
NEXT_SQL = (
    FUTURE_SQL
    + """, fx_both AS (
  SELECT s.language_asked AS learner_id, t.* EXCLUDE (learner_id), FALSE AS is_future
  FROM fx_session_tries t, (VALUES ('german'), ('english')) s(language_asked)
  UNION ALL BY NAME
  SELECT language_asked AS learner_id, f.*, CAST(NULL AS DOUBLE) AS result, TRUE AS is_future FROM fx_future f)"""
    + (history_queries.OWN_SQL + history_queries.D1_SQL.replace(history_queries.OWN_SQL, "", 1))
    .replace("FROM fx_session_tries t)", "FROM fx_both t)")
    .replace("language_asked, id_session, result,", "language_asked, id_session, result, is_future,")
)


def _next_sql(columns):
    casts = ", ".join(
        f"CAST({c} AS DOUBLE) AS {c}" if c.startswith("past_") and ("succ" in c or "fails" in c) else c for c in columns
    )
    return f"WITH {NEXT_SQL} SELECT {casts} FROM fx_features WHERE is_future"


@query("d5_next_session_features", _next_sql(NEXT_COLUMNS))
def d5(spark, sf):
    log = single_tries(spark, sf)
    return datasets.next_session_features(log, future(spark, sf, log)).select(*NEXT_COLUMNS)


@query("t8_new_session_rows", _next_sql(NEXT_COLUMNS))
def t8(spark, sf):
    """The state is kept by four appends of tries, one of them twice, with a fold between; no history is read after."""
    log = single_tries(spark, sf)
    kept = StateLog.of(log, new_path(spark, "state"), every=3)
    part = F.pmod(F.col(ID), F.lit(4))
    for batch in (0, 1, 1, 2, 3):
        kept.append(log.filter(part == batch), batch)
    return next_session_from_state(kept.read(), future(spark, sf, log)).select(*NEXT_COLUMNS)


@query(
    "a10_pivot_probabilities",
    f"""WITH {VOCAB_SQL} SELECT id_vocab, (id_vocab * 7919 % 1000) / 1000.0E0 AS english_proba,
      CASE WHEN english LIKE 'to %' THEN NULL ELSE (id_vocab * 7920 % 1000) / 1000.0E0 END AS german_proba FROM fx_vocab""",
)
def a10(spark, sf):
    key = F.col("id_vocab")
    long = vocab(spark, sf).select(
        key, "english", F.explode(F.array(F.lit("english"), F.lit("german"))).alias("language_asked")
    )
    german = F.col("language_asked") == "german"
    scored = long.filter(~(german & F.col("english").startswith("to "))).withColumn(
        "y_proba", key * F.when(german, 7920).otherwise(7919) % 1000 / 1000.0
    )
    return datasets.probabilities_by_word(scored)


# --- set operations ---------------------------------------------------------------------------------


@query(
    "u1_union_all",
    f"""WITH {SESSION_TRIES_SQL}, h AS (SELECT id_historical_data, id_session, guess FROM fx_session_tries)
    SELECT * FROM h WHERE id_session < 5 UNION ALL SELECT * FROM h WHERE id_session >= 3""",
)
def u1(spark, sf):
    log = history.sessionize(tries(spark, sf), LEARNER).select(ID, "id_session", "guess")
    return log.filter("id_session < 5").unionByName(log.filter("id_session >= 3"))


@query(
    "u2_union_missing_columns",
    f"""WITH {FUTURE_SQL} SELECT id_historical_data, language_asked, result FROM fx_session_tries
    UNION ALL SELECT CAST(id_historical_data AS BIGINT), language_asked, NULL FROM fx_future""",
)
def u2(spark, sf):
    log = single_tries(spark, sf)
    coming = future(spark, sf, log).select(ID, "language_asked")
    return log.select(ID, "language_asked", "result").unionByName(coming, allowMissingColumns=True)


# --- sessions, splits, folds ------------------------------------------------------------------------

RANK_SQL = f"""{SESSION_TRIES_SQL}, fx_ranks AS (
  SELECT learner_id, id_session, row_number() OVER (PARTITION BY learner_id ORDER BY id_session) - 1 AS r,
         count(*) OVER (PARTITION BY learner_id) AS n
  FROM (SELECT DISTINCT learner_id, id_session FROM fx_session_tries))"""


def learner_sessions(spark, sf):
    return history.sessionize(tries(spark, sf), LEARNER)


@query(
    "a3_rows_per_session",
    f"""WITH {SESSION_TRIES_SQL} SELECT learner_id, id_session, count(*) AS n FROM fx_session_tries GROUP BY ALL""",
)
def a3(spark, sf):
    return learner_sessions(spark, sf).groupBy(*LEARNER, "id_session").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a9_distinct_sessions",
    f"""WITH {RANK_SQL} SELECT learner_id, id_session, CAST(r AS BIGINT) AS session_rank, n AS nb_sessions FROM fx_ranks""",
)
def a9(spark, sf):
    return datasets.session_ranks(learner_sessions(spark, sf), LEARNER)


SPLIT_SQL = f"""{RANK_SQL}, fx_sizes AS (
  SELECT *, ceil(0.10E0 * n) AS t, ceil(0.18E0 * (n - ceil(0.10E0 * n))) AS v FROM fx_ranks), fx_split AS (
  SELECT h.*, CASE WHEN r >= n - t THEN 'test' WHEN r >= n - t - v THEN 'valid' ELSE 'train' END AS split
  FROM fx_session_tries h JOIN fx_sizes USING (learner_id, id_session))"""


@query("p1_split_by_session", f"WITH {SPLIT_SQL} SELECT id_historical_data, split FROM fx_split")
def p1(spark, sf):
    return datasets.split_by_session(learner_sessions(spark, sf), LEARNER).select(ID, "split")


@query("t9_test_sessions_only", f"WITH {SPLIT_SQL} SELECT id_historical_data FROM fx_split WHERE split = 'test'")
def t9(spark, sf):
    return datasets.split_by_session(learner_sessions(spark, sf), LEARNER).filter("split = 'test'").select(ID)


@query(
    "p2_expanding_folds",
    f"""WITH {SESSION_TRIES_SQL}, n AS (SELECT learner_id, max(id_session) + 1 AS n FROM fx_session_tries GROUP BY 1), f AS (
      SELECT id_historical_data, id_session, fold, n - fold * 2 AS hi
      FROM fx_session_tries JOIN n USING (learner_id), range(5) r(fold))
    SELECT id_historical_data, fold, CASE WHEN id_session < hi - 2 THEN 'train' ELSE 'valid' END AS role
    FROM f WHERE id_session < hi""",
)
def p2(spark, sf):
    return datasets.expanding_folds(learner_sessions(spark, sf), 5, 2, LEARNER).select(ID, "fold", "role")


@query(
    "t10_rows_of_words",
    f"""WITH {TRIES_SQL} SELECT id_historical_data FROM fx_tries
    WHERE german_word IN ('small ring', 'der Red widget') OR english_word IN ('to bolt', 'stone promo')""",
)
def t10(spark, sf):
    german = F.col("german_word").isin("small ring", "der Red widget")
    return tries(spark, sf).filter(german | F.col("english_word").isin("to bolt", "stone promo")).select(ID)


@query(
    "t13_conditional_update",
    f"""WITH {TRIES_SQL} SELECT id_historical_data,
      CASE WHEN result <> 1 THEN NULL ELSE strftime(day, '%Y-%m-%d') END AS day_success FROM fx_tries""",
)
def t13(spark, sf):
    return tries(spark, sf).select(
        ID, F.when(F.col("result") != 1, None).otherwise(F.date_format("day", "yyyy-MM-dd")).alias("day_success")
    )


@query(
    "w10_dense_ids",
    """SELECT doc_id, row_number() OVER (ORDER BY source, lang, doc_id) - 1 AS id FROM documents""",
)
def w10(spark, sf):
    log = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return dense_id(log, ["source", "lang", "doc_id"], "id").select("doc_id", "id")


# --- preparation ------------------------------------------------------------------------------------

P3_COLUMNS = [c for c in IMPUTE]


@query(
    "p3_impute",
    f"""WITH {history_queries.FEATURES_SQL} SELECT id_historical_data,
      {', '.join(f'round(coalesce(CAST({c} AS DOUBLE), -1), 6) AS {c}' for c in P3_COLUMNS)} FROM fx_features""",
)
def p3(spark, sf):
    return prep.impute(datasets.cast_roles(history_queries.features(spark, sf))).select(ID, *P3_COLUMNS)


P4_COLUMNS = ["previous_correct_article", "previous_language_asked"]


@query(
    "p4_one_hot",
    f"""WITH {history_queries.FEATURES_SQL} SELECT id_historical_data,
      CASE WHEN NOT previous_correct_article THEN 1.0E0 ELSE 0.0E0 END AS previous_correct_article__False,
      CASE WHEN previous_correct_article THEN 1.0E0 ELSE 0.0E0 END AS previous_correct_article__True,
      CASE WHEN previous_correct_article IS NULL THEN 1.0E0 ELSE 0.0E0 END AS previous_correct_article__nan,
      CASE WHEN previous_language_asked = 'english' THEN 1.0E0 ELSE 0.0E0 END AS previous_language_asked__english,
      CASE WHEN previous_language_asked = 'german' THEN 1.0E0 ELSE 0.0E0 END AS previous_language_asked__german,
      CASE WHEN previous_language_asked IS NULL THEN 1.0E0 ELSE 0.0E0 END AS previous_language_asked__nan
    FROM fx_features""",
)
def p4(spark, sf):
    data = history_queries.features(spark, sf).select(ID, *P4_COLUMNS)
    return prep.OneHot.fit(data, P4_COLUMNS).transform(data)


@query(
    "p4_sparse_one_hot",
    f"""WITH {TRIES_SQL}, v AS (SELECT guess, dense_rank() OVER (ORDER BY guess) - 1 AS place FROM (SELECT DISTINCT guess FROM fx_tries)),
      w AS (SELECT write_it_again AS text, row_number() OVER (ORDER BY write_it_again) - 1 AS place
            FROM (SELECT DISTINCT write_it_again FROM fx_tries WHERE write_it_again IS NOT NULL))
    SELECT id_historical_data, CAST(v.place AS BIGINT) AS guess_place, CAST(coalesce(w.place, (SELECT count(*) FROM w)) AS BIGINT) AS again_place
    FROM fx_tries t JOIN v ON v.guess = t.guess LEFT JOIN w ON w.text = t.write_it_again""",
)
def p4_sparse(spark, sf):
    """Which entry is one in the vectors of two text columns with as many categories as there are texts."""
    columns = ["guess", "write_it_again"]
    data = stage(tries(spark, sf).select(ID, *columns), "texts")
    done = prep.SparseOneHot.fit(data, columns).transform(data)
    one = lambda c: F.regexp_extract(F.col(c).cast("string"), r"\[([0-9]+)\]", 1).cast("long")
    return done.select(ID, one("guess__vector").alias("guess_place"), one("write_it_again__vector").alias("again_place"))


def _catalogue():
    roles = {FEATURES.target: "target"}
    for role in ("numerical", "diff_time", "boolean", "categorical"):
        roles |= dict.fromkeys(getattr(FEATURES, role), role)
    return roles


@query(
    "t3_variable_catalogue",
    f"""WITH {D3_SQL}, d AS (SELECT *, 0 AS one FROM (SELECT id_historical_data, result, {ROLES_SQL} FROM fx_features JOIN fx_vocab_features USING (id_vocab)))
    SELECT r.variable, r.role, r.known FROM (SELECT unnest([{', '.join(
        f"struct_pack(variable := '{c}', role := '{role}', known := count({c}))" for c, role in {**_catalogue(), ID: 'outside'}.items())}]) AS r FROM d)""",
)
def t3(spark, sf):
    """Every column of the training set with its role, or ``outside`` of the catalogue, and how many rows know it."""
    rows = training_set(spark, sf).select(ID, "result", *FEATURES.all)
    roles = {c: _catalogue().get(c, "outside") for c in rows.columns}
    assert FEATURES.outside(rows.columns) == [ID]
    counts = [F.struct(F.lit(c).alias("variable"), F.lit(role).alias("role"), F.count(c).alias("known")) for c, role in roles.items()]
    return rows.agg(F.array(*counts).alias("rows")).select(F.inline("rows"))


@query(
    "p5_standard_scale",
    f"""WITH {TRIES_SQL} SELECT id_historical_data,
      round((question_time - avg(question_time) OVER ()) / stddev_pop(question_time) OVER (), 6) AS question_time,
      round((result - avg(result) OVER ()) / stddev_pop(result) OVER (), 6) AS result FROM fx_tries""",
)
def p5(spark, sf):
    data = tries(spark, sf).select(ID, "question_time", "result")
    return prep.Scaler.fit(data, ["question_time", "result"]).transform(data)


P6_COLUMNS = ["is_it_another_word", "language_asked"]


@query(
    "p6_label_index",
    f"""WITH {TRIES_SQL}, a AS (SELECT is_it_another_word v, row_number() OVER (ORDER BY min(id_historical_data)) - 1 AS i
        FROM fx_tries GROUP BY 1),
      b AS (SELECT language_asked v, row_number() OVER (ORDER BY min(id_historical_data)) - 1 AS i FROM fx_tries GROUP BY 1)
    SELECT id_historical_data, CAST(a.i AS DOUBLE) AS is_it_another_word, CAST(b.i AS DOUBLE) AS language_asked
    FROM fx_tries t JOIN a ON t.is_it_another_word IS NOT DISTINCT FROM a.v JOIN b ON t.language_asked = b.v""",
)
def p6(spark, sf):
    data = tries(spark, sf).select(ID, *P6_COLUMNS)
    return prep.LabelIndex.fit(data, P6_COLUMNS, ID).transform(data)[0]


@query(
    "p6_label_index_rejected",
    f"""WITH {SPLIT_SQL}, seen AS (SELECT DISTINCT id_vocab FROM fx_split WHERE split = 'train')
    SELECT id_historical_data, id_vocab FROM fx_split
    WHERE split <> 'train' AND id_vocab NOT IN (SELECT id_vocab FROM seen)""",
)
def p6_rejected(spark, sf):
    data = datasets.split_by_session(learner_sessions(spark, sf), LEARNER).select(ID, "id_vocab", "split")
    index = prep.LabelIndex.fit(data.filter("split = 'train'"), ["id_vocab"], ID)
    return index.transform(data.filter("split <> 'train'"))[1].select(ID, "id_vocab")


# --- metrics on a deterministic probability ---------------------------------------------------------

SCORED_SQL = f"""{TRIES_SQL}, fx_rows AS (
  SELECT id_historical_data, language_asked, result AS y_true, id_historical_data * 7919 % 1000 / 1000.0E0 AS y_proba,
         CASE WHEN id_historical_data * 7919 % 1000 >= 500 THEN 1.0E0 ELSE 0.0E0 END AS y_pred FROM fx_tries)"""


def scored(spark, sf):
    share = F.col(ID) * 7919 % 1000
    return tries(spark, sf).select(
        ID,
        "language_asked",
        F.col("result").alias("y_true"),
        (share / 1000.0).alias("y_proba"),
        (share >= 500).cast("double").alias("y_pred"),
    )


CELLS_SQL = """count(*) FILTER (y_true IN (0, 1) AND y_pred IN (0, 1)) AS total_population,
    count(*) FILTER (y_true = 1) AS total_positive, count(*) FILTER (y_true = 0) AS total_negative,
    count(*) FILTER (y_true = 1 AND y_pred = 1) AS true_positive, count(*) FILTER (y_true = 1 AND y_pred = 0) AS false_negative,
    count(*) FILTER (y_true = 0 AND y_pred = 1) AS false_positive, count(*) FILTER (y_true = 0 AND y_pred = 0) AS true_negative"""
COUNTS_SQL = f"{SCORED_SQL}, c AS (SELECT {CELLS_SQL} FROM fx_rows)"
COUNTED = ["total_population", "total_positive", "total_negative", "true_positive", "false_negative", "false_positive", "true_negative"]


@query(
    "a11_confusion_counts",
    f"WITH {COUNTS_SQL} SELECT *, round(total_positive / total_population, 6) AS random_precision FROM c",
)
def a11(spark, sf):
    return metrics.confusion_counts(scored(spark, sf))


RATIOS_SQL = {
    "recall": "tp / (tp + fn)",
    "miss_rate": "fn / (tp + fn)",
    "fall_out": "fp / (fp + tn)",
    "specificity": "tn / (fp + tn)",
    "precision": "tp / (tp + fp)",
    "false_discovery_rate": "fp / (tp + fp)",
    "false_omission_rate": "fn / (fn + tn)",
    "negative_predictive_value": "tn / (fn + tn)",
    "accuracy": "(tp + tn) / total_population",
    "prevalence": "(tp + fn) / total_population",
    "positive_likelihood_ratio": "(tp / (tp + fn)) / (fp / (fp + tn))",
    "negative_likelihood_ratio": "(fn / (tp + fn)) / (tn / (fp + tn))",
    "diagnostic_odds_ratio": "((tp / (tp + fn)) / (fp / (fp + tn))) / ((fn / (tp + fn)) / (tn / (fp + tn)))",
    "f1_score": "2 * tp / (2 * tp + fp + fn)",
    "logit_roc_auc": "(tp / (tp + fn) + tn / (fp + tn)) / 2",
}
RATIO_SQL = f"""{COUNTS_SQL}, q AS (SELECT *, CAST(true_positive AS DOUBLE) AS tp, CAST(false_negative AS DOUBLE) AS fn,
  CAST(false_positive AS DOUBLE) AS fp, CAST(true_negative AS DOUBLE) AS tn FROM c)"""


@query(
    "f25_binary_metrics",
    f"WITH {RATIO_SQL} SELECT {', '.join(f'round({s}, 6) AS {n}' for n, s in RATIOS_SQL.items())} FROM q",
)
def f25(spark, sf):
    return metrics.binary_ratios(metrics.confusion_counts(scored(spark, sf))).select(*RATIOS_SQL)


ERRORS_SQL = {
    "explained_variance_score": "1 - var_pop(y_true - y_proba) / var_pop(y_true)",
    "max_error": "max(abs(y_true - y_proba))",
    "mean_absolute_error": "avg(abs(y_true - y_proba))",
    "root_mean_squared_error": "sqrt(avg((y_true - y_proba) ** 2))",
    "r2_score": "1 - avg((y_true - y_proba) ** 2) / var_pop(y_true)",
    "normalised_log_loss": "avg(-ln(CASE y_true WHEN 1 THEN p ELSE 1 - p END))",
    "normalised_cross_entropy": "avg(-ln(CASE y_true WHEN 1 THEN p ELSE 1 - p END)) / "
    "-(avg(y_true) * ln(avg(y_true)) + (1 - avg(y_true)) * ln(1 - avg(y_true)))",
    "brier_score": "avg((y_true - y_proba) ** 2)",
}
ERROR_SQL = f"{SCORED_SQL}, fx_clipped AS (SELECT *, greatest(least(y_proba, 1 - 1e-15), 1e-15) AS p FROM fx_rows)"


@query(
    "f26_regression_metrics",
    f"WITH {ERROR_SQL} SELECT {', '.join(f'round({s}, 6) AS {n}' for n, s in ERRORS_SQL.items())} FROM fx_clipped",
)
def f26(spark, sf):
    return metrics.regression_metrics(scored(spark, sf))


@query(
    "a13_share_of_positives",
    f"WITH {SCORED_SQL} SELECT language_asked, count(*) AS n, round(avg(y_true), 6) AS share FROM fx_rows GROUP BY 1",
)
def a13(spark, sf):
    return scored(spark, sf).groupBy("language_asked").agg(F.count(F.lit(1)).alias("n"), F.avg("y_true").alias("share"))


CURVE_SQL = f"""{SCORED_SQL}, d AS (SELECT y_proba, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg
    FROM fx_rows GROUP BY 1), k AS (
  SELECT *, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg,
    sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM d WINDOW w AS (ORDER BY y_proba DESC))"""


@query(
    "w12_roc_curve",
    f"""WITH {CURVE_SQL} SELECT round(fps / n, 6) AS fpr, round(tps / p, 6) AS tpr, round(y_proba, 6) AS threshold FROM k
      WHERE next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
    UNION ALL SELECT 0.0E0, 0.0E0, round(max(y_proba) + 1, 6) FROM k""",
)
def w12(spark, sf):
    return metrics.roc_curve(scored(spark, sf))


@query(
    "w12_roc_curve_all_points",
    f"""WITH {CURVE_SQL} SELECT round(fps / n, 6) AS fpr, round(tps / p, 6) AS tpr, round(y_proba, 6) AS threshold FROM k
    UNION ALL SELECT 0.0E0, 0.0E0, round(max(y_proba) + 1, 6) FROM k""",
)
def w12_all(spark, sf):
    return metrics.roc_curve(scored(spark, sf), drop_intermediate=False)


@query(
    "w13_precision_recall_curve",
    f"""WITH {CURVE_SQL} SELECT round(tps / (tps + fps), 6) AS precision, round(tps / p, 6) AS recall,
        round(y_proba, 6) AS threshold, round(p / (p + n), 6) AS random_precision FROM k WHERE tps - pos < p
    UNION ALL SELECT 1.0E0, 0.0E0, NULL, round(max(p / (p + n)), 6) FROM k""",
)
def w13(spark, sf):
    return metrics.precision_recall_curve(scored(spark, sf))


@query(
    "w11_calibration_strip",
    f"""WITH {SCORED_SQL} SELECT id_historical_data, row_number() OVER (ORDER BY y_proba, id_historical_data) - 1 AS position,
      y_true = y_pred AS correct, (SELECT count(*) FROM fx_rows WHERE y_true = 0) AS negatives FROM fx_rows""",
)
def w11(spark, sf):
    return metrics.calibration_strip(scored(spark, sf), ID).select(ID, "position", "correct", "negatives")


# --- comparing models -------------------------------------------------------------------------------

MODELS = ["ask_german", "ask_english"]
METRICS_SQL = f"""{ERROR_SQL}, c AS (
  SELECT language_asked, {CELLS_SQL} FROM fx_rows GROUP BY 1), q AS (
  SELECT *, CAST(true_positive AS DOUBLE) AS tp, CAST(false_negative AS DOUBLE) AS fn,
    CAST(false_positive AS DOUBLE) AS fp, CAST(true_negative AS DOUBLE) AS tn FROM c), fx_ratios AS (
  SELECT language_asked, {', '.join(f'CAST({n} AS DOUBLE) AS {n}' for n in COUNTED)},
    total_positive / total_population AS random_precision, {', '.join(f'{s} AS {n}' for n, s in RATIOS_SQL.items())} FROM q), fx_errors AS (
  SELECT language_asked, {', '.join(f'{s} AS {n}' for n, s in ERRORS_SQL.items())} FROM fx_clipped GROUP BY 1), fx_metric AS (
  SELECT concat('ask_', language_asked) AS model, metric, value FROM (
    UNPIVOT (SELECT * FROM fx_ratios JOIN fx_errors USING (language_asked)) ON COLUMNS(* EXCLUDE (language_asked)) INTO NAME metric VALUE value)), fx_wide AS (
  SELECT metric, max(value) FILTER (model = 'ask_german') AS ask_german, max(value) FILTER (model = 'ask_english') AS ask_english
  FROM fx_metric GROUP BY metric)"""

def compared(spark, sf):
    """The two directions stand for two models; all metrics of both."""
    rows = scored(spark, sf).withColumn("model", F.concat(F.lit("ask_"), "language_asked"))
    wide = metrics.side_by_side(metrics.evaluate(rows, "model"), MODELS)
    return metrics.with_objective(wide)


WIDE = "round(ask_german, 6) AS ask_german, round(ask_english, 6) AS ask_english"
#: Metrics of which more is better, and less is better; the others are neutral.
MORE = [
    "true_positive", "true_negative", "recall", "specificity", "precision", "negative_predictive_value", "accuracy",
    "positive_likelihood_ratio", "diagnostic_odds_ratio", "f1_score", "logit_roc_auc", "explained_variance_score", "r2_score",
]
LESS = [
    "false_negative", "false_positive", "miss_rate", "fall_out", "false_discovery_rate", "false_omission_rate", "negative_likelihood_ratio",
    "max_error", "mean_absolute_error", "root_mean_squared_error", "normalised_log_loss", "normalised_cross_entropy", "brier_score",
]
GOAL = (
    f"CASE WHEN metric IN ({', '.join(map(repr, MORE))}) THEN 'maximum' "
    f"WHEN metric IN ({', '.join(map(repr, LESS))}) THEN 'minimum' ELSE 'neutral' END"
)


@query("j8_metrics_side_by_side", f"WITH {METRICS_SQL} SELECT metric, {WIDE} FROM fx_wide")
def j8(spark, sf):
    return compared(spark, sf).drop("objective")


@query("j13_metric_objective", f"WITH {METRICS_SQL} SELECT metric, {GOAL} AS objective FROM fx_wide")
def j13(spark, sf):
    return compared(spark, sf).select("metric", "objective")


BEST = (
    "CASE WHEN ask_german = ask_english THEN NULL WHEN {g} = 'maximum' THEN {a}(ask_german, ask_english) "
    "WHEN {g} = 'minimum' THEN {b}(ask_german, ask_english) END"
)
BEST_SQL = (
    f"round({BEST.format(g=GOAL, a='greatest', b='least')}, 6) AS best, "
    f"round({BEST.format(g=GOAL, a='least', b='greatest')}, 6) AS worst"
)


@query("a12_best_and_worst_model", f"WITH {METRICS_SQL} SELECT metric, {BEST_SQL} FROM fx_wide")
def a12(spark, sf):
    return metrics.best_and_worst(compared(spark, sf), MODELS).select("metric", "best", "worst")


@query(
    "m10_compare_models",
    f"WITH {METRICS_SQL} SELECT metric, {WIDE}, {GOAL} AS objective, {BEST_SQL} FROM fx_wide",
)
def m10(spark, sf):
    return metrics.best_and_worst(compared(spark, sf), MODELS)


# --- distributions and reports ----------------------------------------------------------------------


@query(
    "a14_histogram",
    f"WITH {SCORED_SQL} SELECT CAST(floor(y_proba / 0.05E0) AS BIGINT) AS bin, count(*) AS n FROM fx_rows GROUP BY 1",
)
def a14(spark, sf):
    return metrics.histogram(scored(spark, sf), "y_proba", 0.05)


@query(
    "a15_histogram_2d",
    f"""WITH {VOCAB_SQL}, {vocab_queries.PREDICTIONS_SQL} SELECT CAST(floor(german_proba / 0.05E0) AS BIGINT) AS x_bin,
      CAST(floor(english_proba / 0.05E0) AS BIGINT) AS y_bin, count(*) AS n FROM fx_predictions GROUP BY 1, 2""",
)
def a15(spark, sf):
    return metrics.histogram_2d(vocab_queries.predictions(spark, sf), "german_proba", "english_proba", 0.05)


BOX_SQL = """count({v}) AS n, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std, round(min({v}), 6) AS low,
  round(max({v}), 6) AS high, round(quantile_cont({v}, 0.25), 6) AS q25, round(quantile_cont({v}, 0.5), 6) AS q50,
  round(quantile_cont({v}, 0.75), 6) AS q75"""


@query("a6_describe", f"SELECT {BOX_SQL.format(v='value')} FROM events")
def a6(spark, sf):
    return reports.describe(table(spark, sf, "events"), "value")


@query("a16_box_statistics", f"SELECT event_type, {BOX_SQL.format(v='value')} FROM events GROUP BY 1")
def a16(spark, sf):
    return reports.box_statistics(table(spark, sf, "events"), "value", ["event_type"])


@query("a4_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type")
def a4(spark, sf):
    return reports.value_counts(table(spark, sf, "events"), "event_type")


NULLABLE = ["previous_result", "previous_correct_article", "days_since_last_success_same_language", "hour"]


@query(
    "a5_null_counts",
    f"""WITH {history_queries.FEATURES_SQL} {' UNION ALL '.join(
        f"SELECT '{c}' AS column, count(*) FILTER ({c} IS NULL) AS nulls FROM fx_features" for c in NULLABLE)}""",
)
def a5(spark, sf):
    return reports.null_counts(history_queries.features(spark, sf), NULLABLE)


# --- hyperparameter trials: every event is a trial --------------------------------------------------

PARAMETERS = ["learning_rate", "max_depth", "num_leaves", "min_child_samples", "reg_alpha", "reg_lambda"]


def trial_log(spark, sf):
    """Log lines with the parameters and the score of a trial."""
    event = F.col("event_id")
    numbers = [event % 97 / 1000.0, event % 40, event % 31, event % 9, F.col("value") / 100, event % 7]
    pairs = [F.concat(F.lit(f"'{p}': "), n.cast("string")) for p, n in zip(PARAMETERS, numbers)]
    line = F.concat(
        F.lit("Finished a trial resulted in value: "), F.col("value").cast("string"), F.lit(" with parameters: {"),
        F.concat_ws(", ", *pairs), F.lit("}. Best is trial."),
    )
    return table(spark, sf, "events").select(event.alias("n_trial"), line.alias("value"))


TRIAL_SQL = """fx_trials AS (
  SELECT event_id AS n_trial, event_id % 97 / 1000.0E0 AS learning_rate, event_id % 40 AS max_depth, event_id % 31 AS num_leaves,
    event_id % 9 AS min_child_samples, value / 100 AS reg_alpha, CAST(event_id % 7 AS DOUBLE) AS reg_lambda, value AS "MAE"
  FROM events)"""


def trials(spark, sf):
    return reports.trial_score(reports.trial_parameters(trial_log(spark, sf), PARAMETERS)).drop("value")


@query(
    "f21_parameters_from_log",
    f"""WITH {TRIAL_SQL} SELECT n_trial, round(learning_rate, 6) AS learning_rate, max_depth, num_leaves, min_child_samples,
      round(reg_alpha, 6) AS reg_alpha, reg_lambda, "MAE" FROM fx_trials""",
)
def f21(spark, sf):
    return trials(spark, sf)


@query("t12_outlier_filter", f'WITH {TRIAL_SQL} SELECT n_trial, "MAE" FROM fx_trials WHERE "MAE" < 50')
def t12(spark, sf):
    return trials(spark, sf).filter(F.col("MAE") < 50).select("n_trial", "MAE")


@query(
    "a7_score_per_value",
    f"""WITH {TRIAL_SQL} SELECT min_child_samples, round(avg("MAE"), 6) AS mean, round(stddev_samp("MAE"), 6) AS std,
      count("MAE") AS n FROM fx_trials GROUP BY 1""",
)
def a7(spark, sf):
    return reports.score_per_value(trials(spark, sf), "min_child_samples", "MAE")


@query(
    "a8_best_trial",
    f"""WITH {TRIAL_SQL} (SELECT 'low' AS side, n_trial, max_depth, "MAE" FROM fx_trials ORDER BY "MAE", n_trial LIMIT 1)
    UNION ALL (SELECT 'high', n_trial, max_depth, "MAE" FROM fx_trials ORDER BY "MAE" DESC, n_trial LIMIT 1)""",
)
def a8(spark, sf):
    rows = trials(spark, sf)
    low = reports.best_trial(rows, "MAE", "n_trial").withColumn("side", F.lit("low"))
    high = reports.best_trial(rows, "MAE", "n_trial", minimize=False).withColumn("side", F.lit("high"))
    return low.unionByName(high).select("side", "n_trial", "max_depth", "MAE")


@query("k2_sort_trials", f'WITH {TRIAL_SQL} SELECT n_trial, round(learning_rate, 6) AS learning_rate FROM fx_trials ORDER BY 2, 1')
def k2(spark, sf):
    return trials(spark, sf).select("n_trial", "learning_rate").orderBy("learning_rate", "n_trial")


@query(
    "w14_inverse_rank",
    f"""WITH {TRIAL_SQL}, m AS (SELECT max_depth, avg("MAE") AS mean FROM fx_trials GROUP BY 1),
      r AS (SELECT max_depth, rank() OVER (ORDER BY mean DESC) AS rank_test_score FROM m)
    SELECT max_depth, rank_test_score, (SELECT max(rank_test_score) FROM r) - rank_test_score AS inverse FROM r""",
)
def w14(spark, sf):
    means = reports.score_per_value(trials(spark, sf), "max_depth", "MAE")
    ranked = reports.rank_trials(means, "mean").select("max_depth", "rank_test_score")
    return reports.inverse_rank(ranked, "rank_test_score", "inverse")


@query(
    "f23_trial_duration",
    """SELECT event_id, round(((CAST(floor(value * 3600) AS BIGINT) % 86400) + 86400) % 86400 / 3600.0E0, 6) AS duration_hour FROM events""",
)
def f23(spark, sf):
    start = F.col("ts").cast("timestamp")
    end = F.timestamp_add("SECOND", F.floor(F.col("value") * 3600).cast("int"), start)
    rows = table(spark, sf, "events").select("event_id", start.alias("datetime_start"), end.alias("datetime_complete"))
    return reports.trial_duration(rows).select("event_id", "duration_hour")


@query(
    "f22_four_line_trials",
    f"""WITH {TRIAL_SQL} SELECT n_trial + 1 AS n_trial, round(learning_rate, 6) AS learning_rate, max_depth, num_leaves,
      min_child_samples, round(reg_alpha, 6) AS reg_alpha, reg_lambda, "MAE", max_depth * 60 AS time_seconds FROM fx_trials""",
)
def f22(spark, sf):
    log = trial_log(spark, sf).select(
        F.col("n_trial"),
        F.posexplode(
            F.array(
                F.lit("trial"),
                F.col("value"),
                F.regexp_extract("value", "value: ([^ ]*)", 1),
                (F.col("n_trial") % 40 * 60).cast("string"),
            )
        ).alias("at", "value"),
    )
    lines = log.select((F.col("n_trial") * 4 + F.col("at")).alias("line"), "value")
    return reports.four_line_trials(lines, "line", PARAMETERS)
