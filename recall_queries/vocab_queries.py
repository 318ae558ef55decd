"""Word features, dictionary joins, word lists, selection and the review report."""

from __future__ import annotations

from pyspark.sql import functions as F

from recall_queries.registry import query
from recall_queries.views import LEARNER, TRIES_SQL, VOCAB_SQL, table, tries, vocab
from recall_engine.functions import catalog, text
from recall_engine.operators import review, selection, vocabulary
from recall_engine.plans import next_session
from recall_engine.schemas import ENGLISH_ARTICLES, GERMAN_ARTICLES

GERMAN = "'der', 'die', 'das'"
ENGLISH = "'the', 'to'"

# --- views ------------------------------------------------------------------------------------------


def word_lists(spark, sf):
    """All parts as rows of graded lists; some English words differ from the vocabulary."""
    words = vocab(spark, sf).select("id_vocab", "german", "english")
    size = table(spark, sf, "part").select(F.col("p_partkey").alias("id_vocab"), "p_size")
    english = F.when(F.col("p_size") % 9 == 0, F.concat("english", F.lit(" old"))).otherwise(F.col("english"))
    return words.join(size, "id_vocab").select(
        F.col("german").alias("German"),
        english.alias("English"),
        (F.col("p_size") % 16 - 10).alias("difficulty_category"),
        (F.col("p_size") % 4).alias("list"),
        "id_vocab",
    )


LISTS_SQL = (
    VOCAB_SQL
    + """, fx_lists AS (
  SELECT german AS "German", CASE WHEN p_size % 9 = 0 THEN concat(english, ' old') ELSE english END AS "English",
         p_size % 16 - 10 AS difficulty_category, p_size % 4 AS list, id_vocab
  FROM fx_vocab JOIN part ON p_partkey = id_vocab)"""
)


def predictions(spark, sf):
    """A probability per word and direction."""
    key = F.col("id_vocab")
    return vocab(spark, sf).select(
        key,
        (key * 7919 % 1000 / 1000.0).alias("english_proba"),
        (key * 104729 % 1000 / 1000.0).alias("german_proba"),
    )


PREDICTIONS_SQL = """fx_predictions AS (
  SELECT id_vocab, (id_vocab * 7919 % 1000) / 1000.0E0 AS english_proba,
         (id_vocab * 104729 % 1000) / 1000.0E0 AS german_proba
  FROM fx_vocab)"""


def deck(spark, sf, log=None):
    """The words that each learner was ever asked; ``log`` are their tries, if they are at hand."""
    return (tries(spark, sf) if log is None else log).select("learner_id", "id_vocab").distinct()


def learner_words(spark, sf, log=None):
    """The vocabulary of every learner: the words of their deck with scores, flags and probabilities of their own."""
    key, learner = F.col("id_vocab"), F.col("learner_id")
    return deck(spark, sf, log).select(
        "learner_id",
        "id_vocab",
        ((key + learner) % 7 - 3).cast("long").alias("score_german_english"),
        ((key + 2 * learner) % 5 - 2).cast("long").alias("score_english_german"),
        ((key + learner) % 3 == 0).alias("try_session_german_english"),
        ((key + learner) % 5 == 0).alias("try_session_english_german"),
    )


def learner_predictions(spark, sf):
    """Probabilities for the words of every learner; they know nothing of every sixth of their words."""
    key, learner = F.col("id_vocab"), F.col("learner_id")
    return deck(spark, sf).filter((key + learner) % 6 != 0).select(
        "learner_id",
        "id_vocab",
        ((key * 7919 + learner * 31) % 1000 / 1000.0).alias("english_proba"),
        ((key * 104729 + learner * 17) % 1000 / 1000.0).alias("german_proba"),
    )


LEARNER_SQL = f"""{TRIES_SQL}, fx_deck AS (SELECT DISTINCT learner_id, id_vocab FROM fx_tries), fx_words AS (
  SELECT learner_id, id_vocab, CAST((id_vocab + learner_id) % 7 - 3 AS BIGINT) AS score_german_english,
         CAST((id_vocab + 2 * learner_id) % 5 - 2 AS BIGINT) AS score_english_german,
         (id_vocab + learner_id) % 3 = 0 AS try_session_german_english, (id_vocab + learner_id) % 5 = 0 AS try_session_english_german
  FROM fx_deck), fx_learner_predictions AS (
  SELECT learner_id, id_vocab, ((id_vocab * 7919 + learner_id * 31) % 1000) / 1000.0E0 AS english_proba,
         ((id_vocab * 104729 + learner_id * 17) % 1000) / 1000.0E0 AS german_proba
  FROM fx_deck WHERE (id_vocab + learner_id) % 6 <> 0)"""
UNIFORM_SQL = "CAST(('0x' || substr(md5('{seed}:' || {id}::varchar), 1, 8)) AS BIGINT) / 4294967296.0E0"


def all_words(spark, sf):
    """Overall dictionary: the vocabulary, and each word again with a prefix."""
    words = vocab(spark, sf).select("german", "english")
    prefixed = words.select(*[F.concat(F.lit("word "), F.col(c)).alias(c) for c in words.columns])
    return words.unionByName(prefixed)


ALL_WORDS_SQL = """fx_all AS (
  SELECT german, english FROM fx_vocab
  UNION ALL SELECT concat('word ', german), concat('word ', english) FROM fx_vocab)"""

# --- word features ----------------------------------------------------------------------------------


def _clean(column, articles):
    return f"array_to_string(list_filter(string_split(lower({column}), ' '), lambda t: t NOT IN ({articles})), ' ')"


WORD_SQL = f""", fx_words AS (
  SELECT v.*,
    CAST(levenshtein({_clean('german', GERMAN)}, {_clean('english', ENGLISH)}) AS BIGINT)
      AS levenshtein_distance_german_english,
    CAST(length(german) AS BIGINT) AS nb_characters_german, CAST(length(english) AS BIGINT) AS nb_characters_english,
    CAST(len(string_split(german, ' ')) - CASE WHEN split_part(german, ' ', 1) IN ({GERMAN}) THEN 1 ELSE 0 END AS BIGINT)
      AS nb_words_german,
    CAST(len(string_split(english, ' ')) - CASE WHEN split_part(english, ' ', 1) IN ({ENGLISH}) THEN 1 ELSE 0 END AS BIGINT)
      AS nb_words_english,
    split_part(german, ' ', 1) IN ({GERMAN}) AS is_noun,
    contains(split_part(english, ' ', 1), 'to') AS is_verb
  FROM fx_vocab v), fx_points AS (
  SELECT "German", "English", CAST(max(difficulty_category) AS BIGINT) AS difficulty_category
  FROM fx_lists GROUP BY ALL), fx_vocab_features AS (
  SELECT w.* EXCLUDE (german, english), p.difficulty_category
  FROM fx_words w LEFT JOIN fx_points p ON p."German" = w.german AND p."English" = w.english)"""
FEATURES_SQL = LISTS_SQL + WORD_SQL


@query("d2_vocab_features", f"WITH {FEATURES_SQL} SELECT * FROM fx_vocab_features")
def d2(spark, sf):
    return vocabulary.vocab_features(vocab(spark, sf), word_lists(spark, sf))


@query(
    "j7_difficulty_of_pair",
    f"WITH {FEATURES_SQL} SELECT id_vocab, difficulty_category FROM fx_vocab_features",
)
def j7(spark, sf):
    return vocabulary.add_difficulty(vocab(spark, sf), word_lists(spark, sf)).select("id_vocab", "difficulty_category")


@query("a1_top_difficulty", f'WITH {FEATURES_SQL} SELECT "German", "English", difficulty_category FROM fx_points')
def a1(spark, sf):
    return vocabulary.top_difficulty(word_lists(spark, sf))


@query(
    "t7_words_with_difficulty",
    f"WITH {FEATURES_SQL} SELECT id_vocab, difficulty_category FROM fx_vocab_features WHERE difficulty_category IS NOT NULL",
)
def t7(spark, sf):
    return vocabulary.graded(d2(spark, sf)).select("id_vocab", "difficulty_category")


def _word(name, *columns):
    @query(name, f"WITH {FEATURES_SQL} SELECT id_vocab, {', '.join(columns)} FROM fx_words")
    def run(spark, sf):
        return vocabulary.word_columns(vocab(spark, sf)).select("id_vocab", *columns)


_word("f5_character_count", "nb_characters_german", "nb_characters_english")
_word("f6_word_count", "nb_words_german", "nb_words_english")
_word("f7_is_noun", "is_noun")
_word("f8_is_verb", "is_verb")
_word("f10_translation_distance", "levenshtein_distance_german_english")


@query(
    "f5_f6_document_counts",
    """SELECT doc_id, CAST(length(text) AS BIGINT) AS characters,
      CAST(len(string_split(text, ' ')) - CASE WHEN split_part(text, ' ', 1) IN ('the', 'to') THEN 1 ELSE 0 END AS BIGINT)
        AS words FROM documents""",
)
def document_counts(spark, sf):
    body = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        text.character_count(body).alias("characters"),
        text.word_count(body, ENGLISH_ARTICLES).alias("words"),
    )


@query(
    "f9_remove_articles",
    f"""WITH {VOCAB_SQL} SELECT id_vocab,
      array_to_string(list_filter(string_split(german, ' '), lambda t: t NOT IN ({GERMAN})), ' ') AS german,
      array_to_string(list_filter(string_split(english, ' '), lambda t: t NOT IN ({ENGLISH})), ' ') AS english
    FROM fx_vocab""",
)
def f9(spark, sf):
    return vocab(spark, sf).select(
        "id_vocab",
        text.remove_articles(F.col("german"), GERMAN_ARTICLES).alias("german"),
        text.remove_articles(F.col("english"), ENGLISH_ARTICLES).alias("english"),
    )


@query(
    "f9_remove_articles_documents",
    """SELECT doc_id, array_to_string(list_filter(string_split(text, ' '), lambda t: t NOT IN ('the', 'to')), ' ') AS text
    FROM documents""",
)
def f9_documents(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.remove_articles(F.col("text"), ENGLISH_ARTICLES).alias("text")
    )


@query(
    "sql_text_functions",
    f"""WITH {FEATURES_SQL} SELECT id_vocab, CASE WHEN is_noun THEN split_part(german, ' ', 1) END AS article,
      array_to_string(list_filter(string_split(german, ' '), lambda t: t NOT IN ({GERMAN})), ' ') AS german,
      array_to_string(list_filter(string_split(english, ' '), lambda t: t NOT IN ({ENGLISH})), ' ') AS english,
      nb_words_german, nb_words_english FROM fx_words""",
)
def sql_functions(spark, sf):
    catalog.register(spark)
    return vocab(spark, sf).select(
        "id_vocab",
        F.expr("german_article(german)").alias("article"),
        F.expr("without_german_articles(german)").alias("german"),
        F.expr("without_english_articles(english)").alias("english"),
        F.expr("german_word_count(german)").alias("nb_words_german"),
        F.expr("english_word_count(english)").alias("nb_words_english"),
    )


@query("f24_pair_label", f"WITH {VOCAB_SQL} SELECT id_vocab, german || ' - ' || english AS label FROM fx_vocab")
def f24(spark, sf):
    return vocab(spark, sf).select("id_vocab", text.pair_label(F.col("german"), F.col("english")).alias("label"))


# --- list cleaning ----------------------------------------------------------------------------------


def raw_cells(spark, sf):
    """All parts as raw list cells with every mark the cleaning looks for."""
    key, name = F.col("p_partkey"), F.col("p_name")
    rest = key % 6
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(rest < 2, "der").otherwise("").alias("artikel"),
        F.when(rest == 0, F.concat(name, F.lit(", -e")))
        .when(rest == 1, F.concat(name, F.lit("\n-en")))
        .when(rest == 2, F.concat(name, F.lit("  (Sie form)")))
        .when(rest == 3, F.concat(name, F.lit(" (ich form)")))
        .when(rest == 4, F.concat(F.lit(" "), name, F.lit("/"), F.col("p_brand")))
        .otherwise("")
        .alias("deutsch_plural"),
        F.when(rest == 3, F.concat(F.lit("to "), F.lower("p_type")))
        .otherwise(F.concat(F.lower("p_type"), F.lit("  old (rare)")))
        .alias("englisch"),
    )


CELLS_SQL = """fx_cells AS (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 6 < 2 THEN 'der' ELSE '' END AS artikel,
    CASE p_partkey % 6 WHEN 0 THEN p_name || ', -e' WHEN 1 THEN p_name || chr(10) || '-en'
      WHEN 2 THEN p_name || '  (Sie form)' WHEN 3 THEN p_name || ' (ich form)'
      WHEN 4 THEN ' ' || p_name || '/' || p_brand ELSE '' END AS deutsch_plural,
    CASE p_partkey % 6 WHEN 3 THEN 'to ' || lower(p_type) ELSE lower(p_type) || '  old (rare)' END AS englisch
  FROM part)"""


def _tidy_sql(column):
    return rf"trim(regexp_replace(regexp_extract({column}, '^[^(/\n,-]*'), '\s+', ' ', 'g'))"


@query(
    "f19_clean_list",
    f"""WITH {CELLS_SQL}, a AS (
      SELECT id, artikel || ' ' || deutsch_plural AS d,
        CASE WHEN artikel <> '' THEN 'the ' || englisch ELSE englisch END AS e
      FROM fx_cells WHERE deutsch_plural <> '' AND englisch <> ''), b AS (
      SELECT id, d, CASE WHEN (contains(d, '(Sie') OR contains(d, '(ich')) AND substr(e, 1, 3) <> 'to '
                         THEN 'to ' || e ELSE e END AS e FROM a), c AS (
      SELECT id, {_tidy_sql('d')} AS deutsch, {_tidy_sql('e')} AS englisch FROM b)
    SELECT * FROM c WHERE deutsch <> '' AND englisch <> ''""",
)
def f19(spark, sf):
    return vocabulary.clean_list(raw_cells(spark, sf))


@query(
    "f20_repair_cells",
    """WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)
    SELECT doc_id, CASE WHEN len(l) = 1 THEN text ELSE array_to_string(l[2:], '') END AS after_first,
      CASE WHEN len(l) = 1 THEN '' ELSE l[1] END AS article, CASE WHEN len(l) = 1 THEN l[1] ELSE l[2] END AS word FROM s""",
)
def f20(spark, sf):
    body = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        text.after_first_line(body).alias("after_first"),
        text.split_cell(body, "article", "word").alias("_cell"),
    ).select("doc_id", "after_first", "_cell.article", "_cell.word")


# --- filters and joins around the vocabulary --------------------------------------------------------


@query(
    "t5_not_yet_tried",
    f"""WITH {VOCAB_SQL} SELECT id_vocab FROM fx_vocab
    WHERE NOT (try_session_german_english OR try_session_english_german)""",
)
def t5(spark, sf):
    return review.not_yet_tried(vocab(spark, sf)).select("id_vocab")


REPORT_SQL = """SELECT count(*) AS words,
  count(*) FILTER (english_proba < 0.5 OR german_proba < 0.5) AS words_left,
  count(*) FILTER (NOT (english_proba < 0.5 OR german_proba < 0.5)) AS words_known,
  count(*) FILTER (english_proba < 0.5 OR german_proba < 0.5) < 100 AS time_to_add_words"""


@query("t6_words_left", f"WITH {VOCAB_SQL}, {PREDICTIONS_SQL} {REPORT_SQL} FROM fx_predictions")
def t6(spark, sf):
    return review.knowledge_report(predictions(spark, sf))


@query("d7_post_review_report", f"WITH {VOCAB_SQL}, {PREDICTIONS_SQL} {REPORT_SQL} FROM fx_vocab JOIN fx_predictions USING (id_vocab)")
def d7(spark, sf):
    return review.knowledge_report(review.with_probabilities(vocab(spark, sf), predictions(spark, sf)))


@query(
    "j1_vocab_with_probabilities",
    f"""WITH {VOCAB_SQL}, {PREDICTIONS_SQL} SELECT id_vocab, german, english, round(english_proba, 6) AS english_proba,
      round(german_proba, 6) AS german_proba FROM fx_vocab JOIN fx_predictions USING (id_vocab)""",
)
def j1(spark, sf):
    return review.with_probabilities(vocab(spark, sf), predictions(spark, sf)).select(
        "id_vocab", "german", "english", "english_proba", "german_proba"
    )


CONFUSION_SQL = f"""{TRIES_SQL}, {ALL_WORDS_SQL}, fx_checked AS (
  SELECT t.*, guess = CASE language_asked WHEN 'german' THEN german_word ELSE english_word END AS is_it_correct
  FROM fx_tries t), fx_flagged AS (
  SELECT id_historical_data, language_asked, guess, CASE WHEN NOT is_it_correct THEN
      CASE language_asked WHEN 'german' THEN guess IN (SELECT german FROM fx_all)
                          ELSE guess IN (SELECT english FROM fx_all) END END AS is_it_another_word
  FROM fx_checked)"""


def flagged(spark, sf):
    return review.flag_other_words(review.check_answer(tries(spark, sf)), all_words(spark, sf))


@query("j9_is_another_word", f"WITH {CONFUSION_SQL} SELECT id_historical_data, is_it_another_word FROM fx_flagged")
def j9(spark, sf):
    return flagged(spark, sf).select("id_historical_data", "is_it_another_word")


@query(
    "j10_confused_word",
    f"""WITH {CONFUSION_SQL}, g AS (SELECT german AS w, min(id_vocab) AS id FROM fx_vocab GROUP BY 1),
      e AS (SELECT english AS w, min(id_vocab) AS id FROM fx_vocab GROUP BY 1)
    SELECT id_historical_data, CASE WHEN is_it_another_word THEN
      coalesce(CASE language_asked WHEN 'german' THEN g.id ELSE e.id END, 0) END AS confused_word
    FROM fx_flagged f LEFT JOIN g ON g.w = f.guess LEFT JOIN e ON e.w = f.guess""",
)
def j10(spark, sf):
    checked = review.check_answer(tries(spark, sf))
    done = review.resolve_guesses(checked, vocab(spark, sf), all_words(spark, sf))
    return done.select("id_historical_data", "confused_word")


@query(
    "j11_new_words",
    f"""WITH {LISTS_SQL}, k AS (SELECT * FROM fx_vocab WHERE try_session_german_english)
    SELECT id_vocab, "German", "English" FROM fx_lists l
    WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.english = l."English")
      AND NOT EXISTS (SELECT 1 FROM k WHERE k.german = l."German")""",
)
def j11(spark, sf):
    known = vocab(spark, sf).filter("try_session_german_english")
    return vocabulary.new_words(word_lists(spark, sf), known).select("id_vocab", "German", "English")


@query(
    "r2_update_vocab",
    f"""WITH {TRIES_SQL}, c AS (
      SELECT id_vocab, sum(CASE WHEN language_asked = 'english' THEN 2 * result - 1 END) AS de_en,
             sum(CASE WHEN language_asked = 'german' THEN 2 * result - 1 END) AS en_de
      FROM fx_tries GROUP BY id_vocab)
    SELECT id_vocab, german, english,
      CAST(score_german_english + coalesce(de_en, 0) AS BIGINT) AS score_german_english,
      CAST(score_english_german + coalesce(en_de, 0) AS BIGINT) AS score_english_german,
      de_en IS NOT NULL AS try_session_german_english, en_de IS NOT NULL AS try_session_english_german
    FROM fx_vocab LEFT JOIN c USING (id_vocab)""",
)
def r2(spark, sf):
    return review.update_vocab(review.start_session(vocab(spark, sf)), tries(spark, sf))


# --- selection --------------------------------------------------------------------------------------


@query(
    "k4_softmax_weights",
    f"""WITH {VOCAB_SQL}, {PREDICTIONS_SQL} SELECT id_vocab, {', '.join(
        f"round(1000 * exp({b} * (1 - english_proba)) / sum(exp({b} * (1 - english_proba))) OVER (), 6) AS softmax_{b}"
        for b in (1, 2, 3, 4, 5, 10))} FROM fx_predictions""",
)
def k4(spark, sf):
    words = predictions(spark, sf)
    factors = (1, 2, 3, 4, 5, 10)
    words = selection.softmax_weights(words, "english_proba", {f"softmax_{b}": b for b in factors})
    return words.select("id_vocab", *[(F.col(f"softmax_{b}") * 1000).alias(f"softmax_{b}") for b in factors])


R2_LEARNER_SQL = f"""WITH {LEARNER_SQL}, c AS (SELECT learner_id, id_vocab,
        sum(CASE WHEN language_asked = 'english' THEN 2 * result - 1 END) AS ge, sum(CASE WHEN language_asked = 'german' THEN 2 * result - 1 END) AS eg
      FROM fx_tries GROUP BY 1, 2)
    SELECT learner_id, id_vocab, CAST(score_german_english + coalesce(ge, 0) AS BIGINT) AS score_german_english,
      CAST(score_english_german + coalesce(eg, 0) AS BIGINT) AS score_english_german,
      try_session_german_english OR ge IS NOT NULL AS try_session_german_english,
      try_session_english_german OR eg IS NOT NULL AS try_session_english_german
    FROM fx_words LEFT JOIN c USING (learner_id, id_vocab)"""


@query("r2_update_vocab_per_learner", R2_LEARNER_SQL)
def r2_per_learner(spark, sf):
    return review.update_vocab(learner_words(spark, sf), tries(spark, sf), LEARNER)


@query(
    "k5_choose_words",
    f"""WITH {VOCAB_SQL}, {PREDICTIONS_SQL}, d AS (
      SELECT id_vocab, 4 * (1 - english_proba) - ln(-ln({UNIFORM_SQL.format(seed=42, id='id_vocab')} + 0.5E0 / 4294967296.0E0)) AS draw
      FROM fx_predictions)
    SELECT id_vocab, round(draw, 6) AS draw FROM d ORDER BY d.draw DESC, id_vocab LIMIT 200""",
)
def k5(spark, sf):
    return selection.choose_words(predictions(spark, sf), "english_proba", 200, 42, 4).select("id_vocab", "draw")


K7_SQL = f"""WITH {VOCAB_SQL}, {PREDICTIONS_SQL}, a AS (
  SELECT id_vocab, CASE WHEN {UNIFORM_SQL.format(seed=8, id='id_vocab')} < 0.5 THEN 'german' ELSE 'english' END AS language_asked,
         english_proba, german_proba
  FROM fx_vocab JOIN fx_predictions USING (id_vocab)
  WHERE NOT (try_session_german_english OR try_session_english_german)), d AS (
  SELECT id_vocab, language_asked, 3 * (1 - CASE language_asked WHEN 'german' THEN german_proba ELSE english_proba END)
    - ln(-ln({UNIFORM_SQL.format(seed=7, id='id_vocab')} + 0.5E0 / 4294967296.0E0)) AS draw FROM a)"""


@query(
    "k6_direction_of_a_try",
    f"""{K7_SQL} SELECT id_vocab, language_asked FROM a""",
)
def k6(spark, sf):
    words = review.with_probabilities(vocab(spark, sf), predictions(spark, sf))
    return selection.with_direction(words, 7).select("id_vocab", "language_asked")


@query(
    "k7_plan_session",
    f"""{K7_SQL} SELECT CAST(row_number() OVER (ORDER BY draw DESC, id_vocab) AS BIGINT) AS slot, id_vocab, language_asked
    FROM d ORDER BY draw DESC, id_vocab LIMIT 100""",
)
def k7(spark, sf):
    words = review.with_probabilities(vocab(spark, sf), predictions(spark, sf))
    return selection.plan_session(words, 7).select("slot", "id_vocab", "language_asked")


PER_LEARNER_SQL = f"""WITH {LEARNER_SQL}, j AS (SELECT * FROM fx_words JOIN fx_learner_predictions USING (learner_id, id_vocab))"""


def learner_joined(spark, sf):
    return review.with_probabilities(learner_words(spark, sf), learner_predictions(spark, sf), LEARNER)


@query("j1_vocab_with_probabilities_per_learner", f"{PER_LEARNER_SQL} SELECT learner_id, id_vocab, english_proba, german_proba FROM j")
def j1_per_learner(spark, sf):
    return learner_joined(spark, sf).select("learner_id", "id_vocab", "english_proba", "german_proba")


@query("t6_words_left_per_learner", f"{PER_LEARNER_SQL} {REPORT_SQL.replace('SELECT', 'SELECT learner_id,', 1)} FROM fx_learner_predictions GROUP BY learner_id")
def t6_per_learner(spark, sf):
    return review.knowledge_report(learner_predictions(spark, sf), partition_by=LEARNER)


@query("d7_post_review_report_per_learner", f"{PER_LEARNER_SQL} {REPORT_SQL.replace('SELECT', 'SELECT learner_id,', 1)} FROM j GROUP BY learner_id")
def d7_per_learner(spark, sf):
    return next_session.post_review_report(learner_words(spark, sf), learner_predictions(spark, sf), LEARNER)


@query(
    "k4_softmax_weights_per_learner",
    f"""{PER_LEARNER_SQL} SELECT learner_id, id_vocab,
      round(exp(3 * (1 - english_proba)) / sum(exp(3 * (1 - english_proba))) OVER (PARTITION BY learner_id), 6) AS softmax FROM j""",
)
def k4_per_learner(spark, sf):
    words = selection.softmax_weights(learner_joined(spark, sf), "english_proba", {"softmax": 3}, LEARNER)
    return words.select("learner_id", "id_vocab", "softmax")


_PAIR = "learner_id::varchar || ':' || id_vocab"


@query(
    "k7_plan_session_per_learner",
    f"""{PER_LEARNER_SQL}, a AS (
      SELECT *, CASE WHEN {UNIFORM_SQL.format(seed=8, id=_PAIR)} < 0.5 THEN 'german' ELSE 'english' END AS language_asked
      FROM j WHERE NOT (try_session_german_english OR try_session_english_german)), d AS (
      SELECT learner_id, id_vocab, language_asked, 3 * (1 - CASE language_asked WHEN 'german' THEN german_proba ELSE english_proba END)
        - ln(-ln({UNIFORM_SQL.format(seed=7, id=_PAIR)} + 0.5E0 / 4294967296.0E0)) AS draw FROM a), r AS (
      SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY draw DESC, id_vocab) AS slot FROM d)
    SELECT learner_id, CAST(slot AS BIGINT) AS slot, id_vocab, language_asked FROM r WHERE slot <= 4""",
)
def k7_per_learner(spark, sf):
    plan = selection.plan_session(learner_joined(spark, sf), 7, 4, partition_by=LEARNER)
    return plan.select("learner_id", "slot", "id_vocab", "language_asked")


# --- dictionary building ----------------------------------------------------------------------------


@query("u3_all_vocab", f'WITH {LISTS_SQL} SELECT "German" AS german, "English" AS english FROM fx_lists')
def u3(spark, sf):
    return vocabulary.all_vocab(word_lists(spark, sf))


LIST_DRAW = "CAST(('0x' || substr(md5('42:' || \"German\" || ':' || \"English\"), 1, 8)) AS BIGINT) / 4294967296.0E0"


@query(
    "k3_sample_words",
    f"""WITH {LISTS_SQL} SELECT "German", "English", round({LIST_DRAW}, 6) AS draw FROM fx_lists
    ORDER BY {LIST_DRAW}, "German", "English" LIMIT 150""",
)
def k3(spark, sf):
    lists = word_lists(spark, sf).select("German", "English")
    return vocabulary.sample_words(lists, 42, 150).withColumnRenamed("_draw", "draw").drop("_place")


def _step_sql(step):
    """Words of one list that are new after the steps before, as a CTE."""
    known = "fx_known" if step == 0 else f"v{step - 1}"
    return f""", n{step} AS (SELECT "German", "English", {LIST_DRAW} AS draw FROM fx_lists l WHERE list = {step}
      AND NOT EXISTS (SELECT 1 FROM {known} k WHERE k.english = l."English")
      AND NOT EXISTS (SELECT 1 FROM {known} k WHERE k.german = l."German")), v{step} AS (
      SELECT * FROM {known} UNION ALL
      SELECT (SELECT max(id_vocab) FROM {known}) + row_number() OVER (ORDER BY draw, "German", "English"),
             "German", "English", 0, 0, FALSE, FALSE FROM n{step})"""


@query(
    "u4_add_words",
    f"""WITH {LISTS_SQL}, fx_known AS (SELECT * FROM fx_vocab WHERE english LIKE 'to %')"""
    + "".join(_step_sql(i) for i in range(4))
    + """ SELECT CAST(id_vocab AS BIGINT) AS id_vocab, german, english, CAST(score_german_english AS BIGINT) AS score_german_english,
      CAST(score_english_german AS BIGINT) AS score_english_german, try_session_german_english, try_session_english_german FROM v3""",
)
def u4(spark, sf):
    known = vocab(spark, sf).filter(F.col("english").startswith("to "))
    lists = word_lists(spark, sf)
    return vocabulary.add_words(known, [lists.filter(F.col("list") == i) for i in range(4)])


@query(
    "t4_rename_and_drop",
    f"""WITH {VOCAB_SQL}, {PREDICTIONS_SQL} SELECT id_vocab, german AS german_word, english AS english_word,
      score_english_german AS score_before FROM fx_vocab JOIN fx_predictions USING (id_vocab)""",
)
def t4(spark, sf):
    joined = review.with_probabilities(vocab(spark, sf), predictions(spark, sf))
    renamed = joined.withColumnsRenamed(
        {"german": "german_word", "english": "english_word", "score_english_german": "score_before"}
    )
    return renamed.drop(
        "english_proba",
        "german_proba",
        "score_german_english",
        "try_session_german_english",
        "try_session_english_german",
    )
