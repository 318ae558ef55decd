"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Words (runs without white space) and pairs of neighbouring words are hashed into ``buckets`` each. The raw multinomials
count them over all documents, the target ones over trusted documents, drawn towards the raw shares by the weight of
``buckets`` n-grams: what a small target has not seen counts little. A document's score is the mean of
log(target / raw) over its n-grams, so length does not matter, and it is kept if the score reaches a threshold.

How far unseen good documents fall below 0 depends on the size of target and corpus. So half of the trusted documents are held
out of the target, and the threshold is taken from their scores: as far below the ``LOW`` quantile as ``SLACK`` times
the distance from there to the median. Scores are rounded to ``DIGITS`` digits: the order of a sum then decides
no document. Base rules on the shape of the text reject first.

All of it is DataFrame functions. Counts per bucket are aggregated before they are shuffled and then turned into a
literal array: twice ``buckets`` weights, a parameter and not a function of the input. Every trusted document counts, in
the target or for the threshold. Their number grows with the input, so their ids are not broadcast: texts are shuffled to
them, once for the counts and once for the held-out ones, and the first shuffle's files go before the second begins.

Defined cases: a null, empty or blank text has no words, fails the base rule, and scores 0; one word has no pair;
rows with a null id are judged like others; repeated rows get equal verdicts and count again in the
multinomials; with no trusted document at all every score is 0, and with none held out that passes the base rules only the base
rules reject; an empty table gives an empty one. Columns named like those added are replaced; all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_engine.llm.common import Scratch, table
from recall_engine.llm.registry import query
from recall_engine.operators.global_order import exact_quantiles

BUCKETS = 1 << 14
#: Where the threshold lies below the scores of the held-out trusted documents.
LOW, SLACK = 0.01, 0.5
DIGITS = 6
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, whatever the optimizer inlines."""
    return F.transform(F.array(value), use)[0]


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns as the single element of a generated array: no later filter or projection computes them again."""
    return df.select("*", F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))))


def with_words(docs: DataFrame, text: Column) -> DataFrame:
    """Adds ``_plain``, ``_words`` and ``_hashes``; the text is split and a word is hashed once a pass."""
    bare = F.btrim("_plain", F.lit(" \t\n\x0b\f\r"))
    none = F.array().cast("array<string>")
    words = F.when(bare == "", none).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    split = computed(docs.withColumn("_plain", F.coalesce(text, F.lit(""))), _words=words)
    return computed(split, _hashes=F.transform("_words", lambda w: F.xxhash64(w)))


def windows_of(hashes: str) -> Column:
    """Hashes of all three neighbouring words."""
    triple = lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2))
    return F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - 2, F.lit(0))), triple)


def repeated_words(windows: str) -> Column:
    """Words inside 3-word windows that stand in the text twice or more.

    Most texts have no window twice, and their distinct windows say so. In others windows (as 64-bit hashes; two that
    differ inside one text have equal ones with a chance below 2**-30 even at a hundred thousand words) sorted with their
    places put equal ones side by side; the places of repeated windows, sorted again, each cover up to three words that
    the one before did not.
    """

    def repeated(sorted_windows: Column) -> Column:
        n = F.size(sorted_windows)
        text = lambda i: F.element_at(sorted_windows, i)["t"]

        def kept(i: Column) -> Column:
            before = F.when(i > 1, text(F.greatest(i - 1, F.lit(1))) == text(i)).otherwise(False)
            after = F.when(i < n, text(F.least(i + 1, n)) == text(i)).otherwise(False)
            return before | after

        places = F.transform(
            F.filter(F.sequence(F.lit(1), n), kept), lambda i: F.element_at(sorted_windows, i)["p"]
        )
        return _bound(F.sort_array(places), covered)

    def covered(places: Column) -> Column:
        new = F.transform(
            places,
            lambda p, i: F.when(i == 0, F.lit(3)).otherwise(
                F.least(F.lit(3), p - F.element_at(places, F.greatest(i, F.lit(1))))
            ),
        )
        return F.aggregate(new, F.lit(0), lambda total, x: total + x)

    placed = F.transform(windows, lambda t, p: F.struct(t.alias("t"), p.alias("p")))
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(some, _bound(F.sort_array(placed), repeated)).otherwise(F.lit(0)).cast("long")


def duplicate_lines(plain: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(plain, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\f\r"))) > 0)
    return _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def pairs_of(hashes: str) -> Column:
    """Hashes of all two neighbouring words."""
    return F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda h, i: F.xxhash64(h, F.get(hashes, i + 1)))


def _bucket(h: Column, order: int, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int") + order * buckets


def grams_of(hashes: str, buckets: int) -> Column:
    """Bucket of every word and of every pair of neighbouring words; pairs have buckets of their own."""
    ones = F.transform(hashes, lambda h: _bucket(h, 0, buckets))
    return F.concat(ones, F.transform(pairs_of(hashes), lambda h: _bucket(h, 1, buckets)))


def bucket_weights(docs: DataFrame, trusted: Column, text_col: str, buckets: int, scratch: Scratch) -> DataFrame:
    """``_bucket`` and ``_weight`` = log(target share / raw share); one row per bucket that the corpus has.

    The target share is drawn towards the raw one as if ``buckets`` further n-grams had been seen in the raw shares.
    """
    grams = with_words(docs.select(trusted.cast("int").alias("_trusted"), text_col), F.col(text_col))
    grams = grams.select("_trusted", F.explode(grams_of("_hashes", buckets)).alias("_bucket"))
    counts = grams.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_raw"), F.sum("_trusted").alias("_target"))
    counts = scratch.stage(counts.withColumn("_order", F.floor(F.col("_bucket") / buckets)), "bucket-counts")
    totals = counts.groupBy("_order").agg(F.sum("_raw").alias("_all"), F.sum("_target").alias("_all_target"))
    share = F.col("_raw") / F.col("_all")
    weight = F.log((F.col("_target") + buckets * share) / (F.col("_all_target") + buckets) / share)
    return counts.join(totals, "_order").select("_bucket", weight.alias("_weight"))


def _judged(docs: DataFrame, text_col: str, buckets: int, found: dict[int, float]) -> DataFrame:
    """All columns with the base measures, ``base_failed`` and ``score``."""
    # A literal array in the order of the buckets, folded once, so that scoring needs no join.
    weights = F.split(F.lit(",".join(repr(found.get(i, 0.0)) for i in range(2 * buckets))), ",").cast("array<double>")
    add = lambda order: lambda total, h: total + F.get(weights, _bucket(h, order, buckets))
    sums = F.aggregate("_hashes", F.lit(0.0), add(0)) + F.aggregate(pairs_of("_hashes"), F.lit(0.0), add(1))
    size = F.size("_hashes")
    kept = [c for c in docs.columns if c not in (*MEASURES, "score", "base_failed", "kept")]
    split = computed(with_words(docs.select(*kept), F.col(text_col)), _windows=windows_of("_hashes"))
    measured = computed(
        split,
        n_words=size.cast("long"),
        word_chars=F.length(F.array_join("_words", "")).cast("long"),
        n_symbols=F.regexp_count("_plain", F.lit(f"[{SYMBOLS}]")).cast("long"),
        n_dup_lines=duplicate_lines(F.col("_plain")),
        n_repeat_words=repeated_words("_windows"),
        score=F.when(size == 0, 0.0).otherwise(F.round(sums / (2 * size - 1), DIGITS)),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return measured.select(*kept, *MEASURES, "score").withColumn("base_failed", failed)


def judge_quality(
    docs: DataFrame,
    trusted_ids: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """All rows and columns of ``docs`` with the base measures, ``base_failed``, ``score`` and ``kept``.

    ``trusted_ids`` has the ids of the trusted documents in its first column. Half of them (by the hash of the id) fit the
    target. Without ``least`` the other half, which the target has not seen, gives the threshold.
    """
    ids = trusted_ids.select(F.col(trusted_ids.columns[0]).alias("_good")).filter("_good IS NOT NULL").distinct()
    fits = F.pmod(F.xxhash64(F.lit(1), "_good"), F.lit(2)) == 0
    # Merged at every size, so that disk and memory grow evenly.
    marks, unseen = ids.filter(fits).withColumn("_mark", F.lit(True)).hint("merge"), ids.filter(~fits).hint("merge")
    own = F.col(id_col) == F.col("_good")
    with Scratch(docs.sparkSession) as scratch:
        marked = docs.select(id_col, text_col).join(marks, own, "left")
        weights = bucket_weights(marked, F.coalesce("_mark", F.lit(False)), text_col, buckets, scratch)
        found = {r["_bucket"]: r["_weight"] for r in weights.collect()}  # 2 * `buckets` rows at most
        if least is None:
            held = _judged(docs.select(id_col, text_col).join(unseen, own, "left_semi"), text_col, buckets, found)
            scores = scratch.stage(held.filter("NOT base_failed").select("score"), "held-scores")
            tail = exact_quantiles(scores, "score", {"low": LOW, "middle": 0.5}).first()
            least = float("-inf") if tail["low"] is None else tail["low"] - SLACK * (tail["middle"] - tail["low"])
    kept = ~F.col("base_failed") & (F.col("score") >= F.lit(least))
    return _judged(docs, text_col, buckets, found).withColumn("kept", kept)


def trusted_documents(labels: DataFrame) -> DataFrame:
    """Ids labelled as good and not toxic."""
    return labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id").distinct()


@query("op6_target_ratio")
def op6_target_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge_quality(docs, trusted_documents(table(spark, sf_dir, "labels")))
    return judged.select("doc_id", *MEASURES, "base_failed", "kept", "score")
