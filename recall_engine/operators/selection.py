"""Choosing the words of a session: the less likely a word is known, the more often it is asked."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recall_engine.functions.hashing import gumbel, uniform
from recall_engine.operators.global_order import dense_id
from recall_engine.operators.review import not_yet_tried
from recall_engine.schemas import LANGUAGES

SHARPNESS = 3.0  # factor of the softmax argument
MAX_TRIES = 100  # tries of one session
SHARES = 16  # parts of a learner's words that are ranked apart first


def softmax_weights(
    words: DataFrame, proba: str, names: Mapping[str, float], partition_by: Sequence[str] = ()
) -> DataFrame:
    """Add the selection probability of each word for one or more sharpness factors ``{new column: factor}``.

    The weights of the table (of each learner) sum to 1. All sums come from one aggregation.
    """
    weights = {n: F.exp(F.lit(float(b)) * (1 - F.col(proba))) for n, b in names.items()}
    sums = words.groupBy(*partition_by).agg(*[F.sum(w).alias(f"_sum_{n}") for n, w in weights.items()])
    if partition_by:
        joined = words.join(sums, list(partition_by))
        return joined.withColumns({n: w / F.col(f"_sum_{n}") for n, w in weights.items()}).drop(*[f"_sum_{n}" for n in names])
    total = sums.select(F.struct("*")).scalar()
    return words.withColumns({n: w / total[f"_sum_{n}"] for n, w in weights.items()})


def choose_words(
    words: DataFrame,
    proba: str,
    count: int,
    seed: int,
    sharpness: float = SHARPNESS,
    key: str = "id_vocab",
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Weighted draw of ``count`` words (of each learner) without replacement, with their ``slot``, 1 the best.

    Drawing, excluding and renormalising one by one equals taking the largest log weights after adding
    independent Gumbel noise, which is one top-k. A learner's words are first cut to the best of each of ``SHARES``
    parts, so no task holds all words of a learner; without a learner the sorted words are numbered range by range.
    """
    score = F.lit(float(sharpness)) * (1 - F.col(proba)) + gumbel(seed, *[F.col(c) for c in (*partition_by, key)])
    drawn = words.withColumn("draw", score)
    best = [F.col("draw").desc(), F.col(key)]
    if not partition_by:
        placed = dense_id(drawn, best, "slot", 1)
        return placed.filter(F.col("slot") <= count)
    share = F.pmod(F.xxhash64(key), F.lit(SHARES))
    inside = Window.partitionBy(*partition_by, "_share").orderBy(*best)
    over_all = Window.partitionBy(*partition_by).orderBy(*best)
    few = drawn.withColumn("_share", share).withColumn("_nth", F.row_number().over(inside)).filter(F.col("_nth") <= count)
    placed = few.drop("_share", "_nth").withColumn("slot", F.row_number().over(over_all).cast("long"))
    return placed.filter(F.col("slot") <= count)


def with_direction(vocab: DataFrame, seed: int, partition_by: Sequence[str] = ()) -> DataFrame:
    """Untried words with the direction of their next try, a fair coin per word (of each learner).

    Both directions are open as long as some word is untried, as a word tried once is out for both.
    """
    ids = [F.col(c) for c in (*partition_by, "id_vocab")]
    coin = F.when(uniform(seed + 1, *ids) < 0.5, LANGUAGES[0]).otherwise(LANGUAGES[1])
    return not_yet_tried(vocab).withColumn("language_asked", coin)


def plan_session(
    vocab: DataFrame, seed: int, tries: int = MAX_TRIES, sharpness: float = SHARPNESS, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Words and directions of a session of at most ``tries`` tries (for each learner).

    Each word gets a fair coin for its direction and competes there with its weight; a word is asked once
    per session. Words tried in either direction are out.
    """
    asked = with_direction(vocab, seed, partition_by)
    proba = F.when(F.col("language_asked") == "german", F.col("german_proba")).otherwise(F.col("english_proba"))
    chosen = choose_words(asked.withColumn("_proba", proba), "_proba", tries, seed, sharpness, partition_by=partition_by)
    return chosen.drop("_proba")
