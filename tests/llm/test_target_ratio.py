"""Quality rules against a brute-force version, and the defined cases."""

from collections import Counter
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from recall_engine.llm import target_ratio as rules


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(repeated),
        failed,
    )


def grams(spark, text):
    """Buckets by hashing each n-gram on its own; pairs have buckets of their own."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return []
    from pyspark.sql import functions as F

    ones = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(F.xxhash64("w")).collect()]
    pairs = [(i, a, b) for i, (a, b) in enumerate(zip(ones, ones[1:], strict=False))]
    twos = []
    if pairs:
        twos = [r[0] for r in spark.createDataFrame(pairs, "i int, a long, b long").orderBy("i").select(F.xxhash64("a", "b")).collect()]
    return [h % rules.BUCKETS for h in ones] + [rules.BUCKETS + h % rules.BUCKETS for h in twos]


def fitted(spark, ids):
    """The half of the ids that fits the target."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i,) for i in ids], "i long").filter(F.pmod(F.xxhash64(F.lit(1), "i"), F.lit(2)) == 0)
    return {r.i for r in rows.collect()}


def quantile(values, q):
    """Linear interpolation between the sorted values."""
    at = q * (len(values) - 1)
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


def verdicts(spark, texts, trusted):
    """Score of every text, and the threshold."""
    found = {i: grams(spark, t) for i, t in texts.items()}
    fits = fitted(spark, trusted)
    raw, target = Counter(), Counter()
    for i, buckets in found.items():
        raw.update(buckets)
        target.update(buckets if i in fits else [])
    totals = lambda counts: [sum(n for b, n in counts.items() if b // rules.BUCKETS == order) for order in (0, 1)]
    all_raw, all_target = totals(raw), totals(target)

    def ratio(b):
        share = raw[b] / all_raw[b // rules.BUCKETS]
        total = all_target[b // rules.BUCKETS] + rules.BUCKETS
        return math.log((target[b] + rules.BUCKETS * share) / total / share)

    scores = {i: sum(map(ratio, buckets)) / len(buckets) if buckets else 0.0 for i, buckets in found.items()}
    held = sorted(scores[i] for i in trusted if i not in fits and not base(texts[i])[-1])
    if not held:
        return scores, -math.inf
    low = quantile(held, rules.LOW)
    return scores, low - rules.SLACK * (quantile(held, 0.5) - low)


def test_equal_to_brute_force(spark):
    draw = random.Random(1)
    plain = [f"word{i}" for i in range(40)]
    texts = {i: " ".join(draw.choice(plain) for _ in range(draw.choice([0, 1, 2, 3, 60, 120]))) for i in range(8)}
    texts |= {20: None, 21: "", 22: " \n\t ", 23: "same same same " * 40, 24: "a\nb\na\n\na \na", 25: "x|y %% <é> " * 30 + " "}
    texts |= {30: " ".join(f"junk{i}%%%" for i in range(80)), 31: "ab cd ef gh " * 4000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    good = spark.createDataFrame([(i,) for i in range(8)] + [(None,)], "doc_id long")
    got = {r.doc_id: r for r in rules.judge_quality(docs, good).collect()}
    assert 0 < len(fitted(spark, range(8))) < 8
    scores, least = verdicts(spark, texts, range(8))
    for i, text in texts.items():
        row, want = got[i], base(text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed) == want, i
        assert abs(row.score - scores[i]) < 2e-6
        assert row.kept == (not want[-1] and row.score >= least - 4e-6)
    assert not got[30].base_failed


def test_nulls_repeats_clashes_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, 1.0), (1, text, 2.0), (None, text, 3.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long")
    judged = rules.judge_quality(docs, none).collect()
    assert [(r.doc_id, r.n_words, r.score, r.kept) for r in judged] == [(1, 60, 0.0, True), (1, 60, 0.0, True), (None, 60, 0.0, True)]
    assert rules.judge_quality(docs.limit(0), none).collect() == []
    assert "Python" not in rules.judge_quality(docs, none)._jdf.queryExecution().toString()


def test_scores_part_labelled_documents(spark, sf_dir):
    """Whoever is labelled bad and passes the base rules is rejected; whoever is labelled good stays."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = rules.judge_quality(docs, rules.trusted_documents(labels)).join(labels, "doc_id").filter("NOT base_failed")
    right = judged.filter("kept = (quality = 1)").count()
    assert right >= 0.98 * judged.count()


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_good_documents_stay_whose_labels_are_withheld(spark, size):
    """At every size of input; labelled-bad ones that pass the base rules mostly go."""
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{size}/labels.parquet").select("doc_id", "quality")
    seen = rules.trusted_documents(spark.read.parquet(f"/root/testdata/{size}/labels.parquet")).filter("doc_id % 2 = 0")
    judged = rules.judge_quality(docs, seen).filter("NOT base_failed").join(labels, "doc_id")
    kept = {(r.quality, r.odd): (r.n, r.kept) for r in judged.groupBy("quality", (F.col("doc_id") % 2).alias("odd")).agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()}
    n, stay = kept[1, 1]
    assert n > 20 and stay >= 0.95 * n
    if size == "sf0.1":
        n, stay = (kept[0, 0][i] + kept[0, 1][i] for i in (0, 1))
        assert stay <= 0.05 * n


def test_no_filter_computes_a_measure_twice(spark):
    """A filter on the verdict must not be moved below the columns that it reads, where it would split texts again."""
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = rules.judge_quality(docs, docs.select("doc_id").limit(0), least=0.0).filter("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(trim") == 1


def test_every_trusted_document_counts_in_the_target(spark):
    """Far more of them than a bounded sample would take: 52,000 of 104,000 one-word texts fit the target."""
    docs = spark.range(110_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 104_000, "plain").otherwise("junk").alias("text"))
    good = docs.filter("text = 'plain'").select("doc_id")
    fits = good.filter(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)) == 0).count()
    assert fits > 50_000
    share = 104_000 / 110_000
    want = math.log((fits + rules.BUCKETS * share) / (fits + rules.BUCKETS) / share)
    assert abs(rules.judge_quality(docs, good).filter("doc_id = 7").first().score - want) < 1e-6


def test_every_held_out_document_counts_in_the_threshold(spark):
    """Some 6,000 held-out texts of mixed words, and as many others whose shares of foreign words take all values."""
    word = lambda i, n: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(n)))
    foreign = lambda i: F.pmod(F.xxhash64(i, "id"), F.lit(12_000)) < F.col("id") - 12_000
    words = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.when(foreign(i), F.concat(F.lit("x"), word(i, 300))).otherwise(word(i, 300)))
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
    rows = rules.judge_quality(docs, docs.filter("doc_id < 12000").select("doc_id")).select("doc_id", "score", "base_failed", "kept").collect()
    fits = fitted(spark, range(12_000))
    held = sorted(r.score for r in rows if r.doc_id < 12_000 and r.doc_id not in fits and not r.base_failed)
    assert len(held) > 5_000
    low = quantile(held, rules.LOW)
    least = low - rules.SLACK * (quantile(held, 0.5) - low)
    assert [r.doc_id for r in rows if r.kept != (not r.base_failed and r.score >= least)] == []
    assert 0 < sum(r.kept for r in rows if r.doc_id >= 12_000) < 12_000
