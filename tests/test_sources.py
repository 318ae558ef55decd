"""Files in and out, in the formats the tables are kept in."""

import datetime

import pytest
from pyspark.sql import functions as F

from recall_engine.sources import files, versions

HEADER = (
    "id_vocab,german_word,english_word,score_before,score_before_other_language,language_asked,result,guess,"
    "question_time,write_it_again,confused_word,is_it_another_word,datetime"
)
LOG = [
    "3.0,September,September,1.0,2.0,german,1.0,September,3.0,,,,2020-10-23 23:05:21.711325",
    '6.0,verheiratet,married,-1.0,2.0,german,0.0,"a ""b"", c",1.0,jo,,False,2020-10-23 23:05:24.853849',
    "7.0,wirklich,really,1.0,2.0,english,0.0,,0.0,,0.0,True,2020-10-24 11:05:24.853850",
]


def test_read_tries(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("\n".join([HEADER, *LOG]) + "\n")
    rows = files.read_tries(spark, str(path)).orderBy("id_historical_data").collect()
    assert [r.id_historical_data for r in rows] == [0, 1, 2]
    assert [r.id_session for r in rows] == [0, 0, 1]  # one microsecond over twelve hours
    assert [r.guess for r in rows] == ["September", 'a "b", c', ""]
    assert [r.id_vocab for r in rows] == [3, 6, 7] and rows[0].write_it_again is None
    assert [r.is_it_another_word for r in rows] == [None, False, True]
    assert [r.confused_word for r in rows] == [None, None, 0]
    assert rows[2].day == datetime.date(2020, 10, 24)
    assert rows[1].datetime == datetime.datetime(2020, 10, 23, 23, 5, 24, 853849)


def test_read_tries_without_confusion_columns(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(
        "id_vocab,german_word,english_word,score_before,score_before_other_language,language_asked,result,guess,"
        "question_time,write_it_again,datetime\n1.0,ja,yes,0.0,0.0,german,1.0,ja,1.0,,2020-10-23 23:05:21.711325\n"
    )
    row = files.read_tries(spark, str(path), confusion_columns=False).first()
    assert row.confused_word is None and row.is_it_another_word is None and row.id_vocab == 1


def test_row_ids_follow_files_and_lines(spark, tmp_path):
    for n in (2, 0, 1):
        lines = [f"{n}.0,w,w,0.0,0.0,german,1.0,g{n}{i},1.0,,,,2020-10-23 23:05:21.711325" for i in range(3)]
        (tmp_path / f"part-{n}.csv").write_text("\n".join([HEADER, *lines]) + "\n")
    rows = files.read_tries(spark, str(tmp_path)).orderBy("id_historical_data").collect()
    assert [r.guess for r in rows] == [f"g{n}{i}" for n in range(3) for i in range(3)]


def test_a_broken_cell_is_an_error(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(HEADER + "\n" + LOG[0].replace("2020-10-23", "yesterday") + "\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        files.read_tries(spark, str(path)).collect()


def test_vocab_columns(spark, tmp_path):
    path = tmp_path / "vocab.csv"
    path.write_text(
        "id_vocab,german,english,score_german_english,score_english_german,try_session_german_english,"
        "try_session_english_german\n1,rennen,to sprint,0,-3,False,True\n"
    )
    assert files.read_vocab(spark, str(path)).columns == ["id_vocab", "german", "english"]
    assert len(files.read_vocab(spark, str(path), "all").columns) == 7
    row = files.read_vocab(spark, str(path), ["score_english_german", "try_session_english_german"]).first()
    assert tuple(row) == (-3, True)
    plan = files.read_vocab(spark, str(path))._jdf.queryExecution().executedPlan().toString()
    assert "score_german_english" not in plan.split("ReadSchema")[1]


def test_word_lists_of_both_shapes(spark, tmp_path):
    graded = "German,English,Score,SucceedSession,Succeed,TrySession,Retry\n"
    (tmp_path / "Minus3points.csv").write_text(graded + "vorsichtig,cautious,-3,FALSE,FALSE,TRUE,01/01/2022\n")
    (tmp_path / "a1_1.csv").write_text("German,English\naber,but\n")
    rows = files.read_word_lists(spark, str(tmp_path), {"Minus3points": -3, "a1_1": 5}).collect()
    got = {r.German: (r.list, r.difficulty_category, r.Score) for r in rows}
    assert got == {"vorsichtig": ("Minus3points", -3, -3), "aber": ("a1_1", 5, None)}


def test_log_lines(spark, tmp_path):
    path = tmp_path / "log.txt"
    path.write_text("  first \n\n   \nsecond\n\tthird\n")
    rows = files.read_log_lines(spark, str(path)).orderBy("line").collect()
    assert [tuple(r) for r in rows] == [(0, "first"), (1, "second"), (2, "third")]


def test_append(spark, tmp_path):
    path = str(tmp_path / "history")
    df = spark.range(3).select(F.col("id").alias("id_vocab"), (F.col("id") / 4).alias("english_proba"), F.lit(0.5).alias("german_proba"))
    files.append_tries(df, path)
    before = {f.name for f in (tmp_path / "history").glob("*.parquet")}
    files.append_tries(df, path)
    assert before < {f.name for f in (tmp_path / "history").glob("*.parquet")}
    assert spark.read.parquet(path).count() == 6


def test_readers_see_a_complete_version(spark, tmp_path):
    """Also while a version is being written, and after a write that failed."""
    published = str(tmp_path / "published")
    df = spark.range(3).select(F.col("id").alias("id_vocab"), (F.col("id") / 4).alias("english_proba"), F.lit(0.5).alias("german_proba"))
    with pytest.raises(FileNotFoundError):
        files.read_published(spark, published)
    files.publish(df, published)
    first = files.read_published(spark, published)
    broken = df.withColumn("english_proba", F.when(F.col("id_vocab") == 2, F.raise_error(F.lit("lost"))).otherwise(0.1).cast("double"))
    with pytest.raises(Exception, match="lost"):
        files.publish(broken, published)
    assert sorted(files.read_published(spark, published).collect()) == sorted(df.collect())
    files.publish(df.withColumn("german_proba", F.lit(0.75)), published)
    assert {r.german_proba for r in files.read_published(spark, published).collect()} == {0.75}
    assert sorted(first.collect()) == sorted(df.collect())  # a reader of the version before keeps it


def test_folded_log_merges_replays_and_forgets(spark, tmp_path):
    merge = lambda rows: rows.groupBy("k").agg(F.sum("v").alias("v"))
    schema = spark.createDataFrame([], "k long, v long").schema
    open_log = lambda: versions.FoldedLog(spark, str(tmp_path / "log"), schema, merge, every=3)
    total = lambda: {r.k: r.v for r in open_log().read().collect()}
    delta = lambda n: spark.createDataFrame([(0, n), (n, 1)], schema)
    assert total() == {}
    for n in range(1, 8):
        open_log().append(delta(n), n)
        if n in (2, 3, 7):  # again: while a delta, at a fold, after it
            open_log().append(delta(n), n)
    want = {0: 28} | {n: 1 for n in range(1, 8)}
    assert total() == want and versions.current(spark, str(tmp_path / "log")).endswith("upto=6")
    (tmp_path / "log" / "delta" / "batch=8").mkdir()  # a write that never ended
    (tmp_path / "log" / "base" / "upto=9").mkdir()
    open_log().append(delta(5), 5)
    assert total() == want
    open_log().drop_folded()
    assert total() == want
    assert sorted(p.name for p in (tmp_path / "log" / "delta").iterdir()) == ["batch=7", "batch=8"]


def test_finish_vocab_drops_probabilities(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "b", 0.1, 0.2)], "id_vocab LONG, german STRING, english STRING, english_proba DOUBLE, german_proba DOUBLE")
    files.finish_vocab(df, str(tmp_path / "v"))
    assert spark.read.option("header", True).csv(str(tmp_path / "v")).columns == ["id_vocab", "german", "english"]
