import datetime
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from recall_engine.session import local_session  # noqa: E402

TRY = (
    "id_historical_data LONG, learner_id LONG, id_vocab LONG, german_word STRING, english_word STRING, "
    "score_before DOUBLE, score_before_other_language DOUBLE, language_asked STRING, result DOUBLE, guess STRING, "
    "question_time DOUBLE, write_it_again STRING, confused_word LONG, is_it_another_word BOOLEAN, "
    "datetime TIMESTAMP_NTZ, id_session LONG"
)


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def make_tries(spark):
    """Tries from short dictionaries; what is left out gets a plain default."""
    from pyspark.sql import functions as F

    defaults = dict(
        learner_id=1,
        id_vocab=1,
        german_word="der Hund",
        english_word="the dog",
        score_before=0.0,
        score_before_other_language=0.0,
        language_asked="german",
        result=1.0,
        guess="der Hund",
        question_time=2.0,
        write_it_again=None,
        confused_word=None,
        is_it_another_word=None,
        datetime=datetime.datetime(2021, 1, 4, 8, 0, 0),
        id_session=0,
    )

    def build(rows):
        names = ["id_historical_data", *defaults]
        data = [tuple({**defaults, "id_historical_data": i, **r}[n] for n in names) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, _ordered(names)).withColumn("day", F.to_date("datetime"))

    return build


def _ordered(names):
    kinds = dict(part.strip().split(" ") for part in TRY.split(","))
    return ", ".join(f"{n} {kinds[n]}" for n in names)


def day(n, hour=8, minute=0):
    return datetime.datetime(2021, 1, n, hour, minute)
