import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from playseq.session import builder

    session = (
        builder(
            "tests",
            spark__sql__shuffle__partitions="4",
            spark__ui__enabled="false",
            spark__ui__showConsoleProgress="false",
            spark__driver__memory="6g",
            spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
        )
        .master("local[8]")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Treat every key with more than 40 rows as hot."""
    spark.conf.set("spark.playseq.hotRows", "40")
    yield
    spark.conf.unset("spark.playseq.hotRows")


def collected(df, *columns):
    """Rows as sorted tuples, for comparison."""
    df = df.select(*(columns or sorted(df.columns)))
    return sorted((tuple(r) for r in df.collect()), key=repr)
