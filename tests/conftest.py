from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    builder = (SparkSession.builder.master("local[4]").appName("cadence-tests")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true"))
    s = builder.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):  # only set our own where unset
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="cadence-test-ckpt-"))
    yield s


# One listener's plays: (artist, track, album, day, hour, minute), in UTC.  They hold
# one artist in two casings, plays that fall on the day before in New York, an album
# binge within half an hour, an artist with too few plays and plays without album.
CORPUS = [
    ("Copper Lanterns", "Harbour", "Tidal", 0, 1, 15),
    ("Copper Lanterns", "Signal", "Tidal", 0, 13, 0),
    ("Tin Parade", "Solo March", None, 0, 20, 0),
    ("Copper Lanterns", "Undertow", "Tidal", 1, 9, 30),
    ("Velvet Orchard", "Plum", "Orchard Songs", 2, 6, 0),
    ("Velvet Orchard", "Quince", "Orchard Songs", 2, 6, 4),
    ("Velvet Orchard", "Medlar", "Orchard Songs", 2, 6, 9),
    ("Velvet Orchard", "Plum", "Orchard Songs", 2, 6, 15),
    ("Velvet Orchard", "Damson", "Orchard Songs", 2, 6, 20),
    ("copper lanterns", "Undertow", "Tidal", 2, 22, 5),
    ("Copper Lanterns", "Harbour", "Nightfall", 4, 2, 45),
    ("Copper Lanterns", "Ferry", "Nightfall", 4, 16, 0),
    ("Copper Lanterns", "Ferry", "Nightfall", 8, 11, 0),
    ("Tin Parade", "Solo March", None, 9, 0, 30),
]
BASE = dt.datetime(2025, 3, 10)
AS_OF = BASE + dt.timedelta(days=12)
LEA = 1


def at(day: int, hour: int, minute: int = 0) -> dt.datetime:
    """A time of the corpus, counted from its first day."""
    return BASE.replace(hour=hour, minute=minute) + dt.timedelta(days=day)


@pytest.fixture(scope="session")
def corpus(spark):
    from cadence.schemas import PLAYS

    rows = [(LEA, a, t, al, at(d, h, m)) for a, t, al, d, h, m in CORPUS]
    return spark.createDataFrame(rows, PLAYS)


@pytest.fixture(scope="session")
def small(spark):
    from cadence.sources.testdata import TestTables

    return TestTables(spark, SF_SMALL)
