"""Every query that has SQL, against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from imagelake.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def text(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    made = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(made.columns)
    rows = lambda data: sorted("|".join(map(text, r)) for r in data)
    assert rows(made.select(*columns).collect()) == rows(want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_takes_all_pixels(spark, con):
    made = {r.n: (r.samples, r.differing) for r in __spark_entry__.entry(spark).collect()}
    assert made == {n: (k, 0) for n, k in con.execute("SELECT l_linenumber, count(*) FROM lineitem GROUP BY ALL").fetchall()}


def test_image_patterns(spark):
    """All pixels of all patterns against integer formulas."""
    from imagelake.operators import generate

    def noise(x, y, channel):
        h = (x * 73_856_093 ^ y * 19_349_663 ^ channel * 83_492_791 ^ 0x9E3779B9) & 0xFFFFFFFF
        for shift, factor in ((16, 0x45D9F3B), (15, 0x2C1B3C6D)):
            h = (h ^ h >> shift) * factor & 0xFFFFFFFF
        return h >> 24

    width, height = 11, 5
    ramp = lambda v, size: 255 * v // (size - 1)
    formulas = {
        "flat": lambda x, y: (127, 127, 127, 255),
        "ramp": lambda x, y: (ramp(x, width), ramp(y, height), (ramp(x, width) + ramp(y, height)) // 2, 255),
        "checker": lambda x, y: (*((x ^ y) % 2 * 255,) * 3, 255),
        "impulse": lambda x, y: (*(255 * (x == 5 and y == 2),) * 3, 255),
        "stripes": lambda x, y: (x % 2 * 255, y % 2 * 255, (x + y) % 2 * 255, 255),
        "chroma": lambda x, y: (0, 128, 255, 255) if x // 8 % 2 else (255, 0, 0, 255),
        "alpha": lambda x, y: (ramp(x, width), ramp(y, height), 255 - ramp(x, width), ramp(x, width)),
        "noise": lambda x, y: (*(noise(x, y, c) for c in range(3)), 255),
    }
    assert set(formulas) == set(generate.PATTERNS)
    for name, formula in formulas.items():
        made = {(r.y, r.x): (r.r, r.g, r.b, r.a) for r in generate.image(spark, name, width, height).collect()}
        assert made == {(y, x): formula(x, y) for y in range(height) for x in range(width)}, name
