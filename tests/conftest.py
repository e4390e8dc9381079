import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from cellforge.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    session = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{shared}"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.exists(f"{DATA}/shapes.parquet"):
        pytest.skip("the test tables aren't here")
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import glob

    import duckdb

    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, float):
        return None if value != value else round(value, 9)
    try:
        number = float(value)
    except (TypeError, ValueError):
        return str(value)
    return int(number) if number == int(number) and abs(number) < 2**53 else int(value) if number == int(number) else round(number, 9)


def bag(columns, rows):
    """Rows as comparable tuples, columns by name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) if not isinstance(r[i], int) or isinstance(r[i], bool) else r[i] for i in order)) for r in rows)


def assert_same(df, db, sql):
    result = db.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    fix = lambda rows: [tuple(int(v) if isinstance(v, float) and v == int(v) else v for v in r) for r in rows]
    assert bag(df.columns, fix(tuple(r) for r in df.collect())) == bag(columns, fix(result.fetchall()))
