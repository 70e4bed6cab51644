import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from meridian.session import local_session

    session = local_session(4, "tests", **{"spark.driver.memory": "6g", "spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


def canonical(frame):
    """Columns by name and rows by value, all as text."""
    frame = frame[sorted(frame.columns)]
    text = frame.map(lambda v: tuple(v) if getattr(v, "ndim", 0) or isinstance(v, list) else v).astype(str)
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def duck(sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()
