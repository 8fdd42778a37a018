import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = os.environ.get("QUARRY_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from quarry.session import local_session

    s = local_session(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).exists():
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def bare(spark, data, tmp_path_factory):
    """Folders of the test tables without rows, and with six rows each of keys and nulls."""
    from pyspark.sql import functions as F

    keys = {"doc_id", "chunk_id", "q_id", "ans_id", "ret_id", "item_id", "vec_id", "event_id", "pack_id"}
    out = {k: str(tmp_path_factory.mktemp(k)) for k in ("empty", "null")}
    for p in Path(data).glob("*.parquet"):
        t = spark.read.parquet(str(p))
        t.limit(0).write.parquet(f"{out['empty']}/{p.name}")
        t.limit(6).select(*(F.col(c) if c in keys else F.lit(None).cast(t.schema[c].dataType).alias(c) for c in t.columns)).write.parquet(f"{out['null']}/{p.name}")
    return out
