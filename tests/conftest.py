import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from riskgraph.session import checkpoint_root, get_spark
    s = get_spark("local[*]", shuffle_partitions=8, extra={"spark.driver.memory": "16g"})
    checkpoint_root(s)   # uses the session's folder; makes a scratch one only when unset
    yield s


def edges_df(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "emisor long, receptor long, Fi double")


def seeds_df(spark, ids):
    return spark.createDataFrame([(i, 1) for i in ids], "cont_rut long, score int")
