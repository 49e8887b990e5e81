import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    """A session with little overhead per query: the tests check results, not speed."""
    from matchspark.session import local_session
    return local_session(
        "tests", "8", shuffle_partitions=2, **{
            "spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false",
            "spark.sql.codegen.factoryMode": "NO_CODEGEN"})


def rows(df):
    return sorted(tuple(r) for r in df.collect())
