import pytest


@pytest.fixture(scope="session")
def spark():
    from quillmark.session import session

    s = session("local[4]", **{"spark.sql.shuffle.partitions": "4"})
    s.sparkContext.setLogLevel("ERROR")
    return s


SF = "/root/testdata/sf0.01"
