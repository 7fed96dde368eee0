import pytest

from wattlens.session import build_session, ship_package


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    settings = {
        "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "8g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    }
    session = build_session("tests", "local[8]", **settings)
    ship_package(session)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
