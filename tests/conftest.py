import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sievewright import build_session
    session = build_session("local[8]", "tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def shop(spark):
    """Two related tables with an orphan, a negative amount and a bad e-mail."""
    customers = spark.createDataFrame(
        [(1, "a@example.com", "2024-01-01", "IN"), (2, "b@example.com", "2024-01-02", "US"),
         (3, "not-an-email", "2024-01-03", "IN"), (4, None, "2024-01-04", "US"),
         (5, "e@example.com", "2024-01-05", "IN")],
        "customer_id long, email string, signup_date string, country string")
    orders = spark.createDataFrame(
        [(100, 1, 10.5), (101, 2, 20.0), (102, 3, -5.0), (103, 999, 15.0)],
        "order_id long, customer_id long, amount double")
    customers.createOrReplaceTempView("customers")
    orders.createOrReplaceTempView("orders")
    return customers, orders
