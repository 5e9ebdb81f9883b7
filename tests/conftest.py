import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="quire-tests-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lease(spark):
    """Three pages with one section each."""
    texts = [
        "Part A: what the flat costs. The landlord expects rent of $1,420 before the month begins. "
        "Whoever is more than four days behind owes a late fee of $60, and $8 for every day after "
        "that until the rent has come in.",
        "Part B: animals. Ask before you keep a pet of any kind; a dog or a cat that we agree to "
        "adds a pet fee of $220 once and $35 to each monthly payment.",
        "Part C: leaving before time. A tenant may cancel with written notice of ninety days. The "
        "early termination fee is then one and a half monthly payments.",
    ]
    return pages(spark, "lease", texts)


@pytest.fixture(scope="session")
def manual(spark):
    texts = [
        "Keeping the blender clean. Rinse the jug after use, never soak the knives, and let all "
        "parts dry in the open.",
        "Warranty for the blender. We repair the motor free of charge within seven years if you "
        "still have the receipt; jugs and knives wear out and are left out.",
    ]
    return pages(spark, "manual", texts)


def pages(spark, doc_id, texts):
    rows = [(doc_id, f"{doc_id}.pdf", i + 1, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id string, doc_name string, page int, text string")
