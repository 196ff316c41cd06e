import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sitetable.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("sitetable-tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


@pytest.fixture
def pages_of(spark):
    def make(*htmls, **columns):
        rows = [(str(i), f"https://site.example/{i}", html) for i, html in enumerate(htmls)]
        return spark.createDataFrame(rows, "id string, url string, html string")
    return make
