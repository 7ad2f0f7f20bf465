import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


#: Tests that fit, search or stream for long; `--fast` leaves them out.
SLOW = ("train_end_to_end", "segments_artefacts", "held_out_users", "variants_grid", "feature_sets", "algorithm_table", "spectral_on", "meetings_over", "many_rounds", "about_as_good", "calibration_lowers", "ten_million", "exhaustive_winner", "every_candidate", "forest_search", "new_user_channels", "eps_selection")


def pytest_addoption(parser):
    parser.addoption("--fast", action="store_true", help="leave out the tests that take longest")


def pytest_collection_modifyitems(config, items):
    if config.getoption("--fast"):
        for item in items:
            if any(name in item.name for name in SLOW):
                item.add_marker(pytest.mark.skip(reason="slow"))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.host", "127.0.0.1").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s
