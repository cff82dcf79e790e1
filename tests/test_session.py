"""Session settings and the shared folder."""

from pathlib import Path

import pytest

from touchline.session import REQUIRED_CONF, configure, new_run_dir, shared_dir


def test_settings_are_applied(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    configure(spark)
    for key, value in REQUIRED_CONF.items():
        assert spark.conf.get(key) == value


def test_run_folders_lie_in_the_shared_one(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_dir(spark) == configured
    first, second = new_run_dir(spark, "a"), new_run_dir(spark, "a")
    assert first != second and Path(first).parent == Path(configured)


def test_without_a_shared_folder_nothing_is_made_up():
    class Unset:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Unset)
