import os

import pytest

from chronolex import shared


def test_tables_live_in_the_folder_of_the_session(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "_configured", lambda s: f"file://{tmp_path}/")
    df = shared.materialise(spark.range(5), "t")
    assert df.count() == 5 and os.listdir(tmp_path) == ["chronolex"]
    assert os.listdir(tmp_path / "chronolex") == [spark.sparkContext.applicationId]
    shared.clear(spark)
    assert not [f for f in os.listdir(tmp_path / "chronolex") if not f.startswith(".")]


def test_local_folder_where_none_is_configured(spark, monkeypatch):
    monkeypatch.setattr(shared, "_configured", lambda s: None)
    assert spark.conf.get("spark.checkpoint.dir").startswith("file:///")  # local_session set it
    assert shared.shared_dir(spark).startswith("file:///")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://elsewhere")
    with pytest.raises(RuntimeError):
        shared.shared_dir(spark)


def test_released_tables_are_gone(spark):
    kept, gone = (shared.materialise(spark.range(3), "t") for _ in range(2))
    shared.release(gone, spark.range(2))
    assert kept.count() == 3
    with pytest.raises(Exception):
        gone.count()
