"""Stored tables: one folder for each application, deleted on demand."""

from pathlib import Path
from urllib.parse import urlparse

from tidemark.sources import shared


def test_clear_deletes_this_application_only(spark):
    folder = Path(urlparse(shared.shared_folder(spark)).path)
    other = folder / "another-application"
    other.mkdir(exist_ok=True)
    kept = shared.stored(spark.range(10), "ten")
    assert kept.count() == 10
    own = folder / spark.sparkContext.applicationId
    assert list(own.glob("ten-*"))
    shared.clear(spark)
    assert not own.exists()
    assert other.exists()
    shared.clear(spark)  # nothing left to delete
    assert shared.stored(spark.range(3), "three").count() == 3
