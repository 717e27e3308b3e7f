"""Retrieval analytics and training-data preparation as Spark programs."""

from __future__ import annotations

import os
import shutil
import tempfile

_shipped: set[str] = set()


def ship(spark) -> None:
    """Gives this package to the session's Python workers, once per application, as ``spark-submit --py-files`` would."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), "sievewright")
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))
        _shipped.add(app)
