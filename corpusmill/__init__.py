"""Corpus analytics on Spark: operators, sources and functions for parallel text and machine-translation data."""

from __future__ import annotations

import os
import tempfile
import zipfile

_shipped: set[str] = set()


def ship(spark) -> None:
    """Send this package to the executors, once a Spark application, so that their Python can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="corpusmill"), "corpusmill.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("corpusmill", os.path.relpath(full, home)))
    spark.sparkContext.addPyFile(path)
