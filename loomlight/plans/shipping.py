"""Sends this package to the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once for each SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_loomlight_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    made = os.path.join(tempfile.mkdtemp(prefix="loomlight-py-"), "loomlight_src.zip")
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join(os.path.basename(top), os.path.relpath(full, top)))
    sc.addPyFile(made)
    sc._loomlight_shipped = True
