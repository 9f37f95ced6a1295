"""Sends this package to the executors, for functions that run in their Python."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark import SparkContext


def ship(sc: SparkContext) -> None:
    """Adds the package as a zip file once per session, so that executors need no copy of the repository."""
    if getattr(sc, "_lodestar_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="lodestar-"), "lodestar.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._lodestar_shipped = True
