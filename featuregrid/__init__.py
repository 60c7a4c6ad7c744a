"""featuregrid: pixels, masks, vectors and report tables as Spark DataFrames."""

from __future__ import annotations

import os

__version__ = "0.1.0"


def attach(spark) -> None:
    """Let Python workers import this package from where the driver has it.

    Workers started later get its folder on their path. On a cluster the package is installed on
    all nodes or sent along (``--py-files``), and this adds nothing.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
