"""A PySpark-native evidence index, ranked retrieval engine and training-data toolkit."""

from __future__ import annotations

import os
from pathlib import Path

__version__ = "0.1.0"


def ship(spark) -> None:
    """Let Python workers import this package from where the driver has it.

    For a local master or an installation on a shared path; elsewhere install the package on the
    executors or pass it with ``--py-files``. Without effect where workers find it anyway.
    """
    home, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([home, *paths])
