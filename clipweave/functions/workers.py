"""Python helpers that run inside tasks."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_with_job(module: str) -> None:
    """Send the functions of this module along with each job.

    Executors then need not have the package installed or on their path.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])
