"""Functions that run in Python tasks travel with the task.

Executors need no copy of the package: a module that defines such functions
calls :func:`ship` once, and its functions are pickled by value.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module])
