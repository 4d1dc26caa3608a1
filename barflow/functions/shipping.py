"""Functions for workers go by value, so that workers need not have this package installed."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module_name: str) -> None:
    """Pickle a module's functions and classes by value; call it at the end of each module whose functions run in workers."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
