"""One thread of linear algebra a task.

Spark gives a task one core and lets as many tasks run as there are cores.  A
BLAS with threads of its own would have the threads of all tasks wait for each
other; on small matrices they only burn time.
"""

from __future__ import annotations

import ctypes

import numpy  # noqa: F401  loads the library


def one_thread() -> None:
    """Best effort: where the loaded library is not found, its threads stay as they are."""
    try:
        with open("/proc/self/maps") as maps:
            paths = {line.split(maxsplit=5)[5].strip() for line in maps if "openblas" in line}
    except OSError:
        return
    for path in paths:
        try:
            library = ctypes.CDLL(path)
        except OSError:
            continue
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break
