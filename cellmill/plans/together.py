"""Jobs side by side: small ones leave most of a cluster idle when they follow each other."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

#: Jobs at once; every one more has a plan of its own in the driver's memory.
MOST = 3


def together(*work: Callable[[], Any]) -> list[Any]:
    """What the functions give, in their order; they run side by side and all have ended when this returns or raises the first error."""
    session = SparkSession.getActiveSession()
    own = inheritable_thread_target(session) if session else lambda f: f
    with ThreadPoolExecutor(MOST) as pool:
        found = [pool.submit(own(f)) for f in work]
    return [f.result() for f in found]
