"""Timing of driver-side calls, kept as rows of a timing table."""

from __future__ import annotations

import functools
import os
import time
from collections.abc import Callable


def append_row(path: str, name: str, seconds: float) -> None:
    """One headerless CSV row: name, duration, epoch seconds; appended to a local file, a file of its own in the folder that a URI names."""
    row = f'"{name.replace(chr(34), chr(34) * 2)}",{seconds:.6f},{time.time():.6f}\n'
    if "://" in path:
        from pyspark.sql import SparkSession

        from pagewright.sources.files import write_text

        write_text(SparkSession.active(), f"{path.rstrip('/')}/{time.time_ns()}.csv", row)
        return
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "a", encoding="utf-8") as out:
        out.write(row)


def timed(path: str) -> Callable:
    """Decorator; a call is logged if it succeeds. Time an action, for transformations are lazy."""

    def wrap(fn: Callable) -> Callable:
        @functools.wraps(fn)
        def run(*args, **kwargs):
            began = time.perf_counter()
            out = fn(*args, **kwargs)
            append_row(path, fn.__name__, time.perf_counter() - began)
            return out

        return run

    return wrap


class TimeBlock:
    """Context manager; logs on errors too and swallows none."""

    def __init__(self, name: str, path: str):
        self.name, self.path, self.seconds = name, path, 0.0

    def __enter__(self) -> TimeBlock:
        self.began = time.perf_counter()
        return self

    def __exit__(self, *_error) -> bool:
        self.seconds = time.perf_counter() - self.began
        append_row(self.path, self.name, self.seconds)
        return False
