"""Describing large plans: what makes thousands of columns quick to build."""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import TypeVar

from pyspark.errors import utils

Made = TypeVar("Made")


def quickly(make: Callable[..., Made]) -> Callable[..., Made]:
    """make, without the note of its place in the source that Spark takes for each column: some six calls to the JVM beside the one that
    makes the column. It is what spark.python.sql.dataFrameDebugging.enabled = false does for a whole session; errors inside then
    name the operation and not the line. Where this version of Spark keeps that setting elsewhere, nothing changes."""

    @functools.wraps(make)
    def made(*args, **kwargs):
        before = getattr(utils, "_enable_debugging_cache", None)
        utils._enable_debugging_cache = False
        try:
            return make(*args, **kwargs)
        finally:
            utils._enable_debugging_cache = before

    return made
