"""Results that several readers share, kept for as long as somebody holds what was made of them."""

from __future__ import annotations

import uuid
import weakref

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

_COPY = "_kept_copy"


class Kept:
    """A frame that is computed once, when it is first read, and then read from memory or local disk;
    what a lost executor held of it is computed again.

    Spark finds kept results by their plan.  A column of its own keeps this one apart from
    those of other calls, which may have read other files under the same name.
    """

    def __init__(self, frame: DataFrame):
        self._held = frame.withColumn(_COPY, F.lit(uuid.uuid4().hex)).persist(StorageLevel.MEMORY_AND_DISK)
        self.frame = self._held.drop(_COPY)

    def release(self) -> None:
        if self._held.sparkSession.sparkContext._jsc is not None:
            self._held.unpersist()

    def until_gone(self, result: DataFrame) -> DataFrame:
        """Release when ``result`` is no longer referenced.  Frames derived from it stay right and
        read the source again."""
        weakref.finalize(result, self.release).atexit = False
        return result
