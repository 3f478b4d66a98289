"""Searches that can be called off: jobs carry a tag, and a stop cancels those that run and refuses those to come."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Cancelled(RuntimeError):
    """The stop was called before or during the work."""


class Stop:
    """A signal that any thread may give; the work it stops runs within :meth:`jobs`."""

    def __init__(self, spark: SparkSession):
        self.context, self.tag = spark.sparkContext, f"stop-{uuid.uuid4().hex}"
        self.called = threading.Event()

    def __call__(self) -> None:
        self.called.set()
        self.context.cancelJobsWithTag(self.tag)

    @contextmanager
    def jobs(self) -> Iterator[None]:
        """Jobs started inside, by this thread, end with the stop; what they raise then is :class:`Cancelled`."""
        if self.called.is_set():
            raise Cancelled(self.tag)
        self.context.addJobTag(self.tag)
        try:
            yield
        except Exception as e:
            if self.called.is_set():
                raise Cancelled(self.tag) from e
            raise
        finally:
            self.context.removeJobTag(self.tag)
        if self.called.is_set():
            raise Cancelled(self.tag)
