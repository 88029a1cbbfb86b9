"""Errors of building and using pipelines, and of user code that runs on executors."""

from __future__ import annotations

import base64
import contextlib
import functools
import re

MARK = re.compile(r"brooklet-error:([A-Za-z0-9+/=]+):")


class PipelineBuildError(Exception):
    """A pipeline was put together wrongly; raised before any data is touched."""


class CarriedError(Exception):
    """A user's exception on its way from a Python worker: its text holds the pickled original."""


class PipelineStateError(Exception):
    """A pipeline reference was used again after a step, a terminal or a mode switch had consumed it."""


@contextlib.contextmanager
def carried():
    """On executors: sends a user's exception to the driver as it is, if it can be pickled."""
    try:
        yield
    except Exception as e:
        from pyspark import cloudpickle

        try:
            data = cloudpickle.dumps(e)
            cloudpickle.loads(data)
        except Exception:
            raise e from None
        raise CarriedError(f"brooklet-error:{base64.b64encode(data).decode()}: {e!r}") from e


@contextlib.contextmanager
def unwrapped():
    """On the driver: raises the exception that user code raised on an executor."""
    from py4j.protocol import Py4JError
    from pyspark.errors import PySparkException

    try:
        yield
    except (PySparkException, Py4JError, CarriedError) as e:
        found = MARK.search(str(e))
        if not found:
            raise
        from pyspark import cloudpickle

        raise cloudpickle.loads(base64.b64decode(found[1])) from e


def terminal(fn):
    """A method whose errors from executors are the user's own."""

    @functools.wraps(fn)
    def run(*args, **kwargs):
        with unwrapped():
            return fn(*args, **kwargs)

    return run
