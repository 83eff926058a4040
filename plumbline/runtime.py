"""Seeds, logging, timings and guards that all parts share."""

from __future__ import annotations

import functools
import importlib.util
import logging
import os
import tempfile
import time
import uuid
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor reaches: spark.checkpoint.dir; a temporary one only where that is unset, on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files make fewer parts than half of them: for work on cells that outweighs moving rows."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if not df.isStreaming and df.rdd.getNumPartitions() < n // 2 else df


SEED_VARIABLE = "PLUMBLINE_SEED"
_seed: list[int | None] = [None]


def set_seed(seed: int | None = None) -> None:
    """The seed of all that is random from now on; None leaves it to the environment, or to chance."""
    if seed is not None and (not isinstance(seed, int) or seed < 0):
        raise ValueError("a seed is a number from 0 on")
    _seed[0] = seed


def seed() -> int | None:
    own = _seed[0] if _seed[0] is not None else os.environ.get(SEED_VARIABLE)
    return None if own is None else int(own)


def random() -> np.random.Generator:
    return np.random.default_rng(seed())


def set_verbosity(level: int) -> None:
    logging.getLogger("plumbline").setLevel(level)


def logger(name: str) -> logging.Logger:
    return logging.getLogger(f"plumbline.{name}")


def require(*modules: str) -> Callable[[Callable], Callable]:
    """A function that needs modules which may not be there says so when it is called."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def called(*args: object, **named: object) -> object:
            missing = [m for m in modules if importlib.util.find_spec(m) is None]
            if missing:
                raise ImportError(f"{f.__name__} needs {', '.join(missing)}")
            return f(*args, **named)

        return called

    return wrap


def timed(times: dict[str, float], name: str) -> Callable[[Callable], Callable]:
    """Adds a function's seconds to times[name], call by call."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def called(*args: object, **named: object) -> object:
            began = time.monotonic()
            try:
                return f(*args, **named)
            finally:
                times[name] = times.get(name, 0.0) + time.monotonic() - began

        return called

    return wrap


def warned(name: str, error: Exception) -> None:
    """A statistic that failed: wrong values are raised, anything else becomes a warning."""
    if isinstance(error, ValueError):
        raise error
    warnings.warn(f"{name} couldn't be profiled: {error}", RuntimeWarning, stacklevel=2)
