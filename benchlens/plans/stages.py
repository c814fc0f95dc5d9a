"""Stages of runs as keyed tables: each is made once, by whoever needs it first, and kept whole."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable
from concurrent.futures import Future

from pyspark.sql import DataFrame, SparkSession

from benchlens.functions.text import cache_key
from benchlens.sources import results


class Stages:
    """Tables below ``root``/shared, named by stage, parameters and the identity of what all stages read.

    A stage that several runs ask for at once is made by one, the others wait for it.  It is written beside and
    published whole, so after a failure everything that was finished is there and nothing else.
    """

    def __init__(self, spark: SparkSession, root: str, inputs: Iterable[DataFrame] = ()):
        self.spark, self.root = spark, f"{root.rstrip('/')}/shared"
        self.inputs = [results.identity(df) for df in inputs]
        #: Stages that this object has made (not found), in order.
        self.made: list[str] = []
        self._asked: dict[str, Future] = {}
        self._lock = threading.Lock()

    def table(self, stage: str, payload: dict, make: Callable[[], DataFrame]) -> DataFrame:
        return self.tables(stage, payload, lambda: {"rows": make()})["rows"]

    def tables(self, stage: str, payload: dict, make: Callable[[], dict[str, DataFrame | None]]) -> dict[str, DataFrame]:
        """The tables of one stage; those that ``make`` gives as None are left out."""
        key = cache_key(stage, {**payload, "inputs": self.inputs})
        with self._lock:
            first = key not in self._asked
            asked = self._asked.setdefault(key, Future())
        if first:
            try:
                asked.set_result(self._read_or_make(stage, f"{self.root}/{key}", make))
            except BaseException as e:
                with self._lock:
                    del self._asked[key]  # the next one that asks tries again
                asked.set_exception(e)
        return asked.result()

    def _read_or_make(self, stage: str, path: str, make: Callable[[], dict[str, DataFrame | None]]) -> dict[str, DataFrame]:
        if not results.exists(self.spark, path):
            beside = f"{self.root}/.making-{results.fresh()}"
            for name, df in make().items():
                if df is not None:
                    df.write.parquet(f"{beside}/{name}")
            results.publish(self.spark, beside, path)
            self.made.append(stage)
        return {name: self.spark.read.parquet(f"{path}/{name}") for name in results.folders(self.spark, path)}
