"""Long queries in durable units: a run that dies resumes with the units it has not done.

A run's folder holds its journal (the query's text, its hash, the input's
version and unit bounds), a folder per unit and a marker per finished unit.  A
unit is the query over one half-open range of a column, so units are disjoint
and together cover the input; a query that distributes over a partition of its
input is their union, and one with partial aggregates merges them.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, IllegalArgumentException, ParseException, PySparkException, PySparkTypeError, PySparkValueError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import Folder
from ..sources.tables import bounds


def ranges(low, high, parts: int) -> list:
    """parts - 1 cuts between two numbers or times, as ISO text for times."""
    if low is None:
        return []
    if isinstance(low, (datetime, date)):
        return [(low + (high - low) * k / parts).isoformat() for k in range(1, parts)]
    cuts = [low + (high - low) * k / parts for k in range(1, parts)]
    return sorted({int(c) for c in cuts}) if isinstance(low, int) else cuts


def inside(column: str, cuts: Sequence, k: int, kind: str) -> Column:
    """The k-th half-open range; the first and last are open-ended and the first takes nulls."""
    c = F.col(column)
    out = F.lit(True)
    if k:
        out = out & (c >= F.lit(cuts[k - 1]).cast(kind))
    if k < len(cuts):
        below = c < F.lit(cuts[k]).cast(kind)
        out = out & (below if k else below | c.isNull())
    return out


class ResumableQuery:
    """A query over one partitioned input, in units, with an optional merge of their union."""

    def __init__(self, spark: SparkSession, root: str, text: str, source: DataFrame, column: str, query: Callable[[DataFrame], DataFrame], parts: int = 4, merge: Callable[[DataFrame], DataFrame] | None = None, version: int | None = None, together: int = 4):
        self.spark, self.root, self.folder = spark, root, Folder(spark, root)
        self.source, self.column, self.query, self.merge, self.together = source, column, query, merge, together
        digest = hashlib.sha256(f"{text}|{column}|{parts}|{version}".encode()).hexdigest()
        if self.folder.has("journal.json"):
            self.journal = self.folder.get("journal.json")
            if self.journal["digest"] != digest:
                raise ValueError(f"{root} holds another run")
        else:
            kind = source.schema[column].dataType.simpleString()
            self.journal = {"text": text, "digest": digest, "version": version, "kind": kind, "cuts": ranges(*bounds(source, column), parts)}
            self.folder.put("journal.json", self.journal)

    def units(self) -> range:
        return range(len(self.journal["cuts"]) + 1)

    def done(self) -> list[int]:
        return [k for k in self.units() if self.folder.has(f"done-{k}.json")]

    def _unit(self, k: int) -> int:
        part = self.query(self.source.where(inside(self.column, self.journal["cuts"], k, self.journal["kind"])))
        part.write.mode("overwrite").parquet(f"{self.root}/unit={k}")
        self.folder.put(f"done-{k}.json", {"unit": k, "at": time.time()})
        return k

    def run(self, most: int | None = None) -> list[int]:
        """Do the units that are missing, at most `most`, a few at a time; returns those done now.

        Units are jobs of their own, so the last tasks of one leave no core idle
        while another waits; if one fails, the others' results stay.
        """
        done = set(self.done())
        with ThreadPoolExecutor(self.together) as pool:
            return sorted(pool.map(self._unit, [k for k in self.units() if k not in done][:most]))

    def result(self) -> DataFrame:
        self.run()
        schema = self.query(self.source).schema
        both = self.spark.read.schema(schema).parquet(*[f"{self.root}/unit={k}" for k in self.units()])
        return both if self.merge is None else self.merge(both)

    def clear(self) -> None:
        self.folder.delete()


def with_retries(action: Callable[[], DataFrame], tries: int = 3, pause: float = 0.0) -> DataFrame:
    """A client's failover: run again when a job, a driver or a connection fails; durable units make that cheap.

    Errors that would come again (a wrong statement, a name that is not there, the engine's own) are raised at once.
    """
    for k in range(tries):
        try:
            return action()
        except (PySparkException, Py4JError, ConnectionError, OSError) as e:
            if k == tries - 1 or isinstance(e, (AnalysisException, ParseException, IllegalArgumentException, PySparkTypeError, PySparkValueError)):
                raise
            time.sleep(pause)
    raise AssertionError
