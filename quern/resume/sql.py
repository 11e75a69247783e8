"""SELECT statements that outlive their driver.

A run's folder holds a journal: the statement's text, where its tables are (a
database at a pinned version, or a folder of Parquet files), the driving table's
key ranges, and the policy.  A new driver opens the folder with nothing else in
hand, parses and plans the text again and goes on.

The plan is a list of operators: the driving scan, a join for each further
table, a sort, the projection.  The input is worked off in units (ranges of the
driving table's key).  In the first unit each operator's result is written and
measured: seconds and bytes.  In the others the policy says after each operator,
from those measurements, whether its result is written.  A unit that was cut off
goes on from the last operator whose marker carries the digest of this text,
input, unit and operator.  The sort's result, with places, is the run's last
state.
"""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Engine
from ..files import Folder
from ..operators.frames import conjunction, label, names_of, predicate, ref, scan
from ..plans.analyze import Scope, bind
from ..plans.lang import Col, parse
from ..sources.tables import bounds, parquet_tables
from .policies import EnumerativePolicy, IntervalPolicy, RewardPolicy, Step
from .units import inside, ranges

POLICIES = {"reward": RewardPolicy, "interval": IntervalPolicy, "enumerative": EnumerativePolicy}


class Killed(Exception):
    """Stands in for the loss of a driver in tests and queries that show a resumption."""


class SqlRun:
    """One SELECT, started with a text and a source, or opened again from its folder alone.

    source: {"folder": path} of Parquet tables, or {"database": path, "version": n};
    without a version the latest one is pinned.  policy: {"kind": reward,
    interval or enumerative, and its parameters}.
    """

    def __init__(self, spark: SparkSession, root: str, text: str | None = None, source: dict | None = None, parts: int = 4, policy: dict | None = None):
        self.spark, self.root, self.folder = spark, root, Folder(spark, root)
        if self.folder.has("journal.json"):
            self.journal = self.folder.get("journal.json")
            if text is not None and text != self.journal["text"]:
                raise ValueError(f"{root} holds another statement")
        elif text is None or source is None:
            raise ValueError(f"{root} holds no run")
        else:
            source = dict(source)
            if "database" in source:
                source.setdefault("version", Engine(spark, source["database"]).store.latest())
            self.journal = {"text": text, "source": source, "policy": policy or {"kind": "reward"}}
        self._plan()
        if "cuts" not in self.journal:
            low = bounds(self.frames[self.query.tables[0]], self.column)
            kind = self.frames[self.query.tables[0]].schema[self.column].dataType.simpleString()
            self.journal |= {"column": self.column, "kind": kind, "cuts": ranges(*low, parts)}
            self.folder.put("journal.json", self.journal)
        self.digest = hashlib.sha256(json.dumps(self.journal, sort_keys=True).encode()).hexdigest()
        self.read_from: list[tuple[int, int]] = []

    def _plan(self) -> None:
        query, source = parse(self.journal["text"]), self.journal["source"]
        if "folder" in source:
            wanted = {n.lower() for n in query.tables}
            self.frames = parquet_tables(self.spark, source["folder"], sorted(wanted))
        else:
            engine = Engine(self.spark, source["database"])
            self.frames = {n: engine.table(n, source["version"]) for n in query.tables}
        self.query = bind(query, schemas := {n: f.schema for n, f in self.frames.items()})
        self.scope = Scope(schemas)
        first = self.frames[self.query.tables[0]]
        self.column = next(f.name for f in first.schema.fields if f.dataType.simpleString() in ("int", "bigint", "date", "timestamp", "float", "double"))
        self.steps = [("scan", self.query.tables[0]), *[("join", t) for t in self.query.tables[1:]]]

    def units(self) -> range:
        return range(len(self.journal["cuts"]) + 1)

    def _apply(self, k: int, unit: int, below: DataFrame | None) -> DataFrame:
        table = self.steps[k][1]
        if k == 0:
            part = self.frames[table].where(inside(self.column, self.journal["cuts"], unit, self.journal["kind"]))
            return scan(part, table, self.query.local[table], self.scope)
        seen = {t for _, t in self.steps[: k + 1]}
        ready = [c for c in self.query.across if {c.left.table, c.right.table} <= seen and table in (c.left.table, c.right.table)]
        right, on = scan(self.frames[table], table, self.query.local[table], self.scope), conjunction([predicate(c, self.scope) for c in ready])
        out = below.crossJoin(right) if on is None else below.join(right, on)
        # only what later operators read: a state holds no more than that
        later = [c for c in self.query.across if c not in ready and not {c.left.table, c.right.table} <= seen]
        order = [self.query.order[0]] if self.query.order else []
        need = {label(c) for c in [*self.query.columns, *order, *[x for c in later for x in (c.left, c.right)]] if isinstance(c, Col)}
        return out.select(*[F.col(f"`{c}`") for c in out.columns if c in need])

    def _name(self, unit: int, k: int) -> str:
        return f"unit={unit}/step={k}"

    def _write(self, out: DataFrame, unit: int, k: int) -> DataFrame:
        began = time.time()
        out.write.mode("overwrite").parquet(f"{self.root}/{self._name(unit, k)}")
        facts = {"digest": self.digest, "seconds": time.time() - began, "bytes": self.folder.bytes(self._name(unit, k))}
        self.folder.put(f"done/{unit}-{k}.json", facts)
        return self.spark.read.schema(out.schema).parquet(f"{self.root}/{self._name(unit, k)}")

    def done(self, unit: int, k: int) -> dict | None:
        """The marker of an operator's result, if it is this run's own."""
        name = f"done/{unit}-{k}.json"
        found = self.folder.get(name) if self.folder.has(name) else None
        return found if found and found["digest"] == self.digest else None

    def facts(self) -> list[Step]:
        """What the first unit measured of each operator."""
        held = [self.done(0, k) for k in range(len(self.steps))]
        return [Step(f"{kind} {table}", kind, h["seconds"] * 1e6, h["bytes"]) for (kind, table), h in zip(self.steps, held, strict=True)]

    def chosen(self) -> list[int]:
        """Which operators' results the units after the first one write, besides the last."""
        steps, out, since, clock = self.facts(), [], 0.0, 0.0
        policy = POLICIES[self.journal["policy"]["kind"]](**{k: v for k, v in self.journal["policy"].items() if k != "kind"})
        if isinstance(policy, EnumerativePolicy):
            names = policy.choose(steps)
            return [k for k, s in enumerate(steps) if s.name in names]
        for k, step in enumerate(steps):
            since, clock = since + step.elapsed_us, clock + step.elapsed_us / 1e6
            known = Step(step.name, step.kind, since, step.bytes, child_us=0.0)
            if policy.should_checkpoint(known, clock) if isinstance(policy, IntervalPolicy) else policy.should_checkpoint(known):
                out.append(k)
                since = 0.0
        return out

    def run(self, stop_after: tuple[int, int] | None = None) -> None:
        """Do what is missing.  stop_after: (unit, operator) after whose result the driver is lost."""
        last = len(self.steps) - 1
        written = list(range(last + 1))
        for unit in self.units():
            if unit == 1:
                written = sorted({*self.chosen(), last})
            if self.done(unit, last):
                continue
            at = max((k for k in range(last) if self.done(unit, k)), default=-1)
            out = None
            if at >= 0:
                self.read_from.append((unit, at))
                out = self.spark.read.parquet(f"{self.root}/{self._name(unit, at)}")
            for k in range(at + 1, last + 1):
                out = self._apply(k, unit, out)
                if k in written:
                    out = self._write(out, unit, k)
                if (unit, k) == stop_after:
                    raise Killed(f"unit {unit}, operator {k}")

    def result(self) -> DataFrame:
        """The statement's rows.  A sort is done once; its state holds each row's place, so whoever opens the run gets the same order, ties included."""
        self.run()
        last = len(self.steps) - 1
        out = self.spark.read.parquet(*[f"{self.root}/{self._name(u, last)}" for u in self.units()])
        if self.query.order:
            if not self.done(-1, 0):
                col, desc = self.query.order
                out = out.orderBy(ref(col).desc() if desc else ref(col).asc()).withColumn("__at", F.monotonically_increasing_id())
                self._write(out, -1, 0)
            out = self.spark.read.parquet(f"{self.root}/{self._name(-1, 0)}").orderBy("__at")
        return out.select(*[ref(c).alias(n) for c, n in zip(self.query.columns, names_of(self.query), strict=True)])

    def clear(self) -> None:
        self.folder.delete()
