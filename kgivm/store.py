"""Snapshots of a graph: immutable Parquet folders and one pointer file."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from kgivm.schemas import TABLES


@dataclass
class Graph:
    """The tables of a graph and its logical time."""

    tables: dict[str, DataFrame]
    step: int = 0
    paths: dict[str, str] = field(default_factory=dict)
    #: The number of the last micro-batch of a stream that the state holds.
    batch: int = -1

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def updated(self, step: int | None = None, **tables: DataFrame) -> Graph:
        """A graph with some tables replaced; only those are rewritten by a commit."""
        return Graph(self.tables | tables, self.step if step is None else step, {k: v for k, v in self.paths.items() if k not in tables}, self.batch)


class Store:
    """A folder with table snapshots. A commit writes changed tables beside the old ones and then moves the pointer, so a failed one leaves the last state."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self._fs.exists(self._path(f"{self.path}/CURRENT"))

    def init(self) -> Graph:
        """Create an empty graph where there is none."""
        if not self.exists():
            return self.commit(Graph({t: self.spark.createDataFrame([], s) for t, s in TABLES.items()}))
        return self.load()

    def clear(self) -> Graph:
        """Empty all tables. A stream's batches stay counted."""
        return self.commit(Graph({t: self.spark.createDataFrame([], s) for t, s in TABLES.items()}, batch=self.load().batch if self.exists() else -1))

    def drop(self) -> None:
        self._fs.delete(self._path(self.path), True)

    def commit(self, graph: Graph) -> Graph:
        paths = dict(graph.paths)
        for name, df in graph.tables.items():
            if name not in paths:
                paths[name] = f"{self.path}/{name}-{uuid.uuid4().hex}"
                df.write.parquet(paths[name])
        fresh = self._path(f"{self.path}/.current-{uuid.uuid4().hex}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps({"step": graph.step, "tables": paths, "batch": graph.batch}).encode()))
        out.close()
        options = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri())
        array = self.spark.sparkContext._gateway.new_array(options, 1)
        array[0] = options.OVERWRITE
        context.rename(fresh, self._path(f"{self.path}/CURRENT"), array)
        return self.load()

    def load(self) -> Graph:
        text = self.spark.read.text(f"{self.path}/CURRENT", wholetext=True).first()[0]
        state = json.loads(text)
        return Graph({t: self.spark.read.schema(TABLES[t]).parquet(p) for t, p in state["tables"].items()}, state["step"], state["tables"], state.get("batch", -1))

    def append(self, graph: Graph, table: str, rows: DataFrame) -> Graph:
        """Add rows to a table (nothing to do for none)."""
        return graph if rows.isEmpty() else self.commit(graph.updated(**{table: graph[table].unionByName(rows)}))

    def clone(self, other: str) -> Graph:
        """Another store with the same state and files of its own, so either can be changed, cleaned or dropped."""
        now = self.load()
        return Store(self.spark, other).commit(Graph(now.tables, now.step, {}, now.batch))

    def vacuum(self, keep: int = 1) -> int:
        """Delete the table snapshots that the current state does not use, but for the ``keep - 1`` newest of each table. Returns how many went. Not for use beside a running reader of older states."""
        used = {p.rpartition("/")[2] for p in self.load().paths.values()}
        old: dict[str, list[tuple[int, str]]] = {}
        for f in self._fs.listStatus(self._path(self.path)):
            name = f.getPath().getName()
            if f.isDirectory() and name.rpartition("-")[0] in TABLES and name not in used:
                old.setdefault(name.rpartition("-")[0], []).append((f.getModificationTime(), name))
        gone = [name for found in old.values() for _, name in sorted(found, reverse=True)[keep - 1 :]]
        for name in gone:
            self._fs.delete(self._path(f"{self.path}/{name}"), True)
        return len(gone)
