"""Scans of data sets as hubs lay them out: folders of shards in several formats, by split, with columns in folder names.

A shard belongs to a split by its name (train-00000-of-00003.jsonl.gz, train.csv) or by a folder (train/...). Folders named
key=value give columns, and conditions on them rule shards out before they are opened. Spark's own readers take parquet,
JSON lines, CSV, TSV and text, compressed or not; Arrow files have a data source of their own, with a partition for each
run of record batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StringType, StructType

NAME = re.compile(r"(?P<stem>[^/]*?)(?:-(?P<number>\d{5})-of-(?P<of>\d{5}))?\.(?P<kind>parquet|jsonl|ndjson|json|csv|tsv|txt|arrow)(?:\.(?:gz|bz2|zst|xz))?$")
KINDS = {"jsonl": "json", "ndjson": "json"}
#: Record batches of an Arrow file that one task reads.
RUN = 64


@dataclass(frozen=True)
class Shard:
    path: str
    base: str  # up to where folders name no columns
    kind: str
    number: int | None
    of: int | None


def shards(spark: SparkSession, root: str, split: str) -> list[Shard]:
    """The split's shards by path; an error if numbered ones are missing or none is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    files, out = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True), []
    top = None
    while files.hasNext():
        path = files.next().getPath()
        name, full = path.getName(), path.toString()
        top = top or full[: full.index(root.rstrip("/").rsplit("/", 1)[-1] + "/") + len(root.rstrip("/").rsplit("/", 1)[-1])]
        m, folders = NAME.fullmatch(name), full[len(top) + 1 : -len(name)].strip("/").split("/")
        if m and not name.startswith(("_", ".")) and (m["stem"] == split or split in folders):
            plain = [f for f in folders if f and "=" not in f]
            out.append(Shard(full, "/".join([top, *plain]), KINDS.get(m["kind"], m["kind"]), m["number"] and int(m["number"]), m["of"] and int(m["of"])))
    if not out:
        raise FileNotFoundError(f"no shards of {split!r} under {root}")
    for base in {s.base for s in out}:
        own = [s for s in out if s.base == base and s.of]
        if own and {s.number for s in own} != set(range(own[0].of)):
            raise FileNotFoundError(f"{base}: {len({s.number for s in own})} of {own[0].of} shards of {split!r}")
    return sorted(out, key=lambda s: s.path)


def scan(spark: SparkSession, root: str, split: str = "train", *, schema: StructType | str | None = None) -> DataFrame:
    """All rows of a split, whatever formats its shards have; columns by name, nulls where a format lacks one. Without a
    schema each format's is inferred. Corrupt lines of JSON are left out, as the loaders do."""
    found, parts = shards(spark, root, split), []
    for kind in sorted({s.kind for s in found}):
        for base in sorted({s.base for s in found if s.kind == kind}):
            own = [s.path for s in found if (s.kind, s.base) == (kind, base)]
            reader = spark.read.option("basePath", base)
            reader = reader if schema is None else reader.schema(schema)
            if kind == "arrow":
                spark.dataSource.register(ArrowShards)
                spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
                parts.append((spark.read if schema is None else spark.read.schema(schema)).format("arrow_shards").option("base", base).option("paths", "\n".join(own)).load())
            elif kind in ("csv", "tsv"):
                options = {"header": True, "multiLine": True, "escape": '"', "sep": "\t" if kind == "tsv" else ",", **({"inferSchema": True} if schema is None else {})}
                parts.append(reader.options(**options).csv(own))
            elif kind == "json":
                parts.append(reader.option("mode", "DROPMALFORMED").json(own))
            else:
                parts.append(reader.parquet(*own) if kind == "parquet" else reader.text(own))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _opened(path: str) -> pa.ipc.RecordBatchFileReader | pa.ipc.RecordBatchStreamReader:
    fs, inner = pyarrow.fs.FileSystem.from_uri(path if ":" in path.split("/", 1)[0] else f"file://{path}")
    file = fs.open_input_file(inner)
    try:
        return pa.ipc.open_file(file)
    except pa.ArrowInvalid:
        file.seek(0)
        return pa.ipc.open_stream(file)


def _named(path: str, base: str) -> dict[str, str]:
    """The columns that the folders below base name."""
    return dict(f.split("=", 1) for f in path[len(base) + 1 :].split("/")[:-1] if "=" in f)


class ArrowShards(DataSource):
    """Arrow files or streams; options: base, and paths, one a line."""

    @classmethod
    def name(cls) -> str:
        return "arrow_shards"

    def _paths(self) -> list[str]:
        return self.options["paths"].split("\n")

    def schema(self) -> StructType:
        own = from_arrow_schema(_opened(self._paths()[0]).schema)
        for key in _named(self._paths()[0], self.options["base"]):
            own = own.add(key, StringType())
        return own

    def reader(self, schema: StructType) -> ArrowShardsReader:
        return ArrowShardsReader(self._paths(), self.options["base"], schema)


class Run(InputPartition):
    """Record batches first to first + RUN of a file; all where the file is a stream."""

    def __init__(self, path: str, first: int | None):
        super().__init__((path, first))
        self.path, self.first = path, first


class ArrowShardsReader(DataSourceReader):
    def __init__(self, paths: list[str], base: str, schema: StructType):
        self.paths, self.base, self.names = paths, base, schema.names

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership of columns that folders name choose shards; the rest is left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and all(f.attribute[0] in _named(p, self.base) for p in self.paths):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = [p for p in self.paths if _named(p, self.base)[f.attribute[0]] in wanted]
            else:
                yield f

    def partitions(self) -> list[Run]:
        out = []
        for p in self.paths:
            file = _opened(p)
            out += [Run(p, k) for k in range(0, file.num_record_batches, RUN)] if hasattr(file, "num_record_batches") else [Run(p, None)]
        return out

    def read(self, run: Run | None) -> Iterator[pa.RecordBatch]:
        if run is None:  # no partition is left
            return
        file, more = _opened(run.path), _named(run.path, self.base)
        batches = iter(file) if run.first is None else (file.get_batch(k) for k in range(run.first, min(run.first + RUN, file.num_record_batches)))
        for b in batches:
            own = {n: b.column(n) if n in b.schema.names else pa.array([more.get(n)] * b.num_rows, pa.string()) for n in self.names}
            yield pa.RecordBatch.from_arrays(list(own.values()), list(own))
