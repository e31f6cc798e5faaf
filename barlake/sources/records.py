"""Spark data sources: files of fixed-length records in byte ranges, and database tables in ranges of a key.

The classes are made in functions, so that they travel to executors by value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Bytes of a file that one task reads; tasks from which on small ranges share one.
RANGE, TASKS = 128 << 20, 512


def read_fixed(spark: SparkSession, root: str, record: np.dtype, fields: str, pattern: str = "", split: int = RANGE) -> DataFrame:
    """path, place (of the record in its file) and the fields of records in files under a folder (or in one file) whose
    name the pattern finds, in a store that Arrow opens (local, HDFS, S3, GCS).

    A task reads a range of whole records, so one large file is many tasks, and what a task holds is one batch. Where ranges
    are small and there are more than `TASKS`, a task reads several in turn, up to `RANGE` bytes. fields: names and types,
    for the first fields of the record. A trailing part of a record is ignored. A missing folder raises.
    """
    size, names = record.itemsize, [x.split()[0] for x in fields.split(", ")]

    class Range(InputPartition):
        def __init__(self, spans: list[tuple[str, int, int]]) -> None:
            super().__init__(len(spans))
            self.spans = spans

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str], schema) -> None:  # noqa: ANN001
            self.options, self.types = options, to_arrow_schema(schema)

        def partitions(self) -> list[InputPartition]:
            import re

            from pyarrow import fs

            store, top = fs.FileSystem.from_uri(self.options["path"])
            info = store.get_file_info(top)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(top)
            found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(top, recursive=True))
            files = [(x.path, x.size // size) for x in found if x.type == fs.FileType.File and re.search(pattern, x.base_name)]
            step = max(1, split // size)
            most = max(step, min(RANGE // size, sum(n for _, n in files) // TASKS))
            out: list[list[tuple[str, int, int]]] = [[]]
            held = 0
            for path, whole in sorted(files):
                for i in range(0, whole, step):
                    end = min(i + step, whole)
                    if held + end - i > most:
                        out.append([])
                        held = 0
                    if out[-1] and out[-1][-1][0] == path:  # it goes on where the last one ends
                        out[-1][-1] = (path, out[-1][-1][1], end)
                    else:
                        out[-1].append((path, i, end))
                    held += end - i
            return [Range(spans) for spans in out]

        def read(self, part: Range) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs

            store, _ = fs.FileSystem.from_uri(self.options["path"])
            for path, begin, end in part.spans:
                with store.open_input_file(path) as file:
                    for at in range(begin, end, 1 << 16):
                        n = min(1 << 16, end - at)
                        rows = np.frombuffer(file.read_at(n * size, at * size), record)
                        yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(at, at + n)), *(pa.array(rows[c]).cast(self.types.field(c).type) for c in names)], schema=self.types)

    class FixedRecords(DataSource):
        @classmethod
        def name(cls) -> str:
            return "barlake_fixed_records"

        def schema(self) -> str:
            return f"path string, place long, {fields}"

        def reader(self, schema) -> Reader:  # noqa: ANN001
            return Reader(self.options, schema)

    spark.dataSource.register(FixedRecords)
    return spark.read.format("barlake_fixed_records").load(root)


def read_database(spark: SparkSession, connect: Callable[[], object], table: str, schema: str, key: str = "", parts: int = 8, mark: str = "?", fetch: int = 10_000) -> DataFrame:
    """A database table over any Python driver, without one on Spark's classpath.

    With a key, the table is read in `parts` ranges of it that hold equally many rows: their bounds are the table's own
    quantiles, so a skewed key makes no long task; rows without a key are a range of their own. Only the columns of the
    schema are fetched, `fetch` rows at a time; comparisons of a column with a value, and lists, go into the statement.
    `connect` is called wherever a range is read; `mark` is the driver's sign for a parameter.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    columns = [f.name for f in _parse_datatype_string(schema).fields]
    quoted = lambda name: '"' + name.replace('"', '""') + '"'
    listed = ", ".join(map(quoted, columns))
    signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    class Range(InputPartition):
        def __init__(self, where: str, values: list) -> None:
            super().__init__(where)
            self.where, self.values = where, values

    class Reader(DataSourceReader):
        def __init__(self, schema) -> None:  # noqa: ANN001
            self.types, self.where, self.values = to_arrow_schema(schema), [], []

        def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
            for f in filters:
                if type(f) in signs and len(f.attribute) == 1:
                    self.where.append(f"{quoted(f.attribute[0])} {signs[type(f)]} {mark}")
                    self.values.append(f.value)
                elif isinstance(f, In) and len(f.attribute) == 1 and f.value:
                    self.where.append(f"{quoted(f.attribute[0])} IN ({', '.join([mark] * len(f.value))})")
                    self.values += list(f.value)
                else:
                    yield f

        def partitions(self) -> list[InputPartition]:
            own = " AND ".join(self.where)
            if not key:
                return [Range(own, self.values)]
            k, rest = quoted(key), f" AND {own}" if own else ""
            db = connect()
            try:
                cursor = db.cursor()
                cursor.execute(f"SELECT count(*) FROM {table} WHERE {k} IS NOT NULL{rest}", self.values)
                n = cursor.fetchone()[0]
                bounds = []
                for i in range(1, parts if n else 0):
                    cursor.execute(f"SELECT {k} FROM {table} WHERE {k} IS NOT NULL{rest} ORDER BY {k} LIMIT 1 OFFSET {n * i // parts}", self.values)
                    bounds.append(cursor.fetchone()[0])
            finally:
                db.close()
            bounds = list(dict.fromkeys(bounds))
            out = [Range(f"{k} IS NULL{rest}", self.values)]
            for low, high in zip([None, *bounds], [*bounds, None], strict=True):
                ends = [(f"{k} >= {mark}", low), (f"{k} < {mark}", high)]
                mine = [(text, x) for text, x in ends if x is not None] or [(f"{k} IS NOT NULL", None)]
                out.append(Range(" AND ".join(t for t, _ in mine) + rest, [x for _, x in mine if x is not None] + self.values))
            return out

        def read(self, part: Range) -> Iterator[pa.RecordBatch]:
            db = connect()
            try:
                cursor = db.cursor()
                cursor.execute(f"SELECT {listed} FROM {table}" + (f" WHERE {part.where}" if part.where else ""), part.values)
                while rows := cursor.fetchmany(fetch):
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), self.types, strict=True)], schema=self.types)
            finally:
                db.close()

    class Table(DataSource):
        @classmethod
        def name(cls) -> str:
            return "barlake_database"

        def reader(self, schema) -> Reader:  # noqa: ANN001
            return Reader(schema)

    spark.dataSource.register(Table)
    return spark.read.format("barlake_database").schema(schema).load()
