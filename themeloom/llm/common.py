"""Shared plumbing: scratch tables, code shipping, Arrow passes over whole texts."""

from __future__ import annotations

import contextlib
import ctypes
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Rows and bytes of one Arrow batch (one row at least), which bound what JVM and Python worker hold of it.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20
#: Bytes of text that a Python worker turns into words at once; words and their tables take some 30 times as much.
CHUNK_BYTES = 1 << 20
#: Words as the contracts define them, in Java's syntax.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: The bytes that separate such words; bytes.split() splits at exactly these.
SPACES = b" \t\n\x0b\x0c\r"

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Give executors this package's code and bound the rows of an Arrow batch."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent.parent
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        path = Path(tempfile.mkdtemp(prefix="themeloom-code-")) / "themeloom_code.zip"
        path.write_bytes(held.getvalue())
        sc.addPyFile(str(path))
        _shipped.add(sc.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and all run on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not is_local(spark.sparkContext):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found or _own_dir()


_own: list[str] = []


def _own_dir() -> str:
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="themeloom-"))
    return _own[0]


class Scratch:
    """Tables written to the shared folder to cut lineage: they survive the loss of any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/themeloom-{name}-{uuid.uuid4().hex}"
        self.n, self.paths = 0, []

    def cut(self, df: DataFrame, tag: str) -> DataFrame:
        """Write df and read it again."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{tag}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.paths.append(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        self._delete([p for t in tables if (p := getattr(t, "_scratch_path", None))])

    def drop_others(self, *kept: DataFrame) -> None:
        """Delete all tables but these."""
        stay = {getattr(t, "_scratch_path", None) for t in kept}
        self._delete([p for p in self.paths if p not in stay])

    def _delete(self, paths: list[str]) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths = [p for p in self.paths if p not in set(paths)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def arrow_pass(df: DataFrame, columns: Iterable[Column | str], rows: Callable, schema: str) -> DataFrame:
    """One map over Arrow batches. rows: from a batch's columns as lists to the columns of the result, in schema's order."""
    return df.select(*columns).mapInArrow(_Mapper(rows, schema), schema)


class _Mapper:
    def __init__(self, rows: Callable, schema: str):
        self.rows, self.schema = rows, schema

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = arrow_schema(self.schema)
        for batch in batches:
            for part in by_bytes(batch):
                out = self.rows(*[c if pa.types.is_integer(c.type) else c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([as_arrow(c, f.type) for c, f in zip(out, types, strict=True)], schema=types)
        release()


def annotate(docs: DataFrame, text_col: str, rows: Callable, ddl: str) -> DataFrame:
    """All columns of docs, renamed by place so that no name clashes, and what rows finds in each text."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)
    inner = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    added = [StructField(f.name, _parse_datatype_string(_SPARK[f.type])) for f in arrow_schema(ddl)]
    schema = StructType([*inner.schema.fields, *added])
    return inner.mapInArrow(_Annotator(rows, ddl, at), schema)


def restore(annotated: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs by their own names again."""
    return annotated.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


class _Annotator:
    def __init__(self, rows: Callable, ddl: str, at: int):
        self.rows, self.ddl, self.at = rows, ddl, at

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = arrow_schema(self.ddl)
        for batch in batches:
            for part in by_bytes(batch):
                out = self.rows([t or "" for t in part.column(self.at).to_pylist()])
                arrays = [as_arrow(c, f.type) for c, f in zip(out, added, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *added.names])
        release()


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


_SPARK = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.string(): "string", pa.bool_(): "boolean"}


def arrow_schema(ddl: str) -> pa.Schema:
    fields = [x.strip().split(" ", 1) for x in ddl.split(",")]
    return pa.schema([pa.field(n, _TYPES[t.strip()]) for n, t in fields])


def by_bytes(batch: pa.RecordBatch, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about limit bytes of strings, one row at least, so long texts don't add up in a worker."""
    held = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            held += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, lo = np.cumsum(held), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def as_arrow(column, kind: pa.DataType) -> pa.Array:
    """A column of results; lists come as numpy arrays and are joined without Python numbers."""
    if isinstance(column, pa.Array):
        return column.cast(kind)
    if pa.types.is_list(kind):
        sizes = [0 if x is None else len(x) for x in column]
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        flat = np.concatenate([x for x in column if x is not None and len(x)] or [np.zeros(0, np.int64)])
        missing = np.array([x is None for x in column] + [False])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=missing), pa.array(flat, kind.value_type))
    return pa.array(column, kind, from_pandas=False)


def release() -> None:
    """Gives memory that a finished task leaves in allocators back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class WorkerCache:
    """What a Python worker keeps between tasks: of all such caches only the one last used holds anything.

    A reused worker runs the tasks of one stage after another; the cache of a stage that is over is
    dropped as soon as the next one asks for its own, so caches do not add up.
    """

    _holder: WorkerCache | None = None

    def __init__(self, make: Callable):
        self.make, self.key, self.held = make, None, None

    def get(self, *key):
        """The cache, made by make(*key) where it is not held for this key."""
        if WorkerCache._holder is not self or self.key != key:
            if WorkerCache._holder is not None:
                WorkerCache._holder.held = WorkerCache._holder.key = None
                release()
            WorkerCache._holder, self.key, self.held = self, key, self.make(*key)
        return self.held


def word_chunks(texts: list[str], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes, one text at least."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def is_local(sc: SparkContext) -> bool:
    return sc.master.startswith("local")


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
