"""PLY as a Spark data source: `spark.read.format("ply").option("element", "vertex").load(path)` and the same for writing.

The header gives the schema. `columns` names the properties wanted; the others are stepped over. Binary rows of fixed size
are cut into row ranges (`rows_per_task`), each read by its own task from its own offset; elements with lists, and text
files, are read in order by one task per file. Files are opened through the session's file systems where the path has a
scheme other than file, by way of a local copy on the driver of the header only for the schema; such paths must be
reachable from Python on the executors (mounted), or be read with `binaryFile` and `parse`.
"""

from __future__ import annotations

import glob
import io
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Scalar type names of the format, the numpy kind, and the Spark type that holds it.
KINDS = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
SPARK = {"i1": T.ShortType(), "u1": T.ShortType(), "i2": T.ShortType(), "u2": T.IntegerType(), "i4": T.IntegerType(), "u4": T.LongType(), "f4": T.FloatType(), "f8": T.DoubleType()}
NAMES = {"smallint": "short", "int": "int", "bigint": "int", "float": "float", "double": "double", "boolean": "uchar", "tinyint": "char"}


class Property:
    def __init__(self, name: str, kind: str, size: str | None = None):
        self.name, self.kind, self.size = name, KINDS[kind], KINDS[size] if size else None

    @property
    def type(self) -> T.DataType:
        return T.ArrayType(SPARK[self.kind]) if self.size else SPARK[self.kind]


class Header:
    """Format, elements with their counts and properties, comments, and where the data begins."""

    def __init__(self, file: io.BufferedIOBase):
        if file.readline().strip() != b"ply":
            raise ValueError("not a PLY file")
        self.format, self.comments, self.elements, self.counts = "", [], {}, {}
        element = None
        while True:
            line = file.readline()
            if not line:
                raise ValueError("the PLY header has no end")
            words = line.decode("ascii", "replace").split()
            if not words:
                continue
            if words[0] == "end_header":
                break
            if words[0] == "format":
                self.format = words[1]
            elif words[0] in ("comment", "obj_info"):
                self.comments.append(" ".join(words[1:]))
            elif words[0] == "element":
                element = words[1]
                self.counts[element], self.elements[element] = int(words[2]), []
            elif words[0] == "property":
                p = Property(words[4], words[3], words[2]) if words[1] == "list" else Property(words[2], words[1])
                self.elements[element].append(p)
        self.start = file.tell()

    def schema(self, element: str) -> T.StructType:
        return T.StructType([T.StructField(p.name, p.type) for p in self.elements[element]])

    def order(self) -> str:
        return ">" if self.format == "binary_big_endian" else "<"

    def row_type(self, element: str) -> np.dtype | None:
        """The layout of a row, if it has no lists."""
        if any(p.size for p in self.elements[element]):
            return None
        return np.dtype([(p.name, self.order() + p.kind) for p in self.elements[element]])

    def describe(self) -> list[tuple[str, str, str, str | None]]:
        return [(e, p.name, p.kind, p.size) for e, ps in self.elements.items() for p in ps]


def skip(file, header: Header, element: str) -> None:
    """Step over an element's rows."""
    rows = header.row_type(element)
    if rows is not None and header.format != "ascii":
        file.seek(rows.itemsize * header.counts[element], 1)
    else:
        for _ in rows_of(file, header, element, []):
            pass


def rows_of(file, header: Header, element: str, wanted: list[str]) -> Iterator[tuple]:
    """Rows in order, the wanted properties of each."""
    properties = header.elements[element]
    place = [wanted.index(p.name) if p.name in wanted else None for p in properties]
    if header.format == "ascii":
        for _ in range(header.counts[element]):
            words, at, out = file.readline().split(), 0, [None] * len(wanted)
            for p, k in zip(properties, place, strict=True):
                read = float if p.kind[0] == "f" else int
                if p.size:
                    n = int(words[at])
                    value, at = [read(w) for w in words[at + 1 : at + 1 + n]], at + 1 + n
                else:
                    value, at = read(words[at]), at + 1
                if k is not None:
                    out[k] = value
            yield tuple(out)
        return
    order = header.order()
    for _ in range(header.counts[element]):
        out = [None] * len(wanted)
        for p, k in zip(properties, place, strict=True):
            n = int(np.frombuffer(file.read(int(p.size[1])), order + p.size)[0]) if p.size else 1
            data = file.read(n * int(p.kind[1]))
            if k is not None:
                values = np.frombuffer(data, order + p.kind).tolist()
                out[k] = values if p.size else values[0]
        yield tuple(out)


def parse(data: bytes, element: str, columns: list[str] | None = None) -> list[tuple]:
    """Rows of an element from the bytes of a whole file."""
    file = io.BytesIO(data)
    header = Header(file)
    for e in header.elements:
        if e == element:
            return list(rows_of(file, header, e, columns or [p.name for p in header.elements[e]]))
        skip(file, header, e)
    raise ValueError(f"no element {element}")


def files(path: str) -> list[str]:
    path = path.removeprefix("file://").removeprefix("file:")
    found = sorted(glob.glob(os.path.join(path, "**", "*.ply"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path))
    if not found:
        raise FileNotFoundError(path)
    return found


class Range(InputPartition):
    def __init__(self, path: str, first: int, n: int):
        self.path, self.first, self.n = path, first, n


class PlyReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.names, self.arrow = schema.fieldNames(), None
        self.types = [f.dataType for f in schema.fields]
        self.element, self.path = options.get("element", "vertex"), options["path"]
        self.per_task = int(options.get("rows_per_task", 1_000_000))

    def partitions(self) -> list[Range]:
        out = []
        for path in files(self.path):
            with open(path, "rb") as file:
                h = Header(file)
            n = h.counts[self.element]
            step = self.per_task if h.format != "ascii" and h.row_type(self.element) is not None else max(n, 1)
            out += [Range(path, a, min(step, n - a)) for a in range(0, max(n, 1), step)]
        return out

    def read(self, part: Range):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(T.StructType([T.StructField(n, t) for n, t in zip(self.names, self.types, strict=True)]))
        with open(part.path, "rb") as file:
            h = Header(file)
            missing = set(self.names) - {p.name for p in h.elements[self.element]}
            if missing:
                raise ValueError(f"{part.path} has no {sorted(missing)}")
            for e in h.elements:
                if e == self.element:
                    break
                skip(file, h, e)
            rows = h.row_type(self.element)
            if h.format != "ascii" and rows is not None:
                file.seek(part.first * rows.itemsize, 1)
                left = part.n
                while left > 0:
                    data = np.frombuffer(file.read(min(left, 65_536) * rows.itemsize), rows)
                    if not len(data):
                        raise ValueError(f"{part.path} ends early")
                    left -= len(data)
                    native = [np.ascontiguousarray(data[n]).astype(data[n].dtype.newbyteorder("=")) for n in self.names]
                    yield pa.RecordBatch.from_arrays([pa.array(a).cast(f.type) for a, f in zip(native, arrow, strict=True)], schema=arrow)
            else:
                yield from rows_of(file, h, self.element, self.names)


class Written(WriterCommitMessage):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows


class PlyWriter(DataSourceWriter):
    """One PLY file per task in the folder; `format` is ascii, binary_little_endian or binary_big_endian."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.fields = [(f.name, f.dataType) for f in schema.fields]
        self.folder = options["path"].removeprefix("file://").removeprefix("file:")
        self.element, self.format = options.get("element", "vertex"), options.get("format_name", "binary_little_endian")
        self.comment, self.overwrite = options.get("comment", ""), overwrite

    def kinds(self) -> list[tuple[str, str, bool]]:
        out = []
        for name, kind in self.fields:
            many = isinstance(kind, T.ArrayType)
            out.append((name, NAMES[(kind.elementType if many else kind).simpleString()], many))
        return out

    def write(self, rows) -> Written:
        from pyspark import TaskContext

        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.ply")
        kinds, body, n = self.kinds(), io.BytesIO(), 0
        order = ">" if self.format == "binary_big_endian" else "<"
        for row in rows:
            n += 1
            if self.format == "ascii":
                words = []
                for v, (_, _, many) in zip(row, kinds, strict=True):
                    words += [len(v), *v] if many else [v]
                body.write((" ".join(repr(w) if isinstance(w, float) else str(int(w)) for w in words) + "\n").encode())
            else:
                for v, (_, kind, many) in zip(row, kinds, strict=True):
                    if many:
                        body.write(np.array(len(v), "u1").tobytes())
                    a = np.asarray(v)
                    if a.dtype.kind in "iu" and (a > 0x7FFFFFFF).any() or (a < -0x80000000).any():
                        raise OverflowError("PLY has no integers beyond 32 bits; cast such a column to double")
                    body.write(a.astype(order + KINDS[kind]).tobytes())
        lines = ["ply", f"format {self.format} 1.0"] + [f"comment {self.comment}"] * bool(self.comment) + [f"element {self.element} {n}"]
        lines += [f"property list uchar {kind} {name}" if many else f"property {kind} {name}" for name, kind, many in kinds] + ["end_header", ""]
        with open(path, "wb") as file:
            file.write("\n".join(lines).encode() + body.getvalue())
        return Written(path, n)

    def commit(self, messages) -> None:
        new = {m.path for m in messages if m}
        for path in glob.glob(os.path.join(self.folder, "part-*.ply")):
            if self.overwrite and path not in new:
                os.remove(path)

    def abort(self, messages) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> T.StructType:
        with open(files(self.options["path"])[0], "rb") as file:
            found = Header(file).schema(self.options.get("element", "vertex"))
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        missing = set(wanted) - set(found.fieldNames())
        if missing:
            raise ValueError(f"no such properties: {sorted(missing)}")
        return T.StructType([found[c] for c in wanted]) if wanted else found

    def reader(self, schema: T.StructType) -> PlyReader:
        return PlyReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> PlyWriter:
        return PlyWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlySource)


def texture_name(comment):
    """The texture file that a header comment names."""
    return F.regexp_extract(comment, r"(?i)texturefile\s+(.+)$", 1)


def describe(spark: SparkSession, path: str) -> DataFrame:
    """element, property, kind, size of a file's header."""
    with open(files(path)[0], "rb") as file:
        return spark.createDataFrame(Header(file).describe(), "element string, property string, kind string, size string")
