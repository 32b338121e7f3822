"""Binary workspaces of a matrix language (level 5 of the format) as DataFrames.

Files come through Spark's binary reader, one row a file, so that any store that Spark reads will do;
each is parsed where it is read. A variable is kept with its class and sizes and its value as JSON:
numbers (vectors as lists, matrices as lists of rows, higher ones by the first index), text, lists for
cells, objects for structs, a list of objects for arrays of structs, null for what is empty. struct_rows()
turns an array of structs into rows with typed, nested columns.

Sparse matrices, objects and functions have a null value. A file that can't be read as a workspace gives
one row with a null name and what is wrong with it. Files have to fit one task (2 GB at most, Spark's
limit for a binary file).
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

# Fixed values of the format: number types, classes of arrays.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
TEXT = {16: "utf-8", 17: "utf-16", 18: "utf-32"}
MATRIX, COMPRESSED = 14, 15
CLASSES = {1: "cell", 2: "struct", 3: "object", 4: "char", 5: "sparse", 6: "double", 7: "single", 8: "int8", 9: "uint8", 10: "int16", 11: "uint16", 12: "int32", 13: "uint32", 14: "int64", 15: "uint64", 16: "function", 17: "opaque"}
COMPLEX, LOGICAL = 0x08, 0x02


class _Elements:
    """The elements of a stretch of bytes, one after another."""

    def __init__(self, data: bytes, order: str):
        self.data, self.order, self.at = data, order, 0

    def __bool__(self) -> bool:
        return self.at + 8 <= len(self.data)

    def next(self) -> tuple[int, bytes]:
        kind, size = struct.unpack_from(self.order + "II", self.data, self.at)
        if kind >> 16:  # up to four bytes stand within the tag
            kind, size = kind & 0xFFFF, kind >> 16
            start, after = self.at + 4, self.at + 8
        else:
            start = self.at + 8
            after = start + size + (-size % 8 if kind != COMPRESSED else 0)
        if start + size > len(self.data):
            raise ValueError("the file ends within an element")
        self.at = after
        return kind, self.data[start : start + size]

    def numbers(self) -> np.ndarray:
        kind, data = self.next()
        if kind in TEXT:
            return np.array([ord(c) for c in _text(kind, data, self.order)], np.int64)
        return np.frombuffer(data, self.order + NUMBERS[kind])


def _text(kind: int, data: bytes, order: str) -> str:
    name = TEXT[kind]
    return data.decode(name if kind == 16 else f"{name}-{'le' if order == '<' else 'be'}")


def _nested(flat: list, sizes: list[int]):
    """A column-major list by rows; a vector stays a list, one entry is itself, none is None."""
    if not flat:
        return None
    if len(flat) == 1:
        return flat[0]
    if sum(n > 1 for n in sizes) <= 1:
        return flat
    if len(sizes) == 1:
        return flat
    return [_nested_all(flat[i :: sizes[0]], sizes[1:]) for i in range(sizes[0])]


def _nested_all(flat: list, sizes: list[int]) -> list:
    return flat if len(sizes) == 1 else [_nested_all(flat[i :: sizes[0]], sizes[1:]) for i in range(sizes[0])]


def _matrix(data: bytes, order: str) -> tuple[str, str, list[int], object]:
    """name, class, sizes, value."""
    if not data:
        return "", "double", [0, 0], None
    parts = _Elements(data, order)
    flags = int(parts.numbers()[0])
    kind, marks = CLASSES.get(flags & 0xFF, "opaque"), flags >> 8 & 0xFF
    if kind == "opaque":
        return "", kind, [], None
    sizes = [int(n) for n in parts.numbers()]
    name = parts.next()[1].decode("latin-1")
    count = int(np.prod(sizes)) if sizes else 0
    if kind in ("sparse", "function"):
        return name, kind, sizes, None
    if kind == "cell":
        cells = [_matrix(parts.next()[1], order)[3] for _ in range(count)]
        return name, kind, sizes, _nested(cells, sizes) if count != 1 else cells
    if kind in ("struct", "object"):
        if kind == "object":
            return name, kind, sizes, None
        width = int(parts.numbers()[0])
        names = parts.next()[1]
        fields = [names[i : i + width].split(b"\0")[0].decode("latin-1") for i in range(0, len(names), width)] if width else []
        rows = [{f: _matrix(parts.next()[1], order)[3] for f in fields} for _ in range(count)]
        return name, kind, sizes, rows[0] if count == 1 else rows
    values = parts.numbers() if parts else np.zeros(0)
    if kind == "char":
        lines = ["".join(chr(int(c)) for c in values[i :: sizes[0]]) for i in range(sizes[0])] if count else []
        return name, kind, sizes, lines[0] if len(lines) == 1 else lines or None
    if marks & COMPLEX:
        values = [[float(a), float(b)] for a, b in zip(values, parts.numbers())]
        return name, kind, sizes, _nested(values, sizes)
    if marks & LOGICAL:
        return name, "logical", sizes, _nested([bool(v) for v in values], sizes)
    # numbers are stored in the smallest type that holds them, whatever their class
    whole = kind not in ("double", "single")
    return name, kind, sizes, _nested([int(v) if whole else float(v) for v in values], sizes)


def parse(data: bytes) -> Iterator[tuple[str, str, list[int], object]]:
    """name, class, sizes and value of each variable."""
    if len(data) < 128 or data[126:128] not in (b"IM", b"MI"):
        raise ValueError("no workspace of level 5")
    order = "<" if data[126:128] == b"IM" else ">"
    elements = _Elements(data[128:], order)
    while elements:
        kind, body = elements.next()
        if kind == COMPRESSED:
            kind, body = _Elements(zlib.decompress(body), order).next()
        if kind == MATRIX:
            yield _matrix(body, order)


def read_workspaces(spark: SparkSession, path: str | list[str], pattern: str = "*.mat") -> DataFrame:
    """file, name, class, sizes, value (JSON), error: a row for each variable of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, data in zip(pdf["path"], pdf["content"]):
                out = []
                try:
                    for name, kind, sizes, value in parse(bytes(data)):
                        out.append((file, name, kind, sizes, None if value is None else json.dumps(value), None))
                except (ValueError, KeyError, IndexError, struct.error, zlib.error) as wrong:
                    out.append((file, None, None, None, None, f"{type(wrong).__name__}: {wrong}"))
                yield pd.DataFrame(out, columns=["file", "name", "class", "sizes", "value", "error"])

    return files.mapInPandas(rows, "file string, name string, class string, sizes array<long>, value string, error string")


def struct_rows(workspaces: DataFrame, name: str, schema: str | DataType) -> DataFrame:
    """file, position and the columns of schema: a row for each element of the arrays of structs of that
    name, in their column-major order. A single struct is an array of one. Fields that are empty or
    that an element lacks are null."""
    kind = DataType.fromDDL(schema) if isinstance(schema, str) else schema
    listed = F.when(F.col("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    held = workspaces.filter((F.col("name") == name) & (F.col("class") == "struct")).select("file", F.from_json(listed, ArrayType(kind)).alias("_rows"))
    return held.select("file", F.posexplode("_rows").alias("position", "_row")).select("file", "position", "_row.*")


def field_names(df: DataFrame, column: str) -> list[str]:
    """Of a struct, or of an array of structs."""
    kind = df.schema[column].dataType
    return (kind.elementType if isinstance(kind, ArrayType) else kind).fieldNames()


def unpack(df: DataFrame, column: str) -> DataFrame:
    """The fields of a struct as columns, after the other columns."""
    return df.select(*[c for c in df.columns if c != column], f"{column}.*")


def unzip(df: DataFrame, columns: list[str]) -> DataFrame:
    """Arrays that run in parallel (scores, image ids, boxes) as rows; shorter ones end in nulls."""
    return df.select(*[c for c in df.columns if c not in columns], F.inline_outer(F.arrays_zip(*columns)))
