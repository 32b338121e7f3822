"""Workspaces written here, by the format's description, and read back."""

import math
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lodemine.sources import workspaces as W
from lodemine.sources.views import detections

CODES = {"b": 1, "B": 2, "h": 3, "H": 4, "i": 5, "I": 6, "f": 7, "d": 9, "q": 12, "Q": 13}


def element(kind, data, order, small=True):
    if small and len(data) <= 4 and kind not in (14, 15):
        head = struct.pack(order + "HH", kind, len(data)) if order == "<" else struct.pack(">HH", len(data), kind)
        return head + data.ljust(4, b"\0")
    return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8 if kind != 15 else 0)


def numbers(code, values, order):
    return element(CODES[code], struct.pack(f"{order}{len(values)}{code}", *values), order)


def matrix(value, name="", order="<", code="d", kind=6, sizes=None, flags=0):
    head = lambda k, s: numbers("I", [k | flags << 8, 0], order) + numbers("i", s, order) + element(1, name.encode(), order)
    if isinstance(value, str):
        body = head(4, [1 if value else 0, len(value)]) + element(4, b"".join(struct.pack(order + "H", ord(c)) for c in value), order)
    elif isinstance(value, dict) or isinstance(value, list) and value and isinstance(value[0], dict):
        rows = [value] if isinstance(value, dict) else value
        fields = list(rows[0])
        body = head(2, [1, len(rows)]) + numbers("i", [32], order) + element(1, b"".join(f.encode().ljust(32, b"\0") for f in fields), order, small=False)
        body += b"".join(matrix(r[f], order=order) for r in rows for f in fields)
    elif isinstance(value, tuple):  # a cell
        body = head(1, [1, len(value)]) + b"".join(matrix(v, order=order) for v in value)
    else:
        flat = [] if value is None else value if isinstance(value, list) else [value]
        body = head(kind, sizes or ([0, 0] if not flat else [1, len(flat)])) + numbers(code, flat, order)
    return element(14, body, order)


def workspace(parts, order="<", packed=False):
    head = b"a workspace".ljust(124) + struct.pack(order + "H", 0x0100) + (b"IM" if order == "<" else b"MI")
    return head + b"".join(element(15, zlib.compress(p), order) if packed else p for p in parts)


@pytest.mark.parametrize("order, packed", [("<", False), (">", False), ("<", True)])
def test_all_kinds_of_values(order, packed):
    m = lambda *a, **k: matrix(*a, order=order, **k)
    parts = [
        m(1.5, "x"), m([1, 2, 300], "small", code="h"), m([1.0, 2.0, 3.0, 4.0, 5.0, 6.0], "grid", sizes=[2, 3]), m(list(range(8)), "cube", sizes=[2, 2, 2], code="i", kind=12),
        m("tëxt", "s"), m("", "none"), m(None, "empty"), m((1.0, "a", None, {"k": 2.0}), "cell"), m([{"a": 1.0, "b": "u"}, {"a": None, "b": "v"}], "rows"), m({"in": {"er": [1.0, 2.0]}}, "deep"),
        m(255, "byte", code="B", kind=9), m([1, 0], "flag", code="B", kind=9, flags=2), m(math.nan, "nan"), m(-(2**60), "long", code="q", kind=14),
    ]
    got = {n: (k, s, v) for n, k, s, v in W.parse(workspace(parts, order, packed))}
    values = {n: v for n, (_, _, v) in got.items()}
    assert math.isnan(values.pop("nan"))
    assert values == {
        "x": 1.5, "small": [1.0, 2.0, 300.0], "grid": [[1.0, 3.0, 5.0], [2.0, 4.0, 6.0]], "cube": [[[0, 4], [2, 6]], [[1, 5], [3, 7]]], "s": "tëxt", "none": None, "empty": None,
        "cell": [1.0, "a", None, {"k": 2.0}], "rows": [{"a": 1.0, "b": "u"}, {"a": None, "b": "v"}], "deep": {"in": {"er": [1.0, 2.0]}}, "byte": 255, "flag": [True, False], "long": -(2**60),
    }
    assert got["grid"][:2] == ("double", [2, 3]) and got["flag"][0] == "logical" and got["rows"][:2] == ("struct", [1, 2])


def test_a_table_comes_back(spark, sf, tmp_path):
    rows = detections(spark, sf).orderBy("det_id").limit(300).collect()
    for part in range(3):  # three files
        some = [{"det_id": float(r.det_id), "decision": r.decision, "meta": {"imidx": float(r.imidx), "box": [float(r.x1), float(r.y1), float(r.x2), float(r.y2)]}, "name": f"d{r.det_id}"} for r in rows[part::3]]
        folder = tmp_path / f"set{part % 2}"
        folder.mkdir(exist_ok=True)
        (folder / f"w{part}.mat").write_bytes(workspace([matrix(3.0, "n", order="<>"[part % 2]), matrix(some, "dets", order="<>"[part % 2])], "<>"[part % 2], part == 2))
    (tmp_path / "bad.mat").write_bytes(b"no workspace at all")
    (tmp_path / "cut.mat").write_bytes(workspace([matrix([1.0] * 100, "x")])[:-300])
    (tmp_path / "other.txt").write_text("not asked for")
    held = W.read_workspaces(spark, str(tmp_path))
    assert [r.file.rsplit("/", 1)[-1] for r in held.filter("name IS NULL").orderBy("file").collect()] == ["bad.mat", "cut.mat"], held.filter("name IS NULL").collect()
    got = W.struct_rows(held, "dets", "det_id double, decision double, meta struct<imidx: double, box: array<double>>, name string, absent int")
    assert got.columns == ["file", "position", "det_id", "decision", "meta", "name", "absent"]
    back = {int(r.det_id): (r.decision, int(r.imidx), r.box, r.name, r.absent) for r in W.unpack(got, "meta").collect()}
    assert back == {r.det_id: (r.decision, r.imidx, [r.x1, r.y1, r.x2, r.y2], f"d{r.det_id}", None) for r in rows}
    assert held.filter("name = 'n'").agg(F.sum(F.col("value").cast("double"))).first()[0] == 9.0
    assert W.field_names(got, "meta") == ["imidx", "box"]


def test_parallel_arrays_as_rows(spark):
    df = spark.createDataFrame([(1, [0.5, 0.25], [7, 8]), (2, [], []), (3, [1.0], None)], "detector int, scores array<double>, imgIds array<int>")
    got = sorted(map(str, map(tuple, W.unzip(df, ["scores", "imgIds"]).collect())))
    assert got == ["(1, 0.25, 8)", "(1, 0.5, 7)", "(2, None, None)", "(3, None, None)"]
