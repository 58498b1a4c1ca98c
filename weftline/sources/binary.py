"""Workbook, Level-5 matrix and grid-volume files as ``row, values`` cells.

One file is one record of Spark's binaryFile source, so folders of files load in parallel.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def xlsx_rows(blob: bytes) -> list[list[str | None]]:
    """Cell texts of the first worksheet."""
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in si.iter(SHEET + "t")))
        name = min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
        rows: list[list[str | None]] = []
        for row in ElementTree.fromstring(z.read(name)).iter(SHEET + "row"):
            cells: list[str | None] = []
            for i, c in enumerate(row.iter(SHEET + "c")):
                at = _column(c.get("r")) if c.get("r") else i
                cells += [None] * (at + 1 - len(cells))
                v, kind = c.find(SHEET + "v"), c.get("t")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(SHEET + "t"))
                elif v is not None and v.text is not None:
                    cells[at] = shared[int(v.text)] if kind == "s" else v.text
            rows.append(cells)
    return rows


# Numeric type codes of the Level-5 matrix format.
MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MI_MATRIX, MI_COMPRESSED = 14, 15
MX_CELL, MX_STRUCT, MX_CHAR, MX_SPARSE = 1, 2, 4, 5


def _elements(buf: bytes, order: str):
    """Yield (type, payload) of consecutive data elements."""
    at = 0
    while at + 8 <= len(buf):
        kind, size = struct.unpack(order + "II", buf[at : at + 8])
        if kind >> 16:  # small element: size in the upper half, data in the tag
            yield kind & 0xFFFF, buf[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        yield kind, buf[at + 8 : at + 8 + size]
        at += 8 + size + (0 if kind == MI_COMPRESSED else -size % 8)


def _matrix(buf: bytes, order: str, prefix: str = ""):
    """Yield (name, array) of a matrix element and of the fields inside it."""
    parts = list(_elements(buf, order))
    if len(parts) < 3:
        return
    cls = struct.unpack(order + "I", parts[0][1][:4])[0] & 0xFF
    dims = np.frombuffer(parts[1][1], dtype=order + "i4")
    name = prefix + parts[2][1].decode("latin1")
    if cls in (MX_CELL, MX_STRUCT):
        inner = parts[3:]
        fields: list[str] = []
        if cls == MX_STRUCT:
            width = int(np.frombuffer(parts[3][1], dtype=order + "i4")[0])
            raw = parts[4][1]
            fields = [raw[i : i + width].split(b"\0")[0].decode("latin1") for i in range(0, len(raw), width)]
            inner = parts[5:]
        for i, (_, body) in enumerate(inner):
            label = fields[i % len(fields)] if fields else str(i)
            yield from _matrix(body, order, f"{name}.{label}")
        return
    if cls in (MX_CHAR, MX_SPARSE) or len(parts) < 4:
        return
    kind, body = parts[3]
    yield name, np.frombuffer(body, dtype=order + MAT_TYPES[kind]).astype(float).reshape(dims, order="F")


def mat_matrix(blob: bytes) -> np.ndarray:
    """The best numeric array of a file: two-dimensional, then most values, then least lopsided."""
    order = "<" if blob[126:128] == b"IM" else ">"
    found = []
    for kind, body in _elements(blob[128:], order):
        if kind == MI_COMPRESSED:
            kind, body = next(_elements(zlib.decompress(body), order))
        if kind == MI_MATRIX:
            found += [a for n, a in _matrix(body, order) if not n.startswith("__") and a.size]
    if not found:
        raise ValueError("no numeric array in the file")
    best = max(found, key=lambda a: (a.ndim == 2, a.size, min(a.shape)))
    return best if best.ndim == 2 else best.reshape(best.shape[0], -1)


def h5_matrix(blob: bytes, floor: float = 1e-6) -> np.ndarray:
    """Largest four-dimensional dataset as time x active voxel, else the largest matrix."""
    try:
        import h5py
    except ImportError as err:
        raise ImportError("reading HDF5 files needs h5py on the executors") from err
    volumes, flat = [], []
    with h5py.File(io.BytesIO(blob)) as f:

        def visit(_, d):
            if isinstance(d, h5py.Dataset) and d.ndim in (2, 4):
                (volumes if d.ndim == 4 else flat).append(d[()])

        f.visititems(visit)
    if volumes:
        v = max(volumes, key=lambda a: a.size)
        axis = 3 if v.shape[3] >= max(v.shape[:3]) else int(np.argmax(v.shape))
        m = np.moveaxis(v, axis, 0).reshape(v.shape[axis], -1).astype(float)
        return m[:, (np.abs(m).sum(axis=0) > floor) & (m.var(axis=0) > 1e-12)]
    m = max(flat, key=lambda a: a.size).astype(float)
    return m.T if m.shape[0] < m.shape[1] else m


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """``path, row, values`` (texts) of every file under ``path``."""

    def parse(batches):
        for pdf in batches:
            for name, blob in zip(pdf["path"], pdf["content"]):
                if name.lower().endswith(".xlsx"):
                    rows = xlsx_rows(blob)
                else:
                    m = mat_matrix(blob) if name.lower().endswith(".mat") else h5_matrix(blob)
                    rows = [[None if not np.isfinite(v) else repr(float(v)) for v in r] for r in m]
                yield pd.DataFrame({"path": name, "row": np.arange(len(rows)), "values": rows})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, row bigint, values array<string>")
