"""NIfTI-1 images as a Spark data source, after the public format specification.

Reading gives long samples (image, voxel, x, y, z, t, v). An uncompressed file is cut into ranges of frames,
each a task that seeks to its own bytes; a gzip file is one task. The options t, x, y and z (``3`` or ``3:7``)
decide which frames are read and which samples leave the reader. They are options and no pushed filters, as
this version of Spark keeps what a reader was pushed for later scans of the same DataFrame, which would then
miss rows. ``nifti_header`` reads headers only.

Writing places each task's samples at their offsets in one preallocated file on a file system all executors
share; the file gets its name when all tasks are done.

Sources take one path or a comma-separated list. Values are ``raw * slope + intercept``, a slope of 0 means
slope 1 and intercept 0. Complex and 128-bit types are refused.
"""

from __future__ import annotations

import glob
import gzip
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Datatype code to numpy type, and back (fixed values of the format).
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
NAMES = {"uint8": 2, "int16": 4, "int32": 8, "float32": 16, "float64": 64, "int8": 256, "uint16": 512, "uint32": 768, "int64": 1024, "uint64": 1280}
HEADER_BYTES = 348
SAMPLES = "image string, voxel long, x int, y int, z int, t int, v double"
HEADERS = (
    "image string, xdim int, ydim int, zdim int, vdim int, dt int, slope double, inter double, intent_code int, intent_p array<double>, "
    "pixdim array<double>, qform array<double>, sform array<double>, descrip string, extensions array<struct<code: int, content: binary>>"
)
CHUNK_VALUES = 250_000


@dataclass
class Header:
    """What is needed of a NIfTI-1 header."""

    dims: tuple[int, int, int, int]
    code: int = 16
    slope: float = 1.0
    inter: float = 0.0
    pixdim: tuple[float, ...] = (1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0)
    intent: int = 0
    intent_p: tuple[float, float, float] = (0.0, 0.0, 0.0)
    qform_code: int = 0
    sform_code: int = 0
    quatern: tuple[float, ...] = (0.0,) * 6
    srow: tuple[float, ...] = (0.0,) * 12
    descrip: str = ""
    offset: int = 352
    order: str = "<"
    extensions: list[tuple[int, bytes]] = field(default_factory=list)

    @property
    def frame(self) -> int:
        return self.dims[0] * self.dims[1] * self.dims[2]

    @property
    def type(self) -> np.dtype:
        if self.code not in TYPES:
            raise ValueError(f"datatype {self.code} is not supported")
        return np.dtype(self.order + TYPES[self.code])

    def sform(self) -> np.ndarray | None:
        if not self.sform_code:
            return None
        return np.vstack([np.reshape(self.srow, (3, 4)), [0, 0, 0, 1]])

    def qform(self) -> np.ndarray | None:
        """Rotation by the quaternion, voxel sizes and offset."""
        if not self.qform_code:
            return None
        b, c, d, *off = self.quatern
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        rot = np.array([
            [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
            [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
            [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
        ])
        size = np.array(self.pixdim[1:4], float)
        size[2] *= -1 if self.pixdim[0] < 0 else 1
        out = np.eye(4)
        out[:3, :3], out[:3, 3] = rot * size, off
        return out

    def affine(self) -> np.ndarray:
        """The sform, else the qform, else the voxel sizes."""
        for m in (self.sform(), self.qform()):
            if m is not None:
                return m
        return np.diag([*self.pixdim[1:4], 1.0])


def _open(path: str):
    return gzip.open(path, "rb") if path.endswith(".gz") else open(path, "rb")


def read_header(path: str) -> Header:
    with _open(path) as f:
        raw = f.read(HEADER_BYTES)
        if len(raw) < HEADER_BYTES:
            raise ValueError(f"{path}: shorter than a header")
        order = "<" if struct.unpack("<i", raw[:4])[0] == HEADER_BYTES else ">"
        if struct.unpack(order + "i", raw[:4])[0] != HEADER_BYTES or raw[344:347] not in (b"n+1", b"ni1"):
            raise ValueError(f"{path}: no NIfTI-1 header")
        dim = struct.unpack(order + "8h", raw[40:56])
        n = dim[0]
        dims = tuple(max(1, dim[i]) if i <= n else 1 for i in range(1, 5))
        h = Header(
            dims=dims,
            intent_p=struct.unpack(order + "3f", raw[56:68]), intent=struct.unpack(order + "h", raw[68:70])[0],
            code=struct.unpack(order + "h", raw[70:72])[0], pixdim=struct.unpack(order + "8f", raw[76:108]),
            offset=int(struct.unpack(order + "f", raw[108:112])[0]), slope=struct.unpack(order + "f", raw[112:116])[0],
            inter=struct.unpack(order + "f", raw[116:120])[0], descrip=raw[148:228].split(b"\0")[0].decode("latin-1"),
            qform_code=struct.unpack(order + "h", raw[252:254])[0], sform_code=struct.unpack(order + "h", raw[254:256])[0],
            quatern=struct.unpack(order + "6f", raw[256:280]), srow=struct.unpack(order + "12f", raw[280:328]), order=order,
        )
        if f.read(4)[:1] not in (b"", b"\0"):
            at = HEADER_BYTES + 4
            while at + 8 <= h.offset:
                size, code = struct.unpack(order + "2i", f.read(8))
                if size < 8:
                    break
                h.extensions.append((code, f.read(size - 8)))
                at += size
        return h


def header_bytes(h: Header) -> bytes:
    """Header and extensions up to the data; a missing q or s form is a copy of the other."""
    ext = b""
    for code, content in h.extensions:
        pad = -(len(content) + 8) % 16
        ext += struct.pack("<2i", len(content) + 8 + pad, code) + content + b"\0" * pad
    raw = bytearray(HEADER_BYTES)
    put = lambda at, fmt, *v: struct.pack_into("<" + fmt, raw, at, *v)
    put(0, "i", HEADER_BYTES)
    put(40, "8h", 4 if h.dims[3] > 1 else 3, *h.dims, 1, 1, 1)
    put(56, "3f", *h.intent_p)
    put(68, "3h", h.intent, h.code, np.dtype(TYPES[h.code]).itemsize * 8)
    put(76, "8f", *h.pixdim)
    put(108, "3f", float(HEADER_BYTES + 4 + len(ext)), h.slope, h.inter)
    raw[123] = 10  # mm and seconds
    raw[148:228] = h.descrip.encode("latin-1", "replace")[:79].ljust(80, b"\0")
    quatern, qcode, srow, scode = h.quatern, h.qform_code, h.srow, h.sform_code
    if scode and not qcode:
        quatern, qcode = quaternion(np.vstack([np.reshape(srow, (3, 4)), [0, 0, 0, 1]])), scode
    elif qcode and not scode:
        srow, scode = tuple(h.qform()[:3].ravel()), qcode
    put(252, "2h", qcode, scode)
    put(256, "6f", *quatern)
    put(280, "12f", *srow)
    raw[344:348] = b"n+1\0"
    return bytes(raw) + (b"\1\0\0\0" if ext else b"\0\0\0\0") + ext


def quaternion(m: np.ndarray) -> tuple[float, ...]:
    """Quaternion part and offset of an affine without shear."""
    r = m[:3, :3] / np.maximum(np.linalg.norm(m[:3, :3], axis=0), 1e-12)
    if np.linalg.det(r) < 0:
        r = r * np.array([1, 1, -1])
    w, v = np.linalg.eigh(np.array([
        [r[0, 0] - r[1, 1] - r[2, 2], r[1, 0] + r[0, 1], r[2, 0] + r[0, 2], r[2, 1] - r[1, 2]],
        [r[1, 0] + r[0, 1], r[1, 1] - r[0, 0] - r[2, 2], r[2, 1] + r[1, 2], r[0, 2] - r[2, 0]],
        [r[2, 0] + r[0, 2], r[2, 1] + r[1, 2], r[2, 2] - r[0, 0] - r[1, 1], r[1, 0] - r[0, 1]],
        [r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1], r[0, 0] + r[1, 1] + r[2, 2]],
    ]))
    q = v[:, np.argmax(w)]
    q = q * (-1 if q[3] < 0 else 1)
    return (*q[:3], *m[:3, 3])


def read_frames(path: str, h: Header, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
    """(t, scaled values) of frames first..last-1, one frame in memory at a time."""
    size = h.type.itemsize * h.frame
    with _open(path) as f:
        f.seek(h.offset + first * size)
        for t in range(first, last):
            raw = np.frombuffer(f.read(size), h.type)
            if len(raw) < h.frame:
                raise ValueError(f"{path}: frame {t} is cut off")
            v = raw.astype(float)
            yield t, v if h.slope == 0 else v * h.slope + h.inter


def paths_of(options: dict) -> list[str]:
    out = []
    for p in options.get("path", "").split(","):
        p = p.strip().removeprefix("file:")
        out += sorted(glob.glob(p)) if glob.has_magic(p) else [p]
    missing = [p for p in out if not os.path.exists(p)]
    if missing or not out:
        raise FileNotFoundError(f"no such image: {', '.join(missing) or options.get('path')}")
    return out


def span(text: str | None) -> tuple[int, int]:
    """First and last index of ``3`` or ``3:7``; everything where nothing is given."""
    if not text:
        return 0, 1 << 30
    a, _, b = text.partition(":")
    return int(a), int(b or a)


class Frames(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        super().__init__(None)
        self.path, self.first, self.last = path, first, last


class SampleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.bounds = {c: span(options.get(c)) for c in "xyzt"}

    def partitions(self):
        wanted = int(self.options.get("values_per_task", 16_000_000))
        out = []
        for p in paths_of(self.options):
            h = read_header(p)
            first, last = self.bounds["t"][0], min(h.dims[3], self.bounds["t"][1] + 1)
            step = max(1, last - first) if p.endswith(".gz") else max(1, wanted // max(1, h.frame))
            out += [Frames(p, a, min(a + step, last)) for a in range(first, last, step)]
        return out or [Frames("", 0, 0)]

    def read(self, partition):
        if partition.first >= partition.last:
            return
        h = read_header(partition.path)
        xd, yd, zd, _ = h.dims
        k = np.arange(h.frame)
        x, y, z = k % xd, k // xd % yd, k // (xd * yd)
        keep = np.ones(h.frame, bool)
        for c, v in zip("xyz", (x, y, z)):
            lo, hi = self.bounds[c]
            keep &= (v >= lo) & (v <= hi)
        k, x, y, z = k[keep], x[keep].astype(np.int32), y[keep].astype(np.int32), z[keep].astype(np.int32)
        for t, v in read_frames(partition.path, h, partition.first, partition.last):
            v = v[keep]
            for a in range(0, len(k), CHUNK_VALUES):
                s = slice(a, a + CHUNK_VALUES)
                n = len(k[s])
                cols = [pa.array([partition.path] * n), pa.array(k[s]), pa.array(x[s]), pa.array(y[s]), pa.array(z[s]), pa.array(np.full(n, t, np.int32)), pa.array(v[s])]
                yield pa.RecordBatch.from_arrays(cols, ["image", "voxel", "x", "y", "z", "t", "v"])


@dataclass
class Done(WriterCommitMessage):
    count: int


class SampleWriter(DataSourceWriter):
    """Options: path, xdim, ydim, zdim, vdim, dt, slope, inter, affine (16 numbers), tr, intent, descrip."""

    def __init__(self, options: dict):
        o = options
        dims = tuple(int(o.get(k, 1)) for k in ("xdim", "ydim", "zdim", "vdim"))
        m = np.array([float(v) for v in o["affine"].split(",")]).reshape(4, 4) if o.get("affine") else None
        size = tuple(np.linalg.norm(m[:3, :3], axis=0)) if m is not None else (1.0, 1.0, 1.0)
        self.h = Header(
            dims=dims, code=NAMES[o.get("dt", "float32")], slope=float(o.get("slope", 1)), inter=float(o.get("inter", 0)),
            pixdim=(1.0, *size, float(o.get("tr", 1)), 0.0, 0.0, 0.0), intent=int(o.get("intent", 0)), descrip=o.get("descrip", ""),
            sform_code=int(m is not None), srow=tuple(m[:3].ravel()) if m is not None else (0.0,) * 12,
        )
        self.path = o["path"].removeprefix("file:")
        if self.path.endswith(".gz"):
            raise ValueError("tasks place their samples by offset, so the file is not compressed")
        self.part = self.path + ".part"
        head = header_bytes(self.h)
        self.offset = len(head)
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        with open(self.part, "wb") as f:
            f.write(head)
            blank = np.full(self.h.frame, np.nan if self.h.type.kind == "f" else 0, self.h.type).tobytes()
            for _ in range(dims[3]):
                f.write(blank)

    def encode(self, v: np.ndarray) -> np.ndarray:
        """Inverse scaling and truncation toward zero; what an integer type cannot hold becomes its nearest value, NaN 0."""
        r = v if self.h.slope == 0 else (v - self.h.inter) / self.h.slope
        if self.h.type.kind == "f":
            return r.astype(self.h.type)
        info = np.iinfo(self.h.type)
        r = np.trunc(np.nan_to_num(r, nan=0.0, posinf=float(info.max), neginf=float(info.min)))
        return np.where(r >= info.max, info.max, np.where(r <= info.min, info.min, r)).astype(self.h.type)

    def write(self, iterator):
        n = 0
        xd, yd, _, _ = self.h.dims
        with open(self.part, "r+b") as f:
            rows = []

            def flush():
                a = np.array([(r["t"] * self.h.frame + r["z"] * xd * yd + r["y"] * xd + r["x"], np.nan if r["v"] is None else r["v"]) for r in rows], float)
                a = a[np.argsort(a[:, 0], kind="stable")]
                at, v = a[:, 0].astype(np.int64), self.encode(a[:, 1])
                # Runs of neighbouring cells are one write.
                cut = np.flatnonzero(np.diff(at) != 1) + 1
                for start, values in zip(at[np.r_[0, cut]], np.split(v, cut)):
                    f.seek(self.offset + int(start) * self.h.type.itemsize)
                    f.write(values.tobytes())
                rows.clear()

            for r in iterator:
                rows.append(r)
                n += 1
                if len(rows) >= CHUNK_VALUES:
                    flush()
            if rows:
                flush()
        return Done(n)

    def commit(self, messages):
        os.replace(self.part, self.path)

    def abort(self, messages):
        if os.path.exists(self.part):
            os.remove(self.part)


class NiftiSource(DataSource):
    @classmethod
    def name(cls):
        return "nifti"

    def schema(self):
        return SAMPLES

    def reader(self, schema):
        return SampleReader(self.options)

    def writer(self, schema, overwrite):
        path = self.options["path"].removeprefix("file:")
        if os.path.exists(path) and not overwrite:
            raise FileExistsError(path)
        return SampleWriter(self.options)


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [Frames(p, 0, 1) for p in paths_of(self.options)]

    def read(self, partition):
        h = read_header(partition.path)
        flat = lambda m: None if m is None else [float(v) for v in m.ravel()]
        yield (
            partition.path, *h.dims, h.code, float(h.slope), float(h.inter), h.intent, [float(v) for v in h.intent_p], [float(v) for v in h.pixdim],
            flat(h.qform()), flat(h.sform()), h.descrip, [(c, b) for c, b in h.extensions],
        )


class NiftiHeaderSource(DataSource):
    @classmethod
    def name(cls):
        return "nifti_header"

    def schema(self):
        return HEADERS

    def reader(self, schema):
        return HeaderReader(self.options)


def register(spark) -> None:
    """Make ``spark.read.format("nifti")`` and ``("nifti_header")`` known."""
    spark.dataSource.register(NiftiSource)
    spark.dataSource.register(NiftiHeaderSource)


def read_point(path: str, x: int, y: int, z: int) -> np.ndarray:
    """One voxel's series by seeking to its values, without reading the frames."""
    h = read_header(path)
    if not all(0 <= p < d for p, d in zip((x, y, z), h.dims)):
        raise IndexError(f"voxel {x},{y},{z} is outside {h.dims[:3]}")
    at = z * h.dims[0] * h.dims[1] + y * h.dims[0] + x
    if path.endswith(".gz"):
        return np.array([v[at] for _, v in read_frames(path, h, 0, h.dims[3])])
    data = np.memmap(path, h.type, "r", h.offset, (h.dims[3], h.frame))
    v = data[:, at].astype(float)
    return v if h.slope == 0 else v * h.slope + h.inter


def append_comment(h: Header, text: str, code: int = 6) -> Header:
    """The header with a provenance text appended as an extension."""
    h.extensions.append((code, text.encode("utf-8")))
    return h
