"""Decoders and encoders of image and transformation files.

Files are read as binary rows and decoded in mapInPandas, many files a task.
An image row has attrs (sizes, spacing, origin, axes), voxel_type and pixels,
x fastest.
"""

from __future__ import annotations

import gzip
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

ATTRS = "nx int, ny int, nz int, nt int, dx double, dy double, dz double, dt double, origin array<double>, axes array<double>"
SCHEMA = f"path string, {ATTRS}, voxel_type string, pixels array<double>"
#: NIfTI data types.
NIFTI_TYPES = {256: "i1", 2: "u1", 4: "i2", 512: "u2", 16: "f4", 8: "i4", 768: "u4", 64: "f8"}
DOF_MAGIC, DOF_RIGID, DOF_AFFINE = 815007, 2, 3


def image(sizes, spacing, kind: str, pixels: np.ndarray, origin=(0.0, 0.0, 0.0), axes=(1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0)) -> dict:
    sizes, spacing = (list(sizes) + [1] * 4)[:4], (list(spacing) + [1.0] * 4)[:4]
    return dict(zip(("nx", "ny", "nz", "nt"), map(int, sizes))) | dict(zip(("dx", "dy", "dz", "dt"), map(float, spacing))) | {"origin": [float(v) for v in origin], "axes": [float(v) for v in axes], "voxel_type": kind, "pixels": np.asarray(pixels, float).ravel()}


def read_nifti(data: bytes) -> dict:
    """NIfTI-1: the qform, else the sform, else the grid gives axes and the origin, which is the centre."""
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    dim = struct.unpack(order + "8h", data[40:56])
    if dim[0] > 5 or dim[0] == 5 and dim[4] != 1:
        raise ValueError(f"{dim[0]} dimensions aren't supported")
    sizes = [max(1, d) for d in (dim[1:5] if dim[0] >= 1 else (1,) * 4)]
    kind = struct.unpack(order + "h", data[70:72])[0]
    if kind not in NIFTI_TYPES:
        raise ValueError(f"data type {kind} isn't supported")
    pixdim = struct.unpack(order + "8f", data[76:108])
    offset, slope, inter = struct.unpack(order + "3f", data[108:120])
    qform, sform = struct.unpack(order + "2h", data[252:256])
    b, c, d, qx, qy, qz = struct.unpack(order + "6f", data[256:280])
    rows = np.array(struct.unpack(order + "12f", data[280:328])).reshape(3, 4)
    spacing = [abs(p) or 1.0 for p in pixdim[1:5]]
    if qform > 0:
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        r = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - c * c - b * b]])
        r[:, 2] *= -1.0 if pixdim[0] < 0 else 1.0
        first = np.array([qx, qy, qz])
    elif sform > 0:
        spacing[:3] = np.linalg.norm(rows[:, :3], axis=0)
        r, first = rows[:, :3] / np.array(spacing[:3]), rows[:, 3]
    else:
        r, first = np.eye(3), None
    half = (np.array(sizes[:3]) - 1) / 2 * np.array(spacing[:3])
    origin = np.zeros(3) if first is None else first + r @ half
    count = int(np.prod(sizes))
    pixels = np.frombuffer(data, order + NIFTI_TYPES[kind], count, int(offset)).astype(float)
    if slope and (slope != 1 or inter):
        pixels = pixels * slope + inter
    return image(sizes, spacing, NIFTI_TYPES[kind], pixels, origin, r.T.ravel())


def write_nifti(row: dict) -> bytes:
    sizes = [row[k] for k in ("nx", "ny", "nz", "nt")]
    kind = {v: k for k, v in NIFTI_TYPES.items()}[row["voxel_type"]]
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3 if sizes[3] == 1 else 4, *sizes, 1, 1, 1)
    struct.pack_into("<2h", head, 70, kind, 8 * np.dtype(row["voxel_type"]).itemsize)
    struct.pack_into("<8f", head, 76, 1.0, *[row[k] for k in ("dx", "dy", "dz", "dt")], 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    r = np.array(row["axes"], float).reshape(3, 3).T
    spacing = np.array([row[k] for k in ("dx", "dy", "dz")])
    first = np.array(row["origin"]) - r @ ((np.array(sizes[:3]) - 1) / 2 * spacing)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *np.hstack([r * spacing, first[:, None]]).ravel())
    head[344:348] = b"n+1\0"
    return bytes(head) + np.asarray(row["pixels"]).astype("<" + row["voxel_type"]).tobytes()


def read_pgm(data: bytes) -> dict:
    """Binary or plain grey map of 8 or 16 bits."""
    head = re.match(rb"(P[25])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s", data)
    if not head:
        raise ValueError("not a grey map")
    nx, ny, most = (int(head[k]) for k in (2, 3, 4))
    kind = "u1" if most < 256 else "u2"
    pixels = np.array(data[head.end() :].split(), float)[: nx * ny] if head[1] == b"P2" else np.frombuffer(data, ">" + kind, nx * ny, head.end())
    return image((nx, ny), (1, 1), kind, pixels)


def write_pgm(row: dict) -> bytes:
    """One slice, scaled so that its range fills a byte."""
    p = np.asarray(row["pixels"], float)
    span = p.max() - p.min()
    return f"P5\n{row['nx']} {row['ny']}\n255\n".encode() + np.floor((p - p.min()) * (255 / span if span else 0) + 0.5).astype("u1").tobytes()


def read_vtk(data: bytes) -> dict:
    """Legacy structured points, binary or plain."""
    end = data.find(b"LOOKUP_TABLE")
    text = data[: data.find(b"\n", end if end >= 0 else data.find(b"SCALARS")) + 1].decode("latin-1")
    get = lambda name, n: [float(v) for v in re.search(rf"{name}\s+" + r"\s+".join([r"(\S+)"] * n), text).groups()]
    sizes, origin, spacing = get("DIMENSIONS", 3), get("ORIGIN", 3), get("(?:SPACING|ASPECT_RATIO)", 3)
    names = {"unsigned_char": "u1", "char": "i1", "short": "i2", "unsigned_short": "u2", "int": "i4", "unsigned_int": "u4", "float": "f4", "double": "f8"}
    scalars = re.search(r"SCALARS\s+\S+\s+(\S+)[^\n]*\n(?:LOOKUP_TABLE[^\n]*\n)?", text)
    kind, count = names[scalars[1]], int(np.prod(sizes))
    pixels = np.frombuffer(data, ">" + kind, count, scalars.end()) if "BINARY" in text else np.array(data[scalars.end() :].split(), float)[:count]
    centre = np.array(origin) + (np.array(sizes) - 1) / 2 * np.array(spacing)
    return image(sizes, spacing, kind, pixels, centre)


def read_analyze(header: bytes, voxels: bytes) -> dict:
    """A header and voxel file pair."""
    order = "<" if struct.unpack("<i", header[:4])[0] == 348 else ">"
    dim = struct.unpack(order + "8h", header[40:56])
    kind = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8"}[struct.unpack(order + "h", header[70:72])[0]]
    pixdim = struct.unpack(order + "8f", header[76:108])
    sizes = [max(1, d) for d in dim[1:5]]
    return image(sizes, [abs(p) or 1.0 for p in pixdim[1:5]], kind, np.frombuffer(voxels, order + kind, int(np.prod(sizes))))


def read_dof(data: bytes) -> dict:
    """Magic, type, count and doubles, big-endian: a rigid or affine transformation."""
    magic, kind, count = struct.unpack(">3I", data[:12])
    if magic != DOF_MAGIC:
        raise ValueError("not a transformation file")
    names = ("tx", "ty", "tz", "rx", "ry", "rz", "sx", "sy", "sz", "sxy", "syz", "sxz")
    values = struct.unpack(f">{count}d", data[12 : 12 + 8 * count])
    return {"dof_type": kind} | dict(zip(names, values))


def write_dof(row: dict) -> bytes:
    return struct.pack(">3I6d", DOF_MAGIC, DOF_RIGID, 6, *[row[k] for k in ("tx", "ty", "tz", "rx", "ry", "rz")])


def decode(data: bytes) -> dict:
    """Dispatch by the file's first bytes, compressed or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    if len(data) >= 256 and struct.unpack(">I", data[252:256])[0] in GIPL_MAGIC:
        return read_gipl(data)
    if data[344:347] in (b"n+1", b"ni1"):
        return read_nifti(data)
    if len(data) > 348 and 348 in struct.unpack("<i", data[:4]) + struct.unpack(">i", data[:4]):
        return read_analyze(data[:348], data[348:])
    if data[:5] == b"# vtk":
        return read_vtk(data)
    if data[:4] == b"\x89PNG":
        return read_png(data)
    if data[:2] in (b"P2", b"P5"):
        return read_pgm(data)
    raise ValueError("no reader knows this file")


def scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Images of all files below a path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([{"path": p} | decode(bytes(c)) for p, c in zip(f["path"], f["content"])], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content").mapInPandas(run, SCHEMA)


def scan_transformations(spark: SparkSession, path: str) -> DataFrame:
    """slice_id and six parameters of files named transformation<slice>.dof."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [{"slice_id": int(re.search(r"(\d+)\.dof$", p)[1])} | read_dof(bytes(c)) for p, c in zip(f["path"], f["content"])]
            yield pd.DataFrame(rows, columns=["slice_id", "tx", "ty", "tz", "rx", "ry", "rz"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "transformation*.dof").load(path).select("path", "content")
    return files.mapInPandas(run, "slice_id long, tx double, ty double, tz double, rx double, ry double, rz double")


def encoded(images: DataFrame, writer=write_nifti) -> DataFrame:
    """path and content of each image in a file format."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "content": [writer(r) for r in f.to_dict("records")]})

    return images.mapInPandas(run, "path string, content binary")


def frames_of(images: DataFrame) -> DataFrame:
    """A stack for each time frame of an image; the frame's pixels are cut from the whole."""
    t = images.select("*", F.explode(F.sequence(F.lit(0), F.col("nt") - 1)).alias("t"))
    size = F.col("nx") * F.col("ny") * F.col("nz")
    return t.withColumn("pixels", F.slice("pixels", F.col("t") * size + 1, size)).withColumn("nt", F.lit(1))


def millilitres(images: DataFrame, border: int = 0) -> DataFrame:
    """path and whole millilitres of voxels that aren't 0, those within border of an image's edge left out (on axes longer than twice that)."""
    place = {"nx": lambda i: i % F.col("nx"), "ny": lambda i: F.floor(i / F.col("nx")) % F.col("ny"), "nz": lambda i: F.floor(i / (F.col("nx") * F.col("ny"))) % F.col("nz")}

    def counts(p, i):
        ok = p != 0
        for n, at in place.items() if border else ():
            ok = ok & ((F.col(n) <= 2 * border) | ((at(i) >= border) & (at(i) < F.col(n) - border)))
        return ok

    n = F.size(F.filter("pixels", counts))
    return images.select("path", F.floor(n * F.col("dx") * F.col("dy") * F.col("dz") / 1000).cast("long").alias("ml"))


def write_transformations(rows: DataFrame, path: str) -> None:
    """A row a file (name transformation<slice>.dof, bytes) below path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            records = f.to_dict("records")
            yield pd.DataFrame({"path": [f"transformation{r['slice_id']}.dof" for r in records], "content": [write_dof(r) for r in records]})

    rows.mapInPandas(run, "path string, content binary").write.parquet(path)


def read_transformations(spark: SparkSession, path: str) -> DataFrame:
    """slice_id and six parameters of the files below path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [{"slice_id": int(re.search(r"(\d+)\.dof$", p)[1])} | read_dof(bytes(c)) for p, c in zip(f["path"], f["content"])]
            yield pd.DataFrame(rows, columns=["slice_id", "tx", "ty", "tz", "rx", "ry", "rz"])

    return spark.read.parquet(path).mapInPandas(run, "slice_id long, tx double, ty double, tz double, rx double, ry double, rz double")


#: Voxel types of GIPL files, by number, and of VTK files, by name.
GIPL_TYPES = {7: "i1", 8: "u1", 15: "i2", 16: "u2", 31: "u4", 32: "i4", 64: "f4", 65: "f8"}
GIPL_MAGIC = (719555000, 4026526128, 815006, 815007)
VTK_NAMES = {"u1": "unsigned_char", "i1": "char", "i2": "short", "u2": "unsigned_short", "i4": "int", "u4": "unsigned_int", "f4": "float", "f8": "double"}


def write_gipl(row: dict) -> bytes:
    """Big-endian, 256 bytes of header: sizes, type, spacing, the first two axes, origin and magic number."""
    head = bytearray(256)
    struct.pack_into(">4H", head, 0, *[row[k] for k in ("nx", "ny", "nz", "nt")])
    struct.pack_into(">H", head, 8, {v: k for k, v in GIPL_TYPES.items()}[row["voxel_type"]])
    struct.pack_into(">4f", head, 10, *[row[k] for k in ("dx", "dy", "dz", "dt")])
    axes = np.array(row["axes"], float)
    struct.pack_into(">3f", head, 106, *axes[:3])
    struct.pack_into(">3f", head, 122, *axes[3:6])
    p = np.asarray(row["pixels"], float)
    struct.pack_into(">2d", head, 188, p.min(), p.max())
    struct.pack_into(">3d", head, 204, *row["origin"])
    struct.pack_into(">I", head, 252, GIPL_MAGIC[0])
    return bytes(head) + p.astype(">" + row["voxel_type"]).tobytes()


def read_gipl(data: bytes) -> dict:
    sizes = [max(1, n) for n in struct.unpack(">4H", data[:8])]
    kind = GIPL_TYPES[struct.unpack(">H", data[8:10])[0]]
    spacing = [abs(d) or 1.0 for d in struct.unpack(">4f", data[10:26])]
    first, second = (np.array(struct.unpack(">3f", data[k : k + 12])) for k in (106, 122))
    axes = np.concatenate([first, second, np.cross(first, second)]) if first.any() and second.any() else np.eye(3).ravel()
    return image(sizes, spacing, kind, np.frombuffer(data, ">" + kind, int(np.prod(sizes)), 256), struct.unpack(">3d", data[204:228]), axes)


def write_vtk(row: dict) -> bytes:
    """Legacy structured points, binary."""
    sizes, spacing = [row[k] for k in ("nx", "ny", "nz")], [row[k] for k in ("dx", "dy", "dz")]
    first = np.array(row["origin"]) - (np.array(sizes) - 1) / 2 * np.array(spacing)
    line = lambda name, v: f"{name} " + " ".join(map(repr, map(float, v)))
    head = ["# vtk DataFile Version 3.0", "image", "BINARY", "DATASET STRUCTURED_POINTS", "DIMENSIONS " + " ".join(map(str, sizes)), line("ORIGIN", first), line("SPACING", spacing), f"POINT_DATA {int(np.prod(sizes))}", f"SCALARS scalars {VTK_NAMES[row['voxel_type']]} 1", "LOOKUP_TABLE default\n"]
    return "\n".join(head).encode() + np.asarray(row["pixels"], float).astype(">" + row["voxel_type"]).tobytes()


def write_analyze(row: dict) -> bytes:
    """Header and voxels, one after the other: the 348 bytes of a .hdr file and what an .img file holds."""
    head = bytearray(348)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3 if row["nt"] == 1 else 4, *[row[k] for k in ("nx", "ny", "nz", "nt")], 1, 1, 1)
    kind = {"u1": 2, "i2": 4, "i4": 8, "f4": 16, "f8": 64}[row["voxel_type"]]
    struct.pack_into("<2h", head, 70, kind, 8 * np.dtype(row["voxel_type"]).itemsize)
    struct.pack_into("<8f", head, 76, 1.0, *[row[k] for k in ("dx", "dy", "dz", "dt")], 1, 1, 1)
    return bytes(head) + np.asarray(row["pixels"], float).astype("<" + row["voxel_type"]).tobytes()


def write_png(row: dict) -> bytes:
    """A grey image of 8 bits of the first plane, scaled so that its range fills a byte."""
    nx, ny = row["nx"], row["ny"]
    p = np.asarray(row["pixels"], float)[: nx * ny].reshape(ny, nx)
    span = p.max() - p.min()
    grey = np.floor((p - p.min()) * (255 / span if span else 0) + 0.5).astype("u1")
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    lines = np.hstack([np.zeros((ny, 1), "u1"), grey]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", nx, ny, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> dict:
    """Grey images of 8 bits without filters or interlace, as written here."""
    at, body, size = 8, b"", (1, 1)
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        name, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if name == b"IHDR":
            size = struct.unpack(">2I", part[:8])
        elif name == b"IDAT":
            body += part
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(body), "u1").reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines aren't supported")
    return image(size, (1, 1), "u1", lines[:, 1:])


#: Writers by the end of a file's name; any other name is written as GIPL.
WRITERS = {".png": write_png, ".gipl": write_gipl, ".vtk": write_vtk, ".pgm": write_pgm, ".hdr": write_analyze, ".nii": write_nifti}


def writer_of(path: str):
    """The writer for a file name; a later one of WRITERS wins where the name holds several."""
    return next((w for k, w in reversed(WRITERS.items()) if k in path), write_gipl)


def dispatched(images: DataFrame) -> DataFrame:
    """path and content of each image (path and image columns), by the name of its file; .gz names are compressed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [writer_of(r["path"])(r) for r in f.to_dict("records")]
            yield pd.DataFrame({"path": f["path"], "content": [gzip.compress(m, mtime=0) if p.endswith(".gz") else m for p, m in zip(f["path"], made)]})

    return images.mapInPandas(run, "path string, content binary")


def decoded(files: DataFrame) -> DataFrame:
    """Images of path and content."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([{"path": p} | decode(bytes(c)) for p, c in zip(f["path"], f["content"])], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.mapInPandas(run, SCHEMA)


def typed(images: DataFrame, kind: str) -> DataFrame:
    """Pixels as a voxel type would hold them: whole numbers are rounded and held to the type's range."""
    if np.dtype(kind).kind == "f":
        made = F.transform("pixels", lambda p: p.cast("float").cast("double")) if kind == "f4" else F.col("pixels")
    else:
        low, high = np.iinfo(kind).min, np.iinfo(kind).max
        made = F.transform("pixels", lambda p: F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.round(p))))
    return images.withColumn("pixels", made).withColumn("voxel_type", F.lit(kind))


def write_affine_dof(row: dict) -> bytes:
    names = ("tx", "ty", "tz", "rx", "ry", "rz", "sx", "sy", "sz", "sxy", "syz", "sxz")
    return struct.pack(">3I12d", DOF_MAGIC, DOF_AFFINE, 12, *[row[k] for k in names])


def read_ascii_dof(text: str) -> dict:
    """`DOF: n` and a line a parameter, its value last."""
    names = ("tx", "ty", "tz", "rx", "ry", "rz", "sx", "sy", "sz", "sxy", "syz", "sxz")
    lines = [x for x in text.splitlines() if x.strip()]
    count = int(lines[0].split(":")[1])
    values = [float(x.split()[-1]) for x in lines[1 : 1 + count]]
    return {"dof_type": DOF_RIGID if count == 6 else DOF_AFFINE} | dict(zip(names, values))


def write_histogram(bins: int, low: float, high: float, counts) -> str:
    """Number of bins, samples and range in a line, then a line a bin."""
    return f"{bins} {float(sum(counts))!r} {low!r} {high!r}\n" + "\n".join(repr(float(c)) for c in counts) + "\n"


def read_histogram(text: str) -> tuple[int, float, float, list[float]]:
    head, *rest = text.split("\n")
    n, _, low, high = head.split()
    return int(n), float(low), float(high), [float(x) for x in rest[: int(n)]]


def write_matrix(m: np.ndarray) -> bytes:
    """A line of ASCII with the size, then big-endian doubles by column."""
    return f"matrix: {m.shape[0]} x {m.shape[1]}\n".encode() + np.asfortranarray(m).astype(">f8").tobytes(order="F")


def read_matrix(data: bytes) -> np.ndarray:
    head, _, body = data.partition(b"\n")
    rows, _, cols = head.split()[1:4]
    return np.frombuffer(body, ">f8").reshape(int(cols), int(rows)).T


def write_points(points: np.ndarray) -> str:
    """A count, then a point a line; as VTK poly data where a reader asks for it."""
    return "# vtk DataFile Version 3.0\npoints\nASCII\nDATASET POLYDATA\n" + f"POINTS {len(points)} double\n" + "\n".join(" ".join(repr(float(v)) for v in p) for p in points) + "\n"


def read_points(text: str) -> np.ndarray:
    lines = text.split("\n")
    at = next(i for i, x in enumerate(lines) if x.startswith("POINTS"))
    n = int(lines[at].split()[1])
    return np.array([[float(v) for v in x.split()] for x in lines[at + 1 : at + 1 + n]]).reshape(n, 3)
