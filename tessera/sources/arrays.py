"""Sources and sinks: .npy and .npz files, text tables, raw binary.

Files are read through Spark (``binaryFile`` and ``text``), so any store will
do; large arrays are best kept as Parquet in coordinate form.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.grid import Grid, from_flat, ravel_multi_index

PIECE = 1 << 16  # elements that a task packs, and the driver writes, at once
NUMPY = {"boolean": bool, "tinyint": int, "smallint": int, "int": int, "bigint": int, "float": float, "double": float}


def npy_bytes(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


def npy_header(f) -> tuple[np.dtype, tuple[int, ...], bool]:
    """(dtype, shape, Fortran order) of an open file, which then stands at its elements."""
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = read(f)
    return kind, shape, fortran


def _spark_type(kind: np.dtype) -> str:
    return {"b": "boolean", "i": "bigint", "u": "bigint", "f": "double", "c": "struct<re:double,im:double>", "U": "string", "S": "string"}[kind.kind]


def _value(x):
    return {"re": x.real, "im": x.imag} if isinstance(x, complex | np.complexfloating) else x


def _binary(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """``path, content`` of files; content is NULL where tasks open the path themselves, so
    that no row holds a whole file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(path)
    first = files.select("path").first()
    mounted = first is not None and first["path"].startswith("file:")
    return files.select("path", F.lit(None).cast("binary").alias("content") if mounted else F.col("content"))


def _open(path: str, content: bytes | None):
    return open(path.removeprefix("file:"), "rb") if content is None else io.BytesIO(content)


def _raw(f, kind: np.dtype) -> Iterator[pd.DataFrame]:
    """``i, v`` of the elements that follow in an open file, ``PIECE`` at a time."""
    at = 0
    while part := f.read(PIECE * kind.itemsize):
        flat = np.frombuffer(part, kind)
        yield pd.DataFrame({"i": np.arange(at, at + len(flat)), "v": [_value(x) for x in flat] if kind.kind == "c" else flat})
        at += len(flat)


def _npy(f) -> Iterator[pd.DataFrame]:
    """``i, v`` of an open .npy file; only one in Fortran order is read as a whole."""
    kind, shape, fortran = npy_header(f)
    if kind.hasobject:
        raise ValueError("an .npy file of objects")
    if fortran:
        f = io.BytesIO(np.frombuffer(f.read(), kind).reshape(shape, order="F").tobytes())
    return _raw(f, kind)


def load(spark: SparkSession, path: str) -> Grid:
    """An .npy file as a Grid; the header is read by the driver, the elements by a task."""
    files = _binary(spark, path)

    def head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, content in zip(pdf["path"], pdf["content"], strict=True):
                with _open(at, content) as f:
                    yield pd.DataFrame({"head": [f.read(4096)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, content in zip(pdf["path"], pdf["content"], strict=True):
                with _open(at, content) as f:
                    yield from _npy(f)

    kind, shape, _ = npy_header(io.BytesIO(files.mapInPandas(head, "head binary").first()[0]))
    return from_flat(spark, files.mapInPandas(run, f"i bigint, v {_spark_type(kind)}"), shape)


def _pieces(g: Grid) -> Iterator[bytes]:
    """The bytes of the array in C order, ``PIECE`` elements at a time; the driver holds
    those of one partition, some 16 pieces, at once.  Cells that g lacks are 0, masked
    doubles NaN; other masked cells and places outside the shape raise."""
    kind, size = np.dtype(NUMPY[g.dtype]), g.size
    inside = reduce(lambda a, b: a & b, [(i >= 0) & (i < n) for i, n in zip(g.index, g.shape, strict=True)], F.lit(True))
    place = F.when(inside, ravel_multi_index(g.index, g.shape)).otherwise(F.raise_error(F.lit(f"a place outside {g.shape}")))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        k = int(rows["piece"].iloc[0])
        if kind.kind != "f" and rows["v"].isna().any():
            raise ValueError(f"masked cells have no {kind} value")
        out = np.zeros(min(PIECE, size - k * PIECE), kind)
        out[rows["i"].to_numpy() - k * PIECE] = rows["v"].to_numpy()
        return pd.DataFrame({"piece": [k], "content": [out.tobytes()]})

    n = -(-size // PIECE)
    flat = g.df.select(place.alias("i"), "v").withColumn("piece", F.floor(F.col("i") / PIECE).cast("bigint"))
    packed = flat.groupBy("piece").applyInPandas(pack, "piece bigint, content binary")
    at = 0
    for row in packed.repartitionByRange(max(1, n // 16), "piece").sortWithinPartitions("piece").toLocalIterator():
        yield from (bytes(PIECE * kind.itemsize) for _ in range(at, row["piece"]))
        yield bytes(row["content"])
        at = row["piece"] + 1
    yield from (bytes(min(PIECE, size - k * PIECE) * kind.itemsize) for k in range(at, n))


def _write_npy(g: Grid, f) -> None:
    if g.dtype not in NUMPY:
        raise ValueError(f"an .npy file of {g.dtype}")
    np.lib.format.write_array_header_1_0(f, {"descr": np.lib.format.dtype_to_descr(np.dtype(NUMPY[g.dtype])), "fortran_order": False, "shape": g.shape})
    for piece in _pieces(g):
        f.write(piece)


def save(g: Grid, path: str) -> None:
    """One .npy file; the array passes through the driver piece by piece, as the format wants one file."""
    with open(path, "wb") as f:
        _write_npy(g, f)


def savez(path: str, **grids: Grid) -> None:
    with zipfile.ZipFile(path, "w") as z:
        for n, g in grids.items():
            with z.open(f"{n}.npy", "w", force_zip64=True) as f:
                _write_npy(g, f)


savez_compressed = savez


def load_npz(spark: SparkSession, path: str) -> dict[str, Grid]:
    """All arrays of an .npz archive; the driver gets their headers, tasks the elements."""
    files = _binary(spark, path)

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, content in zip(pdf["path"], pdf["content"], strict=True):
                with _open(at, content) as whole, zipfile.ZipFile(whole) as z:
                    for n in z.namelist():
                        with z.open(n) as f:
                            yield pd.DataFrame({"name": [n.removesuffix(".npy")], "head": [f.read(4096)]})

    def one(name: str, kind: np.dtype, shape: tuple[int, ...]) -> Grid:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at, content in zip(pdf["path"], pdf["content"], strict=True):
                    with _open(at, content) as whole, zipfile.ZipFile(whole) as z, z.open(f"{name}.npy") as f:
                        yield from _npy(f)

        return from_flat(spark, files.mapInPandas(run, f"i bigint, v {_spark_type(kind)}"), shape)

    found = files.mapInPandas(heads, "name string, head binary").collect()
    return {r["name"]: one(r["name"], *npy_header(io.BytesIO(r["head"]))[:2]) for r in found}


def load_many(spark: SparkSession, pattern: str) -> DataFrame:
    """``path, i, v`` (doubles) of all .npy files under a path: a task per file."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with _open(path, content) as f:
                    for part in _npy(f):
                        yield pd.DataFrame({"path": path, "i": part["i"], "v": part["v"].astype(float)})

    return _binary(spark, pattern, "*.npy").mapInPandas(run, "path string, i bigint, v double")


def fromfile(spark: SparkSession, path: str, dtype: str = "float64") -> Grid:
    """Raw elements of one type."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] // np.dtype(dtype).itemsize

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, content in zip(pdf["path"], pdf["content"], strict=True):
                with _open(at, content) as f:
                    yield from _raw(f, np.dtype(dtype))

    return from_flat(spark, _binary(spark, path).mapInPandas(run, f"i bigint, v {_spark_type(np.dtype(dtype))}"), (size,))


def tofile(g: Grid, path: str) -> None:
    """Raw elements in C order, passed through the driver piece by piece."""
    if g.dtype not in NUMPY:
        raise ValueError(f"raw elements of {g.dtype}")
    with open(path, "wb") as f:
        for piece in _pieces(g):
            f.write(piece)


def _rows(spark: SparkSession, path: str, delimiter: str | None, comments: str) -> DataFrame:
    """Lines of a file, or of a folder's files by name, in order: ``i0`` counts lines that
    hold something.  Spark deals out large files first, so places alone don't give the order."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select(place.alias("_at"), "value")
    body = F.btrim(F.split("value", re.escape(comments), 2)[0], F.lit(" \t\r"))
    kept = lines.select("_at", body.alias("line")).filter("line <> ''")
    from tessera.operators.ordering import with_index

    numbered = with_index(kept, "_at", "i0")
    return numbered.select("i0", F.split("line", "[ \t]+" if delimiter is None else re.escape(delimiter)).alias("cells"))


def loadtxt(spark: SparkSession, path: str, delimiter: str | None = None, comments: str = "#") -> Grid:
    """Numbers in rows; comments and blank lines are skipped, ragged rows raise."""
    rows = _rows(spark, path, delimiter, comments).withColumn("cells", F.filter(F.transform("cells", lambda c: F.btrim(c)), lambda c: c != ""))
    n, lo, hi = rows.agg(F.count("*"), F.min(F.size("cells")), F.max(F.size("cells"))).first()
    if lo != hi:
        raise ValueError(f"rows of {lo} to {hi} numbers")
    return Grid(rows.select("i0", F.posexplode("cells").alias("i1", "c")).select("i0", F.col("i1").cast("bigint").alias("i1"), F.col("c").cast("double").alias("v")), (n, lo or 0))


def genfromtxt(spark: SparkSession, path: str, delimiter: str | None = None, comments: str = "#") -> Grid:
    """Like loadtxt, with NaN for what is missing or no number."""
    rows = _rows(spark, path, delimiter, comments)
    n, hi = rows.agg(F.count("*"), F.max(F.size("cells"))).first()
    cells = rows.select("i0", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit((hi or 1) - 1)), lambda k: F.get("cells", k))).alias("i1", "c"))
    return Grid(cells.select("i0", F.col("i1").cast("bigint").alias("i1"), F.coalesce(F.expr("try_cast(c AS double)"), F.lit(float("nan"))).alias("v")), (n, hi or 0))


def fromregex(spark: SparkSession, path: str, pattern: str, names: list[str], kinds: list[str]) -> DataFrame:
    """A row per line that matches, a column per group."""
    lines = spark.read.text(path).filter(F.rlike("value", F.lit(pattern)))
    return lines.select(*[F.regexp_extract("value", pattern, k + 1).cast(t).alias(n) for k, (n, t) in enumerate(zip(names, kinds, strict=True))])


def savetxt(g: Grid, path: str, delimiter: str = " ") -> None:
    """A text file per partition, rows in order."""
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i1", "v"))), lambda s: s["v"].cast("string")), delimiter)
    g.df.groupBy("i0").agg(row.alias("value")).orderBy("i0").select("value").write.text(path)


def fromstring(spark: SparkSession, text: str, sep: str = " ") -> Grid:
    parts = [float(x) for x in (text.split() if sep.strip() == "" else text.split(sep)) if x.strip()]
    from tessera.operators.grid import array

    return array(spark, np.array(parts))


def fromiter(spark: SparkSession, values) -> Grid:
    from tessera.operators.grid import array

    return array(spark, np.array(list(values)))


def frombuffer(spark: SparkSession, data: bytes, dtype: str = "float64") -> Grid:
    from tessera.operators.grid import array

    return array(spark, np.frombuffer(data, dtype))


def array_repr(g: Grid) -> str:
    return np.array_repr(g.to_numpy())


def array_str(g: Grid) -> str:
    return np.array_str(g.to_numpy())


