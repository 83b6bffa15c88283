"""Readers and writers of catalogue files: FITS tables, NumPy matrices, text and raw binary.

Files are opened by Spark (``binaryFile`` and ``text``), so they may be in any store that it
reads.  Inside the engine everything is Parquet; these formats are for exchange.
"""

from __future__ import annotations

import ast
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeflow.functions import healpix as H
from latticeflow.operators.catalog import conform

RECORD = 2880
#: NumPy types and Spark types of FITS column codes.
_FITS = {"L": ("S1", "boolean"), "B": ("u1", "short"), "I": (">i2", "short"), "J": (">i4", "int"), "K": (">i8", "long"), "E": (">f4", "float"), "D": (">f8", "double")}


def _cards(raw: bytes, at: int) -> tuple[dict[str, str], int]:
    """Keywords of one header unit, and where its data begin."""
    cards: dict[str, str] = {}
    while True:
        block = raw[at : at + RECORD]
        if len(block) < RECORD:
            raise ValueError("a header ends too soon")
        at += RECORD
        for i in range(0, RECORD, 80):
            card = block[i : i + 80].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return cards, at
            if card[8:10] == "= ":
                value = card[10:].strip()
                cards[key] = value[1 : value.index("'", 1)].rstrip() if value.startswith("'") else value.split("/")[0].strip()


def fits_layout(raw: bytes) -> tuple[np.dtype, list[tuple[str, str]], int, int]:
    """Record type, Spark columns, rows and data offset of the first binary table."""
    cards, at = _cards(raw, 0)
    size = abs(int(cards.get("BITPIX", "8"))) // 8 if int(cards.get("NAXIS", "0")) else 0
    for k in range(int(cards.get("NAXIS", "0"))):
        size *= int(cards[f"NAXIS{k + 1}"])
    at += -(-size // RECORD) * RECORD
    cards, at = _cards(raw, at)
    if not cards.get("XTENSION", "").startswith("BINTABLE"):
        raise ValueError("the first extension is no binary table")
    kinds, columns = [], []
    for k in range(1, int(cards["TFIELDS"]) + 1):
        form = cards[f"TFORM{k}"]
        repeat = int("".join(c for c in form if c.isdigit()) or 1)
        code = form.lstrip("0123456789")[0]
        name = cards.get(f"TTYPE{k}", f"col{k}").lower()
        if code == "A":
            kinds.append((name, f"S{repeat}"))
            columns.append((name, "string"))
        else:
            numpy_type, spark_type = _FITS[code]
            kinds.append((name, numpy_type) if repeat == 1 else (name, numpy_type, (repeat,)))
            columns.append((name, spark_type if repeat == 1 else f"array<{spark_type}>"))
    dtype = np.dtype(kinds)
    if dtype.itemsize != int(cards["NAXIS1"]):
        raise ValueError("rows are not as long as their columns")
    return dtype, columns, int(cards["NAXIS2"]), at


def fits(spark: SparkSession, path: str) -> DataFrame:
    """All columns, in lower case, of the first binary table of each file at ``path``."""
    files = spark.read.format("binaryFile").load(path)
    head = bytes(files.select(F.substring(F.col("content"), 1, 1 << 20).alias("c")).first()["c"])
    _, columns, _, _ = fits_layout(head)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["content"]:
                dtype, _, rows, at = fits_layout(raw)
                for s in range(0, rows, 1 << 16):
                    part = np.frombuffer(raw, dtype, min(1 << 16, rows - s), at + s * dtype.itemsize)
                    yield pd.DataFrame({n: _plain(part[n], t) for n, t in columns})

    return files.select("content").mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in columns))


def _plain(values: np.ndarray, kind: str):
    if kind == "string":
        return [v.decode("ascii", "replace").rstrip(" \0") for v in values]
    if kind == "boolean":
        return values == b"T"
    native = values.astype(values.dtype.newbyteorder("="))
    return list(native) if native.ndim > 1 else native


def fits_bytes(columns: dict[str, np.ndarray]) -> bytes:
    """A FITS file with one binary table of 64-bit columns, for small results and tests."""
    kinds = [(n, ">i8" if np.issubdtype(v.dtype, np.integer) else ">f8") for n, v in columns.items()]
    table = np.zeros(len(next(iter(columns.values()))), np.dtype(kinds))
    for n, v in columns.items():
        table[n] = v

    def unit(cards: list[tuple[str, object]]) -> bytes:
        lines = [f"{k:<8}= {("'" + v + "'") if isinstance(v, str) else ('T' if v is True else v)!s:>20}".ljust(80) for k, v in cards] + ["END".ljust(80)]
        text = "".join(lines).encode("ascii")
        return text + b" " * (-len(text) % RECORD)

    head = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", table.dtype.itemsize), ("NAXIS2", len(table)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(kinds))]
    for i, (n, t) in enumerate(kinds, 1):
        head += [(f"TTYPE{i}", n.upper()), (f"TFORM{i}", "K" if t == ">i8" else "D")]
    data = table.tobytes()
    return unit([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0)]) + unit(head) + data + b"\0" * (-len(data) % RECORD)


def npy(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of two-dimensional ``.npy`` files; columns by position."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["content"]:
                if raw[:6] != b"\x93NUMPY":
                    raise ValueError("no .npy file")
                wide = raw[6] > 1
                size = struct.unpack("<I" if wide else "<H", raw[8 : 12 if wide else 10])[0]
                at = (12 if wide else 10) + size
                head = ast.literal_eval(raw[at - size : at].decode("latin1"))
                rows, width = head["shape"]
                matrix = np.frombuffer(raw, np.dtype(head["descr"]), rows * width, at).reshape((rows, width), order="F" if head["fortran_order"] else "C")
                for s in range(0, rows, 1 << 16):
                    part = matrix[s : s + (1 << 16)].astype(float)
                    yield pd.DataFrame({c: part[:, i] for i, c in enumerate(columns)})

    return files.mapInPandas(run, ", ".join(f"`{c}` double" for c in columns))


def text_matrix(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Numbers between blanks, a row a line; what follows ``#`` is a comment."""
    line = F.trim(F.regexp_replace(F.regexp_replace("value", "#.*$", ""), r"\s+", " "))
    rows = spark.read.text(path).select(line.alias("v")).where("v <> ''").select(F.split("v", " ").alias("v"))
    return rows.select(*(F.col("v")[i].cast("double").alias(c) for i, c in enumerate(columns)))


def write_text_matrix(rows: DataFrame, columns: list[str], path: str) -> None:
    """A folder of text parts that :func:`text_matrix` reads back exactly."""
    rows.select(F.concat_ws(" ", *(F.col(c).cast("double").cast("string") for c in columns)).alias("value")).write.text(path)


def write_skymap(maps: DataFrame, path: str) -> None:
    """The map that :func:`skymap` reads."""
    maps.select(F.col("pix").cast("long"), F.col("val").cast("double")).write.parquet(path)


FLAGS = ("fkp", "cp", "noz", "systot", "veto", "comp")


def positional(columns: int, position: list[int], box: bool, flags: dict[str, bool]) -> list[str]:
    """Names of matrix columns: positions where they are said to be, then the weights that are flagged, in order."""
    names = [f"c{i}" for i in range(columns)]
    for at, name in zip(position, ("x", "y", "z") if box else ("ra", "dec", "redshift")):
        names[at] = name
    at = max(position) + 1
    for flag in FLAGS:
        if flags.get(flag):
            names[at] = flag if flag in ("veto", "comp") else f"weight_{flag}"
            at += 1
    return names


def tracers(spark: SparkSession, path: str, kind: int, box: bool, columns: int = 3, position: tuple[int, ...] = (0, 1, 2), flags: dict[str, bool] | None = None, weights_model: int = 1) -> DataFrame:
    """A catalogue by file type: 1 FITS, 2 ``.npy``, 3 text; missing weights are 1."""
    if kind == 1:
        out = fits(spark, path)
    else:
        names = positional(columns, list(position), box, flags or {})
        out = (npy if kind == 2 else text_matrix)(spark, path, names)
        out = out.drop(*(n for n in names if n.startswith("c") and n[1:].isdigit()))
    if box:
        return out.withColumn("weight", F.lit(1.0))
    out = conform(out)
    return out


def special_mocks(rows: DataFrame, randoms: bool, skymap: DataFrame, nside: int) -> DataFrame:
    """Survey mocks with a mean density column and a veto column, by position; completeness from a map.

    ``rows`` has columns ``c0, c1, ...``; the FKP weight is one over a ten-thousandth times the density.
    """
    density, veto = (F.col("c3"), F.col("c5")) if randoms else (F.col("c4"), F.col("c6"))
    out = rows.select(F.col("c0").alias("ra"), F.col("c1").alias("dec"), F.col("c2").alias("redshift"), (1.0 / (10000.0 * density)).alias("weight_fkp"), veto.alias("veto"))
    pix = H.pixel_of(F.col("ra"), F.col("dec"), nside)
    comp = skymap.select(F.col("pix").alias("__p"), F.col("val").alias("comp"))
    return conform(out.withColumn("__p", pix).join(comp, "__p", "left").drop("__p").withColumn("comp", F.coalesce("comp", F.lit(0.0))))


def positions_file(rows: DataFrame, axes: list[str], path: str, order: str = "id") -> None:
    """A count and then one block of 64-bit numbers a column, as one local file; columns stream one after another."""
    with open(path, "wb") as f:
        n = rows.count()
        f.write(struct.pack("<i", n))
        ordered = rows.select(order, *axes).orderBy(order)
        for axis in axes:
            for r in ordered.select(axis).toLocalIterator():
                f.write(struct.pack("<d", r[0]))


def blocks(spark: SparkSession, path: str, columns: list[str], scale: float = 1.0) -> DataFrame:
    """``(id, *columns)`` of files of a 32-bit count and one block of 64-bit numbers a column.

    Reads positions (three or eight columns), volumes (one) and velocities (three) alike.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["content"]:
                n = struct.unpack_from("<i", raw)[0]
                if len(raw) != 4 + 8 * n * len(columns):
                    raise ValueError(f"{n} rows do not fill the file")
                for s in range(0, n, 1 << 20):
                    m = min(1 << 20, n - s)
                    yield pd.DataFrame({"id": np.arange(s, s + m)} | {c: np.frombuffer(raw, "<f8", m, 4 + 8 * (i * n + s)) * scale for i, c in enumerate(columns)})

    return files.mapInPandas(run, "id long, " + ", ".join(f"`{c}` double" for c in columns))


def adjacency(spark: SparkSession, path: str) -> DataFrame:
    """Symmetric ``(src, dst)`` of a file that has each edge once, with the smaller id.

    Layout: particles, neighbours of each, then per particle the number and ids of its
    larger neighbours.  The counts are checked.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["content"]:
                data = np.frombuffer(raw, "<i4")
                n = int(data[0])
                expected, at, src, dst = data[1 : n + 1], n + 1, [], []
                for i in range(n):
                    k = int(data[at])
                    dst.append(data[at + 1 : at + 1 + k])
                    src.append(np.full(k, i))
                    at += k + 1
                a = np.concatenate(src) if src else np.empty(0, int)
                b = np.concatenate(dst).astype(int) if dst else np.empty(0, int)
                if (np.bincount(np.concatenate([a, b]), minlength=n) != expected).any():
                    raise ValueError("an edge is missing")
                yield pd.DataFrame({"src": np.concatenate([a, b]), "dst": np.concatenate([b, a])})

    return files.mapInPandas(run, "src long, dst long")


def adjacency_bytes(n: int, edges: list[tuple[int, int]]) -> bytes:
    """The file :func:`adjacency` reads, for small graphs."""
    larger: list[list[int]] = [[] for _ in range(n)]
    count = [0] * n
    for a, b in {(min(e), max(e)) for e in edges}:
        larger[a].append(b)
        count[a] += 1
        count[b] += 1
    out = [n, *count]
    for own in larger:
        out += [len(own), *sorted(own)]
    return np.array(out, "<i4").tobytes()


def density_grid(spark: SparkSession, path: str) -> DataFrame:
    """``(vox, rho)`` of a headless file of 32-bit densities."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["content"]:
                v = np.frombuffer(raw, "<f4")
                for s in range(0, len(v), 1 << 20):
                    part = v[s : s + (1 << 20)]
                    yield pd.DataFrame({"vox": np.arange(s, s + len(part)), "rho": part.astype(float)})

    return files.mapInPandas(run, "vox long, rho double")


def selection_lines(table: DataFrame, z: str = "z", f: str = "f") -> DataFrame:
    """``(value)``: a line of redshift and selection for each row, in full precision."""
    return table.select(F.format_string("%.18e %.18e", F.col(z), F.col(f)).alias("value"))


def selection_table(lines: DataFrame) -> DataFrame:
    """``(z, f)`` of the lines of :func:`selection_lines`."""
    parts = F.split(F.trim("value"), r"\s+")
    return lines.select(parts[0].cast("double").alias("z"), parts[1].cast("double").alias("f"))


def hierarchy_lines(rows: DataFrame) -> DataFrame:
    """``(h, groups, final_ratio)`` of lines ``h {added ratio zones...} 0 ratio``, split into words."""

    def parse(words: list[str]) -> tuple[int, list[dict], float]:
        at, groups = 1, []
        while int(words[at]):
            n = int(words[at])
            groups.append({"ratio": float(words[at + 1]), "zones": [int(w) for w in words[at + 2 : at + 2 + n]]})
            at += 2 + n
        return int(words[0]), groups, float(words[at + 1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [parse(v.split()) for v in pdf["value"] if len(v.split()) > 2]
            yield pd.DataFrame({"h": [o[0] for o in out], "groups": [o[1] for o in out], "final_ratio": [o[2] for o in out]})

    return rows.select("value").mapInPandas(run, "h long, groups array<struct<ratio: double, zones: array<long>>>, final_ratio double")


def hierarchy_text(hierarchy: DataFrame) -> DataFrame:
    """The inverse of :func:`hierarchy_lines`."""
    group = F.transform("groups", lambda g: F.concat_ws(" ", F.size(g["zones"]).cast("string"), g["ratio"].cast("string"), F.array_join(F.transform(g["zones"], lambda z: z.cast("string")), " ")))
    return hierarchy.select(F.concat_ws(" ", F.col("h").cast("string"), F.array_join(group, " "), F.lit("0"), F.col("final_ratio").cast("string")).alias("line")).select(F.regexp_replace("line", " +", " ").alias("value"))


def catalogue_lines(rows: DataFrame, columns: list[str], decimals: int = 4) -> Column:
    """One line of a text catalogue: whole numbers as they are, others with fixed decimals."""
    whole = {c for c, t in rows.dtypes if t in ("int", "bigint", "smallint", "tinyint", "boolean")}
    parts = [F.col(c).cast("long").cast("string") if c in whole else F.format_string(f"%.{decimals}f", F.col(c).cast("double")) for c in columns]
    return F.concat_ws(" ", *parts)


def write_catalogue(rows: DataFrame, columns: list[str], path: str, header: str, decimals: int = 4) -> None:
    """A folder of text parts, in order, the first one headed by two comment lines."""
    lines = rows.select(catalogue_lines(rows, columns, decimals).alias("value"))
    head = rows.sparkSession.createDataFrame([(f"# {header}",), ("# " + " ".join(columns),)], "value string").coalesce(1)
    head.unionByName(lines).write.mode("overwrite").text(path)


def skymap(spark: SparkSession, path: str) -> DataFrame:
    """``(pix, val)`` of a sky map kept as Parquet."""
    return spark.read.parquet(path).select("pix", "val")


def sky_table(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """A sky map from a FITS table of values in RING order, and its resolution; rows hold one value or a run of them."""
    raw = fits(spark, path)
    name, kind = raw.dtypes[0]
    if not kind.startswith("array"):
        raise ValueError("a map without runs has no order in a distributed scan; write it in runs, or as Parquet")
    width = len(raw.first()[0])
    rows = raw.count()
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                dtype, _, n, at = fits_layout(content)
                values = np.frombuffer(content, dtype, n, at)[name].reshape(-1).astype(float)
                yield pd.DataFrame({"pix": np.arange(len(values)), "val": values})

    return files.mapInPandas(run, "pix long, val double"), math.isqrt(width * rows // 12)
