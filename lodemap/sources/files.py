"""Files with one frame or chunk each: scans, labels, features, clouds and named arrays, written by tasks and read by Spark."""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemap.operators.sets import dense_ids
from lodemap.operators.stages import shared_folder


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder name under the shared one, which goes when the session ends."""
    path = f"{shared_folder(spark).rstrip('/')}/lodemap-{what}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def write_files(df: DataFrame, folder: str, by: str, encode: Callable[[pd.DataFrame], bytes], name: str, order: str = "point_id") -> int:
    """Writes a file for each value of ``by``, its rows in order, and returns their number. ``name`` is formatted with the
    value. A file appears under its name when it is whole, so a task that runs again writes it again."""

    def write(group: pd.DataFrame) -> pd.DataFrame:
        uri = f"{folder}/{name.format(group[by].iloc[0])}"
        where, path = fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)
        where.create_dir(path.rpartition("/")[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with where.open_output_stream(part) as out:
            out.write(encode(group.sort_values(order)))
        where.move(part, path)
        return pd.DataFrame({"path": [uri]})

    return df.groupBy(by).applyInPandas(write, "path string").count()


def stacked(columns: tuple[str, ...], kind: str) -> Callable[[pd.DataFrame], bytes]:
    """The columns side by side, a row after the other."""
    return lambda rows: rows[list(columns)].to_numpy(kind).tobytes()


def compressed(column: str, kind: str = "<f4") -> Callable[[pd.DataFrame], bytes]:
    """An array column, compressed by zlib."""
    return lambda rows: zlib.compress(np.stack(rows[column].to_list()).astype(kind).tobytes())


def arrays(columns: tuple[str, ...]) -> Callable[[pd.DataFrame], bytes]:
    """Each column as a named array of an NPZ file."""

    def encode(rows: pd.DataFrame) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **{c: np.stack(rows[c].to_list()) for c in columns})
        return out.getvalue()

    return encode


def pcd(rows: pd.DataFrame) -> bytes:
    """A binary point cloud file of x, y and z."""
    n = len(rows)
    head = f"""# .PCD v0.7
VERSION 0.7
FIELDS x y z
SIZE 4 4 4
TYPE F F F
COUNT 1 1 1
WIDTH {n}
HEIGHT 1
VIEWPOINT 0 0 0 1 0 0 0
POINTS {n}
DATA binary
"""
    return head.encode() + rows[["x", "y", "z"]].to_numpy("<f4").tobytes()


def parse_pcd(content: bytes) -> np.ndarray:
    """x, y and z of an uncompressed point cloud file, binary or text, whatever other fields it has."""
    head, start = {}, 0
    while "DATA" not in head:
        end = content.index(b"\n", start)
        key, _, rest = content[start:end].decode().strip().partition(" ")
        head[key] = rest.split()
        start = end + 1
    counts = [int(c) for c in head.get("COUNT", ["1"] * len(head["FIELDS"]))]
    if head["DATA"] == ["ascii"]:
        at = {f: sum(counts[:i]) for i, f in enumerate(head["FIELDS"])}
        rows = [line.split() for line in content[start:].decode().splitlines() if line.strip()]
        return np.array([[float(r[at[a]]) for a in "xyz"] for r in rows], float).reshape(-1, 3)
    if head["DATA"] != ["binary"]:
        raise ValueError(f"point cloud data of kind {head['DATA']} isn't read")
    kinds = zip(head["FIELDS"], head["TYPE"], head["SIZE"], counts, strict=True)
    # fields may repeat a name (padding), so they are numbered
    record = np.dtype([(f"{f}" if f in "xyz" else f"{f}{i}", f"<{t.lower()}{s}", (c,) if c > 1 else ()) for i, (f, t, s, c) in enumerate(kinds)])
    points = np.frombuffer(content, record, int(head["POINTS"][0]), start)
    return np.stack([points[a].astype(float) for a in "xyz"], 1)


def _contents(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")


def clouds(spark: SparkSession, path: str, pattern: str = "*.pcd") -> DataFrame:
    """name, point_id, x, y, z of point cloud files."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["name"], part["content"], strict=True):
                rows = parse_pcd(content)
                yield pd.DataFrame({"name": name, "point_id": np.arange(len(rows))} | {a: rows[:, i] for i, a in enumerate("xyz")})

    return _contents(spark, path, pattern).mapInPandas(parse, "name string, point_id long, x double, y double, z double")


def named_arrays(spark: SparkSession, path: str, pattern: str = "*.npz") -> DataFrame:
    """name, array, row, values: a row for each first index of the numeric arrays of NPZ files; deeper ones are flattened."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["name"], part["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as found:
                    for key in found.files:
                        values = np.atleast_1d(found[key]).astype(float)
                        values = values.reshape(len(values), -1)
                        yield pd.DataFrame({"name": name, "array": key, "row": np.arange(len(values)), "values": list(values)})

    return _contents(spark, path, pattern).mapInPandas(parse, "name string, array string, row long, values array<double>")


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """token and its place from 0 in a text file with one a line, blank lines left out; a list of samples is one short file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "token"))
    return dense_ids(lines.select("line", F.trim("token").alias("token")).where("token <> ''"), "line", "place").select("place", "token")


def in_file_order(names: DataFrame, name: str = "name") -> DataFrame:
    """The rows with ``place``: the number of their file, from 0, in the order of names, in which folds take files."""
    return dense_ids(names, name, "place")
