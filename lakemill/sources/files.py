"""Tables, play lists, images and projects as DataFrames; run tables and nested documents as files."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed schema of a run table.
RUNS = "image string, line int, start int, length int"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def play_list(parts: list[tuple[DataFrame, str, list[int] | None]], page: str) -> DataFrame:
    """Excerpts of several inputs in order: (input, name, pages or None for all) as one table with part and name."""
    out = None
    for k, (df, name, pages) in enumerate(parts):
        own = (df if pages is None else df.where(F.col(page).isin(pages))).withColumn("part", F.lit(k)).withColumn("name", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def images(spark: SparkSession, path: str) -> DataFrame:
    """Pixels (image, x, y, v) of PNG (8-bit gray or RGB, not interlaced) and binary PGM files; other files raise an error."""

    def decode(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                m = read_image(bytes(content))
                ys, xs = np.indices(m.shape)
                yield pd.DataFrame({"image": name, "x": xs.ravel(), "y": ys.ravel(), "v": m.ravel().astype(np.int16)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "image string, x int, y int, v short")


def read_image(data: bytes) -> np.ndarray:
    if data[:2] == b"P5":
        head, rest = [], data[2:]
        while len(head) < 3:
            rest = rest.lstrip()
            if rest[:1] == b"#":
                rest = rest[rest.index(b"\n") + 1 :]
                continue
            n = next(i for i in range(len(rest)) if rest[i : i + 1].isspace())
            head.append(int(rest[:n]))
            rest = rest[n:]
        return np.frombuffer(rest[1 : 1 + head[0] * head[1]], dtype=np.uint8).reshape(head[1], head[0])
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("neither PNG nor PGM")
    at, body, w = 8, b"", 0
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunk)
            if depth != 8 or colour not in (0, 2) or interlaced:
                raise ValueError("only 8-bit gray or RGB PNG without interlacing is read")
        elif kind == b"IDAT":
            body += chunk
        at += 12 + size
    step = 1 if colour == 0 else 3
    raw = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h + 1, (w + 1) * step), dtype=np.int64)
    for y in range(h):
        f, line, up, own = raw[y, 0], raw[y, 1:].astype(np.int64), out[y], out[y + 1]
        for i in range(w * step):
            a, b, c = own[i], up[i + step], up[i]
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            own[i + step] = (line[i] + (0, a, b, (a + b) // 2, nearest)[f]) & 255
    pixels = out[1:, step:].reshape(h, w, step).astype(float)
    return (pixels[:, :, 0] if step == 1 else pixels @ [0.299, 0.587, 0.114]).round().astype(np.uint8)


def write_runs(runs: DataFrame, path: str) -> None:
    runs.select("image", "line", "start", "length").write.mode("overwrite").partitionBy("image").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(path)


def nested(df: DataFrame, keys: list[str], order: list[str], fields: list[str], name: str) -> DataFrame:
    """One document for each key: its rows as a sorted array of structs. The way up from notes to measures, parts and scores."""
    packed = F.sort_array(F.collect_list(F.struct(*order, *[c for c in fields if c not in order])))
    return df.groupBy(*keys).agg(F.transform(packed, lambda s: F.struct(*[s[c].alias(c) for c in fields])).alias(name))


def write_documents(df: DataFrame, path: str, by: str, form: str = "json") -> None:
    """A folder for each value of by: JSON lines, or XML where rowTag names the element."""
    writer = df.write.mode("overwrite").partitionBy(by)
    writer.format("xml").option("rowTag", "document").save(path) if form == "xml" else writer.json(path)
