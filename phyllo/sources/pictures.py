"""Pictures of a folder as rows of decoded pixels, and back.

Read are PNG (8 bits, not interlaced: grey, RGB, palette, with or without an
alpha channel, which is dropped) and binary PGM and PPM. Spark reads the files,
so any store that it knows will do; one picture is one row.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Signature and colour types (type: channels) of the format.
PNG = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


class PictureError(ValueError):
    """A file that is none of the formats read."""


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes from filtered rows, each of which begins with its filter's number."""
    out = np.zeros((len(raw), raw.shape[1] - 1), np.uint8)
    above = np.zeros(raw.shape[1] - 1, np.uint8)
    for y, line in enumerate(raw):
        kind, row = line[0], line[1:]
        if kind == 1:  # each byte counts from the one before
            row = np.add.accumulate(row.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            row = row + above
        elif kind in (3, 4):
            done, over = [0] * step + [0] * len(row), [0] * step + above.tolist()
            for i, value in enumerate(row.tolist(), step):
                left, up, corner = done[i - step], over[i], over[i - step]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    guess = min((left, up, corner), key=lambda v, at=left + up - corner: abs(at - v))
                done[i] = (value + guess) & 255
            row = np.array(done[step:], np.uint8)
        elif kind:
            raise PictureError(f"filter {kind} of row {y}")
        out[y] = above = row
    return out


def _png(data: bytes) -> np.ndarray:
    at, body, head, palette = len(PNG), [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            break
        at += size + 12
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise PictureError("this kind of PNG is not read")
    width, height, step = head[0], head[1], CHANNELS[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * step)
    pixels = _unfiltered(raw, step).reshape(height, width, step)
    if head[3] == 3:
        return palette[pixels[:, :, 0]]
    return pixels[:, :, : step - (step in (2, 4))]


def decode(data: bytes) -> np.ndarray:
    """(height, width, channels) of a PNG, PGM or PPM file."""
    if data.startswith(PNG):
        return _png(data)
    head = re.match(rb"P([56])(?:\s+#[^\n]*)*\s+(\d+)(?:\s+#[^\n]*)*\s+(\d+)(?:\s+#[^\n]*)*\s+(\d+)\s", data)
    if not head or int(head[4]) > 255:
        raise PictureError("no PNG, PGM or PPM")
    width, height, step = int(head[2]), int(head[3]), 3 if head[1] == b"6" else 1
    if len(data) < head.end() + width * height * step:
        raise PictureError("the picture is cut off")
    return np.frombuffer(data, np.uint8, width * height * step, head.end()).reshape(height, width, step)


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG of grey or RGB pixels."""
    height, width, step = pixels.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, width * step)], axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[step], 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def read_pictures(spark: SparkSession, folder: str, pattern: str = "*.{png,pgm,ppm}") -> DataFrame:
    """``(name, height, width, pixels)`` of the pictures below a folder; ``name`` is the file's, without its ending."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    files = files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("name"), "content")

    def run(batches):
        for pdf in batches:
            shown = [decode(c) for c in pdf["content"]]
            yield pd.DataFrame({"name": pdf["name"], "height": [p.shape[0] for p in shown], "width": [p.shape[1] for p in shown], "pixels": [p.tobytes() for p in shown]})

    return files.mapInPandas(run, "name string, height int, width int, pixels binary")


def write_pictures(images: DataFrame, folder: str) -> int:
    """``<name>.png`` of every row ``(name, height, width, pixels)``, written by the tasks; how many."""

    def run(batches):
        from phyllo.sources.stores import write_whole

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                write_whole(f"{folder.rstrip('/')}/{r.name}.png", encode_png(np.frombuffer(r.pixels, np.uint8).reshape(int(r.height), int(r.width), -1)))
            yield pd.DataFrame({"n": [len(pdf)]})

    return images.select("name", "height", "width", "pixels").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
