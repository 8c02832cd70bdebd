"""RIFF/WAVE files as rows: ``binaryFile`` rows are parsed, sample arrays are written, both as vectorised functions."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ColumnOrName = Column | str
PCM, IEEE_FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
HEADER = "format int, channels int, sample_rate int, bit_depth int, samples array<double>, error string"


def parse(content: bytes) -> tuple:
    """Format, channels, rate, depth, samples (channels one after another for each frame) and error of one file.

    Chunks other than ``fmt `` and ``data`` are skipped, with the byte that fills one of odd size. 8-bit samples are
    unsigned, 24-bit ones are moved to the top of 32 bits.
    """
    try:
        order = {b"RIFF": "<", b"RIFX": ">"}[content[:4]]
        if content[8:12] != b"WAVE":
            raise ValueError("not a WAVE file")
        at, known, data = 12, None, None
        while at + 8 <= len(content):
            name, size = content[at : at + 4], struct.unpack(f"{order}I", content[at + 4 : at + 8])[0]
            body = content[at + 8 : at + 8 + size]
            if name == b"fmt ":
                kind, channels, rate, _, _, depth = struct.unpack(f"{order}HHIIHH", body[:16])
                if kind == EXTENSIBLE and size >= 40:
                    kind = struct.unpack(f"{order}H", body[24:26])[0]
                known = kind, channels, rate, depth
            elif name == b"data":
                data = body
            at += 8 + size + size % 2
        if known is None or data is None:
            raise ValueError("no fmt or no data chunk")
        return (*known, samples(data, known[0], known[3], order).tolist(), None)
    except (KeyError, ValueError, struct.error) as e:
        return None, None, None, None, None, f"bad file: {e}"


def samples(data: bytes, kind: int, depth: int, order: str) -> np.ndarray:
    if kind == PCM and depth == 24:
        whole = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3)
        wide = np.zeros((len(whole), 4), np.uint8)
        wide[:, slice(1, 4) if order == "<" else slice(0, 3)] = whole
        return wide.view(f"{order}i4").ravel()
    types = {(PCM, 8): "u1", (PCM, 16): f"{order}i2", (PCM, 32): f"{order}i4", (IEEE_FLOAT, 32): f"{order}f4", (IEEE_FLOAT, 64): f"{order}f8"}
    if (kind, depth) not in types:
        raise ValueError(f"format {kind} of {depth} bits")
    dtype = np.dtype(types[kind, depth])
    return np.frombuffer(data[: len(data) // dtype.itemsize * dtype.itemsize], dtype)


def build(values: np.ndarray, rate: int, channels: int = 1) -> bytes:
    """A file of an array of unsigned 8-bit, 16- or 32-bit whole or 32- or 64-bit floating samples."""
    values = np.ascontiguousarray(values, values.dtype.newbyteorder("<"))
    if values.dtype.kind == "u" and values.dtype.itemsize > 1 or values.dtype.kind not in "uif":
        raise ValueError(f"samples of type {values.dtype}")
    kind, width = IEEE_FLOAT if values.dtype.kind == "f" else PCM, values.dtype.itemsize
    fmt = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * width, channels * width, 8 * width) + (b"\0\0" if kind == IEEE_FLOAT else b"")
    chunks = [(b"fmt ", fmt), *([(b"fact", struct.pack("<I", values.size // channels))] if kind == IEEE_FLOAT else []), (b"data", values.tobytes())]
    body = b"WAVE" + b"".join(n + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for n, b in chunks)
    if len(body) > 0xFFFFFFFF:
        raise ValueError("larger than 4 GiB")
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _parse(content: pd.Series) -> pd.DataFrame:
    names = [c.split()[0] for c in HEADER.split(", ")]
    return pd.DataFrame([parse(bytes(c)) if c is not None else (None,) * 5 + ("no content",) for c in content], columns=names)


def _build(values: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series([build(np.array(v, np.int16), int(r)) if v is not None else None for v, r in zip(values, rate, strict=True)])


def parse_wav(content: ColumnOrName) -> Column:
    """Struct of a file's header, samples and error."""
    return F.pandas_udf(_parse, HEADER)(content)


def build_wav(values: ColumnOrName, rate: ColumnOrName) -> Column:
    """A mono file of 16-bit samples."""
    return F.pandas_udf(_build, "binary")(values, rate)


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, channels, sample_rate, bit_depth, samples, error) of the files under a path."""
    return spark.read.format("binaryFile").load(path).select("path", parse_wav("content").alias("w")).select("path", "w.*")
