"""Decoding of frames as they come, in two phases: from the beginning until enough frames tell how many samples a frame has, then
the new frames with a context before them. Over a finished table by windows, over a stream by keyed state; both give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Frames before the new ones that are decoded with them, and that calibration waits for.
CONTEXT = 25
_OUT = "chunk long, phase int, n_context int, n_new int, audio array<double>"


def decode_chunks(frames: DataFrame, key: str, order: str, size: int, decode: Callable[[Column], Column], context: int = CONTEXT) -> DataFrame:
    """(key, chunk, phase, n_context, n_new, audio) of chunks of ``size`` frames (key, order, code), the last maybe smaller;
    ``decode`` makes samples of an array of codes.

    A chunk decodes all frames so far (phase 1) until a chunk's end has at least max(context, size) of them, later ones the new
    frames and ``context`` before them (phase 2), of whose samples those of the context are cut by the samples a frame had.
    """
    w = Window.partitionBy(key).orderBy(order)
    at = F.row_number().over(w) - 1
    known = max(context, size)
    rows = frames.select(key, order, at.alias("_at"), F.floor(at / size).cast("long").alias("chunk"), (F.lead(order).over(w).isNull() | (at % size == size - 1)).alias("_ends"),
                         F.collect_list("code").over(w.rowsBetween(-(known + size + context), 0)).alias("_codes")).where("_ends")
    passed = F.col("chunk") * size
    n_new, phase = (F.col("_at") + 1 - passed).cast("int"), F.when(passed >= known, 2).otherwise(1)
    rows = rows.withColumn("n_new", n_new).withColumn("phase", phase).withColumn("n_context", F.when(phase == 1, 0).otherwise(F.least(F.lit(context), passed)).cast("int"))
    wanted = F.when(F.col("phase") == 1, F.col("_at") + 1).otherwise(F.col("n_context") + F.col("n_new")).cast("int")
    heard = rows.withColumn("_audio", decode(F.slice("_codes", F.size("_codes") - wanted + 1, wanted)))
    by_chunk = Window.partitionBy(key).orderBy("chunk")
    per_frame = F.last(F.when(F.col("phase") == 1, F.size("_audio") / (F.col("_at") + 1)), True).over(by_chunk)
    cut = F.when(F.col("phase") == 1, F.coalesce(F.lag(F.size("_audio")).over(by_chunk), F.lit(0))).otherwise(F.bround(F.col("n_context") * per_frame)).cast("int")
    return heard.withColumn("_cut", cut).select(key, "chunk", "phase", "n_context", "n_new", F.slice("_audio", F.col("_cut") + 1, F.greatest(F.size("_audio") - F.col("_cut"), F.lit(0))).alias("audio"))


class _Decoder(StatefulProcessor):
    """State of a key: the frames that the next chunk may need, frames and samples so far, samples a frame once they are known."""

    def __init__(self, key: str, order: str, size: int, decode: Callable[[np.ndarray], np.ndarray], context: int) -> None:
        self.key, self.order, self.size, self.decode, self.context = key, order, size, decode, context

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.codes = handle.getListState("codes", "code double")
        self.counts = handle.getValueState("counts", "frames long, samples long, per_frame double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        n, samples, per_frame = self.counts.get() if self.counts.exists() else (0, 0, None)
        held = [c[0] for c in self.codes.get()] if self.codes.exists() else []
        fresh = pd.concat(list(rows)).sort_values(self.order)["code"].astype(float).tolist()
        codes, made = held + fresh, []
        chunk = n // self.size
        at = len(held) - n % self.size if n % self.size else len(held)  # where the open chunk begins in ``codes``
        while len(codes) - at >= self.size:
            end = at + self.size
            total = (chunk + 1) * self.size
            if per_frame is None:
                audio = np.asarray(self.decode(np.array(codes[:end])), float)
                made.append((key[0], chunk, 1, 0, self.size, audio[samples:]))
                samples = len(audio)
                if total >= max(self.context, self.size):
                    per_frame = samples / total
            else:
                n_context = min(self.context, chunk * self.size)
                audio = np.asarray(self.decode(np.array(codes[at - n_context : end])), float)
                made.append((key[0], chunk, 2, n_context, self.size, audio[round(n_context * per_frame) :]))
            chunk, at = chunk + 1, end
        n += len(fresh)
        if per_frame is not None:
            codes = codes[max(0, at - self.context) :]
        self.codes.put([(c,) for c in codes])
        self.counts.update((n, samples, per_frame))
        if made:
            yield pd.DataFrame({name: [m[i] for m in made] for i, name in enumerate([self.key, "chunk", "phase", "n_context", "n_new", "audio"])})

    def close(self) -> None:
        pass


def stream_decode_chunks(frames: DataFrame, key: str, order: str, size: int, decode: Callable[[np.ndarray], np.ndarray], context: int = CONTEXT) -> DataFrame:
    """``decode_chunks`` of a stream, a row as each chunk of ``size`` frames fills up; ``decode`` takes and gives numpy arrays. State
    that survives a restart is in the query's checkpoint; the session's state store is to be RocksDB."""
    kind = frames.schema[key].dataType.simpleString()
    return frames.groupBy(key).transformWithStateInPandas(_Decoder(key, order, size, decode, context), f"{key} {kind}, {_OUT}", "Append", "None")
