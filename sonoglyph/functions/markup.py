"""Speech markup and normal forms: what built-in expressions cannot walk or compose, as vectorised functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import groupby
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

SEGMENTS = "segments array<struct<type:string,text:string,speaker:string,duration_ms:int>>, error string"
DEFAULT_BREAK_MS = 250


def time_ms(value: str) -> int:
    v = value.strip().lower()
    for unit, factor in (("ms", 1), ("s", 1000), ("", 1)):
        if v.endswith(unit):
            return int(float(v[: len(v) - len(unit)]) * factor)
    raise ValueError(value)


class _Events:
    """What a document says, in order, as (speaker, text) and, for a break, its length. Elements come as starts and ends; a
    stack tells whose turn it is, and nothing is said within a break."""

    def __init__(self) -> None:
        self.said: list[tuple[str | None, str] | int] = []
        self.speakers: list[str | None] = []
        self.waiting, self.breaks = "", 0

    def _speak(self) -> None:
        text, self.waiting = self.waiting.strip(), ""
        if text and self.speakers and not self.breaks:
            self.said.append((self.speakers[-1], text))

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        self._speak()
        if not self.speakers and tag != "speak":
            raise ValueError(f"root element is {tag}")
        speaker = self.speakers[-1] if self.speakers else None
        if tag == "break":
            if not self.breaks:
                self.said.append(time_ms(attributes.get("time", f"{DEFAULT_BREAK_MS}ms")))
            self.breaks += 1
        self.speakers.append(tag == "voice" and attributes.get("name") or speaker)

    def end(self, tag: str) -> None:
        self._speak()
        self.speakers.pop()
        self.breaks -= tag == "break"

    def data(self, text: str) -> None:
        self.waiting += text

    def close(self) -> list[dict]:
        turns = groupby(enumerate(self.said), lambda x: x[0] if isinstance(x[1], int) else ("said", x[1][0]))
        groups = [[x for _, x in turn] for _, turn in turns]
        return [
            {"type": "break", "text": None, "speaker": None, "duration_ms": g[0]} if isinstance(g[0], int)
            else {"type": "text", "text": " ".join(t for _, t in g), "speaker": g[0][0], "duration_ms": None} for g in groups]


def parse_ssml(ssml: str | None) -> tuple[list[dict] | None, str | None]:
    """Segments, adjacent texts of one speaker joined by a space, or an error."""
    if ssml is None or not ssml.strip().startswith("<speak"):
        return None, "no <speak> element"
    parser = ElementTree.XMLParser(target=_Events())
    try:
        parser.feed(ssml.strip())
        return parser.close(), None
    except (ElementTree.ParseError, ValueError) as e:
        return None, f"bad markup: {e}"


def _segments(ssml: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_ssml(x) for x in ssml], columns=["segments", "error"])


def _code_points(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else list(unicodedata.normalize("NFD", t.casefold())))


def ssml_segments(ssml: Column | str) -> Column:
    """Struct of the segments of markup, or the error in it."""
    return F.pandas_udf(_segments, SEGMENTS)(ssml)


def folded_code_points(text: Column | str) -> Column:
    """Case-folded text in canonical decomposition, a code point an element."""
    return F.pandas_udf(_code_points, "array<string>")(text)


class _SegmentRows:
    """A row for each segment of a text of markup, or one with its error."""

    def eval(self, ssml: str) -> Iterator[tuple]:
        segments, error = parse_ssml(ssml)
        for i, s in enumerate(segments or []):
            yield i, s["type"], s["text"], s["speaker"], s["duration_ms"], None
        if error is not None:
            yield None, None, None, None, None, error


def ssml_rows(df: DataFrame, ssml: str) -> DataFrame:
    """``df`` beside (seq, type, segment, speaker, duration_ms, error) of the markup in its column ``ssml``, a table function joined
    laterally: a row for each segment, one with an error, none for markup that says nothing."""
    table = F.udtf(_SegmentRows, returnType="seq int, type string, segment string, speaker string, duration_ms int, error string", useArrow=True)
    return df.lateralJoin(table(F.col(ssml).outer()))
