"""What the engine asks of services, media tools and models, which it doesn't hold itself.

Each interface is a Protocol; the functions beside them, and the data sources in ``remote``, are the engine's part
(decisions, tables of results) and take any object that has the methods, as tests do with fakes.
"""

from __future__ import annotations

import datetime as dt
import email.utils
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- services ---------------------------------------------------------------------------------------------------------


class Pages(Protocol):
    """A paged listing; the second value is what the service says of all rows, or None."""

    def page(self, number: int) -> tuple[Sequence[dict], int | None]: ...


class IdLookup(Protocol):
    """Ids for a batch of keys, in their order; raises Busy if it is to be asked again later."""

    def ids(self, keys: Sequence[str]) -> Sequence[str | None]: ...


class Busy(Exception):
    """The service is busy (429) or failing (5xx)."""


def newest_of_kinds(entries: DataFrame, *kinds: str) -> DataFrame:
    """Of a service's bulk files (type, uri, updated_at), the newest of each kind asked for; of equally new ones the last uri.

    A kind without an entry gives no row; an entry without a time is older than any with one.
    """
    newest = F.max(F.struct("updated_at", "uri")).alias("newest")
    return entries.where(F.col("type").isin(*kinds)).groupBy("type").agg(newest).select("type", "newest.uri", "newest.updated_at")


# --- downloads --------------------------------------------------------------------------------------------------------


def http_date(text: str | None) -> dt.datetime | None:
    """A Last-Modified header's time; None if there is none or it can't be read."""
    try:
        return email.utils.parsedate_to_datetime(text) if text else None
    except ValueError:
        return None


def http_timestamp(c: Column) -> Column:
    """The same of a column, in any session's time zone; the weekday in front says nothing new."""
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(c, r"^\s*[A-Za-z]+,\s*", ""), r" (?:GMT|UTC)\s*$", " Z"), F.lit("d MMM yyyy HH:mm:ss X"))


def download_decision(exists: Column, force: Column, check: Column, local: Column, remote: Column) -> Column:
    """fetch or skip. What isn't there, or is forced, is fetched; what is there only if it is checked and the remote is newer or of unknown age."""
    newer = F.coalesce(remote > local, F.lit(True))
    return F.when(~exists | force | (check & newer), "fetch").otherwise("skip")


# --- media and models -------------------------------------------------------------------------------------------------


class FrameReader(Protocol):
    """Frames of a video: (time in ms, encoded picture), all or key frames only."""

    def frames(self, content: bytes, key_only: bool) -> Iterator[tuple[int, bytes]]: ...


class PictureModel(Protocol):
    """Vectors of encoded pictures, a row each: neural embeddings, perceptual hashes (0 and 1), blur scores, corners."""

    width: int

    def vectors(self, pictures: Sequence[bytes]) -> np.ndarray: ...


class PictureEdit(Protocol):
    """An encoded picture made of another and numbers: dewarped by corners, resized, drawn upon."""

    def edit(self, picture: bytes, numbers: Sequence[float]) -> bytes: ...


def vectors_of(df: DataFrame, id_col: str, data_col: str, model: PictureModel, normalise: bool = False, batch: int = 64) -> DataFrame:
    """id, vector of each row by a model, in batches; unit length on demand; null data or a picture the model refuses gives null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield pd.DataFrame({id_col: part["id"].to_numpy(), "vector": _vectors(model, part["data"].tolist(), normalise)})

    source = df.select(F.col(id_col).alias("id"), F.col(data_col).alias("data"))
    return source.mapInPandas(run, f"`{id_col}` {source.schema['id'].dataType.simpleString()}, vector array<float>")


def _vectors(model: PictureModel, pictures: list[bytes | None], normalise: bool) -> list[np.ndarray | None]:
    out: list[np.ndarray | None] = [None] * len(pictures)
    own = [i for i, p in enumerate(pictures) if p is not None]
    groups = [own] if own else []
    while groups:
        group = groups.pop()
        try:
            found = np.asarray(model.vectors([pictures[i] for i in group]), np.float32)
        except Exception:  # noqa: BLE001  the model is the caller's
            groups += [[i] for i in group] if len(group) > 1 else []
            continue
        for i, v in zip(group, found, strict=True):
            size = float(np.linalg.norm(v))
            out[i] = v / size if normalise and size else v
    return out


def frames_of(df: DataFrame, id_col: str, data_col: str, reader: FrameReader, key_only: bool = False) -> DataFrame:
    """id, at_ms, picture of each video's frames, in the order of the reader."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for own, content in zip(frame["id"], frame["data"], strict=True):
                for at_ms, picture in reader.frames(content, key_only) if content is not None else ():
                    yield pd.DataFrame({id_col: [own], "at_ms": [at_ms], "picture": [picture]})

    source = df.select(F.col(id_col).alias("id"), F.col(data_col).alias("data"))
    return source.mapInPandas(run, f"`{id_col}` {source.schema['id'].dataType.simpleString()}, at_ms bigint, picture binary")


def edited(df: DataFrame, data_col: str, numbers_col: str, tool: PictureEdit) -> DataFrame:
    """All rows and columns with the picture of ``data_col`` edited; rows without picture or numbers keep a null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [tool.edit(p, n) if p is not None and n is not None else None for p, n in zip(frame[data_col], frame[numbers_col], strict=True)]
            yield frame.assign(**{data_col: made})

    return df.mapInPandas(run, df.schema)
