"""Rows of a stream that repeat an id, found across micro-batches."""

import json
import zlib
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.dates import to_instant

SPREAD = 64
BUCKETS = 1 << 12


def _rank(row: str) -> list[tuple[bool, str]]:
    """The order of a row, nulls first; Python orders texts like Spark, by code points."""
    return [(v is not None, v or "") for v in json.loads(row)]


def _candidates(frames):
    """The least row of each id in a batch is a candidate for the id's first row and keeps its bucket.

    The others come after it, whatever else is known, so they are spread over groups below zero and touch no state.
    """
    for frame in frames:
        least: dict[str, tuple[list, int]] = {}
        twice = np.flatnonzero(frame["_key"].duplicated(keep=False))
        for at, key, row in zip(twice.tolist(), frame["_key"].iloc[twice], frame["_row"].iloc[twice]):
            rank = _rank(row)
            if key not in least or rank < least[key][0]:
                least[key] = rank, at
        passing = np.zeros(len(frame), dtype=bool)
        passing[twice] = True
        passing[[at for _, at in least.values()]] = False
        spread = (-1 - np.arange(len(frame)) % SPREAD).astype(np.int32)
        # State lives from an id's newest row on; rows without a time come as of the newest row near them.
        newest = frame.groupby("_key")["_time"].transform("max") if len(twice) else frame["_time"]
        yield frame.assign(_time=newest.fillna(frame["_time"].max()), _bucket=np.where(passing, spread, frame["_bucket"]))


def _packed(firsts: dict[str, list]) -> bytes:
    return zlib.compress(json.dumps([list(firsts), *zip(*firsts.values())]).encode(), 1)


def _unpacked(blob: bytes, now: int) -> dict[str, list]:
    """Of each id whose time is not over, its first row so far and the time until which it is known."""
    keys, rows, until = json.loads(zlib.decompress(blob))
    return {k: [r, u] for k, r, u in zip(keys, rows, until) if u > now}


def _step(keep_ms: int):
    """State of a bucket: the first row so far of each of its ids. Of two rows of an id, the later one is given out."""

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        if key[0] < 0:
            for frame in frames:
                yield frame[["_row"]]
            return
        now = state.getCurrentWatermarkMs()
        firsts = _unpacked(state.get[0], now) if state.exists else {}
        for frame in frames:
            later = []
            # Without a time, the instant is taken for the watermark's.
            times = frame["_time"].astype("datetime64[ms]").astype("int64").where(frame["_time"].notna(), now)
            for id_, row, at in zip(frame["_key"], frame["_row"], times.tolist()):
                until = max(now, at) + keep_ms
                known = firsts.get(id_)
                if known is None:
                    firsts[id_] = [row, until]
                    continue
                known[1] = max(known[1], until)
                if row != known[0] and _rank(row) < _rank(known[0]):
                    known[0], row = row, known[0]
                later.append(row)
            yield pd.DataFrame({"_row": later}, dtype=object)
        # Ids whose time is over go when their bucket is next read; one that nobody reads goes as a whole after its last id.
        state.update((_packed(firsts),))
        state.setTimeoutTimestamp(max(until for _, until in firsts.values()))

    return step


def later_rows(
    stream: DataFrame, time: Column, delay: str, keep: timedelta, key: str = "ticket_id", order_by: tuple[str, ...] = ("created_at",),
    buckets: int = BUCKETS,
) -> DataFrame:
    """The rows of a stream that come after the first one of their id, each once, as an appending stream of the same columns.

    Over all micro-batches, an id's first row is the least by `order_by`, then by the other columns, all compared as text, nulls
    first and null being an id like any other. Where a smaller row turns up later, the one taken for the first until then is
    given out. Its state is one row per id, forgotten `keep` after the newest `time` of its rows: an id that comes back then
    starts anew. Rows more than `delay` behind the newest one of earlier micro-batches are lost. Both depend on the source, so
    there is no default. A row whose time is null counts as of the newest time of the rows read with it.

    Ids are held in `buckets` by hash, as Spark hands Python one group at a time and a group costs far more than a row. A
    micro-batch rewrites the buckets of its rows, so their number should follow that of the ids (some hundreds or thousands to a bucket); it is
    fixed for the life of a checkpoint.
    """
    kinds = {f.name: f.dataType for f in stream.schema}
    ordered = [*order_by, *[c for c in stream.columns if c != key and c not in order_by], key]
    id_text = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    packed = stream.select(
        id_text.alias("_key"),
        F.pmod(F.xxhash64(id_text), F.lit(buckets)).cast("int").alias("_bucket"),
        to_instant(time).alias("_time"),
        F.to_json(F.array(*[F.col(c).cast("string") for c in ordered])).alias("_row"),
    )
    marked = packed.mapInPandas(_candidates, "_key string, _bucket int, _time timestamp, _row string")
    found = marked.withWatermark("_time", delay).groupBy("_bucket").applyInPandasWithState(
        _step(int(keep.total_seconds() * 1000)), "_row string", "firsts binary", "append", "EventTimeTimeout")
    values = F.from_json("_row", "array<string>")
    return found.select(*[values[i].cast(kinds[c]).alias(c) for i, c in enumerate(ordered)]).select(*stream.columns)
