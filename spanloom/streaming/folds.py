"""Ordered folds as streaming queries: the same state machines as in batch, one per key, kept in Spark's state store by buckets of keys."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.config import Options
from spanloom.operators import dispatch, ingest
from spanloom.plans.fold import State, ensure_importable

#: Into how many buckets keys are dealt; a query's checkpoint holds for one number alone.
BUCKETS = 1024


def fold_stream(rows: DataFrame, key: str, order: list[str], columns: list[str], make: Callable[[object], State], schema: str) -> DataFrame:
    """What the folds of the keys give, as it comes. Rows of one trigger are taken in order; those of later triggers come after them.

    A stream has no end, so flush is never called: what a key still holds stays in its state, which
    Spark's checkpoint makes survive a restart of the query under the same code. Keys are dealt to
    BUCKETS, whose keys' states are read and written together: each call of Python costs more than
    most keys' rows in it.
    """
    ensure_importable(rows.sparkSession)
    whole = {f.name for f in rows.schema if isinstance(f.dataType, T.IntegralType)}
    names = [f.name for f in T._parse_datatype_string(schema)]
    used = list(dict.fromkeys([key, *order, *columns]))
    absent = {c: f"_{i}_absent" for i, c in enumerate(used)}
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    # pandas would make floats of integers that have nulls beside them.
    filled = [F.coalesce(F.col(c), F.lit(0).cast(rows.schema[c].dataType)).alias(c) if c in whole else F.col(c) for c in used]
    dealt = rows.select(bucket.cast("int").alias("_bucket"), *filled, *(F.col(c).isNull().alias(n) for c, n in absent.items()))

    def values(pdf: pd.DataFrame, name: str) -> list:
        return [None if gone else x for x, gone in zip(pdf[name].tolist(), pdf[absent[name]].tolist(), strict=True)]

    def step(_: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        states, out = pickle.loads(held.get[0]) if held.exists else {}, []
        pdf = pd.concat(list(batches)).sort_values([x for c in [key, *order] for x in (absent[c], c)], kind="stable")
        for at, *row in zip(*(values(pdf, c) for c in [key, *columns]), strict=True):
            if at not in states:
                states[at] = make(at)
            out += states[at].push(tuple(row))
        held.update((pickle.dumps(states),))
        yield pd.DataFrame({n: pd.Series([r[i] for r in out], dtype=object) for i, n in enumerate(names)})

    return dealt.groupBy("_bucket").applyInPandasWithState(step, schema, "states binary", "append", GroupStateTimeout.NoTimeout)


def append_packets_stream(packets: DataFrame, options: Options | None = None) -> DataFrame:
    """The outcome of every packet as it comes; as ingest.append_packets, with each stream's buffer as state."""
    options = options or Options()
    return fold_stream(ingest.inputs(packets), "stream_id", ["seq"], ingest.COLUMNS, lambda k: ingest.Buffer(k, options.cap_samples, options.gap_tolerance), ingest.PACKETS)


def admit_stream(events: DataFrame, max_in_flight: int = 6, observations: int = 1) -> DataFrame:
    """Starts, resolutions and the language lock as cuts and results come; as dispatch.admit."""
    dispatch.check_admission(max_in_flight, observations)
    return fold_stream(events, "stream_id", ["seq"], dispatch.ADMISSION_COLUMNS, lambda k: dispatch.Admission(k, max_in_flight, observations), dispatch.ADMISSIONS)


class _Waiting:
    """Resolved chunks of a stream that wait for those before them."""

    def __init__(self, stream: int) -> None:
        self.stream, self.next_id = stream, 0
        self.held: dict[int, str | None] = {}

    def push(self, row: tuple) -> list[tuple]:
        chunk, payload = row
        if chunk is None or chunk < self.next_id:
            return []
        self.held.setdefault(chunk, payload)
        out = []
        while self.next_id in self.held:
            out.append((self.stream, self.next_id, self.held.pop(self.next_id)))
            self.next_id += 1
        return out

    def flush(self) -> list[tuple]:
        return []


def in_order_stream(resolved: DataFrame) -> DataFrame:
    """stream_id, chunk_id and payload of every resolved chunk, each stream's in order of chunk_id from 0 on, once all before it are there.

    Repeated chunks, and those without an id, are left out. As many wait as are in flight.
    """
    return fold_stream(resolved, "stream_id", ["chunk_id"], ["chunk_id", "payload"], _Waiting, "stream_id bigint, chunk_id bigint, payload string")
