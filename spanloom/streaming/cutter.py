"""The cut as a streaming query: the same rules as the batch fold, with each stream's open chunk in the state store."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.operators.cut import CHUNKS, Acceptance, Cutter, inputs
from spanloom.plans.fold import ensure_importable


def whole(x: object) -> int | None:
    """A number of a pandas row as an integer; None for a missing one."""
    return None if pd.isna(x) else int(x)


STATE = "next_id bigint, watermark bigint, high_water bigint, ended boolean, start bigint, end bigint, override string, next_seq bigint, subs string"


def cut_stream(spans: DataFrame, limit: int, gap: int | None = None) -> DataFrame:
    """Chunks as they close. Rows of one trigger are taken in order of seq; an eof row closes a stream's last chunk.

    State holds one open chunk per stream, and Spark's checkpoint makes it survive a restart.
    """
    ensure_importable(spans.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rules, cutter, next_id = Acceptance(), Cutter(limit, gap), 0
        if held.exists:
            next_id, rules.watermark, rules.high_water, rules.ended, cutter.start, cutter.end, cutter.override_at_start, cutter.next_seq, subs = held.get
            cutter.subs = [tuple(s) for s in json.loads(subs)]
        out: list[tuple] = []

        def emit(chunks: Iterator[tuple]) -> None:
            nonlocal next_id
            for start, end, override, subs in chunks:
                out.append((key[0], next_id, start, end, override, [dict(zip(("start", "end", "kind", "vad_seq", "part", "total_parts"), s, strict=True)) for s in subs]))
                next_id += 1

        for row in pd.concat(list(batches)).sort_values("seq").itertuples():
            kind, start, end = row.kind, whole(row.start_sample), whole(row.end_sample)
            if pd.notna(row.high_water):
                rules.high_water = int(row.high_water)
            if kind == "restart":
                emit(cutter.flush())
                rules, cutter = Acceptance(), Cutter(limit, gap)
            elif rules.judge(kind, start, end) == "accepted":
                if kind == "eof" or (kind == "no_speech" and cutter.would_flush_at(end)):
                    emit(cutter.flush())
                elif kind == "vad":
                    emit(cutter.push(start, end, row.override if isinstance(row.override, str) else None))
        held.update((next_id, rules.watermark, rules.high_water, rules.ended, cutter.start, cutter.end, cutter.override_at_start, cutter.next_seq, json.dumps(cutter.subs)))
        yield pd.DataFrame(out, columns=["stream_id", "chunk_id", "start_sample", "end_sample", "override_at_start", "subs"])

    return inputs(spans).groupBy("stream_id").applyInPandasWithState(step, CHUNKS, STATE, "append", GroupStateTimeout.NoTimeout)
