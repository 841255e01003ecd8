"""Options of a transcription plan, checked when the plan is built."""

from __future__ import annotations

from dataclasses import dataclass

MAX_CHUNK_SECONDS, MAX_CAP_SAMPLES, MAX_IN_FLIGHT = 600, 57_600_000, 4_096


@dataclass(frozen=True)
class Options:
    """Chunk length, buffer cap, gap tolerance and silence limit in samples; work in flight; observations before the language lock."""

    chunk_samples: int = 480_000
    cap_samples: int = MAX_CAP_SAMPLES
    gap_tolerance: int = 3_200
    silence_limit: int | None = None
    max_in_flight: int = 6
    lock_after: int = 1
    word_alignment: bool = False

    def __post_init__(self) -> None:
        checks = {
            "chunk_samples": 1 <= self.chunk_samples <= MAX_CHUNK_SECONDS * 16_000,
            "cap_samples": 1 <= self.cap_samples <= MAX_CAP_SAMPLES,
            "gap_tolerance": 0 <= self.gap_tolerance <= self.cap_samples,
            "silence_limit": self.silence_limit is None or self.silence_limit >= 0,
            "max_in_flight": 1 <= self.max_in_flight <= MAX_IN_FLIGHT,
            "lock_after": self.lock_after >= 1,
        }
        for name, good in checks.items():
            if not good:
                raise ValueError(f"invalid {name}")
