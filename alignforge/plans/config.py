"""Configuration objects, JSON in and out."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from math import ceil

from alignforge.functions.scoring import Scoring


# Option names and defaults.
@dataclass
class SWConfig:
    gapInit: int = 0
    gapExtend: int = -1
    matchValue: int = 1
    mismatchValue: int = -1
    ambiguityValue: int = -1
    similarity: str = "na"
    datatype: str = "na"

    def scoring(self) -> Scoring:
        return Scoring.named(
            self.similarity, self.datatype, self.matchValue, self.mismatchValue, self.ambiguityValue, self.gapInit, self.gapExtend
        )


@dataclass
class AlgoConfig:
    tilesUsed: int = 1
    maxAB: int = 300
    maxBatches: int = 20
    bufsize: int = 3000
    fillAlgo: str = "fillFirst"
    forwardOnly: bool = False
    useRemoteBuffer: bool = False
    engine: str = "arrow"

    def __post_init__(self):
        if self.fillAlgo not in FILL:
            raise ValueError(f"fillAlgo is one of {sorted(FILL)}")
        if self.engine not in ENGINES:
            raise ValueError(f"engine is one of {sorted(ENGINES)}")

    def comparisons(self) -> int:
        return self.tilesUsed * self.maxBatches

    def buffer_words(self) -> int:
        return ceil(self.bufsize / 4)

    def total_words(self) -> int:
        return self.tilesUsed * self.buffer_words()

    def meta_words(self) -> int:
        return 4 * self.comparisons()

    def input_words(self) -> int:
        return self.total_words() + self.meta_words()

    def batch_limits(self) -> tuple[int, int]:
        """(comparisons, bytes) at which a batch closes; no byte limit where the configuration leaves no room for one."""
        data = 4 * self.total_words() - 100 * self.bufsize
        return self.comparisons() - self.maxBatches, data if data > 0 else 1 << 62


@dataclass
class RunConfig:
    numDevices: int = 1
    numThreads: int = 1
    duplicateDatasets: bool = False
    duplicationFactor: int = 0

    def copies(self) -> int:
        return self.duplicationFactor or (max(self.numDevices, 1) if self.duplicateDatasets else 1)


# Names of the fill algorithms, here and in :mod:`alignforge.operators.packing`.
FILL = {"fillFirst": "fill_first", "roundRobin": "round_robin", "roundrobin": "round_robin", "greedy": "greedy"}
#: how pairs are aligned: numpy over Arrow batches, or a recursive SQL query for short sequences
ENGINES = {"arrow", "sql"}


def to_json(config) -> str:
    return json.dumps(asdict(config))


def from_json(kind, text: str):
    """Unknown keys are errors; missing ones keep their default."""
    given = json.loads(text)
    known = {f.name for f in fields(kind)}
    if extra := set(given) - known:
        raise ValueError(f"unknown keys: {sorted(extra)}")
    return kind(**given)
