"""Similarity matrices and gap costs."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from enum import Enum

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .alphabets import AA_LETTERS, NA_LETTERS, DataType


class Similarity(str, Enum):
    NA = "na"
    BLOSUM50 = "blosum50"
    BLOSUM62 = "blosum62"
    SIMPLE = "simple"


# Lower triangles of the published matrices, in the order ARNDCQEGHILKMFPSTWYVBZ.
BLOSUM50 = """
5
-2 7
-1 -1 7
-2 -2 2 8
-1 -4 -2 -4 13
-1 1 0 0 -3 7
-1 0 0 2 -3 2 6
0 -3 0 -1 -3 -2 -3 8
-2 0 1 -1 -3 1 0 -2 10
-1 -4 -3 -4 -2 -3 -4 -4 -4 5
-2 -3 -4 -4 -2 -2 -3 -4 -3 2 5
-1 3 0 -1 -3 2 1 -2 0 -3 -3 6
-1 -2 -2 -4 -2 0 -2 -3 -1 2 3 -2 7
-3 -3 -4 -5 -2 -4 -3 -4 -1 0 1 -4 0 8
-1 -3 -2 -1 -4 -1 -1 -2 -2 -3 -4 -1 -3 -4 10
1 -1 1 0 -1 0 -1 0 -1 -3 -3 0 -2 -3 -1 5
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 2 5
-3 -3 -4 -5 -5 -1 -3 -3 -3 -3 -2 -3 -1 1 -4 -4 -3 15
-2 -1 -2 -3 -3 -1 -2 -3 2 -1 -1 -2 0 4 -3 -2 -2 2 8
0 -3 -3 -4 -1 -3 -3 -4 -4 4 1 -3 1 -1 -3 -2 0 -3 -1 5
-2 -1 5 6 -3 0 1 -1 0 -4 -4 0 -3 -4 -2 0 0 -5 -3 -3 6
-1 0 0 1 -3 4 5 -2 0 -3 -3 1 -1 -4 -1 0 -1 -2 -2 -3 1 5
"""
BLOSUM62 = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
-2 -1 4 4 -3 0 1 -1 0 -3 -4 0 -3 -3 -2 0 -1 -4 -3 -3 4
-1 0 0 1 -3 4 4 -2 0 -3 -3 1 -1 -3 -1 0 -1 -2 -2 -2 0 4
"""
# Which nucleotide codes meet, rows and columns in the order NATCGURYKMSWBDHV.
NA_MEETS = """
1111111111111111
1100001001010111
1010000110011110
1001000101101011
1000101010101101
1000010000000000
1100101000001111
1010000100001111
1010100010001100
1100000001000011
1000100000101001
1110000000010110
1011101110101000
1110101100010100
1111001101010010
1101101101100001
"""


def nucleotide_matches() -> np.ndarray:
    """0/1 over NA_LETTERS: whether two codes meet. Not symmetric: C meets Y, M and S, they do not meet C."""
    return np.array([[int(c) for c in line] for line in NA_MEETS.split()], np.int64)


def residue_matrix(triangle: str, letters: str = AA_LETTERS) -> np.ndarray:
    """Full matrix from a lower triangle over all letters but X and *, which follow rules:
    X is -1 to all; * is the lowest value to all and 1 to itself."""
    rows = [list(map(int, line.split())) for line in triangle.strip().splitlines()]
    k, n = len(rows), len(letters)
    base = np.zeros((k, k), np.int64)
    for i, r in enumerate(rows):
        base[i, : i + 1] = r
        base[: i + 1, i] = r
    low = int(base.min())
    out = np.full((n, n), low, np.int64)
    out[:k, :k] = base
    x, star = letters.index("X"), letters.index("*")
    out[x, :star] = out[:star, x] = -1
    out[star, star] = 1
    return out


@dataclass
class Scoring:
    """A matrix over an alphabet's letters and gap costs: a gap of k costs gap_init + k * gap_extend."""

    matrix: np.ndarray
    letters: str
    datatype: DataType
    gap_init: int = 0
    gap_extend: int = -1
    name: str = "custom"
    unknown: str = field(default="")

    @classmethod
    def named(
        cls, similarity: str = "na", datatype: str | None = None, match: int = 1, mismatch: int = -1, ambiguity: int = -1,
        gap_init: int = 0, gap_extend: int = -1,
    ) -> "Scoring":
        """Matrix by name. The match values shape ``na`` only; ``simple`` is +1/-1 over any characters."""
        s = Similarity(similarity)
        if gap_init > 0 or gap_extend > 0:
            raise ValueError("gap costs are not positive")
        if s == Similarity.NA:
            m = np.where(nucleotide_matches() == 1, match, mismatch)
            m[0, :] = m[:, 0] = ambiguity
            return cls(m, NA_LETTERS, DataType.NA, gap_init, gap_extend, s.value, "N")
        if s == Similarity.SIMPLE:
            letters = "".join(map(chr, range(256)))
            return cls(np.where(np.eye(256) == 1, 1, -1), letters, DataType.STR, gap_init, gap_extend, s.value)
        m = residue_matrix(BLOSUM50 if s == Similarity.BLOSUM50 else BLOSUM62)
        return cls(m, AA_LETTERS, DataType.AA, gap_init, gap_extend, s.value, "*")

    @classmethod
    def open_extend(cls, similarity: str, open_cost: int, extend_cost: int, **kw) -> "Scoring":
        """From the cost of a gap's first base and of each further one (both as positive numbers)."""
        return cls.named(similarity, gap_init=extend_cost - open_cost, gap_extend=-extend_cost, **kw)

    @classmethod
    def simple_bases(cls, match: int = 2, mismatch: int = 2, ambiguity: int = 2, open_cost: int = 3, extend_cost: int = 1) -> "Scoring":
        """The pairwise aligner's base matrix: match, minus mismatch, N against all minus ambiguity."""
        m = np.full((5, 5), -mismatch)
        np.fill_diagonal(m, match)
        m[4, :] = m[:, 4] = -ambiguity
        return cls(m, "ACGTN", DataType.NA, extend_cost - open_cost, -extend_cost, "bases", "N")

    @classmethod
    def from_text(cls, text: str, datatype: str = "aa", gap_init: int = 0, gap_extend: int = -1) -> "Scoring":
        """A matrix file: comments by #, a head line of letters, a line of letter and values each."""
        lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
        letters = "".join(lines[0])
        m = np.array([[int(v) for v in x[1:]] for x in lines[1:]])
        return cls(m, letters, DataType(datatype), gap_init, gap_extend, "custom", "*" if "*" in letters else "")

    def byte_codes(self) -> np.ndarray:
        """Code of every byte, unknown ones standing for ``unknown`` (or a letter that matches nothing)."""
        rest = self.letters.index(self.unknown) if self.unknown else len(self.letters)
        out = np.full(256, rest, np.uint8 if len(self.letters) < 256 else np.int64)
        for i, c in enumerate(self.letters):
            if ord(c) < 256:
                out[ord(c)] = i
                if self.datatype != DataType.STR:
                    out[ord(c.lower())] = i
        return out

    def kernel_matrix(self) -> np.ndarray:
        """The matrix with one more row and column, for characters that match nothing."""
        n = len(self.letters)
        out = np.full((n + 1, n + 1), int(self.matrix.min()), np.int32)
        out[:n, :n] = self.matrix
        return out

    def score(self, x: str, y: str) -> int:
        c = self.byte_codes()
        return int(self.kernel_matrix()[c[ord(x)], c[ord(y)]])

    def frame(self, spark: SparkSession) -> DataFrame:
        """(x, y, score) rows."""
        n = len(self.letters)
        return spark.createDataFrame(
            [(self.letters[i], self.letters[j], int(self.matrix[i, j])) for i in range(n) for j in range(n)], "x string, y string, score int"
        )

    def profile_column(self, text: Column) -> Column:
        """Query profile: for every character its scores against all letters, array<array<int>>."""
        rows = F.array(*[F.array(*[F.lit(int(v)) for v in r]) for r in self.matrix])
        place = lambda c: F.instr(F.lit(self.letters), c)
        rest = self.letters.index(self.unknown) + 1 if self.unknown else 1
        up = F.upper(text) if self.datatype != DataType.STR else text
        chars = F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(up, ""))
        return F.transform(chars, lambda c: F.element_at(rows, F.when(place(c) > 0, place(c)).otherwise(rest)))

    def describe(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k not in ("matrix",)}


def simple_similarity(a: Column, b: Column) -> Column:
    return F.when(a == b, 1).otherwise(-1)


class Matrix:
    """A dense matrix: bounds-checked cells, its greatest one, copies, flat and printed forms."""

    def __init__(self, rows: int, columns: int, values=None):
        self.cells = np.zeros((rows, columns), np.int64) if values is None else np.array(values, np.int64).reshape(rows, columns)

    @property
    def shape(self) -> tuple[int, int]:
        return self.cells.shape

    def _at(self, i: int, j: int) -> tuple[int, int]:
        if not (0 <= i < self.shape[0] and 0 <= j < self.shape[1]):
            raise IndexError(f"({i}, {j}) is outside {self.shape}")
        return i, j

    def __getitem__(self, at: tuple[int, int]) -> int:
        return int(self.cells[self._at(*at)])

    def __setitem__(self, at: tuple[int, int], value: int) -> None:
        self.cells[self._at(*at)] = value

    def argmax(self) -> tuple[int, int]:
        return argmax(self.cells)

    def copy(self) -> "Matrix":
        return Matrix(*self.shape, self.cells)

    def flat(self) -> list[int]:
        """Row by row."""
        return self.cells.ravel().tolist()

    def rows(self) -> list[list[int]]:
        return self.cells.tolist()

    def __str__(self) -> str:
        return "\n".join(" ".join(str(v) for v in r) for r in self.rows())

    def frame(self, spark: SparkSession) -> DataFrame:
        """(i, j, value) rows."""
        return spark.createDataFrame([(i, j, v) for i, r in enumerate(self.rows()) for j, v in enumerate(r)], "i int, j int, value long")


def argmax(matrix: np.ndarray) -> tuple[int, int]:
    """Row and column of the first greatest value in row order."""
    return tuple(int(v) for v in np.unravel_index(int(np.argmax(matrix)), matrix.shape))
