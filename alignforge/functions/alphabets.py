"""Alphabets: letter codes as Column expressions and as byte tables for the kernel."""

from __future__ import annotations

from enum import Enum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class DataType(str, Enum):
    """na: nucleotides, aa: amino acids, str: plain characters."""

    NA = "na"
    AA = "aa"
    STR = "str"


# The letters of each alphabet in code order (code = place).
NA_LETTERS = "NATCGURYKMSWBDHV"
AA_LETTERS = "ARNDCQEGHILKMFPSTWYVBZX*"
# Base translation of the pairwise aligner (others: 4).
BASE_CODES = {"A": 0, "C": 1, "G": 2, "T": 3, "U": 0}


class Alphabet:
    """Case-insensitive codes; an unknown character encodes to the terminator (= number of letters)."""

    def __init__(self, datatype: DataType | str):
        self.datatype = DataType(datatype)
        self.letters = {"na": NA_LETTERS, "aa": AA_LETTERS, "str": "".join(map(chr, range(256)))}[self.datatype.value]
        self.terminator = len(self.letters)
        self.codes = {c: i for i, c in enumerate(self.letters)}

    def encode(self, text: str | list[str]) -> list[int]:
        folded = [c.upper() if self.datatype != DataType.STR else c for c in text]
        return [self.codes.get(c, self.terminator) for c in folded]

    def decode(self, codes: list[int]) -> str:
        return "".join(self.letters[c] if 0 <= c < self.terminator else "\0" for c in codes)

    def byte_table(self, unknown: int | None = None) -> np.ndarray:
        """Code of every byte, for the kernel; ``unknown`` stands for what has none."""
        out = np.full(256, self.terminator if unknown is None else unknown, np.uint8)
        for c, i in self.codes.items():
            if ord(c) < 256:
                out[ord(c)] = i
                if self.datatype != DataType.STR:
                    out[ord(c.lower())] = i
        return out

    # ---- Column forms
    def encode_column(self, text: Column) -> Column:
        """array<int> of codes; null in, null out."""
        if self.datatype == DataType.STR:
            return F.transform(_characters(text), F.ascii)
        found = lambda c: F.instr(F.lit(self.letters), c) - 1
        return F.transform(_characters(F.upper(text)), lambda c: F.when(found(c) >= 0, found(c)).otherwise(self.terminator))

    def decode_column(self, codes: Column) -> Column:
        letter = lambda c: F.when(c.between(0, self.terminator - 1), F.substring(F.lit(self.letters), c + F.lit(1), F.lit(1))).otherwise("\0")
        return F.array_join(F.transform(codes, letter), "")


def _characters(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))


def translate_bases(text: Column) -> Column:
    """array<int>: A 0, C 1, G 2, T 3, U 0, all else 4."""
    code = lambda c: F.coalesce(F.create_map(*[F.lit(x) for kv in BASE_CODES.items() for x in kv])[c], F.lit(4))
    return F.transform(_characters(F.upper(text)), code)


def right_trim(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s]+$", "")


def strip_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, r"\s", "")
