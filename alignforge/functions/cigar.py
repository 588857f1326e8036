"""CIGAR codec and measures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operations in code order.
OPS = "MIDNSHP=X"


def parse(cigar: Column) -> Column:
    """array<struct<len, op>>."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^\d+", 0).cast("long").alias("len"), F.substring(p, -1, 1).alias("op")))


def pack(length: Column, op: Column) -> Column:
    """length << 4 | code; an unknown operation counts as M."""
    place = F.instr(F.lit(OPS), op) - 1
    return F.shiftleft(length.cast("long"), 4).bitwiseOR(F.greatest(place, F.lit(0)).cast("long"))


def op_of(packed: Column) -> Column:
    code = packed.bitwiseAND(F.lit(15).cast("long"))
    return F.when(code < len(OPS), F.substring(F.lit(OPS), code.cast("int") + F.lit(1), F.lit(1))).otherwise("M")


def length_of(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 4)


def packed_array(cigar: Column) -> Column:
    return F.transform(parse(cigar), lambda p: pack(p["len"], p["op"]))


def mismatches(cigar: Column) -> Column:
    """Summed lengths of X, I and D."""
    return F.aggregate(parse(cigar), F.lit(0).cast("long"), lambda s, p: s + F.when(p["op"].isin("X", "I", "D"), p["len"]).otherwise(0))
