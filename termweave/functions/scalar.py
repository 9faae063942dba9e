"""Scalar functions of frequencies, ranks, hashes and sizes, as column expressions."""

from __future__ import annotations

import ast
import hashlib
import math
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_IDF = 60


def idf_x10(df: Column, n: Column, most: int = MAX_IDF) -> Column:
    """Ten times the logarithm of n / df, rounded half up and capped; nothing found has the cap."""
    raw = F.floor(F.lit(10.0) * F.log10(n / df) + 0.5)
    return F.when(df <= 0, F.lit(min(most, MAX_IDF))).otherwise(F.least(F.lit(min(most, MAX_IDF)), raw)).cast("int")


def idf_to_frequency(idf: Column) -> Column:
    return F.pow(F.lit(10.0), -idf / 10.0)


def frequency_at_rank(f: Column, rank: Column) -> Column:
    return F.when(rank == 0, f).otherwise(1 - F.pow(1 - f, F.pow(F.lit(2.0), rank)))


def document_frequency(n: Column, idf: Column) -> Column:
    """How many of n documents a term of this (undecupled) idf is in."""
    return F.floor(n / F.pow(F.lit(10.0), idf)).cast("long")


def max_rank(f: Column, target: float) -> Column:
    """The least rank at which the frequency reaches the target."""
    if target >= 1:
        return F.lit(0)
    need = F.log2(F.log(F.lit(1 - target)) / F.log(1 - f))
    return F.when((f <= 0) | (f >= target), F.lit(0)).otherwise(F.ceil(need - 1e-12).cast("int"))


def row_count(f: Column, density: float, snr: float) -> Column:
    """Rows needed for the signal to noise ratio; one where the term is denser than the rows."""
    k = F.ceil(F.log(f / snr) / F.log(F.lit(density) - f))
    return F.when(f >= density, F.lit(1)).otherwise(F.greatest(k, F.lit(1))).cast("int")


def gram_hash(left: Column, right: Column) -> Column:
    """The hash of a gram: its beginning's rotated left by one, xor the last term's."""
    return F.shiftleft(left, 1).bitwiseOR(F.shiftrightunsigned(left, 63)).bitwiseXOR(right)


def unsigned_mod(x: Column, n: Column) -> Column:
    """x mod n with x as an unsigned 64-bit number, for n of at most 2 ** 31."""
    high, low = F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF))
    return ((high % n) * (F.lit(1 << 32) % n) + low % n) % n


def shared_row(h: Column, variant: int, rows: Column) -> Column:
    """A term's row among `rows` shared ones: the unsigned hash, xor the variant's constant, modulo their number."""
    if not 0 <= variant < 64:
        raise ValueError("there are 64 variants")
    constant = int.from_bytes(hashlib.md5(b"row variant %d" % variant).digest()[:8], "big", signed=True)
    return unsigned_mod(h.bitwiseXOR(F.lit(constant)), rows).cast("long")


def shard_of(postings: Column, minima: list[int]) -> Column:
    """The last shard whose least posting count is reached."""
    out = F.lit(0)
    for k, least in enumerate(sorted(minima)):
        out = F.when(postings >= least, F.lit(k)).otherwise(out) if k else out
    return out


def round_up(x: Column, n: int) -> Column:
    return (F.ceil(x / n) * n).cast("long")


def round_up_power_of_two(x: Column) -> Column:
    return F.when(x <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(x)))).cast("long")


def documents_in_row(n: Column, most_rank: int = 6) -> Column:
    return round_up(n, 64 << most_rank)


def bytes_in_row(n: Column, rank: int, most_rank: int = 6) -> Column:
    return F.shiftright(documents_in_row(n, most_rank), 3 + rank)


def gaussian(x: Column, mean: float, sd: float) -> Column:
    return F.exp(-F.pow((x - mean) / sd, 2) / 2) / (sd * 2.5066282746310002)


def rotate_left(x: Column, n: int) -> Column:
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n))


def packed_extreme(a: Column, b: Column, largest: bool = True) -> Column:
    """Field by field the greatest or least of two structs' order, as tuples."""
    return F.greatest(a, b) if largest else F.least(a, b)


def apply_model(table: list[float], index: Column) -> Column:
    """A lookup table's value; null outside."""
    return F.get(F.array(*map(F.lit, table)), index.cast("int"))


def arithmetic(formula: str) -> Column:
    """A formula of + - * /, parentheses, numbers, e, pi and sqrt; operators of a level go from left to right.

    Parsed here, so that nothing but arithmetic gets into the plan.
    """
    tree = ast.parse(formula.strip(), mode="eval").body
    names = {"e": math.e, "pi": math.pi}
    binary = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}

    def value(n: ast.expr) -> Column:
        match n:
            case ast.Constant(v) if isinstance(v, int | float) and not isinstance(v, bool):
                return F.lit(float(v))
            case ast.Name(name) if name in names:
                return F.lit(names[name])
            case ast.BinOp(left, op, right) if type(op) in binary:
                return binary[type(op)](value(left), value(right))
            case ast.UnaryOp(ast.USub(), x):
                return -value(x)
            case ast.UnaryOp(ast.UAdd(), x):
                return value(x)
            case ast.Call(ast.Name("sqrt"), [x], []):
                return F.sqrt(value(x))
            case ast.Name(name):
                return F.col(f"`{name}`").cast("double")
        raise ValueError(f"not arithmetic: {formula!r}")

    return value(tree)
