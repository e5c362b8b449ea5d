"""Seeded draws from hashes: the same in any split of the rows, in any engine that has MD5, and without a generator's state."""

from __future__ import annotations

import math
from hashlib import md5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Draws that one hash holds: pieces of eight hexadecimal digits.
PIECES, DIGITS = 4, 8


def hash_of(*parts: Column) -> Column:
    """32 hexadecimal digits of the parts joined by colons."""
    return F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary"))


def uniforms(digest: Column) -> Column:
    """An array of PIECES numbers in [0, 1) from hash_of()."""
    return F.array(*(F.conv(F.substring(digest, 1 + DIGITS * i, DIGITS), 16, 10).cast("long") / float(16**DIGITS) for i in range(PIECES)))


def poisson_steps() -> list[float]:
    """Where the distribution function of a Poisson variable of mean 1 steps, as far as 32 bits tell its values from 1."""
    out, total, k = [], 0.0, 0
    while total < 1 - 16.0**-DIGITS:
        total += math.exp(-1) / math.factorial(k)
        out.append(total)
        k += 1
    return out


def poisson(u: Column) -> Column:
    """The Poisson variable of mean 1 that a uniform number stands for: how often a row is in a resample."""
    steps = [(u >= s).cast("int") for s in poisson_steps()]
    return sum(steps[1:], steps[0])


def poisson_of(digits: Column) -> Column:
    """poisson() of a piece of hash_of() as it is written: equally long hexadecimal digits compare as their numbers do, and most draws are told by the first steps."""
    bounds = [b for b in (math.ceil(s * 16**DIGITS) for s in poisson_steps()) if b < 16**DIGITS]
    out = F.when(digits < f"{bounds[0]:0{DIGITS}x}", 0)
    for k, b in enumerate(bounds[1:], 1):
        out = out.when(digits < f"{b:0{DIGITS}x}", k)
    return out.otherwise(len(bounds))


def hash_text(*parts: object) -> str:
    """hash_of() of plain values."""
    return md5(":".join(map(str, parts)).encode()).hexdigest()


def number(*parts: object) -> int:
    """A whole number of 32 bits."""
    return int(hash_text(*parts)[:DIGITS], 16)
