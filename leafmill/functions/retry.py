"""Waits between attempts, and which errors are worth another."""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of errors that pass: with the server's 5xx and 429. Fixed values.
PASSING = ("timeout", "connection")


def waits(attempts: Column, initial: Column, most: Column, jitter: Column | None = None, noise: Column | None = None) -> Column:
    """Seconds before each further attempt: initial times 1, 1, 2, 3, 5, ..., `most` at most. `noise` in -1..1 times
    jitter is put on before the cap. One attempt less than `attempts`; none for 1."""
    spread = 1 + F.coalesce(jitter, F.lit(0.0)) * F.coalesce(noise, F.lit(0.0)) if jitter is not None else F.lit(1.0)
    begun = F.struct(F.lit(1.0).alias("a"), F.lit(1.0).alias("b"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, i: Column) -> Column:
        wait = F.greatest(F.lit(0.0), F.least(initial * s.a * spread, most)).cast("double")
        more = F.when(i < attempts, F.concat(s.out, F.array(wait))).otherwise(s.out)
        return F.struct(s.b.alias("a"), (s.a + s.b).alias("b"), more.alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(attempts, F.lit(1))), begun, step, lambda s: s.out)


def is_transient(kind: Column, status: Column) -> Column:
    return F.coalesce(kind.isin(*PASSING) | (status >= 500) | (status == 429), F.lit(False))


def error_summary(name: Column, status: Column, message: Column) -> Column:
    """Class, status and message; never a response's body."""
    return F.when(status.isNotNull(), F.format_string("%s: status=%d: %s", name, status, message)).otherwise(F.format_string("%s: %s", name, message))


def wait_times(initial: float, most: float, jitter: float, source: random.Random) -> Iterator[float]:
    """The same waits one after another, for a worker."""
    a, b = 1.0, 1.0
    while True:
        yield max(0.0, min(initial * a * (1 + source.uniform(-jitter, jitter)), most))
        a, b = b, a + b
