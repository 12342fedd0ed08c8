"""Counter-mode SHA-256 numbers: the i-th is the first 8 bytes of SHA-256(seed || i as 8 bytes)."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def seed_hex(material: Column) -> Column:
    return F.sha2(material, 256)


def u64(seed: Column, counter: Column) -> Column:
    """decimal(20,0) in [0, 2^64)."""
    block = F.sha2(F.concat(F.unhex(seed), F.unhex(F.lpad(F.hex(counter.cast("bigint")), 16, "0"))), 256)
    return F.conv(F.substring(block, 1, 16), 16, 10).cast("decimal(20,0)")


def below(draw: Column, n: Column | int) -> Column:
    return (draw % (F.lit(n) if isinstance(n, int) else n)).cast("bigint")


def threshold(probability: float) -> int:
    """Exact on the driver: a double through a decimal column would lose digits."""
    if not 0.0 <= probability <= 1.0:
        raise ValueError("a probability lies in [0, 1]")
    return int(probability * (1 << 64))


def happens(draw: Column, probability: float) -> Column:
    return draw < F.lit(str(threshold(probability))).cast("decimal(21,0)")


class Stream:
    """The same numbers in Python, for transforms that draw as they go."""

    def __init__(self, material: str):
        self.seed = hashlib.sha256(material.encode()).digest()
        self.drawn = 0

    def u64(self) -> int:
        got = int.from_bytes(hashlib.sha256(self.seed + self.drawn.to_bytes(8, "big")).digest()[:8], "big")
        self.drawn += 1
        return got

    def below(self, n: int) -> int:
        if n < 1:
            raise ValueError("nothing to draw from")
        return self.u64() % n

    def happens(self, probability: float) -> tuple[bool, int]:
        got = self.u64()
        return got < threshold(probability), got

    def shuffled(self, values: list) -> list:
        """Fisher-Yates from the end."""
        out = list(values)
        for i in reversed(range(1, len(out))):
            j = self.below(i + 1)
            out[i], out[j] = out[j], out[i]
        return out


def twister_draws(spark: SparkSession, *, seeds: dict[str, int], replicates: int, size: int) -> DataFrame:
    """stream, replicate, idx, times: draws with replacement by the Mersenne Twister, `size` a replicate.

    A stream is sequential, so each is made in one task; streams run beside each other, and equal
    draws are counted before they leave the task.
    """
    rows = spark.createDataFrame([(k, v) for k, v in seeds.items()], "stream string, seed bigint").repartition(max(len(seeds), 1), "stream")

    def draw(batches):
        import pandas as pd

        for batch in batches:
            for name, seed in zip(batch["stream"], batch["seed"]):
                rnd = random.Random(int(seed))
                for r in range(replicates):
                    counts = pd.Series([rnd.randrange(size) for _ in range(size)]).value_counts()
                    yield pd.DataFrame({"stream": name, "replicate": r, "idx": counts.index, "times": counts.values})

    return rows.mapInPandas(draw, "stream string, replicate int, idx int, times int")
