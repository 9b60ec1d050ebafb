"""Deterministic Monte-Carlo building blocks (W-4, G-19).

Permutations are keyed bijections whose round keys are md5 hashes of ``seed:perm:round`` text,
so a permutation test gives the same answer on every run, on any cluster layout, and in any
SQL engine with md5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def dense_index(df: DataFrame, *order, out: str = "pos") -> DataFrame:
    """Attach a 0-based position in ``order`` (a total order) without a single-partition window.

    Range-partition + local sort, tag each row with its partition and in-partition ordinal,
    then add the running row count of the preceding partitions.  Only one row per partition
    (a bounded table) is aggregated and broadcast.  The tagged frame is checkpointed so the
    counts and the rows see the same layout even if executors are lost.
    """
    ensure_checkpoint_dir(df.sparkSession)
    tagged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint()
    )
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    offsets = counts.withColumn(
        "_off", F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    )
    return (
        tagged.join(F.broadcast(offsets), "_pid")
        .withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("long"))
        .drop("_pid", "_mid", "_m0", "_n", "_off")
    )


ROUNDS = 16
PRIME = 2_147_483_647


def round_keys(perms: DataFrame, seed: int, n: int, perm: str = "perm", out: str = "keys") -> DataFrame:
    """``perms`` with the round keys of each permutation of 0..n-1: ROUNDS structs, k (60 bits, mod n) and s (28 bits)."""

    def key(i: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(perm).cast("string"), i.cast("string")))
        number = lambda a, n: F.conv(F.substring(digest, a, n), 16, 10).cast("long")
        return F.struct(F.pmod(number(1, 15), F.lit(n).cast("long")).alias("k"), number(16, 7).alias("s"))

    return perms.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), key))


def permuted_position(x: Column, n: int, keys: Column) -> Column:
    """Image of position ``x`` under the keyed bijection of 0..n-1 ("swap or not" shuffle).

    Each round pairs x with (k - x) mod n and lets a hash of the pair's larger member decide
    whether they change places; a round is its own inverse, so the whole is a permutation for
    every n.  O(1) per position: no sort, and the first r images are a random ordered sample
    without replacement.  k has 60 bits, far beyond any n.
    """
    size, prime = F.lit(n).cast("long"), F.lit(PRIME).cast("long")

    def swap(x: Column, key: Column) -> Column:
        y = F.when(x <= key["k"], key["k"] - x).otherwise(key["k"] - x + size)
        t = F.greatest(x, y) + key["s"]
        t = t if n + (1 << 28) < PRIME else F.pmod(t, prime)  # already below the prime
        odd = F.shiftright(F.pmod(t * t + key["s"], prime), 10).bitwiseAND(F.lit(1).cast("long")) == 1
        return F.when(odd, y).otherwise(x)

    return F.aggregate(keys, x.cast("long"), swap)


IMAGES = 1 << 16
"""Images that ``permuted_rows`` computes at once."""


def permuted_rows(keys: list, n: int):
    """For ``mapInPandas`` over rows (pos, z): a row (place, z) for every permutation of ``keys`` (collected rows of
    ``round_keys``, one a permutation, in order), place being image x number of permutations + number of the permutation;
    the image is ``permuted_position`` on arrays."""
    import numpy as np
    import pandas as pd

    perms = np.arange(len(keys), dtype=np.int64)
    k, s = (np.array([[x[f] for x in r["keys"]] for r in keys], np.int64).reshape(-1, ROUNDS) for f in ("k", "s"))
    step, prime, high = max(1, IMAGES // max(len(perms), 1)), PRIME, n + (1 << 28) >= PRIME

    def images(batches):
        for batch in batches:
            pos, z = batch["pos"].to_numpy(), batch["z"].to_numpy()
            for at in range(0, len(pos), step):
                x = np.repeat(pos[at : at + step, None], len(perms), axis=1)
                for ki, si in zip(k.T, s.T, strict=True):
                    y = ki - x
                    y += (y < 0) * np.int64(n)
                    t = np.maximum(x, y) + si
                    if high:
                        t %= prime
                    t = (t * t + si) % prime
                    x = np.where(t >> 10 & 1, y, x)
                yield pd.DataFrame({"place": (x * len(perms) + perms).ravel(), "z": np.repeat(z[at : at + step], len(perms))})

    return images


def rows_of(width: int):
    """For ``mapInPandas`` over rows (place, z) sorted by place, ``width`` places a position: a row (pos, v) with the
    values of a position in their order. Less than a position's values are held between batches."""
    import numpy as np
    import pandas as pd

    def joined(batches):
        place, z = np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            place, z = np.concatenate([place, batch["place"].to_numpy()]), np.concatenate([z, batch["z"].to_numpy()])
            whole = len(z) // width * width
            yield pd.DataFrame({"pos": place[:whole:width] // width, "v": list(z[:whole].reshape(-1, width))})
            place, z = place[whole:], z[whole:]

    return joined


def spread_for_fanout(df: DataFrame, n_rows: int, fanout: int, rows_per_task: int = 200_000) -> DataFrame:
    """Round-robin a small frame over enough partitions before a row fan-out (explode).

    A tiny input often sits in one partition; multiplying it by ``fanout`` there would run
    the whole replicated workload in one task.  Only the small side is moved.
    """
    sc = df.sparkSession.sparkContext
    want = max(sc.defaultParallelism, -(-n_rows * fanout // rows_per_task))
    want = max(1, min(want, n_rows))
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want)


BROADCAST_MAX_BYTES = 16 * 1024 * 1024


def plan_bytes(df: DataFrame) -> int:
    """Spark's size of a frame in bytes; for a table read from files, that of the files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint for a written table within ``max_bytes``; a larger one is returned as it is
    and the join shuffles.

    Used for the per-id side of a join against a fanned-out (x P) side: the optimizer's
    estimate of an ``explode`` output is unreliable and may otherwise pick the big side.
    """
    return F.broadcast(df) if plan_bytes(df) <= max_bytes else df


def folded_count(n_ge: Column, permutations: int) -> Column:
    """min(#sim >= obs, P - #sim >= obs): the folded tail count of a pseudo p-value."""
    return F.least(n_ge, F.lit(permutations) - n_ge)


def pseudo_p(n_ge: Column, permutations: int) -> Column:
    """G-19: (folded tail count + 1) / (P + 1)."""
    return (folded_count(n_ge, permutations) + F.lit(1)).cast("double") / F.lit(float(permutations + 1))
