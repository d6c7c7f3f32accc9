"""Deterministic, partition-independent randomness from md5 hashes.

The same integers come out of DuckDB, so random operators can be checked
against SQL:  u(id, salt) = int(md5(id || ':' || salt)[0:8], 16) / 2^32.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_hex(id_col, salt: str) -> Column:
    return F.md5(F.concat(_col(id_col).cast("string"), F.lit(f":{salt}")))


def _hex_int(hexstr: Column, start: int) -> Column:
    return F.conv(F.substring(hexstr, start, 8), 16, 10).cast("double")


def hash_uniform(id_col, salt: str) -> Column:
    """Uniform in [0, 1)."""
    return _hex_int(hash_hex(id_col, salt), 1) / F.lit(TWO32)


def hash_normal(id_col, salt: str) -> Column:
    """Standard normal by Box-Muller on two 32-bit slices of one md5."""
    h = hash_hex(id_col, salt)
    u1 = (_hex_int(h, 1) + F.lit(1.0)) / F.lit(TWO32 + 1.0)
    u2 = _hex_int(h, 9) / F.lit(TWO32)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def hash_index(id_col, salt: str, n) -> Column:
    """Integer in [0, n) (n may be a Column)."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.floor(hash_uniform(id_col, salt) * n).cast("long")


def rank_by_hash(
    df: DataFrame,
    id_col: str,
    salt: str,
    partition_cols: Sequence[str] = (),
    out: str = "hrank",
    digits: int = 4,
) -> DataFrame:
    """Exact ``row_number() over (partition by P order by md5(id:salt), id)``.

    A plain window would put a whole partition value (or, with no partition,
    the whole table) into one task. Instead the leading ``digits`` hex digits of
    the hash form buckets that are a prefix of the sort key: rows are numbered
    inside (P, bucket), and each bucket's offset comes from a prefix sum over
    the small table of bucket counts (at most |P| x 16^digits rows).
    """
    p = list(partition_cols)
    h = "__h"
    b = "__b"
    keyed = df.withColumn(h, hash_hex(id_col, salt)).withColumn(b, F.substring(F.col(h), 1, digits))
    local_w = Window.partitionBy(*p, b).orderBy(F.col(h), F.col(id_col))
    keyed = keyed.withColumn("__local", F.row_number().over(local_w))
    # bucket sizes from the numbered rows: the data is already partitioned by
    # (P, bucket), so this needs no shuffle and both branches share one exchange
    counts = keyed.groupBy(*p, b).agg(F.max("__local").alias("__n"))
    off_w = Window.partitionBy(*p).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*p, b, F.coalesce(F.sum("__n").over(off_w), F.lit(0)).alias("__off"))
    # The numbered rows are already hash-partitioned and sorted by (P, bucket),
    # so a join on (P, bucket) only moves the small offsets table (AQE may
    # broadcast it once its measured size is known).
    # NULL partition values and ids are values of their own, hence <=>.
    offsets = offsets.select(*[F.col(c).alias(f"__o_{c}") for c in [*p, b]], "__off")
    on = None
    for c in [*p, b]:
        same = F.col(c).eqNullSafe(F.col(f"__o_{c}"))
        on = same if on is None else on & same
    joined = keyed.join(offsets, on)
    ranks = joined.withColumn(out, (F.col("__off") + F.col("__local")).cast("long"))
    return ranks.drop(h, b, "__local", "__off", *[f"__o_{c}" for c in [*p, b]])


def nth_hash(df: DataFrame, id_col: str, salt: str, n: int, digits: int = 3, few: int = 10_000) -> str | None:
    """The hash of the n-th row by md5(id:salt), id (NULL ids first); None if no row ends just there,
    or if the rows after it have the same hash (or a NULL one).

    Each pass counts the rows by the next ``digits`` hex digits under the prefix found so far, until at
    most ``few`` hashes are left to be looked at: no row is shuffled or sorted.
    """
    hashes = df.select(hash_hex(id_col, salt).alias("h"))
    prefix, left = "", n - hashes.where("h is null").count()
    if left <= 0:
        return None
    while len(prefix) < 32:
        under = hashes.where(F.col("h").startswith(prefix)) if prefix else hashes.where("h is not null")
        counts = under.groupBy(F.substring("h", len(prefix) + 1, digits).alias("d")).count().collect()
        for d, count in sorted((r["d"], r["count"]) for r in counts):
            if left <= count:
                break
            left -= count
        else:
            return None
        prefix += d
        if count <= few:
            found = sorted(r["h"] for r in hashes.where(F.col("h").startswith(prefix)).collect())
            return None if left < len(found) and found[left] == found[left - 1] else found[left - 1]
    return None
