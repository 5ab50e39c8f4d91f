"""Uniform sharding by a hypergeometric communication matrix, in DataFrame operations only.

A uniform random permutation of N rows that lie in P partitions, cut into S
shards of fixed sizes, sends from each partition to each shard a number of rows
whose joint law is multivariate hypergeometric. So the counts are drawn first,
from the partitions' row counts alone; each partition then orders its own rows
by a seeded hash and deals them out by its row of counts, and each shard orders
what it receives by another seeded hash. The result has the law of a global
shuffle, shard sizes at most one apart, and moves each row once.

A partition here is a hash class of the ids, not a physical one, so that retries
and reruns give the same rows. The matrix has P x S numbers, whatever the
rows; it is drawn on the driver, with plain arithmetic, from P counts.

Law: ``rows`` (shard sizes differ by one at most). Equal texts are dealt like
other rows: keeping them together would break the exact shard sizes.

Defined results: a null text has size 16 and the crc32 of the empty string; a
null id is a row like any other; repeated rows (equal id and text) lie in one
partition and each get a slot of their own; an empty table gives no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm import common as C


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Successes among ``draws`` of ``good + bad`` without replacement, by inversion from the mode; exact for any size that a double can tell apart."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    spread = math.sqrt(max(draws * (good / total) * (bad / total) * ((total - draws) / max(total - 1, 1)), 1.0))
    reach = int(12 * spread) + 40  # beyond 12 deviations lies less than a double can hold of the sum
    a, b = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(a, b, dtype=np.float64)
    # log p(k+1) - log p(k)
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(step)])
    weight = np.exp(logs - logs.max())
    return a + int(np.searchsorted(np.cumsum(weight), rng.random() * weight.sum(), "right").clip(0, b - a))


def communication_matrix(counts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows sent from each partition to each shard: row sums ``counts``, column sums ``shards``."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left = list(shards)
    out = []
    for n in counts:
        row, rest, total = [], n, sum(left)
        for s, room in enumerate(left):
            total -= room
            got = hypergeometric(rng, room, total, rest) if rest else 0
            row.append(got)
            rest -= got
            left[s] -= got
        out.append(row)
    return out


def shard(docs: DataFrame, n_shards: int = 40, n_partitions: int | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of each row, shuffled uniformly.

    ``n_partitions`` is a partition for each 20,000 rows by default, from 64 to
    16,384 of them.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    base = base.select("doc_id", (F.octet_length("text") + 16).cast("long").alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"))
    # 24 bytes a row: the texts are read once
    base = C.materialize(base, "shard-rows")
    n = base.count()
    n_partitions = n_partitions or min(16_384, max(64, n // 20_000))
    base = base.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(n_partitions)))
    counts = {r["part"]: r["n"] for r in base.groupBy("part").agg(F.count("*").alias("n")).collect()}  # n_partitions rows
    parts = sorted(counts)
    sizes = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([counts[p] for p in parts], sizes, seed)
    # the last rank (exclusive) of each partition for each shard; the first shards get the longer counts
    bounds = [[p, *np.cumsum(row).tolist()] for p, row in zip(parts, matrix, strict=True)]
    table = docs.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(bounds)), "array<array<long>>")).alias("b")).select(F.col("b")[0].alias("part"), F.slice("b", 2, n_shards).alias("bounds"))

    own = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "text_crc32", "size")
    dealt = base.withColumn("rank", F.row_number().over(own) - 1).join(F.broadcast(table), "part")  # n_partitions rows
    dealt = dealt.withColumn("shard", F.size(F.filter("bounds", lambda b: b <= F.col("rank"))))
    # inside a shard: order by a second hash, in two levels, so that a shard may be larger than a task
    h = F.xxhash64(F.lit(seed + 2), "doc_id", "rank")
    n_cells = max(8, n // n_shards // 20_000)
    dealt = dealt.select("doc_id", "size", "text_crc32", "shard", F.shiftrightunsigned(h, 1).alias("h"), F.lit(1).alias("one"))
    dealt = dealt.withColumn("cell", F.floor(F.col("h") / float(1 << 63) * n_cells).cast("int"))
    out = C.prefix_sums(dealt, ["shard"], "cell", ["h", "doc_id", "text_crc32"], "one", "slot")
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")
