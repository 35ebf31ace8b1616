"""Session settings that follow the size of the data.

Operators never touch the session; a job that owns its session can start from these.
"""

from __future__ import annotations

from math import ceil

MIB = 2**20
SHUFFLE_PARTITION_BYTES = 128 * MIB
SCAN_PARTITION_BYTES = 256 * MIB
MOST_PARTITIONS = 200_000


def settings_for(input_bytes: int, cores: int, shuffled_share: float = 1.0) -> dict[str, str]:
    """Spark SQL settings for reading ``input_bytes`` on ``cores`` executor cores.

    ``shuffled_share`` is the part of the input's bytes that a shuffle moves.  Rule queries
    and filtered rows carry most columns, uncompressed, so it is 1 unless a job that only
    sums a few columns says less.  Shuffles start with one partition per 128 MiB of that share: a
    partition then fits in memory, adaptive execution merges what turns out small and cuts
    what turns out skewed.  There is at least one partition per core and an upper bound,
    because every map task tracks every partition.  Scan splits are small enough to
    give every core work, but not below 4 MiB.
    """
    shuffled = input_bytes * shuffled_share
    partitions = min(MOST_PARTITIONS, max(cores, ceil(shuffled / SHUFFLE_PARTITION_BYTES)))
    split = min(SCAN_PARTITION_BYTES, max(4 * MIB, ceil(input_bytes / max(cores, 1))))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Filtered orders of any usual size may cut the line items before the shuffle.
        "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
        # Off: recording the caller's line for every column expression costs more than
        # building the plan does.  Takes effect when the session is created.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
