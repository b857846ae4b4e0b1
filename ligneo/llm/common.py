"""Shared helpers: the folder all executors see, written tables, files in that folder."""

import contextlib
import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import functions as F

FOLDER_SETTING = "spark.checkpoint.dir"


def shared_folder(spark):
    """A fresh folder below the one the cluster names in spark.checkpoint.dir.

    Only a local master, where driver and executors are one process, falls back to a temporary folder.
    """
    named = spark.conf.get(FOLDER_SETTING, None) or spark.sparkContext.getConf().get(FOLDER_SETTING)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {FOLDER_SETTING} to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="ligneo-llm-")
    return f"{named.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df, folder, name):
    """Write the rows as Parquet in the shared folder and read them back: lineage ends here, a lost executor costs nothing."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df, *names):
    """Names like those given that no column of `df` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def plain(columns):
    """The columns by name, whatever marks the names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in columns]


def shuffle_width(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_file(folder, name, content):
    """Write one file from a task. The rename makes a repeated attempt harmless: it puts the same bytes in place."""
    system, root = pafs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    context = TaskContext.get()
    attempt = context.taskAttemptId() if context else os.getpid()
    unfinished, final = f"{root}/.{name}.{attempt}", f"{root}/{name}"
    with system.open_output_stream(unfinished) as out:
        out.write(content)
    system.move(unfinished, final)
    return f"{folder}/{name}"


CACHES = {}


def kept_for(work, cache):
    """Names the work that a cache of this worker process serves."""
    CACHES[work] = cache
    return cache


def forget_others(work=None):
    """Free the caches of all work but this one: a Python worker lives through many stages and would keep those of each."""
    full = [cache for name, cache in CACHES.items() if name != work and cache]
    for cache in full:
        cache.clear()
    if full:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix64(x):
    """Scramble unsigned 64-bit integers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running_offsets(counts, keys, count):
    """Add `before`: the sum of `count` over all rows whose keys sort lower. One row per task or file comes in, never one per document."""
    from pyspark.sql import Window

    order = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum(count).over(order), F.lit(0)).cast("long"))
