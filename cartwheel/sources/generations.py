"""Generations of a stored result (S11, C5-C7): readers see a whole one or the one before.

A generation is written to a folder of its own.  When all its tables are there, a small
manifest that names it is written under a temporary name and renamed to the next number;
the rename is the only step that readers notice.  A job that dies before it leaves the
last generation as it was.  Older generations but one are removed after the rename, so
that a reader that has just looked up the one before can end.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

from cartwheel.sources.io import remove_path

#: Generations kept: the current one and the one that running readers may still use.
KEPT = 2
_MANIFEST = re.compile(r"manifest-(\d{8})$")


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifests(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """``(number, folder of the generation)`` of all published generations, oldest first."""
    _, p, files = _file_system(spark, root)
    if not files.exists(p):
        return []
    names = [s.getPath().getName() for s in files.listStatus(p)]
    numbers = sorted(int(m.group(1)) for m in map(_MANIFEST.match, names) if m)
    return [(n, spark.read.text(f"{root}/manifest-{n:08d}").first()["value"]) for n in numbers]


def begin(root: str) -> str:
    """The folder of a new generation, which nobody reads yet."""
    return f"{root.rstrip('/')}/generation-{uuid.uuid4().hex}"


def publish(spark: SparkSession, root: str, folder: str) -> int:
    """Make a fully written generation the current one; returns its number.

    Of two jobs that publish at a time both succeed, one after the other: a taken number
    is not overwritten, the next one is tried.
    """
    root = root.rstrip("/")
    jvm, _, files = _file_system(spark, root)
    draft = f"{root}/draft-{uuid.uuid4().hex}"
    name = folder[len(root) + 1:] if folder.startswith(root + "/") else folder
    spark.createDataFrame([(name,)], "value string").coalesce(1).write.text(draft)
    number = max((n for n, _ in manifests(spark, root)), default=0) + 1
    while True:
        place = jvm.org.apache.hadoop.fs.Path(f"{root}/manifest-{number:08d}")
        if not files.exists(place) and files.rename(jvm.org.apache.hadoop.fs.Path(draft), place):
            break
        number += 1
    for n, old in manifests(spark, root)[:-KEPT]:
        remove_path(spark, f"{root}/manifest-{n:08d}")
        remove_path(spark, f"{root}/{old}")
    return number


def current(spark: SparkSession, root: str) -> str:
    """The folder of the current generation; a root without manifests is itself the folder."""
    root = root.rstrip("/")
    found = manifests(spark, root)
    return f"{root}/{found[-1][1]}" if found else root
