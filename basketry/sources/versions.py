"""Versioned table folders with one manifest, so that readers see all of a load or none of it.

A load writes its tables into a new folder and publishes them last, by one small file that names
the folder of every table. Readers follow the newest manifest; a load that fails leaves the
tables of the one before, whole. Tables that a load does not bring keep their folder.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession

VERSIONS, MANIFESTS = "_versions", "_manifests"


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def new_version(directory: str) -> str:
    return f"{directory}/{VERSIONS}/{time.time_ns():020d}-{uuid.uuid4().hex}"


def _manifests(spark: SparkSession, directory: str) -> list[str]:
    """The published manifests, oldest first; names start with the time of publishing."""
    files, folder = _path(spark, f"{directory}/{MANIFESTS}")
    if not files.exists(folder):
        return []
    return sorted(str(f.getPath().toString()) for f in files.listStatus(folder) if f.getPath().getName().endswith(".json"))


def _read(spark: SparkSession, manifest: str) -> dict[str, str]:
    files, path = _path(spark, manifest)
    stream = files.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)


def current(spark: SparkSession, directory: str) -> dict[str, str]:
    """Table name -> folder of the newest published load; empty if none was published."""
    found = _manifests(spark, directory)
    return _read(spark, found[-1]) if found else {}


def publish(spark: SparkSession, directory: str, folders: dict[str, str]) -> None:
    """Make ``folders`` the current ones of their tables.

    The manifest is written beside its place and renamed into it, so it is never seen half written.
    """
    text = json.dumps(current(spark, directory) | folders, indent=1, sort_keys=True)
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    files, draft = _path(spark, f"{directory}/{MANIFESTS}/.{name}")
    stream = files.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    _, final = _path(spark, f"{directory}/{MANIFESTS}/{name}.json")
    if not files.rename(draft, final):
        raise OSError(f"cannot publish {final}")


def drop_old(spark: SparkSession, directory: str, keep: int = 2) -> list[str]:
    """Delete manifests and table folders that none of the ``keep`` newest loads uses; their names."""
    found = _manifests(spark, directory)
    used = {folder for m in found[-keep:] for folder in _read(spark, m).values()}
    gone = []
    for manifest in found[:-keep]:
        for folder in _read(spark, manifest).values():
            if folder not in used and folder not in gone:
                files, path = _path(spark, folder)
                files.delete(path, True)
                gone.append(folder)
        files, path = _path(spark, manifest)
        files.delete(path, False)
    return gone
