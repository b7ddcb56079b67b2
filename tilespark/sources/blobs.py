"""Objects under a root: put, head, get, and all of them as a table. The root is a URI that pyarrow knows (file, hdfs, s3, gs)."""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

SIDECAR = ".meta.json"


def path_of(root: str, key: str) -> str:
    """The key's place under the root; keys that leave it or name the root itself are refused."""
    inner = posixpath.normpath(key.lstrip("/"))
    if inner == "." or inner.split("/")[0] == "..":
        raise ValueError(f"key {key!r} lies outside of the root")
    return posixpath.join(root, inner)


def _open(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _store(system, path: str, body: bytes) -> None:
    # object stores show a whole object or none; elsewhere the name appears when the bytes are there
    straight = system.type_name in ("s3", "gcs", "abfs")
    target = path if straight else f"{path}.{uuid.uuid4().hex}.part"
    system.create_dir(posixpath.dirname(path), recursive=True)
    with system.open_output_stream(target) as out:
        out.write(body)
    if not straight:
        system.move(target, path)


def put(objects: DataFrame, root: str) -> DataFrame:
    """(key, uri, bytes, sha256) of the objects (key, content, content_type, sha256), which are stored when this returns.

    A given sha256 must be that of the content; null: not compared. Putting the same key again replaces the object, so a task
    that is run again does no harm. A null content is an empty object."""

    def run(batches):
        system, base = _open(root)
        for batch in batches:
            for x in batch.to_pylist():
                path, body = path_of(base, x["key"]), bytes(x["content"] or b"")
                digest = hashlib.sha256(body).hexdigest()
                if x["sha256"] not in (None, digest):
                    raise ValueError(f"{x['key']!r}: content has another sha256 than was given")
                _store(system, path, body)
                _store(system, path + SIDECAR, json.dumps({"sha256": digest, "contentType": x["content_type"], "bytes": len(body)}).encode())
                yield pa.RecordBatch.from_pylist([{"key": x["key"], "uri": path_of(root, x["key"]), "bytes": len(body), "sha256": digest}])

    return written(objects.select("key", "content", "content_type", "sha256").mapInArrow(run, "key string, uri string, bytes long, sha256 string"), "manifest")


def head(keys: DataFrame, root: str) -> DataFrame:
    """(key, bytes, sha256): bytes is null where there is no object, sha256 where nothing was noted beside it."""

    def run(batches):
        system, base = _open(root)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            paths = [path_of(base, k) for k in keys]
            sizes = [f.size if f.is_file else None for f in system.get_file_info(paths)]
            notes = [f.is_file for f in system.get_file_info([p + SIDECAR for p in paths])]
            sha = [json.loads(system.open_input_stream(p + SIDECAR).read()).get("sha256") if n and s is not None else None for p, s, n in zip(paths, sizes, notes, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sizes, pa.int64()), pa.array(sha, pa.string())], names=["key", "bytes", "sha256"])

    return keys.select("key").mapInArrow(run, "key string, bytes long, sha256 string")


def get(keys: DataFrame, root: str) -> DataFrame:
    """(key, content) of the keys; a key without an object is an error."""

    def run(batches):
        system, base = _open(root)
        for batch in batches:
            for key in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"key": [key], "content": pa.array([system.open_input_stream(path_of(base, key)).read()], pa.binary())})

    return keys.select("key").mapInArrow(run, "key string, content binary")


def read(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, content) of all objects below the root, by Spark's own reader. Notes beside them are left out, and so
    are empty objects, for which that reader makes no task: `head` and `get` know those."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.where(~F.col("path").endswith(SIDECAR) & ~F.col("path").endswith(".part")).select("path", F.col("length").alias("bytes"), "content")
