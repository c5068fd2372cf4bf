"""Full reloads of a set of tables that are seen whole or not at all.

A reload writes every table into a folder of its own and checks it; the manifest that names the folder comes last. Readers take the
manifest with the highest number, or the one they were given, so a reload that fails, or one that runs beside them, changes nothing for
them. Nothing is written twice or moved.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Tables = dict[str, DataFrame]


class ReloadFailed(RuntimeError):
    pass


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _files(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def _write(spark: SparkSession, path: str, content: bytes) -> None:
    """A new file; one that is there already is an error."""
    fs, at = _files(spark, path)
    out = fs.create(at, False)
    out.write(content)
    out.close()


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions, ascending."""
    return [int(n.removesuffix(".json")) for n in _names(spark, f"{root}/manifests") if n.endswith(".json")]


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """Folder, and of each table rows and schema, of a version, else of the latest."""
    known = versions(spark, root)
    if not known or (version is not None and version not in known):
        raise ReloadFailed(f"no version {version if version is not None else 'at all'} below {root}")
    number = known[-1] if version is None else version
    return json.loads(spark.read.text(f"{root}/manifests/{number:08d}.json", wholetext=True).first()[0]) | {"version": number}


def open_tables(spark: SparkSession, root: str, version: int | None = None) -> Tables:
    """The tables of one version: the same files however often they are read, whatever is published meanwhile."""
    found = manifest(spark, root, version)
    return {n: spark.read.schema(StructType.fromJson(t["schema"])).parquet(f"{root}/{found['folder']}/{n}") for n, t in found["tables"].items()}


def publish(spark: SparkSession, root: str, build: dict[str, Callable[[Tables], DataFrame]], check: Callable[[Tables], DataFrame] | None = None) -> int:
    """Builds the tables in order, each from those written before it, and publishes them under the next number.

    check gives rows (name, passed, ...) of the written tables; one that has not passed, like any error before, leaves the version before
    in force. Of two reloads that end together one fails. Returns the version's number.
    """
    folder = f"data/{uuid.uuid4().hex}"
    done: Tables = {}
    facts: dict[str, dict] = {}
    for name, make in build.items():
        df = make(done)
        path = f"{root}/{folder}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        done[name] = spark.read.schema(df.schema).parquet(path)
        facts[name] = {"n_rows": done[name].count(), "schema": df.schema.jsonValue()}
    if check is not None:
        failed = [r.name for r in check(done).where(~F.col("passed")).select("name").limit(20).collect()]
        if failed:
            raise ReloadFailed(f"not published, these failed: {', '.join(failed)}")
    taken = [int(n.partition(".")[0]) for n in _names(spark, f"{root}/manifests") if n[0].isdigit()]
    number = max(taken, default=0) + 1
    place = f"{root}/manifests/{number:08d}"
    _write(spark, f"{place}.claim", b"")  # only one reload gets the number
    _write(spark, f"{place}.part", json.dumps({"folder": folder, "tables": facts}).encode())
    fs, part = _files(spark, f"{place}.part")
    if not fs.rename(part, spark._jvm.org.apache.hadoop.fs.Path(f"{place}.json")):
        raise ReloadFailed(f"version {number} could not be published")
    return number


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Deletes all folders but those of the latest `keep` versions, what failed reloads left among them, and the others' manifests.

    Not while a reload runs: its folder has no manifest yet. Returns the deleted folders.
    """
    if keep < 1:
        raise ValueError("the latest version stays")
    known = versions(spark, root)
    stay = {manifest(spark, root, v)["folder"] for v in known[-keep:]}
    for v in known[:-keep]:
        fs, at = _files(spark, f"{root}/manifests/{v:08d}.json")
        fs.delete(at, False)
    gone = [f"data/{n}" for n in _names(spark, f"{root}/data") if f"data/{n}" not in stay]
    for folder in gone:
        fs, at = _files(spark, f"{root}/{folder}")
        fs.delete(at, True)
    return gone
