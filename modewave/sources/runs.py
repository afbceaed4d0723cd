"""Published runs: written aside, then renamed; never overwritten; known by hashes."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import require
from ..functions.scalar import canonical_json, json_ready, safe_label_text, sha256_json


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    data = spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)
    stream.close()
    return bytes(data).decode()


def publish(spark: SparkSession, final: str, write: Callable[[str], None]) -> str:
    """``write`` fills a folder aside, which then takes the final name; on failure only that folder goes."""
    require(not exists(spark, final), f"{final} exists")
    parent, _, name = final.rstrip("/").rpartition("/")
    aside = f"{parent}/.{name}.partial-{uuid.uuid4().hex}"
    fs, p = _fs(spark, aside)
    fs.mkdirs(p)
    try:
        write(aside)
        require(not exists(spark, final), f"{final} exists")
        require(bool(fs.rename(p, _fs(spark, final)[1])), f"{aside} could not be renamed")
    except BaseException:
        fs.delete(p, True)
        raise
    return final


def write_tables(folder: str, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, run: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{run}/{n}") for n in names}


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    write_text(spark, path, json.dumps(json_ready(value), ensure_ascii=False, sort_keys=True, indent=2))


def read_metadata(spark: SparkSession, run: str) -> dict[str, Any]:
    return json.loads(read_text(spark, f"{run}/metadata.json"))


def science_hash(config: dict[str, Any]) -> str:
    """Of all that bears on results; figures don't."""
    return sha256_json(config, without=("figures",))


def run_id(label: str, config: dict[str, Any], months: list[tuple[str, str]]) -> str:
    """The label and the first digits of a hash of the configuration and the sources."""
    digest = sha256_json({"config": {k: v for k, v in config.items() if k != "figures"}, "months": [list(m) for m in months]})
    return f"{safe_label_text(label)}_{digest[:12]}"


def same_science(spark: SparkSession, run: str, config: dict[str, Any]) -> str:
    """The hash that a run was made under; raises if the configuration at hand is another."""
    stored = science_hash(json.loads(read_text(spark, f"{run}/config.json")))
    require(stored == science_hash(config), "the configuration is not the run's")
    return stored


def selection(spark: SparkSession, root: str, config: dict[str, Any], *, allow_legacy: bool = True) -> tuple[str, str | None]:
    """What becomes of a configuration among the published runs of its label, and the run.

    exact: one run of the same science. pending: none of the label. legacy: one run of another science, where that may stand in
    for it. stale: runs of another science that may not. More than one run that could be meant raises.
    """
    label = safe_label_text(config["analysis_label"])
    fs, folder = _fs(spark, root)
    found = sorted(str(f.getPath().getName()) for f in fs.listStatus(folder) if f.isDirectory()) if fs.exists(folder) else []
    own = [f"{root}/{n}" for n in found if n.startswith(f"{label}_") and exists(spark, f"{root}/{n}/config.json") and exists(spark, f"{root}/{n}/metadata.json")]
    same = [r for r in own if science_hash(json.loads(read_text(spark, f"{r}/config.json"))) == science_hash(config)]
    require(len(same) <= 1, f"{label}: {len(same)} runs of this configuration")
    if same:
        return "exact", same[0]
    if not own:
        return "pending", None
    if not allow_legacy:
        return "stale", None
    require(len(own) == 1, f"{label}: {len(own)} runs, none of this configuration")
    return "legacy", own[0]


class Stopwatch:
    """Wall times of named stages; a name counts once."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def measure(self, name: str) -> Iterator[None]:
        require(name not in self.seconds, f"stage {name} ran twice")
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = time.perf_counter() - began


class Checkpoint:
    """Tables kept for a run that failed in its solver, bound to the configuration by a hash."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def save(self, key: dict[str, Any], tables: dict[str, DataFrame]) -> None:
        write_tables(self.folder, tables)
        write_json(self.spark, f"{self.folder}/manifest.json", {"key": sha256_json(key), "tables": sorted(tables)})

    def load(self, key: dict[str, Any]) -> dict[str, DataFrame]:
        manifest = json.loads(read_text(self.spark, f"{self.folder}/manifest.json"))
        require(manifest["key"] == sha256_json(key), "the checkpoint belongs to another run")
        return read_tables(self.spark, self.folder, *manifest["tables"])


class RunLog:
    """Events of a command, written as JSON when it ends, with its exit code."""

    def __init__(self, spark: SparkSession, path: str, context: dict[str, Any]):
        self.spark, self.path = spark, path
        self.value: dict[str, Any] = {"context": context, "events": [], "attachments": [], "exit_code": None}

    def event(self, name: str, **details: Any) -> None:
        self.value["events"].append({"name": name, **details})

    def attach(self, path: str) -> None:
        self.value["attachments"].append(path)

    def __enter__(self) -> RunLog:
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.value["exit_code"] = 0 if kind is None else getattr(error, "code", 1) if kind is SystemExit else 1
        write_json(self.spark, self.path, self.value)


__all__ = ["Checkpoint", "RunLog", "Stopwatch", "canonical_json", "exists", "publish", "read_metadata", "read_tables", "read_text", "run_id", "same_science", "science_hash", "selection", "write_json", "write_tables", "write_text"]
