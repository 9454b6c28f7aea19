"""A map of a code base as Parquet tables with a manifest, which is written last and says what there is."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orrery.operators import find_index, resolve

SCHEMA_VERSION = 1
MANIFEST = "manifest.json"

EMPTY = {
    "files": "path string, lang string, rank int, scan_pos int, size long, est_tokens long, line_count long",
    "ast_edges": "src string, dst string, kind string",
    "llm_edges": "src string, dst string, kind string",
    "modules": "path string, name string, description string, role double, degree long",
    "file_summaries": "path string, summary string, symbols array<struct<name:string,kind:string,description:string>>",
    "entry_points": "path string, name string, kind string, description string",
    "quick_reference": "query string, location string",
    "data_flow": "source string, destination string, description string",
    "db_tables": "name string, columns array<struct<name:string,type:string,constraints:string>>, description string",
    "tests": "file string, covers string",
    "notes": "note string",
    "evidence": "path string, score double",
    "file_importance": "path string, role double, degree long, fused double",
    "cycles": "nodes array<string>, length int, risk_score double, test_only boolean",
}


@dataclass
class CodeMapTables:
    """The tables of a map. A table that was not made is None, which is not the same as an empty one."""

    tables: dict[str, DataFrame | None]
    meta: dict = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        t = self.tables.get(name)
        return t if t is not None else self.empty(name)

    def empty(self, name: str) -> DataFrame:
        spark = next((t.sparkSession for t in self.tables.values() if t is not None), None) or SparkSession.getActiveSession()
        return spark.createDataFrame([], EMPTY[name])

    def has(self, name: str) -> bool:
        return self.tables.get(name) is not None


def _refuse_links(path: str) -> None:
    at = os.path.abspath(path)
    while True:
        if os.path.islink(at):
            raise ValueError(f"{at} is a link; nothing is written through it")
        up = os.path.dirname(at)
        if up == at:
            return
        at = up


def write_map(m: CodeMapTables, folder: str) -> None:
    """Write all tables into a new version of the folder; then the manifest; then drop older versions.

    The folder must be shared by the driver and the executors. A reader sees the old map until the manifest is replaced.
    """
    _refuse_links(folder)
    os.makedirs(folder, exist_ok=True)
    version = f"v-{uuid.uuid4().hex}"
    for name, t in m.tables.items():
        if t is not None:
            t.write.parquet(f"{folder}/{version}/{name}")
    manifest = {"schema_version": SCHEMA_VERSION, "version": version, "tables": {n: t is not None for n, t in m.tables.items()}, "meta": m.meta}
    part = f"{folder}/.{MANIFEST}.{version}"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(manifest, f, ensure_ascii=False, indent=2)
    os.replace(part, f"{folder}/{MANIFEST}")
    for old in os.listdir(folder):
        if old.startswith("v-") and old != version and not os.path.islink(f"{folder}/{old}"):
            shutil.rmtree(f"{folder}/{old}", ignore_errors=True)


def load_baseline(spark: SparkSession, folder: str, engine_version: str | None = None) -> tuple[CodeMapTables | None, str]:
    """The map in a folder and its state: first_run (there is none), uncomparable (it cannot be read), version_changed, normal."""
    path = f"{folder}/{MANIFEST}"
    if not os.path.lexists(path):
        return None, "first_run"
    try:
        with open(path, encoding="utf-8") as f:
            manifest = json.load(f)
        if not isinstance(manifest, dict) or manifest.get("schema_version") is True or manifest.get("schema_version") != SCHEMA_VERSION:
            return None, "uncomparable"
        tables = {n: spark.read.parquet(f"{folder}/{manifest['version']}/{n}") if there else None for n, there in manifest["tables"].items()}
        if any(t is not None and n in EMPTY and not set(StructType.fromDDL(EMPTY[n]).names) <= set(t.columns) for n, t in tables.items()):
            return None, "uncomparable"
    except Exception:
        return None, "uncomparable"
    changed = manifest["meta"].get("engine_version") != engine_version if engine_version else False
    return CodeMapTables(tables, manifest["meta"]), "version_changed" if changed else "normal"


def load_map(spark: SparkSession, folder: str) -> CodeMapTables:
    m, state = load_baseline(spark, folder)
    if m is None:
        raise FileNotFoundError(f"no readable map in {folder} ({state})")
    return m


class CachedMap:
    """A map that is read again when its manifest changes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._at, self._map = spark, folder, None, None

    def get(self) -> CodeMapTables:
        st = os.stat(f"{self.folder}/{MANIFEST}")
        at = st.st_mtime_ns, st.st_ino
        if at != self._at:
            self._map, self._at = load_map(self.spark, self.folder), at
        return self._map


def as_json(m: CodeMapTables) -> DataFrame:
    """``name, value``: each table but the indexes as JSON lines; nulls are left out of tables and kept in meta."""
    spark = next(t.sparkSession for t in m.tables.values() if t is not None)
    out = spark.createDataFrame([("meta", json.dumps(m.meta, ensure_ascii=False))], "name string, value string")
    for name, t in m.tables.items():
        if t is not None and name not in find_index.TABLES and name not in resolve.PATH_TABLES:
            out = out.unionByName(t.select(F.lit(name).alias("name"), F.to_json(F.struct(*t.columns), {"ignoreNullFields": "true"}).alias("value")))
    return out
