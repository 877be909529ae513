"""Indexes on storage: versioned table directories, a pointer to the current one, and pinned snapshots.

A version is written whole before the pointer moves, so readers see the old or the new state and nothing between. Pointers
are numbered files that are created once and never changed; the newest that is whole counts. Two writers cannot create the
same number, so the later one fails and neither is lost; a writer that dies leaves the pointers before its own in force.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import MISSING, dataclass, fields as attributes

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans.schema import Field, Index


def field_to_json(f: Field) -> dict:
    """What differs from the defaults; ``TypeError`` where that is code (an analyzer or a script that is a function)."""
    out = {}
    for a in attributes(Field):
        v = getattr(f, a.name)
        if a.name == "children":
            v = {n: field_to_json(c) for n, c in v.items()}
        default = a.default if a.default is not MISSING else a.default_factory() if a.default_factory is not MISSING else None
        if v != default:
            json.dumps(v)
            out[a.name] = v
    return out


def field_from_json(d: dict) -> Field:
    return Field(**d | {"children": {n: field_from_json(c) for n, c in d.get("children", {}).items()}})


@dataclass
class Catalog:
    """Indexes below ``root``, any path that Hadoop knows. Fields that hold no code are kept there with the pointers."""

    spark: SparkSession
    root: str

    def __post_init__(self) -> None:
        self.schemas: dict[str, tuple[dict[str, Field], str]] = {}
        self.sorts: dict[str, list[str]] = {}
        fs, p = self._fs(self.root)
        for x in fs.listStatus(p) if fs.exists(p) else []:
            name = x.getPath().getName()
            if kept := self._meta(name).get("schema"):
                self.schemas[name] = {n: field_from_json(f) for n, f in kept["fields"].items()}, kept["id"]
                self.sorts[name] = kept["sort"]

    def _fs(self, path: str) -> tuple:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _pointers(self, name: str) -> list[int]:
        """Numbers of the pointer files, newest first."""
        fs, p = self._fs(f"{self.root}/{name}/pointers")
        found = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted((int(x.removesuffix(".json")) for x in found if x.endswith(".json") and not x.startswith(".")), reverse=True)

    def _meta(self, name: str) -> dict:
        for number in self._pointers(name):
            fs, p = self._fs(f"{self.root}/{name}/pointers/{number}.json")
            stream = fs.open(p)
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            try:
                return json.loads(text) | {"pointer": number}
            except ValueError:  # its writer died or is still at it
                continue
        return {"version": 0, "snapshots": [], "folders": {}, "pointer": 0}

    def _put(self, name: str, meta: dict) -> None:
        """Create the pointer after the one that ``meta`` was read from."""
        number = max([meta.get("pointer", 0), *self._pointers(name)[:1]]) + 1
        newest = self._meta(name)["pointer"]
        fs, p = self._fs(f"{self.root}/{name}/pointers/{number}.json")
        if newest != meta.get("pointer", 0) or fs.exists(p):
            raise RuntimeError(f"another writer has changed index {name}")
        kept = {k: v for k, v in meta.items() if k != "pointer"}
        if name in self.schemas:
            try:
                kept["schema"] = {"fields": {n: field_to_json(f) for n, f in self.schemas[name][0].items()}, "id": self.schemas[name][1], "sort": self.sorts.get(name, [])}
            except TypeError:
                kept.pop("schema", None)
        out = fs.create(p, False)  # fails where the file exists
        out.write(bytearray(json.dumps(kept).encode()))
        out.close()

    def _folder(self, name: str, meta: dict, version: int) -> str:
        return f"{self.root}/{name}/{meta['folders'][str(version)]}"

    def create_index(self, name: str, fields: dict[str, Field], id: str = "doc_id", sort: list[str] | None = None) -> None:
        if name in self.schemas:
            raise ValueError(f"index {name} exists")
        self.schemas[name] = (dict(fields), id)
        self.sorts[name] = sort or []

    def register_fields(self, name: str, fields: dict[str, Field]) -> None:
        known = self.schemas[name][0]
        if clash := set(known) & set(fields):
            raise ValueError(f"fields are registered already: {sorted(clash)}")
        known.update(fields)

    def indices(self) -> list[str]:
        return sorted(self.schemas)

    def stats(self, name: str) -> dict:
        meta = self._meta(name)
        return {"version": meta["version"], "documents": self.open(name).df.count() if meta["version"] else 0, "snapshots": meta["snapshots"], "fields": sorted(self.schemas[name][0])}

    def commit(self, name: str, df: DataFrame, files: int | None = None) -> int:
        """Write ``df`` as the next version and move the pointer; ``files`` compacts."""
        meta = self._meta(name)
        version = meta["version"] + 1
        out = df.coalesce(files) if files else df
        if self.sorts.get(name):
            out = out.sortWithinPartitions(*self.sorts[name])
        folder = f"v={version}-{uuid.uuid4().hex}"
        out.write.parquet(f"{self.root}/{name}/{folder}")
        self._put(name, meta | {"version": version, "folders": meta["folders"] | {str(version): folder}})
        return version

    def open(self, name: str, version: int | None = None) -> Index:
        fields, id = self.schemas[name]
        meta = self._meta(name)
        v = version or meta["version"]
        if str(v) not in meta["folders"]:
            raise ValueError(f"index {name} has no version {v or ''} yet")
        return Index(self.spark.read.parquet(self._folder(name, meta, v)), fields, id, name)

    def force_merge(self, name: str, files: int | None = None, file_bytes: int = 512 << 20) -> int:
        """The current version in files of about ``file_bytes``, or in so many ``files``."""
        if files is None:
            meta = self._meta(name)
            fs, p = self._fs(self._folder(name, meta, meta["version"]))
            files = max(1, math.ceil(fs.getContentSummary(p).getLength() / file_bytes))
        return self.commit(name, self.open(name).df, files)

    def create_snapshot(self, name: str) -> int:
        meta = self._meta(name)
        self._put(name, meta | {"snapshots": sorted({*meta["snapshots"], meta["version"]})})
        return meta["version"]

    def release_snapshot(self, name: str, version: int) -> None:
        meta = self._meta(name)
        self._put(name, meta | {"snapshots": [s for s in meta["snapshots"] if s != version]})

    def clean(self, name: str) -> list[int]:
        """Delete versions that are neither current nor pinned."""
        meta = self._meta(name)
        gone = [int(v) for v in meta["folders"] if int(v) != meta["version"] and int(v) not in meta["snapshots"]]
        old = self._pointers(name)
        if gone:  # the pointer first: no state that counts names a folder that is gone
            self._put(name, meta | {"folders": {v: f for v, f in meta["folders"].items() if int(v) not in gone}})
            for v in gone:
                fs, p = self._fs(self._folder(name, meta, v))
                fs.delete(p, True)
        for number in old[1:]:
            fs, p = self._fs(f"{self.root}/{name}/pointers/{number}.json")
            fs.delete(p, False)
        return sorted(gone)

    def delete_index(self, name: str) -> None:
        fs, p = self._fs(f"{self.root}/{name}")
        fs.delete(p, True)
        self.schemas.pop(name, None)
