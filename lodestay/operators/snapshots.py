"""Versioned tables: every write is a folder of its own, and a manifest that is swapped last says which one counts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lodestay.storage import delete

_MANIFEST = "_manifest.json"


class Snapshots:
    """The versions of one table below ``path``. Readers see a version whole or not at all.

    A commit writes its rows first and then swaps the manifest in one rename, so a crash in between leaves the table as it was; what
    it wrote goes with the next ``prune``. Of two commits that began at the same version, the one that swaps last fails if it
    notices the other; between its look and its swap it does not, so a table should have one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = self._root().getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _root(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.path)

    def manifest(self) -> dict:
        """{current, versions: [{version, folder, rows, schema, note}]}, the oldest first."""
        where = self._file(_MANIFEST)
        if not self.fs.exists(where):
            return {"current": None, "versions": []}
        stream = self.fs.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _swap(self, manifest: dict, begun: int | None) -> None:
        if self.manifest()["current"] != begun:
            raise RuntimeError("another commit came first; read again and repeat")
        draft = self._file(f"_draft-{uuid.uuid4().hex}.json")
        stream = self.fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        overwrite = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(draft, self._file(_MANIFEST), overwrite)

    @property
    def current(self) -> int | None:
        return self.manifest()["current"]

    def versions(self) -> list[int]:
        return [v["version"] for v in self.manifest()["versions"]]

    def commit(self, rows: DataFrame, note: str = "", partition_by: list[str] | None = None) -> int:
        """Write ``rows`` as the next version, make it the current one, and return its number. ``rows`` may read this table."""
        before = self.manifest()
        folder = f"v-{uuid.uuid4().hex}"
        # Dealt by the folders they go to, so that each folder has few files.
        writer = rows.repartition(*partition_by).write.partitionBy(*partition_by) if partition_by else rows.write
        writer.parquet(f"{self.path}/{folder}")
        version = max([0, *(v["version"] for v in before["versions"])]) + 1
        entry = {"version": version, "folder": folder, "schema": rows.schema.json(), "note": note}
        self._swap({"current": version, "versions": [*before["versions"], entry]}, before["current"])
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, or of the current one."""
        now = self.manifest()
        wanted = now["current"] if version is None else version
        entry = next((v for v in now["versions"] if v["version"] == wanted), None)
        if entry is None:
            raise KeyError(f"no version {wanted} of {self.path}")
        return self.spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(f"{self.path}/{entry['folder']}")

    def undo(self, to: int | None = None) -> int:
        """Make an earlier version the current one (the one before it, unless named) and return its number; nothing is deleted."""
        now = self.manifest()
        earlier = [v["version"] for v in now["versions"] if now["current"] is not None and v["version"] < now["current"]]
        wanted = (earlier[-1] if earlier else None) if to is None else to
        if wanted not in self.versions():
            raise KeyError(f"no version to go back to in {self.path}")
        self._swap({**now, "current": wanted}, now["current"])
        return wanted

    def prune(self, keep: int) -> list[int]:
        """Delete all but the ``keep`` newest versions, the current one always stays, and all that crashed commits left."""
        now = self.manifest()
        kept = [v for i, v in enumerate(reversed(now["versions"])) if i < keep or v["version"] == now["current"]][::-1]
        gone = [v["version"] for v in now["versions"] if v not in kept]
        if gone:
            self._swap({**now, "versions": kept}, now["current"])
        names = {v["folder"] for v in kept} | {_MANIFEST}
        if self.fs.exists(self._root()):
            for status in self.fs.listStatus(self._root()):
                name = status.getPath().getName()
                if name not in names and name.startswith(("v-", "_draft-")):
                    delete(self.spark, f"{self.path}/{name}")
        return gone
