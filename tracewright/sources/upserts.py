"""A table on files that is merged by key, a batch at a time, and that a repeated batch does not change.

Each batch is written to a folder of its own and becomes part of the table when its manifest is created. A manifest
lists the folders that make up one version, oldest first; of the rows with equal keys the one in the last folder counts. Eight
folders of a level are merged into one of the next, so each row is written again once a level, not with each batch.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN_IN = 8


class UpsertTable:
    """A table below ``path`` whose rows are unique in ``keys``; ``schema`` has all columns."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, fan_in: int = FAN_IN) -> None:
        self.spark, self.path, self.keys, self.schema, self.fan_in = spark, path.rstrip("/"), keys, schema, fan_in

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Numbers of the batches that are part of the table."""
        files, folder = self._file("manifests")
        if not files.exists(folder):
            return []
        names = [f.getPath().getName() for f in files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _folders(self, version: int | None) -> list[dict]:
        if version is None:
            return []
        text = self.spark.read.text(f"{self.path}/manifests/{version}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, version: int, folders: list[dict]) -> bool:
        """Create the manifest in one step; False if another writer did so before."""
        files, draft = self._file(f"drafts/{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        _, path = self._file(f"manifests/{version}.json")
        files.mkdirs(path.getParent())
        return not files.exists(path) and files.rename(draft, path)

    def upsert(self, rows: DataFrame, batch: int) -> bool:
        """Merge ``rows``, unique in the keys, as batch number ``batch``; False, and nothing changes, if it is part already.

        Batches come in the order of their numbers. A batch that was written but not committed is written anew.
        """
        known = self.versions()
        if known and batch <= known[-1]:
            if batch in known:
                return False
            raise ValueError(f"batch {batch} after batch {known[-1]}")
        folders = self._folders(known[-1] if known else None)
        name = f"data/{batch}-{uuid.uuid4().hex}"
        rows.select(*[f.name for f in self._types()]).write.parquet(f"{self.path}/{name}")
        folders.append({"folder": name, "level": 0})
        while len(last := self._tail(folders)) >= self.fan_in:
            merged = f"data/{batch}-{uuid.uuid4().hex}"
            self._merged(last).write.parquet(f"{self.path}/{merged}")
            folders = folders[: -len(last)] + [{"folder": merged, "level": last[0]["level"] + 1}]
        return self._commit(batch, folders)

    def _types(self):
        return self.spark.createDataFrame([], self.schema).schema

    @staticmethod
    def _tail(folders: list[dict]) -> list[dict]:
        """The last folders of one level."""
        at = len(folders)
        while at and folders[at - 1]["level"] == folders[-1]["level"]:
            at -= 1
        return folders[at:]

    def _merged(self, folders: list[dict]) -> DataFrame:
        schema = self._types()
        if not folders:
            return self.spark.createDataFrame([], schema)
        parts = None
        for age, folder in enumerate(folders):
            part = self.spark.read.schema(schema).parquet(f"{self.path}/{folder['folder']}").withColumn("_age", F.lit(age))
            parts = part if parts is None else parts.unionByName(part)
        rest = [f.name for f in schema if f.name not in self.keys]
        last = F.max_by(F.struct(*rest), "_age").alias("_last")
        return parts.groupBy(*self.keys).agg(last).select(*self.keys, "_last.*").select(*[f.name for f in schema])

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of the batch ``version``, the last one by default."""
        known = self.versions()
        if version is not None and version not in known:
            raise ValueError(f"no version {version}")
        return self._merged(self._folders(known[-1] if version is None and known else version))

    def vacuum(self, keep: int = 1) -> None:
        """Forget all but the last ``keep`` versions and delete folders that none of them lists."""
        known = self.versions()
        stay = known[len(known) - keep :] if keep else []
        used = {f["folder"] for v in stay for f in self._folders(v)}
        for version in known:
            if version not in stay:
                files, path = self._file(f"manifests/{version}.json")
                files.delete(path, False)
        files, data = self._file("data")
        if files.exists(data):
            for status in files.listStatus(data):
                if f"data/{status.getPath().getName()}" not in used:
                    files.delete(status.getPath(), True)
