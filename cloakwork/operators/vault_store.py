"""A vault kept in files: snapshots of hash buckets, each batch of changes one transaction.

Entries lie in BUCKETS buckets by a hash of their conversation, however many
conversations there are. A batch rewrites only the buckets that it touches, into a
folder of its own; then a manifest names the folder of every bucket. Readers take the
newest manifest, so a batch is seen as a whole or not at all: a writer that dies
before its manifest leaves files that no manifest names, and the old snapshot. Two
writers of one version can't both place their manifest; the later one fails and
merges again.

Values are stored encrypted; what finds them is a keyed index. With another key for
the index, reindexed() gives every entry its new index in one such batch.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.operators.mask import index_of, sealed, unsealed
from cloakwork.operators.tables import materialised

BUCKETS = 64
STORED = "conv_id string, label string, fake string, sealed_real binary, expires_at double, idx string"


class VaultStore:
    """folder: shared by driver and executors. seal: the key of the values (16, 24 or 32 bytes)."""

    def __init__(self, spark: SparkSession, folder: str, seal: bytes, buckets: int = BUCKETS):
        self.spark, self.folder, self.seal, self.buckets = spark, folder.rstrip("/"), seal, buckets
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        found = self.files.globStatus(self.path(f"{self.folder}/manifest-*.json"))
        return sorted(int(s.getPath().getName()[9:-5]) for s in found or [])

    def manifest(self) -> tuple[int, dict[int, str]]:
        """The newest version, and the folder of each bucket that has entries."""
        versions = self._manifests()
        if not versions:
            return 0, {}
        stream = self.files.open(self.path(f"{self.folder}/manifest-{versions[-1]}.json"))
        try:
            held = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return versions[-1], {int(b): f for b, f in held.items()}

    def _place(self, version: int, folders: dict[int, str]) -> None:
        """Makes a manifest the newest: written beside its place, then moved there at once. Fails if another writer was first."""
        draft = self.path(f"{self.folder}/draft-{uuid.uuid4().hex}")
        stream = self.files.create(draft, False)
        stream.write(json.dumps(folders).encode())
        stream.close()
        place = self.path(f"{self.folder}/manifest-{version}.json")
        if self.files.exists(place) or not self.files.rename(draft, place):
            self.files.delete(draft, False)
            raise RuntimeError(f"version {version} of the vault is there already: merge again")

    def _read(self, folders: dict[int, str], buckets: list[int] | None = None) -> DataFrame:
        names = [f"{self.folder}/{f}/bucket={b}" for b, f in folders.items() if buckets is None or b in buckets]
        found = self.spark.read.schema(STORED).parquet(*names) if names else self.spark.createDataFrame([], STORED)
        return found

    def bucket(self, conv: Column) -> Column:
        return F.pmod(F.xxhash64(conv), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        """conv_id, label, real, fake, idx, expires_at of the newest snapshot."""
        return unsealed(self._read(self.manifest()[1]), self.seal)

    def merge(self, entries: DataFrame) -> int:
        """A batch of entries (conv_id, label, real, fake, idx, expires_at) as one transaction: each takes the place of the one of its
        conversation and index; of several in a batch the one that expires last. Gives the new version."""
        last = F.struct("expires_at", "fake", "label", "sealed_real")
        new = sealed(entries, self.seal).groupBy("conv_id", "idx").agg(F.max_by(last, F.struct("expires_at", "fake")).alias("e"))
        new = materialised(new.select("conv_id", "e.label", "e.fake", "e.sealed_real", "e.expires_at", "idx").withColumn("bucket", self.bucket(F.col("conv_id"))))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        version, folders = self.manifest()
        old = self._read(folders, touched).join(new.select("conv_id", "idx"), ["conv_id", "idx"], "left_anti")
        return self._write(version, folders, old.withColumn("bucket", self.bucket(F.col("conv_id"))).unionByName(new), touched)

    def _write(self, version: int, folders: dict[int, str], rows: DataFrame, buckets: list[int]) -> int:
        """rows are all that the buckets hold from now on."""
        folder = f"data-{uuid.uuid4().hex}"
        rows.repartition("bucket").sortWithinPartitions("bucket", "conv_id").write.partitionBy("bucket").parquet(f"{self.folder}/{folder}")
        kept = {b: f for b, f in folders.items() if b not in buckets}
        written = [s.getPath().getName() for s in self.files.listStatus(self.path(f"{self.folder}/{folder}")) if s.isDirectory()]
        self._place(version + 1, kept | {int(n.split("=")[1]): folder for n in written})
        return version + 1

    def purge(self, now: Column, conv_ids: list[str] | None = None) -> int:
        """Takes out what has expired, and the conversations named."""
        version, folders = self.manifest()
        rows = self._read(folders).where(F.col("expires_at") > now)
        if conv_ids:
            rows = rows.where(~F.col("conv_id").isin(*conv_ids))
        return self._write(version, folders, rows.withColumn("bucket", self.bucket(F.col("conv_id"))), list(folders))

    def reindexed(self, key: bytes) -> int:
        """Every entry found by an index of another key: for when the old one is lost."""
        version, folders = self.manifest()
        rows = self._read(folders)
        real = F.aes_decrypt("sealed_real", F.lit(self.seal), F.lit("GCM")).cast("string")
        rows = rows.withColumn("idx", index_of(key, F.col("label"), real)).withColumn("bucket", self.bucket(F.col("conv_id")))
        return self._write(version, folders, rows, list(folders))

    def clean(self, keep: int = 2) -> None:
        """Deletes manifests but the newest ones, and data that none of these name: only while no batch is being written."""
        versions = self._manifests()
        named = set()
        for v in versions[-keep:]:
            stream = self.files.open(self.path(f"{self.folder}/manifest-{v}.json"))
            named |= set(json.loads(bytes(stream.readAllBytes()).decode()).values())
            stream.close()
        for v in versions[:-keep]:
            self.files.delete(self.path(f"{self.folder}/manifest-{v}.json"), False)
        for s in self.files.globStatus(self.path(f"{self.folder}/data-*")) or []:
            if s.getPath().getName() not in named:
                self.files.delete(s.getPath(), True)
