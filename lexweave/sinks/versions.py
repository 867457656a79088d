"""Tables whose files never change, and versions that say which files count.

A folder holds for each table data files in generations, and a manifest for each version.
A manifest lists the live files of all tables and is written last, under a name that must
not exist yet.  So the changes of a run become visible together, a reader that has read a
manifest sees one version until its files expire, and of two writers that start from the
same version one fails.

Rows lie in buckets by the hash of their keys.  A change rewrites the files that hold rows
with an affected key, and no others; new rows go to files of their own, until a bucket has
more than ``FILES_PER_BUCKET`` of them and is written together.
"""

from __future__ import annotations

import json
from collections.abc import Collection, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexweave.operators.rows import small_side
from lexweave.storage import materialize

BUCKETS = 64
FILES_PER_BUCKET = 8
MAX_BROADCAST_KEYS = 500_000
_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer made the next version first."""


@dataclass(frozen=True)
class Table:
    """The live files of a table: paths under the store's folder, by bucket."""

    schema: str
    keys: tuple[str, ...]
    format: str = "parquet"
    buckets: int = BUCKETS
    files: dict[int, tuple[str, ...]] = field(default_factory=dict)

    def struct(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))


@dataclass(frozen=True)
class Manifest:
    """A version: its tables, and facts of the runs that made it, by run."""

    version: int = 0
    tables: dict[str, Table] = field(default_factory=dict)
    runs: dict[str, dict] = field(default_factory=dict)

    def to_json(self) -> str:
        tables = {
            name: {
                "schema": t.schema,
                "keys": list(t.keys),
                "format": t.format,
                "buckets": t.buckets,
                "files": {str(b): list(paths) for b, paths in sorted(t.files.items())},
            }
            for name, t in self.tables.items()
        }
        return json.dumps({"version": self.version, "tables": tables, "runs": self.runs})

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        raw = json.loads(text)
        tables = {
            name: Table(
                t["schema"],
                tuple(t["keys"]),
                t["format"],
                t["buckets"],
                {int(b): tuple(paths) for b, paths in t["files"].items()},
            )
            for name, t in raw["tables"].items()
        }
        return cls(raw["version"], tables, raw["runs"])


class Versions:
    """The versions under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # -- the file system that Spark itself would use

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _system(self):
        return self._path(self.root).getFileSystem(self._conf)

    def _names(self, folder: str) -> list[str]:
        path, system = self._path(folder), self._system()
        if not system.exists(path):
            return []
        return [status.getPath().getName() for status in system.listStatus(path)]

    def files_under(self, folder: str) -> list[str]:
        """Data files below a generation's folder, as paths from the root."""
        system, root = self._system(), self._path(f"{self.root}/{folder}")
        if not system.exists(root):
            return []
        found, listed = [], system.listFiles(root, True)
        while listed.hasNext():
            path = listed.next().getPath()
            if path.getName().startswith("part-"):
                found.append(f"{folder}/{path.getParent().getName()}/{path.getName()}")
        return sorted(found)

    # -- versions

    def numbers(self) -> list[int]:
        names = self._names(f"{self.root}/manifests")
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """A version, by default the last one; of an empty folder version 0 without tables."""
        if version is None:
            version = max(self.numbers(), default=0)
        if version == 0:
            return Manifest()
        path = f"{self.root}/manifests/{version:012d}.json"
        return Manifest.from_json(self.spark.read.text(path, wholetext=True).collect()[0][0])

    def commit(self, manifest: Manifest) -> Manifest:
        """Make the version after ``manifest`` with its tables and runs."""
        done = replace(manifest, version=manifest.version + 1)
        folder, system = f"{self.root}/manifests", self._system()
        target = self._path(f"{folder}/{done.version:012d}.json")
        if system.exists(target):
            raise Conflict(f"version {done.version} exists")
        attempt = self._jvm.java.util.UUID.randomUUID().toString()
        written = self._path(f"{folder}/_{attempt}")
        stream = system.create(written, False)
        stream.write(bytearray(done.to_json().encode()))
        stream.close()
        fs = self._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
        try:
            # Refuses to replace a file.
            context = fs.FileContext.getFileContext(system.getUri(), self._conf)
            context.rename(system.makeQualified(written), system.makeQualified(target), none)
        except Exception as failure:
            system.delete(written, False)
            raise Conflict(f"version {done.version} exists") from failure
        return done

    def read(self, name: str, manifest: Manifest | None = None) -> DataFrame:
        """A table as of a version; one that does not change while it is read."""
        table = (manifest or self.manifest()).tables[name]
        return self.read_files(table, [p for paths in table.files.values() for p in paths])

    def read_files(self, table: Table, paths: Sequence[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], table.struct())
        reader = self.spark.read.schema(table.struct()).option("recursiveFileLookup", True)
        return reader.format(table.format).load([f"{self.root}/{p}" for p in paths])

    def replaced(
        self,
        table: Table,
        generation: str,
        incoming: DataFrame,
        gone: DataFrame | None = None,
    ) -> Table:
        """The table with the incoming rows in the place of all rows that share their keys,
        and without those that share the keys of ``gone``.

        Writes files of ``generation`` (anew if an earlier attempt left some) and changes
        nothing that counts: the result does so with the manifest that lists it.
        """
        keys, columns = list(table.keys), table.struct().names
        bucket = _bucket_of(table)
        rows = materialize(
            incoming.select(*columns).withColumn(_BUCKET, bucket), "incoming-rows"
        )
        named = rows.select(*keys)
        if gone is not None:
            named = named.unionByName(gone.select(*keys))
        affected, candidates = self._affected(table, named)
        holders = self._holders(table, candidates, affected)
        for paths in candidates.values():
            if len(paths) > FILES_PER_BUCKET:
                holders |= set(paths)
        rest = _joined(self.read_files(table, sorted(holders)), affected, keys, "left_anti")
        rows = rest.withColumn(_BUCKET, bucket).unionByName(rows)
        return self._with_files(table, self._written(table, generation, rows), holders)

    def placed(
        self,
        table: Table,
        generation: str,
        rows: DataFrame,
        bucket: str,
        emptied: Collection[int] = (),
    ) -> Table:
        """The table with more rows in the buckets that a column of theirs names, and none
        of the files of the ``emptied`` buckets.  As ``replaced``, it changes nothing yet."""
        rows = rows.select(*table.struct().names, F.col(bucket).cast("int").alias(_BUCKET))
        left = {p for b in emptied for p in table.files.get(b, ())}
        return self._with_files(table, self._written(table, generation, rows), left)

    def _written(self, table: Table, generation: str, rows: DataFrame) -> list[str]:
        """Write rows by bucket; range partitioning also splits a bucket of many rows."""
        (
            rows.repartitionByRange(_BUCKET, *table.keys)
            .sortWithinPartitions(_BUCKET, *table.keys)
            .write.partitionBy(_BUCKET)
            .option("ignoreNullFields", False)
            .mode("overwrite")
            .format(table.format)
            .save(f"{self.root}/{generation}")
        )
        return self.files_under(generation)

    def _with_files(self, table: Table, added: list[str], left: set[str]) -> Table:
        files = {b: tuple(p for p in paths if p not in left) for b, paths in table.files.items()}
        for path in added:
            number = int(path.split(f"{_BUCKET}=")[1].split("/")[0])
            files[number] = (*files.get(number, ()), path)
        return replace(table, files={b: paths for b, paths in files.items() if paths})

    def matching(self, name: str, wanted: DataFrame, manifest: Manifest) -> DataFrame:
        """The rows of a table that share their keys with ``wanted``; reads the buckets they
        can lie in."""
        table = manifest.tables[name]
        affected, candidates = self._affected(table, wanted.select(*table.keys))
        paths = [p for found in candidates.values() for p in found]
        return _joined(self.read_files(table, paths), affected, list(table.keys), "left_semi")

    def _affected(self, table: Table, named: DataFrame) -> tuple[DataFrame, dict]:
        """Distinct keys, and the files of the buckets they lie in."""
        affected = small_side(named.distinct(), "affected-keys", MAX_BROADCAST_KEYS)
        hit = {r[0] for r in affected.select(_bucket_of(table)).distinct().collect()}
        return affected, {b: paths for b, paths in table.files.items() if b in hit}

    def _holders(self, table: Table, candidates: dict, affected: DataFrame) -> set[str]:
        """The candidate files with a row whose keys are affected."""
        paths = [p for found in candidates.values() for p in found]
        keys = list(table.keys)
        live = self.read_files(table, paths)
        if not paths:
            return set()
        live = live.select(*keys, F.col("_metadata.file_path").alias("_file"))
        hit = _joined(live, affected, keys, "left_semi").select("_file").distinct()
        # Bucket and file name: names hold the id of the job that wrote them.
        ends = {"/".join(r[0].rsplit("/", 2)[-2:]) for r in hit.collect()}
        return {p for p in paths if "/".join(p.rsplit("/", 2)[-2:]) in ends}

    def expire(self, keep: int = 2) -> int:
        """Delete all but the last versions, and the files that only they list."""
        numbers = self.numbers()
        old, kept = numbers[:-keep], numbers[-keep:]

        def listed(version: int) -> set[str]:
            tables = self.manifest(version).tables.values()
            return {p for t in tables for paths in t.files.values() for p in paths}

        live = set().union(*[listed(v) for v in kept])
        dead = set().union(*[listed(v) for v in old]) - live
        system = self._system()
        for version in old:
            system.delete(self._path(f"{self.root}/manifests/{version:012d}.json"), False)
        for path in dead:
            system.delete(self._path(f"{self.root}/{path}"), False)
        return len(dead)


def _bucket_of(table: Table) -> Column:
    return F.pmod(F.xxhash64(*table.keys), F.lit(table.buckets)).cast("int")


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A semi or anti join in which null equals null."""
    equal = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return left.alias("l").join(right.alias("r"), equal, how)


def empty_table(
    schema: StructType, keys: Sequence[str], fmt: str = "parquet", buckets: int = BUCKETS
) -> Table:
    return Table(schema.json(), tuple(keys), fmt, buckets)
