"""Named, versioned collections of vectors stored as Parquet.

A collection is split into hash buckets of the id. A change rewrites the
buckets it touches into a new folder and then publishes a small manifest that
names the folder of every bucket. Readers use the manifest they opened, so a
change never disturbs them; two writers of the same version cannot both
publish, and the loser gets a ``ConflictError``.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from larkspur import files
from larkspur.functions.vectors import resolve_metric
from larkspur.operators.relational import latest_per_key, row_tiebreak
from larkspur.session import stage

BUCKET = "bucket"


class ConflictError(RuntimeError):
    """Another writer published the next version first."""


class CollectionMissing(ValueError):
    """No collection of that name."""


@dataclass(frozen=True)
class Manifest:
    """State of one version of a collection."""

    name: str
    dim: int
    metric: str
    n_buckets: int
    version: int = 0
    schema: str | None = None
    folders: dict[str, str] = field(default_factory=dict)
    written: dict[str, int] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)
    index: dict | None = None
    dropped: bool = False


@dataclass(frozen=True)
class WriteReport:
    """What a write did; ``rejected`` holds ``id, reason`` of refused rows."""

    version: int
    written: int
    rejected_rows: int
    rejected: DataFrame | None = None


def bucket_of(id_column: Column, n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(id_column), F.lit(n_buckets)).cast("int")


def fitted(value: Column, given: T.DataType, stored: T.DataType) -> Column:
    """``value`` in the type the ids are stored in, null where it has no equal there.

    The bucket of an id is a hash that differs between types, so ids are compared in one type only.
    """
    if given == stored:
        return value
    if isinstance(given, T.IntegralType) and isinstance(stored, T.IntegralType):
        cast = value.try_cast(stored)
        return F.when(cast.cast("decimal(38,0)") == value.cast("decimal(38,0)"), cast)
    raise ValueError(f"ids are stored as {stored.simpleString()}, given as {given.simpleString()}")


def reject_reason(vector: Column, dim: int) -> Column:
    return (
        F.when(vector.isNull(), F.lit("vector is null"))
        .when(F.size(vector) != dim,
              F.concat(F.lit("vector has "), F.size(vector).cast("string"), F.lit(f" dimensions, expected {dim}")))
    )


def collapse_duplicates(points: DataFrame, order_by: str | None = None) -> DataFrame:
    """One row per id: the one with the highest ``order_by``, then a fixed choice."""
    newest = [F.col(order_by).desc()] if order_by else []
    return latest_per_key(points, ["id"], [*newest, row_tiebreak(points, ["id"]).desc()])


class CollectionStore:
    """Collections below one root path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Manifests

    def _home(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _manifest_names(self, name: str) -> list[str]:
        found = files.names(self.spark, f"{self._home(name)}/manifests")
        return sorted((n for n in found if n.endswith(".json")), reverse=True)

    def manifest(self, name: str, version: int | None = None) -> Manifest:
        """The manifest of a version, the newest one by default."""
        for entry in self._manifest_names(name):
            if version is not None and entry != f"{version:08d}.json":
                continue
            try:
                found = Manifest(**json.loads(files.read(self.spark, f"{self._home(name)}/manifests/{entry}")))
            except json.JSONDecodeError:  # still being written: not published yet
                continue
            if found.dropped:
                break
            return found
        raise CollectionMissing(f"no collection {name!r} below {self.root}")

    def _publish(self, manifest: Manifest) -> Manifest:
        path = f"{self._home(manifest.name)}/manifests/{manifest.version:08d}.json"
        try:
            files.create(self.spark, path, json.dumps(asdict(manifest)))
        except files.FileExists as error:
            raise ConflictError(f"version {manifest.version} of {manifest.name!r} was published by another writer") from error
        return manifest

    def _next_version(self, name: str) -> int:
        entries = self._manifest_names(name)
        return int(entries[0].split(".")[0]) + 1 if entries else 0

    def exists(self, name: str) -> bool:
        try:
            self.manifest(name)
            return True
        except CollectionMissing:
            return False

    def names(self) -> list[str]:
        return sorted(n for n in files.names(self.spark, self.root) if self.exists(n))

    # Reading

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """Rows ``id, vector, ...`` of a version. ``bucket`` is a partition column."""
        manifest = self.manifest(name, version)
        return self._read_buckets(manifest, None)

    def _read_buckets(self, manifest: Manifest, buckets: set[int] | None) -> DataFrame:
        data = f"{self._home(manifest.name)}/data"
        wanted = {b: f for b, f in manifest.folders.items() if buckets is None or int(b) in buckets}
        if not wanted:
            schema = T.StructType.fromJson(json.loads(manifest.schema)) if manifest.schema else T.StructType([
                T.StructField("id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())),
                T.StructField(BUCKET, T.IntegerType())])
            return self.spark.createDataFrame([], schema)
        schema = T.StructType.fromJson(json.loads(manifest.schema))
        reader = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("folder", T.StringType())]))
        paths, by_folder = [], {}
        for bucket, folder in wanted.items():
            by_folder.setdefault(folder, []).append(bucket)
        for folder, live in sorted(by_folder.items()):
            if len(live) == manifest.written.get(folder):  # every bucket of the folder is current
                paths.append(f"{data}/{folder}")
            else:
                paths += [f"{data}/{folder}/{BUCKET}={b}" for b in sorted(live)]
        return reader.option("basePath", data).parquet(*paths).drop("folder")

    def count(self, name: str) -> int:
        return self.read(name).count()

    def describe(self, name: str) -> DataFrame:
        """One row: metric, version, points, vector sizes seen, nulls and whether an index is current."""
        m = self.manifest(name)
        fresh = m.index is not None and m.index.get("version") == m.version
        sizes = self.read(name).agg(
            F.count(F.lit(1)).alias("points"),
            F.min(F.size("vector")).alias("min_dim"),
            F.max(F.size("vector")).alias("max_dim"),
            F.count_if(F.col("vector").isNull()).alias("null_vectors"),
        )
        return sizes.select(
            F.lit(m.name).alias("name"), F.lit(m.metric).alias("metric"), F.lit(m.dim).alias("dim"),
            F.lit(m.version).alias("version"), F.lit(m.n_buckets).alias("n_buckets"), "*",
            F.lit((m.index or {}).get("n_lists")).cast("int").alias("n_lists"),
            F.lit("indexed" if fresh else "stale" if m.index else "none").alias("index_status"),
        )

    # Writing

    def create(self, name: str, dim: int, metric: str = "cosine", n_buckets: int = 64) -> Manifest:
        """Create a collection; an existing one is left as it is."""
        try:
            return self.manifest(name)
        except CollectionMissing:
            pass
        if dim < 1 or n_buckets < 1:
            raise ValueError("dim and n_buckets must be at least 1")
        fresh = Manifest(name, dim, resolve_metric(metric), n_buckets, version=self._next_version(name))
        try:
            return self._publish(fresh)
        except ConflictError:
            return self.manifest(name)

    def _new_folder(self, version: int) -> str:
        return f"folder=v{version:08d}-{uuid.uuid4().hex[:8]}"

    def _write(self, name: str, folder: str, rows: DataFrame) -> None:
        """Add rows that are already laid out by bucket to a folder, one subfolder per bucket."""
        rows.sortWithinPartitions(BUCKET, "id").write.mode("append").partitionBy(BUCKET).parquet(
            f"{self._home(name)}/data/{folder}")

    def _replace_rows(self, name: str, folder: str, old: DataFrame, ids: DataFrame, incoming: DataFrame | None) -> None:
        """Write the old rows without the given ids, and the incoming rows, to a new folder.

        The ids come from a file, so Spark knows their bytes and broadcasts them if they are few: then old rows are
        filtered and rewritten where they are read, and only the incoming rows move.
        """
        self._write(name, folder, old.join(ids, [BUCKET, "id"], "left_anti"))
        if incoming is not None:
            self._write(name, folder, incoming.hint("rebalance", BUCKET))

    def _buckets_in(self, name: str, folder: str) -> set[int]:
        entries = files.names(self.spark, f"{self._home(name)}/data/{folder}")
        return {int(e.split("=")[1]) for e in entries if e.startswith(f"{BUCKET}=")}

    @staticmethod
    def _id_type(manifest: Manifest) -> T.DataType | None:
        if not manifest.schema:
            return None
        return T.StructType.fromJson(json.loads(manifest.schema))["id"].dataType

    def _with_stored_ids(self, rows: DataFrame, manifest: Manifest) -> DataFrame:
        """``rows`` with ids in the type of the collection; ``_given`` tells whether there was one."""
        rows = rows.withColumn("_given", F.col("id").isNotNull())
        stored = self._id_type(manifest)
        return rows if stored is None else rows.withColumn("id", fitted(F.col("id"), rows.schema["id"].dataType, stored))

    def _checked(self, points: DataFrame, manifest: Manifest) -> DataFrame:
        typed = self._with_stored_ids(points.withColumn("vector", F.col("vector").cast("array<float>")), manifest)
        reason = F.when(~F.col("_given"), F.lit("id is null")).when(
            F.col("id").isNull(), F.lit("id does not fit the type of the collection")).otherwise(
            reject_reason(F.col("vector"), manifest.dim))
        return typed.withColumn("_reason", reason).drop("_given")

    @staticmethod
    def _refused(checked: DataFrame) -> DataFrame:
        return checked.filter("_reason is not null").select("id", F.col("_reason").alias("reason"))

    @staticmethod
    def _stored_schema(df: DataFrame) -> str:
        fields = [T.StructField(f.name, f.dataType) for f in df.schema.fields if f.name != BUCKET]
        return json.dumps(T.StructType([*fields, T.StructField(BUCKET, T.IntegerType())]).jsonValue())

    def load(self, name: str, points: DataFrame, dim: int, metric: str = "cosine", n_buckets: int = 64,
             order_by: str | None = None, distinct_ids: bool = False) -> WriteReport:
        """Bulk load into a new collection; the report tells how many rows went in and which were refused.

        The rebalance hint lets Spark split a large bucket over several tasks
        and join small ones. With ``distinct_ids`` the caller vouches that no
        id comes twice, which saves the shuffle that keeps one row per id. The
        load builds no index: call ``build_index`` afterwards.
        """
        manifest = self.create(name, dim, metric, n_buckets)
        if manifest.folders:
            return self.upsert(name, points, order_by)
        return self._fill(manifest, points, order_by, distinct_ids)

    def _fill(self, manifest: Manifest, points: DataFrame, order_by: str | None, distinct_ids: bool) -> WriteReport:
        """Publish a version that holds the given points only."""
        fresh = replace(manifest, schema=None)
        checked = self._checked(points, fresh)
        rows = checked.filter("_reason is null").drop("_reason")
        if not distinct_ids:
            rows = collapse_duplicates(rows, order_by)
        rows = rows.withColumn(BUCKET, bucket_of(F.col("id"), manifest.n_buckets))
        version = manifest.version + 1
        folder = self._new_folder(version)
        self._write(manifest.name, folder, rows.hint("rebalance", BUCKET))
        folders = {str(b): folder for b in self._buckets_in(manifest.name, folder)}
        done = self._publish(replace(manifest, version=version, folders=folders, written={folder: len(folders)},
                                     schema=self._stored_schema(rows), index=None))
        refused = self._refused(checked)
        return WriteReport(version, self._read_buckets(done, None).count(), refused.count(), refused)

    def upsert(self, name: str, points: DataFrame, order_by: str | None = None,
               batch: tuple[str, int] | None = None, staged: bool = False) -> WriteReport:
        """Insert points or overwrite those with the same id.

        ``order_by`` decides between rows of one id inside the input. A batch
        ``(stream, number)`` that was already applied writes nothing, but still
        reports what it refuses. The input is read several times and therefore
        staged first, unless the caller says that it already comes from stored
        files (``staged``).
        """
        manifest = self.manifest(name)
        checked = self._checked(points, manifest).withColumn(BUCKET, bucket_of(F.col("id"), manifest.n_buckets))
        rows = checked if staged else stage(checked, "upsert")
        if batch and manifest.applied.get(batch[0], -1) >= batch[1]:
            refused = self._refused(rows)
            return WriteReport(manifest.version, 0, refused.count(), refused)
        counts = {
            (r[BUCKET], r.good): r["count"]
            for r in rows.groupBy(BUCKET, F.col("_reason").isNull().alias("good")).count().collect()
        }
        touched = {b for b, good in counts if good}
        written = sum(n for (_, good), n in counts.items() if good)
        refused = sum(n for (_, good), n in counts.items() if not good)
        rejected = self._refused(rows)
        applied = {**manifest.applied, **({batch[0]: batch[1]} if batch else {})}
        if not touched:
            if batch:
                version = manifest.version + 1
                self._publish(replace(manifest, version=version, applied=applied,
                                      index=self._index_after(manifest, version, None, None)))
            return WriteReport(manifest.version, 0, refused, rejected)

        good = rows.filter("_reason is null").drop("_reason")
        incoming = collapse_duplicates(good, order_by)
        version = manifest.version + 1
        folder = self._new_folder(version)
        old_buckets = touched & {int(b) for b in manifest.folders}
        schema, replaced = self._stored_schema(incoming), None
        if old_buckets:
            old, ids = self._read_buckets(manifest, old_buckets), stage(good.select(BUCKET, "id"), "ids")
            schema = self._stored_schema(old.unionByName(incoming, allowMissingColumns=True))
            self._replace_rows(name, folder, old, ids, incoming)
            replaced = old.join(ids, [BUCKET, "id"], "left_semi")
        else:
            self._write(name, folder, incoming.hint("rebalance", BUCKET))
        folders = {**manifest.folders, **{str(b): folder for b in touched}}
        self._publish(replace(manifest, version=version, folders=folders, schema=schema, applied=applied,
                              written=self._still_used(manifest, folders, folder, len(touched)),
                              index=self._index_after(manifest, version, incoming, replaced)))
        return WriteReport(version, written, refused, rejected)

    def delete(self, name: str, ids: DataFrame) -> int:
        """Remove the points with the given ids (column ``id``); unknown ids are ignored."""
        manifest = self.manifest(name)
        typed = self._with_stored_ids(ids.select("id"), manifest).drop("_given").filter("id is not null")
        gone = stage(typed.withColumn(BUCKET, bucket_of(F.col("id"), manifest.n_buckets)), "delete")
        counts = {r[BUCKET]: r["count"] for r in gone.groupBy(BUCKET).count().collect()}
        touched = set(counts) & {int(b) for b in manifest.folders}
        if not touched:
            return manifest.version
        version = manifest.version + 1
        folder = self._new_folder(version)
        old, ids = self._read_buckets(manifest, touched), gone.select(BUCKET, "id")
        self._replace_rows(name, folder, old, ids, None)
        left = self._buckets_in(name, folder)
        folders = {b: f for b, f in manifest.folders.items() if int(b) not in touched}
        folders.update({str(b): folder for b in left})
        self._publish(replace(manifest, version=version, folders=folders,
                              written=self._still_used(manifest, folders, folder, len(left)),
                              index=self._index_after(manifest, version, None, old.join(ids, [BUCKET, "id"], "left_semi"))))
        return version

    @staticmethod
    def _still_used(manifest: Manifest, folders: dict[str, str], new: str, size: int) -> dict[str, int]:
        """Number of buckets written to each folder that some bucket still points to."""
        sizes = {**manifest.written, new: size}
        return {f: sizes[f] for f in set(folders.values()) if f in sizes}

    def drop(self, name: str) -> None:
        """Remove a collection: a closing manifest first, then the files."""
        manifest = self.manifest(name)
        self._publish(replace(manifest, version=manifest.version + 1, folders={}, written={}, index=None, dropped=True))
        files.remove(self.spark, f"{self._home(name)}/data")
        files.remove(self.spark, f"{self._home(name)}/index")

    def copy(self, name: str, target: CollectionStore, new_name: str | None = None) -> int:
        """Copy the current version to another store, replacing the rows of a collection of that name.

        Readers of the target see its old rows until the new ones are all written. Ids are distinct already.
        """
        manifest, new_name = self.manifest(name), new_name or name
        fresh = target.create(new_name, manifest.dim, manifest.metric, manifest.n_buckets)
        fresh = replace(fresh, dim=manifest.dim, metric=manifest.metric, n_buckets=manifest.n_buckets, applied={})
        return target._fill(fresh, self.read(name).drop(BUCKET), None, True).written

    def vacuum(self, name: str, keep: int = 2, older_than_hours: float = 24.0) -> list[str]:
        """Remove data folders that none of the newest ``keep`` versions uses.

        A folder that changed within ``older_than_hours`` may belong to a write that is not published yet and stays;
        choose more than the longest write takes.
        """
        recent = [int(n.split(".")[0]) for n in self._manifest_names(name)[:keep]]
        used: set[str] = set()
        for version in recent:
            used |= set(self.manifest(name, version).folders.values())
        changed = files.changed(self.spark, f"{self._home(name)}/data")
        limit = time.time() - older_than_hours * 3600
        stale = [f for f, at in changed.items() if f.startswith("folder=") and f not in used and at <= limit]
        for folder in stale:
            files.remove(self.spark, f"{self._home(name)}/data/{folder}")
        return stale

    # Index

    def index_path(self, name: str, version: int) -> str:
        return f"{self._home(name)}/index/v{version:08d}"

    def build_index(self, name: str, n_lists: int = 64, filter_columns: list[str] | None = None, seed: int = 42,
                    subspaces: int | None = None, n_codes: int = 64, centroids=None):
        """Build the inverted file index of the current version and record it in the manifest.

        With ``subspaces`` the index also holds product quantisation codes. Given ``centroids`` are used as they are.
        Later writes are noted in the index, so it stays current: see ``fold_index``.
        """
        from larkspur.operators.ivf import IvfIndex, PqModel

        manifest = self.manifest(name)
        path = self.index_path(name, manifest.version + 1) + f"-{uuid.uuid4().hex[:8]}"
        rows = self.read(name)
        pq = PqModel.train(rows, manifest.dim, subspaces, n_codes, manifest.metric, seed=seed) if subspaces else None
        index = IvfIndex.build(rows, path, n_lists=n_lists, metric=manifest.metric,
                               filter_columns=filter_columns or [], seed=seed, pq=pq, centroids=centroids)
        version = manifest.version + 1
        self._publish(replace(manifest, version=version,
                              index={"version": version, "path": path, "n_lists": index.n_lists, "state": index.state}))
        return index

    def index(self, name: str, version: int | None = None):
        """The index of a version, the newest one by default; None where it has none."""
        return self._index_of(self.manifest(name, version))

    def _index_of(self, manifest: Manifest):
        from larkspur.operators.ivf import IvfIndex

        if not manifest.index or manifest.index["version"] != manifest.version:
            return None
        return IvfIndex.open(self.spark, manifest.index["path"], manifest.index["state"])

    def _index_after(self, manifest: Manifest, version: int, added: DataFrame | None, left: DataFrame | None) -> dict | None:
        """The manifest's entry of the index after a write; what changed is written to the index before it is published."""
        index = self._index_of(manifest)
        if index is None:
            return manifest.index
        return {**manifest.index, "version": version, "state": index.changed(added, left, version)}

    def fold_index(self, name: str, when: float = 0.0) -> bool:
        """Write the noted changes of the index into its lists, once they are more than a share ``when`` of its rows.

        Only lists with a change are written again, around the centroids as they are. Readers of earlier versions keep
        their files.
        """
        manifest = self.manifest(name)
        index = self._index_of(manifest)
        if index is None:
            raise ValueError(f"collection {name!r} has no current index")
        changes = index.changes()
        if not changes or changes <= when * self.count(name):
            return False
        version = manifest.version + 1
        self._publish(replace(manifest, version=version,
                              index={**manifest.index, "version": version, "state": index.folded(version)}))
        return True
