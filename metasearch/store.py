"""Generations of a catalog on disk.

    root/current.json           generation, base rows, the change batches that belong to it, sizes and build statistics
    root/base/g=<n>/            Parquet in the order of path_key, zstd, with the number of each row's block
    root/index/g=<n>/           (gram, block_id) in that order: which blocks have which trigrams
    root/changes/g=<n>/b=<id>/  one directory a batch
    root/_LOCK                  a writer is at work
    root/_STALE                 readers are refused until a full build

A reader sees what ``current.json`` lists; it is written beside and renamed over, so a step that dies leaves files that nobody reads.
What is listed must have the size that was written, and pages are read with their checksums: a damaged catalog raises instead of answering. One writer works
at a time: each writing step takes the lock, and raises if another has it.

A search for terms of three bytes or more asks the index for the blocks that can hold them all and reads only those of the base; changes since are few
and are searched as a whole.

``seq`` orders changes within a generation. A compaction takes in what came before it: a later batch lies on top of the new base, whatever its seq.

All access is by the Hadoop FileSystem of the path. Rename is atomic on HDFS and local disks; object stores need a table format instead.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from metasearch.functions import paths
from metasearch.operators import overlay, trigram
from metasearch.plans.query import Query
from metasearch.schema import CHANGE_SCHEMA, FILE_SCHEMA, KEY, STORED_SCHEMA, as_files, check, with_key

FORMAT = 2
#: Bytes of change batches beyond which the base is rebuilt.
COMPACT_BYTES = 64 << 20
INDEX_SCHEMA = StructType([StructField("gram", LongType(), True), StructField("block_id", LongType(), True)])


class StaleError(RuntimeError):
    """The catalog needs a full build before it may be read."""


class LockedError(RuntimeError):
    """Another writer is at work."""


class DamagedError(RuntimeError):
    """Files that the catalog lists are not as they were written."""


@dataclass(frozen=True)
class Manifest:
    generation: int
    records: int
    batches: list[int] = field(default_factory=list)
    changes: int = 0
    format: int = FORMAT
    #: Bytes of the base ("base"), the index ("index") and each batch (its number).
    sizes: dict[str, int] = field(default_factory=dict)
    #: Of the build: blocks, trigrams, postings, milliseconds.
    stats: dict[str, int] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self._mine = spark, root.rstrip("/"), False
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # files

    def _at(self, *parts: str):  # noqa: ANN202
        return self._path("/".join((self.root, *parts)))

    def _exists(self, *parts: str) -> bool:
        return self._fs.exists(self._at(*parts))

    def _put(self, name: str, text: str) -> None:
        """Write beside, then rename over."""
        beside = f".{name}.{uuid.uuid4().hex}"
        out = self._fs.create(self._at(beside), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(name).toUri() if self._at(name).toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(self._fs.makeQualified(self._at(beside)), self._fs.makeQualified(self._at(name)), options)

    def _get(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _base(self, generation: int) -> str:
        return f"{self.root}/base/g={generation}"

    def _index(self, generation: int) -> str:
        return f"{self.root}/index/g={generation}"

    def _batch(self, generation: int, batch: int) -> str:
        return f"{self.root}/changes/g={generation}/b={batch}"

    def _size(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength() if self._fs.exists(self._path(path)) else -1

    def _read(self, schema: StructType, *paths_: str) -> DataFrame:
        return self.spark.read.schema(schema).option("parquet.page.verify-checksum.enabled", "true").parquet(*paths_)

    # reading

    def manifest(self) -> Manifest:
        if self._exists("_STALE"):
            raise StaleError(self._get("_STALE"))
        if not self._exists("current.json"):
            raise FileNotFoundError(f"no catalog in {self.root}")
        got = json.loads(self._get("current.json"))
        if got.get("format") != FORMAT:
            raise ValueError(f"format {got.get('format')} is not {FORMAT}")
        return Manifest(**got)

    def checked(self, manifest: Manifest | None = None) -> Manifest:
        """The manifest, if what it lists has the sizes that were written."""
        manifest = manifest or self.manifest()
        g = manifest.generation
        for name, size in manifest.sizes.items():
            at = {"base": self._base(g), "index": self._index(g)}.get(name) or self._batch(g, int(name))
            if self._size(at) != size:
                raise DamagedError(f"{at} has {self._size(at)} bytes; {size} were written")
        return manifest

    def base(self, manifest: Manifest | None = None, keyed: bool = False) -> DataFrame:
        manifest = manifest or self.checked()
        schema = STORED_SCHEMA if keyed else FILE_SCHEMA
        return check(self._read(schema, self._base(manifest.generation)), schema)

    def records(self) -> DataFrame:
        return self.base().orderBy("path", "native_id")

    def changes(self, manifest: Manifest | None = None) -> DataFrame:
        manifest = manifest or self.checked()
        if not manifest.batches:
            return self.spark.createDataFrame([], CHANGE_SCHEMA)
        return self._read(CHANGE_SCHEMA, *[self._batch(manifest.generation, b) for b in manifest.batches])

    def files(self) -> DataFrame:
        """The live table of one manifest: base and batches always belong together."""
        manifest = self.checked()
        return overlay.overlay(self.base(manifest), self.changes(manifest)) if manifest.batches else self.base(manifest)

    def blocks(self, query: Query, manifest: Manifest | None = None) -> list[int] | None:
        """The base's blocks that can hold all terms; None if the terms are too short or too common to tell."""
        manifest = manifest or self.checked()
        if "index" not in manifest.sizes:
            return None
        found = trigram.candidates(self._read(INDEX_SCHEMA, self._index(manifest.generation)), query)
        if found is None:
            return None
        rows = found.limit(trigram.MOST_BLOCKS + 1).collect()
        return [r["block_id"] for r in rows] if len(rows) <= trigram.MOST_BLOCKS else None

    def searchable(self, query: Query | None = None, manifest: Manifest | None = None) -> DataFrame:
        """The live table in its stored form, with path_key: searches push prefixes down to the scan. For a query, only what can match
        is read of the base."""
        manifest = manifest or self.checked()
        base = self.base(manifest, keyed=True)
        blocks = self.blocks(query, manifest) if query else None
        if blocks is not None:
            base = base.filter(trigram.within(trigram.block_ranges(blocks)))
        base = base.drop("block_id")
        if not manifest.batches:
            return base
        last = overlay.fold(self.changes(manifest))
        return overlay.visible(base, last).unionByName(with_key(overlay.upserts(last)))

    def status(self) -> dict:
        manifest = self.checked()
        return {"records": manifest.records, "changes": manifest.changes, "generation": manifest.generation, "bytes": manifest.sizes["base"], "store": "base+changes" if manifest.batches else "base", **manifest.stats}

    # writing; one writer at a time

    def lock(self) -> bool:
        """Take the writer's lock file; false if another has it."""
        try:
            self._fs.create(self._at("_LOCK"), False).close()
        except Exception as error:
            if "exist" in str(error).lower():
                return False
            raise
        self._mine = True
        return True

    def unlock(self) -> None:
        """Give the lock back, or take away that of a writer that died."""
        self._fs.delete(self._at("_LOCK"), False)
        self._mine = False

    @contextlib.contextmanager
    def writing(self) -> Iterator[None]:
        """With the writer's lock; steps within a step share it."""
        if self._mine:
            yield
            return
        if not self.lock():
            raise LockedError(f"another writer has {self.root}/_LOCK")
        try:
            yield
        finally:
            self.unlock()

    def mark_stale(self, reason: str) -> None:
        self._put("_STALE", reason)

    def build(self, files: DataFrame) -> Manifest:
        """Write a new generation, with its index, and make it current. Unsafe paths are refused."""
        with self.writing():
            began = time.monotonic()
            files = as_files(files)
            if not files.filter(F.col("path").isNull() | ~paths.safe("path")).isEmpty():
                raise ValueError("a path is not absolute and normalized")
            last = json.loads(self._get("current.json"))["generation"] if self._exists("current.json") else 0
            generation = last + 1
            while self._exists("base", f"g={generation}"):  # left by a build that died
                generation += 1
            ordered = with_key(files).repartitionByRange(KEY, "path").sortWithinPartitions(KEY, "path")
            # rows of a file are numbered in their order, so blocks are runs of rows and the numbers rise along the path
            numbered = ordered.withColumn("block_id", F.shiftright(F.monotonically_increasing_id(), trigram.STORED_BITS))
            numbered.write.option("compression", "zstd").parquet(self._base(generation))
            base = self._read(STORED_SCHEMA, self._base(generation))
            trigram.postings(base).repartitionByRange("gram", "block_id").sortWithinPartitions("gram", "block_id").select("gram", "block_id").write.mode("overwrite").option("compression", "zstd").parquet(self._index(generation))
            n = base.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("block_id").alias("blocks")).first()
            index = self._read(INDEX_SCHEMA, self._index(generation)).agg(F.count(F.lit(1)).alias("postings"), F.countDistinct("gram").alias("trigrams")).first()
            stats = {"blocks": n["blocks"], "trigrams": index["trigrams"], "postings": index["postings"], "build_ms": int((time.monotonic() - began) * 1000)}
            manifest = Manifest(generation, n["rows"], sizes={"base": self._size(self._base(generation)), "index": self._size(self._index(generation))}, stats=stats)
            self._put("current.json", json.dumps(asdict(manifest)))
            self._fs.delete(self._at("_STALE"), False)
            return manifest

    def apply(self, batch_id: int, changes: DataFrame) -> Manifest:
        """Add a batch of changes. A batch that is already listed is not added again; one that died half-way is overwritten."""
        with self.writing():
            manifest = self.manifest()
            if batch_id in manifest.batches:
                return manifest
            out = self._batch(manifest.generation, batch_id)
            have = set(changes.columns)
            rows = changes.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in CHANGE_SCHEMA])
            overlay.fold(rows).select(*CHANGE_SCHEMA.fieldNames()).write.mode("overwrite").parquet(out)
            n = self._read(CHANGE_SCHEMA, out).count()
            manifest = replace(manifest, batches=[*manifest.batches, batch_id], changes=manifest.changes + n, sizes={**manifest.sizes, str(batch_id): self._size(out)})
            self._put("current.json", json.dumps(asdict(manifest)))
            return manifest

    def needs_compaction(self, most: int = COMPACT_BYTES, share: float = 0.0) -> bool:
        """Whether the changes have ``most`` bytes, and ``share`` of the base's at least."""
        manifest = self.manifest()
        return bool(manifest.batches) and sum(manifest.sizes[str(b)] for b in manifest.batches) >= max(most, share * manifest.sizes["base"])

    def compact(self) -> Manifest:
        """A new generation from the live table, without changes."""
        with self.writing():
            return self.build(self.files())

    def clean(self) -> None:
        """Delete generations that aren't current; only when no reader uses them."""
        keep = f"g={self.manifest().generation}"
        for kind in ("base", "index", "changes"):
            if self._exists(kind):
                for status in self._fs.listStatus(self._at(kind)):
                    if status.getPath().getName() != keep:
                        self._fs.delete(status.getPath(), True)

    def publish(self, staged: DataFrame, lanes: int, errors: int) -> Manifest | None:
        """Build from a finished scan if some lane succeeded and there are rows; else the last catalog stays."""
        if not (lanes > 0 and errors < lanes) or staged.isEmpty():
            return None
        return self.build(staged)


class Reader:
    """A reader that follows the catalog: it looks at the manifest before each query and checks and reopens when that has changed."""

    def __init__(self, store: Store) -> None:
        self.store, self.seen, self._files = store, None, None

    def _current(self) -> Manifest:
        manifest = self.store.manifest()
        if manifest != self.seen:
            self.store.checked(manifest)
            self.seen, self._files = manifest, self.store.searchable(manifest=manifest)
        return manifest

    def files(self) -> DataFrame:
        self._current()
        return self._files

    def rows(self, query: Query) -> DataFrame:
        """What a query has to look at: the blocks that its terms leave of the base, and all changes."""
        manifest = self._current()
        return self.store.searchable(query, manifest) if query.terms else self._files
