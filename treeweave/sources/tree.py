"""A directory tree as a streaming source: each batch has the files that are new or have changed since the one before.

The offset of a stream is the number of a manifest in its `listings` folder. A manifest names one listing per repository, a sorted
Parquet file of paths, sizes and times of change, and a repository whose tree is as it was keeps its listing. Two manifests tell what a
batch holds: a task takes one row group of the new listing, neighbouring paths, compares it with the row groups of the old listing that
reach into it, and opens the files that differ. So the driver walks folders and holds one listing per thread, never all, and a query
that is started again goes on where it stopped.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from treeweave.session import ship_package
from treeweave.sources.files import content_of, file_system, folder_entries

COLUMNS = "root string, repo_url string, path string, size long, modified_ns long, content binary"
_LISTING = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified_ns", pa.int64())])
# Files of one task, bytes of contents in one batch of rows, folders walked at once.
SHARE = 2_000
BATCH_BYTES = 32 << 20
THREADS = 16


def register_tree(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(TreeSource)


class TreeSource(DataSource):
    """`spark.readStream.format("worktree").option("listings", folder).load(root)`.

    Rows are regular files, hidden ones too; links are not followed. The first `repoDepth` folders (1) name the repository, files
    above that belong to the repository of the folders there are. Files above `maxSize` bytes, if given, come with a null
    content and are not opened. A file that is gone, or has become larger than `maxSize`, when its task reads it has a null content.
    """

    @classmethod
    def name(cls) -> str:
        return "worktree"

    def schema(self) -> str:
        return COLUMNS

    def streamReader(self, schema: StructType) -> TreeStream:
        return TreeStream(self.options)


class Share(InputPartition):
    """Neighbouring files of one repository: a row group of its listing, and the listing before."""

    def __init__(self, repo: str, before: str | None, after: str | None, number: int):
        super().__init__(None)
        self.repo, self.before, self.after, self.number = repo, before, after, number


class TreeStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/") or "/"
        self.listings = options["listings"].rstrip("/")
        self.depth = int(options.get("repodepth", options.get("repoDepth", 1)))
        limit = options.get("maxsize", options.get("maxSize"))
        self.limit = None if limit is None else int(limit)

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        known = self._versions()
        version = max(known, default=0)
        before = self._manifest(version)
        after = {}
        with ThreadPoolExecutor(THREADS) as threads:
            repos = list(self._repositories())
            for repo, listed in zip(repos, threads.map(lambda r: self._list(r, before.get(r)), repos)):
                if listed:
                    after[repo] = listed
        if after != before:
            version += 1
            # Written whole or not at all: a listing is only used once a manifest names it.
            self._write(f"manifest-{version}.json", json.dumps(after).encode())
        return {"version": version}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        before, after = self._manifest(start["version"]), self._manifest(end["version"])
        shares = []
        for repo, listed in sorted(after.items()):
            old = before.get(repo)
            if old is None or old["listing"] != listed["listing"]:
                shares += [Share(repo, old and old["listing"], listed["listing"], n) for n in range(listed["shares"])]
        return shares or [Share("", None, None, 0)]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        if share.after is None:
            return
        held: list[tuple] = []
        total = 0
        for path, size, modified in self._changed(share):
            content = self._content(f"{share.repo}/{path}" if share.repo else path, size)
            held.append((self.root, share.repo, path, size, modified, content))
            total += len(content or b"")
            if total >= BATCH_BYTES:
                yield self._batch(held)
                held, total = [], 0
        if held:
            yield self._batch(held)

    def _changed(self, share: Share) -> list[tuple]:
        """Rows of the listing that the one before does not have."""
        with self._open(share.after) as stream:
            rows = _rows(pq.ParquetFile(stream), [share.number])
        if share.before is None:
            return rows
        known: set[tuple] = set()
        with self._open(share.before) as stream:
            listing = pq.ParquetFile(stream)
            for group in range(listing.num_row_groups):
                about = listing.metadata.row_group(group).column(0).statistics
                # Names too long for statistics leave a row group without bounds.
                if about is None or not about.has_min_max or (about.min <= rows[-1][0] and about.max >= rows[0][0]):
                    known.update(r for r in _rows(listing, [group]) if rows[0][0] <= r[0] <= rows[-1][0])
        return [r for r in rows if r not in known]

    def commit(self, end: dict) -> None:
        """Manifests before the one that a restart may still need go; so do listings that none of the rest names."""
        versions = self._versions()
        for version in versions:
            if version < end["version"] - 1:
                self._delete(f"manifest-{version}.json")
        named = {v["listing"] for n in versions if n >= end["version"] - 1 for v in self._manifest(n).values()}
        system, base = file_system(self.listings)
        for entry in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if entry.base_name.endswith(".parquet") and entry.base_name not in named:
                self._delete(entry.base_name)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        return pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*rows), types)], names=names)

    def _content(self, path: str, size: int) -> bytes | None:
        if self.limit is not None and size > self.limit:
            return None
        try:
            content = content_of(self.root, path)
        except FileNotFoundError:
            return None
        return None if self.limit is not None and len(content) > self.limit else content

    def _repositories(self) -> Iterator[str]:
        """Repositories of the tree: folders at the given depth, and those above it that hold files of their own."""
        level = [""]
        for _ in range(self.depth):
            yield from level
            level = [path for folder in level for path, size, _ in folder_entries(self.root, folder) if size is None]
        yield from level

    def _list(self, repo: str, known: dict | None) -> dict | None:
        """The listing of a repository, the known one if nothing has changed; none without files."""
        rows, todo = [], [repo]
        # Folders below a repository above the depth are repositories of their own.
        whole = repo.count("/") + 1 == self.depth if repo else self.depth == 0
        while todo:
            for path, size, modified in folder_entries(self.root, todo.pop()):
                if size is not None:
                    rows.append((path[len(repo):].lstrip("/"), size, modified))
                elif whole:
                    todo.append(path)
        if not rows:
            return None
        rows.sort()
        mark = hashlib.blake2b(repr(rows).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        if known and known["mark"] == mark:
            return known
        listing = f"{uuid.uuid4().hex}.parquet"
        table = pa.table([pa.array(column, field.type) for column, field in zip(zip(*rows), _LISTING)], schema=_LISTING)
        sink = pa.BufferOutputStream()
        pq.write_table(table, sink, compression="zstd", row_group_size=SHARE)
        self._write(listing, sink.getvalue())
        return {"listing": listing, "shares": -(-len(rows) // SHARE), "mark": mark}

    def _open(self, name: str) -> pa.NativeFile:
        system, base = file_system(self.listings)
        return system.open_input_file(f"{base}/{name}")

    def _versions(self) -> list[int]:
        system, base = file_system(self.listings)
        names = [e.base_name for e in system.get_file_info(fs.FileSelector(base, allow_not_found=True))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _manifest(self, version: int) -> dict:
        if not version:
            return {}
        with self._open(f"manifest-{version}.json") as stream:
            return json.loads(stream.read())

    def _write(self, name: str, content: bytes) -> None:
        system, base = file_system(self.listings)
        system.create_dir(base, recursive=True)
        hidden = f"{base}/.{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(hidden) as stream:
            stream.write(content)
        system.move(hidden, f"{base}/{name}")

    def _delete(self, name: str) -> None:
        system, base = file_system(self.listings)
        try:
            system.delete_file(f"{base}/{name}")
        except FileNotFoundError:
            pass


def _rows(listing: pq.ParquetFile, groups: list[int]) -> list[tuple]:
    table = listing.read_row_groups(groups)
    return list(zip(*(table.column(name).to_pylist() for name in _LISTING.names)))
