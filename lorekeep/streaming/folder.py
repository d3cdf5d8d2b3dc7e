"""Folders as a stream: a data source that lists them at each trigger, and states of paths that turn listings into events.

A file stream sees new files only. Here every batch holds a whole listing (path, size, time), and the state of a path
(size, time, digest, when it was last hashed, when it was last listed), kept with those of its bucket's other paths, decides what happened to it. Contents are read only where size or time differ
from the state, or where the last hash is older than the full verification allows. The time of the listings is event time: a path
is removed once the watermark, which is the newest listing of the batches before, has passed the last listing that held it. So no
pause, repeated batch or batch without rows looks like deletions, and a folder that can't be listed stops the batch instead.
"""

import hashlib
import json
import os
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lorekeep import schema as S

LISTING = "path string, size long, mtime_ns long, ms long"
EVENT = "path string, change string, sha256 string, size long, mtime_ns long, ms long"
STATE = "path array<string>, size array<long>, mtime_ns array<long>, sha256 array<string>, hashed_ms array<long>, seen_ms array<long>"
#: Buckets that paths are dealt to by a hash. A call of Python takes a bucket's paths, not one path. It is part of a checkpoint.
BUCKETS = 1024


def _place(path: str):
    """File system of an address or of a plain path, the path in it, and what stands before that path in the address."""
    from pyarrow import fs

    path = re.sub("^file:/+", "/", path.rstrip("/"))
    if "://" not in path:
        return fs.LocalFileSystem(), path, ""
    system, at = fs.FileSystem.from_uri(path)
    return system, at, path[: path.rindex(at)]


def sha256_of(path: str) -> str | None:
    """The digest of a file read in blocks; None where it can't be read."""
    try:
        system, at, _ = _place(path)
        digest = hashlib.sha256()
        with system.open_input_stream(at) as stream:
            while block := stream.read(1 << 20):
                digest.update(block)
        return digest.hexdigest()
    except OSError:
        return None


class _Folders(InputPartition):
    """Folders that one task lists with all below them, or a root of which it lists the files only."""

    def __init__(self, folders: list[str], deep: bool, ms: int):
        self.folders, self.deep, self.ms = folders, deep, ms


class _Reader(DataSourceStreamReader):
    def __init__(self, options):
        self.roots, self.tasks = json.loads(options["roots"]), int(options.get("tasks", "16"))
        self.excluded = tuple(_place(e)[1] + "/" for e in json.loads(options.get("exclude", "[]")))

    def initialOffset(self) -> dict:
        return {"ms": 0}

    def latestOffset(self) -> dict:
        return {"ms": int(time.time() * 1000)}

    def partitions(self, start: dict, end: dict):
        """One task for the files of the roots, and up to `tasks` for the folders in them; the driver lists one level only."""
        from pyarrow import fs

        below = []
        for root in self.roots:
            system, at, prefix = _place(root)
            below += [prefix + i.path for i in system.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.Directory and (prefix or not os.path.islink(i.path))]
        below = sorted(set(below))
        dealt = [below[k :: self.tasks] for k in range(min(self.tasks, len(below)))]
        return [_Folders(self.roots, False, end["ms"]), *[_Folders(d, True, end["ms"]) for d in dealt]]

    def read(self, partition):
        from pyarrow import fs

        for folder in partition.folders:
            system, at, prefix = _place(folder)
            for i in system.get_file_info(fs.FileSelector(at, recursive=partition.deep, allow_not_found=partition.deep)):
                linked = not prefix and os.path.realpath(i.path) != os.path.realpath(at) + i.path[len(at) :]
                if i.type == fs.FileType.File and not linked and i.base_name.lower() not in S.RESERVED and not i.path.startswith(self.excluded):
                    yield (prefix + i.path, i.size, i.mtime_ns, partition.ms)

    def commit(self, end: dict) -> None:
        pass


class FolderListing(DataSource):
    """Format `folder_listing`: option roots is a JSON list of folders; a file below two of them is listed twice.

    Symbolic links and what lies behind them are left out, as are reserved names and the folders of option exclude (a bundle is no source of itself).
    """

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return LISTING

    def streamReader(self, schema):
        return _Reader(self.options)


def listings(spark: SparkSession, roots: list[str], exclude: list[str] = [], tasks: int = 16) -> DataFrame:  # noqa: B006  never changed
    """A stream that lists the roots at each trigger."""
    spark.dataSource.register(FolderListing)
    return spark.readStream.format("folder_listing").option("roots", json.dumps(roots)).option("exclude", json.dumps(exclude)).option("tasks", str(tasks)).load()


def events(listed: DataFrame, verify_ms: int = 300_000, buckets: int = BUCKETS) -> DataFrame:
    """path, change (added, updated, removed), sha256, size, mtime_ns, ms: what a stream of whole listings says happened.

    listed: LISTING, and optionally `sha256` where digests come with the listing; else the file is read when it has to be hashed.
    A path listed twice in a batch counts once, with its latest time. A new time or size with the same digest is no event. A file that
    can't be read keeps its state until it can. Removed paths have the digest, size and time they had, and the listing's time that showed it.
    Listings need times that grow from batch to batch. A checkpoint holds for one number of buckets.
    """
    given = "sha256" in listed.columns

    def step(key, batches, state):
        import pandas as pd

        known = {path: row for path, *row in zip(*state.get, strict=True)} if state.exists else {}
        watermark, latest, found = state.getCurrentWatermarkMs(), {}, []
        if not state.hasTimedOut:
            for pdf in batches:
                digests = pdf["sha256"].tolist() if given else [None] * len(pdf)
                for path, size, mtime, ms, digest in zip(pdf["path"].tolist(), pdf["size"].tolist(), pdf["mtime_ns"].tolist(), pdf["ms"].tolist(), digests, strict=True):
                    if path not in latest or (mtime, size) > latest[path][:2]:
                        latest[path] = (mtime, size, ms, digest)
        for path, (mtime, size, ms, digest) in latest.items():
            old = known.get(path)
            same = old is not None and (old[0], old[1]) == (size, mtime) and ms - old[3] < verify_ms
            digest = old[2] if same else digest if given else sha256_of(path)
            if digest is None:
                if old is not None:
                    old[4] = ms
                continue
            if old is None or digest != old[2]:
                found.append((path, "added" if old is None else "updated", digest, size, mtime, ms))
            known[path] = [size, mtime, digest, old[3] if same else ms, ms]
        for path in [p for p, row in known.items() if row[4] + 1 < watermark and p not in latest]:
            size, mtime, digest, *_ = known.pop(path)
            found.append((path, "removed", digest, size, mtime, watermark))
        if known:
            state.update(tuple(list(column) for column in zip(*[(path, *row) for path, row in known.items()], strict=True)))
            state.setTimeoutTimestamp(min(row[4] for row in known.values()) + 1)  # of the bucket's paths, the one that may be gone first
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame(found, columns=["path", "change", "sha256", "size", "mtime_ns", "ms"])

    timed = listed.withColumns({"_at": F.timestamp_millis("ms"), "_bucket": F.pmod(F.xxhash64("path"), F.lit(buckets))}).withWatermark("_at", "0 seconds")
    return timed.groupBy("_bucket").applyInPandasWithState(step, EVENT, STATE, "append", "EventTimeTimeout")
