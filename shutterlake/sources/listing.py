"""A data source that lists photo files: one input partition a directory, and a stream of files that are new.

    spark.dataSource.register(PhotoListing)
    spark.read.format("photo_listing").option("path", root).load()
    spark.readStream.format("photo_listing").option("path", root).load()

Options: path, a folder as a path or URI that pyarrow opens; depth, how many levels of folders become
partitions of their own (2), below which a partition lists its whole subtree; levels, how many levels of folders are listed at all.
Files and folders whose name begins with a dot are left out, and so is what lies in such folders; all other names count, those that begin with an
underscore as well. Links to folders elsewhere are followed; a link to a folder below path is not, since that folder is listed where it
is. A folder elsewhere that links of two partitions lead to comes twice with the same paths; scan() drops the second.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, dir string, name string, mtime double, size long"
# fixed values: extensions of photo files, by which a listing is cut
EXTENSIONS = (".jpg", ".jpeg", ".raf")
DEPTH = 2


class Folder(InputPartition):
    """A folder to be listed: its own files, or all below it with so many more levels. after, until: (mtime, path) bounds of a stream's batch."""

    def __init__(self, path: str, whole: bool, levels: int | None, after: tuple | None = None, until: tuple | None = None):
        self.path, self.whole, self.levels, self.after, self.until = path, whole, levels, after, until


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the folder there, without links where the system has them."""
    system, root = fs.FileSystem.from_uri(path)
    if isinstance(system, fs.LocalFileSystem):
        from os.path import realpath

        root = realpath(root)
    return system, root.rstrip("/") or "/"


def listed(system: fs.FileSystem, root: str, folder: str) -> tuple[list[str], list[fs.FileInfo]]:
    """(folders, photo files) in a folder, without those whose names begin with a dot; a folder that is gone has none. Links to folders below root are left out."""
    folders, files = [], []
    for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if info.base_name.startswith("."):
            continue
        if info.type == fs.FileType.Directory:
            real = opened(info.path)[1] if isinstance(system, fs.LocalFileSystem) else info.path
            if real == info.path or not f"{real}/".startswith(f"{root}/"):
                folders.append(real)
        elif info.type == fs.FileType.File and info.base_name.lower().endswith(EXTENSIONS):
            files.append(info)
    return folders, files


def walked(system: fs.FileSystem, root: str, folder: str, levels: int | None) -> Iterator[fs.FileInfo]:
    """The photo files in a folder and, so many levels deep, below it. Each folder once, whatever links lead to it."""
    seen, waiting = {folder}, [(folder, 0)]
    while waiting:
        now, level = waiting.pop()
        folders, files = listed(system, root, now)
        yield from files
        if levels is None or level < levels:
            new = [f for f in folders if f not in seen]
            seen.update(new)
            waiting += [(f, level + 1) for f in new]


class _Listing:
    def __init__(self, options: dict[str, str]):
        self.path, self.depth = options["path"], int(options.get("depth", DEPTH))
        self.levels = int(options["levels"]) if "levels" in options else None

    def folders(self, after: tuple | None = None, until: tuple | None = None) -> list[Folder]:
        """Partitions: every folder of the first depth levels by itself, those below with all that is in them. Only folders are listed here."""
        system, root = opened(self.path)
        out, level, seen = [], [root], {root}
        for at in range(self.depth + 1):
            deepest = at == self.depth or at == self.levels
            below = None if self.levels is None else self.levels - at
            out += [Folder(f, deepest, below, after, until) for f in level]
            if deepest:
                break
            found = []
            for folder in level:
                found += [f for f in listed(system, root, folder)[0] if f not in seen]
                seen.update(found)
            level = found
        return out

    def files(self, part: Folder) -> Iterator[tuple]:
        system, root = opened(self.path)
        for info in walked(system, root, part.path, part.levels if part.whole else 0):
            mtime = info.mtime.timestamp() if info.mtime else 0.0
            key = (mtime, info.path)
            if (part.after is None or key > part.after) and (part.until is None or key <= part.until):
                folder, _, name = info.path.rpartition("/")
                yield info.path, folder, name, mtime, info.size


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.listing = _Listing(options)

    def partitions(self) -> list[Folder]:
        return self.listing.folders()

    def read(self, partition: Folder) -> Iterator[tuple]:
        return self.listing.files(partition)


class ListingStreamReader(DataSourceStreamReader):
    """Files in order of (mtime, path): an offset is the last one's. A file that appears later with an older time than the offset's is not seen; a full scan finds it."""

    def __init__(self, options: dict[str, str]):
        self.listing, self.last = _Listing(options), None

    def initialOffset(self) -> dict:
        return {"mtime": -1.0, "path": ""}

    def latestOffset(self) -> dict:
        system, root = opened(self.listing.path)
        last = max(((info.mtime.timestamp() if info.mtime else 0.0, info.path) for info in walked(system, root, root, self.listing.levels)), default=None)
        if self.last is None or last is not None and last > self.last:
            self.last = last
        return {"mtime": self.last[0], "path": self.last[1]} if self.last else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return self.listing.folders((start["mtime"], start["path"]), (end["mtime"], end["path"]))

    def read(self, partition: Folder) -> Iterator[tuple]:
        return self.listing.files(partition)

    def commit(self, end: dict) -> None:
        pass


class PhotoListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "photo_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> ListingReader:
        return ListingReader(dict(self.options))

    def streamReader(self, schema: object) -> ListingStreamReader:
        return ListingStreamReader(dict(self.options))
