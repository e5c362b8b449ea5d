"""Files of our own formats in the shared folder, through pyarrow's file systems (local, HDFS, S3, GCS by URI)."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), uri.removeprefix("file://").removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


class Writer:
    """One new file under a folder. Its name is fresh for every attempt of a task; only names in the rows a task returned count, so what a lost attempt left is never read."""

    def __init__(self, folder: str, kind: str):
        system, path = open_fs(folder)
        system.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.{kind}"
        self.uri, self.at = f"{folder}/{name}", 0
        self._out = system.open_output_stream(f"{path}/{name}", compression=None)

    def write(self, data: bytes) -> tuple[int, int]:
        """(offset, length) of what was written."""
        self._out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def close(self) -> None:
        self._out.close()


def read_ranges(ranges: Iterable[tuple[str, int, int, object]], gap: int = 1 << 16, most: int = 4 << 20) -> Iterator[tuple[object, bytes]]:
    """(tag, bytes) of (uri, offset, length, tag), which come sorted by uri and offset: ranges at most `gap` apart are read in one go of at most about `most` bytes."""
    held: list[tuple[int, int, object]] = []
    at_uri, file, end = None, None, 0

    def flush():
        if held:
            start = held[0][0]
            data = memoryview(file.read_at(max(o + n for o, n, _ in held) - start, start))
            for o, n, tag in held:
                yield tag, bytes(data[o - start : o - start + n])
            held.clear()

    for uri, offset, length, tag in ranges:
        if uri != at_uri or (held and (offset > end + gap or offset + length - held[0][0] > most)):
            yield from flush()
        if uri != at_uri:
            if file:
                file.close()
            system, path = open_fs(uri)
            at_uri, file, end = uri, system.open_input_file(path), 0
        held.append((offset, length, tag))
        end = max(end, offset + length)
    yield from flush()
    if file:
        file.close()
