"""A streaming source of appended lines: offsets are bytes, and the driver opens no log.

Spark's file source ignores what is appended to a file it has seen. This one lists the
files and their sizes, and admits bytes up to the bound of a trigger wherever a
line may stand just there: a line belongs to the part that holds its end, and the executor
that reads a part goes back to where its first line begins. So parts are cut by numbers
alone, a long file is many tasks, and a line without an end waits for it.

The folder ``progress`` (in the store that driver and executors share) outlives a query:

* ``offset.json``: how far bytes were admitted. It is written before Spark logs an offset, so
  after a failure it is never behind; what it is ahead by goes into the next batch.
* ``mark-*``: digests of the bytes before the end of what was read, left by executors. The
  next reader of the file compares. A difference means another file under the same
  name: the reader leaves ``replaced-*`` and gives no rows, and the next trigger reads the
  file anew under a higher generation, as it does with a file that became shorter.

PySpark ends an AvailableNow run after one bounded batch of such a source;
``jobs.drained`` runs it until nothing is left. Paths are those of ``pyarrow.fs`` (local, hdfs,
s3, gs) with `*`, `?` and `**`. Lines end with \\n; a \\r before it is cut off.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a digest, and of a block that is read.
MARK, BLOCK = 4096, 1 << 20
_NEW = {"bytes": 0, "generation": 0}


class _Part(InputPartition):
    """Bytes ``start`` to ``end`` of a file; what was read before this batch ends at ``known``, the batch at ``last``."""

    def __init__(self, path: str, start: int, end: int, known: int, last: int, generation: int):
        self.path, self.start, self.end, self.known, self.last, self.generation = path, start, end, known, last, generation


def _opened(uri: str) -> tuple[fs.FileSystem, str, str]:
    """A store, the path in it, and what stands before the path in names of that store."""
    system, path = fs.FileSystem.from_uri(uri)
    return system, path, "" if uri.startswith(("/", "file:")) else uri[: uri.rindex(path)]


def _matcher(pattern: str) -> re.Pattern:
    wild = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return re.compile("".join(wild.get(t) or re.escape(t) for t in re.split(r"(\*\*/|\*\*|\*|\?)", pattern)))


def listed(pattern: str) -> dict[str, int]:
    """Sizes of the files that a pattern names; nothing is opened."""
    fixed = re.split(r"[*?]", pattern)[0]
    base = fixed.rpartition("/")[0] if fixed != pattern else pattern
    system, path, before = _opened(base or "/")
    found = system.get_file_info(fs.FileSelector(path, recursive="/" in pattern[len(base) + 1 :], allow_not_found=True) if fixed != pattern else [path])
    matches = _matcher(path + pattern[len(base) :]).fullmatch
    return {before + f.path: f.size for f in found if f.type == fs.FileType.File and matches(f.path)}


def lines_ending(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(first byte, line) of every line whose end lies in the bytes from ``start`` up to ``end``."""
    f.seek(start)
    at, begin, held = start, None, []
    while at < end and (block := f.read(min(BLOCK, end - at))):
        *whole, rest = block.split(b"\n")
        if whole and begin is None:
            begin, before = _line_before(f, start)
            held.insert(0, before)
            f.seek(at + len(block))
        for piece in whole:
            line = b"".join([*held, piece])
            yield begin, line
            begin, held = begin + len(line) + 1, []
        if begin is not None or rest:
            held.append(rest)
        at += len(block)


def _line_before(f, end: int) -> tuple[int, bytes]:
    """Where the line begins that ``end`` is in, and its bytes up to there."""
    found: list[bytes] = []
    at = end
    while at:
        low = max(0, at - BLOCK)
        f.seek(low)
        block = f.read(at - low)
        cut = block.rfind(b"\n") + 1
        found.append(block[cut:])
        if cut:
            return low + cut, b"".join(reversed(found))
        at = low
    return 0, b"".join(reversed(found))


def _digest(f, end: int) -> str:
    f.seek(max(0, end - MARK))
    return hashlib.sha256(f.read(min(MARK, end))).hexdigest()


def _name(path: str) -> str:
    return hashlib.sha256(path.encode()).hexdigest()[:32]


class _Progress:
    """The small files that planner and executors leave for each other."""

    def __init__(self, folder: str):
        self.system, self.folder, _ = _opened(folder)

    def names(self) -> list[str]:
        return [f.base_name for f in self.system.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))]

    def read(self, name: str) -> str | None:
        path = f"{self.folder}/{name}"
        if self.system.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with self.system.open_input_stream(path) as f:
            return f.read().decode()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: a reader never sees half of it."""
        self.system.create_dir(self.folder, recursive=True)
        with self.system.open_output_stream(f"{self.folder}/.{name}") as f:
            f.write(text.encode())
        self.system.move(f"{self.folder}/.{name}", f"{self.folder}/{name}")

    def remove(self, name: str) -> None:
        self.system.delete_file(f"{self.folder}/{name}")


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.pattern, self.folder = options["path"], options["progress"]
        self.most_bytes = int(options.get("maxBytesPerTrigger", str(1 << 40)))
        self.most_files = int(options.get("maxFilesPerTrigger", str(1 << 40)))
        self.part = int(options.get("partBytes", str(1 << 26)))

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        progress = _Progress(self.folder)
        files: dict = json.loads(progress.read("offset.json") or "{}")
        replaced = {n for n in progress.names() if n.startswith("replaced-")}
        before, left, room = json.dumps(files, sort_keys=True), self.most_bytes, self.most_files
        sizes = listed(self.pattern)
        for path in sorted(sizes, key=lambda p: (files.get(p, _NEW)["bytes"] > 0, p)):  # new files first: none waits for ever behind a busy one
            seen = files.get(path, _NEW)
            if sizes[path] < seen["bytes"] or f"replaced-{_name(path)}-{seen['generation']}" in replaced:
                seen = {"bytes": 0, "generation": seen["generation"] + 1}
            take = min(sizes[path] - seen["bytes"], left) if room else 0
            if take or seen["generation"] != files.get(path, _NEW)["generation"]:
                files[path] = {"bytes": seen["bytes"] + take, "generation": seen["generation"]}
                left, room = left - take, room - (take > 0)
        now = json.dumps(files, sort_keys=True)
        if now != before:
            progress.write("offset.json", now)
        return {"files": now}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        parts = []
        for path, now in after.items():
            was = before.get(path, _NEW)
            known = was["bytes"] if was["generation"] == now["generation"] else 0
            parts += [_Part(path, a, min(a + self.part, now["bytes"]), known, now["bytes"], now["generation"]) for a in range(known, now["bytes"], self.part)]
        return parts or [_Part("", 0, 0, 0, 0, 0)]

    def read(self, part: _Part):
        if not part.path:
            return
        system, path, _ = _opened(part.path)
        progress, name = _Progress(self.folder), f"{_name(part.path)}-{part.generation}"
        with system.open_input_file(path) as f:
            mark = progress.read(f"mark-{name}-{part.known}") if part.known else None
            if f.size() < part.last or (mark and mark != _digest(f, part.known)):
                progress.write(f"replaced-{name}", "")
                return
            for position, line in lines_ending(f, part.start, part.end):
                yield part.path, position, line.removesuffix(b"\r").decode("utf-8"), part.generation
            if part.end == part.last:
                progress.write(f"mark-{name}-{part.last}", _digest(f, part.last))

    def commit(self, end: dict) -> None:
        """Marks of ends before the last committed one, and what is left of older generations, are not needed any more."""
        progress = _Progress(self.folder)
        files = {_name(p): f for p, f in json.loads(end["files"]).items()}
        for n in progress.names():
            kind, _, rest = n.partition("-")
            at = [int(x) for x in rest.split("-")[1:]] if kind in ("mark", "replaced") else []
            held = files.get(rest.split("-")[0])
            if at and held and (at[0] < held["generation"] or (at[0] == held["generation"] and at[1:] and at[1] < held["bytes"])):
                progress.remove(n)


class AppendedLines(DataSource):
    """`spark.readStream.format("appended_lines").option("path", "/logs/**/*.jsonl").option("progress", folder)`.

    Columns: path, the byte its line begins at (from 0; plus 1 it orders lines where readers take a line number from 1), the
    line, and the file's generation. ``maxBytesPerTrigger``
    and ``maxFilesPerTrigger`` bound a batch, ``partBytes`` a task.
    """

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "path string, position long, text string, generation long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)
