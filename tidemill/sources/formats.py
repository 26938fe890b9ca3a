"""Formats of Spark's Python data source API: growing logs, replay lines and Markdown posts, read and written by their paths.

    register(spark)
    spark.read.format("tidemill_log").load(path)            # byte ranges of files as partitions
    spark.readStream.format("tidemill_log").load(path)      # follows files as they grow; the offsets are bytes of each
    spark.read.format("tidemill_replay").load(path)         # replay lines, with their place in their source's queue
    spark.read.format("tidemill_posts").load(path)          # front matter, body, and the addresses that they name
    posts.write.format("tidemill_posts").mode("append").save(path)

The option `ends` names the endings of the files that are read. Paths are URIs of any store that Arrow knows (file, hdfs, s3, gs). A log that another process appends to is what Spark's file
stream cannot follow, since it takes each file once. A writer stages its files and moves them when all tasks are done; if
one fails, none is there.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: The form of a log line, the keys of a post that name its source, and the line of a body that does.
LINE = re.compile(r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \| (\w+)\s* \| ([^|]+?) \| (.*)$")
SOURCE_KEYS = ("source_url", "source", "original_url")
SOURCE_LINE = re.compile(r"Fuente original:\s*(?:\[(https?://[^\]\s]+)\]|(https?://\S+))", re.IGNORECASE)
SPLIT, BLOCK, FILES_EACH = 32 << 20, 1 << 20, 64


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{posixpath.abspath(path)}")


def files_under(path: str, ends: tuple[str, ...]) -> list[tuple[str, int]]:
    """The files of a folder, or the file itself, with their sizes, in order."""
    fs, at = store_of(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [(info.path, info.size)]
    if info.type == pafs.FileType.NotFound:
        return []
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    hidden = lambda p: any(x[:1] in "._" for x in p[len(at) :].strip("/").split("/"))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.endswith(ends) and not hidden(f.path))


@dataclass
class Range(InputPartition):
    """Bytes of a file: the lines that start in [start, end)."""

    path: str
    start: int
    end: int


def lines_of(root: str, part: Range) -> Iterator[tuple[int, str]]:
    """Where each line starts, and the line."""
    fs, _ = store_of(root)
    with fs.open_input_file(part.path) as f:
        at, rest, size = part.start, b"", f.size()
        if at:  # a line that starts before the range belongs to the range before
            at -= 1
            f.seek(at)
            while True:
                block = f.read(BLOCK)
                cut = block.find(b"\n")
                at += cut + 1 if cut >= 0 else len(block)
                if cut >= 0 or not block:
                    break
            f.seek(at)
        while at < part.end:
            block = f.read(BLOCK)
            rest += block
            *whole, rest = rest.split(b"\n")
            if not block and rest:
                whole, rest = [rest], b""
            for line in whole:
                if at >= part.end:
                    return
                yield at, line.decode("utf-8", "replace").rstrip("\r")
                at += len(line) + 1
            if not block or at >= size:
                return


def ranges(files: list[tuple[str, int, int]], split: int) -> list[Range]:
    return [Range(path, at, min(end, at + split)) for path, start, end in files for at in range(start, end, split)]


# ---- logs

LOG = "path string, at long, time string, level string, place string, message string"


def log_rows(root: str, part: Range) -> Iterator[tuple]:
    for at, line in lines_of(root, part):
        m = LINE.match(line)
        if m:
            yield (part.path, at, *m.groups())


class LogReader(DataSourceReader):
    def __init__(self, path: str, split: int, ends: str = ".log") -> None:
        self.path, self.split, self.ends = path, split, tuple(ends.split(","))

    def partitions(self) -> list[Range]:
        return ranges([(p, 0, n) for p, n in files_under(self.path, self.ends)], self.split) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return log_rows(self.path, partition) if partition.path else iter(())


class LogFollower(DataSourceStreamReader):
    """Offsets say how far each file has been read; a line counts when it is whole. A file that has become shorter is a new one."""

    def __init__(self, path: str, split: int, ends: str = ".log") -> None:
        self.path, self.split, self.ends = path, split, tuple(ends.split(","))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def whole_lines(self, path: str, size: int) -> int:
        fs, _ = store_of(self.path)
        with fs.open_input_file(path) as f:
            end = size
            while end:
                start = max(0, end - BLOCK)
                f.seek(start)
                cut = f.read(end - start).rfind(b"\n")
                if cut >= 0:
                    return start + cut + 1
                end = start
        return 0

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": json.dumps({p: self.whole_lines(p, n) for p, n in files_under(self.path, self.ends)}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        new = [(p, before.get(p, 0) if before.get(p, 0) <= n else 0, n) for p, n in after.items()]
        return ranges([x for x in new if x[1] < x[2]], self.split)

    def read(self, partition: Range) -> Iterator[tuple]:
        return log_rows(self.path, partition)


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemill_log"

    def schema(self) -> str:
        return LOG

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(self.options["path"], int(self.options.get("split", SPLIT)), self.options.get("ends", ".log"))

    def streamReader(self, schema: StructType) -> LogFollower:  # noqa: N802
        return LogFollower(self.options["path"], int(self.options.get("split", SPLIT)), self.options.get("ends", ".log"))


# ---- replay lines

ARTICLE = ("link", "title", "summary", "published")
REPLAY = f"path string, at long, source_id string, status_code int, content_hash string, articles array<struct<{','.join(f'{c}:string' for c in ARTICLE)}>>, error string"


class ReplayReader(LogReader):
    """Each line a JSON object; (path, at) is its order, by which a source's queue is told. Broken lines come with their error."""

    def read(self, partition: Range) -> Iterator[tuple]:
        for at, line in lines_of(self.path, partition) if partition.path else ():
            if not line.strip():
                continue
            try:
                r = json.loads(line)
                articles = [tuple(a.get(c) for c in ARTICLE) for a in r.get("articles") or []]
                yield (partition.path, at, r.get("source_id"), r.get("status_code"), r.get("content_hash"), articles, None)
            except (ValueError, AttributeError) as e:
                yield (partition.path, at, None, None, None, None, type(e).__name__)


class ReplaySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemill_replay"

    def schema(self) -> str:
        return REPLAY

    def reader(self, schema: StructType) -> ReplayReader:
        return ReplayReader(self.options["path"], int(self.options.get("split", SPLIT)), self.options.get("ends", ".jsonl,.json"))


# ---- posts

POST = "path string, front map<string,string>, body string, source_url string, published_url string"


def front_of(text: str) -> tuple[dict[str, str], str]:
    """The front matter of a post, and its body."""
    parts = text.split("---", 2)
    if not text.startswith("---") or len(parts) < 3:
        return {}, text
    pairs = (re.match(r"^([\w-]+)\s*:\s*(.+)$", line) for line in parts[1].splitlines())
    front: dict[str, str] = {}
    for m in pairs:
        if m:
            front.setdefault(m[1], m[2].strip().strip('"').strip("'").strip())
    return front, parts[2].removeprefix("\n")


def source_of(front: dict[str, str], body: str) -> str | None:
    """The address of a post's source: the first key that has one, else the line of the body that names it."""
    m = SOURCE_LINE.search(body)
    return next((front[k] for k in SOURCE_KEYS if front.get(k)), (m[1] or m[2]) if m else None)


@dataclass
class Files(InputPartition):
    paths: list[str]


class PostReader(DataSourceReader):
    def __init__(self, path: str, site: str) -> None:
        self.path, self.site = path, site

    def partitions(self) -> list[Files]:
        found = [p for p, _ in files_under(self.path, (".md",))]
        return [Files(found[i : i + FILES_EACH]) for i in range(0, len(found), FILES_EACH)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = store_of(self.path)
        for path in partition.paths:
            with fs.open_input_stream(path) as f:
                front, body = front_of(f.read().decode("utf-8", "replace"))
            link = front.get("permalink")
            published = f"{self.site.rstrip('/')}/{link.lstrip('/')}" if self.site and link else None
            yield (path, front, body, source_of(front, body), published)


@dataclass
class Staged(WriterCommitMessage):
    names: list[str]


class PostWriter(DataSourceWriter):
    """Rows (name, front, body) as Markdown files. A name that is there already is replaced, unless the folder is to be overwritten as a whole."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite
        self.stage = f".stage-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        fs, root = store_of(self.path)
        part = f"{root}/{self.stage}/{uuid.uuid4().hex}"  # of an attempt: one that fails leaves nothing to be moved
        fs.create_dir(part)
        names = []
        for row in iterator:
            if not re.fullmatch(r"[\w.-]+", row["name"]) or row["name"].startswith("."):
                raise ValueError(f"not a name of a post: {row['name']!r}")
            head = "".join(f"{k}: {json.dumps(v, ensure_ascii=False) if re.search(r'[:#]', v) else v}\n" for k, v in sorted((row["front"] or {}).items()))
            with fs.open_output_stream(f"{part}/{row['name']}.md") as f:
                f.write(f"---\n{head}---\n{row['body'] or ''}".encode())
            names.append(f"{part}/{row['name']}.md")
        return Staged(names)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, root = store_of(self.path)
        if self.overwrite:
            for path, _ in files_under(self.path, (".md",)):
                fs.delete_file(path)
        for m in messages:
            for name in m.names if m else ():
                fs.move(name, f"{root}/{posixpath.basename(name)}")
        fs.delete_dir(f"{root}/{self.stage}")

    def abort(self, messages: list[Staged | None]) -> None:
        fs, root = store_of(self.path)
        if fs.get_file_info(f"{root}/{self.stage}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.stage}")


class PostSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemill_posts"

    def schema(self) -> str:
        return POST

    def reader(self, schema: StructType) -> PostReader:
        return PostReader(self.options["path"], self.options.get("site", ""))

    def writer(self, schema: StructType, overwrite: bool) -> PostWriter:
        return PostWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    for source in (LogSource, ReplaySource, PostSource):
        spark.dataSource.register(source)
