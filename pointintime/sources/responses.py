"""Landed responses as a Spark data source, in batches and as a stream. Fetching isn't done here: a poller writes what it got.

A poller lands files of JSON lines below day=YYYY-MM-DD folders, named so that later files sort later within a day; a line has url,
status, etag, fetched_at (ISO) and body (base64, null where there is none). A file is a partition of the read. Filters on day skip
files before any is opened, filters on status and etag are applied before bodies are decoded.
"""

from __future__ import annotations

import base64
import datetime as dt
import json
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThanOrEqual, InputPartition, LessThanOrEqual

SCHEMA = "url string, status int, etag string, fetched_at timestamp, content binary, day string"


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _files(uri: str) -> list[str]:
    """Landed files below a place, by day and then by name."""
    fs, root = pafs.FileSystem.from_uri(uri)
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(".jsonl") and "/day=" in f.path)


def _day(path: str) -> str:
    return path.rsplit("/day=", 1)[1].split("/", 1)[0]


def _read(uri: str, path: str, wanted: dict) -> Iterator[tuple]:
    """The responses of a file that have the wanted status and etag. A line that isn't a response is an error: nothing is skipped."""
    fs, _ = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as stream:
        for line in stream.read().decode().splitlines():
            said = json.loads(line)
            if all(said.get(k) == v for k, v in wanted.items()):
                at = dt.datetime.fromisoformat(said["fetched_at"].replace("Z", "+00:00")) if said.get("fetched_at") else None
                at = at if at is None or at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
                body = said.get("body")
                yield said.get("url"), said.get("status"), said.get("etag"), at, None if body is None else base64.b64decode(body), _day(path)


class _Batch(DataSourceReader):
    def __init__(self, uri: str):
        self.uri, self.wanted, self.days = uri, {}, []

    def pushFilters(self, filters):
        """Takes equality on status, etag and day and bounds of day; the others stay with Spark."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if isinstance(f, EqualTo) and column in ("status", "etag"):
                self.wanted[column] = f.value
            elif isinstance(f, (EqualTo, GreaterThanOrEqual, LessThanOrEqual)) and column == "day":
                self.days.append((type(f).__name__, f.value))
            else:
                yield f

    def partitions(self):
        fits = {"EqualTo": lambda d, v: d == v, "GreaterThanOrEqual": lambda d, v: d >= v, "LessThanOrEqual": lambda d, v: d <= v}
        return [File(p) for p in _files(self.uri) if all(fits[kind](_day(p), v) for kind, v in self.days)] or [File("")]

    def read(self, partition):
        if partition.path:
            yield from _read(self.uri, partition.path, self.wanted)


class _Stream(DataSourceStreamReader):
    """Offsets are names of files: a batch takes the files that sort after those of the one before."""

    def __init__(self, uri: str, most: int):
        self.uri, self.most, self.seen = uri, most, ""

    def initialOffset(self):
        return {"after": ""}

    def latestOffset(self):
        later = [p for p in _files(self.uri) if p > self.seen]
        self.seen = later[: self.most][-1] if later else self.seen
        return {"after": self.seen}

    def partitions(self, start, end):
        self.seen = max(self.seen, end["after"])
        return [File(p) for p in _files(self.uri) if start["after"] < p <= end["after"]] or [File("")]

    def read(self, partition):
        if partition.path:
            yield from _read(self.uri, partition.path, {})


class LandedResponses(DataSource):
    """``spark.dataSource.register(LandedResponses)``, then ``spark.read.format("landed_responses").load(place)`` or ``readStream``;
    ``filesPerBatch`` bounds the files of a micro-batch."""

    @classmethod
    def name(cls):
        return "landed_responses"

    def schema(self):
        return SCHEMA

    def _uri(self) -> str:
        place = self.options["path"]
        return place if "://" in place or place.startswith("file:") else f"file://{place}"

    def reader(self, schema):
        return _Batch(self._uri())

    def streamReader(self, schema):
        return _Stream(self._uri(), int(self.options.get("filesPerBatch", "1000")))
