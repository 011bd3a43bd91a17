"""Cursor-paginated sources: retries, a response cache in a shared folder, and Spark data sources over both."""

from __future__ import annotations

import hashlib
import json
import math
import random
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

#: url -> status, headers (lower case), body.
Fetch = Callable[[str], tuple[int, dict[str, str], str]]
#: Every row is one result of a page, as JSON; read it with from_json and the schema of the results.
SCHEMA = "page int, value string"


@dataclass(frozen=True)
class Retry:
    """Answers 429 and 5xx are asked again `attempts` times, after the time the server names or 2^n seconds (S3)."""

    attempts: int = 6
    pause: tuple[float, float] = (0.85, 1.15)
    sleep: Callable[[float], None] = time.sleep

    def delay(self, attempt: int, named: str | None) -> float:
        try:
            wanted = float(named or 0)
        except ValueError:
            wanted = 0.0
        return wanted if math.isfinite(wanted) and wanted > 0 else 2.0**attempt + random.uniform(0, 0.5)

    def get(self, fetch: Fetch, url: str) -> str:
        for attempt in range(self.attempts + 1):
            status, headers, body = fetch(url)
            if (status == 429 or status >= 500) and attempt < self.attempts:
                self.sleep(self.delay(attempt, headers.get("retry-after")))
                continue
            break
        if not 200 <= status < 300:
            raise RuntimeError(f"{status} {url}")
        self.sleep(random.uniform(*self.pause))
        return body


@dataclass(frozen=True)
class Responses:
    """Read-through cache of bodies, a file per URL named by its SHA-256 (S4); a rename makes writing atomic."""

    folder: str
    fetch: Fetch
    retry: Retry = Retry()

    def __call__(self, url: str) -> str:
        store, root = fs.FileSystem.from_uri(self.folder)
        path = f"{root}/{hashlib.sha256(url.encode()).hexdigest()}.json"
        if store.get_file_info(path).type == fs.FileType.File:
            with store.open_input_stream(path) as f:
                return f.read().decode()
        body = self.retry.get(self.fetch, url)
        store.create_dir(root, recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            f.write(body.encode())
        store.move(part, path)
        return body


@dataclass(frozen=True)
class Chain(InputPartition):
    """One chain of pages: pages of a chain follow one another, chains are read side by side."""

    scope: str


def page_source(name: str, url_of: Callable[[str, str], str], body_of: Callable[[str], str], scopes: Sequence[str] = ("",), most: int = 0) -> type[DataSource]:
    """Data source `name`, for spark.dataSource.register: rows (page, value) of all pages of all scopes.

    url_of(scope, cursor) names a page, body_of(url) reads it (Responses); it holds `results` and
    `meta.next_cursor`. A chain begins at cursor "*" and ends without a next cursor or, if `most` is not 0, after `most`
    pages. In a stream, a batch is one page of the only scope; what was read before is in the cache, so a batch that
    is repeated has the same rows.
    """

    def page(scope: str, cursor: str) -> tuple[list[str], str | None]:
        got = json.loads(body_of(url_of(scope, cursor)))
        return [json.dumps(r, ensure_ascii=False) for r in got["results"]], (got.get("meta") or {}).get("next_cursor")

    class Reader(DataSourceReader):
        def partitions(self) -> list[Chain]:
            return [Chain(s) for s in scopes]

        def read(self, partition: Chain) -> Iterator[tuple[int, str]]:
            cursor, number = "*", 0
            while cursor and not (most and number >= most):
                rows, cursor = page(partition.scope, cursor)
                number += 1
                yield from ((number, r) for r in rows)

    class Stream(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"cursor": "*", "page": 0}

        def read(self, start: dict) -> tuple[Iterator[tuple[int, str]], dict]:
            if not start["cursor"] or (most and start["page"] >= most):
                return iter([]), start
            rows, cursor = page(scopes[0], start["cursor"])
            number = start["page"] + 1
            return iter([(number, r) for r in rows]), {"cursor": cursor or "", "page": number}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[int, str]]:
            while start["page"] < end["page"]:
                rows, start = self.read(start)
                yield from rows

        def commit(self, end: dict) -> None:
            pass

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> Reader:
            return Reader()

        def simpleStreamReader(self, schema) -> Stream:
            if len(scopes) != 1:
                raise ValueError("a stream follows one scope")
            return Stream()

    return Pages
