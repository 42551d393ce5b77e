"""A paginated REST list as a Spark data source, and one request per row.

``spark.read.format("paged_rest").option("url", ...).schema(...)`` reads JSON pages with ``limit`` and ``offset`` until the total of
the reply's ``meta`` is reached or a page is empty. Options whose names start with ``param_`` are sent to the server (predicates pushed
to the source); rows of another ``scope`` are dropped again, as servers have ignored such filters. One partition, because the
server's request limit counts for all readers together: a throttle keeps to ``max_calls`` in any ``window`` seconds, and 429 and 5xx
replies are tried again up to five times, after the time the server asks for or 1, 2, 4 and 8 seconds.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

ATTEMPTS = 5


class Throttle:
    """No more than ``most`` calls in any ``window`` seconds. Each call reserves the time at which it may go out: not before the call ``most`` places ahead is a window old."""

    def __init__(self, most: int = 90, window: float = 300.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.window, self.clock, self.sleep = window, clock, sleep
        self._out = [float("-inf")] * most
        self._next = 0

    def wait(self) -> None:
        now = self.clock()
        at = max(now, self._out[self._next] + self.window)
        self._out[self._next] = at
        self._next = (self._next + 1) % len(self._out)
        if at > now:
            self.sleep(at - now)


def http_get(url: str, headers: dict[str, str], timeout: float = 30.0) -> tuple[int, dict[str, str], bytes]:
    request = urllib.request.Request(url, headers=headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return reply.status, dict(reply.headers), reply.read()
    except urllib.error.HTTPError as error:
        return error.code, dict(error.headers), error.read()


#: What becomes of a reply, by the first range its status falls into.
POLICY = ((range(200, 400), "use"), (range(401, 402), "refused"), (range(429, 430), "again"), (range(500, 600), "again"))


def pause(asked: str | None, attempt: int, now: Callable[[], float] = time.time) -> float:
    """Seconds to wait: what the server asks for, as seconds or as a date, else 1, 2, 4, 8."""
    if asked:
        try:
            return max(0.0, float(asked))
        except ValueError:
            try:
                return max(0.0, parsedate_to_datetime(asked).timestamp() - now())
            except ValueError:
                pass
    return float(2**attempt)


def ask(url: str, headers: dict[str, str], throttle: Throttle, fetch: Callable[..., tuple[int, dict[str, str], bytes]] = http_get) -> tuple[int, bytes]:
    """Status and body of a URL; 429 and 5xx are asked for again, up to ATTEMPTS times in all."""
    status, body, reply = 0, b"", {}
    for attempt in range(ATTEMPTS):
        if attempt:
            throttle.sleep(pause(reply.get("Retry-After"), attempt - 1))
        throttle.wait()
        status, reply, body = fetch(url, headers)
        if _action(status) != "again":
            break
    return status, body


def _action(status: int) -> str:
    return next((action for statuses, action in POLICY if status in statuses), "failed")


def get(url: str, headers: dict[str, str], throttle: Throttle, fetch: Callable[..., tuple[int, dict[str, str], bytes]] = http_get) -> dict:
    """JSON of a URL; a status that isn't good is an error, 401 a PermissionError."""
    status, body = ask(url, headers, throttle, fetch)
    if _action(status) == "use":
        return json.loads(body)
    if _action(status) == "refused":
        raise PermissionError("the server refused the key")
    raise RuntimeError(f"HTTP {status}" + (f" after {ATTEMPTS} attempts" if _action(status) == "again" else ""))


def fetched(rows: DataFrame, url: str, authorization: str | None = None, most: int = 90, window: float = 300.0, readers: int = 1) -> DataFrame:
    """``rows`` with ``status`` and ``body`` of the URL in column ``url``: detail records, files or pages of each row.

    ``readers`` tasks share the server's limit of ``most`` calls in ``window`` seconds evenly. A null or blank URL, and one that can't be reached, has a null status; a status
    of 429 or 5xx stays after the last attempt. A task that runs again asks again.
    """
    if not 1 <= readers <= most:
        raise ValueError("readers must be between 1 and the number of calls")
    headers = {"Authorization": authorization} if authorization else {}
    place = rows.columns.index(url)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        throttle = Throttle(most // readers, window)
        for batch in batches:
            found: list[tuple[int | None, bytes | None]] = []
            for address in batch.column(place).to_pylist():
                try:
                    found.append(ask(address, headers, throttle) if address and address.strip() else (None, None))
                except (OSError, ValueError):
                    found.append((None, None))
            columns = [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "status", "body"])

    schema = StructType([*rows.schema.fields, StructField("status", IntegerType()), StructField("body", BinaryType())])
    return rows.repartition(readers).mapInArrow(run, schema)


def liveness(status: Column) -> Column:
    """``live`` for a page that was delivered; anything else says nothing about the page: ``unknown``."""
    return F.when(status == 200, "live").otherwise("unknown")


def saved(files: DataFrame, folder: str, name: str = "name", body: str = "body") -> DataFrame:
    """(name, path, bytes) of files written to a folder that all tasks see. A file appears whole or not at all, however often its task runs; null bodies are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            rows = []
            for label, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = os.path.join(folder, os.path.basename(label))
                part = f"{path}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as out:
                    out.write(content)
                os.replace(part, path)
                rows.append((label, path, len(content)))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["name", "path", "bytes"])

    some = files.select(F.col(name).alias("name"), F.col(body).alias("body")).filter("name IS NOT NULL AND body IS NOT NULL")
    return some.mapInArrow(run, "name string, path string, bytes bigint")


def pages(url: str, params: dict[str, str], limit: int, read: Callable[[str], dict]) -> Iterator[dict]:
    """All objects of a paginated list."""
    offset = 0
    while True:
        page = read(f"{url}?{urllib.parse.urlencode({**params, 'limit': limit, 'offset': offset})}")
        rows = page.get("objects") or page.get("results") or []
        yield from rows
        offset += len(rows)
        if not rows or offset >= int(page.get("meta", {}).get("total", offset + 1)):
            return


class PagedRest(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return "id bigint, raw string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.names, self.options = schema.fieldNames(), options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        options = self.options
        throttle = Throttle(int(options.get("max_calls", 90)), float(options.get("window", 300)))
        headers = {"Authorization": options["authorization"]} if "authorization" in options else {}
        params = {k[6:]: v for k, v in options.items() if k.startswith("param_")}
        scope = options.get("scope")
        for row in pages(options["url"], params, int(options.get("limit", 250)), lambda url: get(url, headers, throttle)):
            if scope and str(row.get(scope)) != params.get(scope):
                continue
            yield tuple(json.dumps(row) if name == "raw" else row.get(name) for name in self.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedRest)
