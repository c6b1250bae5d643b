"""A paged web service as a Spark data source.

`spark.dataSource.register(PagedSource)`, then `spark.read.format("paged_json").options(...)` gives page, at and record (JSON
text) of every record.  Pages are dealt over `partitions` tasks; each page is fetched with retries and a growing pause, and all
tasks together keep to `per_second` fetches a second.

The transport is a function named by the option `transport` as "module:function", called as fetch(page, options) with the
reader's options and returning {"records": [...], "pages": number of pages}; `http_pages` asks a web address, tests name one
that reads files.  A page that fails for good fails the read, since a table with silent gaps is worse than none.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.calls import Pace, Policy
from .readers import BATCHES, DIRECTORY_SCHEMA


def http_pages(page: int, options: dict) -> dict:
    """Page `page` (from 0) of options["url"], asked with the parameters page and per_page; the records are in the answer's list,
    or under options["records"], and the number of pages is under options["pages"], or an empty page ends them."""
    import urllib.parse
    import urllib.request

    query = urllib.parse.urlencode({"page": page + 1, "per_page": options.get("page_size", "100")})
    headers = json.loads(options.get("headers", "{}"))
    address = options["url"] + ("&" if "?" in options["url"] else "?") + query
    with urllib.request.urlopen(urllib.request.Request(address, headers=headers), timeout=float(options.get("timeout", "30"))) as answer:
        body = json.load(answer)
    records = body if isinstance(body, list) else body[options.get("records", "records")]
    pages = body.get(options.get("pages", "pages")) if isinstance(body, dict) else None
    return {"records": records, "pages": pages}


def named(transport: str) -> Callable[[int, dict], dict]:
    module, _, function = transport.partition(":")
    return getattr(importlib.import_module(module), function)


class Pages(InputPartition):
    def __init__(self, first: int, step: int, end: int | None):
        self.first, self.step, self.end = first, step, end


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.parallel = max(1, int(options.get("partitions", "8")))
        rate = options.get("per_second")
        self.policy = Policy(int(options.get("attempts", "4")), float(options.get("backoff", "0.5")), float(rate) if rate else None, self.parallel)

    def _page(self, page: int) -> dict:
        got, error, attempts = self.policy.tried(named(self.options["transport"]), page, self.options)
        if error:
            raise RuntimeError(f"page {page} failed {attempts} times: {error}")
        return got

    def partitions(self) -> list[InputPartition]:
        """Every task takes each `partitions`-th page; without a known number of pages it goes on to its first empty one."""
        pages = self._page(0).get("pages")
        tasks = self.parallel if pages is None else max(1, min(self.parallel, pages))
        return [Pages(i, tasks, pages) for i in range(tasks)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        pace, page = Pace(self.policy, partition.step), partition.first
        while partition.end is None or page < partition.end:
            pace.wait()
            records = self._page(page)["records"]
            if not records and partition.end is None:
                return
            for at, record in enumerate(records):
                yield page, at, json.dumps(record)
            page += partition.step


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, at int, record string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


def read_pages(spark: SparkSession, transport: str = f"{__name__}:http_pages", **options) -> DataFrame:
    """page, at, record of every record of a paged service."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged_json").options(transport=transport, **{k: str(v) for k, v in options.items()}).load()


def read_directory_pages(spark: SparkSession, batches: tuple[str, ...] | None = BATCHES, **options) -> DataFrame:
    """Directory records of the given batches from a paged service, as `readers.read_directory` gives them from files."""
    rows = read_pages(spark, **options).select(F.from_json("record", DIRECTORY_SCHEMA).alias("r")).select("r.*")
    return rows if batches is None else rows.where(F.col("batch").isin(*batches))
