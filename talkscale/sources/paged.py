"""Paged lists over HTTP as a data source: spark.read.format("paged_json") gives one JSON text for each item.

Pages name the next one, so a list is read by one task, page by page, and rows leave as they come. Register with
register(spark); the package must be installed on the executors. Options: path (the first page), items and next (the fields
of a page that hold its items and the next page's address), always (query text that each address must carry), pause
(seconds between requests) and tries.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

PAUSE, TRIES, WAIT, LIMIT = 0.5, 4, 5.0, 120.0


def _open(url: str) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "*/*"}), timeout=LIMIT) as answer:
        return answer.read()


def fetch(url: str, tries: int = TRIES, get: Callable[[str], bytes] = _open, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """What an address holds; failures are tried again after growing waits, but for a page that isn't there."""
    for turn in range(1, tries + 1):
        try:
            return get(url)
        except OSError as e:
            if turn == tries or getattr(e, "code", None) == 404:
                raise
            sleep(WAIT * turn)
    raise ValueError("tries must be 1 or more")


def address(base: str, link: str, always: str) -> str:
    """The full address of a next page, which may be given relative to the list's; always is added unless it is there."""
    url = link if link.startswith("http") else f"{base.split('?')[0].rsplit('/', 1)[0]}/{link}"
    if always and always.split("=")[0] not in url:
        url += ("&" if "?" in url else "?") + always
    return url


def items(first: str, field: str, following: str, always: str, get: Callable[[str], bytes]) -> Iterator[str]:
    """Each item of all pages as JSON. A list whose pages lead back to one already read is an error."""
    url, seen = address(first, first, always), set()
    while url:
        if url in seen:
            raise ValueError(f"{url} comes twice")
        seen.add(url)
        page = json.loads(get(url))
        for x in page.get(field) or []:
            yield json.dumps(x, ensure_ascii=False)
        link = page.get(following)
        url = address(first, link, always) if link else None


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def read(self, partition) -> Iterator[tuple[str]]:
        o, last = self.options, [0.0]

        def get(url: str) -> bytes:
            time.sleep(max(0.0, float(o.get("pause", PAUSE)) - (time.monotonic() - last[0])))
            last[0] = time.monotonic()
            return fetch(url, int(o.get("tries", TRIES)))

        for text in items(o["path"], o.get("items", "value"), o.get("next", "odata.nextLink"), o.get("always", "$format=json"), get):
            yield (text,)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)


def listing(spark: SparkSession, url: str, store: str, schema: str, refresh: bool = False, **options: str) -> DataFrame:
    """A list's items under a schema, read from store, where the first call (or one with refresh) writes them."""
    read = lambda: spark.read.schema("value string").parquet(store)
    try:
        kept = None if refresh else read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        kept = None
    if kept is None:
        register(spark)
        spark.read.format("paged_json").options(**options).load(url).write.mode("overwrite").parquet(store)
        kept = read()
    return kept.select(F.from_json("value", schema).alias("_v")).select("_v.*")


def files_of_sittings(sessions: DataFrame, documents: DataFrame, after: str, group_type: int) -> DataFrame:
    """(session_id, date, path): sittings after a day with the protocol to take, a .docx before others, then the one updated last, then by path."""
    docs = documents.where((F.col("GroupTypeID") == group_type) & (F.coalesce("FilePath", F.lit("")) != ""))
    order = F.struct(F.lower(F.trim("FilePath")).endswith(".docx"), F.coalesce("LastUpdatedDate", F.lit("")), "FilePath")
    best = docs.groupBy("PlenumSessionID").agg(F.max_by("FilePath", order).alias("path"))
    days = sessions.select("PlenumSessionID", F.substring("StartDate", 1, 10).try_cast("date").alias("date")).where(F.col("date") > F.lit(after).cast("date"))
    return days.join(best, "PlenumSessionID").select(F.col("PlenumSessionID").alias("session_id"), "date", F.trim("path").alias("path"))
