"""A paged search of a company register as a data source: a task for each shard of codes and place, pages by offset, retries, pruned by predicates.

What asks the register is given by name, as its service, keys and pace are
those of whoever runs it.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

SCHEMA = "number string, name string, status string, codes array<string>, locality string, postal string, address string, place string, shard int"
#: The first offset that the register refuses; a code of which no company counts.
LAST_START, EXCLUDE = 10_000, "82200"


def parsed_query(text: Column) -> Column:
    """(codes, place) of a planned query, sic:<code,code> loc:<place>; null for other texts."""
    shape = r"^sic:([\d,]+)\s+loc:(.+)$"
    codes = F.filter(F.split(F.regexp_extract(F.trim(text), shape, 1), ","), lambda c: c != "")
    return F.when(F.trim(text).rlike(shape), F.struct(codes.alias("codes"), F.trim(F.regexp_extract(F.trim(text), shape, 2)).alias("place")))


@dataclass
class Shard(D.InputPartition):
    number: int
    codes: list[str]
    place: str


def _named(name: str) -> Callable[[list[str], str, int, int], list[dict]]:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class SearchReader(D.DataSourceReader):
    def __init__(self, options: dict):
        self.fetch = options["fetch"]
        self.shards = [Shard(i, list(s["codes"]), s["place"]) for i, s in enumerate(json.loads(options["shards"]))]
        self.size, self.most = int(options.get("page_size", 100)), int(options.get("max_hits", 0))
        self.exclude = set(filter(None, options.get("exclude", EXCLUDE).split(",")))
        self.retries, self.wait = int(options.get("retries", 3)), float(options.get("wait", 60))
        self.keep_capped = options.get("capped", "error") == "keep"

    def partitions(self) -> list[Shard]:
        return self.shards or [Shard(-1, [], "")]

    def _page(self, shard: Shard, size: int, start: int) -> list[dict]:
        ask = _named(self.fetch)
        for attempt in range(self.retries + 1):
            try:
                return ask(shard.codes, shard.place, size, start)
            except OSError:
                if attempt == self.retries:
                    raise  # the task, and with it the shard, is tried again
                time.sleep(self.wait * 2**attempt)
        raise AssertionError

    def read(self, shard: Shard) -> Iterator[tuple]:
        """Active companies of a shard, each number once, without those of an excluded code."""
        if shard.number < 0:
            return
        seen: set[str] = set()
        given = start = 0
        while not self.most or given < self.most:
            if start >= LAST_START:
                if not self.keep_capped:
                    raise ValueError(f"over {LAST_START} companies for {shard.codes} in {shard.place}: part the shard")
                return
            size = min(self.size, self.most - given) if self.most else self.size
            items = self._page(shard, size, start)
            for item in items:
                number, codes, status = item.get("company_number"), [str(c) for c in item.get("sic_codes") or []], (item.get("company_status") or "").strip().lower()
                if not number or number in seen:
                    continue
                seen.add(number)
                if status not in ("", "active") or self.exclude & set(codes):
                    continue
                where = item.get("registered_office_address") or {}
                line = ", ".join(str(v) for v in where.values() if v)
                yield number, item.get("company_name"), status or None, codes, where.get("locality"), where.get("postal_code"), line, shard.place, shard.number
                given += 1
                if given == self.most:
                    return
            if len(items) < size:
                return
            start += size


class PushingSearch(SearchReader):
    """The same, asking only for the places and shards that predicates leave."""

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        of = {("place",): lambda s: s.place, ("shard",): lambda s: s.number}
        for f in filters:
            value = of.get(getattr(f, "attribute", None))
            if value and isinstance(f, D.EqualTo):
                self.shards = [s for s in self.shards if value(s) == f.value]
            elif value and isinstance(f, D.In):
                self.shards = [s for s in self.shards if value(s) in f.value]
            elif value and isinstance(f, D.IsNotNull):
                pass  # every row has both
            else:
                yield f


class CompanySearch(D.DataSource):
    """Options: fetch (module:function, called with codes, place, size and start, and giving the page's items), shards (JSON), page_size, max_hits of a shard (0: all), exclude, retries, wait (seconds, doubled), capped (error or keep)."""

    @classmethod
    def name(cls) -> str:
        return "company_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SearchReader:
        return (PushingSearch if self.options.get("pushdown") == "true" else SearchReader)(dict(self.options))


def search_companies(spark: SparkSession, fetch: str, shards: list[tuple[list[str], str]], **options) -> DataFrame:
    """Companies of all shards, with predicates on place and shard pushed down; each plan has predicates of its own, as Spark reuses those of the plan before otherwise."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CompanySearch)
    reader = spark.read.format("company_search").option("fetch", fetch).option("pushdown", "true").option("shards", json.dumps([{"codes": c, "place": p} for c, p in shards]))
    return reader.options(**options).load().filter(F.col("place").isNotNull())
