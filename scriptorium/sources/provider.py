"""A host's own pages as a Spark data source: category by category, asking the host only for the categories a query wants.

A host gives a provider: which categories it has, and the pages of one of them as Arrow batches, so a page store of any kind can
stand behind a listing. Each category is a partition of the scan, and conditions on the category are answered by the provider and
not looked at again; the number of tasks and what is fetched follow from the selector. Large categories can be dealt out
further by the provider, in parts.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, Not
from pyspark.sql.types import StructType

from scriptorium.sources.wiki import Wiki

#: Spark's setting that lets Python sources see conditions.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class PageProvider(Protocol):
    """What a host implements; it is made anew in each task from the options, so it must not hold open connections."""

    def schema(self) -> str:
        """Columns of a page, with a string column ``category``."""

    def categories(self) -> list[tuple[str, int]]:
        """Categories and in how many parts each is read."""

    def pages(self, category: str, part: int, parts: int) -> Iterator[pa.RecordBatch]:
        """A part of a category's pages."""


def provider_of(options: dict[str, str]) -> PageProvider:
    """The provider named by ``provider`` (module:class), made from all options."""
    module, _, name = options["provider"].partition(":")
    return getattr(importlib.import_module(module), name)(dict(options))


@dataclass
class CategoryPart(InputPartition):
    category: str
    part: int
    parts: int

    def __post_init__(self) -> None:
        super().__init__((self.category, self.part))


class CategoryReader(DataSourceReader):
    """``wanted`` and ``unwanted`` are what the conditions leave; null is no condition."""

    def __init__(self, options: dict[str, str]):
        self.options, self.wanted, self.unwanted = options, None, set()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            if getattr(inner, "attribute", None) == ("category",) and isinstance(inner, (EqualTo, In)) and (values := inner.value if isinstance(inner, In) else (inner.value,)) and None not in values:
                if isinstance(f, Not):
                    self.unwanted |= set(values)
                else:
                    self.wanted = set(values) if self.wanted is None else self.wanted & set(values)
            elif not (isinstance(f, IsNotNull) and f.attribute == ("category",)):  # a category is never null
                yield f

    def partitions(self) -> list[CategoryPart]:
        known = provider_of(self.options).categories()
        asked = [(c, n) for c, n in known if (self.wanted is None or c in self.wanted) and c not in self.unwanted]
        return [CategoryPart(c, part, n) for c, n in asked for part in range(n)] or [CategoryPart("", 0, 0)]

    def read(self, partition: CategoryPart) -> Iterator[pa.RecordBatch]:
        if partition.parts:
            yield from provider_of(self.options).pages(partition.category, partition.part, partition.parts)


class WikiPages(DataSource):
    """``spark.read.format("wiki_pages").option("provider", "module:Class")``; further options go to the provider."""

    @classmethod
    def name(cls) -> str:
        return "wiki_pages"

    def schema(self) -> str:
        return provider_of(self.options).schema()

    def reader(self, schema: StructType) -> CategoryReader:
        return CategoryReader(dict(self.options))


def provided_pages(spark: SparkSession, provider: str, **options: str) -> DataFrame:
    """The pages of a provider; conditions on their category reach it."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(WikiPages)
    return spark.read.format("wiki_pages").options(provider=provider, **options).load()


@dataclass(frozen=True)
class ProvidedWiki(Wiki):
    """A wiki whose pages come from a provider and the rest from its folder: listings over it run as over any other."""

    provider: str = ""
    options: tuple[tuple[str, str], ...] = ()

    def pages(self) -> DataFrame:
        return provided_pages(self.spark, self.provider, **dict(self.options))
