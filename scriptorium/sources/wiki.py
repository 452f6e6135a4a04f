"""The wiki's tables as DataFrames: pages, tags, users, votes, rating axes, texts and links.

The driver's tables stand in for a wiki's: orders are structured pages, line items give tags, events are
votes, customers are users, documents are page texts, raw web pages give links.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vote of each event type; other types vote 0.
VOTES = {"purchase": 1, "error": -1}
#: Pages that votes go to.
VOTED_PAGES = 1000


def page_key(category: Column, name: Column) -> Column:
    """fullname of a page; pages of the default category have none in front."""
    return F.when(category == "_default", name).otherwise(F.concat_ws(":", category, name))


def split_fullname(fullname: Column) -> tuple[Column, Column]:
    """Category and name, cut at the first colon; no colon means the default category."""
    at = F.instr(fullname, ":")
    category = F.when(at > 0, fullname.substr(F.lit(1), at - 1)).otherwise("_default")
    return category, F.when(at > 0, fullname.substr(at + 1, F.length(fullname))).otherwise(fullname)


#: Rows that a task gets, at most, where rows are counted before they are spread.
SHARE = 250_000


def spread(rows: DataFrame, *keys: str, count: int | None = None) -> DataFrame:
    """The rows dealt by ``keys`` to as many tasks as a shuffle of the session has, and to one for each SHARE of ``count`` rows if that is more;
    where ``count`` gives each core a SHARE at most they stay as they are.

    A table of one row group is read by one task, and adaptive execution puts shuffled rows that compress well into a few tasks, however many
    they are. What is dear for each row, or keeps many of them, is spread before. Joins and groups of the same keys need no other shuffle.
    """
    spark, tasks = rows.sparkSession, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if count is not None:
        if count <= SHARE * spark.sparkContext.defaultParallelism:
            return rows
        tasks = max(tasks, -(-count // SHARE))
    return rows.repartition(tasks, *keys)


@dataclass(frozen=True)
class Wiki:
    """Tables of one wiki, read from a folder of Parquet files; every table is a lazy scan."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def pages(self) -> DataFrame:
        key = F.col("o_orderkey")
        name = F.concat(F.when(key % 97 == 0, "_").otherwise(""), F.lit("order-"), key.cast("string"))
        title = F.when(key % 50 == 0, "").otherwise(F.concat(F.lit("Order "), key.cast("string")))
        return self.table("orders").select(
            key.alias("page_id"),
            F.lower("o_orderstatus").alias("category"),
            name.alias("name"),
            F.concat(F.lower("o_orderstatus"), F.lit(":"), name).alias("fullname"),
            F.coalesce(F.nullif(title, F.lit("")), name).alias("title"),
            F.col("o_orderdate").alias("created_at"),
            (F.col("o_orderdate") + F.make_dt_interval(days=key % 90)).alias("updated_at"),
            F.when(key % 3 != 0, F.col("o_orderdate") + F.make_dt_interval(days=key % 30)).alias("commented_at"),
            F.col("o_custkey").alias("owner_id"),
            (F.col("o_custkey") + key % 2).alias("editor_id"),
            F.when(key % 3 != 0, F.col("o_custkey") + key % 5).alias("commenter_id"),
            F.when(key > 0, F.floor(key / 8)).alias("parent_id"),
            F.floor("o_totalprice").alias("size"),
            (key % 5).alias("comments"),
            (key % 11).alias("revisions"),
            F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("form_data"),
            F.create_map(F.lit("priority"), F.substring_index("o_orderpriority", "-", 1)).alias("form_raw"),
            F.create_map(F.lit("priority"), F.lit("Priority")).alias("form_label"),
            F.create_map(F.lit("priority"), F.concat(F.lit("of order "), key.cast("string"))).alias("form_hint"),
        )

    def metadata(self) -> DataFrame:
        """(page_id, metadata): values under registered keys, each with its type and the user that it names, if any."""
        kinds = {"kind": "string", "text": "string", "number": "double", "date": "timestamp", "user_id": "bigint"}

        def entry(kind: str, **given: Column) -> Column:
            return F.struct(*[(F.lit(kind) if k == "kind" else given.get(k, F.lit(None))).cast(t).alias(k) for k, t in kinds.items()])

        rows = {
            "priority": entry("text", text=F.col("o_orderpriority")),
            "price": entry("number", number=F.col("o_totalprice")),
            "due": entry("date", date=F.col("o_orderdate") + F.make_dt_interval(days=F.lit(30))),
            "buyer": entry("user", user_id=F.col("o_custkey")),
        }
        return self.table("orders").select(F.col("o_orderkey").alias("page_id"), F.create_map(*[x for k, v in rows.items() for x in (F.lit(k), v)]).alias("metadata"))

    @property
    def metadata_keys(self) -> tuple[str, ...]:
        """The registered keys."""
        return ("priority", "price", "due", "buyer")

    def contents(self) -> DataFrame:
        """(page_id, content): sources of the pages that have one."""
        return self.table("documents").select(F.col("doc_id").alias("page_id"), F.col("text").alias("content"))

    def tag_rows(self) -> DataFrame:
        """Tags as often as the table has them: sets are made where they are gathered."""
        bulk = F.when(F.col("l_quantity") >= 49, F.lit("_bulk"))
        found = F.array(F.concat(F.lit("flag-"), F.lower("l_returnflag")), F.concat(F.lit("status-"), F.lower("l_linestatus")), bulk)
        rows = self.table("lineitem").select(F.col("l_orderkey").alias("page_id"), F.explode(F.array_compact(found)).alias("tag"))
        return rows

    def page_tags(self) -> DataFrame:
        """Each tag of each page once."""
        return self.tag_rows().distinct()

    def tag_lists(self) -> DataFrame:
        """Visible and hidden tags of each tagged page, sorted; hidden tags begin with an underscore."""
        lists = self.tag_rows().groupBy("page_id").agg(F.array_sort(F.collect_set("tag")).alias("all"))
        return lists.select("page_id", F.filter("all", lambda t: ~t.startswith("_")).alias("tags"), F.filter("all", lambda t: t.startswith("_")).alias("hidden_tags"))

    def users(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.regexp_replace(F.lower("c_name"), "[^a-z0-9]+", "-").alias("unix_name"))

    def vote_events(self) -> DataFrame:
        """The log of votes as they were cast."""
        rate = F.coalesce(*[F.when(F.col("event_type") == kind, rate) for kind, rate in VOTES.items()], F.lit(0))
        return self.table("events").select(
            F.col("event_id").alias("vote_id"), "user_id", (F.col("event_id") % VOTED_PAGES).alias("page_id"), F.col("event_type").alias("axis_key"), rate.alias("rate"), "ts"
        )

    def axes(self) -> DataFrame:
        """Rating axes: a handful of rows, which votes are allowed on them, and who may cancel."""
        rows = [
            ("click", "Clarity", True, True, True, True, True, True, True),
            ("purchase", "Value", True, False, False, True, False, True, True),
            ("error", "Faults", False, True, True, True, True, True, False),
            ("view", "Reach", True, True, False, False, True, True, True),
            ("signup", "Growth", True, True, True, True, True, False, True),
        ]
        return self.spark.createDataFrame(rows, "axis_key string, label string, allow_up boolean, allow_neutral boolean, allow_down boolean, can_vote boolean, can_cancel boolean, enabled boolean, show_aggregate boolean")

    def texts(self) -> DataFrame:
        """Page texts with tags: the language, and labels as visible (quality) or hidden (toxic) tags."""
        labels = self.table("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
        tags = F.array_compact(F.array("lang", F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "_toxic")))
        docs = self.table("documents").join(labels, "doc_id", "left")
        return docs.select(F.col("doc_id").alias("page_id"), F.concat("source", F.lit(":doc-"), F.col("doc_id").cast("string")).alias("fullname"), F.col("text").alias("source_text"), tags.alias("tags"))

    def links(self) -> DataFrame:
        """(page_id, ord, target): href values of the raw pages, in order."""
        hrefs = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), 1)
        return self.table("pages").select("page_id", F.posexplode(hrefs).alias("ord", "target"))
