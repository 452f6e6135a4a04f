"""Trees from flat lists with depths, by one fold with a stack for each list, and multisets by numbered occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import let

_ROW = "struct<depth:int,kind:string,list:int,above:int,last:int>"
_OUT = "struct<list:int,above:int,parent:int>"


def depth_places(items: Column) -> Column:
    """For an array of (depth, kind) in order, an array of (list, above, parent).

    ``parent`` is the place of the last item before with a smaller depth, null at the top. ``list`` numbers the lists that items
    stand in: going down opens a list for each level, going up closes them, and another kind on the same level is a new list;
    ``above`` is the list around, null for the outermost. Places and lists count from 0. A depth under 0 counts as 0, a null one too.
    """
    start = F.struct(F.array().cast(f"array<{_ROW}>").alias("stack"), F.lit(0).alias("lists"), F.array().cast(f"array<{_OUT}>").alias("out"))

    def row(depth: Column, kind: Column, number: Column, above: Column, last: Column) -> Column:
        return F.struct(depth.cast("int").alias("depth"), kind.alias("kind"), number.cast("int").alias("list"), above.cast("int").alias("above"), last.cast("int").alias("last")).cast(_ROW)

    def step(s: Column, x: Column) -> Column:
        """The stack's top stands last; each open level is a row with the last item that stands in its list. What is named more than once is bound
        by ``let``: a fold is evaluated as it is written."""
        def opened(d: Column, kept: Column) -> Column:
            there = F.size(kept)
            above = F.get(kept, there - 1)["list"]
            fresh = F.transform(F.sequence(there, d), lambda level: row(level, x["kind"], s["lists"] + level - there, F.when(level > there, s["lists"] + level - there - 1).otherwise(above), none))
            return let(F.when(there <= d, F.concat(kept, fresh)).otherwise(kept), lambda grown: placed(d, there, grown))

        def placed(d: Column, there: Column, grown: Column) -> Column:
            # An item on a level that was open has another list where it is of another kind.
            last = F.get(grown, d)
            other = (there > d) & ~last["kind"].eqNullSafe(x["kind"])
            lists = s["lists"] + F.when(there <= d, d - there + 1).when(other, 1).otherwise(0)
            mine = let(last, lambda last: F.when(other, row(d, x["kind"], s["lists"], last["above"], none)).otherwise(last))
            return let(mine, lambda mine: let(F.slice(grown, 1, d), lambda below: put(d, mine, below, lists)))

        def put(d: Column, mine: Column, below: Column, lists: Column) -> Column:
            stack = F.concat(below, F.array(row(d, mine["kind"], mine["list"], mine["above"], F.size(s["out"]))))
            parent = F.array_max(F.transform(below, lambda r: r["last"]))
            out = F.concat(s["out"], F.array(F.struct(mine["list"].alias("list"), mine["above"].alias("above"), parent.alias("parent")).cast(_OUT)))
            return F.struct(stack.alias("stack"), lists.cast("int").alias("lists"), out.alias("out"))

        none = F.lit(None).cast("int")
        depth = F.greatest(F.coalesce(x["depth"].cast("int"), F.lit(0)), F.lit(0))
        return let(depth, lambda d: let(F.slice(s["stack"], 1, F.least(F.size(s["stack"]), d + 1)), lambda kept: opened(d, kept)))

    return F.aggregate(items, start, step)["out"]


def depth_tree(rows: DataFrame, key: str, order: str, depth: str, kind: str | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (key, order, depth, kind, and what ``also`` names) with ``list``, ``above`` and ``parent``, which is the order of the item above: one
    shuffle by key and one fold, whatever the depths."""
    item = F.struct(F.col(order).alias("order"), F.col(depth).cast("int").alias("depth"), (F.col(kind) if kind else F.lit("")).cast("string").alias("kind"), *also)
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    places = lists.withColumn("places", depth_places(F.col("items"))).select(key, "items", F.posexplode(F.arrays_zip("items", "places")).alias("n", "x"))
    parent = F.get(F.col("items"), F.col("x.places.parent"))["order"]
    return places.select(key, F.col("x.items.order").alias(order), F.col("x.items.depth").alias(depth), *([F.col("x.items.kind").alias(kind)] if kind else []), *[F.col(f"x.items.{c}") for c in also], F.col("x.places.list").alias("list"), F.col("x.places.above").alias("above"), parent.alias("parent"))


def numbered(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``rows`` with ``occurrence``: which of the rows of equal keys each is, from 1 in order."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def without_occurrences(rows: DataFrame, gone: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A multiset difference: for each row of ``gone`` the first row of equal keys that is still there goes; the rest keeps its order."""
    counts = gone.groupBy(*keys).agg(F.count("*").alias("_gone"))
    left = numbered(rows, keys, order).join(counts, keys, "left").filter(F.col("occurrence") > F.coalesce("_gone", F.lit(0)))
    return left.select(*rows.columns)


def merged_styles(existing: DataFrame, collected: DataFrame, anchored: DataFrame, slots: DataFrame, marker: str = "slot:") -> DataFrame:
    """(page_id, ord, style): a page's styles after another pass over it. All tables are (page_id, ord, style); ``slots`` (page_id, style,
    ord, value) says what stands in a marker's slot, if that is known.

    First come the styles that were there, without one for each anchored style and each collected marker, and without markers;
    then what was collected, a marker by the styles of its slot, or as itself while they aren't known.
    """
    keys = ["page_id", "style"]
    is_marker = F.col("style").startswith(marker)
    marks = collected.filter(is_marker)
    before = without_occurrences(existing, anchored.select(*keys).unionByName(marks.select(*keys)), keys, "ord").filter(~is_marker)
    filled = collected.join(slots.select("page_id", "style", F.col("ord").alias("slot_ord"), "value"), keys, "left")
    after = filled.select("page_id", "ord", F.coalesce("slot_ord", F.lit(0)).alias("slot_ord"), F.when(is_marker & F.col("slot_ord").isNotNull(), F.col("value")).otherwise(F.col("style")).alias("style"))
    both = before.select("page_id", F.lit(0).alias("part"), "ord", F.lit(0).alias("slot_ord"), "style").unionByName(after.withColumn("part", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("part", "ord", "slot_ord")) - 1
    return both.select("page_id", place.alias("ord"), "style")
