"""Many listings at once: a table of queries answered in one plan over classes of the pages and an inverted index of them.

Each query is the selectors of one listing on one page, as columns. Equal selectors are one specification, answered once.
Pages alike in category, tags and in being hidden or at the top are one class. A specification's classes come from an inverted index:
of its conditions that the index knows (a required tag, any of some tags, the same tags, a category, no parent) the one with the
fewest classes is looked up, and its classes are then checked exactly. What else a specification asks (owner, parent, dates) and its order are its
view: the first pages of a class in a view are ranked once for all specifications that show them, a top-k which Spark limits
before the shuffle, and a specification merges those of its classes. Where an owner or a parent has fewer pages than the classes,
its pages are looked up instead and checked against all conditions. So no plan holds the product of pages and queries,
and popular classes and entries are dealt out by a salt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.listing import ORDERS, PER_PAGE, PER_PAGE_MOST, with_ratings
from scriptorium.sources.wiki import Wiki

#: Columns of a query table with their types; those that a table doesn't have are null.
SELECTORS = {
    "category": "string", "tags": "string", "owner_id": "bigint", "parent": "string", "own_id": "bigint", "own_parent": "bigint", "own_category": "string",
    "own_tags": "array<string>", "created_from": "timestamp", "created_before": "timestamp", "pagetype": "string", "order": "string", "offset": "int", "limit": "int",
}
#: Parts of an index entry's pages.
SALT = 16
#: What pages of one class have in common, and the parts of a specification that it decides; the other parts are its view.
FACETS = ("category", "tags", "hidden_tags", "hidden", "top")
_BY_CLASS = ("categories", "not_categories", "required", "forbidden", "any", "any_own", "same", "untagged", "pagetype", "top")
_BY_PAGE = ("owner_id", "parent", "parent_id", "created_from", "created_before", "field", "down")
_NONE = "array<string>"


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def _signed(tokens: Column, sign: str) -> Column:
    return F.transform(F.filter(tokens, lambda t: t.startswith(sign) & (F.length(t) > 1)), lambda t: t.substr(F.lit(2), F.length(t)))


def parsed_queries(queries: DataFrame) -> DataFrame:
    """query_id, ``spec``: the selectors taken apart, alike for queries that ask the same, and the rows that are shown (skip, take).

    ``tags``: ``+t`` required, ``-t`` forbidden, bare ones any, ``=`` any of the page's own visible tags, ``==`` the same
    visible tags, a lone ``-`` none. ``category``: names, ``*``, ``.`` for the page's own, ``-x`` excluded. ``parent``: ``-``, ``=``, ``-=``, ``.``.
    """
    given = queries.select("query_id", *[(F.col(c) if c in queries.columns else F.lit(None)).cast(t).alias(c) for c, t in SELECTORS.items()])
    tokens = _tokens(F.col("tags"))
    own = F.array_sort(F.array_distinct(F.filter(F.coalesce("own_tags", F.array().cast(_NONE)), lambda t: ~t.startswith("_"))))
    same, untagged = (F.size(tokens) == 1) & F.array_contains(tokens, "=="), (F.size(tokens) == 1) & F.array_contains(tokens, "-")
    names = F.filter(F.split(F.lower(F.trim(F.coalesce("category", F.lit("")))), r"[,;\s]+"), lambda n: n != "")
    names = F.transform(F.when(F.size(names) == 0, F.array(F.lit("."))).otherwise(names), lambda n: F.when(n == ".", F.col("own_category")).when(n == "-.", F.concat(F.lit("-"), "own_category")).otherwise(n))
    wanted, unwanted = F.filter(names, lambda n: ~n.startswith("-")), _signed(names, "-")
    every = F.array_contains(wanted, "*") | (F.size(wanted) == 0)
    words = F.split(F.lower(F.trim(F.coalesce("order", F.lit("")))), r"\s+")
    known = F.create_map(*[F.lit(x) for pair in ORDERS.items() for x in pair])
    field = F.try_element_at(known, F.get(words, F.lit(0)))
    empty = F.array().cast(_NONE)
    parent = F.trim("parent")
    spec = F.struct(
        F.when(~every, F.array_sort(F.array_distinct(wanted))).alias("categories"),
        F.array_sort(F.array_distinct(unwanted)).alias("not_categories"),
        F.when(same | untagged, empty).otherwise(F.array_sort(F.array_distinct(_signed(tokens, "+")))).alias("required"),
        F.when(same | untagged, empty).otherwise(F.array_sort(F.array_distinct(_signed(tokens, "-")))).alias("forbidden"),
        F.array_sort(F.array_distinct(F.filter(tokens, lambda t: ~F.substring(t, 1, 1).isin("+", "-", "=")))).alias("any"),
        F.when(~same & F.array_contains(tokens, "="), own).alias("any_own"),
        F.when(same, own).alias("same"),
        untagged.alias("untagged"),
        "owner_id",
        F.when(parent.isin("-", "=", "-=", "."), parent).alias("parent"),
        F.when(parent.isin("=", "-="), F.col("own_parent")).when(parent == ".", F.col("own_id")).alias("parent_id"),
        "created_from",
        "created_before",
        F.coalesce("pagetype", F.lit("normal")).alias("pagetype"),
        F.coalesce((parent == "-") | ((parent == "=") & F.col("own_parent").isNull()), F.lit(False)).alias("top"),
        F.coalesce(field, F.lit("created_at")).alias("field"),
        (field.isNull() | (F.coalesce(F.get(words, F.lit(1)), F.lit("desc")) != "asc")).alias("down"),
    )
    skip = F.greatest(F.coalesce("offset", F.lit(0)), F.lit(0))
    take = F.least(F.when(F.col("limit") < 0, PER_PAGE).otherwise(F.coalesce("limit", F.lit(PER_PAGE))), F.lit(PER_PAGE_MOST))
    return given.select("query_id", spec.alias("spec"), skip.alias("skip"), take.alias("take"))


def _entry(kind: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{kind}:"), value.cast("string")))


def class_index(classes: DataFrame) -> DataFrame:
    """(entry, class_id): each class under its tags, its set of visible tags, its category, and whether its pages have no parent."""
    single = [_entry("tags", F.array_join("tags", " ")), _entry("category", F.col("category")), F.when(F.col("top"), "top:")]
    tagged = F.transform(F.array_distinct(F.array_union("tags", "hidden_tags")), lambda t: F.concat(F.lit("tag:"), t))
    return classes.select(F.explode(F.array_compact(F.concat(F.array(*single), tagged))).alias("entry"), "class_id")


def page_index(pages: DataFrame) -> DataFrame:
    """(entry, page_id): each page under its owner and its parent."""
    return pages.select(F.explode(F.array_compact(F.array(_entry("owner", F.col("owner_id")), _entry("parent", F.col("parent_id"))))).alias("entry"), "page_id")


def _groups(spec: Column) -> Column:
    """The ways to look a specification's classes up: each a list of entries that together have all of them."""
    named = lambda kind, values: F.transform(values, lambda v: F.concat(F.lit(f"{kind}:"), v))
    ways = F.array(
        F.when(spec["same"].isNotNull(), F.array(F.concat(F.lit("tags:"), F.array_join(spec["same"], " ")))),
        F.when(F.size(spec["any"]) > 0, named("tag", spec["any"])),
        F.when(spec["any_own"].isNotNull(), named("tag", spec["any_own"])),
        F.when(spec["categories"].isNotNull(), named("category", spec["categories"])),
        F.when(spec["top"], F.array(F.lit("top:"))),
    )
    return F.array_compact(F.concat(ways, F.transform(spec["required"], lambda t: F.array(F.concat(F.lit("tag:"), t)))))


def _entries(spec: Column) -> Column:
    """Entries of the page index that a specification's pages all stand under; one that no page has where nothing fits."""
    below = F.when(spec["parent"].isin("=", ".") & spec["parent_id"].isNotNull(), _entry("parent", spec["parent_id"])).when((spec["parent"] == ".") & spec["parent_id"].isNull(), "none:")
    return F.array_compact(F.array(_entry("owner", spec["owner_id"]), below))


def _all(rules: list[Column]) -> Column:
    return reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), rules, F.lit(True))


def _fits_class(spec: Column) -> Column:
    """The conditions of a specification that a class decides."""
    every = F.array_union("tags", "hidden_tags")
    return _all([
        spec["categories"].isNull() | F.array_contains(spec["categories"], F.col("category")),
        ~F.array_contains(spec["not_categories"], F.col("category")),
        F.size(F.array_except(spec["required"], every)) == 0,
        ~F.arrays_overlap(spec["forbidden"], every),
        (F.size(spec["any"]) == 0) | F.arrays_overlap(spec["any"], every),
        spec["any_own"].isNull() | F.arrays_overlap(spec["any_own"], F.col("tags")),
        spec["same"].isNull() | (spec["same"] == F.array_sort(F.array_distinct("tags"))),
        ~spec["untagged"] | (F.size(every) == 0),
        F.when(spec["pagetype"] == "normal", ~F.col("hidden")).when(spec["pagetype"] == "hidden", F.col("hidden")).otherwise(True),
        ~spec["top"] | F.col("top"),
    ])


def _fits_page(view: Column) -> Column:
    """The other conditions, over a page's columns."""
    return _all([
        view["owner_id"].isNull() | (view["owner_id"] == F.col("owner_id")),
        view["parent"].isNull() | F.when(view["parent"] == "-", F.col("parent_id").isNull()).when(view["parent"] == "-=", ~F.col("parent_id").eqNullSafe(view["parent_id"]))
        .when(view["parent"] == "=", F.col("parent_id").eqNullSafe(view["parent_id"])).otherwise(F.col("parent_id") == view["parent_id"]),
        view["created_from"].isNull() | (F.col("created_at") >= view["created_from"]),
        view["created_before"].isNull() | (F.col("created_at") < view["created_before"]),
    ])


def _digest(value: Column) -> Column:
    return F.unhex(F.sha2(F.to_json(value, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}), 256))


def _classes_of(wanted: DataFrame, classes: DataFrame) -> DataFrame:
    """(facet_id, class_id, pages): the classes that fit each (facet_id, spec), by the index entry that has the fewest."""
    index = class_index(classes)
    ways = wanted.select("facet_id", F.posexplode(_groups(F.col("spec"))).alias("way", "entries")).select("facet_id", "way", F.explode_outer("entries").alias("entry"))
    counts = index.join(ways.select("entry").distinct(), "entry", "left_semi").groupBy("entry").agg(F.count("*").alias("classes"))
    costs = ways.join(counts, "entry", "left").groupBy("facet_id", "way").agg(F.coalesce(F.sum("classes"), F.lit(0)).alias("classes"), F.collect_set("entry").alias("entries"))
    best = costs.groupBy("facet_id").agg(F.min(F.struct("classes", "way", "entries"))["entries"].alias("entries"))
    salt, salts = F.pmod(F.xxhash64("class_id"), F.lit(SALT)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    looked = best.select("facet_id", F.explode("entries").alias("entry")).withColumn("salt", salts)
    found = looked.join(index.withColumn("salt", salt), ["entry", "salt"]).select("facet_id", "class_id").distinct()
    # Without a condition that the index knows, the specification's classes are most classes: these few specifications meet all.
    rest = wanted.join(best, "facet_id", "left_anti").select("facet_id").withColumn("salt", salts)
    found = found.unionByName(rest.join(classes.select("class_id", salt.alias("salt")), "salt").select("facet_id", "class_id"))
    return found.join(wanted, "facet_id").join(classes, "class_id").filter(_fits_class(F.col("spec"))).select("facet_id", "class_id", "pages")


def batch_listings(wiki: Wiki, queries: DataFrame, rated: bool = False, materialize=None) -> DataFrame:
    """(query_id, index, page_id, total) of every listing of a query table; see ``parsed_queries`` for its columns.

    ``rated``: orders by rating and votes are wanted, so votes are joined. A query that nothing fits has no row. ``total`` counts the matches
    before paging. Views differ by dates, owners and orders: pages are ranked once for each view that shows their class. ``materialize``
    cuts lineage (by default a checkpoint): what is read twice is made once.
    """
    materialize = materialize or (lambda df: df.checkpoint())
    none = F.array().cast(_NONE)
    pages = wiki.pages().join(wiki.tag_lists(), "page_id", "left").withColumns({c: F.coalesce(c, none) for c in ("tags", "hidden_tags")})
    pages = pages.withColumns({"hidden": F.col("name").startswith("_"), "top": F.col("parent_id").isNull()}).withColumn("class_id", _digest(F.struct(*FACETS)))
    pages = pages.select("page_id", "class_id", *FACETS, "fullname", "title", "created_at", "updated_at", "commented_at", "owner_id", "parent_id", "size", "comments", "revisions")
    pages = with_ratings(pages, wiki).drop("rating_percent") if rated else pages.withColumns({c: F.lit(0).cast("long") for c in ("rating", "rating_votes")})
    pages = materialize(pages)
    asked = materialize(parsed_queries(queries).withColumn("spec_id", _digest(F.col("spec"))))
    spec = F.col("spec")
    specs = asked.groupBy("spec_id").agg(F.first("spec").alias("spec"))
    specs = materialize(specs.select("spec_id", "spec", _digest(F.struct(*[spec[c] for c in _BY_CLASS])).alias("facet_id"), F.struct(*[spec[c].alias(c) for c in _BY_PAGE]).alias("view")))

    classes = materialize(pages.groupBy("class_id", *FACETS).agg(F.count("*").alias("pages")))
    met = materialize(_classes_of(specs.groupBy("facet_id").agg(F.first("spec").alias("spec")), classes))
    by_class = met.groupBy("facet_id").agg(F.sum("pages").alias("by_class"))
    index = page_index(pages)
    ways = specs.select("spec_id", F.explode(_entries(spec)).alias("entry"))
    index = index.join(ways.select("entry").distinct(), "entry", "left_semi")
    costs = ways.join(index.groupBy("entry").agg(F.count("*").alias("pages")), "entry", "left").select("spec_id", F.struct(F.coalesce("pages", F.lit(0)).alias("pages"), "entry").alias("way"))
    plans = specs.join(by_class, "facet_id").join(costs.groupBy("spec_id").agg(F.min("way").alias("way")), "spec_id", "left")
    plans = materialize(plans.withColumn("entry", F.when(F.col("way.pages") <= F.col("by_class"), F.col("way.entry"))).drop("way", "by_class"))

    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int")
    near = plans.filter("entry is not null")
    found = near.select("spec_id", "entry", salts.alias("salt")).join(index.withColumn("salt", salt), ["entry", "salt"]).select("spec_id", "page_id")
    keys = lambda of: [o.alias(f"o{n}") for n, o in enumerate(_keys(of))]
    fits = materialize(found.join(near.select("spec_id", "spec"), "spec_id").join(pages, "page_id").filter(_fits_class(spec) & _fits_page(spec)).select("spec_id", "page_id", *keys(spec)))

    most = int(asked.agg(F.max(F.col("skip") + F.col("take")).alias("most")).first()["most"] or 0)
    order = [F.col("o0").asc_nulls_last(), F.col("o1").asc_nulls_last(), F.col("o2").desc_nulls_last(), F.col("o3").asc()]
    ranked = lambda rows, by: rows.withColumn("index", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("index") <= most)
    # A part is a class in a view; ``shown_in`` has the parts of each specification.
    far = plans.filter("entry is null").select("spec_id", "facet_id", "view").join(met.drop("pages"), "facet_id")
    shown_in = materialize(far.select("spec_id", "class_id", "view", _digest(F.struct(F.hex("class_id").alias("class_id"), "view")).alias("part")))
    needed = shown_in.groupBy("part").agg(F.first("class_id").alias("class_id"), F.first("view").alias("view")).withColumn("salt", salts)
    view = F.col("view")
    hits = pages.withColumn("salt", salt).join(needed, ["class_id", "salt"]).filter(_fits_page(view))
    sizes = materialize(hits.groupBy("part").agg(F.count("*").alias("total")))
    tops = materialize(ranked(hits.select("part", "page_id", *keys(view)), "part").drop("index"))
    parts = shown_in.select("spec_id", "part")

    first = ranked(fits.unionByName(parts.join(tops, "part").drop("part")), "spec_id")
    totals = fits.groupBy("spec_id").agg(F.count("*").alias("total")).unionByName(parts.join(sizes, "part").groupBy("spec_id").agg(F.sum("total").alias("total")))
    rows = first.join(totals, "spec_id").select("spec_id", F.col("index").cast("long").alias("index"), "page_id", "total")
    shown = asked.select("query_id", "spec_id", "skip", "take").join(rows, "spec_id").filter((F.col("index") > F.col("skip")) & (F.col("index") <= F.col("skip") + F.col("take")))
    return shown.select("query_id", "index", "page_id", "total")


def _keys(spec: Column) -> list[Column]:
    """The columns that ``batch_listings`` ranks by, narrow so that they can be kept."""
    numbers = {"created_at": F.unix_micros(F.col("created_at").cast("timestamp")), "updated_at": F.unix_micros(F.col("updated_at").cast("timestamp")), "commented_at": F.unix_micros(F.col("commented_at").cast("timestamp")), "random": F.xxhash64("page_id")}
    numbers |= {c: F.col(c).cast("long") for c in ("rating", "rating_votes", "revisions", "comments", "size")}
    pick = lambda of: F.coalesce(*[F.when(spec["field"] == c, v) for c, v in of.items()])
    number, text, down = pick(numbers), pick({c: F.col(c) for c in ("title", "fullname")}), spec["down"]
    return [F.when(down, -number).otherwise(number), F.when(~down, text), F.when(down, text), F.when(down, -F.col("page_id")).otherwise(F.col("page_id"))]
