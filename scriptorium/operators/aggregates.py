"""Aggregate modules: tag cloud, categories, link graph, page tree and include expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import regions
from scriptorium.functions.text import let, url_component
from scriptorium.sources.wiki import Wiki, spread


def _visible_tags(wiki: Wiki, tags: DataFrame, category: str | None) -> DataFrame:
    """Rows of ``tags`` (page_id, tag) that are shown, of the pages of a category if one is given."""
    tags = tags.filter(~F.col("tag").startswith("_"))
    if category:
        tags = tags.join(wiki.pages().filter(F.col("category") == category).select("page_id"), "page_id", "left_semi")
    return tags


def tag_counts(wiki: Wiki, category: str | None = None) -> DataFrame:
    """Visible tags with the number of their pages. The rows are spread by page before each tag of a page is taken once: a table of a few
    large parts would give their tasks all the pairs of page and tag to hold."""
    tags = _visible_tags(wiki, spread(wiki.tag_rows(), "page_id"), category)
    return tags.distinct().groupBy("tag").agg(F.count("*").alias("weight"))


def scaled(low: float, high: float, share: Column) -> Column:
    """Linear between two values, rounded with halves up."""
    return F.floor(F.lit(low) + F.lit(high - low) * share + 0.5).cast("int")


def cloud_limit(given: str | None) -> int:
    """A tag cloud's limit from its attribute: digits that make a number over 0, else 50."""
    return int(given) if given and given.isascii() and given.isdecimal() and 0 < int(given) < 1 << 53 else 50


def cloud_status(wiki: Wiki, category: str | None = None) -> DataFrame:
    """One row (status, message): ``ok``, ``no-tags``, or ``category-not-found`` where no page is in the category."""
    pages = wiki.pages() if category is None else wiki.pages().filter(F.col("category") == category)
    there = pages.select(F.lit(1).alias("n")).limit(1).agg(F.count("*").alias("found"))
    # Whether there is a tag, not how many: no row needs to be known apart from another one.
    tagged = _visible_tags(wiki, wiki.tag_rows(), category).limit(1).agg(F.count("*").alias("tags"))
    missing = F.lit(category is not None) & (F.col("found") == 0)
    status = F.when(missing, "category-not-found").when(F.col("tags") == 0, "no-tags").otherwise("ok")
    message = F.when(missing, F.lit(f'Category "{category}" can not be found.'))
    return there.crossJoin(tagged).select(status.alias("status"), message.alias("message"))  # one row with one row


def tag_cloud(wiki: Wiki, category: str | None = None, limit: int = 50, sizes: tuple[int, int] = (100, 300), colors: tuple[tuple[int, int, int], tuple[int, int, int]] = ((128, 128, 192), (64, 64, 128)), target: str = "/system:page-tags/tag/", unit: str = "%") -> DataFrame:
    """The heaviest tags, in order of name, with size, color and link. Only the top-k meets in one task."""
    top = tag_counts(wiki, category).orderBy(F.col("weight").desc(), "tag").limit(limit)
    everything = Window.partitionBy()  # over the top-k only
    low, high = F.min("weight").over(everything), F.max("weight").over(everything)
    share = F.when(high == low, F.lit(0.0)).otherwise((F.col("weight") - low) / (high - low))
    suffix = F.concat(F.lit("/category/"), url_component(F.lit(category))) if category else F.lit("")
    rgb = F.concat_ws(", ", *[scaled(a, b, F.col("share")).cast("string") for a, b in zip(*colors)])
    style = F.concat(F.lit("font-size: "), scaled(*sizes, F.col("share")).cast("string"), F.lit(f"{unit}; color: rgb("), rgb, F.lit(");"))
    return top.withColumn("share", share).select("tag", "weight", F.concat(F.lit(target), url_component(F.col("tag")), suffix).alias("href"), style.alias("style")).orderBy("tag")


def categories(wiki: Wiki, hidden: bool = False) -> DataFrame:
    """Categories with their number of pages; those that begin with an underscore are hidden."""
    found = wiki.pages().groupBy("category").agg(F.count("*").alias("pages"))
    return found if hidden else found.filter(~F.col("category").startswith("_"))


def backlinks(wiki: Wiki) -> DataFrame:
    """Per target: the pages that link to it and how many links there are."""
    return wiki.links().groupBy("target").agg(F.count("*").alias("links"), F.countDistinct("page_id").alias("pages"), F.min("page_id").alias("first_page"))


def missing_links(wiki: Wiki, known: DataFrame) -> DataFrame:
    """Links whose target no page has."""
    return wiki.links().join(known, "target", "left_anti")


def page_tree(wiki: Wiki, root: int, depth: int) -> DataFrame:
    """Pages under a root, level by level: a join for each level, of the last level only."""
    pages = wiki.pages().select("page_id", "parent_id", "fullname")
    level = pages.filter(F.col("page_id") == root).select("page_id", F.lit(0).alias("depth"), F.col("fullname").alias("path"))
    found = level
    for d in range(1, depth + 1):
        below = level.select(F.col("page_id").alias("parent_id"), F.col("path").alias("above"))
        level = pages.join(below, "parent_id").select("page_id", F.lit(d).alias("depth"), F.concat_ws("/", "above", "fullname").alias("path"))
        found = found.unionByName(level)
    return found


#: Rounds of includes, and the longest text that including may give.
INCLUDE_ROUNDS, INCLUDE_MOST = 10, 1_000_000
#: A directive at the start of a line: its page, ``page`` or ``:site:page``, and its arguments. Double brackets inside them
#: (a link, a module) don't end it; one level of them is known. The parts of the arguments begin differently and none of them can
#: begin with what ends the directive, so none is ever given back.
INCLUDE = r"(?im)^\[\[include\s+([^\s\]|]+)((?:[^\[\]]++|\[\[\[[^\[\]\n]*\]\]\]|\[\[[^\[\]\n]*\]\]|\[(?!\[)|\](?!\]))*+)\]\]"


#: The name that a directive includes; as no part of INCLUDE gives anything back, it is the name that INCLUDE finds.
INCLUDED = r"(?i)^\[\[include\s+([^\s\]|]+)"


def _target(directive: Column) -> Column:
    return F.lower(F.regexp_extract(directive, INCLUDED, 1))


def _away(target: Column) -> Column:
    """Whether a target names a site."""
    return target.rlike("^:[^:]*:")


def _site_and_page(target: Column) -> tuple[Column, Column]:
    return F.when(_away(target), F.regexp_extract(target, "^:([^:]*):", 1)), F.when(_away(target), F.regexp_replace(target, "^:[^:]*:", "")).otherwise(target)


def _assignments(directive: Column, raws: Column) -> Column:
    """(key, value) of a directive that still has the marks of ``raws``."""
    given = directive.substr(F.length(F.regexp_extract(directive, INCLUDED, 0)) + 1, F.length(directive) - F.length(F.regexp_extract(directive, INCLUDED, 0)) - 2)
    pairs = F.filter(F.split(given, r"\|"), lambda p: F.trim(p).rlike(r"^[^=]+=\s*\S"))
    # The first assignment of a key takes all its places.
    keyed = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.regexp_replace(F.regexp_replace(p, "^[^=]*=", ""), r"^\s+|\s+$", "").alias("value")))
    return F.transform(keyed, lambda a: F.struct(a["key"], regions.restored(a["value"], raws).alias("value")))


def include_edges(texts: DataFrame, *also: str) -> DataFrame:
    """(page_id, ord, directive, site, page, assignments): what each text includes, in order; a null site is this one.
    Directives in raw regions are none, and raw regions in a value are part of it. ``also``: other columns of the texts to keep."""
    masked, raws = regions.masked(F.col("source_text"))
    # Made before the rows are exploded, so once for each text.
    parted = texts.select("page_id", *also, masked.alias("_masked"), raws.alias("_raws"))
    rows = parted.select("page_id", *also, "_raws", F.posexplode(F.regexp_extract_all("_masked", F.lit(INCLUDE), 0)).alias("ord", "directive")).withColumn("_target", _target(F.col("directive")))
    site, page = _site_and_page(F.col("_target"))
    assignments = _assignments(F.col("directive"), F.col("_raws"))
    return rows.select("page_id", *also, "ord", regions.restored(F.col("directive"), F.col("_raws")).alias("directive"), site.alias("site"), page.alias("page"), assignments.alias("assignments"))


def substituted(content: Column, assignments: Column, most: int = INCLUDE_MOST) -> Column:
    """Each ``{$key}`` replaced by its assignment, one assignment after the other. A value may hold later places, so a text can
    double at each; null stands for one that would pass ``most``, before it is made."""

    def step(text: Column, a: Column) -> Column:
        place = F.concat(F.lit("{$"), a["key"], F.lit("}"))
        gone = F.length(text) - F.length(F.replace(text, place, F.lit("")))
        grown = F.length(text) - gone + gone / F.length(place) * F.length(a["value"])
        # Most texts have no place of most keys.
        return F.when(~text.contains(place), text).when(grown <= most, F.replace(text, place, a["value"]))

    return F.aggregate(assignments, content, step)


def expand_includes(texts: DataFrame, library: DataFrame, rounds: int = INCLUDE_ROUNDS, most: int = INCLUDE_MOST, materialize=None, trace: bool = False, only: list[str] | None = None) -> DataFrame:
    """Texts with includes put in place: (page_id, source_text, rounds, too_long), with ``trace`` also ``included``:
    round, place and page of what was put in.

    Each round parts the texts that still have directives once, at these, joins the directives to ``library`` (page, content, and
    site for pages of other sites, null for this one), and puts the parts together again; it stops where none is left, and only texts
    with something to put in go to the next round. A page that includes itself keeps the directive; a missing page gives an error block; a
    text over ``most`` is left as it was before the round. ``only``: no other pages than these are put in. ``materialize`` cuts lineage.
    """
    materialize = materialize or (lambda df: df.checkpoint())
    step = "array<struct<round:int,ord:int,page:string>>"
    kept = ["page_id", "source_text", "rounds", "too_long", "included"]
    sites = F.lower("site") if "site" in library.columns else F.lit(None).cast("string")
    library = library.select("page", F.coalesce(sites, F.lit("")).alias("from"), "content")
    # Texts are spread once, by page: what is grouped by page stays in its task.
    state = spread(texts.select("page_id", "fullname", "source_text"), "page_id").select("page_id", F.lower("fullname").alias("own"), "source_text", F.lit(0).alias("rounds"), F.lit(False).alias("too_long"), F.array().cast(step).alias("included"))

    def wanted(target: Column) -> Column:
        found = (target != F.col("own")) | _away(target)
        return F.coalesce(found if only is None else found & target.isin(only), F.lit(False))

    masked, raws = regions.masked(F.col("source_text"))
    found = F.regexp_extract_all("_masked", F.lit(INCLUDE), 0)
    done = []
    for number in range(1, rounds + 1):
        # A part is the text before a directive and the directive, the last one has no directive. Rows of one page are told apart by a number.
        parted = state.select("page_id", "own", "rounds", "included", masked.alias("_masked"), raws.alias("_raws"), F.monotonically_increasing_id().alias("_row"))
        pieces = F.arrays_zip(F.split("_masked", INCLUDE).alias("gap"), found.alias("directive"))
        rows = parted.select("page_id", "_row", "own", "rounds", "included", "_raws", F.posexplode_outer(pieces).alias("ord", "_piece")).select("*", "_piece.gap", "_piece.directive")
        rows = rows.withColumn("_target", _target(F.col("directive"))).withColumn("wanted", wanted(F.col("_target")))
        site, page = _site_and_page(F.col("_target"))
        rows = rows.withColumns({"page": F.when(F.col("wanted"), page), "from": F.when(F.col("wanted"), F.coalesce(site, F.lit("")))})
        content = F.col("content")
        missing = F.concat(F.lit('[[div class="error-block"]]\nPage to be included "'), F.col("page"), F.lit('" cannot be found!\n[[/div]]'))
        put = F.when(F.col("wanted"), F.when(content.isNull(), missing).otherwise(substituted(content, _assignments(F.col("directive"), F.col("_raws")), most)))
        own = F.coalesce(regions.restored(F.col("directive"), F.col("_raws")), F.lit(""))
        part = F.struct("ord", regions.restored(F.col("gap"), F.col("_raws")).alias("gap"), own.alias("directive"), put.alias("text"), "page", "wanted")
        joined = rows.join(library, ["page", "from"], "left").select("page_id", "_row", "own", "rounds", "included", part.alias("part"))
        whole = joined.groupBy("page_id", "_row").agg(*[F.first(c).alias(c) for c in ("own", "rounds", "included")], F.array_sort(F.collect_list("part")).alias("parts"))

        def put_together(shown) -> Column:
            parts = F.col("parts")
            return F.when(F.size(parts) == 1, parts[0]["gap"]).otherwise(F.array_join(F.flatten(F.transform(parts, lambda p: F.array(p["gap"], shown(p)))), ""))

        shown = lambda p: F.when(p["wanted"], p["text"]).otherwise(p["directive"])
        # Known before the text is made: a part that passed the limit, or parts that do together.
        put_in = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.length(shown(p)))
        some = F.exists("parts", lambda p: p["wanted"])
        made = whole.withColumn("made", F.when(some & (put_in <= most), put_together(shown)))
        changed = F.coalesce(F.length("made") <= most, F.lit(False))
        made = made.withColumn("changed", changed).withColumn("source_text", F.when(F.col("changed"), F.col("made")).otherwise(put_together(lambda p: p["directive"])))
        added = F.transform(F.filter("parts", lambda p: p["wanted"]), lambda p: F.struct(F.lit(number).alias("round"), p["ord"].cast("int").alias("ord"), p["page"].alias("page")))
        made = made.select(
            "page_id", "own", "source_text", F.when(F.col("changed"), F.lit(number)).otherwise(F.col("rounds")).alias("rounds"),
            (~F.col("changed") & (some | F.coalesce(F.length("source_text") > most, F.lit(False)))).alias("too_long"),
            F.when(F.col("changed"), F.concat("included", added)).otherwise(F.col("included")).alias("included"), F.when(F.col("changed"), masked).alias("_masked"),
        )
        state = materialize(made.withColumn("open", F.coalesce(F.exists(found, lambda d: wanted(_target(d))), F.lit(False))).drop("_masked"))
        done.append(state.filter(~F.col("open")).select(*kept))
        state = state.filter("open").drop("open")
        if state.isEmpty():
            break
    else:
        done.append(state.select(*kept))
    out = reduce(DataFrame.unionByName, done)
    return out if trace else out.drop("included")


#: A tag condition around text without another one in it.
IFTAGS = r"(?i)\[\[iftags\s*([^\]]*)\]\]((?:(?!\[\[/?iftags)[\s\S])*?)\[\[/iftags\]\]"


def condition_holds(condition: Column, tags: Column) -> Column:
    """A tag condition given as a column: as TagCondition, with the tokens in the row."""
    named = lambda tokens, sign: F.transform(F.filter(tokens, lambda t: t.startswith(sign) & (F.length(t) > 1)), lambda t: F.substring(t, 2, 1 << 20))

    def met(tokens: Column) -> Column:
        bare = F.filter(tokens, lambda t: ~t.rlike("^[+-]"))
        holds = F.forall(named(tokens, "+"), lambda t: F.array_contains(tags, t)) & ~F.arrays_overlap(named(tokens, "-"), tags) & let(bare, lambda bare: (F.size(bare) == 0) | F.arrays_overlap(bare, tags))
        return (F.size(tokens) > 0) & ~F.array_contains(tokens, "+") & holds

    return let(F.filter(F.split(F.trim(condition), r"\s+"), lambda t: t != ""), met)


def expand_iftags(texts: DataFrame, rounds: int = 10, materialize=None) -> DataFrame:
    """(page_id, source_text) with tag conditions resolved, innermost first; a round takes one level of nesting.
    Where tags are null nothing can be decided yet, and the text stays as it is; so do raw regions, wherever conditions leave them.

    The rounds are a fold inside each row, as a condition looks at its own page only: nothing is shuffled or stored, so ``materialize`` has no
    history to cut."""
    masked, raws = regions.masked(F.col("source_text"))
    state = texts.select("page_id", "tags", masked.alias("source_text"), raws.alias("raws"))

    def left(directive: Column) -> Column:
        return F.when(condition_holds(F.regexp_extract(directive, IFTAGS, 1), F.col("tags")), F.regexp_extract(directive, IFTAGS, 2)).otherwise("")

    def step(s: Column, _: Column) -> Column:
        def placed(found: Column) -> Column:
            # Each condition's own place: the text between conditions and what is left of them, in turn.
            swaps = F.concat(F.transform(found, left), F.array(F.lit("")))
            made = F.array_join(F.zip_with(F.split(s["text"], IFTAGS, -1), swaps, lambda gap, swap: F.concat(gap, swap)), "")
            return F.struct(F.when(F.size(found) > 0, made).otherwise(s["text"]).alias("text"), (F.size(found) > 0).alias("open"))

        return let(F.when(s["open"], F.regexp_extract_all(s["text"], F.lit(IFTAGS), 0)).otherwise(F.array().cast("array<string>")), placed)

    start = F.struct(F.col("source_text").alias("text"), F.col("tags").isNotNull().alias("open"))
    made = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)["text"] if rounds > 0 else F.col("source_text")
    return state.select("page_id", made.alias("source_text"), "raws").select("page_id", regions.restored(F.col("source_text"), F.col("raws")).alias("source_text"))


def inserted_once(table: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """An insert that may run again: rows whose key is there already stay out."""
    return table.unionByName(rows.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti"))


def updated(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with rows of ``changes`` (key and some of its columns) laid over it, nulls too. Of changes with one key the
    greatest by the columns counts, so a run gives the same rows every time and no row twice."""
    columns = [c for c in changes.columns if c != key]
    new = changes.groupBy(key).agg(F.max(F.struct(*columns)).alias("_new"))
    return table.join(new, key, "left").select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def deleted(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """A delete that cascades: each table without the rows of the keys in ``gone``."""
    return {name: table.join(gone.select(key), key, "left_anti") for name, table in tables.items()}


def content_blobs(pages: DataFrame, key: str, content: str, kind: str = "html") -> DataFrame:
    """(path, page, digest, content): content-addressed blobs ``local--kind/page/hash``; equal contents of a page are one."""
    digest = F.sha2(content, 256)
    path = F.concat(F.lit(f"local--{kind}/"), F.col(key).cast("string"), F.lit("/"), F.substring(digest, 1, 16))
    return pages.select(path.alias("path"), F.col(key).alias("page"), digest.alias("digest"), F.col(content).alias("content")).dropDuplicates(["path"])


def blobs_written(table: DataFrame, blobs: DataFrame) -> DataFrame:
    """A blob table after a write that may run again: blobs whose path is there stay as they are."""
    return inserted_once(table, blobs, "path")


def blobs_without(table: DataFrame, prefix: str) -> DataFrame:
    """A blob table without the paths under a prefix."""
    return table.filter(~F.col("path").startswith(prefix))


def from_json_list(spark, keys: str, name: str, kind: str = "bigint") -> DataFrame:
    """A JSON array given as a parameter, as a relation of one column."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(keys), f"array<{kind}>")).alias(name))


def lookups(targets: DataFrame, wiki: Wiki) -> DataFrame:
    """Per target of (fullname): whether its page exists, its title and its owner's name; every target once."""
    wanted = targets.select(F.lower(F.trim("fullname")).alias("fullname")).distinct()
    users = wiki.users().select(F.col("user_id").alias("owner_id"), F.col("name").alias("owner"))
    known = wiki.pages().select("fullname", "title", "owner_id").join(users, "owner_id", "left")
    return wanted.join(known, "fullname", "left").select("fullname", F.col("title").isNotNull().alias("present"), "title", "owner")
