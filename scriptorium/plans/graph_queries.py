"""Queries over whole tables of many listings, include graphs, page forests, depth lists and styles, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators import graphs, trees
from scriptorium.operators.aggregates import expand_includes
from scriptorium.operators.batch import batch_listings
from scriptorium.plans.base_sql import PAGES, TAGS, sql
from scriptorium.registry import query
from scriptorium.sources.wiki import Wiki, spread

#: Selectors of the customers' listings by the customer's number.
_TAGS = ("+status-f -_bulk", "==", "=", "flag-a flag-n", "+flag-r +_bulk", "-", None, "= -flag-a")
_CATEGORY = (None, "*", "o f", "-p", ". p")
_ORDER = ("title asc", "size desc", "created_at", "fullname desc", "commented_at asc")


def _pick(values: tuple, by) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), by.cast("int"))


def customer_queries(wiki: Wiki) -> DataFrame:
    """A listing for each customer, who stands on the first page of theirs."""
    k = F.col("query_id")
    first = wiki.pages().groupBy("owner_id").agg(F.min("page_id").alias("own_id")).select(F.col("owner_id").alias("query_id"), "own_id")
    own = wiki.pages().select(F.col("page_id").alias("own_id"), F.col("category").alias("own_category"), F.col("parent_id").alias("own_parent"))
    tags = wiki.tag_lists().select(F.col("page_id").alias("own_id"), F.col("tags").alias("own_tags"))
    rows = wiki.users().select(F.col("user_id").alias("query_id")).join(first, "query_id", "left").join(own, "own_id", "left").join(tags, "own_id", "left")
    return rows.select(
        "query_id", "own_id", "own_parent", "own_category", "own_tags", _pick(_TAGS, k % 8).alias("tags"), _pick(_CATEGORY, k % 5).alias("category"), F.when(k % 4 == 0, k).alias("owner_id"),
        _pick((".", None, None, None, "="), k % 5).alias("parent"), F.when(k % 6 == 0, F.lit("1995-01-01").cast("timestamp")).alias("created_from"), _pick(_ORDER, k % 5).alias("order"),
        (k % 3).alias("offset"), (k % 4 + 5).alias("limit"),
    )


_BATCH = sql(PAGES, TAGS, """q AS (
  SELECT c_custkey AS query_id, o.page_id AS own_id, o.category AS own_category, o.parent_id AS own_parent, coalesce(l.tags, []) AS own_tags, c_custkey % 8 AS t, c_custkey % 5 AS m
  FROM customer LEFT JOIN (SELECT owner_id, min(page_id) AS page_id FROM w_pages GROUP BY 1) f ON f.owner_id = c_custkey
  LEFT JOIN w_pages o ON o.page_id = f.page_id LEFT JOIN w_lists l ON l.page_id = f.page_id
), p AS (
  SELECT w.*, coalesce(l.tags, []) AS tags, coalesce(l.every, []) AS every FROM w_pages w LEFT JOIN w_lists l USING (page_id)
), f AS (
  SELECT query_id, p.*, q.m FROM q, p WHERE NOT starts_with(name, '_')
    AND CASE m WHEN 0 THEN category = own_category WHEN 1 THEN true WHEN 2 THEN category IN ('o', 'f') WHEN 3 THEN category <> 'p' ELSE category IN (own_category, 'p') END
    AND CASE t WHEN 0 THEN list_contains(every, 'status-f') AND NOT list_contains(every, '_bulk') WHEN 1 THEN p.tags = own_tags WHEN 2 THEN list_has_any(p.tags, own_tags)
      WHEN 3 THEN list_has_any(every, ['flag-a', 'flag-n']) WHEN 4 THEN list_contains(every, 'flag-r') AND list_contains(every, '_bulk') WHEN 5 THEN len(every) = 0 WHEN 6 THEN true
      ELSE list_has_any(p.tags, own_tags) AND NOT list_contains(every, 'flag-a') END
    AND (query_id % 4 <> 0 OR owner_id = query_id) AND (query_id % 6 <> 0 OR created_at >= DATE '1995-01-01')
    AND CASE m WHEN 0 THEN parent_id = own_id WHEN 4 THEN parent_id IS NOT DISTINCT FROM own_parent ELSE true END
), r AS (
  SELECT query_id, page_id, count(*) OVER (PARTITION BY query_id) AS total, row_number() OVER (PARTITION BY query_id ORDER BY
    CASE WHEN m = 0 THEN title END, CASE WHEN m = 1 THEN size END DESC, CASE WHEN m = 2 THEN created_at END DESC, CASE WHEN m = 3 THEN fullname END DESC,
    CASE WHEN m = 4 THEN commented_at END NULLS LAST, CASE WHEN m IN (0, 4) THEN page_id ELSE -page_id END) AS "index" FROM f)""",
    body='SELECT query_id, "index", page_id, total FROM r WHERE "index" > query_id % 3 AND "index" <= query_id % 3 + query_id % 4 + 5')


@query("lp_batch_listings", _BATCH)
def batch(spark, folder: str) -> DataFrame:
    """A listing for every customer in one run."""
    wiki = Wiki(spark, folder)
    return batch_listings(wiki, customer_queries(wiki))


_RATED = sql(PAGES, TAGS, """e AS (SELECT event_id, user_id, event_id % 1000 AS page_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS rate, ts FROM events),
  v AS (SELECT page_id, sum(rate) AS rating FROM (SELECT *, row_number() OVER (PARTITION BY user_id, page_id ORDER BY ts DESC, event_id DESC) AS n FROM e) WHERE n = 1 GROUP BY 1),
  t AS (SELECT DISTINCT tag FROM w_tag_rows),
  r AS (SELECT t.tag, page_id, count(*) OVER x AS total, row_number() OVER (PARTITION BY t.tag ORDER BY coalesce(rating, 0) DESC, page_id DESC) AS "index"
    FROM t JOIN w_tag_rows USING (tag) JOIN w_pages p USING (page_id) LEFT JOIN v USING (page_id) WHERE NOT starts_with(name, '_') WINDOW x AS (PARTITION BY t.tag))""",
    body='SELECT tag AS query_id, "index", page_id, total FROM r WHERE "index" <= 20')


@query("lp_batch_best_of_tags", _RATED)
def best_of_tags(spark, folder: str) -> DataFrame:
    """The best rated pages of every tag."""
    wiki = Wiki(spark, folder)
    tags = wiki.page_tags().select("tag").distinct()
    asked = tags.select(F.col("tag").alias("query_id"), F.concat(F.lit("+"), "tag").alias("tags"), F.lit("*").alias("category"), F.lit("rating desc").alias("order"))
    return batch_listings(wiki, asked, rated=True)


def _include_graph(wiki: Wiki) -> DataFrame:
    """(page, content) of every page: includes of its parent's number and of a far one, now and then a module, a missing page or itself."""
    k = F.col("page_id")
    line = lambda target: F.concat(F.lit("\n[[include p-"), target.cast("string"), F.lit("]]"))
    up = F.when((k > 40) & (k % 7 != 3), line(F.floor(k / 3))).otherwise("")
    far = F.when(k % 11 == 0, line(k - 1)).otherwise("")
    odd = F.when(k % 401 == 5, line(-k)).when(k % 401 == 6, line(k)).when(k % 401 == 7, F.lit("\n[[module ListPages order=\"title\"]]\nx\n[[/module]]")).when(k % 401 == 8, line(k + 1)).when(k % 401 == 9, line(k - 1)).otherwise("")
    return wiki.pages().select(F.concat(F.lit("p-"), k.cast("string")).alias("page"), F.concat(F.lit("text"), up, far, odd).alias("content"))


_EDGES = """e AS (
  SELECT page_id AS k, page_id // 3 AS t FROM w_pages WHERE page_id > 40 AND page_id % 7 <> 3 UNION SELECT page_id, page_id - 1 FROM w_pages WHERE page_id % 11 = 0
  UNION SELECT page_id, -page_id FROM w_pages WHERE page_id % 401 = 5 UNION SELECT page_id, page_id FROM w_pages WHERE page_id % 401 = 6
  UNION SELECT page_id, page_id + 1 FROM w_pages WHERE page_id % 401 = 8 UNION SELECT page_id, page_id - 1 FROM w_pages WHERE page_id % 401 = 9),
own AS (
  SELECT page_id AS k, CASE WHEN page_id % 401 = 7 THEN 'module' WHEN EXISTS (SELECT 1 FROM e WHERE e.k = page_id AND e.t = page_id) THEN 'itself'
    WHEN EXISTS (SELECT 1 FROM e WHERE e.k = page_id AND e.t NOT IN (SELECT page_id FROM w_pages)) THEN 'missing' END AS reason FROM w_pages)"""


@query(
    "dt_completeness",
    "WITH RECURSIVE " + PAGES + ", " + _EDGES + """, walk AS (
      SELECT page_id AS start, page_id AS here, 0 AS depth FROM w_pages UNION SELECT start, e.t, depth + 1 FROM walk JOIN e ON e.k = here WHERE depth < 11),
    bad AS (SELECT DISTINCT start FROM walk LEFT JOIN own ON own.k = here WHERE own.reason IS NOT NULL OR depth = 11)
    SELECT 'p-' || k AS page, bad.start IS NULL AS complete, CASE WHEN bad.start IS NOT NULL THEN coalesce(reason, 'include') END AS reason FROM own LEFT JOIN bad ON bad.start = own.k""",
)
def completeness(spark, folder: str) -> DataFrame:
    """Which pages' texts can be made whole."""
    return graphs.completeness(_include_graph(Wiki(spark, folder)))


@query(
    "dt_includers",
    "WITH RECURSIVE " + PAGES + ", " + _EDGES + """, r AS (SELECT k FROM e WHERE t % 97 = 50 UNION SELECT e.k FROM r JOIN e ON e.t = r.k) SELECT 'p-' || k AS node FROM r""",
)
def includers(spark, folder: str) -> DataFrame:
    """All pages that an edit of some pages reaches."""
    library = _include_graph(Wiki(spark, folder))
    none = library.limit(0).select(F.lit(0).cast("long").alias("page_id"), F.lit("").alias("source_text"))
    changed = library.filter(F.substring("page", 3, 20).cast("long") % 97 == 50).select("page")
    return graphs.includers(graphs.dependency_edges(none, library).checkpoint(), changed)


_EDITED = """CASE page_id % 5 WHEN 0 THEN 'Nil ' || page_id || '!' WHEN 1 THEN 'One.' || chr(10) || 'Nil nested ' || page_id || '!'
  WHEN 2 THEN '[[div class="error-block"]]' || chr(10) || 'Page to be included "part-2" cannot be found!' || chr(10) || '[[/div]]' WHEN 3 THEN 'One.' || chr(10) || 'Nil nested deep!'
  ELSE 'Four' END"""


@query(
    "dt_include_refresh",
    sql(PAGES, body=f"""SELECT page_id, 'Title ' || page_id || chr(10) || {_EDITED} || chr(10) || '[[include page-' || page_id || ']]' || chr(10) || 'end' AS source_text,
      CASE page_id % 5 WHEN 1 THEN 2 WHEN 3 THEN 3 ELSE 1 END AS rounds, true AS renewed FROM w_pages WHERE page_id % 5 <> 4 OR page_id % 2 = 0
      UNION ALL SELECT page_id, 'Title ' || page_id || chr(10) || '[[include page-' || page_id || ']]', 0, page_id % 10 = 9 FROM w_pages WHERE page_id % 5 = 4 AND page_id % 2 = 1"""),
)
def include_refresh(spark, folder: str) -> DataFrame:
    """Expanded pages after edits of parts (one changed, one gone, one new) and of some pages: only those that are reached are expanded again."""
    wiki = Wiki(spark, folder)
    key = F.col("page_id").cast("string")
    part = F.concat(F.lit("[[include part-"), (F.col("page_id") % 5).cast("string"), F.lit(" | who = "), key, F.lit("]]\n"))
    source = lambda part: F.concat(F.lit("Title "), key, F.lit("\n"), part, F.lit("[[include page-"), key, F.lit("]]"))
    plain = F.col("page_id") % 10 == 9
    before = wiki.pages().select("page_id", F.concat(F.lit("page-"), key).alias("fullname"), F.when(plain, F.lit("old")).otherwise(F.concat(source(part), F.lit("\nend"))).alias("source_text"))
    after = wiki.pages().select("page_id", F.concat(F.lit("page-"), key).alias("fullname"), F.when(plain, source(F.lit(""))).otherwise(F.concat(source(part), F.lit("\nend"))).alias("source_text"))
    old = [("part-0", "Zero {$who}."), ("part-1", "One.\n[[include part-0 | who=nested {$who}]]"), ("part-2", "Two"), ("part-3", "[[include part-1 | who=deep]]")]
    new = [("part-0", "Nil {$who}!"), old[1], old[3], ("part-4", "Four")]
    library = lambda rows: spark.createDataFrame(rows, "page string, content string")
    stored = expand_includes(before, library(old), trace=True).checkpoint()
    changed = spark.createDataFrame([("part-0",), ("part-2",), ("part-4",)], "page string")
    out = graphs.refreshed(stored, after, library(new), changed, wiki.pages().filter(plain).select("page_id"))
    return out.select("page_id", "source_text", "rounds", "renewed")


#: Parents with long chains and cycles: each page stands below the one before it in blocks of 100, whose firsts stand below another block's.
_PARENT = "CASE WHEN page_id % 1000 = 501 THEN page_id + 1 WHEN page_id % 1000 = 601 THEN page_id WHEN page_id % 100 <> 1 THEN page_id - 1 WHEN page_id > 300 THEN page_id // 3 END"


@query(
    "dt_page_forest",
    "WITH RECURSIVE " + PAGES + f""", n AS (SELECT page_id, fullname, {_PARENT} AS up FROM w_pages), p AS (SELECT n.page_id, n.fullname, q.page_id AS up FROM n LEFT JOIN n q ON q.page_id = n.up),
    t AS (SELECT page_id, page_id AS root_id, 0 AS depth, fullname AS path FROM p WHERE up IS NULL UNION ALL SELECT p.page_id, t.root_id, t.depth + 1, t.path || '/' || p.fullname FROM t JOIN p ON p.up = t.page_id)
    SELECT p.page_id, root_id, CAST(depth AS BIGINT) AS depth, sha256(path) AS path_sha256, p.page_id % 1000 IN (501, 502, 601) AND root_id IS NULL AS cyclic FROM p LEFT JOIN t USING (page_id)""",
)
def page_forest(spark, folder: str) -> DataFrame:
    """Root, depth and path of every page, and the cycles."""
    pages = Wiki(spark, folder).pages().select("page_id", "fullname", F.expr(_PARENT.replace("//", "div")).alias("parent_id"))
    return graphs.page_forest(pages).select("page_id", "root_id", "depth", F.sha2("path", 256).alias("path_sha256"), "cyclic")


@query(
    "dt_page_tree_shown",
    "WITH RECURSIVE " + PAGES + """, t AS (
      SELECT page_id, 0 AS depth, '' AS "order" FROM w_pages WHERE page_id = 3
      UNION ALL SELECT p.page_id, t.depth + 1, CASE WHEN t.depth = 0 THEN '' ELSE t."order" || '/' END || p.fullname FROM t JOIN w_pages p ON p.parent_id = t.page_id)
      SELECT page_id, CAST(depth AS BIGINT) AS depth, "order" FROM t""",
)
def page_tree_shown(spark, folder: str) -> DataFrame:
    """The whole tree below a page, the page itself shown."""
    pages = Wiki(spark, folder).pages().select("page_id", "parent_id", "fullname")
    top = pages.filter("page_id = 3").select("fullname").first()
    return graphs.page_tree_of(graphs.page_forest(pages, top=3), pages, top["fullname"] if top else "", show_root=True)


#: Lines of an order with places of their own, as line numbers repeat.
_ITEMS = """x AS (SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS ord,
  'flag-' || l_returnflag AS style, CAST(l_quantity AS BIGINT) AS q FROM lineitem)"""


def _items(wiki: Wiki) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_extendedprice", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"))
    # Spread, as a list's fold is dear and its numbers compress so well that few tasks would get all.
    lines = spread(wiki.table("lineitem"), "l_orderkey")
    return lines.select(F.col("l_orderkey").alias("page_id"), place.cast("long").alias("ord"), F.concat(F.lit("flag-"), "l_returnflag").alias("style"), F.col("l_quantity").cast("long").alias("q"))


@query(
    "wn_depth_tree",
    sql(_ITEMS, body="""SELECT page_id, ord, q % 5 AS depth, coalesce((SELECT max(j.ord) FROM x j WHERE j.page_id = x.page_id AND j.ord < x.ord AND j.q % 5 < x.q % 5), 0) AS parent FROM x"""),
)
def depth_tree(spark, folder: str) -> DataFrame:
    """The item above each line of every order, by depths that the lines give; 0 where there is none."""
    items = _items(Wiki(spark, folder)).withColumn("depth", F.col("q") % 5)
    return trees.depth_tree(items, "page_id", "ord", "depth").select("page_id", "ord", F.col("depth").cast("long").alias("depth"), F.coalesce("parent", F.lit(0)).alias("parent"))


_STYLES = _ITEMS + """, b AS (SELECT *, row_number() OVER (PARTITION BY page_id, style ORDER BY ord) AS n FROM x),
  g AS (SELECT page_id, style, count(*) AS gone FROM x WHERE q % 3 = 0 GROUP BY ALL)"""


@query("se_styles_left", sql(_STYLES, body="SELECT page_id, b.ord, b.style FROM b LEFT JOIN g USING (page_id, style) WHERE n > coalesce(gone, 0)"))
def styles_left(spark, folder: str) -> DataFrame:
    """The styles of every page without as many as another pass took away, the first ones of each."""
    styles = _items(Wiki(spark, folder))
    return trees.without_occurrences(styles.drop("q"), styles.filter("q % 3 = 0"), ["page_id", "style"], "ord")


@query(
    "se_styles_merged",
    sql(_STYLES, body="""SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY part, ord) - 1 AS INTEGER) AS ord, style FROM (
      SELECT page_id, 0 AS part, b.ord, b.style FROM b LEFT JOIN g USING (page_id, style) WHERE n > coalesce(gone, 0)
      UNION ALL SELECT page_id, 1, ord, CASE WHEN q % 2 = 1 THEN style WHEN page_id % 2 = 0 THEN 'filled-' || page_id ELSE 'slot:' || style END FROM x)"""),
)
def styles_merged(spark, folder: str) -> DataFrame:
    """Styles of a first and a second pass over every page together; on even pages what stands in the slots is known."""
    x = _items(Wiki(spark, folder))
    collected = x.select("page_id", "ord", F.when(F.col("q") % 2 == 1, F.col("style")).otherwise(F.concat(F.lit("slot:"), "style")).alias("style"))
    known = collected.filter("page_id % 2 = 0 and style like 'slot:%'").select("page_id", "style").distinct()
    slots = known.select("page_id", "style", F.lit(0).alias("ord"), F.concat(F.lit("filled-"), F.col("page_id").cast("string")).alias("value"))
    return trees.merged_styles(x.drop("q"), collected, x.filter("q % 3 = 0").drop("q"), slots)
