"""Queries of ratings, votes, tag clouds, links, trees and includes, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators import aggregates, ratings
from scriptorium.plans.base_sql import ALLOWED, ALLOWED_VOTES, AXES, LINKS, PAGES, TAGS, USERS, VOTES, sql
from scriptorium.registry import query
from scriptorium.sources.wiki import Wiki, page_key, split_fullname

@query("ag_main_rating", sql(VOTES, body="SELECT page_id, rating, rating_votes, positive, rating_percent FROM w_ratings"))
def main_rating(spark, folder: str) -> DataFrame:
    return ratings.main_ratings(Wiki(spark, folder))


@query("ag_own_vote", sql(VOTES, body="SELECT r.*, v.rate AS current_vote FROM w_ratings r LEFT JOIN w_votes v ON v.page_id = r.page_id AND v.user_id = 7"))
def own_vote(spark, folder: str) -> DataFrame:
    return ratings.own_vote(Wiki(spark, folder), 7)


@query(
    "ag_axis_rating",
    sql(VOTES, AXES, ALLOWED_VOTES, body="""SELECT p.page_id, a.axis_key, a.label, CAST(coalesce(sum(rate), 0) AS BIGINT) AS points, count(v.vote_id) AS votes,
      CAST(CASE WHEN count(v.vote_id) > 0 THEN floor(count(*) FILTER (rate > 0) / count(v.vote_id) * 100 + 0.5) ELSE 0 END AS BIGINT) AS percent
      FROM (SELECT o_orderkey AS page_id FROM orders) p CROSS JOIN w_axes a
      LEFT JOIN w_open v ON v.page_id = p.page_id AND v.axis_key = a.axis_key WHERE a.enabled AND a.show_aggregate GROUP BY ALL"""),
)
def axis_rating(spark, folder: str) -> DataFrame:
    """The ratings of every page."""
    wiki = Wiki(spark, folder)
    return ratings.axis_ratings(wiki, wiki.pages())


@query("sk_latest_votes", sql(VOTES, body="SELECT user_id, page_id, vote_id, axis_key, rate FROM w_votes"))
def latest_votes(spark, folder: str) -> DataFrame:
    """Upserts as a log: the last vote of each user and page."""
    return ratings.latest(Wiki(spark, folder).vote_events(), "user_id", "page_id").select("user_id", "page_id", "vote_id", "axis_key", "rate")


@query("sk_guarded_votes", sql(VOTES, AXES, ALLOWED_VOTES, body="SELECT user_id, page_id, axis_key, vote_id, rate FROM w_open"))
def guarded_votes(spark, folder: str) -> DataFrame:
    return ratings.accepted_votes(Wiki(spark, folder)).select("user_id", "page_id", "axis_key", "vote_id", "rate")


@query(
    "sk_cancelled_votes",
    sql(VOTES, AXES, ALLOWED_VOTES, body="""SELECT user_id, page_id, axis_key, rate FROM w_open o WHERE NOT EXISTS (
      SELECT 1 FROM w_events c JOIN w_axes a USING (axis_key) WHERE enabled AND can_cancel AND c.vote_id % 7 = 0
        AND c.user_id = o.user_id AND c.page_id = o.page_id AND c.axis_key = o.axis_key)"""),
)
def cancelled_votes(spark, folder: str) -> DataFrame:
    wiki = Wiki(spark, folder)
    cancels = wiki.vote_events().filter("vote_id % 7 = 0").select("user_id", "page_id", "axis_key")
    return ratings.after_cancels(ratings.accepted_votes(wiki), cancels, wiki.axes()).select("user_id", "page_id", "axis_key", "rate")


@query(
    "sk_checked_writes",
    sql(VOTES, AXES, body=f"""SELECT vote_id, axis_key, page_id, rate, CASE WHEN label IS NULL THEN 'unknown axis' WHEN NOT enabled THEN 'disabled'
      WHEN NOT can_vote THEN 'closed' WHEN NOT {ALLOWED} THEN 'value not allowed' WHEN page_id % 10 = 0 THEN 'locked' END AS refused
      FROM w_events LEFT JOIN w_axes USING (axis_key)"""),
)
def checked_writes(spark, folder: str) -> DataFrame:
    return ratings.checked_writes(Wiki(spark, folder), F.col("page_id") % 10 == 0)


@query(
    "sk_recalculated_rates",
    sql(PAGES, VOTES, body="SELECT page_id, coalesce(rating, 0) AS rate FROM w_pages LEFT JOIN w_ratings USING (page_id)"),
)
def recalculated(spark, folder: str) -> DataFrame:
    wiki = Wiki(spark, folder)
    rates = ratings.main_ratings(wiki).select("page_id", F.col("rating").alias("rate"))
    return wiki.pages().select("page_id").join(rates, "page_id", "left").withColumn("rate", F.coalesce("rate", F.lit(0).cast("long")))


@query(
    "sk_updated_pages",
    sql(PAGES, body="SELECT page_id, CASE WHEN page_id % 20 = 0 THEN 'New ' || page_id ELSE title END AS title, size + CASE WHEN page_id % 20 = 0 THEN 1 ELSE 0 END AS size FROM w_pages WHERE page_id % 33 <> 1"),
)
def updated_pages(spark, folder: str) -> DataFrame:
    """Update and cascading delete as an overlay and an anti join."""
    pages = Wiki(spark, folder).pages().select("page_id", "title", "size")
    changes = pages.filter("page_id % 20 = 0").select("page_id", F.concat(F.lit("New "), F.col("page_id").cast("string")).alias("title"), (F.col("size") + 1).alias("size"))
    kept = aggregates.deleted({"pages": pages}, pages.filter("page_id % 33 = 1"), "page_id")["pages"]
    return aggregates.updated(kept, changes, "page_id")


@query(
    "sk_cascading_delete",
    sql(PAGES, TAGS, VOTES, body="""SELECT 'pages' AS kind, count(*) AS n, CAST(sum(page_id) AS BIGINT) AS ids FROM w_pages WHERE page_id % 3 <> 1
      UNION ALL SELECT 'tags', count(*), CAST(sum(page_id) AS BIGINT) FROM w_tag_rows WHERE page_id % 3 <> 1 UNION ALL SELECT 'votes', count(*), CAST(sum(page_id) AS BIGINT) FROM w_events WHERE page_id % 3 <> 1 OR page_id NOT IN (SELECT page_id FROM w_pages)"""),
)
def cascading_delete(spark, folder: str) -> DataFrame:
    """A delete of pages that takes their tags and votes along."""
    wiki = Wiki(spark, folder)
    tables = {"pages": wiki.pages(), "tags": wiki.page_tags(), "votes": wiki.vote_events()}
    left = aggregates.deleted(tables, wiki.pages().filter("page_id % 3 = 1"), "page_id")
    return reduce(DataFrame.unionByName, [t.agg(F.lit(name).alias("kind"), F.count("*").alias("n"), F.sum("page_id").alias("ids")) for name, t in left.items()])


@query("sk_inserted_pages", sql(PAGES, body="SELECT page_id, title FROM w_pages WHERE page_id % 4 <> 0 UNION ALL SELECT page_id, title || ' again' FROM w_pages WHERE page_id % 4 = 0"))
def inserted_pages(spark, folder: str) -> DataFrame:
    """An insert of pages, some of which are there already."""
    pages = Wiki(spark, folder).pages().select("page_id", "title")
    rows = pages.filter("page_id % 2 = 0").select("page_id", F.concat("title", F.lit(" again")).alias("title"))
    return aggregates.inserted_once(pages.filter("page_id % 4 <> 0"), rows, "page_id")


@query("sk_vote_deleted", sql(VOTES, body="SELECT user_id, page_id, rate FROM w_votes v WHERE NOT EXISTS (SELECT 1 FROM w_events c WHERE c.axis_key = 'signup' AND c.user_id = v.user_id AND c.page_id = v.page_id)"))
def vote_deleted(spark, folder: str) -> DataFrame:
    votes = Wiki(spark, folder).vote_events()
    return ratings.without_own_vote(ratings.latest(votes, "user_id", "page_id"), votes.filter("axis_key = 'signup'")).select("user_id", "page_id", "rate")


_BLOBS = "w_blobs AS (SELECT DISTINCT 'local--html/' || page_id || '/' || substring(sha256(html), 1, 16) AS path, page_id AS page, sha256(html) AS digest FROM pages)"


@query("sk_blobs_written", sql(_BLOBS, body="SELECT path, CASE WHEN page % 2 = 0 THEN 'old' ELSE 'new' END AS kept FROM w_blobs"))
def blobs_written(spark, folder: str) -> DataFrame:
    """A write of all blobs over a table that has those of every second page."""
    blobs = aggregates.content_blobs(Wiki(spark, folder).table("pages"), "page_id", "html").select("path", "page")
    return aggregates.blobs_written(blobs.filter("page % 2 = 0").select("path", F.lit("old").alias("kept")), blobs.select("path", F.lit("new").alias("kept")))


@query("sk_blobs_without", sql(_BLOBS, body="SELECT path, digest FROM w_blobs WHERE NOT starts_with(path, 'local--html/1')"))
def blobs_without(spark, folder: str) -> DataFrame:
    blobs = aggregates.content_blobs(Wiki(spark, folder).table("pages"), "page_id", "html")
    return aggregates.blobs_without(blobs, "local--html/1").select("path", "digest")


@query("sc_blob_read", sql(_BLOBS, body="SELECT path, digest FROM w_blobs WHERE page IN (2, 3, 5, 8)"))
def blob_read(spark, folder: str) -> DataFrame:
    """Blobs by key: the keys come as a JSON array."""
    blobs = aggregates.content_blobs(Wiki(spark, folder).table("pages"), "page_id", "html")
    return blobs.join(aggregates.from_json_list(spark, "[2, 3, 5, 8, 8, -1]", "page"), "page", "left_semi").select("path", "digest")


@query("sc_json_list", sql(PAGES, body="SELECT page_id, fullname FROM w_pages WHERE page_id IN (3, 7, 11, 100)"))
def json_list(spark, folder: str) -> DataFrame:
    return Wiki(spark, folder).pages().join(aggregates.from_json_list(spark, "[3, 7, 11, 100]", "page_id"), "page_id", "left_semi").select("page_id", "fullname")


@query(
    "sc_lookups",
    sql(PAGES, USERS, body="""SELECT fullname, title IS NOT NULL AS present, title, u.name AS owner
      FROM (SELECT DISTINCT CASE page_id % 3 WHEN 0 THEN fullname ELSE 'none:' || page_id END AS fullname FROM w_pages) t LEFT JOIN w_pages p USING (fullname) LEFT JOIN w_users u ON u.user_id = p.owner_id"""),
)
def lookups(spark, folder: str) -> DataFrame:
    """Existence, title and owner of every referenced page, in one join."""
    wiki = Wiki(spark, folder)
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" "), F.upper(F.substring("fullname", 1, 1)), F.expr("substring(fullname, 2)"))).otherwise(F.concat(F.lit("none:"), F.col("page_id").cast("string")))
    return aggregates.lookups(wiki.pages().select(name.alias("fullname")), wiki)


_REFS = "w_refs AS (SELECT DISTINCT page_id, CASE WHEN axis_key = 'click' THEN NULL WHEN axis_key = 'signup' THEN 'other' ELSE axis_key END AS axis_key FROM w_events)"


@query(
    "jn_rating_states",
    sql(VOTES, AXES, ALLOWED_VOTES, _REFS, body="""SELECT r.page_id, coalesce('custom:' || r.axis_key, 'main') AS ref, r.axis_key IS NULL OR a.axis_key IS NOT NULL AS declared, CASE WHEN r.axis_key IS NULL THEN 'Rating' ELSE a.label END AS label,
      CASE WHEN r.axis_key IS NULL THEN m.rating WHEN show_aggregate THEN coalesce(x.points, 0) END AS points, CASE WHEN r.axis_key IS NULL THEN m.rating_votes WHEN show_aggregate THEN coalesce(x.n, 0) END AS votes,
      CASE WHEN r.axis_key IS NULL THEN m.rating_percent WHEN show_aggregate THEN coalesce(x.share, 0) END AS percent
      FROM w_refs r LEFT JOIN (SELECT * FROM w_axes WHERE enabled) a USING (axis_key) LEFT JOIN w_ratings m ON m.page_id = r.page_id
      LEFT JOIN (SELECT page_id, axis_key, CAST(sum(rate) AS BIGINT) AS points, count(*) AS n, CAST(floor(count(*) FILTER (rate > 0) / count(*) * 100 + 0.5) AS BIGINT) AS share FROM w_open GROUP BY ALL) x
        ON x.page_id = r.page_id AND x.axis_key = r.axis_key"""),
)
def rating_states(spark, folder: str) -> DataFrame:
    """Rating references joined with the states of main and custom ratings."""
    wiki = Wiki(spark, folder)
    axis = F.when(F.col("axis_key") == "signup", "other").when(F.col("axis_key") != "click", F.col("axis_key"))
    return ratings.rating_states(wiki.vote_events().select("page_id", axis.alias("axis_key")), wiki)


@query("jn_authorized_references", sql(VOTES, body="SELECT vote_id, page_id, axis_key AS ref FROM w_events e WHERE EXISTS (SELECT 1 FROM w_events d WHERE d.vote_id % 3 = 0 AND d.page_id = e.page_id AND d.axis_key = e.axis_key)"))
def authorized_references(spark, folder: str) -> DataFrame:
    requests = Wiki(spark, folder).vote_events().select("vote_id", "page_id", F.col("axis_key").alias("ref"))
    return ratings.authorized(requests, requests.filter("vote_id % 3 = 0")).select("vote_id", "page_id", "ref")


@query(
    "ag_cloud_status",
    sql(PAGES, TAGS, body="""SELECT c.category, CASE WHEN c.category IS NOT NULL AND NOT EXISTS (SELECT 1 FROM w_pages p WHERE p.category = c.category) THEN 'category-not-found'
      WHEN NOT EXISTS (SELECT 1 FROM w_tag_rows t JOIN w_pages p USING (page_id) WHERE NOT starts_with(tag, '_') AND (c.category IS NULL OR p.category = c.category)) THEN 'no-tags' ELSE 'ok' END AS status
      FROM (VALUES (NULL), ('o'), ('none')) c(category)"""),
)
def cloud_status(spark, folder: str) -> DataFrame:
    wiki = Wiki(spark, folder)
    return reduce(DataFrame.unionByName, [aggregates.cloud_status(wiki, c).select(F.lit(c).cast("string").alias("category"), "status") for c in (None, "o", "none")])


@query("ag_tag_counts", sql(TAGS, body="SELECT tag, count(*) AS weight FROM w_tag_rows WHERE NOT starts_with(tag, '_') GROUP BY tag"))
def tag_counts(spark, folder: str) -> DataFrame:
    return aggregates.tag_counts(Wiki(spark, folder))


@query(
    "ag_tag_cloud",
    sql(PAGES, TAGS, """c AS (SELECT tag, count(*) AS weight FROM w_tag_rows WHERE NOT starts_with(tag, '_') AND page_id IN (SELECT page_id FROM w_pages WHERE category = 'o') GROUP BY tag),
      t AS (SELECT * FROM c ORDER BY weight DESC, tag LIMIT 4), s AS (SELECT *, (weight - min(weight) OVER ()) / (max(weight) OVER () - min(weight) OVER ()) AS a FROM t)""",
      body="""SELECT tag, weight, '/system:page-tags/tag/' || tag || '/category/o' AS href, 'font-size: ' || CAST(floor(100 + 200 * a + 0.5) AS INTEGER) || '%; color: rgb('
        || CAST(floor(128 - 64 * a + 0.5) AS INTEGER) || ', ' || CAST(floor(128 - 64 * a + 0.5) AS INTEGER) || ', ' || CAST(floor(192 - 64 * a + 0.5) AS INTEGER) || ');' AS style FROM s"""),
)
def tag_cloud(spark, folder: str) -> DataFrame:
    return aggregates.tag_cloud(Wiki(spark, folder), category="o", limit=4)


@query("sc_tag_lists", sql(TAGS, body="SELECT page_id, array_to_string(coalesce(tags, []), ' ') AS tags, array_to_string(coalesce(hidden_tags, []), ' ') AS hidden_tags FROM w_lists"))
def tag_lists(spark, folder: str) -> DataFrame:
    lists = Wiki(spark, folder).tag_lists()
    return lists.select("page_id", F.array_join("tags", " ").alias("tags"), F.array_join("hidden_tags", " ").alias("hidden_tags"))


@query("ag_categories", sql(PAGES, body="SELECT category, count(*) AS pages FROM w_pages WHERE NOT starts_with(category, '_') GROUP BY category"))
def categories(spark, folder: str) -> DataFrame:
    return aggregates.categories(Wiki(spark, folder))


@query("dt_backlinks", sql(LINKS, body="SELECT target, count(*) AS links, count(DISTINCT page_id) AS pages, min(page_id) AS first_page FROM w_links GROUP BY target"))
def backlinks(spark, folder: str) -> DataFrame:
    return aggregates.backlinks(Wiki(spark, folder))


@query("jn_missing_links", sql(LINKS, body="SELECT page_id, ord, target FROM w_links WHERE target NOT IN (SELECT target FROM w_links WHERE page_id % 2 = 0)"))
def missing_links(spark, folder: str) -> DataFrame:
    wiki = Wiki(spark, folder)
    known = wiki.links().filter("page_id % 2 = 0").select("target").distinct()
    return aggregates.missing_links(wiki, known).select("page_id", "ord", "target")


@query("ag_first_seen_links", sql(LINKS, body="SELECT page_id, target, min(ord) AS first_ord, CAST(row_number() OVER (PARTITION BY page_id ORDER BY min(ord)) AS INTEGER) AS number FROM w_links GROUP BY page_id, target"))
def first_seen_links(spark, folder: str) -> DataFrame:
    """Distinct references of a page in the order they are first seen, numbered: as a bibliography is."""
    firsts = Wiki(spark, folder).links().groupBy("page_id", "target").agg(F.min("ord").alias("first_ord"))
    return firsts.withColumn("number", F.row_number().over(Window.partitionBy("page_id").orderBy("first_ord")))


@query(
    "dt_page_tree",
    "WITH RECURSIVE " + PAGES + """, t AS (
      SELECT page_id, 0 AS depth, fullname AS path FROM w_pages WHERE page_id = 3
      UNION ALL SELECT p.page_id, t.depth + 1, t.path || '/' || p.fullname FROM t JOIN w_pages p ON p.parent_id = t.page_id WHERE t.depth < 3)
      SELECT page_id, depth, path FROM t""",
)
def page_tree(spark, folder: str) -> DataFrame:
    return aggregates.page_tree(Wiki(spark, folder), 3, 3)


def _library(wiki: Wiki) -> tuple[DataFrame, DataFrame]:
    """Pages that include others, and the pages that can be included."""
    key = F.col("page_id").cast("string")
    users = wiki.pages().select(
        "page_id", F.concat(F.lit("page-"), key).alias("fullname"),
        F.concat(F.lit("Title "), key, F.lit("\n[[include part-"), (F.col("page_id") % 5).cast("string"), F.lit(" | who = "), key, F.lit(" | empty = ]]\n"), F.lit("[[include page-"), key, F.lit("]]\nend")).alias("source_text"),
    )
    rows = [("part-0", "Zero {$who}."), ("part-1", "One.\n[[include part-0 | who=nested {$who}]]"), ("part-2", "Two {$who} {$who} {$empty}"), ("part-3", "[[include part-1 | who=deep]]")]
    return users, wiki.spark.createDataFrame(rows, "page string, content string")


_PART = """CASE page_id % 5 WHEN 0 THEN 'Zero ' || page_id || '.' WHEN 1 THEN 'One.' || chr(10) || 'Zero nested ' || page_id || '.'
  WHEN 2 THEN 'Two ' || page_id || ' ' || page_id || ' {$empty}' WHEN 3 THEN 'One.' || chr(10) || 'Zero nested deep.'
  ELSE '[[div class="error-block"]]' || chr(10) || 'Page to be included "part-4" cannot be found!' || chr(10) || '[[/div]]' END"""


@query(
    "dt_include_expansion",
    sql(PAGES, body=f"""SELECT page_id, 'Title ' || page_id || chr(10) || {_PART} || chr(10) || '[[include page-' || page_id || ']]' || chr(10) || 'end' AS source_text,
      CASE page_id % 5 WHEN 1 THEN 2 WHEN 3 THEN 3 ELSE 1 END AS rounds, false AS too_long FROM w_pages"""),
)
def include_expansion(spark, folder: str) -> DataFrame:
    """The includes of every page."""
    users, library = _library(Wiki(spark, folder))
    return aggregates.expand_includes(users, library)


@query(
    "dt_include_trace",
    sql(PAGES, body="""SELECT page_id, CASE page_id % 5 WHEN 1 THEN '1.0 part-1,2.0 part-0' WHEN 3 THEN '1.0 part-3,2.0 part-1,3.0 part-0' ELSE '1.0 part-' || page_id % 5 END AS included FROM w_pages"""),
)
def include_trace(spark, folder: str) -> DataFrame:
    """What was put into each page, by round and place."""
    users, library = _library(Wiki(spark, folder))
    found = F.transform("included", lambda x: F.concat(x["round"].cast("string"), F.lit("."), x["ord"].cast("string"), F.lit(" "), x["page"]))
    return aggregates.expand_includes(users, library, trace=True).select("page_id", F.array_join(found, ",").alias("included"))


@query(
    "dt_include_nested",
    sql(PAGES, body="""SELECT page_id, ord, CASE WHEN ord = 1 THEN 'far' END AS site, CASE ord WHEN 0 THEN 'box' ELSE 'page-' || page_id END AS page,
      CASE ord WHEN 0 THEN 'body=see [[[page-' || page_id || ']]] and [[module Rate]] [x],n=' || page_id ELSE 'a=b' END AS given FROM w_pages, (VALUES (0), (1)) v(ord)"""),
)
def include_nested(spark, folder: str) -> DataFrame:
    """Directives with links and modules in their values, and pages of another site."""
    key = F.col("page_id").cast("string")
    source = F.concat(F.lit("x\n[[include box | body=see [[[page-"), key, F.lit("]]] and [[module Rate]] [x] | n="), key, F.lit("]]\nno [[include inline]]\n[[Include :far:page-"), key, F.lit("\n|a = b\n]]"))
    return _edges(Wiki(spark, folder).pages().select("page_id", source.alias("source_text")), "site")


def _edges(users: DataFrame, *more: str) -> DataFrame:
    given = F.array_join(F.transform("assignments", lambda a: F.concat(a["key"], F.lit("="), a["value"])), ",")
    return aggregates.include_edges(users).select("page_id", "ord", *more, "page", given.alias("given"))


@query("dt_include_edges", sql(PAGES, body="SELECT page_id, ord, CASE ord WHEN 0 THEN 'part-' || page_id % 5 ELSE 'page-' || page_id END AS page, CASE ord WHEN 0 THEN 'who=' || page_id ELSE '' END AS given FROM w_pages, (VALUES (0), (1)) v(ord)"))
def include_edges(spark, folder: str) -> DataFrame:
    """The includes of every page as edges."""
    users, _ = _library(Wiki(spark, folder))
    return _edges(users)


@query(
    "it_source_expansion",
    sql(PAGES, TAGS, body="""SELECT p.page_id, 'a' || CASE WHEN list_contains(e, 'flag-r') THEN '<r' || CASE WHEN list_contains(e, '_bulk') THEN '' ELSE 'small' END || '>' ELSE '' END
      || 'b' || CASE WHEN list_has_any(e, ['flag-a', 'flag-n']) THEN 'an' ELSE '' END || 'c' AS source_text
      FROM (SELECT p.page_id, coalesce(l.every, CAST([] AS VARCHAR[])) AS e FROM w_pages p LEFT JOIN w_lists l USING (page_id)) p"""),
)
def iftags_expansion(spark, folder: str) -> DataFrame:
    """The conditions of every page."""
    wiki = Wiki(spark, folder)
    return _expanded(wiki, wiki.pages())


def _expanded(wiki: Wiki, pages: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    source = "a[[iftags +flag-r]]<r[[iftags -_bulk]]small[[/iftags]]>[[/iftags]]b[[iftags flag-a flag-n]]an[[/iftags]]c[[iftags]]never[[/iftags]]"
    tags = F.coalesce(F.array_union("tags", "hidden_tags"), none)
    tagged = pages.select("page_id").join(wiki.tag_lists(), "page_id", "left")
    return aggregates.expand_iftags(tagged.select("page_id", tags.alias("tags"), F.lit(source).alias("source_text")))


@query("sk_insert_once", "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'late ' || c_custkey END AS name FROM customer WHERE c_custkey % 2 = 0 OR c_custkey < 100")
def insert_once(spark, folder: str) -> DataFrame:
    users = Wiki(spark, folder).users().select("user_id", "name")
    late = users.filter("user_id < 100").select("user_id", F.concat(F.lit("late "), F.col("user_id").cast("string")).alias("name"))
    return aggregates.inserted_once(users.filter("user_id % 2 = 0"), late.unionByName(late), "user_id")


@query("sc_collected_references", sql(LINKS, body="SELECT count(DISTINCT target) AS targets, count(DISTINCT target) FILTER (starts_with(target, '/')) AS local FROM w_links"))
def collected_references(spark, folder: str) -> DataFrame:
    """The references that a renderer has to look up, each once."""
    targets = Wiki(spark, folder).links().select("target").distinct()
    return targets.agg(F.count("*").alias("targets"), F.count_if(F.col("target").startswith("/")).alias("local"))


@query("sc_split_fullname", sql(PAGES, body="SELECT page_id, category AS cat, name AS rest, fullname AS again FROM w_pages"))
def split_fullnames(spark, folder: str) -> DataFrame:
    category, name = split_fullname(F.col("fullname"))
    return Wiki(spark, folder).pages().select("page_id", category.alias("cat"), name.alias("rest"), page_key(category, name).alias("again"))
