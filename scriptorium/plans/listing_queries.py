"""Queries of page listings, each with its SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.listing import Current, Listing, PageQuery, Template, assembled, bound_query, rendered, user_items, with_owners
from scriptorium.plans.base_sql import ALLOWED_VOTES, AXES, LINKS, PAGES, TAGS, USERS, VOTES, sql
from scriptorium.registry import query
from scriptorium.sources.wiki import Wiki

NOW = Current(page_id=40, category="f", tags=("flag-r", "status-o", "_staff"), parent_id=5, now=datetime(1998, 6, 15))
LISTED = ("page_id", "index", "total")


def _matching(spark, folder: str, **selectors) -> DataFrame:
    return Listing(Wiki(spark, folder), PageQuery(**selectors), NOW).matching().select("page_id", "fullname")


def _register(query_name: str, where: str, tables: tuple[str, ...] = (PAGES,), source: str = "w_pages p", hidden: bool = False, **selectors) -> None:
    """A selector's query: the pages that it keeps."""
    plain = "" if hidden else "NOT starts_with(p.name, '_') AND "
    query(query_name, sql(*tables, body=f"SELECT p.page_id, p.fullname FROM {source} WHERE {plain}{where}"))(lambda spark, folder: _matching(spark, folder, **selectors))


_register("fi_category_default", "category = 'f'")
_register("fi_category_list", "category IN ('o', 'p')", category="O, P")
_register("fi_category_exclusion", "category NOT IN ('f')", category="-f")
_register("fi_category_current_and_excluded", "category IN ('f', 'o') AND category NOT IN ('o')", category=". o -o")
_TAGGED = "w_pages p LEFT JOIN w_lists l USING (page_id)"
_EVERY = "coalesce(l.every, CAST([] AS VARCHAR[]))"
_register("fi_tags_required_forbidden", f"list_contains({_EVERY}, 'flag-r') AND NOT list_contains({_EVERY}, '_bulk')", (PAGES, TAGS), _TAGGED, category="*", tags="+flag-r -_bulk")
_register("fi_tags_any", f"list_has_any({_EVERY}, ['flag-a', '_bulk'])", (PAGES, TAGS), _TAGGED, category="*", tags="flag-a _bulk")
_register("fi_tags_none", f"len({_EVERY}) = 0", (PAGES, TAGS), _TAGGED, category="*", tags="-")
_register("fi_tags_same_all", "l.tags = ['flag-r', 'status-o']", (PAGES, TAGS), _TAGGED, category="*", tags="==")
_register("fi_tags_same_visible", "list_has_any(coalesce(l.tags, CAST([] AS VARCHAR[])), ['flag-r', 'status-o'])", (PAGES, TAGS), _TAGGED, category="*", tags="=")
_RATED = "w_pages p LEFT JOIN w_ratings r USING (page_id)"
_register("fi_rating", "coalesce(r.rating, 0) >= 1", (PAGES, VOTES), _RATED, category="*", rating=">=1")
_register("fi_votes", "coalesce(r.rating_votes, 0) = 9", (PAGES, VOTES), _RATED, category="*", votes="9")
_AXIS_RATED = """w_axis AS (SELECT page_id, sum(rate) AS rating, count(*) AS n FROM w_open WHERE axis_key = 'purchase' GROUP BY page_id)"""
_register("fi_axis_rating", "coalesce(x.rating, 0) >= 2 AND coalesce(x.n, 0) < 4", (PAGES, VOTES, AXES, ALLOWED_VOTES, _AXIS_RATED), "w_pages p LEFT JOIN w_axis x USING (page_id)", category="*", rating_axis="purchase", rating=">=2", votes="<4")
_register("fi_date_year", "created_at >= DATE '1997-01-01' AND created_at < DATE '1998-01-01'", category="*", created_at="1997")
_register("fi_date_month", "created_at >= DATE '1998-02-01' AND created_at < DATE '1998-03-01'", category="*", created_at="1998.2")
_register("fi_date_compared", "updated_at <= DATE '1996-03-01'", category="*", updated_at="<= 1996-03-01")
_register("fi_date_relative", "created_at >= TIMESTAMP '1998-06-15' - INTERVAL 6 MONTH", category="*", created_at="last 6 months")
_register("fi_parent_none", "parent_id IS NULL", hidden=True, pagetype="*", category="*", parent="-")
_register("fi_parent_same", "parent_id IS NOT DISTINCT FROM 5", category="*", parent="=")
_register("fi_parent_different", "parent_id IS DISTINCT FROM 5", category="*", parent="-=")
_register("fi_parent_children", "parent_id = 40", category="*", parent=".")
_register("fi_parent_named", "parent_id IN (SELECT page_id FROM w_pages WHERE fullname = 'p:order-5')", category="*", parent="p:order-5")
_register("fi_fullname", "fullname = 'o:order-7'", category="*", fullname="o:order-7")
_register("fi_created_by", "owner_id IN (SELECT c_custkey FROM customer WHERE lower(c_name) = 'customer#000000011')", category="*", created_by="Customer#000000011")
_register("fi_name", "p.name = 'order-77'", category="*", name="order-77")
_register("fi_range_others", "p.page_id <> 40", category="*", page_range="others")
_register("fi_range_before", "p.page_id < 40", category="*", page_range="before")
_register("fi_pagetype_hidden", "starts_with(p.name, '_')", hidden=True, category="*", pagetype="hidden")
_register("fi_form_field", "priority = '1-URGENT'", category="*", form={"priority": "1-URGENT"})


@query(
    "fi_url_binding",
    sql(PAGES, body="""SELECT page_id, fullname FROM w_pages WHERE NOT starts_with(name, '_') AND category = 'o'
        AND created_at >= DATE '1999-01-01' AND created_at < DATE '2000-01-01' AND priority = '2-HIGH'"""),
)
def url_binding(spark, folder: str) -> DataFrame:
    attributes = {"category": "@URL|f", "createdAt": "@URL", "_priority": "@URL|2-HIGH", "name": "@URL"}
    bound = bound_query(attributes, "/start/category/o/createdat/1999?x=1")
    return Listing(Wiki(spark, folder), bound, NOW).matching().select("page_id", "fullname")


def _paged(query_name: str, by: str, where: str, skip: int, take: int, number: int, tables=(PAGES,), source="w_pages p", **selectors) -> None:
    body = f"""SELECT page_id, CAST({skip} + row_number() OVER (ORDER BY {by}) AS BIGINT) AS "index", total FROM (
      SELECT *, count(*) OVER () AS total FROM {source} WHERE NOT starts_with(p.name, '_') AND {where} ORDER BY {by} LIMIT {take} OFFSET {skip})"""
    query(query_name, sql(*tables, body=body))(lambda spark, folder: Listing(Wiki(spark, folder), PageQuery(**selectors), NOW).page(number).select(*LISTED))


_paged("so_default_newest", "created_at DESC, page_id DESC", "category = 'f'", 0, 20, 1)
_paged("so_title_asc_page3", "title, page_id", "category = 'o'", 50, 25, 3, category="o", order="titleAsc", per_page=25)
_paged("so_commented_nulls_last", "commented_at DESC NULLS LAST, page_id DESC", "category = 'p'", 10, 30, 1, category="p", order="commented_at", offset=10, limit=30, per_page=250)
_paged("so_reversed_size", "size ASC, page_id ASC", "true", 0, 20, 1, category="*", order="size desc", reverse=True)
_RATED_PAGES = "(SELECT p.*, coalesce(r.rating, 0) AS rating FROM w_pages p LEFT JOIN w_ratings r USING (page_id)) p"
_paged("so_rating", "rating DESC, page_id DESC", "true", 0, 20, 1, (PAGES, VOTES), _RATED_PAGES, category="*", order="rating")


_paged("so_metadata_price", "(SELECT o_totalprice FROM orders WHERE o_orderkey = page_id), page_id", "category = 'o'", 40, 20, 3, category="o", order="metadata{price} asc")
_paged("so_axis_rating", "rating DESC, page_id DESC", "true", 0, 20, 1, (PAGES, VOTES, AXES, ALLOWED_VOTES, _AXIS_RATED),
       "(SELECT p.*, coalesce(x.rating, 0) AS rating FROM w_pages p LEFT JOIN w_axis x USING (page_id)) p", category="*", order="rating desc", rating_axis="purchase")


@query("so_limit_zero", sql(PAGES, body='SELECT page_id, page_id AS "index", page_id AS total FROM w_pages WHERE false'))
def limit_zero(spark, folder: str) -> DataFrame:
    return Listing(Wiki(spark, folder), PageQuery(category="*", limit=0), NOW).page().select(*LISTED)


ITEM = "%%index%%. %%title_linked%% by %%created_by%% on %%created_at|%e %b %Y%% (%%rating%%, %%tags%%) %%form_data{priority}%%%%unknown%%"
_ITEMS = sql(PAGES, TAGS, USERS, VOTES, body="""
  SELECT page_id, "index", "index" || '. [[[' || fullname || ' | ' || title || ']]] by ' || coalesce(u.name, 'Anonymous') || ' on '
    || strftime(created_at, '%-d %b %Y') || ' (' || coalesce(rating, 0) || ', ' || coalesce(array_to_string(l.tags, ' '), '') || ') ' || priority AS item
  FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, page_id DESC) AS "index" FROM w_pages WHERE NOT starts_with(name, '_') AND category = 'o' ORDER BY created_at DESC, page_id DESC LIMIT 50) p
  LEFT JOIN w_users u ON u.user_id = p.owner_id LEFT JOIN w_ratings r USING (page_id) LEFT JOIN w_lists l USING (page_id)""")  # fmt: skip


@query("listpages_flagship", _ITEMS)
def flagship(spark, folder: str) -> DataFrame:
    """A listing from selectors to items: category, order, top 50, owner, rating, tags and dates in a template."""
    return rendered(Listing(Wiki(spark, folder), PageQuery(category="o", per_page=50), NOW), Template(ITEM))


@query(
    "pj_parent_children_template",
    sql(PAGES, body="""SELECT p.page_id, "index", p.name || ' < ' || coalesce('[[[' || q.fullname || ' | ' || q.title || ']]]', '') || ' has ' || coalesce(c.n, 0) || ' / ' || total AS item
      FROM (SELECT *, row_number() OVER (ORDER BY fullname, page_id) AS "index" FROM (
        SELECT *, count(*) OVER () AS total FROM w_pages WHERE NOT starts_with(name, '_') AND page_id < 40) ORDER BY fullname, page_id LIMIT 20) p
      LEFT JOIN w_pages q ON q.page_id = p.parent_id LEFT JOIN (SELECT parent_id, count(*) AS n FROM w_pages GROUP BY 1) c ON c.parent_id = p.page_id"""),
)
def parent_children(spark, folder: str) -> DataFrame:
    listing = Listing(Wiki(spark, folder), PageQuery(category="*", page_range="before", order="fullname asc"), NOW)
    return rendered(listing, Template("%%name%% < %%parent_title_linked%% has %%children%% / %%total%%"))


#: What SQL needs for readable texts of prose, and for text that markup can't act in.
_BOLD = r"regexp_replace(content, '\*\*(\S(?:[^*\n]*\S)?)\*\*', '\1', 'g')"
_READABLE = rf"regexp_replace(regexp_replace(regexp_replace({_BOLD}, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def _literal(text: str) -> str:
    return f"CASE WHEN {text} = '' THEN '' ELSE '@<' || array_to_string(list_transform(regexp_extract_all({text}, '(?s).'), lambda c: '&#' || unicode(c) || ';'), '') || '>@' END"


def _items(query_name: str, template: str, item: str, joins: str = "", tables: tuple[str, ...] = (PAGES,), where: str = "category = 'o'", take: int = 50, **selectors) -> None:
    """A query of a listing's items, newest pages first: what a template's variables give."""
    body = f"""SELECT p.page_id, "index", {item} AS item FROM (
      SELECT *, row_number() OVER (ORDER BY created_at DESC, page_id DESC) AS "index", count(*) OVER () AS total FROM w_pages WHERE NOT starts_with(name, '_') AND {where}
      ORDER BY created_at DESC, page_id DESC LIMIT {take}) p {joins}"""
    chosen = {"category": "o", "per_page": take} | selectors
    query(query_name, sql(*tables, body=body))(lambda spark, folder: rendered(Listing(Wiki(spark, folder), PageQuery(**chosen), NOW), Template(template)))


_TEXTS = """w_contents AS (SELECT doc_id AS page_id, text AS content FROM documents), w_read AS (SELECT page_id, content, """ + _READABLE + """ AS readable FROM w_contents)"""
_EARLY = {"category": "*", "page_range": "before"}
_items(
    "pj_content_variables", "%%content{1}%%|%%content{2}%%|%%preview(30)%%|%%preview%%|%%size%%",
    r"coalesce(regexp_replace(content, '^\s+|\s+$', '', 'g'), '') || '||' || " + _literal("coalesce(left_grapheme(readable, 30), '')") + " || '|' || " + _literal("coalesce(left_grapheme(readable, 200), '')")
    + " || '|' || coalesce(length_grapheme(readable), p.size)",
    "LEFT JOIN w_read r USING (page_id)", (PAGES, _TEXTS), "page_id < 40", 40, **_EARLY,
)
_items(
    "pj_summary_and_excerpt", r'%%summary%%|%%first_paragraph%%|%%excerpt{pattern="[a-z]+\."}%%',
    _literal("f") + " || '|' || " + _literal("f") + " || '|' || " + _literal("coalesce(regexp_extract(readable, '[a-z]+\\.'), '')"),
    "LEFT JOIN (SELECT *, coalesce(list_filter(list_transform(regexp_split_to_array(readable, '\\n[ \\t]*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1], '') AS f FROM w_read) r USING (page_id)",
    (PAGES, _TEXTS), "page_id < 40", 40, **_EARLY,
)
_items(
    "pj_people", "%%created_by_id%% %%created_by_unix%% %%updated_by%% %%updated_by_id%% %%updated_by_linked%% %%commented_by%% %%commented_by_id%% %%commented_by_unix%% %%commented_by_linked%%",
    "coalesce(a.user_id, 0) || ' ' || coalesce(a.unix_name, '') || ' ' || coalesce(b.name, 'Anonymous') || ' ' || coalesce(b.user_id, 0) || ' ' || coalesce('[[*user ' || b.name || ']]', 'Anonymous') || ' ' || coalesce(c.name, '')"
    " || ' ' || coalesce(c.user_id, 0) || ' ' || coalesce(c.unix_name, '') || ' ' || coalesce('[[*user ' || c.name || ']]', '')",
    "LEFT JOIN w_users a ON a.user_id = owner_id LEFT JOIN w_users b ON b.user_id = editor_id LEFT JOIN w_users c ON c.user_id = commenter_id", (PAGES, USERS), take=200,
)
_items("pj_parents", "%%parent_name%%/%%parent_category%%/%%parent_fullname%%/%%parent_title%%", "coalesce(q.name, '') || '/' || coalesce(q.category, '') || '/' || coalesce(q.fullname, '') || '/' || coalesce(q.title, '')", "LEFT JOIN w_pages q ON q.page_id = p.parent_id")
_items("pj_limits", "%%index%% of %%total%%, %%limit%%, %%total_or_limit%%", "\"index\" || ' of ' || total || ', 30, ' || least(total, 30)", take=30, limit=30)
_items("pj_no_limit", "%%limit%%, %%total_or_limit%%, %%site_title%% %%site_domain%%", "', ' || total || ', Scriptorium scriptorium.example'")
_items(
    "pj_form_variables", "%%form_data{priority}%% %%form_raw{priority}%% %%form_label{priority}%% %%form_hint{priority}%% %%form_label{other}%%.",
    "priority || ' ' || string_split(priority, '-')[1] || ' Priority of order ' || p.page_id || ' .'",
)
_items(
    "pj_metadata", "%%metadata{priority}%% %%metadata{due}|%Y-%m-%d%% %%metadata{buyer}%% %%metadata{buyer}|id%% %%metadata{buyer}|unix%% %%metadata{none}%%.",
    " || ' ' || ".join([_literal("priority"), _literal("strftime(created_at + to_days(30), '%Y-%m-%d')"), _literal("coalesce(u.name, '')"), _literal("CAST(owner_id AS VARCHAR)"), _literal("coalesce(u.unix_name, '')"), "'.'"]),
    "LEFT JOIN w_users u ON u.user_id = owner_id", (PAGES, USERS),
)
_items(
    "pj_custom_rates", "%%customrate{purchase}%% of %%customrate_votes{purchase}%%, %%customrate_percent{purchase}%%%, hidden %%customrate{error}%%, unknown %%customrate{none}%%.",
    "coalesce(x.points, 0) || ' of ' || coalesce(x.n, 0) || ', ' || CASE WHEN x.points > 0 THEN 100 ELSE 0 END || '%, hidden , unknown .'",
    "LEFT JOIN (SELECT page_id, CAST(sum(rate) AS BIGINT) AS points, count(*) AS n FROM w_open WHERE axis_key = 'purchase' GROUP BY page_id) x USING (page_id)",
    (PAGES, VOTES, AXES, ALLOWED_VOTES), "page_id < 40", 40, **_EARLY,
)
_items(
    "pj_linked_tags", "%%tags_linked%% %%_tags_linked%% %%_tags%% %%commented_at%%",
    "coalesce(array_to_string(list_transform(l.tags, lambda t: '[/system:page-tags/tag/' || t || ' ' || t || ']'), ' '), '') || ' ' || coalesce(array_to_string(list_transform(l.hidden_tags, lambda t: '[/system:page-tags/tag/' || t || ' ' || t || ']'), ' '), '')"
    " || ' ' || coalesce(array_to_string(l.hidden_tags, ' '), '') || ' ' || coalesce(strftime(commented_at, '%Y-%m-%dT%H:%M:%S.000Z'), '')",
    "LEFT JOIN w_lists l USING (page_id)", (PAGES, TAGS),
)


@query(
    "pj_default_body",
    sql(PAGES, USERS, _TEXTS, body=f"""SELECT p.page_id, "index", '+ [[[' || p.fullname || ' | ' || p.title || ']]]' || chr(10) || chr(10) || 'by ' || coalesce('[[*user ' || u.name || ']]', 'Anonymous') || ' '
      || strftime(created_at, '%Y-%m-%dT%H:%M:%S.000Z') || chr(10) || chr(10) || {_literal("f")} AS item
      FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, page_id DESC) AS "index" FROM w_pages WHERE NOT starts_with(name, '_') AND page_id < 40 ORDER BY created_at DESC, page_id DESC LIMIT 20) p
      LEFT JOIN w_users u ON u.user_id = owner_id LEFT JOIN (SELECT page_id, coalesce(list_filter(list_transform(regexp_split_to_array(readable, '\\n[ \\t]*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1], '') AS f FROM w_read) r USING (page_id)"""),
)
def default_body(spark, folder: str) -> DataFrame:
    return rendered(Listing(Wiki(spark, folder), PageQuery(**_EARLY), NOW))


_JOINED = """(SELECT string_agg(fullname, chr(10) ORDER BY created_at DESC, page_id DESC) AS items
      FROM (SELECT * FROM w_pages WHERE NOT starts_with(name, '_') AND category = 'p' ORDER BY created_at DESC, page_id DESC LIMIT 20))"""


@query("pj_assembled", sql(PAGES, body=f"SELECT '[[div]]' || chr(10) || items || chr(10) || '[[/div]]' AS body FROM {_JOINED}"))
def assembled_items(spark, folder: str) -> DataFrame:
    items = rendered(Listing(Wiki(spark, folder), PageQuery(category="p"), NOW), Template("%%fullname%%"))
    return assembled(items, "[[div]]", "[[/div]]", separate=False)


@query("pj_wrapped", sql(PAGES, body=f"""SELECT '[[div class="list-pages-box"]]' || chr(10) || items || chr(10) || '[[/div]]' AS body FROM {_JOINED}"""))
def wrapped_items(spark, folder: str) -> DataFrame:
    """Separate items take no lines before and after, but the box goes around them."""
    items = rendered(Listing(Wiki(spark, folder), PageQuery(category="p"), NOW), Template("%%fullname%%"))
    return assembled(items, "before", "after", separate=True, wrapper=True)


@query("jn_owner", sql(PAGES, USERS, body="SELECT page_id, u.name AS owner_name, u.unix_name AS owner_unix FROM w_pages p LEFT JOIN w_users u ON u.user_id = p.owner_id"))
def owners(spark, folder: str) -> DataFrame:
    wiki = Wiki(spark, folder)
    return with_owners(wiki.pages(), wiki).select("page_id", "owner_name", "owner_unix")


@query("lu_current_user", sql(USERS, body="SELECT 0 + user_id AS number, name AS title, unix_name AS name FROM w_users WHERE unix_name = 'customer-000000007'"))
def current_user(spark, folder: str) -> DataFrame:
    """A user listing knows one user: the one who looks."""
    me = Wiki(spark, folder).users().filter(F.col("unix_name") == "customer-000000007")
    return me.select(F.col("user_id").alias("number"), F.col("name").alias("title"), F.col("unix_name").alias("name"))


@query("lu_template", sql(USERS, body="SELECT user_id, '#' || user_id || ' ' || name || ' (' || unix_name || ') .' AS item FROM w_users"))
def user_template(spark, folder: str) -> DataFrame:
    return user_items(Wiki(spark, folder).users(), "#%%number%% %%Title%% (%%name%%) %%other%%.")
