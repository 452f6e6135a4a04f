"""Queries of text, date and arithmetic functions and of tag conditions, each with its SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import dates, text
from scriptorium.functions.expressions import directives, expression
from scriptorium.functions.selectors import TagCondition
from scriptorium.plans.base_sql import LINKS, PAGES, TEXTS, USERS, sql
from scriptorium.registry import query
from scriptorium.sources.wiki import Wiki


def _condition(name: str, condition: str, rule: str) -> None:
    @query(name, sql(TEXTS, body=f"SELECT page_id, {rule} AS shown FROM w_texts"))
    def run(spark, folder: str) -> DataFrame:
        return Wiki(spark, folder).texts().select("page_id", TagCondition(condition).predicate(F.col("tags")).alias("shown"))


_condition("it_required_forbidden", "+good -_toxic", "list_contains(tags, 'good') AND NOT list_contains(tags, '_toxic')")
_condition("it_any", "de fr -good", "list_has_any(tags, ['de', 'fr']) AND NOT list_contains(tags, 'good')")
def _undecided(name: str, condition: str, rule: str) -> None:
    """A condition over texts of which a third have no tag list yet: null there."""

    @query(name, sql(TEXTS, body=f"SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN {rule} END AS shown FROM w_texts"))
    def run(spark, folder: str) -> DataFrame:
        tags = F.when(F.col("page_id") % 3 != 0, F.col("tags"))
        return Wiki(spark, folder).texts().select("page_id", TagCondition(condition).predicate(tags).alias("shown"))


_undecided("it_bare_plus", "+ en", "false")
_undecided("it_bare_minus", "-", "true")
_undecided("it_nothing", "", "false")
_undecided("it_minus_and_bare", "- en", "list_contains(tags, 'en')")


@query("it_rendered", sql(TEXTS, body="SELECT page_id, list_contains(tags, 'good') AS shown FROM w_texts"))
def rendered_condition(spark, folder: str) -> DataFrame:
    """The renderer's reading of a condition ignores case and bare signs."""
    return Wiki(spark, folder).texts().select("page_id", TagCondition("+GOOD + -").predicate(F.col("tags"), ignore_case=True).alias("shown"))


def _math(name: str, source: str, rule: str) -> None:
    """An expression over every row of lineitem."""

    @query(name, f"SELECT l_orderkey, l_linenumber, {rule} AS value FROM lineitem")
    def run(spark, folder: str) -> DataFrame:
        value = expression(source, quantity=F.col("l_quantity"), price=F.col("l_extendedprice"), discount=F.col("l_discount"), tax=F.col("l_tax"), line=F.col("l_linenumber"))
        return Wiki(spark, folder).table("lineitem").select("l_orderkey", "l_linenumber", value.alias("value"))


_math("mx_arithmetic", "price * (1 - discount) + quantity % 7 - -line", "l_extendedprice * (1 - l_discount) + l_quantity % 7 + l_linenumber")
_math("mx_power_unary", "-2 ^ 2 + line ^ 2", "4.0 + CAST(l_linenumber AS DOUBLE) * l_linenumber")
_math("mx_logic", "quantity > 25 and not line = 1 or discount >= 0.09", "CASE WHEN (l_quantity > 25 AND l_linenumber <> 1) OR l_discount >= 0.09 THEN 1.0 ELSE 0.0 END")
_math("mx_division_by_zero", "quantity / (line - 2)", "CASE WHEN l_linenumber <> 2 THEN l_quantity / (l_linenumber - 2) END")
_math("mx_functions", "min(4, line, quantity) + max(line, 3) + abs(-line) + floor(price / 7) + ceil(tax * 10)", "least(4.0, l_linenumber, l_quantity) + greatest(l_linenumber, 3.0) + l_linenumber + floor(l_extendedprice / 7) + ceil(l_tax * 10)")
_math("mx_round_half_up", "round(0 - line - 0.5) + round(line + 0.5)", "floor(-l_linenumber - 0.5 + 0.5) + floor(l_linenumber + 1.0)")
_math("mx_constants", "true + false + (line <> 1) + (line != 2) + !line", "1.0 + CASE WHEN l_linenumber <> 1 THEN 1.0 ELSE 0.0 END + CASE WHEN l_linenumber <> 2 THEN 1.0 ELSE 0.0 END")
_math("mx_roots", "floor(sqrt(quantity) * 1000 + 0.5) + floor(log(pow(10, line)) + 0.5) + floor(ln(exp(line)) + 0.5)", "floor(sqrt(l_quantity) * 1000 + 0.5) + 2.0 * l_linenumber")
_math("mx_circular", "floor(sin(line) * 1000 + 0.5) + floor(cos(quantity) * 1000 + 0.5) / 7 + floor(tan(line) * 100 + 0.5)", "floor(sin(l_linenumber) * 1000 + 0.5) + floor(cos(l_quantity) * 1000 + 0.5) / 7 + floor(tan(l_linenumber) * 100 + 0.5)")


_SOURCE = "Line [[#expr line + 1]]: [[#ifexpr quantity > 25 | big, [[#expr [[#expr quantity]] * 2]] | small]] [[#if [[#expr line - 1]] | later | first]] [[#expr quantity / (line - 2)]][[#expr]][[#if x]] [[#EXPR 1 +]]."


@query(
    "mx_directives",
    """SELECT l_orderkey, l_linenumber, 'Line ' || (l_linenumber + 1) || ': ' || CASE WHEN l_quantity > 25 THEN 'big, ' || CAST(l_quantity * 2 AS BIGINT) ELSE 'small' END || ' '
      || CASE WHEN l_linenumber > 1 THEN 'later' ELSE 'first' END || ' ' || CASE l_linenumber WHEN 2 THEN 'ERROR' WHEN 1 THEN CAST(CAST(-l_quantity AS BIGINT) AS VARCHAR)
      ELSE CASE WHEN l_quantity % (l_linenumber - 2) = 0 THEN CAST(CAST(l_quantity / (l_linenumber - 2) AS BIGINT) AS VARCHAR) ELSE CAST(l_quantity / (l_linenumber - 2) AS VARCHAR) END END || ' ERROR.' AS text FROM lineitem""",
)
def directive_texts(spark, folder: str) -> DataFrame:
    """Expressions and conditions inside a source text, over every row of lineitem."""
    made = directives(_SOURCE, quantity=F.col("l_quantity"), line=F.col("l_linenumber"))
    return Wiki(spark, folder).table("lineitem").select("l_orderkey", "l_linenumber", made.alias("text"))


@query("mx_truth", "SELECT event_id, NOT (lower(trim(t)) IN ('false', 'null', '', '0')) AS truth FROM (SELECT event_id, [' False ', '0', 'yes', '', 'NULL', '00', event_type][event_id % 7 + 1] AS t FROM events)")
def truth(spark, folder: str) -> DataFrame:
    words = F.array(*map(F.lit, (" False ", "0", "yes", "", "NULL", "00")), F.col("event_type"))
    return Wiki(spark, folder).table("events").select("event_id", text.truth(F.get(words, (F.col("event_id") % 7).cast("int"))).alias("truth"))


@query("mx_number_text", "SELECT event_id, CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS text FROM events")
def number_text(spark, folder: str) -> DataFrame:
    return Wiki(spark, folder).table("events").select("event_id", text.number_text(F.col("value")).alias("text"))


@query("st_graphemes", "SELECT doc_id, length_grapheme(text) AS graphemes, left_grapheme(text, 200) AS preview FROM documents")
def graphemes(spark, folder: str) -> DataFrame:
    docs = Wiki(spark, folder).table("documents")
    return docs.select("doc_id", text.grapheme_count(F.col("text")).cast("long").alias("graphemes"), text.grapheme_prefix(F.col("text"), 200).alias("preview"))


@query("st_excerpt", r"SELECT doc_id, coalesce(regexp_extract_all(text, '(?i)\b(the\s+(\w+))', 2)[2], '') AS excerpt FROM documents")
def excerpts(spark, folder: str) -> DataFrame:
    docs = Wiki(spark, folder).table("documents")
    return docs.select("doc_id", text.excerpt(F.col("text"), r"\b(the\s+(\w+))", "i", group=2, match=2).alias("excerpt"))


@query("st_excerpt_refused", r"SELECT doc_id, '' AS refused, coalesce(regexp_extract(text, '[a-z]+'), '') AS taken FROM documents")
def refused_excerpts(spark, folder: str) -> DataFrame:
    """A pattern that looks around gives nothing, a plain one its match."""
    docs = Wiki(spark, folder).table("documents")
    return docs.select("doc_id", text.excerpt(F.col("text"), r"(?=the)(.)\1").alias("refused"), text.excerpt(F.col("text"), "[a-z]+").alias("taken"))


@query("st_page_slug", "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9:_-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def slugs(spark, folder: str) -> DataFrame:
    return Wiki(spark, folder).table("part").select("p_partkey", text.page_slug(F.col("p_name")).alias("slug"))


@query("st_url_component", "SELECT p_partkey, url_encode(p_type || ' ~*é/' || p_brand) AS coded FROM part")
def url_components(spark, folder: str) -> DataFrame:
    return Wiki(spark, folder).table("part").select("p_partkey", text.url_component(F.concat("p_type", F.lit(" ~*é/"), "p_brand")).alias("coded"))


@query("st_escape_html", "SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS digest FROM pages")
def escaped(spark, folder: str) -> DataFrame:
    return Wiki(spark, folder).table("pages").select("page_id", F.sha2(text.escape_html(F.col("html")), 256).alias("digest"))


@query("st_literal_markup", "SELECT p_partkey, '@<' || array_to_string(list_transform(regexp_extract_all(p_name, '.'), lambda c: '&#' || unicode(c) || ';'), '') || '>@' AS literal FROM part")
def literals(spark, folder: str) -> DataFrame:
    return Wiki(spark, folder).table("part").select("p_partkey", text.literal_markup(F.col("p_name")).alias("literal"))


@query("st_link_kind", sql(LINKS, body="SELECT page_id, ord, CASE WHEN starts_with(target, '#') THEN 'anchor' WHEN regexp_matches(target, '^(https?|ftp|gopher|news|mailto|mms):') OR starts_with(target, '/') THEN 'direct' ELSE 'page' END AS kind FROM w_links"))
def link_kinds(spark, folder: str) -> DataFrame:
    return Wiki(spark, folder).links().select("page_id", "ord", text.link_kind(F.col("target")).alias("kind"))


@query("st_emails", r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+')) AS addresses FROM documents")
def emails(spark, folder: str) -> DataFrame:
    return Wiki(spark, folder).table("documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(text.email_address()), 0)).cast("long").alias("addresses"))


@query("st_normalized_space", r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS digest FROM documents")
def normalized(spark, folder: str) -> DataFrame:
    return Wiki(spark, folder).table("documents").select("doc_id", F.sha2(text.normalized_space(F.col("text")), 256).alias("digest"))


@query(
    "st_first_paragraph",
    r"""SELECT doc_id, coalesce(list_filter(list_transform(regexp_split_to_array(text, '\n[ \t]*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1], '') AS paragraph,
      length(text) + len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]')) AS utf16 FROM documents""",
)
def first_paragraph(spark, folder: str) -> DataFrame:
    return Wiki(spark, folder).table("documents").select("doc_id", text.first_paragraph(F.col("text")).alias("paragraph"), text.utf16_length(F.col("text")).cast("long").alias("utf16"))


@query("da_iso_strftime", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS iso, strftime(o_orderdate, '%a %d %B %Y, week day %w, day %j, %I:%M %p') || ' UTC +0000 100%' AS text FROM orders""")
def date_texts(spark, folder: str) -> DataFrame:
    orders = Wiki(spark, folder).table("orders")
    return orders.select("o_orderkey", dates.iso(F.col("o_orderdate")).alias("iso"), dates.strftime(F.col("o_orderdate"), "%a %d %B %Y, week day %w, day %j, %I:%M %p %Z %z 100%%").alias("text"))


@query("da_elapsed", """SELECT event_id, CASE WHEN s >= 86400 THEN s // 86400 || CASE WHEN s // 86400 = 1 THEN ' day ago' ELSE ' days ago' END
    WHEN s >= 3600 THEN s // 3600 || CASE WHEN s // 3600 = 1 THEN ' hour ago' ELSE ' hours ago' END
    WHEN s >= 60 THEN s // 60 || CASE WHEN s // 60 = 1 THEN ' minute ago' ELSE ' minutes ago' END ELSE 'just now' END AS ago
  FROM (SELECT event_id, greatest(epoch(TIMESTAMP '2024-01-20') - CAST(floor(epoch(ts)) AS BIGINT), 0)::BIGINT AS s FROM events)""")  # fmt: skip
def elapsed(spark, folder: str) -> DataFrame:
    return Wiki(spark, folder).table("events").select("event_id", dates.elapsed(F.col("ts"), F.lit(datetime(2024, 1, 20))).alias("ago"))


@query("sk_content_blobs", "SELECT page_id, sha256(html) AS digest, 'local--html/' || page_id || '/' || substring(sha256(html), 1, 16) AS key FROM pages")
def blobs(spark, folder: str) -> DataFrame:
    """Content-addressed blobs of the pages' sources."""
    digest = F.sha2("html", 256)
    return Wiki(spark, folder).table("pages").select("page_id", digest.alias("digest"), F.concat(F.lit("local--html/"), F.col("page_id").cast("string"), F.lit("/"), F.substring(digest, 1, 16)).alias("key"))


@query("sc_default_user", sql(USERS, body="SELECT event_id, coalesce(name, 'Anonymous') AS name FROM events LEFT JOIN w_users u ON u.user_id = events.user_id AND u.user_id % 3 = 0"))
def default_user(spark, folder: str) -> DataFrame:
    wiki = Wiki(spark, folder)
    return wiki.table("events").join(wiki.users().filter("user_id % 3 = 0"), "user_id", "left").select("event_id", F.coalesce("name", F.lit("Anonymous")).alias("name"))


@query("sc_point_lookup", sql(PAGES, body="SELECT page_id, fullname, title FROM w_pages WHERE fullname IN ('o:order-11', 'f:order-12', 'p:order-13', 'o:order-12', 'o:order-13', 'f:order-11', 'p:order-11')"))
def point_lookup(spark, folder: str) -> DataFrame:
    wiki = Wiki(spark, folder)
    wanted = wiki.spark.createDataFrame([(f"{c}:order-{n}",) for c, n in (("o", 11), ("f", 12), ("p", 13), ("o", 12), ("o", 13), ("f", 11), ("p", 11))], "fullname string")
    return wiki.pages().join(F.broadcast(wanted), "fullname", "left_semi").select("page_id", "fullname", "title")


_IMAGES = """w_images AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'https://x.example/' || p_partkey || '.png' WHEN 1 THEN '/dir/' || p_partkey || '.png' WHEN 2 THEN 'pic-' || p_partkey || '.png'
  WHEN 3 THEN 'page-' || p_size || '/pic.png' WHEN 4 THEN 'far:page-' || p_size || '/pic.png' WHEN 5 THEN 'far/page/' || p_partkey ELSE '/a/../b?' END AS source, p_partkey % 7 AS k, p_size FROM part)"""


def _images(spark, folder: str) -> DataFrame:
    key, size, kind = F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.col("p_partkey") % 7
    sources = [F.concat(F.lit("https://x.example/"), key, F.lit(".png")), F.concat(F.lit("/dir/"), key, F.lit(".png")), F.concat(F.lit("pic-"), key, F.lit(".png")), F.concat(F.lit("page-"), size, F.lit("/pic.png")),
               F.concat(F.lit("far:page-"), size, F.lit("/pic.png")), F.concat(F.lit("far/page/"), key), F.lit("/a/../b?")]
    return Wiki(spark, folder).table("part").select("p_partkey", F.get(F.array(*sources), kind.cast("int")).alias("source"))


@query(
    "st_image_source",
    sql(_IMAGES, body="""SELECT p_partkey, CASE WHEN k IN (0, 1, 6) THEN 'url' WHEN k = 2 THEN 'file1' WHEN k = 3 THEN 'file2' ELSE 'file3' END AS kind, CASE WHEN k IN (4, 5) THEN 'far' END AS site,
      CASE WHEN k IN (3, 4) THEN 'page-' || p_size WHEN k = 5 THEN 'page' END AS page, CASE WHEN k IN (3, 4) THEN 'pic.png' WHEN k = 5 THEN CAST(p_partkey AS VARCHAR) ELSE source END AS file,
      CASE k WHEN 0 THEN source WHEN 1 THEN '/local--files' || source WHEN 2 THEN '/local--files/here/' || source WHEN 3 THEN '/local--files/' || source WHEN 4 THEN '/local--files/far/page-' || p_size || '/pic.png'
        WHEN 5 THEN '/local--files/' || source END AS url FROM w_images"""),
)
def image_sources(spark, folder: str) -> DataFrame:
    """Image sources by kind, and where each is read from; an unsafe path has no place."""
    found = _images(spark, folder).withColumn("at", text.image_source(F.col("source")))
    return found.select("p_partkey", "at.kind", "at.site", "at.page", "at.file", text.image_url(F.col("source"), F.lit("here")).alias("url"))


@query("st_safe_path", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'a/size ' || p_size || '/b' END AS path FROM part")
def safe_paths(spark, folder: str) -> DataFrame:
    name, kind = F.concat(F.lit("size "), F.col("p_size").cast("string")), (F.col("p_partkey") % 4).cast("int")
    made = F.get(F.array(F.concat(F.lit("/a/"), name, F.lit("/b")), F.concat(F.lit("a/./"), name), F.concat(F.lit("a//"), name), F.concat(name, F.lit("#/x"))), kind)
    return Wiki(spark, folder).table("part").select("p_partkey", text.safe_local_path(made).alias("path"))


@query(
    "st_page_link",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'https://one.example' WHEN 2 THEN 'https://two.example' ELSE '/three' END || '/page-' || p_size || '#part-' || lower(p_brand) AS link FROM part""",
)
def page_links(spark, folder: str) -> DataFrame:
    """Links to pages of this site, of a site with a known domain, of one named by its domain, and of another."""
    site = F.get(F.array(F.lit(None).cast("string"), F.lit("one"), F.lit("two.example"), F.lit("Three")), (F.col("p_partkey") % 4).cast("int"))
    page = F.concat(F.lit("Page "), F.col("p_size").cast("string"), F.lit("#Part-"), "p_brand")
    return Wiki(spark, folder).table("part").select("p_partkey", text.page_link(page, site, {"one": "http://one.example//"}).alias("link"))


@query("st_provider_ids", "SELECT p_partkey, regexp_full_match(p_brand, '[a-zA-Z0-9_-]+') AS video, regexp_full_match(CAST(p_partkey AS VARCHAR), '[0-9]+') AND p_partkey % 2 = 0 AS snippet, p_size % 2 = 0 AS hash FROM part")
def provider_ids(spark, folder: str) -> DataFrame:
    snippet = F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise("x"))
    digest = F.when(F.col("p_size") % 2 == 0, F.md5("p_name")).otherwise(F.upper(F.concat(F.md5("p_name"), F.lit("f"))))
    return Wiki(spark, folder).table("part").select(
        "p_partkey", text.provider_id_fits(F.col("p_brand"), "video").alias("video"), text.provider_id_fits(snippet, "gitlab-snippet").alias("snippet"), text.provider_id_fits(digest, "gist").alias("hash")
    )


@query("da_date_element", """SELECT event_id, '<span class="odate time_' || CAST(floor(epoch(ts)) AS BIGINT) || ' format_%25e%20%25b%7Cagohover">' || strftime(ts, '%d %b %Y %H:%M') || '</span>' AS element FROM events""")
def date_elements(spark, folder: str) -> DataFrame:
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return Wiki(spark, folder).table("events").select("event_id", dates.date_element(seconds, "%e %b", hover=True).alias("element"))
