"""Page listings: selectors, order, paging and projected templates over the wiki's tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import dates, markup, selectors, text
from scriptorium.operators.ratings import accepted_votes, main_ratings, rating_columns
from scriptorium.sources.wiki import Wiki

#: Names of orders (fixed values): what a listing calls a field, and the column it means.
ORDERS = {
    "datecreated": "created_at", "created_at": "created_at", "dateedited": "updated_at", "updated_at": "updated_at",
    "commented_at": "commented_at", "title": "title", "fullname": "fullname", "rating": "rating", "votes": "rating_votes",
    "revisions": "revisions", "comments": "comments", "pagelength": "size", "size": "size", "random": "random",
}
PER_PAGE, PER_PAGE_MOST = 20, 250


@dataclass(frozen=True)
class Current:
    """The page that a listing stands on."""

    page_id: int = 0
    category: str = "f"
    tags: tuple[str, ...] = ()
    parent_id: int | None = None
    now: datetime = datetime(2001, 1, 1)


@dataclass(frozen=True)
class PageQuery:
    """A listing's selectors as their texts; None is no selector."""

    category: str | None = None
    tags: str | None = None
    rating: str | None = None
    votes: str | None = None
    rating_axis: str | None = None
    created_at: str | None = None
    updated_at: str | None = None
    created_by: str | None = None
    parent: str | None = None
    name: str | None = None
    fullname: str | None = None
    page_range: str | None = None
    pagetype: str = "normal"
    link_to: str | None = None
    form: dict[str, str] = field(default_factory=dict)
    order: str = "created_at desc"
    reverse: bool = False
    offset: int = 0
    limit: int | None = None
    per_page: int = PER_PAGE
    readable_sizes: bool = False


def parse_order(order: str) -> tuple[str, bool]:
    """(column, descending): a field and its direction as two words or in one, where only ``asc`` ascends and further words
    don't count; ``metadata{key}`` is the column ``metadata.key``; else newest first."""
    name, _, rest = order.strip().partition("}")
    if name[:9].lower() == "metadata{" and "}" in order and rest.lower().strip() in ("", "asc", "desc") and (not rest or rest[0].isspace()):
        return f"metadata.{name[9:]}", rest.lower().strip() != "asc"
    words = order.lower().split()
    if len(words) > 1 and words[0] in ORDERS:
        return ORDERS[words[0]], words[1] != "asc"
    whole = order.strip().lower()
    field_name = whole.removesuffix("desc") if whole.endswith("desc") else whole.removesuffix("asc")
    return (ORDERS[field_name], whole == field_name or whole.endswith("desc")) if field_name in ORDERS else ("created_at", True)


#: Attribute spellings of a listing (fixed values): other names for a selector.
ALIASES = {"categories": "category", "tag": "tags", "createdat": "created_at", "created-at": "created_at", "createdby": "created_by", "created-by": "created_by", "pagetype": "pagetype", "page-type": "pagetype", "perpage": "per_page", "per-page": "per_page", "linkto": "link_to", "link-to": "link_to", "range": "page_range", "ratingaxis": "rating_axis", "rating-axis": "rating_axis"}


def url_parameters(path: str) -> dict[str, str]:
    """Key and value pairs of a path, after its page name unless it begins with a parameter's name; what follows ``?``
    or ``#`` doesn't count."""
    words = [unquote(w) for w in re.split(r"[?#]", path, maxsplit=1)[0].split("/") if w]
    if words and words[0].lower() not in {*ALIASES, *PageQuery.__dataclass_fields__}:
        words = words[1:]
    return dict(zip(words[::2], words[1::2]))


def bound_query(attributes: dict[str, str], path: str = "", prefix: str = "") -> PageQuery:
    """A query from a listing's attributes; ``@URL`` or ``@URL|default`` takes the value from the path."""
    given, values, form = url_parameters(path), {}, {}
    for key, value in attributes.items():
        key = key.lower()
        name = ALIASES.get(key, key)
        if value.startswith("@URL"):
            value = given.get(f"{prefix}_{key}" if prefix else key, value[5:] if value[4:5] == "|" else None)
        if value is None:
            continue
        if key.startswith("_"):
            form[key[1:]] = value
        elif name in ("offset", "limit", "per_page"):
            found = re.match(r"\s*[+-]?\d+", value)
            if found:
                values[name] = int(found[0])
        elif name == "reverse":
            values[name] = value.lower() in ("true", "yes", "1")
        elif name in PageQuery.__dataclass_fields__:
            values[name] = value
    return PageQuery(**values, form=form)


class Listing:
    """A listing over a wiki; every step gives a DataFrame."""

    def __init__(self, wiki: Wiki, query: PageQuery, current: Current = Current()):
        self.wiki, self.query, self.current = wiki, query, current

    def matching(self) -> DataFrame:
        """Pages that the selectors keep. Ratings, tags and links are joined only where they are asked for."""
        q, now = self.query, self.current
        pages, order = self.wiki.pages(), parse_order(q.order)[0]
        if order.startswith("metadata.") and order[9:] not in self.wiki.metadata_keys:
            return pages.filter(F.lit(False)).withColumn("sorted_by", F.lit(None).cast("string"))  # no result, not another order
        rules: list[Column | None] = [
            selectors.category_predicate(q.category, F.col("category"), now.category),
            selectors.date_predicate(q.created_at, F.col("created_at"), now.now),
            selectors.date_predicate(q.updated_at, F.col("updated_at"), now.now),
            selectors.parent_predicate(q.parent, F.col("parent_id"), now.page_id, now.parent_id),
            {"normal": ~F.col("name").startswith("_"), "hidden": F.col("name").startswith("_")}.get(q.pagetype),
            {".": F.col("page_id") == now.page_id, "others": F.col("page_id") != now.page_id, "before": F.col("page_id") < now.page_id, "after": F.col("page_id") > now.page_id}.get(q.page_range or ""),
            F.col("name") == q.name if q.name else None,
            F.col("fullname") == q.fullname if q.fullname else None,
            *[F.try_element_at("form_data", F.lit(k)) == v for k, v in q.form.items()],
        ]
        for rule in rules:
            pages = pages if rule is None else pages.filter(rule)
        if q.created_by:
            pages = pages.join(self.wiki.users().filter(F.lower("name") == q.created_by.lower()), F.col("owner_id") == F.col("user_id"), "left_semi")
        if q.tags:
            none = F.array().cast("array<string>")
            pages = pages.join(self.wiki.tag_lists(), "page_id", "left").withColumns({c: F.coalesce(c, none) for c in ("tags", "hidden_tags")})
            rule = selectors.tags_predicate(q.tags, F.col("tags"), F.col("hidden_tags"), list(now.tags))
            pages = pages if rule is None else pages.filter(rule)
        if q.link_to:
            pages = pages.join(self.wiki.links().filter(F.col("target") == q.link_to), "page_id", "left_semi")
        parent = selectors.parent_name(q.parent)
        if parent:
            named = self.wiki.pages().filter(F.col("fullname") == parent).select(F.col("page_id").alias("parent_id"))
            pages = pages.join(named, "parent_id", "left_semi")
        if q.rating_axis is not None:
            # An axis that isn't known or doesn't show its sums gives no result: its table of one row joins nothing.
            pages = with_axis(pages, self.wiki, q.rating_axis)
        if q.rating or q.votes or q.rating_axis is not None or order in ("rating", "rating_votes"):
            pages = pages if q.rating_axis is not None else with_ratings(pages, self.wiki)
            for rule in (selectors.number_predicate(q.rating, F.col("rating")), selectors.number_predicate(q.votes, F.col("rating_votes"))):
                pages = pages if rule is None else pages.filter(rule)
        if order == "size" and q.readable_sizes:
            # What a reader sees of a page; one without a text has no size and comes last.
            texts = self.wiki.contents().select("page_id", text.grapheme_count(markup.readable(F.col("content"))).alias("sorted_by"))
            pages = pages.join(texts, "page_id", "left")
        if order.startswith("metadata."):
            value = F.try_element_at("metadata", F.lit(order[9:]))
            by = F.when(value.isNotNull(), F.struct(*[value[k] for k in ("number", "date", "text", "user_id")]))
            pages = pages.join(self.wiki.metadata(), "page_id", "left").withColumn("sorted_by", by)
        return pages

    def ordering(self) -> list[Column]:
        name, down = parse_order(self.query.order)
        down ^= self.query.reverse
        by = F.xxhash64("page_id") if name == "random" else F.col("sorted_by" if name.startswith("metadata.") or name == "size" and self.query.readable_sizes else name)
        return [by.desc_nulls_last() if down else by.asc_nulls_last(), F.col("page_id").desc() if down else F.col("page_id").asc()]

    def page_size(self) -> int:
        return min(self.query.per_page if self.query.per_page > 0 else PER_PAGE, PER_PAGE_MOST)

    def page(self, number: int = 1) -> DataFrame:
        """One page of the listing with ``index`` (from 1) and ``total``, the matches before paging.

        The total is a one-row aggregate; the page is a top-k, so no full sort and no window over all rows.
        A page number past the end gives the last page.
        """
        q = self.query
        found = self.matching()
        size = self.page_size()
        if q.limit == 0:
            return found.limit(0).withColumns({"total": F.lit(0).cast("long"), "index": F.lit(0).cast("long")})
        most = q.limit if q.limit is not None and q.limit >= 0 else None
        offset = max(q.offset, 0)
        if number > 1:
            count = max(found.count() - offset, 0)
            count = count if most is None else min(count, most)
            number = max(1, min(number, -(-count // size)))
        skip = (number - 1) * size
        take = size if most is None else min(size, max(most - skip, 0))
        rows = found.orderBy(*self.ordering()).offset(offset + skip).limit(take)
        place = F.row_number().over(Window.orderBy(*self.ordering())) + (offset + skip)
        total = F.broadcast(found.agg(F.count("*").alias("total")))
        return rows.withColumn("index", place.cast("long")).crossJoin(total)


def with_ratings(pages: DataFrame, wiki: Wiki) -> DataFrame:
    """Pages with rating, rating_votes and rating_percent; zero without votes."""
    rated = pages.join(main_ratings(wiki).select("page_id", "rating", "rating_votes", "rating_percent"), "page_id", "left")
    return rated.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("rating", "rating_votes", "rating_percent")})


def with_axis(pages: DataFrame, wiki: Wiki, axis: str) -> DataFrame:
    """Pages with rating, rating_votes and rating_percent of one axis; no pages where the axis is unknown or hidden."""
    shown = wiki.axes().filter((F.col("axis_key") == axis) & F.col("enabled") & F.col("show_aggregate")).select(F.lit(1).alias("shown"))
    votes = accepted_votes(wiki).filter(F.col("axis_key") == axis).groupBy("page_id").agg(*rating_columns(F.col("rate"))).drop("positive")
    rated = pages.join(votes, "page_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("rating", "rating_votes", "rating_percent")})
    return rated.join(shown.limit(1), F.lit(True), "left_semi")


def pager_pages(current: int, total: int) -> list[int]:
    """Numbers a pager shows: first, last and two on each side."""
    return sorted({1, total, *range(max(1, current - 2), min(total, current + 2) + 1)}) if total > 1 else []


def pager_neighbours(current: int, total: int) -> tuple[int | None, int | None]:
    """The page before and the one after, where there is one."""
    return (current - 1 if 1 < current <= total else None, current + 1 if 1 <= current < total else None)


def pager_parameters(prefixes: list[str]) -> list[str]:
    """The page parameter of each listing of a page: its own prefix, and for those without one p, p2, p3 in order."""
    bare = iter(range(1, len(prefixes) + 1))
    return [f"{x}_p" if x else "p" if (n := next(bare)) == 1 else f"p{n}" for x in prefixes]


def pager_url(path: str, parameter: str, page: int) -> str:
    """The path with its page parameter set: page name, then pairs of key and value, the parameter's own last."""
    bare, suffix = re.fullmatch(r"([^?#]*)(.*)", path, re.S).groups()
    name, *rest = bare.strip("/").split("/")
    pairs = [rest[k : k + 2] for k in range(0, len(rest), 2)]
    words = [name, *(w for pair in pairs if pair[0] != parameter for w in pair)]
    return "/".join(["", *filter(None, words), parameter, str(page)]) + suffix


#: What a listing shows without a template (fixed value).
DEFAULT_BODY = "+ %%title_linked%%\n\nby %%created_by_linked%% %%created_at%%\n\n%%summary%%"

_QUOTED = r"""(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')"""
#: A variable of a template. The braces of an excerpt end at the first one outside quotes.
_VARIABLE = re.compile(
    rf"%%(?:(excerpt)\{{((?:{_QUOTED}|[^\"'}}])*)\}}|([a-z_]+)(?:\{{([^}}%]*)\}})?(?:\((\d+)\))?(?:\|([^%]*(?:%[A-Za-z%][^%]*)*?))?)%%", re.I | re.S
)
_OPTION = re.compile(r"""\s*(pattern|flags|group|match|max)\s*=\s*(?:"((?:\\["\\]|\\(?!["\\])|[^"\\])*)"|'((?:\\['\\]|\\(?!['\\])|[^'\\])*)')(?=\s|\Z)""", re.S)
OPTIONS_MOST = 8192


def excerpt_options(source: str) -> dict[str, str] | None:
    """Named, quoted options of an excerpt, each once; a backslash before the quote makes it a character of the value and
    stays before anything else. None for a text that is anything but options, or gives no pattern."""
    found, at = {}, 0
    source = source.rstrip()
    while at < len(source):
        m = _OPTION.match(source, at)
        if not m or m[1] in found or len(source) > OPTIONS_MOST:
            return None
        quote, value = ('"', m[2]) if m[2] is not None else ("'", m[3])
        found[m[1]] = re.sub(rf"\\(\\|{quote})", lambda e: quote if e[1] == quote else e[0], value)
        at = m.end()
    return found if "pattern" in found else None


class Template:
    """A listing's item template as one Column: literal parts and the variables' columns, concatenated."""

    def __init__(self, source: str, site: dict[str, str] | None = None):
        self.pieces, at = [], 0
        self.site = {"title": "Scriptorium", "name": "scriptorium", "domain": "scriptorium.example"} | (site or {})
        for m in _VARIABLE.finditer(source):
            self.pieces += [source[at : m.start()], (m[1].lower(), m[2], None, None) if m[1] else (m[3].lower(), m[4], m[5], m[6])]
            at = m.end()
        self.pieces.append(source[at:])

    @property
    def names(self) -> set[str]:
        """Variables that the template uses: what has to be joined for it."""
        return {p[0] for p in self.pieces if not isinstance(p, str)}

    @property
    def axes(self) -> list[str]:
        """Rating axes that the template names."""
        return sorted({p[1] for p in self.pieces if not isinstance(p, str) and p[0].startswith("customrate") and p[1]})

    def column(self, limit: int | None = None) -> Column:
        """``limit``: the listing's limit, which two variables show."""
        return F.concat(F.lit(""), *[F.lit(p) if isinstance(p, str) else self.variable(*p, limit) for p in self.pieces if p])

    def variable(self, name: str, brace: str | None, number: str | None, pattern: str | None, limit: int | None = None) -> Column:
        """A variable's text; one that is not known is empty."""
        blank = F.lit("")
        who = re.fullmatch(r"(created|updated|commented)_by(?:_(unix|id|linked))?", name)
        if name in ("created_at", "updated_at", "commented_at"):
            return F.coalesce(dates.strftime(F.col(name), pattern) if pattern else dates.iso(F.col(name)), blank)
        if who:
            return self._user(who[1], who[2])
        if name == "content" and brace:
            return F.coalesce(text.section(F.col("content"), int(brace)), blank) if brace.isdigit() and int(brace) else blank
        if name == "preview":
            return text.literal_markup(F.coalesce(text.grapheme_prefix(F.col("readable"), int(number or 200)), blank))
        if name in ("summary", "first_paragraph"):
            return text.literal_markup(text.first_paragraph(markup.readable(markup.without_headings(F.col("content")))))
        if name == "size":
            return F.coalesce(text.grapheme_count(F.col("readable")).cast("string"), F.col("size").cast("string"), blank)
        if name in ("tags", "_tags"):
            return F.coalesce(F.array_join("hidden_tags" if name[0] == "_" else "tags", " "), blank)
        if name in ("tags_linked", "_tags_linked"):
            start = pattern or "/system:page-tags/tag/"
            linked = F.transform("hidden_tags" if name[0] == "_" else "tags", lambda t: F.concat(F.lit(f"[{start}"), t, F.lit(" "), t, F.lit("]")))
            return F.coalesce(F.array_join(linked, " "), blank)
        if name in ("form_data", "form_raw", "form_label", "form_hint"):
            return F.coalesce(F.try_element_at(name, F.lit(brace or "")), blank)
        if name == "metadata":
            return self._metadata(brace or "", pattern)
        if name in ("customrate", "customrate_votes", "customrate_percent"):
            part = {"customrate": "rating", "customrate_votes": "rating_votes", "customrate_percent": "rating_percent"}[name]
            return F.coalesce(F.try_element_at("custom_rates", F.lit(brace or ""))[part].cast("string"), blank)
        if name.startswith("site_"):
            return F.lit(self.site.get(name[5:], ""))
        if name == "excerpt":
            return text.literal_markup(F.coalesce(self._excerpt(excerpt_options(brace or "")), blank))
        made = {
            "title_linked": lambda: F.concat(F.lit("[[["), "fullname", F.lit(" | "), "title", F.lit("]]]")),
            "link": lambda: F.concat(F.lit(f"https://{self.site['domain']}/"), "fullname"),
            "parent_title_linked": lambda: F.coalesce(F.concat(F.lit("[[["), "parent_fullname", F.lit(" | "), "parent_title", F.lit("]]]")), blank),
            "limit": lambda: F.lit("" if limit is None else str(limit)),
            "total_or_limit": lambda: (F.col("total") if limit is None else F.least("total", F.lit(limit).cast("long"))).cast("string"),
        }
        if name in made:
            return made[name]()
        plain = (
            "name", "category", "fullname", "title", "content", "children", "comments", "revisions", "rating", "rating_votes", "rating_percent", "index", "total",
            "parent_name", "parent_category", "parent_fullname", "parent_title",
        )
        return F.coalesce(F.col(name).cast("string"), blank) if name in plain else blank

    def _excerpt(self, options: dict[str, str] | None) -> Column:
        """Of the options only a group may be other than a number."""
        numbers = {k: (options or {}).get(k, d) for k, d in (("match", "1"), ("max", "200"))}
        if options is None or not all(v.isascii() and v.isdecimal() for v in numbers.values()):
            return F.lit("")
        group = options.get("group", "0")
        group = int(group) if group.isascii() and group.isdecimal() else group
        return text.excerpt(F.col("readable"), options["pattern"], options.get("flags", ""), group, int(numbers["match"]), int(numbers["max"]))

    def _user(self, role: str, part: str | None) -> Column:
        """A user's name or part; nobody is Anonymous, but a page without comments has no one who commented."""
        nobody = F.lit("" if role == "commented" else "Anonymous")
        name, unix, number = (F.col(f"{role}_by_{x}") for x in ("name", "unix", "id"))
        if part == "unix":
            return F.coalesce(unix, F.lit(""))
        if part == "id":
            return F.coalesce(F.when(name.isNotNull(), number.cast("string")), F.lit("0"))
        return F.coalesce(F.concat(F.lit("[[*user "), name, F.lit("]]")) if part == "linked" else name, nobody)

    def _metadata(self, key: str, form: str | None) -> Column:
        """A registered value as literal text: dates by their form, users by name, id or unix name."""
        value = F.try_element_at("metadata", F.lit(key))
        user = {"id": value["user_id"].cast("string"), "unix": value["user_unix"]}.get(form or "", value["user_name"])
        shown = (
            F.when(value["kind"] == "text", value["text"])
            .when(value["kind"] == "number", text.number_text(value["number"]))
            .when(value["kind"] == "date", dates.strftime(value["date"], form) if form else dates.iso(value["date"]))
            .when(value["kind"] == "user", user)
        )
        return text.literal_markup(F.coalesce(shown, F.lit("")))


#: The column of pages that has the user of each role.
ROLES = {"created": "owner_id", "updated": "editor_id", "commented": "commenter_id"}


def with_owners(pages: DataFrame, wiki: Wiki) -> DataFrame:
    users = wiki.users().select(F.col("user_id").alias("owner_id"), F.col("name").alias("owner_name"), F.col("unix_name").alias("owner_unix"))
    return pages.join(users, "owner_id", "left")


def with_users(pages: DataFrame, wiki: Wiki, role: str) -> DataFrame:
    """Pages with name, unix name and id of the user in a role."""
    users = wiki.users().select(F.col("user_id").alias(f"{role}_by_id"), F.col("name").alias(f"{role}_by_name"), F.col("unix_name").alias(f"{role}_by_unix"))
    return pages.join(users, F.col(ROLES[role]) == F.col(f"{role}_by_id"), "left")


def with_parents(pages: DataFrame, wiki: Wiki) -> DataFrame:
    parents = wiki.pages().select(F.col("page_id").alias("parent_id"), *[F.col(c).alias(f"parent_{c}") for c in ("fullname", "title", "name", "category")])
    return pages.join(parents, "parent_id", "left")


def with_contents(pages: DataFrame, wiki: Wiki) -> DataFrame:
    """Pages with their source and their readable text, null where a page has none."""
    return pages.join(wiki.contents(), "page_id", "left").withColumn("readable", markup.readable(F.col("content")))


def with_metadata(pages: DataFrame, wiki: Wiki) -> DataFrame:
    """Pages with their registered values, the users among them by name too."""
    kept = pages.drop("metadata") if "metadata" in pages.columns else pages
    rows = kept.join(wiki.metadata(), "page_id", "left")
    entries = rows.select("page_id", F.explode("metadata").alias("key", "value")).select("page_id", "key", "value.*")
    users = wiki.users().select("user_id", F.col("name").alias("user_name"), F.col("unix_name").alias("user_unix"))
    named = entries.join(users, "user_id", "left")
    value = F.struct("key", F.struct("kind", "text", "number", "date", "user_id", "user_name", "user_unix").alias("value"))
    return kept.join(named.groupBy("page_id").agg(F.map_from_entries(F.collect_list(value)).alias("metadata")), "page_id", "left")


def with_custom_rates(pages: DataFrame, wiki: Wiki, axes: list[str]) -> DataFrame:
    """Pages with ``custom_rates``: of each named axis that shows its sums, rating, votes and percent, zeros without votes."""
    shown = wiki.axes().filter("enabled and show_aggregate").filter(F.col("axis_key").isin(axes)).select("axis_key")
    every = pages.select("page_id").distinct().crossJoin(shown)
    votes = accepted_votes(wiki).filter(F.col("axis_key").isin(axes)).groupBy("page_id", "axis_key").agg(*rating_columns(F.col("rate"))).drop("positive")
    zero = F.lit(0).cast("long")
    rate = F.struct(*[F.coalesce(c, zero).alias(c) for c in ("rating", "rating_votes", "rating_percent")])
    rates = every.join(votes, ["page_id", "axis_key"], "left").groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("axis_key", rate.alias("rate")))).alias("custom_rates"))
    return pages.join(rates, "page_id", "left")


def with_children(pages: DataFrame, wiki: Wiki) -> DataFrame:
    counts = wiki.pages().filter("parent_id is not null").groupBy(F.col("parent_id").alias("page_id")).agg(F.count("*").alias("children"))
    return pages.join(counts, "page_id", "left").withColumn("children", F.coalesce("children", F.lit(0).cast("long")))


def rendered(listing: Listing, template: Template = Template(DEFAULT_BODY), number: int = 1) -> DataFrame:
    """The items of a page of the listing: page_id, index and item text. Selection and order run on narrow
    rows; what only the template needs is joined to the few rows of the page."""
    rows, wiki, names = listing.page(number), listing.wiki, template.names
    for role in ROLES:
        if any(n.startswith(f"{role}_by") for n in names):
            rows = with_users(rows, wiki, role)
    if any(n.startswith("parent_") for n in names):
        rows = with_parents(rows, wiki)
    if "children" in names:
        rows = with_children(rows, wiki)
    if names & {"rating", "rating_votes", "rating_percent"} and "rating" not in rows.columns:
        rows = with_ratings(rows, wiki)
    if names & {"tags", "_tags", "tags_linked", "_tags_linked"} and "tags" not in rows.columns:
        rows = rows.join(wiki.tag_lists(), "page_id", "left")
    if names & {"content", "preview", "excerpt", "summary", "first_paragraph", "size"}:
        rows = with_contents(rows, wiki)
    if "metadata" in names:
        rows = with_metadata(rows, wiki)
    if template.axes:
        rows = with_custom_rates(rows, wiki, template.axes)
    return rows.select("page_id", "index", template.column(listing.query.limit).alias("item"))


def assembled(items: DataFrame, prepend: str = "", append: str = "", separate: bool = True, wrapper: bool = False) -> DataFrame:
    """One text of a page's items in order; no row where there are no items.

    ``separate`` items stand one after the other; else lines before and after go with them (items of their own take
    no such lines). ``wrapper`` puts the listing's box around all.
    """
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "item"))), lambda x: x["item"]), "\n")
    lines = [F.lit(""), F.lit("")] if separate else [F.lit(f"{prepend}\n" if prepend else ""), F.lit(f"\n{append}" if append else "")]
    box = [F.lit('[[div class="list-pages-box"]]\n'), F.lit("\n[[/div]]")] if wrapper else [F.lit(""), F.lit("")]
    body = F.concat(box[0], lines[0], "body", lines[1], box[1])
    return items.agg(ordered.alias("body"), F.count("*").alias("n")).filter("n > 0").select(body.alias("body"))


_USER_VARIABLE = re.compile(r"%%([a-z_]+)%%", re.I)


def user_items(users: DataFrame, template: str) -> DataFrame:
    """A user listing's items: number, title and name of each user (user_id, name, unix_name) in a template."""
    known = {"number": F.col("user_id").cast("string"), "title": F.col("name"), "name": F.col("unix_name")}
    pieces = _USER_VARIABLE.split(template)
    parts = [F.lit(p) if n % 2 == 0 else F.coalesce(known.get(p.lower(), F.lit("")), F.lit("")) for n, p in enumerate(pieces)]
    return users.select("user_id", F.concat(*parts).alias("item"))


@dataclass(frozen=True)
class Host:
    """Limits of a host: selectors and orders that it supports, and its largest page."""

    fields: frozenset[str] = frozenset({"category", "tags", "order", "reverse", "offset", "limit"})
    orders: frozenset[str] = frozenset({"created_at", "updated_at", "title", "fullname", "rating"})
    most: int = 20

    def accepted(self, query: PageQuery) -> PageQuery:
        """The query within the host's limits; one that asks for more than the host has is refused."""
        blank = PageQuery()
        asked = {f for f in PageQuery.__dataclass_fields__ if getattr(query, f) != getattr(blank, f)}
        if asked - self.fields or parse_order(query.order)[0] not in self.orders:
            raise ValueError(f"this host doesn't support {', '.join(sorted(asked - self.fields)) or query.order}")
        limit = self.most if query.limit is None else max(0, min(query.limit, self.most))
        return replace(query, limit=limit, per_page=self.most)
