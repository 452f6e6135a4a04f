"""Text functions as Columns: graphemes, excerpts, white space, page names, escapes and number texts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import patterns

#: Limits of an excerpt's text and of its match's number.
EXCERPT_TEXT_MOST, MATCHES_MOST = 1_000_000, 10_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def grapheme_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\X"))


def grapheme_prefix(text: Column, count: int) -> Column:
    """The first ``count`` graphemes."""
    return F.regexp_extract(text, rf"(?s)^\X{{0,{count}}}", 0)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units, by which size limits are stated."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def normalized_space(text: Column) -> Column:
    """Readable text: blanks in a run and around line ends go, three or more line ends become two."""
    out = F.regexp_replace(text, r"(?U)[^\S\n]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, " ?\n ?", "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def source_space(text: Column) -> Column:
    """Markup before parsing: one kind of line end, no NUL, tabs as four blanks, lines of blanks empty,
    a trailing backslash... joined lines stay as they are; line ends at both edges go."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"(?m)^\x{00A0}+", "")
    out = F.replace(F.regexp_replace(out, r"\x00", " "), F.lit("\t"), F.lit("    "))
    out = F.regexp_replace(out, r"(?m)^[ ]+$", "")
    out = F.regexp_replace(out, " _\n", "\n")
    return F.regexp_replace(out, "^\n+|\n+$", "")


def _words(text: Column) -> Column:
    """Runs of letters and digits, joined by single hyphens."""
    return F.array_join(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), 0), "-")


def page_slug(name: Column) -> Column:
    """A page name as links have it, in lower case: category and name apart at the last colon, and each of them its runs
    of letters and digits with single hyphens between. An underscore at the front of a part marks a hidden one and stays.
    The default category isn't named. Names are expected in composed form."""

    def part(text: Column) -> Column:
        return F.concat(F.when(text.startswith("_"), "_").otherwise(""), _words(text))

    def parts(whole: Column) -> Column:
        at = F.length(whole) - F.instr(F.reverse(whole), ":")  # characters before the last colon
        cut = F.instr(whole, ":") > 0
        category = F.when(cut, part(whole.substr(F.lit(1), at))).otherwise("")
        return F.struct(category.alias("category"), part(F.when(cut, whole.substr(at + 2, F.length(whole))).otherwise(whole)).alias("rest"))

    def put_together(p: Column) -> Column:
        return F.when(p["category"].isin("", "_default"), p["rest"]).when(p["rest"] == "", p["category"]).otherwise(F.concat_ws(":", p["category"], p["rest"]))

    return let(let(F.lower(F.regexp_replace(F.trim(name), "^/", "")), parts), put_together)


def lookup_name(name: Column) -> Column:
    """A page name as a lookup has it: lower case, blanks and slashes as hyphens."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s/]+", "-")


def url_component(text: Column) -> Column:
    """Percent encoding of all but letters, digits and ``-._~``."""
    out = F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    return F.replace(out, F.lit("%7E"), F.lit("~"))


def escape_html(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def _replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), pairs, text)


#: What stands for characters inside a script's string (fixed values); the backslash comes first.
JS_ESCAPES = (("\\", "\\\\"), ("'", "\\x27"), ('"', "\\x22"), ("<", "\\x3c"), (">", "\\x3e"), ("&", "\\x26"), ("\n", "\\n"), ("\r", "\\r"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029"))


def escape_text(text: Column) -> Column:
    """Text between elements: quotes can stay there."""
    return _replaced(text, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")))


def escape_script(text: Column) -> Column:
    """Text inside a quoted string of a script that stands in a page."""
    return _replaced(text, JS_ESCAPES)


def escape_style(css: Column) -> Column:
    """A style sheet that can't end its element."""
    return F.regexp_replace(css, "(?i)</style", r"<\\/style")


def literal_markup(text: Column) -> Column:
    """Text that markup can't act in: every character as a numeric entity, inside ``@<...>@``."""
    coded = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), 0), lambda c: F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))), "")
    return F.when(text == "", "").otherwise(F.concat(F.lit("@<"), coded, F.lit(">@")))


def first_paragraph(readable: Column) -> Column:
    """The first of a readable text's paragraphs, which blank lines part, that isn't empty."""
    parts = F.transform(F.split(readable, r"\n[ \t]*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.coalesce(F.get(F.filter(parts, lambda p: p != ""), F.lit(0)), F.lit(""))


def section(text: Column, number: int) -> Column:
    """The n-th part of a text cut at lines of four or more ``=``, trimmed; empty where there is none."""
    return F.regexp_replace(F.coalesce(F.get(F.split(text, r"(?md)^={4,}$"), F.lit(number - 1)), F.lit("")), r"^\s+|\s+$", "")


def excerpt(text: Column, pattern: str, flags: str = "", group: int | str = 0, match: int = 1, most: int = 200) -> Column:
    """The first ``most`` graphemes of the ``match``-th match of a pattern, or of its group by number or name.

    Patterns of another dialect, ones that could take exponential time, unknown flags and groups, and numbers out of range give an
    empty string; so does a text over the limit, or one whose matching could take more steps than the budget.
    """
    try:
        found = patterns.compiled(pattern, flags)
    except patterns.Refused:
        return F.lit("")
    number = found.group(group)
    if number is None or not 0 < match <= MATCHES_MOST or most <= 0:
        return F.lit("")
    # The first match needs no look for others.
    part = F.regexp_extract(text, found.source, number) if match == 1 else F.coalesce(F.get(F.regexp_extract_all(text, F.lit(found.source), number), F.lit(match - 1)), F.lit(""))
    # A character has two units at most, so those of short texts needn't be counted.
    fine = (F.length(text) * 2 <= EXCERPT_TEXT_MOST) | (utf16_length(text) <= EXCERPT_TEXT_MOST)
    if found.loops:
        fine = fine & found.affordable(text)
    return grapheme_prefix(F.when(fine, part).otherwise(""), most)


def truth(text: Column) -> Column:
    """Whether a text counts as true: not empty, 0, false or null, in any case."""
    return ~F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")).isin("false", "null", "", "0")


def number_text(x: Column) -> Column:
    """A double as a script prints it: its shortest decimal, in plain form from 1e-6 up to under 1e21, else with an exponent.

    The value is bound once: a tree that names it in every branch makes code too large to be compiled. Whole numbers under 2^53 and short
    decimals in the range that a cast shows plainly are printed as they are, so only the rest is laid out anew.
    """

    def printed(x: Column) -> Column:
        whole = (F.abs(x) < float(1 << 53)) & (x == F.rint(x))
        plain = (F.abs(x) >= 1e-3) & (F.abs(x) < 1e7)
        short = let(x.cast("string"), lambda shown: F.when(plain & (F.length(shown) <= 16), shown).otherwise(_laid_out(x)))
        # A null would be formatted as a text, which is no number: an exception for each row.
        return F.when(whole, x.cast("bigint").cast("string")).when(x.isNotNull(), short)

    return let(x, printed)


def _laid_out(x: Column) -> Column:
    size = F.abs(x)

    def shortest(printed: Column) -> Column:
        # A decimal of at most fifteen digits is the shortest of its number, but for subnormal ones. Else fifteen digits are the shortest form
        # wherever they read back as the same number; so are sixteen after them, and seventeen always do.
        tried = [let(F.format_string(f"%.{n}e", size), lambda shown: F.when(shown.try_cast("double") == size, shown)) for n in (14, 15, 16)]
        return F.coalesce(F.when((F.length(printed) <= 16) & (size >= 1e-300), printed), *tried, printed)

    smallest = F.when(size == 5e-324, "5e-324").when(size == 1e-323, "1e-323")  # fewer digits than other printers give

    def laid_out(shown: Column) -> Column:
        """The number is 0.digits times ten to the power of ``point``."""
        parts = F.split(shown, "e")
        whole, fraction = F.substring_index(parts[0], ".", 1), F.when(parts[0].contains("."), F.substring_index(parts[0], ".", -1)).otherwise("")
        every = F.concat(whole, fraction)
        point = F.length(whole) + F.coalesce(F.get(parts, F.lit(1)).cast("int"), F.lit(0)) - F.length(F.regexp_extract(every, "^0*", 0))
        return F.struct(F.regexp_replace(every, "^0+|0+$", "").alias("digits"), point.alias("point"))

    def printed(number: Column) -> Column:
        digits, point, n = number["digits"], number["point"], F.length(number["digits"])
        power = F.concat(F.when(point > 0, "+").otherwise("-"), F.abs(point - 1).cast("string"))
        long = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), digits.substr(F.lit(2), n))).otherwise(""), F.lit("e"), power)
        return (
            F.when((point >= n) & (point <= 21), F.rpad(digits, point, "0"))
            .when((point > 0) & (point <= 21), F.concat(digits.substr(F.lit(1), point), F.lit("."), digits.substr(point + 1, n)))
            .when((point > -6) & (point <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .otherwise(long)
        )

    text = F.concat(F.when(x < 0, "-").otherwise(""), let(let(F.coalesce(smallest, let(F.lower(size.cast("string")), shortest)), laid_out), printed))
    return F.when(F.isnan(x), "NaN").when(size == float("inf"), F.when(x < 0, "-Infinity").otherwise("Infinity")).when(x == 0, "0").otherwise(text)


def email_address() -> str:
    """Pattern of an address in running text."""
    return r"[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"


def dangerous_url(url: Column) -> Column:
    """Whether a URL would run script: by scheme, after control characters and white space are gone."""
    return F.regexp_replace(url, r"[\x00-\x20\x7F]", "").rlike("(?i)^(?:javascript|vbscript|data):")


def link_kind(target: Column) -> Column:
    """page, direct (a URL or a rooted path), anchor (#name) or interwiki (site:page with a known prefix)."""
    return (
        F.when(target.startswith("#"), "anchor")
        .when(target.rlike("^(?:https?|ftp|gopher|news|mailto|mms):") | target.startswith("/"), "direct")
        .when(target.rlike("^!?(?:wikipedia|wp|google|dictionary|metawiki)(?:\\.[a-z]+)?:"), "interwiki")
        .otherwise("page")
    )


def safe_local_path(path: Column) -> Column:
    """A local path whose parts can each stand in a URL: none empty, dotted, ending in a blank, or holding a percent sign,
    a control character or one of ``\\ ? #``; a leading slash doesn't count. Null where a part isn't safe."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    fine = F.forall(parts, lambda p: p.rlike(r"^[^\x00-\x1F\x7F\\\\/?#%]*[^\x00-\x20\x7F\\\\/?#%]$") & ~p.isin(".", ".."))
    return F.when(fine, F.array_join(parts, "/"))


#: What an image's source looks like, and which groups are its site, page and file; the first form that fits counts.
IMAGE_FORMS = (
    ("(?s)^((?:https?://|/).*)$", "url", (0, 0, 1)),
    ("(?s)^([^:/]+):(.*)/([^/]*)$", "file3", (1, 2, 3)),
    ("(?s)^([^/]*)/(.*)/([^/]*)$", "file3", (1, 2, 3)),
    ("(?s)^([^/]+)/([^/]*)$", "file2", (0, 1, 2)),
    ("(?s)^(.*)$", "file1", (0, 0, 1)),
)


def image_source(source: Column) -> Column:
    """Struct (kind, site, page, file) of an image's source: ``url``, or a file of the page (file1), of another page
    (file2) or of another site (file3, ``site:page/file`` or ``site/page/file``)."""
    found = F.lit(None)
    for form, kind, groups in reversed(IMAGE_FORMS):
        taken = [F.regexp_extract(source, form, n) if n else F.lit(None).cast("string") for n in groups]
        fields = F.struct(F.lit(kind).alias("kind"), *[v.alias(k) for k, v in zip(("site", "page", "file"), taken)])
        found = F.when(source.rlike(form), fields).otherwise(found)
    return found


def image_url(source: Column, page: Column) -> Column:
    """Where an image is read from: its URL, or a safe path below ``/local--files/``; null where there is none."""
    found = image_source(source)
    url = source.rlike(r"^(?://|[A-Za-z][A-Za-z0-9+.-]*://)") & ~source.rlike(r"[\x00-\x1F\x7F\\\\]|^\s|\s$")
    local = F.when(found["kind"] == "url", F.when(source.rlike("^/(?!/)") & ~source.rlike(r"[\x00-\x1F\x7F\\\\]|\s$"), source)).when(found["kind"] == "file1", F.concat_ws("/", page, found["file"]))
    local = F.coalesce(local, F.when(found["kind"] != "url", F.concat_ws("/", found["site"], found["page"], found["file"])))
    # A file's own parts can't hold slashes, so one path has as many parts as it was put together from.
    return F.when((found["kind"] == "url") & url, source).otherwise(F.concat(F.lit("/local--files/"), safe_local_path(local)))


#: What the target of a page link looks like, and what is made of its name; the first form that fits counts.
ROUTES: tuple[tuple[str, Callable[[Column], Column]], ...] = (
    ("(?s)^.*?#/", F.lower),
    ("(?s)^/", lambda name: F.regexp_replace(F.lower(name), r"\s+", "-")),
    ("", page_slug),
)


def page_link(page: Column, site: Column, domains: dict[str, str] | None = None) -> Column:
    """Link of ``page`` (its anchor in lower case) on this site, or on another by its domain: a known one, or a
    site's name that is a domain itself; else the site's name is part of the path. A target without a protocol stays as it is."""
    name = F.regexp_replace(page, "(?s)/?#.*$", "")
    anchor = F.lower(F.regexp_extract(page, "(?s)#.*$", 0))
    route = reduce(lambda rest, form: F.when(page.rlike(form[0]), form[1](name)).otherwise(rest), reversed(ROUTES), F.lit(None).cast("string"))
    path = F.concat(F.lit("/"), F.regexp_replace(route, "^/", ""), anchor)
    hosts = F.create_map(*[F.lit(x) for pair in (domains or {"": ""}).items() for x in pair])
    host = F.coalesce(F.nullif(F.try_element_at(hosts, site), F.lit("")), F.when(site.contains("."), site))
    before = F.coalesce(F.concat(F.lit("https://"), F.regexp_replace(host, "(?i)^https?://|/+$", "")), F.concat(F.lit("/"), page_slug(site)))
    own = F.coalesce(site, F.lit("")) == ""
    return F.when(page.startswith("//"), F.lower(page)).when(own, path).otherwise(F.concat(before, path))


#: What ids of embedded providers look like (fixed values).
PROVIDER_IDS = {
    "video": "[a-zA-Z0-9_-]+",
    "github-user": "[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,37}[a-zA-Z0-9])?",
    "gist": "[a-f0-9]+",
    "gitlab-snippet": "[0-9]+",
}


def provider_id_fits(text: Column, provider: str) -> Column:
    """Whether a text can be an id of a provider."""
    return text.rlike(rf"\A(?:{PROVIDER_IDS[provider]})\z")


def stable_hex(text: Column, digits: int) -> Column:
    """A 32-bit FNV-1a hash of a text's UTF-16 units, once for every eight hex digits with the round in its start value."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), 0)
    word = (1 << 32) - 1

    def step(h: Column, unit: Column) -> Column:
        return (h.bitwiseXOR(F.conv(unit, 16, 10).cast("long")) * 0x01000193).bitwiseAND(word)

    rounds = [F.lower(F.lpad(F.hex(F.aggregate(units, F.lit(0x811C9DC5 ^ n).cast("long"), step)), 8, "0")) for n in range(-(-digits // 8))]
    return F.substring(F.concat(*rounds), 1, digits)
