"""Graphs, depth lists, per-row expressions, raw regions, bounded patterns and number texts beside plain versions."""

import random
import time

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import markup, patterns, regions, text
from scriptorium.functions.expressions import ExpressionError, directives, expression
from scriptorium.functions.row_expressions import with_values
from scriptorium.operators import aggregates, graphs, trees
from scriptorium.operators.batch import batch_listings
from scriptorium.operators.listing import Current, Listing, PageQuery, Template, excerpt_options, parse_order
from scriptorium.sources.wiki import Wiki


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def values(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{n}") for n, c in enumerate(columns)]).first())


NUMBERS = {
    12345678.9: "12345678.9", 123456789.125: "123456789.125", 1.2345678901234567e19: "12345678901234567000", 5e-324: "5e-324", 1e-323: "1e-323", 0.1: "0.1", 1e21: "1e+21", 1e20: "100000000000000000000",
    1e-6: "0.000001", 1e-7: "1e-7", 1.5e-7: "1.5e-7", -0.0: "0", 100.0: "100", -2.5: "-2.5", 8.41e21: "8.41e+21", 2e23: "2e+23", 1e23: "1e+23", 0.30000000000000004: "0.30000000000000004", 1.7976931348623157e308: "1.7976931348623157e+308",
    float("nan"): "NaN", float("-inf"): "-Infinity", 9007199254740993.0: "9007199254740992", 4.35: "4.35", 123456.7: "123456.7",
}


def test_number_texts(spark):
    rows = spark.createDataFrame([(float(x), shown) for x, shown in NUMBERS.items()], "x double, shown string")
    assert [tuple(r) for r in rows.select("x", text.number_text(F.col("x")).alias("mine"), "shown").filter("mine is distinct from shown").collect()] == []


def test_orders():
    for order, want in {
        "title foo": ("title", True), "title asc,x": ("title", True), "title asc x": ("title", False), "titleAsc": ("title", False), "ratingDESC": ("rating", True), "": ("created_at", True),
        "name asc": ("created_at", True), "metadata{a b} asc": ("metadata.a b", False), "metadata{k}": ("metadata.k", True), "Metadata{k} DESC": ("metadata.k", True), "metadata{k}asc": ("created_at", True), "votes  asc": ("rating_votes", False),
    }.items():
        assert parse_order(order) == want, order


def test_excerpt_options():
    assert excerpt_options(r"""pattern="a\"b\\d" max='5'""") == {"pattern": r"a\"b\\d".replace('\\"', '"'), "max": "5"}
    assert excerpt_options("pattern='x' group=\"name\" match = '2'") == {"pattern": "x", "group": "name", "match": "2"}
    for bad in ("pattern=x", "pattern='a' pattern='b'", "other='a' pattern='x'", "pattern='a'max='1'", "max='3'", "pattern='a", ""):
        assert excerpt_options(bad) is None, bad
    assert Template('a %%excerpt{pattern="x}%%y{2}"}%% b').pieces == ["a ", ("excerpt", 'pattern="x}%%y{2}"', None, None), " b"]


HOSTILE = ["(.*a){12}b", "(a+)+b", "(a*)*b", "(a|a)*b", "(a|ab|b)*c", r"(?:\w+\s*)*x", "(a?){30}a{30}", "a?" * 30 + "a" * 30, "a?a" * 30, r"^(([a-z])+.)+[A-Z]([a-z])+$"]


def test_hostile_patterns_are_empty_at_once(spark):
    for p in HOSTILE:
        with pytest.raises(patterns.Refused):
            patterns.compiled(p)
    texts = spark.createDataFrame([("a" * 28 + " " + "a" * 5000, "x" * 90_000, "ab " * 30_000 + "yes")], "hostile string, run string, words string")
    found = texts.select(*[text.excerpt(F.col("hostile"), p).alias(f"p{n}") for n, p in enumerate(HOSTILE)], text.excerpt(F.col("run"), "x*x*y").alias("run"), text.excerpt(F.col("words"), r"\w+\s+(y\w+)", group=1).alias("words"))
    began = time.time()
    assert tuple(found.first()) == ("",) * (len(HOSTILE) + 1) + ("yes",)
    assert time.time() - began < 30


def test_patterns_of_other_dialects(spark):
    for bad in ("a(", "a++", "(?=a)b", r"(a)\1", "(?>a)", r"\Qa\E", "[a", "a{2}{3}", "*a", "(?<n>a)(?<n>b)", "a{1001}", r"\K"):
        with pytest.raises(patterns.Refused):
            patterns.compiled(bad)
    for bad in ("ii", "g", "x"):
        with pytest.raises(patterns.Refused):
            patterns.compiled("a", bad)


@pytest.mark.parametrize(
    "pattern, flags, group, match, most, shown",
    [
        (r"[*+]+b", "", 0, 1, 200, "+*b"), (r"(?P<k>\w+): (?<v>[a-z]+)", "", "v", 2, 200, "two"), (r"(?P<k>\w+): (?<v>[a-z]+)", "", "none", 1, 200, ""), ("K[0-9]", "", 0, 3, 200, ""), ("k1", "i", 0, 1, 200, "K1"),
        ("^x", "", 0, 1, 200, ""), ("^x.$", "m", 0, 1, 200, "xé"), ("one.+$", "s", 0, 1, 5, "one +"), (r"[[:upper:]]\d", "", 0, 1, 200, "K1"), ("a{,2}", "", 0, 1, 200, "a{,2}"), (r"\x{e9}", "", 0, 1, 200, "é"), ("[a-z&&[b]]+]", "", 0, 1, 200, ""), ("x", "", 0, 0, 200, ""), ("x", "", 0, 1, 0, ""), (r"\bone\b", "", 3, 1, 9, ""),
    ],
)
def test_excerpts(spark, pattern, flags, group, match, most, shown):
    assert values(spark, text.excerpt(F.lit("K1: one +*b a{,2}\nxé\nK2: two"), pattern, flags, group, match, most)) == (shown,)


def test_first_paragraph_is_no_heading(spark):
    shown = [text.first_paragraph(markup.readable(markup.without_headings(F.lit(t)))) for t in ("+ Title\n\nBody", "+ Title\nBody\nmore\n++* Next\nx", "+Title", "++ a\n+ b", "")]
    assert values(spark, *shown) == ("Body", "Body\nmore", "+Title", "", "")


def test_sections_and_slugs(spark):
    assert values(spark, text.section(F.lit("a\n==== \nb\n====\nc"), 1), text.section(F.lit("a\n==== \nb\n====\nc"), 2), text.page_slug(F.lit("_"))) == ("a\n==== \nb", "c", "_")


def test_an_attribute_given_twice(spark):
    rows = spark.createDataFrame([(1, '[[module X a="1" A="2" b="3"]]')], "page_id long, source_text string")
    assert markup.modules(rows).first()["arguments"] == {"a": "2", "b": "3"}


def test_substitution_stops_before_it_doubles(spark):
    """Forty chained assignments would make 2^40 characters."""
    given = " | ".join([f"a{n} = {{$a{n + 1}}}{{$a{n + 1}}}" for n in range(40)])
    rows = spark.createDataFrame([(1, "one", f"[[include part | {given}]]"), (2, "two", "[[include part | a0 = x]]")], "page_id long, fullname string, source_text string")
    library = spark.createDataFrame([("part", "{$a0}")], "page string, content string")
    out = {r["page_id"]: r for r in aggregates.expand_includes(rows, library).collect()}
    assert out[1]["too_long"] and out[1]["source_text"].startswith("[[include part") and out[2]["source_text"] == "x"


def test_updates_write_nulls_and_no_row_twice(spark):
    table = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3)], "k long, v string, w long")
    changes = spark.createDataFrame([(1, None), (2, "x"), (2, "y"), (9, "z")], "k long, v string")
    assert sorted(map(tuple, aggregates.updated(table, changes, "k").collect())) == [(1, None, 1), (2, "y", 2), (3, None, 3)]


def test_raw_regions(spark):
    for source in ("", "plain", "@@a@@@@b@@", "@@ open\n@@ [[code]] x", "[!-- @@ --] @@[!--@@ --]", "[[html]]a[[/html]][[html]]b", "5 @@x@@ 0", "@<a>@@@b@@", "[[CODE type=\"x\"]]@@[[/Code]]@@y@@"):
        whole, changed = values(spark, F.array_join(F.transform(regions.segments(F.lit(source)), lambda s: s["text"]), ""), regions.outside(F.lit(source), lambda t: t))
        assert (whole, changed) == (source, source)
        masked, units = regions.masked_text(source)
        assert regions.restored_text(masked, units) == source
    upper = values(spark, regions.outside(F.lit("a @@b@@ c [[code]]d[[/code]] [!-- @@ --] e @@"), F.upper))
    assert upper == ("A @@b@@ C [[code]]d[[/code]] [!-- @@ --] E @@",)
    assert values(spark, directives("@@[[#expr 1+1]]@@ [[#expr 1+1]] [[code]][[#expr 1]]")) == ("@@[[#expr 1+1]]@@ 2 [[code]][[#expr 1]]",)


def test_row_expressions(spark):
    """Made expressions, right and wrong ones, beside the same texts compiled at plan time."""
    rng = random.Random(3)

    def made(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(["a", "b", "2", "0.5", ".25", "3.", "true", "FALSE", "0", "c"])
        kind = rng.random()
        if kind < 0.55:
            return f"{made(depth - 1)} {rng.choice(['+', '-', '*', '/', '%', '^', '<', '>=', '=', '==', '<>', '!=', 'and', 'or'])} {made(depth - 1)}"
        if kind < 0.7:
            return f"({made(depth - 1)})"
        if kind < 0.85:
            return f"{rng.choice(['-', '+', '!', 'not '])}{made(depth - 1)}"
        return f"{rng.choice(['abs', 'min', 'MAX', 'floor', 'round', 'sqrt', 'pow', 'ln', 'nofunction'])}({', '.join(made(depth - 1) for _ in range(rng.choice([1, 1, 2, 3])))})"

    sources = {made(rng.randrange(1, 5)) for _ in range(300)} | {"", "(", ")", "a b", "1 2", "f()", "min()", "min(1,)", "1 + not 2", "a < b < 2", "not a = b", "-2 ^ 2", "2 ^ 3 ^ 2", "2 ^ -1", "1 / 0 > 2", "1 / (1 / 0)", "0 / 0 = 0 / 0", "a @ b", "x" * 300, "a,b", "(a", "a)", "abs(1, 2)", "pow(2)", "ln(0) < 1", "c", "c > 1", "!c"}
    columns = {"a": F.col("a"), "b": F.col("b"), "c": F.col("c")}
    rows = spark.createDataFrame([(s, 3.0, -1.5, None) for s in sorted(sources)] + [(None, 1.0, 1.0, 1.0)], "source string, a double, b double, c double")
    mine = {r["source"]: r["value"] for r in with_values(rows, "source", columns).collect()}
    assert mine.pop(None) is None
    plain, one = {}, spark.createDataFrame([(3.0, -1.5, None)], "a double, b double, c double")
    for s in sorted(sources):
        try:
            plain[s] = expression(s, **columns)
        except ExpressionError:
            plain[s] = F.lit(None).cast("double")
    found = one.select(*[c.alias(f"x{n}") for n, c in enumerate(plain.values())]).first()
    wrong = {s: (mine[s], found[n]) for n, s in enumerate(plain) if mine[s] != found[n] and not (mine[s] is not None and found[n] is not None and abs(mine[s] - found[n]) < 1e-9)}
    assert not wrong


def test_depth_lists(spark):
    rng = random.Random(5)
    rows = [(p, n, rng.choice([0, 0, 1, 1, 2, 3, 5, -1]), rng.choice("ab")) for p in range(40) for n in range(rng.randrange(1, 25))]
    mine = {(r["p"], r["n"]): (r["list"], r["above"], r["parent"]) for r in trees.depth_tree(spark.createDataFrame(rows, "p long, n long, depth int, kind string"), "p", "n", "depth", "kind").collect()}
    for p in range(40):
        stack, lists, before = [], 0, []
        for _, n, depth, kind in (r for r in rows if r[0] == p):
            depth = max(depth, 0)
            del stack[depth + 1 :]
            if len(stack) > depth and stack[depth][0] != kind:
                stack[depth] = (kind, lists, stack[depth][2])
                lists += 1
            while len(stack) <= depth:
                stack.append((kind, lists, stack[-1][1] if stack else None))
                lists += 1
            above = [m for m, d in before if d < depth]
            assert mine[p, n] == (stack[depth][1], stack[depth][2], above[-1] if above else None), (p, n)
            before.append((n, depth))


def test_forest(spark):
    rng = random.Random(7)
    for n, far in ((1, 1), (60, 60), (200, 3), (90, 1)):
        up = {k: rng.choice([None, -5, *range(max(0, k - far), min(n, k + 2))]) if far > 1 else k - 1 if k else None for k in range(n)}
        rows = spark.createDataFrame([(k, p, f"n{k}") for k, p in up.items()], "page_id long, parent_id long, fullname string")
        found = {r["page_id"]: r for r in graphs.page_forest(rows).collect()}
        assert len(found) == n
        for k in range(n):
            way, at = [k], up[k]
            while at in up and at not in way:
                way.append(at)
                at = up[at]
            if at in way:
                assert (found[k]["root_id"], found[k]["depth"], found[k]["path"]) == (None, None, None) and found[k]["cyclic"] == (at == k)
            else:
                assert tuple(found[k])[1:] == (way[-1], len(way) - 1, "/".join(f"n{x}" for x in reversed(way)), False)


def test_completeness(spark):
    rng = random.Random(9)
    pages = [(f"P{k}", "".join(f"\n[[include p{t}]]" for t in rng.sample(range(45), rng.choice([0, 0, 1, 2]))) + ("\n[[module TagCloud]]" if k % 13 == 0 else "")) for k in range(40)]
    pages += [("deep-0", None)] + [(f"deep-{k}", f"[[include deep-{k - 1}]]") for k in range(1, 14)]
    out = {r["page"]: (r["complete"], r["reason"]) for r in graphs.completeness(spark.createDataFrame(pages, "page string, content string")).collect()}
    content = {p.lower(): c or "" for p, c in pages}

    def height(page, seen):
        targets = [line[10:-2] for line in content[page].split("\n") if line.startswith("[[include")]
        if page in seen or "[[module" in content[page] or any(t not in content for t in targets):
            return 99
        return 1 + max((height(t, seen | {page}) for t in targets), default=-1)

    for page, _ in pages:
        assert out[page][0] == (height(page.lower(), frozenset()) <= 10), page
        assert (out[page][1] is None) == out[page][0]
    assert out["deep-10"] == (True, None) and out["deep-11"] == (False, "include")


def test_refreshed_equals_all_anew(spark):
    """After edits of any kind; and only what leads to them is expanded again."""
    rng = random.Random(11)
    line = lambda t: f"\n[[include {t} | who = x{t}]]"
    texts = [(k, f"t{k}", f"text {k}" + "".join(line(f"p{rng.randrange(12)}") for _ in range(rng.choice([0, 1, 2])))) for k in range(60)]
    texts += [(60, "t60", "[[include made | page = p1]]"), (61, "t61", "[[include p11]]")]
    library = {f"p{k}": f"part {k} {{$who}}" + (line(f"p{k + rng.choice([1, 2, 5])}") if k % 3 else "") for k in range(11)} | {"made": "[[include {$page}]]"}
    table = lambda rows: spark.createDataFrame(rows, "page_id long, fullname string, source_text string")
    parts = lambda rows: spark.createDataFrame(list(rows.items()), "page string, content string")
    stored = aggregates.expand_includes(table(texts), parts(library), trace=True).checkpoint()
    edited = library | {"p1": "edited [[x]]", "p11": "new"}
    del edited["p5"]
    after = [t for t in texts if t[0] != 7] + [(99, "t99", "[[include p0]]")]
    after[3] = (after[3][0], after[3][1], "another text")
    out = graphs.refreshed(stored, table(after), parts(edited), spark.createDataFrame([("P1",), ("p11",), ("p5",)], "page string"), spark.createDataFrame([(after[3][0],)], "page_id long"))
    rows = {r["page_id"]: r for r in out.collect()}
    anew = {r["page_id"]: r for r in aggregates.expand_includes(table(after), parts(edited), trace=True).collect()}
    assert rows.keys() == anew.keys()
    for k, r in rows.items():
        assert tuple(r)[:-1] == tuple(anew[k]), k

    def leads(source, seen=()):
        found = {w for w in ("p1", "p5", "p11") if f"[[include {w} " in source + " " or f"[[include {w}]]" in source}
        return bool(found) or any(leads(c, (*seen, p)) for p, c in edited.items() if p not in seen and (f"[[include {p} " in source or f"[[include {p}]]" in source))

    renewed = {k for k, r in rows.items() if r["renewed"]}
    assert renewed == {k for k, _, s in after if leads(s)} | {60, 99, after[3][0]} and len(renewed) < len(rows)


def test_batch_equals_listings_one_by_one(spark, folder):
    wiki = Wiki(spark, folder)
    asked = [("+status-f -_bulk", "*", "title asc", 2, 7), ("flag-a flag-n", "o", "size desc", 0, 250), ("-", "*", "fullname desc", 0, 5), ("=", ". p", "updated_at asc", 1, 9), ("==", "*", None, 0, 20), (None, "-p", "comments asc", 3, 4), ("+none", "*", "title", 0, 5), (None, None, "revisions foo", 0, 3)]
    page, tags = wiki.pages().filter("page_id = 9").first(), wiki.tag_lists().filter("page_id = 9").first()
    rows = [(n, t, c, o, skip, take, 9, page["category"], tags["tags"] if tags else []) for n, (t, c, o, skip, take) in enumerate(asked)]
    queries = spark.createDataFrame(rows, "query_id int, tags string, category string, `order` string, offset int, limit int, own_id long, own_category string, own_tags array<string>")
    found = batch_listings(wiki, queries).collect()
    for n, t, c, o, skip, take, *_ in rows:
        one = Listing(wiki, PageQuery(tags=t, category=c, order=o or "created_at desc", offset=skip, limit=take, per_page=250), Current(page_id=9, category=page["category"], tags=tuple(tags["tags"] if tags else ())))
        assert sorted((r["index"], r["page_id"], r["total"]) for r in found if r["query_id"] == n) == sorted((r["index"], r["page_id"], r["total"]) for r in one.page().select("index", "page_id", "total").collect()), n


def test_batch_meets_no_product_of_pages_and_queries(spark, folder):
    wiki = Wiki(spark, folder)
    queries = wiki.users().select(F.col("user_id").alias("query_id"), F.lit("+flag-r").alias("tags"), F.col("user_id").alias("owner_id"), F.lit("*").alias("category"))
    plan = batch_listings(wiki, queries, materialize=lambda df: df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan
