"""Pages from a host's provider: the same listings, and only the wanted categories asked for."""

import pytest
from pyspark.sql import functions as F

from scriptorium.operators.listing import Current, Listing, PageQuery, Template, rendered
from scriptorium.sources.provider import CategoryReader, ProvidedWiki, provided_pages
from scriptorium.sources.wiki import Wiki

PROVIDER = "tests.page_folder:PageFolder"


@pytest.fixture(scope="module")
def store(spark, folder, tmp_path_factory):
    root = tmp_path_factory.mktemp("pages")
    pages = Wiki(spark, folder).pages()
    narrow = pages.drop("form_data", "form_raw", "form_label", "form_hint").withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "updated_at", "commented_at")})
    narrow.repartition(3).write.partitionBy("category").parquet(str(root / "store"))
    columns = [f for f in narrow.schema if f.name != "category"]
    (root / "store" / "schema.txt").write_text(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns) + ", category string")
    (root / "asked").mkdir()
    return root


def asked_for(store):
    found = sorted(p.name for p in (store / "asked").iterdir())
    for p in (store / "asked").iterdir():
        p.unlink()
    return found


def pages(spark, store):
    return provided_pages(spark, PROVIDER, folder=str(store / "store"), asked=str(store / "asked"))


def test_only_wanted_categories_are_asked_for(spark, folder, store):
    every = Wiki(spark, folder).pages()
    for rule, wanted in ((F.col("category") == "o", "o"), (F.col("category").isin("f", "p"), "fp"), (F.col("category") != "f", "op"), (F.lit(True), "fop"), ((F.col("category") == "o") & (F.col("size") > 1000), "o"), (F.col("category") == "none", ""), ((F.col("category") == "o") & (F.col("category") == "f"), "")):
        asked_for(store)
        mine = pages(spark, store).filter(rule)
        assert sorted(r["page_id"] for r in mine.select("page_id").collect()) == sorted(r["page_id"] for r in every.filter(rule).select("page_id").collect())
        assert asked_for(store) == sorted(f"{c}.{n}" for c in wanted for n in (0, 1))


def test_a_listing_is_the_same(spark, folder, store):
    wiki = ProvidedWiki(spark, folder, PROVIDER, (("folder", str(store / "store")), ("asked", str(store / "asked"))))
    query = PageQuery(category="o", order="title asc", per_page=40, tags="+status-f")
    template = Template("%%index%% %%fullname%% %%created_by%% %%rating%% %%total%%")
    one, other = (sorted(map(tuple, rendered(Listing(w, query, Current()), template).collect())) for w in (wiki, Wiki(spark, folder)))
    assert one and one == other and set(asked_for(store)) == {"o.0", "o.1"}


def test_conditions_on_other_columns_stay_with_spark():
    from pyspark.sql.datasource import EqualTo, IsNotNull, Not

    reader = CategoryReader({})
    given = [EqualTo(("size",), 3), EqualTo(("category",), "a"), IsNotNull(("category",)), IsNotNull(("size",)), Not(EqualTo(("category",), "b")), EqualTo(("category",), None)]
    assert list(reader.pushFilters(given)) == [given[0], given[3], given[5]] and reader.wanted == {"a"} and reader.unwanted == {"b"}
