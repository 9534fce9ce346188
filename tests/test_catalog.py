import pytest
from pyspark.sql import functions as F

from quillspark.functions import catalog as C
from quillspark.plans import catalogue
from tests.compare import compare


@pytest.mark.parametrize("name", ["rights_grounds", "citation_depth", "manifest_claims", "attributions", "title_parts", "multi_part_works", "rendered_segments"])
def test_queries_equal_sql(spark, name):
    compare(spark, "/root/testdata/sf0.001", catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_names_and_titles(spark):
    row = spark.range(1).select(
        C.attribution(F.lit("Doe, J. (Jane), 43 BCE-17; Roe [Translator]; ;Poe [dubious author]")).alias("a"), C.lifespan(F.lit("Doe, 43 BCE-17")).alias("l"),
        C.lifespan(F.lit("Doe")).alias("none"), C.display_name(F.lit("Doe, J. (Jane), 43 BCE-17")).alias("shown"), C.display_name(F.lit("Homer")).alias("plain"),
        C.base_title(F.lit("The Sea, Vol. 3 (of 9)")).alias("base"), C.volume_of(F.lit("The Sea, Vol. 3")).alias("volume"), C.title_key(F.lit("The Séa, Vol. 3")).alias("key"),
        C.is_numeral(F.lit("xiv")).alias("numeral"), C.is_numeral(F.lit("")).alias("empty"), C.years(F.lit("in 1850 and 12345, 1901")).alias("years"),
        C.duration_shown(F.lit(61_000)).alias("long"), C.duration_shown(F.lit(0)).alias("unmeasured"), C.year_shown(F.lit(-44)).alias("bce"),
    ).first()
    assert row["a"]["authors"] == ["Doe, J. (Jane), 43 BCE-17", "Poe"] and row["a"]["translator"] == "Roe" and row["a"]["dubious"]
    assert tuple(row["l"]) == (-43, 17) and tuple(row["none"]) == (None, None) and (row["shown"], row["plain"]) == ("Jane Doe", "Homer")
    assert (row["base"], row["volume"], row["key"]) == ("The Sea", 3, "sea") and row["numeral"] and not row["empty"] and row["years"] == [1850, 1901]
    assert (row["long"], row["unmeasured"], row["bce"]) == ("1 min 1 s", None, "44 BCE")


def test_names_as_they_are_shown(spark):
    told = {
        "Doe, J. (Jane), 43 BCE-17": "Jane Doe", "Homer": "Homer", "Acton, John Emerich Edward Dalberg Acton, Baron, 1834-1902": "Lord Acton", "Plato, 428-348": "Plato", "Eusebius, Bishop of Caesarea": "Bishop of Caesarea Eusebius",
        "Lee, Vernon, the Younger, Sir": "Vernon Lee, the Younger", "Mill,  John   Stuart ": "John Stuart Mill", "": "", " , ": " , ",
    }
    rows = spark.createDataFrame(list(told.items()), "x string, want string").select("want", C.display_name(F.col("x"), {"Acton, John Emerich": "Lord Acton", "Acton": "never"}).alias("found")).collect()
    assert [r["found"] for r in rows] == [r["want"] for r in rows]
    one = spark.range(1).select(C.overridden(F.lit("a"), F.lit("k"), {"k": "b"}).alias("x"), C.overridden(F.lit("a"), F.lit("z"), {"k": "b"}).alias("y"), C.overridden(F.lit("a"), F.lit("z"), {}).alias("z")).first()
    assert tuple(one) == ("b", "a", "a")


def test_costs_as_they_are_shown(spark):
    told = {0.0: ("$0", "0 kr"), -1.0: ("$0", "0 kr"), 0.00001: ("<$0.0001", "<0,001 kr"), 0.01234: ("$0.0123", "0,012 kr"), 0.5: ("$0.5000", "0,50 kr"), 1234.5: ("$1,234.5000", "1\u00a0234,50 kr")}
    rows = spark.createDataFrame([(x,) for x in told], "x double").select("x", C.usd_shown(F.col("x")).alias("usd"), C.sek_shown(F.col("x"), "sv").alias("sek")).collect()
    assert {r["x"]: (r["usd"], r["sek"]) for r in rows} == told


def test_candidates_are_met_by_key(spark):
    from quillspark.operators.builder import candidates

    catalog = spark.createDataFrame([(1, "Anna; Annabel", "b"), (1, "Anna", "a"), (2, "Bo; Someone [Translator]", "c"), (3, "Anna [Dubious author]", "d"), (4, "Anna", None), (4, "Anna", "e")], "id long, authors string, title string")
    wanted = spark.createDataFrame([(1, 1, "Ann", 4), (1, 1, "Ann", 4), (1, 2, "Ann", 3), (2, 1, "Annab", 4), (2, 2, "", 4), (2, 3, None, 4), (2, 4, "Zo", 4)], "grp long, author_no long, key string, cap int")
    found = candidates(catalog, wanted)
    assert sorted(tuple(r) for r in found.collect()) == [
        (1, 1, "Ann", 4, 1, "a"), (1, 1, "Ann", 4, 4, "e"), (1, 2, "Ann", 3, 1, "a"), (1, 2, "Ann", 3, 4, "e"), (2, 1, "Annab", 4, 1, "b"),
    ]
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
