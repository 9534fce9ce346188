"""Landing with a fetcher that is busy, broken and rude; searches that are stopped; streams that are late."""

import time
from email.utils import format_datetime
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quillspark.functions import clean as C
from quillspark.sources import landing as L
from quillspark.streaming import ingest
from quillspark.streaming.progress import Searches

QUICK = L.Manners(pause=0.01, attempts=3, first=0.01, longest=5)


def test_waits_as_asked():
    now = time.time()
    later = format_datetime(datetime.now(timezone.utc) + timedelta(seconds=30), usegmt=True)
    assert L.asked_to_wait({"Retry-After": " 7 "}, now) == 7 and 25 < L.asked_to_wait({"retry-after": later}, now) < 31
    assert L.asked_to_wait({}, now) is None and L.asked_to_wait({"Retry-After": "soon"}, now) is None


def make(log):
    """Fails, is busy or answers by address; tells each call."""

    def fetcher():
        def ask(url):
            with open(log, "a") as f:
                f.write(f"{url} {time.monotonic()}\n")
            times = sum(line.split()[0] == url for line in open(log))
            if "busy" in url:
                return L.Answer(503 if times < 3 else 200, b"late", {"Retry-After": "0"})
            if "never" in url:
                return L.Answer(429, b"", {"Retry-After": "999"})
            if "gone" in url:
                return L.Answer(404, b"no")
            if "raises" in url:
                raise OSError("no route")
            return L.Answer(200, f"text of {url}".encode())

        return ask

    return fetcher


def calls(log):
    return [line.split()[0] for line in open(log)]


def test_landing_resumes(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = [("1", "a", "https://one.org/x"), ("2", "a", "https://one.org/busy"), ("3", "b", "https://two.org/never"), ("4", "b", "https://two.org/gone"), ("5", "b", "https://three.org/raises"), ("6", "a", "nothing"), ("7", "a", None), (None, "a", "https://one.org/y"), ("1", "a", "https://one.org/x")]
    asked = spark.createDataFrame(rows, "id string, source string, url string")
    landing = L.Landing(spark, str(tmp_path / "landing"))
    landing.land(asked, make(log), QUICK)
    assert {r["id"]: bytes(r["content"]) for r in landing.landed().collect()} == {"1": b"text of https://one.org/x", "2": b"late"}
    told = {r["id"]: (r["status"], r["attempts"], r["error"]) for r in landing.failures().collect()}
    assert told == {"3": (429, 1, "status 429; asked to wait 999 s"), "4": (404, 1, "status 404"), "5": (None, 3, "OSError: no route"), "6": (None, 0, "no address"), "7": (None, 0, "no address")}
    assert calls(log).count("https://one.org/busy") == 3 and calls(log).count("https://one.org/x") == 1
    before = len(calls(log))
    landing.land(asked, make(log), QUICK)  # what has landed isn't asked for again
    assert not any("one.org" in x for x in calls(log)[before:]) and landing.table.read().count() == 7
    version = landing.table.version()
    assert landing.land(asked.where("id IN ('1', '2')"), make(log), QUICK) == version


def test_a_host_is_asked_one_thing_after_another(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = [(str(i), "a", f"https://h{i % 3}.org/{i}") for i in range(18)]
    found = L.fetched(spark.createDataFrame(rows, "id string, source string, url string").repartition(6), make(log), L.Manners(pause=0.05, attempts=1))
    assert {r["status"] for r in found.collect()} == {200}
    for k in range(3):
        at = sorted(float(line.split()[1]) for line in open(log) if f"h{k}.org" in line)
        assert len(at) == 6 and all(b - a > 0.04 for a, b in zip(at, at[1:]))


def test_chain_by_source(spark):
    rows = [("1", "pages", b"<p>One</p><p>two</p>"), ("2", "plain", "é START body END".encode("latin-1")), ("3", "plain", b"nothing free"), ("4", "new", b"x")]
    landed = spark.createDataFrame(rows, "id string, source string, content binary")
    readers = {"pages": C.html_to_text, "plain": lambda t: C.without_boilerplate(t, "START", "END")}
    found = L.works_of(landed, readers, {"plain": lambda t: F.when(t.rlike("START"), "").otherwise("rights")})
    assert sorted(tuple(r) for r in found.collect()) == [("1", "pages", "One\n\ntwo", ""), ("2", "plain", "body", ""), ("3", "plain", None, "rights"), ("4", "new", None, "no reader")]


def test_a_stopped_search_ends_its_jobs(spark):
    searches = Searches(spark)

    def slow(tell):
        tell("plan", 1)
        spark.range(0, 4, 1, 4).rdd.foreach(lambda _: time.sleep(60))
        tell("never")

    own = searches.start(slow, "one")
    events = own.events()
    assert next(events) == ("plan", 1) and searches.running() == ["one"]
    with pytest.raises(ValueError):
        searches.start(slow, "one")
    began = time.time()
    while not spark.sparkContext.statusTracker().getJobIdsForGroup("one") and time.time() - began < 20:
        time.sleep(0.1)
    time.sleep(0.5)
    assert searches.cancel("one") and list(events) == [("cancelled", None)] and time.time() - began < 30
    assert not searches.cancel("one") and not searches.running() and not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_progress_of_searches(spark):
    searches = Searches(spark)
    two = [searches.start(lambda tell, n=n: (tell("found", n), spark.range(n).count())[1]) for n in (3, 5)]
    assert [list(s.events()) for s in two] == [[("found", 3), ("done", 3)], [("found", 5), ("done", 5)]]

    def broken(tell):
        raise KeyError("x")

    assert list(searches.start(broken).events()) == [("failed", "KeyError: 'x'")]


def test_late_rows_drop_from_a_stream(spark, tmp_path):
    land, out = str(tmp_path / "land"), str(tmp_path / "out")
    schema = "ts timestamp, event_type string, value double"
    at = lambda minute: datetime(2026, 1, 1, 10) + timedelta(minutes=minute)

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(land)
        stream = spark.readStream.schema(schema).parquet(land)
        ingest.usage(stream, late="5 minutes", window="10 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-check").outputMode("append").trigger(availableNow=True).start().awaitTermination()

    run([(at(1), "a", 1.0), (at(2), "a", 2.0), (at(31), "a", 5.0)])
    run([(at(3), "a", 100.0), (at(28), "a", 7.0), (at(65), "a", 1.0)])  # the first is later than the watermark
    run([(at(120), "a", 1.0)])
    found = {r["window"]["start"].minute + 60 * (r["window"]["start"].hour - 10): (r["n"], r["cost"]) for r in spark.read.parquet(out).collect()}
    assert found[0] == (2, 3.0) and found[20] == (1, 7.0) and found[30] == (1, 5.0)
