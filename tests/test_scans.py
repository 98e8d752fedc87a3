"""Range scans, paged merges and greedy spacing against plain versions of their rules."""

import collections
import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import shocks
from tidemark.sources import paged, ranges

DAY = datetime.date(2024, 1, 1)


def day(k):
    return DAY + datetime.timedelta(k)


def refuses(seed, share):
    """A rule by mode and range, without state: tasks can follow it."""

    def fetch(query, mode, start, end):
        r = random.Random(f"{seed}{query}{mode}{start}{end}")
        if r.random() < share * (0.5 + (end - start).days / 60):
            raise ranges.Limited("slow down") if r.random() < 0.5 else ValueError("no")
        got = {start + datetime.timedelta(k): k + len(mode) for k in range((end - start).days + 1) if r.random() < 0.7}
        if r.random() < 0.3:
            got[end + datetime.timedelta(1)] = -1  # a day beyond the asked ones
        return got

    return fetch


def plain_scan(fetch, plan, query, start, end):
    counts, covered, failed = {}, {}, []

    def settle(a, b):
        span, said, modes = (b - a).days + 1, [], list(plan.modes)
        if plan.fallback and span <= plan.fallback_days:
            modes.append(plan.fallback)
        for m in modes:
            try:
                got = fetch(query, m, a, b)
                counts.update({d: (m, n) for d, n in got.items()})
                covered.update({a + datetime.timedelta(k): m for k in range(span)})
                return
            except Exception as e:
                said.append(f"{m}: attempt={plan.retries}: {e}")
        if span > plan.floor:
            mid = a + datetime.timedelta(span // 2 - 1)
            settle(a, mid)
            settle(mid + datetime.timedelta(1), b)
        else:
            failed.append((a, b, " | ".join(said)))

    while start <= end:
        stop = min(end, start + datetime.timedelta(plan.chunk_days - 1))
        settle(start, stop)
        start = stop + datetime.timedelta(1)
    return counts, covered, failed


@pytest.mark.parametrize("share", [0.0, 0.5, 5.0])
@pytest.mark.parametrize("fallback", [None, "rss"])
def test_scan_is_the_plain_recursion(spark, share, fallback):
    fetch = refuses(3, share)
    plan = ranges.ScanPlan(fallback=fallback, fallback_days=4, chunk_days=50, min_split_days=7, retries=2, cooldown=0.0, most_pause=0.0, tasks=3)
    asked = spark.createDataFrame([("a", day(0), day(119)), ("b", day(10), day(10)), ("c", day(5), day(4))], "query string, start date, end date")
    got = collections.defaultdict(list)
    for r in ranges.scan(spark, asked, fetch, plan).collect():
        got[r["query"], r["kind"]].append(r)
    for q, a, b in (("a", 0, 119), ("b", 10, 10), ("c", 5, 4)):
        counts, covered, failed = plain_scan(fetch, plan, q, day(a), day(b))
        assert {r["d"]: (r["source"], r["n"]) for r in got[q, "count"]} == counts
        assert {r["d"]: r["source"] for r in got[q, "covered"]} == covered
        assert sorted((r["d"], r["until"], r["error"]) for r in got[q, "failed"]) == sorted(failed)
    if share == 5.0:
        assert all((r["until"] - r["d"]).days < plan.floor for r in got["a", "failed"])


def test_later_ranges_win_and_status(spark):
    fetch = lambda q, m, a, b: {a: 1, b: 2} if q == "x" else 1 / 0
    plan = ranges.ScanPlan(retries=1, min_split_days=100)
    asked = spark.createDataFrame([("x", 0, day(0), day(5)), ("x", 1, day(5), day(9)), ("y", 0, day(0), day(3))], "query string, ord long, start date, end date")
    out = ranges.scan(spark, asked, fetch, plan)
    assert {r["d"]: r["n"] for r in out.where("query = 'x' AND kind = 'count'").collect()} == {day(0): 1, day(5): 1, day(9): 2}
    assert {r["query"]: r["s"] for r in out.groupBy("query").agg(ranges.status_of(out).alias("s")).collect()} == {"x": "full_success", "y": "failed"}
    assert ranges.scan(spark, asked.limit(0), fetch, plan).count() == 0


def test_pauses_and_retries():
    plan, slept, tried = ranges.ScanPlan(modes=("m",), retries=4, cooldown=5.0, most_pause=6.0), [], []

    def fetch(query, mode, start, end):
        tried.append(mode)
        if len(tried) < 4:
            raise ranges.Limited("429") if len(tried) == 2 else ValueError("x")
        return {start: 1}

    assert ranges.ask(fetch, plan, "q", DAY, DAY, slept.append) == ("m", {DAY: 1}, "")
    assert slept == [1.2, 5.0, 4.8] and plan.pause(9, False) == 6.0 and plan.pause(1, True) == 5.0
    tried.clear()
    no = ranges.ScanPlan(modes=("m", "n"), fallback="f", fallback_days=1, retries=0)
    assert ranges.ask(lambda *a: 1 / 0, no, "q", DAY, day(1), slept.append)[2] == "m: attempt=1: division by zero | n: attempt=1: division by zero"
    assert ranges.ask(lambda *a: 1 / 0, no, "q", DAY, DAY, slept.append)[2].endswith("f: attempt=1: division by zero")
    assert no.floor == 1 and ranges.ScanPlan().floor == 90


def make_pages(seed):
    rng = random.Random(seed)
    pages, entries = [], []
    for s in range(8):
        urls = rng.randrange(2, 25)
        for p in range(1, rng.randrange(2, 14)):
            pages.append((f"s{s}", p, rng.random() < 0.2))
            for o in range(rng.randrange(0, 6)):
                url = rng.choice([None, "", f"u{rng.randrange(urls)}", f"u{rng.randrange(urls)}"])
                entries.append((f"s{s}", p, o, url, rng.choice([" A  b", "a b", "c", None]), rng.choice(["2024-01-01", "2024-01-02", None])))
    return pages, entries


def plain_merge(pages, entries, stop=2):
    out, asked = [], []
    for s in sorted({p[0] for p in pages}):
        seen, empty = set(), 0
        for _, p, failed in sorted(x for x in pages if x[0] == s):
            if empty >= stop:
                break
            asked.append((s, p))
            if failed:
                continue
            new = 0
            for e in sorted((e for e in entries if e[:2] == (s, p)), key=lambda e: e[2]):
                k = e[3] or (" ".join((e[4] or "").split()).lower(), e[5] or "")
                if k not in seen:
                    seen.add(k)
                    out.append(e)
                    new += 1
            empty = 0 if new else empty + 1
    return sorted(out, key=str), sorted(asked)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_paged_merge(spark, seed):
    pages, entries = make_pages(seed)
    want, asked = plain_merge(pages, entries)
    p = spark.createDataFrame(pages, "source string, page int, failed boolean")
    e = spark.createDataFrame(entries, "source string, page int, ord int, url string, title string, date string")
    assert sorted(map(tuple, paged.merge_pages(p, e).select("source", "page", "ord", "url", "title", "date").collect()), key=str) == want
    status = paged.paged_status(p, e)
    assert sorted((r.source, r.page) for r in status.where("asked").collect()) == asked
    by = collections.Counter(x[0] for x in want)
    assert {r.source: r.entries for r in paged.paged_result(status).collect()} == {s: by[s] for s in {x[0] for x in pages}}


def test_paged_stream(spark, tmp_path):
    """Pages in any order, over several batches, some twice."""
    pages, entries = make_pages(9)
    rows = [(s, p, f, [(o, u, t, d) for a, b, o, u, t, d in entries if (a, b) == (s, p)]) for s, p, f in pages]
    rows += random.Random(1).sample(rows, 10)
    random.Random(2).shuffle(rows)
    schema = f"source string, page int, failed boolean, entries {paged.PAGE_ENTRIES}"
    for k in range(0, len(rows), 15):
        spark.createDataFrame(rows[k : k + 15], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = paged.stream_pages(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert not q.isActive and q.exception() is None
    got = spark.read.parquet(str(tmp_path / "out")).select("source", "page", "ord", "url", "title", "date").collect()
    assert sorted(map(tuple, got), key=str) == plain_merge(pages, entries)[0]


def greedy(rows, gap, most=None):
    kept = []
    for r in rows:
        if (most is None or len(kept) < most) and all(abs((r - k).days) > gap for k in kept):
            kept.append(r)
    return kept


@pytest.mark.parametrize(("gap", "most"), [(0, None), (3, None), (3, 7), (40, None), (5, 1)])
def test_spacing_is_greedy(spark, gap, most):
    rng = random.Random(gap)
    rows = [(g, day(rng.randrange(400)), rng.randrange(9), i) for g in ("a", "b") for i in range(150)]
    rows += [("up", day(2 * k), k, k) for k in range(120)]  # every choice hangs on the one before
    df = spark.createDataFrame(rows, "g string, d date, v int, i int")
    out = shocks.spaced(df, gap, [F.col("v").desc(), F.col("d").desc(), F.col("i")], most, ["g"]).collect()
    assert len(out) == len(rows)
    for g in ("a", "b", "up"):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], -r[1].toordinal(), r[3]))
        assert sorted(r.d for r in out if r.g == g and r.kept) == sorted(greedy([r[1] for r in mine], gap, most))


def test_non_overlapping_names_the_nearest(spark):
    rng = random.Random(5)
    rows = [(day(k), rng.choice([1, 2, 3]), float(rng.randrange(5))) for k in rng.sample(range(500), 140)]
    out = shocks.non_overlapping(spark.createDataFrame(rows, "d date, priority int, score double"), [10, 0, 25, 10]).collect()
    assert len(out) == 2 * len(rows)
    for gap in (10, 25):
        kept = greedy([r[0] for r in sorted(rows, key=lambda r: (r[1], r[2], r[0]), reverse=True)], gap)
        for r in (r for r in out if r.gap == gap):
            assert r.kept == (r.d in kept)
            assert r.nearest == (None if r.kept else min(kept, key=lambda k: (abs((k - r.d).days), k)))
