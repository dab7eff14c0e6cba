"""Merging, storing, publishing, browsing and streaming against plain Python rules."""

import os
import random

import pytest
from pyspark.sql import functions as F

from feedcore.catalog import scans
from feedcore.functions.text import title_key
from feedcore.operators import browse, calendar, first, lookup, rank
from feedcore.plans import merge
from feedcore.rules import SHIPPED, links_frame, replace_from_frames, trust_frame
from feedcore.schema import ITEM, ITEM_COLUMNS, STORED, conform
from feedcore.session import shared_folder
from feedcore.sources import readers, store
from feedcore.streaming import intake
from test_sources import raw, rss

AS_OF = "2026-08-08"
OFFICIAL, NEWS = SHIPPED.official_type, SHIPPED.news_type
CATEGORY = "K-IFRS"


def items(spark, rows, run=0):
    """Rows of (title, date, source_type[, trust[, source[, category]]]) in intake order."""
    full = []
    for i, row in enumerate(rows):
        title, date, kind, trust, source, category = (*row, *(30, "신문", CATEGORY)[len(row) - 3 :])
        full.append((source, kind, category, title, f"https://x/{i}", date, trust, run, 0, 0, "p", i))
    schema = (
        "source string, source_type string, category string, title string, url string, date string, "
        "trust int, run_seq long, source_rank int, group_rank int, payload_id string, feed_pos long"
    )
    return conform(spark.createDataFrame(full, schema), STORED)


def random_rows(seed, n):
    rng = random.Random(seed)
    titles = [f"{a} K-IFRS 개정 {b}" for a in ("[속보]", "", "가", "나-") for b in range(12)] + ["---", "[태그]"]
    days = ["2026-08-07", "2026-08-08", "2026-02-09", "2026-02-08", "2027-01-01", "", "미정"]
    return [
        (rng.choice(titles), rng.choice(days), rng.choice([OFFICIAL, NEWS, NEWS]), rng.choice([100, 60, 30]))
        for _ in range(n)
    ]


def plain_key(title):
    import re

    bare = re.sub(r"\[[^\]]*\]", "", title)
    return "".join(c for c in bare if "가" <= c <= "힣" or (c.isascii() and c.isalnum())).lower()[:24]


def plain_merge(new, stored):
    """The rule written down: official rows first by (title, date), then the rest by key."""
    both = new + stored
    seen, kept = set(), []
    for official in (True, False):
        for row in both:
            if (row[2] == OFFICIAL) is not official:
                continue
            key = (official, row[0], row[1]) if official else (official, plain_key(row[0]))
            if key in seen or key == (False, ""):
                continue
            seen.add(key)
            kept.append(row)
    kept = [r for r in kept if r[2] == OFFICIAL or r[1] >= "2026-02-09"]
    return sorted(kept, key=lambda r: (r[3], r[1]), reverse=True)


def shape(rows):
    return [(r.title, r.date, r.source_type, r.trust) for r in rows]


@pytest.mark.parametrize("partitions", ["1", "8", "64"])
def test_merge_and_rank_equal_the_plain_rule(spark, partitions):
    new, stored = random_rows(1, 150), random_rows(2, 300)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = merge.merge(
            items(spark, new).repartition(7), items(spark, stored).repartition(5), SHIPPED, AS_OF, 1
        )
        found = shape(rank.rank_feed(df, SHIPPED).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == plain_merge(new, stored)


def test_second_merge_over_a_unique_store(spark):
    new, stored = random_rows(3, 120), random_rows(4, 200)
    first_run = merge.merge(items(spark, stored), items(spark, []), SHIPPED, AS_OF, 1)
    fresh, kept = merge.merge_parts(items(spark, new), first_run, SHIPPED, AS_OF, 2)
    found = shape(rank.rank_feed(fresh.unionByName(kept), SHIPPED).collect())
    assert found == plain_merge(new, plain_merge(stored, []))
    whole = merge.merge(items(spark, new), first_run, SHIPPED, AS_OF, 2)
    assert found == shape(rank.rank_feed(whole, SHIPPED).collect())


def test_merge_again_changes_nothing(spark):
    once = merge.merge(items(spark, random_rows(5, 100)), items(spark, []), SHIPPED, AS_OF, 1)
    again = merge.merge(items(spark, []), once, SHIPPED, AS_OF, 2)
    assert shape(rank.rank_feed(again, SHIPPED).collect()) == shape(rank.rank_feed(once, SHIPPED).collect())


def test_official_and_news_with_one_title_both_stay(spark):
    rows = [("같은 제목 개정", "2026-08-08", OFFICIAL, 100), ("같은 제목 개정", "2026-08-08", NEWS, 60)]
    assert merge.merge(items(spark, rows), items(spark, []), SHIPPED, AS_OF, 1).count() == 2


def test_hot_key_sends_one_row_per_task(spark):
    hot = spark.range(0, 40_000, 1, 16).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("title"),
        F.col("id").alias("feed_pos"),
    )
    df = first.title_dedup(hot, [F.col("feed_pos")])
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert plan.count("WindowGroupLimit") == 2
    assert df.where("title = 'hot'").first().feed_pos == 0
    assert df.count() == 1 + 40_000 - 13_334


def test_revalidate(spark):
    rows = [
        ("K-IFRS 개정", "d", None, None, "신문", "회계기준"),
        ("K-IFRS 개정", "d", None, None, "금융위원회", "법령"),
        ("K-IFRS 주가 개정", "d", NEWS),
        ("K-IFRS 소식", "d", NEWS),
        ("아무 제목", "d", OFFICIAL, 7, "부처", "ESG"),
        ("K-IFRS 개정", "d", NEWS, 30, "신문", "없는 분야"),
        ("K-IFRS 개정", "d", NEWS, 30, "신문", None),
        (None, "d", NEWS),
    ]
    found = merge.revalidate(items(spark, rows), SHIPPED).orderBy("feed_pos")
    assert [(r.feed_pos, r.category, r.source_type, r.trust, len(r.official)) for r in found.collect()] == [
        (0, "K-IFRS", NEWS, 30, 2), (1, "세법", OFFICIAL, 100, 2), (4, "ESG", OFFICIAL, 7, 2),
    ]


def test_retention_is_inclusive_text_comparison(spark):
    rows = [("a", d, k) for k in (NEWS, OFFICIAL) for d in ("2026-02-09", "2026-02-08", "", None, "9999", "미정")]
    kept = items(spark, rows).where(merge.retained(SHIPPED, AS_OF)).select("source_type", "date").collect()
    assert [r.date for r in kept if r.source_type == NEWS] == ["2026-02-09", "9999", "미정"]
    assert sum(r.source_type == OFFICIAL for r in kept) == 6


def test_store_keeps_the_last_finished_run(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.read_store(spark, path).count() == 0
    df = items(spark, [("a", "2026-08-01", NEWS), ("b", "bad", OFFICIAL)])
    store.write_store(df, path, 1, SHIPPED)
    store.write_store(df.limit(1), path, 2, SHIPPED)
    assert store.read_store(spark, path).count() == 1
    os.remove(tmp_path / "store" / "run=2" / "_SUCCESS")
    assert store.latest_run(spark, path) == 1
    assert sorted(r.title for r in store.read_store(spark, path).collect()) == ["a", "b"]
    assert [r.title for r in store.read_store(spark, path, "2026-09-01").collect()] == ["b"]


def test_item_lists_and_snapshots_in_json(spark, tmp_path):
    good = '[{"title":"가","source":"s","official":[{"label":"l","url":"u"}]},{"title":"나","trust":5,"extra":1}]'
    (tmp_path / "good.json").write_text(good, encoding="utf-8")
    (tmp_path / "bad.json").write_text('[{"title":', encoding="utf-8")
    (tmp_path / "data.js").write_text(f'window.X = {{"updated": "2026-08-07 22:26", "items": {good}}};', encoding="utf-8")
    found, unread = store.read_items_json(spark, str(tmp_path / "good.json"))
    assert [(r.title, r.trust, r.feed_pos) for r in found.orderBy("feed_pos").collect()] == [("가", None, 0), ("나", 5, 1)]
    assert unread.count() == 0
    found, unread = store.read_items_json(spark, str(tmp_path / "bad.json"))
    assert (found.count(), unread.count()) == (0, 1)
    found, unread = store.read_items_json(spark, str(tmp_path / "absent.json"))
    assert (found.count(), unread.count()) == (0, 0)
    found, _ = store.read_snapshot(spark, str(tmp_path / "data.js"))
    assert [r.title for r in found.orderBy("feed_pos").collect()] == ["가", "나"]
    assert store.snapshot_updated(spark, str(tmp_path / "data.js")) == "2026-08-07 22:26"
    assert store.snapshot_updated(spark, str(tmp_path / "none.js")) == "-"


def test_ranked_files_follow_published_order(spark, tmp_path):
    df = merge.merge(items(spark, random_rows(6, 200)), items(spark, []), SHIPPED, AS_OF, 1)
    store.write_ranked(df, str(tmp_path / "ranked"), SHIPPED)
    import json

    lines = []
    for part in sorted((tmp_path / "ranked").glob("part-*")):
        lines += [json.loads(line) for line in part.read_text(encoding="utf-8").splitlines()]
    expected = shape(rank.rank_feed(df, SHIPPED).collect())
    assert [(r["title"], r["date"], r["source_type"], r["trust"]) for r in lines] == expected


def test_envelope_has_all_fields_in_order(spark):
    import json

    df = merge.merge(items(spark, random_rows(7, 60)), items(spark, []), SHIPPED, AS_OF, 1)
    text = store.snapshot_envelope(df, SHIPPED, "2026-08-08 09:00", 10).first().snapshot
    parsed = json.loads(text)
    assert parsed["updated"] == "2026-08-08 09:00"
    assert [list(i) for i in parsed["items"]] == [ITEM_COLUMNS] * 10
    assert [i["title"] for i in parsed["items"]] == [r.title for r in rank.rank_feed(df, SHIPPED).limit(10).collect()]
    with pytest.raises(ValueError):
        rank.top(df, rank.feed_order(SHIPPED), rank.MAX_TOP + 1)


RUNS = [
    [("내부회계 개정", "u1", "2026-08-01"), ("회계 소식", "u2", "2026-08-02")],
    [("회계 소식", "u3", "2026-08-02"), ("ESG 소식", "u4", "2026-08-03")],
]


def payloads(spark, run):
    body = rss(*RUNS[run])
    news = rss(("K-IFRS 개정 소식 - 신문", f"https://www.mk.co.kr/{run}", "Fri, 07 Aug 2026 10:00:00 GMT"))
    return raw(
        spark, ("regulator_rss", None, None, body, 0, True, f"a{run}"), ("search_news", CATEGORY, "q", news, 0, True, f"b{run}"),
        ("search_news", "ESG", "q", "<rss><channel><item>", 0, True, f"c{run}"), ("portal_news", "ESG", "q", None, 0, False, f"d{run}"),
    )


def urls_of(df):
    return sorted((r.title, r.url, r.run_seq) for r in df.collect())


EXPECTED = sorted([
    ("내부회계 개정", "u1", 1), ("회계 소식", "u3", 2), ("ESG 소식", "u4", 2), ("K-IFRS 개정 소식", "https://www.mk.co.kr/1", 2),
])


def test_two_runs_of_the_whole_job(spark, tmp_path):
    path = str(tmp_path / "store")
    one = merge.run_job(spark, payloads(spark, 0), path, SHIPPED, AS_OF, 1)
    assert one.items.count() == 3
    two = merge.run_job(spark, payloads(spark, 1), path, SHIPPED, AS_OF, 2, ranked=str(tmp_path / "ranked"))
    assert urls_of(two.items) == EXPECTED
    again = merge.run_job(spark, payloads(spark, 1), path, SHIPPED, AS_OF, 2)
    assert urls_of(again.items) == EXPECTED
    report = {(r.source, r.category): (r.requests, r.no_answer, r.broken, r.rows) for r in two.report.collect()}
    assert report[("search_news", CATEGORY)] == (1, 0, 0, 1)
    assert report[("search_news", "ESG")] == (1, 0, 1, 0)
    assert report[("portal_news", "ESG")] == (1, 1, 0, 0)
    assert {(r.source, r.failure, r.n) for r in two.failures.collect()} == {
        ("search_news", "broken payload", 1), ("portal_news", "no answer", 1),
    }
    merge.publish_envelope(two.items, str(tmp_path / "envelope"), SHIPPED, "u", 100)
    found, _ = store.read_snapshot(spark, str(tmp_path / "envelope"))
    assert found.count() == 4


def test_stream_of_files_equals_the_batch_runs(spark, tmp_path):
    folder, path, marks = (str(tmp_path / n) for n in ("raw", "store", "marks"))
    for run in range(2):
        payloads(spark, run).coalesce(1).write.mode("append").parquet(folder)
        job = intake.stream_job(intake.raw_stream(spark, folder), path, marks, SHIPPED, AS_OF)
        job.awaitTermination()
    assert urls_of(store.read_store(spark, path)) == EXPECTED


def test_new_only_and_lookup_forms_agree(spark):
    rows = [("x", "d", NEWS, 30, "s", c) for c in ("세법", "ESG", "모름", None)]
    df = items(spark, rows).drop("official")
    joined = lookup.join_official_links(df, links_frame(spark, SHIPPED)).orderBy("feed_pos")
    literal = df.withColumn("official", lookup.links_of(F.col("category"), SHIPPED)).orderBy("feed_pos")
    assert [r.official for r in joined.collect()] == [r.official for r in literal.collect()]


def test_a_crashed_write_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "store")
    df = items(spark, [("a", "2026-08-01", NEWS), ("b", "bad", OFFICIAL)])
    store.write_store(df.limit(1), path, 1, SHIPPED)
    store.write_store(df.limit(1), path, 2, SHIPPED)
    os.remove(tmp_path / "store" / "run=2" / "_SUCCESS")
    store.write_store(df, path, 2, SHIPPED)
    assert store.latest_run(spark, path) == 2 and store.read_store(spark, path).count() == 2
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        store.write_store(df, path, 2, SHIPPED)


def test_trust_join_with_equal_short_and_empty_rules(spark):
    rules = [(1, "b.kr", 70, "B"), (1, "a.kr", 80, "A"), (2, "k", 60, "K"), (3, "", 50, "any"), (3, "verylongfragment", 90, "L")]
    trust = spark.createDataFrame(rules, "prio int, fragment string, score int, name string")
    links = ["x.a.kr/b.kr", "B.KR", "k", "zzz", None, "verylongfragment"]
    df = spark.createDataFrame(list(enumerate(links)), "id int, url string")
    found = lookup.trust_join(df, trust, "id").orderBy("id").collect()
    assert [(r.trust, r.trust_name) for r in found] == [(80, "A"), (70, "B"), (60, "K"), (50, "any"), (50, "any"), (50, "any")]


def test_trust_join_equals_the_literal_form(spark):
    from feedcore.functions.urls import with_trust

    rng = random.Random(8)
    pieces = [t.fragment for t in SHIPPED.trust] + ["https://", "www.", "/", "MONEY.COM", "k", ".kr", "mt.co", "ey.co"]
    links = ["".join(rng.choice(pieces) for _ in range(rng.randrange(5))) for _ in range(500)] + [None, ""]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(links)], "id int, url string")
    literal = with_trust(df, SHIPPED, name="trust_name").select("id", "trust", "trust_name")
    joined = lookup.trust_join(df, trust_frame(spark, SHIPPED), "id").select("id", "trust", "trust_name")
    assert sorted(joined.collect()) == sorted(literal.collect())


def test_rules_from_tables(spark):
    frames = {
        "trust": trust_frame(spark, SHIPPED),
        "official_links": links_frame(spark, SHIPPED),
        "categories": spark.createDataFrame(
            [(r.category, i, list(r.must), list(r.combine)) for i, r in enumerate(SHIPPED.categories)],
            "category string, prio int, must array<string>, combine array<string>",
        ),
        "ordered": spark.createDataFrame(
            [("regulator_rules", i, r.category, list(r.keywords)) for i, r in enumerate(SHIPPED.regulator_rules)],
            "rule_set string, prio int, category string, keywords array<string>",
        ),
        "migration": spark.createDataFrame(list(SHIPPED.migration.items()), "old string, new string"),
    }
    assert replace_from_frames(SHIPPED, frames) == SHIPPED


def test_feed_filter_and_order(spark):
    rows = [
        ("회계 가", "2026-08-01", NEWS, 30, "신문"), ("나", "2026-08-02", OFFICIAL, 100, "회계원"),
        ("다", "2026-08-03", NEWS, 60, "신문", "ESG"), ("라 회계", None, NEWS, 60, None, "ESG"),
    ]
    df = items(spark, rows)

    def found(**filters):
        return [r.title for r in browse.feed_search(df, SHIPPED, **filters).collect()]

    assert found() == ["다", "나", "회계 가", "라 회계"]
    assert found(category=browse.ALL, text=" 회계 ") == ["나", "회계 가", "라 회계"]
    assert found(category="ESG") == ["다", "라 회계"]
    assert found(date_from="2026-08-02") == ["다", "나"]
    assert found(date_from="2026-08-01", date_to="2026-08-02") == ["나", "회계 가"]
    assert browse.search_count(df, text="회계").first().n == 3
    assert tuple(browse.dashboard_stats(df, SHIPPED).first()) == (4, 1, 3, 2)
    assert tuple(browse.dashboard_stats(df.limit(0), SHIPPED).first()) == (0, 0, 0, 0)


def test_calendar_and_upcoming(spark):
    rows = [
        ("가법 (제정) · 2026-08-08 시행", "d", OFFICIAL, 100, "s", "세법"),
        ("나법 · 2026-09-07 시행", "d", OFFICIAL, 100, "s", "ESG"),
        ("다법 2026-09-08 시행", "d", NEWS, 30, "s", "ESG"),
        ("라법 2026-09-08 시행", "d", NEWS, 30, "s", "세법"),
        ("마법 2026-02-30 시행", "d", NEWS), ("바법 2026-11-08 시행", "d", NEWS), ("사법 2026-11-09 시행", "d", NEWS),
        ("아법 2026-08-07 시행", "d", NEWS, 30, "s", "모름"), ("자법 2026-09-08 시행", "d", NEWS, 30, "s", "ESG"),
    ]
    events = calendar.enforcement_events(items(spark, rows), SHIPPED, ["feed_pos"])
    soon = calendar.upcoming(events, "2026-08-08", [F.col("feed_pos")]).collect()
    assert [(r.name, r.days_left, r.soon) for r in soon] == [
        ("가법", 0, True), ("나법", 30, True), ("다법 2026-09-08 시행", 31, False), ("라법 2026-09-08 시행", 31, False),
        ("자법 2026-09-08 시행", 31, False), ("바법 2026-11-08 시행", 92, False),
    ]
    grid = calendar.month_calendar(events, 2026, 8, "2026-08-08").orderBy("day").collect()
    assert (len(grid), grid[0].cell, [r.day for r in grid if r.is_today]) == (31, 6, [8])
    assert {r.day: r.codes for r in grid if r.codes} == {7: [""], 8: ["tax"]}
    september = calendar.month_calendar(events, 2026, 9, "2026-08-08").where("day = 8").first()
    assert september.codes == ["esg", "tax"]


def test_cap_keeps_first_rows(spark):
    df = spark.createDataFrame([(s, i) for i in range(50) for s in ("a", "b")], "source string, feed_pos long")
    found = first.cap(df.repartition(9), ["source"], 3).collect()
    assert sorted(tuple(r) for r in found) == [(s, i) for s in ("a", "b") for i in range(3)]


def test_scratch_folder_comes_from_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    assert base is None or shared_folder(spark, "x").startswith(base)


SNAPSHOT = os.environ.get("FEEDCORE_SNAPSHOT")


@pytest.mark.skipif(not SNAPSHOT, reason="FEEDCORE_SNAPSHOT names no published snapshot")
def test_published_snapshot_is_reproduced(spark):
    """A real snapshot, if one is given: its derived columns and order come out again."""
    from feedcore.functions.urls import with_trust

    found, unread = store.read_snapshot(spark, SNAPSHOT)
    found = found.cache()
    assert unread.count() == 0 and found.count() > 100
    redone = merge.summarize(found.drop("summary_lines", "impact"), SHIPPED)
    assert redone.select(*ITEM.fieldNames(), "feed_pos").exceptAll(found.select(*ITEM.fieldNames(), "feed_pos")).count() == 0
    ranked = [r.feed_pos for r in rank.rank_feed(found, SHIPPED).collect()]
    assert ranked == sorted(ranked)
    others = with_trust(found.where(F.col("source_type") != OFFICIAL), SHIPPED, score="again")
    assert others.where("again != trust").count() == 0
    links = found.withColumn("again", lookup.links_of(F.col("category"), SHIPPED))
    assert links.where("again != official").count() == 0
    assert first.feed_dedup(found, SHIPPED).count() == found.count()
    keys = found.where(F.col("source_type") != OFFICIAL).select(title_key(F.col("title")).alias("k"))
    assert keys.distinct().count() == keys.count()
    events = calendar.enforcement_events(found, SHIPPED)
    assert events.count() == 50
    assert readers.LAW_SOURCE in {r.source for r in found.select("source").distinct().collect()}


def test_date_range_reaches_the_scan(spark, tmp_path):
    rows = [("a", "2026-01-01"), ("b", "2026-02-01"), ("c", None), ("d", "")]
    spark.createDataFrame(rows, "title string, date string").write.parquet(str(tmp_path / "items"))
    items = spark.read.parquet(str(tmp_path / "items"))
    late = browse.feed_filter(items, date_from="2026-01-15")
    early = browse.feed_filter(items, date_to="2026-01-15")
    assert [r.title for r in late.collect()] == ["b"]
    assert sorted(r.title for r in early.collect()) == ["a", "c", "d"]
    for found in (late, early):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "2026-01-15" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_a_document_s_feed_is_made_once_for_all_attempts(spark, tmp_path):
    docs = [(i, ("en", "fr", "de", "es", None)[i % 5], f"src{i % 3}", None if i == 7 else f"one {i} & <b>\ntwo") for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for answered in (False, True):
        whole = scans.attempts(spark, str(tmp_path), answered)
        above = whole._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
        assert "transform" not in above and "split" not in above
        for rank in range(3):
            alone = scans.attempts(spark, str(tmp_path), answered, [rank])
            assert sorted(map(repr, alone.collect())) == sorted(map(repr, whole.where(whole.attempt_rank == rank).collect()))


def test_an_absent_store_is_known_to_be_empty(spark, tmp_path):
    for rows, schema in ((store.read_store(spark, f"{tmp_path}/none"), STORED), (intake.answered_before(spark, f"{tmp_path}/none", 3), None)):
        plan = rows.join(rows.limit(5), rows.columns[0], "left_anti")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.startswith("LocalRelation <empty>") and rows.collect() == []
        assert schema is None or rows.schema == schema
