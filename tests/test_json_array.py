"""JSON arrays read by ranges against the standard library."""

import json
import random

import pytest
from pyspark.sql import functions as F

from feedcore.plans import merge
from feedcore.rules import SHIPPED
from feedcore.sources import json_array, store
from test_jobs import AS_OF, CATEGORY, NEWS
from test_sources import raw


def value(rnd, depth=0):
    text = "".join(rnd.choice('ab"\\{}[],:é漢😀 \n') for _ in range(rnd.randint(0, 30)))
    kinds = [text, rnd.random(), None, True]
    if depth < 3:
        kinds += [{text[:4]: value(rnd, depth + 1), "k": text}, [value(rnd, depth + 1) for _ in range(3)]]
    return rnd.choice(kinds)


@pytest.mark.parametrize("split, piece", [(7, 5), (64, 1 << 20), (1 << 20, 33)])
def test_records_equal_the_standard_library(spark, tmp_path, monkeypatch, split, piece):
    monkeypatch.setattr(json_array.pieces, "__defaults__", (piece,))
    rnd = random.Random(split)
    arrays = [[{"a": value(rnd), "b": i} for i in range(n)] for n in (0, 1, 9, 60)] + [[[1, [2]], {"x": "\\"}, [], {}]]
    for i, a in enumerate(arrays):
        text = json.dumps(a, ensure_ascii=i % 2 == 0, indent=i % 3 or None)
        (tmp_path / f"{i}.json").write_text(f" \n{text}\n", encoding="utf-8")
    rows, broken = json_array.array_records(spark, str(tmp_path), split)
    got = {}
    for r in rows.orderBy("file", "pos").collect():
        own = got.setdefault(int(r.file[-6]), [])
        assert r.pos == len(own)
        own.append(json.loads(r.text))
    assert broken == [] and got == {i: a for i, a in enumerate(arrays) if a}
    assert split > 64 or rows.rdd.getNumPartitions() > 4


def test_a_large_array_is_read_in_many_tasks(spark, tmp_path):
    item = json.dumps({"title": "t" * 900, "url": "u"})
    with open(tmp_path / "large.json", "w") as out:
        out.write("[" + item)
        for _ in range(40):
            out.write(("," + item) * 1000)
        out.write("]")
    found, unread = store.read_items_json(spark, str(tmp_path / "large.json"), split=4 << 20)
    per_task = found.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per_task) == 40_001 and len(per_task) >= 4 and unread.count() == 0
    assert found.agg(F.countDistinct("feed_pos"), F.max("feed_pos")).first()[:] == (40_001, 40_000)


def test_unreadable_files_give_nothing(spark, tmp_path):
    good = '[{"title": "one"}, {"title": "two"}]'
    cases = {"cut": good[:-9], "object": '{"title": "x"}', "record": '[{"title": "x"}, {"title": nope}]', "string": '[{"title": "x}]', "good": good}
    for name, text in {**cases, "empty": ""}.items():
        (tmp_path / f"{name}.json").write_text(text)
    found, unread = store.read_items_json(spark, str(tmp_path))
    assert sorted(r.title for r in found.collect()) == ["one", "two"]
    told = [r.text for r in unread.collect()]
    assert len(told) == 4 and '{"title": nope}' in told


def test_a_job_begins_with_an_item_list(spark, tmp_path):
    title = "K-IFRS 개정 안내"
    rows = [{"title": f"{t} {title}", "source": "신문", "source_type": NEWS, "category": c, "url": "u", "date": "2026-08-01"} for t, c in (("하나", CATEGORY), ("둘", "none"))]
    (tmp_path / "items.json").write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    path = str(tmp_path / "store")
    for run in (1, 2):
        merge.run_job(spark, raw(spark).limit(0), path, SHIPPED, AS_OF, run, first_load=str(tmp_path / "items.json"))
        assert [r.title for r in store.read_store(spark, path).collect()] == [f"하나 {title}"]


def test_a_range_reads_little_beyond_its_border(spark, tmp_path):
    item = json.dumps({"title": "t" * 900, "url": "u"}).encode()
    data = b"[" + b",".join([item] * 4000) + b"]"

    class Source:
        read = 0

        def read_at(self, n, at):
            self.read += min(n, len(data) - at)
            return data[at : at + n]

    source, split, found = Source(), 1 << 16, 0
    for start in range(0, len(data), split):
        before = data[:start]
        quotes, depth = before.count(b'"') % 2, before.count(b"[") + before.count(b"{") - before.count(b"}")
        found += len(list(json_array.records(source, start, min(start + split, len(data)), len(data), quotes, depth)))
    assert found == 4000 and source.read < 1.5 * len(data)
    (tmp_path / "a.json").write_bytes(data)
    rows, broken = json_array.array_records(spark, str(tmp_path), 1 << 12)
    assert rows.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert not broken and rows.agg(F.countDistinct("pos"), F.max("pos")).first()[:] == (4000, 3999)
