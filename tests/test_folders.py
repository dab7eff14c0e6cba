"""The stored set by touched folders against merging it whole."""

import os
import shutil

import pytest

from feedcore.plans import merge
from feedcore.rules import SHIPPED
from feedcore.sources import folders, store
from test_jobs import CATEGORY, NEWS, OFFICIAL, items, random_rows

RUNS = ((1, "2026-08-01"), (2, "2026-08-08"), (3, "2026-09-20"), (4, "2027-03-01"))


def fields(df):
    columns = [c for c in df.columns if c not in ("official",)]
    return sorted((tuple(map(str, (r[c] for c in columns))) for r in df.collect()))


def batch(spark, run):
    rows = random_rows(run, 60) + [("K-IFRS 개정 x", d, NEWS) for d in ("2026-3-9", "2026-13-45", None)]
    return items(spark, rows, run)


def state(path):
    return {
        os.path.join(top, f): os.stat(os.path.join(top, f)).st_mtime_ns
        for top, _, files in os.walk(os.path.join(path, "data"))
        for f in files
        if f.startswith("part-")
    }


def test_touched_folders_equal_a_whole_merge(spark, tmp_path):
    path, whole = str(tmp_path / "store"), None
    for run, as_of in RUNS:
        new = batch(spark, run)
        stored = whole if whole is not None else new.limit(0)
        fresh, kept = merge.merge_parts(new, merge.revalidate(stored, SHIPPED), SHIPPED, as_of, run)
        target = str(tmp_path / f"whole-{run}")
        fresh.unionByName(kept).write.parquet(target)
        whole = spark.read.schema(new.schema).parquet(target)
        merge.merge_touched(spark, new, path, SHIPPED, as_of, run)
        assert fields(store.read_store(spark, path)) == fields(whole)
        assert store.latest_run(spark, path) == run
    # Only the newest two runs are kept.
    assert sorted(os.listdir(tmp_path / "store" / "_manifest")) == ["run=3", "run=4"]
    versions = {f.folder.split("/")[1] for n in (3, 4) for f in manifest(spark, path, n)}
    assert set(os.listdir(tmp_path / "store" / "data")) - {"_SUCCESS"} <= versions | {"v=4"}


def manifest(spark, path, run):
    rows = spark.read.schema("folder string, is_official boolean, month string, rules string").parquet(f"{path}/_manifest/run={run}")
    return [folders.Folder(*r) for r in rows.collect()]


def row(title, day, kind=NEWS):
    return (f"{title} K-IFRS 개정", day, kind)


def test_untouched_folders_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "store")
    first = [row("april", "2026-04-02"), row("may", "2026-05-02"), row("june", "2026-06-02"), row("july", "2026-07-02"), row("law", "2020-01-01", OFFICIAL)]
    merge.merge_touched(spark, items(spark, first, 1), path, SHIPPED, "2026-08-01", 1)
    before = state(path)
    # A row of August replaces June's; April expires as a whole; the rest is not rewritten, though it is in force.
    second = [row("june", "2026-08-03"), row("august", "2026-08-02")]
    merge.merge_touched(spark, items(spark, second, 2), path, SHIPPED, "2026-10-29", 2)
    after = state(path)
    assert {f: t for f, t in after.items() if f in before} == before
    assert {(f.month, f.folder.split("/")[1]) for f in folders.in_force(spark, path)[1]} == {
        ("2026-05", "v=1"), ("2026-07", "v=1"), ("2026-08", "v=2"), ("2020-01", "v=1"),
    }
    assert sorted(r.title.split()[0] for r in store.read_store(spark, path).collect()) == ["august", "july", "june", "law", "may"]
    # Other rules: every folder is checked again.
    fewer = SHIPPED.replace(noise=(*SHIPPED.noise, "may"))
    merge.merge_touched(spark, items(spark, [], 3), path, fewer, "2026-10-29", 3)
    assert {f.folder.split("/")[1] for f in folders.in_force(spark, path)[1]} == {"v=3"}
    assert sorted(r.title.split()[0] for r in store.read_store(spark, path).collect()) == ["august", "july", "june", "law"]
    assert not any("v=1" in f for f in state(path)) or folders.finished_runs(spark, f"{path}/_manifest") == [3, 2]


@pytest.mark.parametrize("step", ["put_in_force", "remove_unused", "createDataFrame", "_written"])
def test_a_crash_at_each_step_can_be_repeated(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "store")
    merge.merge_touched(spark, batch(spark, 1), path, SHIPPED, *reversed(RUNS[0]))
    old = fields(store.read_store(spark, path))
    plain = str(tmp_path / "plain")
    shutil.copytree(path, plain)
    merge.merge_touched(spark, batch(spark, 2), plain, SHIPPED, *reversed(RUNS[1]))

    def crash(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        new = batch(spark, 2)
        if step == "createDataFrame":
            real = spark.createDataFrame
            broken.setattr(type(spark), step, lambda self, *a, **k: crash() if "folder string" in str(a) else real(*a, **k))
        else:
            broken.setattr(folders, step, crash)
        with pytest.raises(RuntimeError):
            merge.merge_touched(spark, new, path, SHIPPED, *reversed(RUNS[1]))
    in_force = step == "remove_unused"
    assert fields(store.read_store(spark, path)) == (fields(store.read_store(spark, plain)) if in_force else old)
    if not in_force:
        merge.merge_touched(spark, batch(spark, 2), path, SHIPPED, *reversed(RUNS[1]))
    assert fields(store.read_store(spark, path)) == fields(store.read_store(spark, plain))


def test_a_set_written_whole_is_carried_on(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [row("may", "2026-05-02"), row("june", "2026-06-02"), ("no match", "2026-06-03", NEWS)]
    store.write_store(items(spark, rows), path, 1, SHIPPED)
    merge.merge_touched(spark, items(spark, [row("may", "2026-08-02")], 2), path, SHIPPED, "2026-08-08", 2)
    assert sorted((r.title.split()[0], r.date) for r in store.read_store(spark, path).collect()) == [("june", "2026-06-02"), ("may", "2026-08-02")]
    assert store.latest_run(spark, path) == 2 and CATEGORY in {r.category for r in store.read_store(spark, path).collect()}
    assert [r.title.split()[0] for r in store.read_store(spark, path, "2026-07-01").collect()] == ["may"]
