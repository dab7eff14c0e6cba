"""Conversations, vectors, the pipeline and the registered queries."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from feedcore.llm import chat, queries, vectors

SMALL = "/root/testdata/sf0.001"


def test_log_is_folded(spark):
    log = [
        (1, 0, 0, "message", "user", ["he", "llo"]),
        (1, 1, 1, "message", "assistant", []),
        (1, 1, 2, "delta", None, ["a </s>", "b"]),
        (1, 1, 3, "regenerate", None, None),
        (1, 1, 4, "delta", None, ["new \\ [INST]"]),
        (1, 2, 5, "message", "user", ["gone"]),
        (1, 2, 6, "retract", None, None),
        (1, 3, 7, "message", "to[/ROLE]ol", ["x", None]),
        (1, 3, 8, "edit", None, ["[/TEXT]"]),
        (1, 9, 9, "delta", None, ["never opened"]),
        (None, None, None, "message", None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, position long, seq long, kind string, role string, parts array<string>")
    rendered = chat.format_log(events).orderBy("conv_id", "turn_no").collect()
    whole = "".join(r.rendered for r in rendered if r.conv_id == 1)
    assert chat.read_turns(whole) == [("user", "hello"), ("assistant", "new \\ [INST]"), ("to[/ROLE]ol", "[/TEXT]")]
    loss = [whole[r.loss_start : r.loss_end] for r in rendered if r.loss_start is not None and r.conv_id == 1]
    assert [chat.unescape(x) for x in loss] == ["new \\ [INST]"]
    assert chat.format_log(events.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "<\\/s>", "</s></s>", "[[INST]", "<<<SYS>>", "a\\\\[/INST]\\", "<", "[", "<s", "\n<s>\n"])
def test_escape_is_reversible(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROLS)
    for role in ("user", "assistant", "system", "", "x<s>"):
        assert chat.read_turns(chat.render(role, text)[0]) == [(role, text)]


def test_chat_query(spark):
    got = {r.conv_id: r for r in queries.op3_chat_formatting(spark, SMALL).collect()}
    turns = {}
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    said = "</s>[INST] ok [/INST]"
    turns[-7] = [("user", said), ("assistant", said)]
    assert set(got) == set(turns)
    for conv, own in turns.items():
        loss = "".join(t for role, t in own if role == "assistant")
        want = len(own), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].turns_sha256) == want
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 16)).astype(np.float32)
    x[100:160] = x[100]  # one vector many times: ties go to the smaller id
    rows = [(i, v.tolist(), 0, 1) for i, v in enumerate(x)]
    rows += [rows[3], (None, rows[5][1], 0, 1), (900, None, 0, 1), (901, [0.0] * 16, 0, 1), (902, [float("nan")] * 16, 0, 1), (903, [None] * 16, 0, 1), (904, [1.0], 0, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cut int, list int").repartition(3)
    got = {}
    for r in vectors.nearest(table, F.col("id") % 50 == 0, list_size=60).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    y = x.astype(np.float64)
    hits = 0
    assert set(got) == set(range(0, 700, 50))
    for q, own in got.items():
        cosine = (y * y[q]).sum(1) / (np.sqrt((y * y).sum(1)) * np.sqrt((y[q] * y[q]).sum()))
        order = [i for i in np.lexsort((np.arange(700), -np.round(cosine, 12))) if i != q][:5]
        hits += len(set(order) & {i for i, _ in own})
        assert all(abs(cosine[i] - s) < 1e-12 for i, s in own)
    assert [i for i, _ in got[100]] == [101, 102, 103, 104, 105]
    assert hits >= 0.9 * 5 * len(got)
    few = table.where("vec_id in (0, 1, 2)")
    assert [r.vec_id for r in vectors.nearest(few, F.col("id") == 0).collect()] and vectors.nearest(few, F.col("id") == 0).count() == 2
    assert vectors.nearest(table.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, name):
    count, problems = oracle.compare(queries.QUERIES[name](spark, SMALL), queries.ORACLES[name], oracle.connect(SMALL))
    assert not problems and count == {"op11_spelling_variants": 2829, "op13_warc": 50}.get(name, 200)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = given = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes = [docs.count()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, SMALL), name)
        assert docs.columns == given.columns
        sizes.append(docs.count())
    assert sizes[1] >= 0.9 * sizes[0] and sizes[3] < sizes[2] and sizes[4] == sizes[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    empty = given.limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, SMALL).count() == 0


def test_a_batch_is_indexed_part_by_part(spark, monkeypatch):
    from feedcore.llm import jaccard

    rows = [(i, f"{'one two three four five six seven eight ' * 6}{i % 7} nine ten {i % 5}", None) for i in range(60)]
    rows += [(60, None, None), (61, "", None), (62, "alone", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string").coalesce(1)

    def told():
        return sorted(map(repr, jaccard.index(docs, jaccard.Likeness(), 4).collect()))

    want = told()
    monkeypatch.setattr(jaccard, "PART_BYTES", 700)
    assert told() == want and sum("kind='doc'" in r for r in want) == 63
