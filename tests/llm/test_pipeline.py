"""The pipeline's stages against plain versions of each, on planted rows."""

import collections
import hashlib
import random
import tracemalloc
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from feedcore.llm import common, language
from plain_texts import plain_classes, plain_repeats

# Names that the operators use for their own columns, one of them not nullable.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, familiar double, "
    "n_lines long, n_dropped long, n_words long, n_removed long, kept_sha256 string, own_key string, zz int not null"
)


def planted():
    rnd = random.Random(12)
    parts = {"xx": ["ka", "mo", "ti", "lu", "sen", "ra"], "yy": ["örn", "blà", "gé", "wim", "tör", "ñu"]}
    names = {k: ["".join(rnd.choices(v, k=rnd.randint(1, 4))) for _ in range(300)] for k, v in parts.items()}
    prose = lambda k, n: " ".join(rnd.choices(names[k], k=n))
    rows = [(i, prose("xy"[i % 2] * 2, rnd.randint(40, 90)), "xy"[i % 2] * 2) for i in range(60)]
    junk = [(100 + i, " ".join("".join(rnd.choices("bcdfghjklq", k=7)) for _ in range(60)), "xx") for i in range(5)]
    junk += [(110, " ".join(chr(0x4E00 + rnd.randrange(9000)) * 5 for _ in range(60)), None), (111, "12 34 --", "xx"), (112, None, "yy")]
    lined = [(120 + i, f"all rights of page {i} are ours\n" + prose("xx", 60), "xx") for i in range(4)]
    base = prose("yy", 80).split()
    near = [(140 + i, " ".join([*base[:40], f"ka{'mo' * i}", *base[40:]]), "yy") for i in range(2)] + [(145, rows[7][1], "yy")]
    passage = prose("xx", 45)
    shared = [(150 + i, f"{prose('xx', 50)} {passage} {prose('xx', 50)}", "xx") for i in range(3)]
    twice = [(160, prose("xx", 50), "xx"), (160, prose("yy", 50), "yy"), *2 * [(161, prose("xx", 55), "xx")], (None, prose("xx", 60), "xx")]
    clean = {r[0] for r in [*rows, *lined, *near, *shared, *twice]}
    return [*rows, *junk, *lined, *near, *shared, *twice], {r[0] for r in junk}, clean


def test_planted_rows(spark):
    rows, junk, clean = planted()
    docs = spark.createDataFrame([(*r, "s", len(r[1] or ""), -1.5, "p", -2.5, -5, -6, -7, -8, "k", "o", 3) for r in rows], SCHEMA).repartition(3)
    steps = dict(corpus_pipeline.STAGES)
    kept = {}
    for name in list(steps)[:-1]:
        docs = corpus_pipeline.stage(steps[name](spark, docs, "planted"), name)
        kept[name] = docs.collect()
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        for r in kept[name]:  # extra columns are never overwritten
            assert r[5:] == (-1.5, "p", -2.5, -5, -6, -7, -8, "k", "o", 3)
    assert {r.doc_id for r in kept["language_id"]} == clean and len(kept["language_id"]) == len(rows) - len(junk)

    texts = {r.doc_id: r.text for r in kept["line_dedup"]}
    first = {r[0]: r[1] for r in rows}
    for key in clean - {160, None}:
        recurring = key in (121, 122, 123)
        assert texts[key] == (first[key].split("\n")[1] if recurring else first[key])

    given = sorted((r.doc_id, hashlib.md5((r.text or "").encode()).digest(), r.text) for r in kept["line_dedup"] if r.doc_id is not None)
    _, own = plain_classes([t for _, _, t in given], 5, 4, 5)
    want = {(k, h) for (k, h, _), o, i in zip(given, own, range(len(own))) if own.index(o) == i}
    got = [(r.doc_id, hashlib.md5(r.text.encode()).digest()) for r in kept["near_duplicates"] if r.doc_id is not None]
    assert sorted(got) == sorted(want) and len(kept["near_duplicates"]) == len(want) + 1
    assert [r.doc_id for r in kept["near_duplicates"]].count(160) == 2

    before = [r for r in kept["near_duplicates"]]
    plain = collections.Counter((r.doc_id, sha) for r, (_, _, sha) in zip(before, plain_repeats([r.text for r in before])))
    words = lambda t: b" ".join((t or "").encode().split())
    assert collections.Counter((r.doc_id, hashlib.sha256(words(r.text)).hexdigest()) for r in kept["substring_dedup"]) == plain
    assert sum(len(words(r.text).split()) for r in kept["substring_dedup"]) <= sum(len(words(r.text).split()) for r in before) - 3 * 45

    packed = steps["packing"](spark, docs, "planted").collect()
    whole = collections.Counter()
    for r in packed:
        whole[r.doc_id, r.text_hash] += r.length
        assert r.start + r.length <= r.doc_tokens
    assert {k: n for k, n in whole.items()} == {(r.doc_id, r.text_hash): r.doc_tokens for r in packed}
    assert {k for k, _ in whole} == {r.doc_id for r in kept["substring_dedup"]}


def test_long_runs_are_read_whole():
    runs = language.words_of("a" * 95 + " " + "漢" * 41 + " É1b")
    assert runs == ["a" * 40, "a" * 40, "a" * 15, "漢" * 40, "漢", "é", "b"]


def letters(i):
    return "".join("abcdefghij"[int(d)] for d in f"{i:04}")


def test_languages_are_learned_from_every_document(spark, monkeypatch):
    rnd, models = random.Random(3), []
    common = {"xx": ["kamo", "tilu", "senra"], "yy": ["wimtor", "gelba", "nulfa"]}
    rows = [(i, " ".join([*rnd.choices(common[k], k=20), k[0] * 3 + letters(i)]), k) for i in range(1200) for k in [("xx", "yy")[i % 2]]]
    docs = spark.createDataFrame([(*r, "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(language, "predict", lambda d, model, key, f=language.predict: models.append(model) or f(d, model, key))
    for n in (2, 9):
        assert corpus_pipeline.language_id(spark, docs.repartition(n), "").count() == len(rows)
    learned = [t.split()[-1] for i, t, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    assert all(models[0].weights[zlib.crc32(b"w" + w.encode()) % language.BUCKETS].any() for w in learned)
    # Neither does the model depend on how rows lie.
    assert (models[0].weights == models[1].weights).all() and (models[0].move == models[1].move).all()


def test_features_of_many_words_are_those_of_each():
    words = ["a", "é", "ab", "abc", "abcd", "漢字", "ñandú", "x" * 40]
    flat, sizes = language.features_of(words)
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [language.features(w) for w in words]


def test_bound_of_all_documents_is_that_of_the_halves(spark):
    docs = spark.createDataFrame([(i, f"some words again and again {letters(i)}", "x") for i in range(60)], "doc_id long, text string, lang string")
    _, usual = language.learn(docs, F.lit(True))
    rows = [(r.half, r.text) for r in language.learnable_rows(docs, F.lit(True)).collect()]
    assert (usual == language.usual_features([("x", t) for half, t in rows if not half])).all()
    shares = [np.mean([usual[language.features(w)[2:]].mean() for w in t.split()]) for half, t in rows if half]
    assert abs(language.learned_bound(docs, F.lit(True), usual) - 0.6 * np.median(shares)) < 1e-4
    assert language.learned_bound(docs.limit(0), F.lit(True), usual) == 0.0


def test_bound_follows_the_sample():
    assert language.familiar_bound([]) == 0.0
    assert language.familiar_bound([("x", "one"), ("x", "")]) == 0.0
    assert 0.5 < language.familiar_bound([("x", f"some words again and again {i}") for i in range(40)]) <= 0.6


def test_predict_replaces_columns_of_its_names(spark):
    docs = spark.createDataFrame([(1, "one two", 7.0, "z"), (2, None, 8.0, "z")], "doc_id long, text string, score double, lang_pred string")
    model = language.train([("en", "one two three")])
    told = language.predict(docs, model, docs.columns)
    assert told.columns == ["doc_id", "text", "lang_pred", "score", "familiar"]
    assert {(r.doc_id, r.lang_pred, r.familiar is None) for r in told.collect()} == {(1, "en", False), (2, "und", True)}


def test_texts_of_a_shard_are_not_held():
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghij", k=40)) for _ in range(500)]
    rows = [(i // 16, "xy"[i % 2], i // 2 % 2, " ".join(rnd.choices(words, k=25_000 if i < 16 else 90))) for i in range(20)]
    number, held = {"x": 0, "y": 1}, []

    def batches():
        for row in rows:
            held.append(tracemalloc.get_traced_memory()[0])
            yield pa.record_batch([[x] for x in row], ["shard", "label", "half", "text"])

    tracemalloc.start()
    got = language.sum_of_shards(batches(), number)
    tracemalloc.stop()
    # The first 16 rows are a shard of 16 MB; a word's number takes a tenth of the word (what the first row loads is no text).
    assert max(held[1:16]) - held[1] < 8 << 20
    lines = [language.shard_line([(number[k], h, t) for s, k, h, t in rows if s == name], 2, name) for name in (0, 1)]
    assert np.array_equal(got, lines[0] + lines[1]) and language.sum_of_shards([], number) is None


def test_words_of_other_operators_go():
    common.in_worker(("words", "of another"), lambda: [0] * 1000)
    common.clear_worker()
    assert common.in_worker(("words", "of another"), list) == []
    common.clear_worker()
