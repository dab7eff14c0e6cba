"""Operators on texts against plain versions, with nulls, empty and long texts, ties, repeats, clashing columns."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from feedcore.llm import byte_bpe, fingerprint, jaccard, language, packing, pseudo, substrings, templates
from feedcore.llm.common import stage, word_hashes
from plain_texts import plain_classes, plain_repeats

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
# Extra columns have names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, a string, doc string, leaf int, n_lines int"


def prose(seed, n, words=60):
    rnd = random.Random(seed)
    names = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(words)]
    return " ".join(rnd.choice(names) for _ in range(n))


def rows():
    base, long = prose(1, 120), prose(2, 30_000, 3000)
    texts = [base, base, base.replace(" ", "  ", 3), prose(3, 40) + " " + base, prose(4, 35), prose(4, 34), None, "", "x" * 9000]
    texts += [long, long + " end", " \t\n", "\xa0 \x1c one", "12 34\n5 6", "same line here\nown " + prose(5, 50)]
    texts += ["same line here\nown " + prose(6, 50), "same line here\nother " + prose(7, 50), "ok", "ok", "Ok", prose(8, 300)]
    words = prose(8, 300).split()
    texts += [" ".join(words[:150] + ["new"] + words[151:]), " ".join(words[:100] + ["b"] * 12 + words[112:])]
    out = [(i, t, "xy"[i % 2], "s", 0, 1, "z", "q", 2, 3) for i, t in enumerate(texts)]
    return [*out, out[0], (None, base, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs, empty):
    tokenizer = Tokenizer.from_file(WORD)
    ids = [tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows()]
    got = packing.pack(docs, WORD, 2, window=256, cut_every=4).collect()
    assert sum(r.length for r in got) == sum(map(len, ids))
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    by_id = collections.defaultdict(list)
    for r, own in zip(rows(), ids):
        by_id[r[0]].append(own)
    sequences = collections.defaultdict(list)
    for r in got:
        own = np.array(by_id[r.doc_id][0], "<u4")
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
        padding += 0 if at & (at - 1) == 0 else 256 - at
    assert padding < 0.05 * sum(map(len, ids))
    assert packing.pack(empty, WORD, 2).count() == 0


def test_sequences_hold_the_ids(spark):
    rows_ = [(i, prose(i, 50 + i)) for i in range(20)]
    rows_ += [rows_[3], rows_[3], (4, prose(90, 30)), (None, "a b c"), (None, None), (7, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows_], "doc_id long, text string, _hash int not null")
    packed = packing.pack(docs, WORD, 2, window=64).cache()
    made = {r.sequence_id: r for r in packing.sequences(docs, packed, WORD, 2, window=64).collect()}
    assert set(made) == {r.sequence_id for r in packed.collect()}
    sizes = collections.Counter()
    for r in packed.collect():
        sizes[r.sequence_id] += r.length
    assert all(len(made[k].input_ids) == (n if n & (n - 1) == 0 else 64) for k, n in sizes.items())
    for r in packed.collect():
        part = made[r.sequence_id].input_ids[r.offset : r.offset + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32


def test_word_ids():
    ids, own = packing.WordIds(WORD), Tokenizer.from_file(WORD)
    assert ids.mark is not None and ids.lower and ids.ends
    ids.limit = 40
    rnd = random.Random(8)
    texts = ["J\u030c \u01f0 a\0b \0 \0\0 'S'T DON'T ,,. \u0130 I\u0307 \u212a", " \n", "", "x\0 y", "don't, don', é, É. «a», a.b, 5, 5."]
    texts += ["".join(rnd.choice("abcEÉé ,.\0'5\n\u0301") for _ in range(200)) for _ in range(60)]
    for turn in range(2):
        for text, data in zip(texts, ids.encode([t.encode() for t in texts], 2)):
            assert np.frombuffer(data, "<u4").tolist() == [*own.encode(text, add_special_tokens=False).ids, 2]
        ids.mark = None


def test_fill_is_the_closest():
    rnd = random.Random(3)
    for _ in range(60):
        counts = collections.Counter(rnd.randint(1, 30) for _ in range(8))
        order = sorted(counts, reverse=True)
        used = packing.fill(counts, order, order[0], 37)
        total = sum(n * c for n, c in used.items())
        sums = {order[0]}
        for n, c in (counts - collections.Counter([order[0]])).items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= 37}
        assert total == max(sums)
        assert all(counts[n] >= c for n, c in used.items())


def test_substrings(docs, empty):
    want = sorted(zip([str(r[0]) for r in rows()], plain_repeats([r[1] for r in rows()])))
    got = substrings.remove_repeats(docs).collect()
    assert sorted((str(r.doc_id), (r.n_words, r.n_removed, r.kept_sha256)) for r in got) == want
    texts = substrings.remove_repeats(docs, with_text=True)
    assert set(docs.columns) <= set(texts.columns)
    for r in texts.collect():
        assert hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() == r.kept_sha256
    assert substrings.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("words,num,den", [(3, 90, 100), (5, 4, 5)])
def test_jaccard(spark, empty, words, num, den):
    rnd = random.Random(words)
    texts = [r[1] for r in rows()]
    for family in range(6):  # many copies with a few words changed, at all sizes
        base = prose(50 + family, (8, 14, 30, 60, 150, 400)[family], 400).split()
        for _ in range(25):
            own = list(base)
            for _ in range(rnd.randint(0, 1 + len(base) // 60)):
                own[rnd.randrange(len(own))] = "w%d" % rnd.randrange(3)
            texts.append(" ".join(own))
    ids = [3 * i for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
    sets, own = plain_classes(texts, words, num, den)
    least = {}
    for i, o in zip(ids, own):
        least.setdefault(o, i)
    like = jaccard.Likeness(words, num, den)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs, like).collect()}
    assert got == {i: (len(s), least[o]) for i, s, o in zip(ids, sets, own)}
    assert jaccard.classes(empty, like).count() == 0


def test_no_similar_pair_without_a_common_key():
    rng = np.random.default_rng(2)
    like = jaccard.Likeness(3, 4, 5)
    for size in [*range(2, 40), 90, 200]:
        for _ in range(25):
            a = rng.integers(0, 1 << 60, size).astype(np.uint64)
            cut = int(rng.integers(0, max(1, size // 5) + 1))
            b = np.concatenate((a[cut:], rng.integers(0, 1 << 60, int(rng.integers(0, cut + 1))).astype(np.uint64)))
            a, b = np.unique(a), np.unique(b)
            if like.similar(len(np.intersect1d(a, b)), len(a), len(b)) and len(a) + len(b) != 2 * len(np.intersect1d(a, b)):
                which, keys = jaccard.signatures([a, b], like)
                assert set(keys[which == 0].tolist()) & set(keys[which == 1].tolist())


def test_distinct_documents_keep_one_of_each_class(docs):
    kept = sorted(str(r.doc_id) for r in jaccard.distinct_documents(docs).collect())
    sets, own = plain_classes([r[1] for r in rows()[:-2]], 5, 4, 5)
    want = [str(i) for i, o in enumerate(own) if own.index(o) == i]
    assert kept == sorted([*want, "None"])


def test_distinct_documents_tell_rows_of_one_id_apart(spark):
    a, b, c = prose(31, 40), prose(32, 40), prose(33, 40)
    texts = [(1, a, "x"), (2, a, "y"), (2, b, "z"), (2, b, "z"), (3, c, "p"), (3, c + " more", "q"), (4, None, "r"), (4, "", "s"), (4, None, "r")]
    docs = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, key string, own_key int not null").repartition(2)
    kept = jaccard.distinct_documents(docs)
    assert kept.columns == docs.columns
    rows_ = kept.collect()
    # B stays, one of the two near texts of id 3, and one row without words for id 4 (null and empty share a key).
    assert sorted(r.doc_id for r in rows_) == [1, 2, 3, 4] and [r.text for r in rows_ if r.doc_id == 2] == [b]


def test_cells_join_all_that_is_similar():
    rng = np.random.default_rng(6)
    for turn in range(12):
        like, sets = jaccard.Likeness(3, 4, 5), []
        for base in [rng.integers(0, 4000, int(n)) for n in rng.integers(1, 80, 25)]:
            for _ in range(int(rng.integers(1, 9))):
                own = base.copy()
                own[rng.random(len(own)) < 0.12] = rng.integers(0, 30)
                sets.append(np.unique(own).astype(np.uint64))
        parts = np.arange(len(sets)) if turn % 2 else rng.integers(0, len(sets), len(sets))
        want = parts.copy()
        for i, a in enumerate(sets):
            for j in range(i):
                if want[i] != want[j] and like.similar(len(np.intersect1d(a, sets[j])), len(a), len(sets[j])):
                    want[want == want[i]] = want[j]
        got = parts.copy()
        for i, j in jaccard.Cell(np.concatenate(sets), np.array([len(x) for x in sets]), parts, like).links(held=1 + turn * 50):
            assert like.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))
            got[got == got[i]] = got[j]
        assert (got[:, None] == got[None, :]).tolist() == (want[:, None] == want[None, :]).tolist()


def test_postings_travel_whole():
    rnd = np.random.default_rng(4)
    for bits, n in ((4, 50), (7, 70_000)):
        posts = np.empty(n, jaccard._POST)
        posts["key"] = np.sort(rnd.integers(0, 1 << 63, n).astype(np.uint64)) >> np.uint64(bits)
        posts["node"] = [jaccard.node_of(np.array([i % 66_000])) for i in range(n)]
        back = jaccard.unpacked(jaccard.packed(posts, bits))
        assert (back["node"] == posts["node"]).all()
        assert (back["key"] == posts["key"] << np.uint64(bits) >> np.uint64(16)).all()
    assert len(jaccard.unpacked(b"")) == 0


def test_byte_bpe(docs, empty):
    with open(BYTE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = byte_bpe.Encoder(BYTE, public_tokenizers.PATTERN)
    rnd = random.Random(5)
    alphabet = "ab é\n\t 's'll12　\xa0\x1c\x85 Ω漢🙂.,!<|>  \r\n"
    texts = [r[1] or "" for r in rows()] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    for text in [*texts, "ab" * 4000, "!" * 65, "é" * 32, "\t" * 200]:
        packed = encoder.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == own.encode_ordinary(text)
        assert encoder.decode(packed) == text.encode()
    got = byte_bpe.round_trip_digests(docs, BYTE, public_tokenizers.PATTERN).collect()
    assert {r.decoded_sha256 for r in got} == {hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows()}
    back = byte_bpe.decode(byte_bpe.encode(docs, BYTE, public_tokenizers.PATTERN), BYTE, public_tokenizers.PATTERN)
    assert sorted(bytes(r.data) for r in back.collect()) == sorted((r[1] or "").encode() for r in rows())
    assert byte_bpe.round_trip_digests(empty, BYTE, public_tokenizers.PATTERN).count() == 0


def test_line_templates(spark, docs, empty):
    got = {(r.doc_id, r.source): r for r in templates.drop_recurring(docs).collect()}
    # "same line here" is in three documents: the first keeps it.
    assert got[14, "s"].n_dropped == 0 and got[14, "s"].text.startswith("same line here\n")
    assert got[15, "s"].text.startswith("own ") and got[16, "s"].text.startswith("other ")
    assert got[6, "s"].text is None and got[7, "s"].text == "" and got[13, "s"].text == "12 34\n5 6"
    fields = [(i, f"Posted by user{i} on day {i}\nabout {word} things\n\n" + prose(20 + i, 30)) for i, word in enumerate("abcd")]
    told = {r.doc_id: r for r in templates.drop_recurring(spark.createDataFrame(fields, "doc_id long, text string")).collect()}
    assert [told[i].n_dropped for i in range(4)] == [0, 1, 1, 1]
    assert told[2].text.startswith("about c things\n\n") and told[2].n_lines == 4
    assert templates.drop_recurring(empty).count() == 0


def test_templates_merge_likely_lines():
    lines = ["open file <*> for user ann", "open file <*> for user bob", "close all the open files now", "open file <*> for user ann"]
    assert templates.merge(lines, 0.7) == [0, 0, 1, 0]


def plain_merge(lines, likeness):
    templates_, out = [], []
    for line in (x.split(" ") for x in lines):
        same = [sum(a == b for a, b in zip(t, line)) / len(line) for t in templates_]
        if same and max(same) >= likeness:
            best = same.index(max(same))
            templates_[best] = [a if a == b else templates.FIELD for a, b in zip(templates_[best], line)]
            out.append(best)
        else:
            out.append(len(templates_))
            templates_.append(line)
    return out


@pytest.mark.parametrize("width,likeness", [(3, 0.7), (4, 0.7), (6, 0.7), (10, 0.7), (13, 0.5), (20, 0.7), (10, 1.0)])
def test_looked_up_templates_are_the_plain_ones(width, likeness):
    rnd = random.Random(width)
    lines = [" ".join(["a", "b", "c"] + [rnd.choice(["x", "y", templates.FIELD, f"w{rnd.random()}"]) for _ in range(width - 3)]) for _ in range(600)]
    expected = plain_merge(lines, likeness)
    assert all(templates.merge(lines, likeness, 3, scanned) == expected for scanned in (0, 7, 1000))


def test_large_leaves_keep_their_templates(spark):
    words = [f"w{i}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(1100)]
    texts = [(i, f"Copyright 2024 by {w} all rights reserved\n" + (f"see the {w} of {w} in {w}" if i % 2 else f"ask {w}")) for i, w in enumerate(words)]
    table = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    for leaf_lines in (1000, 3):
        told = {r.doc_id: r.n_dropped for r in templates.drop_recurring(table, leaf_lines=leaf_lines).collect()}
        assert told == {i: int(i > 0) for i in range(1100)}


def test_language(spark, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.train(language.sample(table, ~out, docs_per_label=60))
    told = language.predict(table.where(out), model, ["doc_id", "lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in told) > 0.95 * len(told)
    assert all(0 <= r.score <= 1 for r in told)
    by_label = {r.lang: r for r in table.where(~out).where("length(text) > 300").orderBy("doc_id").limit(200).collect()}
    mixed = [w for lang in ("en", "de") for w in language.words_of(by_label[lang].text)[:40]]
    labels = [label for _, label in model.word_labels(" ".join(mixed))]
    assert labels[:40].count("en") > 30 and labels[40:].count("de") > 30
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?")], "doc_id long, text string")
    assert {(r.lang_pred, r.score) for r in language.predict(odd, model, ["doc_id"]).collect()} == {("und", 0.0)}
    assert language.predict(empty, language.train(language.sample(empty, F.lit(True))), ["doc_id"]).count() == 0


def test_forward_backward_sums_all_paths():
    rng = np.random.default_rng(1)
    emit, move, start = rng.random((1, 4, 3)) + 0.1, rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    want = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        weight = start[path[0]] * np.prod([emit[0, t, y] for t, y in enumerate(path)])
        weight *= np.prod([move[a, b] for a, b in zip(path, path[1:])])
        for t, y in enumerate(path):
            want[t, y] += weight
    got = language.forward_backward(emit, np.array([4]), move, start)
    assert np.allclose(got[0][0], want / want.sum(1, keepdims=True))
    assert np.isclose(got[3][0], np.log(want[0].sum()))


def test_pseudo_likelihood(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    tokens = pseudo.vocabulary(table)
    network = pseudo.train(table, tokens, train_every=1, rounds=3)
    new = pseudo.Network()
    mean = "sum(pseudo_log_likelihood) / sum(n_tokens)"
    learned, before = (pseudo.score(table, tokens, n).selectExpr(mean).first()[0] for n in (network, new))
    assert learned > before + 0.5
    # Probabilities of all tokens at one place sum to one.
    around = np.repeat(np.array([[1], [2], [3], [4]]), pseudo.VOCABULARY, 1)
    assert np.isclose(np.exp(network.log_probabilities(around, np.arange(pseudo.VOCABULARY))).sum(), 1, atol=1e-3)
    told = {r.doc_id: r for r in pseudo.score(docs, tokens, network).collect()}
    assert told[6].n_tokens == 0 and told[6].mean_log_probability is None
    assert told[17].pseudo_log_likelihood == pytest.approx(told[18].pseudo_log_likelihood)
    assert pseudo.score(empty, pseudo.vocabulary(empty), pseudo.train(empty, tokens)).count() == 0


def test_every_word_has_its_own_probability(spark):
    words = [(f"w{i}", 1 + i % 7) for i in range(9000)]
    table = spark.createDataFrame([(i, " ".join([w] * n)) for i, (w, n) in enumerate(words)], "doc_id long, text string").repartition(4)
    known = pseudo.vocabulary(table)
    hashes = word_hashes([w.encode() for w, _ in words])[0]
    token, part = known.look(hashes)
    # The words of a token share it in full, by their counts.
    assert np.allclose(np.bincount(token, np.exp(part.astype(float)))[np.unique(token)], 1, atol=1e-3)
    counts, weights = np.array([n for _, n in words]), np.bincount(token, [n for _, n in words])
    assert np.allclose(np.exp(part), counts / weights[token], rtol=1e-3)
    # The vocabulary grows with the corpus: 6 of 7 words occur twice or more.
    assert len(known.words) == sum(n > 1 for _, n in words)
    assert len(pseudo.vocabulary(table.where("doc_id < 700")).words) == 600


def test_all_documents_are_learned_from(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("pmod(xxhash64(text), 16) <> 0").repartition(4)
    known, new = pseudo.vocabulary(table), pseudo.Network()
    network = pseudo.train(table, known)
    mean = "sum(pseudo_log_likelihood) / sum(n_tokens)"
    learned, before = (pseudo.score(table, known, n).selectExpr(mean).first()[0] for n in (network, new))
    assert learned > before + 0.5


def test_fingerprints(spark, docs, empty):
    plain = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in plain]
    want = []
    for r, text, following in zip(plain, texts, texts[1:] + texts[:1]):
        changed = fingerprint.edited(text, following)
        prints = [fingerprint.fingerprint(t) for t in (text, changed, following)]
        sha = hashlib.sha256(changed.encode()).hexdigest()
        want.append((str(r[0]), len(text), sha, prints[0], prints[1], fingerprint.likeness(*prints[:2]), fingerprint.likeness(prints[0], prints[2])))
    got = fingerprint.with_next(docs).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in got) == sorted(want)
    assert fingerprint.with_next(empty).count() == 0
    one = fingerprint.with_next(docs.where("doc_id = 20")).first()
    assert one.near_next == 1.0


def test_tree_locates_an_edit(spark):
    lines = [prose(i, 8) for i in range(40)]
    changed = [*lines[:20], "something else", *lines[21:]]
    a, b = (fingerprint.tree(spark.createDataFrame([(1, "\n".join(x))], "doc_id long, text string")) for x in (lines, changed))
    found = sorted((r.level, r.idx) for r in fingerprint.edits(a, b).collect())
    assert found == [(0, 0), (1, 1), (2, 20)]
    near = fingerprint.likeness(*(fingerprint.fingerprint("\n".join(x)) for x in (lines, changed)))
    assert 0.8 < near < 1


def test_scores_do_not_depend_on_partitions(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    repeated = table.where("doc_id = 3")
    long = spark.createDataFrame([(-1, prose(4, 70_000)), (None, prose(5, 40))], "doc_id long, text string")
    table = table.select("doc_id", "text").unionByName(repeated.select("doc_id", "text")).unionByName(long)
    found = []
    for n in (1, 4, 64):
        own = table.repartition(n)
        known = pseudo.vocabulary(own)
        told = pseudo.score(own, known, pseudo.train(own, known, rounds=1, shard=1 << 16)).collect()
        found.append(sorted((str(r.doc_id), r.n_tokens, r.pseudo_log_likelihood) for r in told))
    for other in found[1:]:
        assert [x[:2] for x in other] == [x[:2] for x in found[0]]
        assert np.allclose([x[2] for x in other], [x[2] for x in found[0]], rtol=1e-6)


def test_score_is_the_plain_sum(spark):
    texts = [(i, prose(i, 20 + i)) for i in range(6)]
    table = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    known = pseudo.vocabulary(table)
    network = pseudo.train(table, known, rounds=1)
    told = {r.doc_id: r.pseudo_log_likelihood for r in pseudo.score(table, known, network).collect()}
    for i, text in texts:
        hashes = [word_hashes([w.encode()], lower=True)[0] for w in text.split()]
        tokens = [int(known.look(h)[0][0]) for h in hashes]
        padded = [pseudo.VOCABULARY] * pseudo.REACH + tokens + [pseudo.VOCABULARY] * pseudo.REACH
        total = 0.0
        for at, (token, h) in enumerate(zip(tokens, hashes)):
            places = [padded[at + pseudo.REACH + d] for d in range(-pseudo.REACH, pseudo.REACH + 1) if d]
            hidden = np.tanh(sum(network.inside[p][t].astype(float) for p, t in enumerate(places)))
            hidden = np.append(hidden, 1.0)
            c, m = divmod(token, pseudo.VOCABULARY // pseudo.CLASS)
            for scores, own in ((hidden @ network.upper, c), (hidden @ network.lower[c], m)):
                total += scores[own] - np.log(np.exp(scores).sum())
            total += float(known.look(h)[1][0])
        assert told[i] == pytest.approx(total, rel=1e-4)


def test_families_of_many_blocks_lose_no_link(spark):
    rng = np.random.default_rng(8)
    sets = []
    for size in (1, 2, 3, 5, 8, 13, 21, 34, 55, 60, 69, 86, 100):
        own = rng.integers(0, 1 << 60, size).astype(np.uint64)
        for _ in range(12):
            fresh = rng.integers(0, 1 << 60, size).astype(np.uint64)
            sets.append(np.unique(np.where(rng.random(size) < rng.choice([0, 0.05, 0.12, 0.4]), fresh, own)))
            sets.append(np.unique(np.concatenate((own, fresh[: max(1, size // 6)]))))
    like = jaccard.Likeness()
    sets = list({x.tobytes(): x for x in sets}.values())
    names = [jaccard.node_of(x) for x in sets]
    table = spark.createDataFrame([(bytearray(n), len(x), bytearray(x.tobytes())) for n, x in zip(names, sets)], "node binary, size long, members binary")
    near = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in zip(names, names[1:])], "a binary, b binary")
    roots = spark.createDataFrame([], "node binary, root binary")
    want = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if want[i] != want[j] and like.similar(len(np.intersect1d(x, y)), len(x), len(y)):
                want = [want[j] if w == want[i] else w for w in want]
    for block in (40, 400, 1 << 20):
        got = list(range(len(sets)))
        place = {n: i for i, n in enumerate(names)}
        for r in jaccard.links_between(table, near, roots, like, block).collect():
            i, j = place[bytes(r.a)], place[bytes(r.b)]
            assert like.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))
            got = [got[j] if g == got[i] else g for g in got]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_families_are_compared_in_rounds_of_bounded_size(spark, monkeypatch):
    rng = np.random.default_rng(9)
    own = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < 0.1, rng.integers(0, 1 << 60, 60).astype(np.uint64), own)) for _ in range(60)]
    names = [jaccard.node_of(x) for x in sets]
    table = spark.createDataFrame([(bytearray(n), len(x), bytearray(x.tobytes())) for n, x in zip(names, sets)], "node binary, size long, members binary")
    near = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in zip(names, names[1:])], "a binary, b binary")
    roots = spark.createDataFrame([], "node binary, root binary")
    rounds = []

    def counted(df, name):
        rounds.append(name)
        return stage(df, name)

    monkeypatch.setattr(jaccard, "stage", counted)

    def found(least_round):
        rounds.clear()
        links = jaccard.links_between(table, near, roots, jaccard.Likeness(), 400, least_round).collect()
        return {(bytes(r.a), bytes(r.b)) for r in links}, rounds.count("round")

    one, many = found(1 << 30), found(1)
    assert one[0] and many[0] == one[0]
    # A set goes to about as many cells as there are blocks, nine; no round moves much more than all sets hold.
    assert one[1] == 1 and many[1] >= 8


def test_log_softmax_of_one_place():
    scores = np.random.default_rng(4).standard_normal((700, pseudo.CLASS)).astype(np.float32) * 30
    places = np.arange(700) % pseudo.CLASS
    whole = scores - scores.max(1, keepdims=True)
    want = whole - np.log(np.exp(whole).sum(1, keepdims=True))
    assert np.array_equal(pseudo.Network.log_softmax_of(scores.copy(), places), want[np.arange(700), places])
