"""Near copies in a table where most texts share a phrase with an unrelated one."""

import random
from collections import Counter

import numpy as np
import pytest
from feedcore.llm import jaccard
from plain_texts import plain_classes


def phrased(n: int) -> list[str]:
    """Texts of words of their own and a few of the same phrases, some of them with near copies."""
    rnd = random.Random(21)
    phrases = [" ".join(rnd.choices("abcdefgh", k=7)) for _ in range(6)]
    texts = []
    for i in range(n):
        own = [f"w{i}x{k}" for k in range(rnd.randint(30, 70))]
        for phrase in rnd.sample(phrases, 4):
            own.insert(rnd.randrange(len(own)), phrase)
        texts.append(" ".join(own))
        for copy in range(2 * (i % 40 == 0)):
            texts.append(" ".join([f"n{copy}", *own]))
    return texts


def test_texts_that_share_phrases_are_not_compared(spark, monkeypatch):
    texts = phrased(400)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    like, seen = jaccard.Likeness(), {}
    verified = jaccard.verified

    def counted(pairs, sets, like):
        seen["sets"] = sets.count()
        return verified(pairs, sets, like)

    monkeypatch.setattr(jaccard, "verified", counted)
    monkeypatch.setattr(jaccard, "HELD_BYTES", 5_000)
    got = {r.doc_id: r.component_id for r in jaccard.classes(docs, like).collect()}
    _, own = plain_classes(texts, like.words, like.num, like.den)
    assert got == {i: own.index(o) for i, o in enumerate(own)}
    keyed = {r.a for r in jaccard.index(docs, like, 4).where("kind = 'pair'").collect()}
    # Leaders alone are more than the near copies; only near copies and what they are copied from are held.
    assert len(keyed) > 30 and seen["sets"] == 30


@pytest.mark.parametrize("num,den", [(4, 5), (90, 100), (1, 2)])
def test_similar_sets_share_a_rare_member(num, den):
    rng = np.random.default_rng(num)
    like = jaccard.Likeness(5, num, den)
    for _ in range(20):
        sets = []
        for base in [rng.integers(0, 300, int(n)) for n in rng.integers(1, 60, 12)]:
            for _ in range(int(rng.integers(1, 5))):
                sets.append(np.unique(np.where(rng.random(len(base)) < rng.choice([0, 0.03, 0.1, 0.3]), rng.integers(0, 3000), base)))
        sets = [x.astype(np.uint64) for x in {x.tobytes(): x for x in sets}.values()]
        times = Counter(x for s in sets for x in s.tolist())
        flat, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
        counts = np.array([min(times[x], 3 if num == 1 else 255) for x in flat.tolist()], np.uint8)
        which, keys = jaccard.rarest(flat, sizes, counts, like)
        rare = [set(keys[which == i].tolist()) for i in range(len(sets))]
        for i, a in enumerate(sets):
            assert rare[i] <= {x for x in a.tolist() if times[x] > 1}
            if sum(times[x] > 1 for x in a.tolist()) * den < num * len(a):
                assert not rare[i]
            for j in range(i):
                if like.similar(len(np.intersect1d(a, sets[j])), len(a), len(sets[j])):
                    assert rare[i] & rare[j]


def test_members_are_counted_over_all_rows(spark):
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2)
    rows, times = [], Counter()
    for name in (b"a", b"b", b"c"):
        sets = [np.unique(rng.choice(pool[: 400 if i else 5], 60)) for i in range(130)]
        times.update(x for s in sets for x in s.tolist())
        rows.append((bytearray(name), bytearray(b""), bytearray(b""), bytearray(np.concatenate(sets).tobytes())))
    held = spark.createDataFrame(rows, "name binary, nodes binary, sizes binary, members binary").repartition(3)
    found = {}
    for r in sorted(jaccard.counts_of(held, 4).collect(), key=lambda r: r.bucket):
        found[bytes(r.name)] = found.get(bytes(r.name), b"") + bytes(r.counts)
    for name, _, _, members in rows:
        values = np.unique(np.frombuffer(bytes(members), np.uint64)).tolist()
        assert list(found[bytes(name)]) == [min(times[x], 255) for x in values]
