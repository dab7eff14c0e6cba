"""Spelling variants, fill in the middle and WARC against plain versions."""

import base64
import collections
import gzip
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedcore.llm import fim, spelling, warc
from feedcore.session import shared_folder

# Extra columns have names that the operators use themselves, one of them not nullable.
DOCS = "doc_id long, text string, n long, form string, word string, region int not null, role string, output string"


def table(spark, texts, schema=DOCS):
    return spark.createDataFrame([(*r, 1, "f", "w", 2, "r", "o") for r in texts], schema).repartition(3)


# ---------------------------------------------------------------- spelling


def plain_words(rows, every):
    counts = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if key is None else key}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts):
    forms, out = {}, {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best and counts[best] >= 2 * n else None
        out[w] = (n, len(near))
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, *out[w], counts[forms[w]] if forms[w] else None)
    return out


def spelt(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def documents():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abÀéÿ×z") for _ in range(rnd.randint(3, 9))) for _ in range(150)]
    words += [w[:2] + rnd.choice("abé") + w[3:] for w in words] + [w + "a" for w in words[:60]]
    rows = [(i, " ".join(rnd.choices(words, range(1, len(words) + 1), k=300)).replace("a", rnd.choice("aA"))) for i in range(30)]
    rows += [(40, None), (41, ""), (None, "words Words wordS, word5 naïve " * 3), (42, "x" * 3000 + " " + "x" * 2999), (42, "x" * 3000)]
    return [*rows, rows[0], rows[-1], (43, "y" * 200_000), (44, "x" * 2999 + " " + "x" * 2999 + "-" + "x" * 3000)]


@pytest.mark.parametrize("region", [8, spelling.REGION])
def test_spelling(spark, region):
    rows = documents()
    found = spelling.runs(table(spark, rows))
    counts = spelling.count_words(found, spelling.misspelt(found, 7))
    want = plain_words(rows, 7)
    assert {r.word: r.n for r in counts.collect()} == want
    assert "x" * 2999 in want or "x" * 3000 in want
    if region < 100:
        trees = spelling.plan_trees(counts, region)
        assert max(len(t) for t in trees.values()) >= 5
    assert spelt(spelling.groups(counts, region=region)) == plain_groups(want)


def test_spelling_empty(spark):
    found = spelling.runs(table(spark, []))
    assert spelling.groups(spelling.count_words(found, F.col("run"))).collect() == []
    assert spelling.groups(spark.createDataFrame([], "word string, n int")).collect() == []


def test_spelling_ties_chain_and_anagrams(spark):
    counts = {"aaaab": 1, "aaaac": 2, "aaaad": 2, "aaaadd": 5, "eaaadd": 11, "baaaa": 9, "abaaa": 9}
    counts |= {f"{a}{b}zzzz": 7 for a in "pqrst" for b in "pqrst"}
    df = spark.createDataFrame(list(counts.items()), "word string, n int")
    assert spelt(spelling.groups(df, region=2)) == plain_groups(counts)


def test_box_distance_is_a_bound():
    rnd = np.random.default_rng(5)
    words = rnd.choice(np.frombuffer(b"abcde\xe9\xc9", np.uint8), (400, 7))
    codes = spelling.points(words)
    pairs = {(min(a, b), max(a, b)) for r, q, p in spelling.near_pairs(words, words[:0], words[:0]) for a, b in zip(q, p)}
    assert pairs == {(i, j) for i in range(400) for j in range(i + 1, 400) if (words[i] != words[j]).sum() == 1}
    assert (spelling.beyond(codes, codes) == 0).all()


# ---------------------------------------------------------------- fill in the middle


def texts():
    rnd = random.Random(9)
    own = ["".join(rnd.choice("ab \n.!é漢😀\r\x00") for _ in range(rnd.choice([1, 2, 63, 64, 65, 300]))) for _ in range(60)]
    special = [None, "", "\n", "\n\n\n", "no end", "has <P> in it\nb\n", "<S>", "a\n<M>", "<P\n>\n<", "S>\n<", "<\n<P \n"]
    return list(enumerate([*own, *special, "long line\n" * 60_000, "x" * 400_000])) + [(None, "a\nb\n"), (3, own[3])]


def plain_cut(key, text, pattern, rate=100, spm=50):
    text = text or ""
    units = re.findall(pattern, text)
    h = hashlib.sha256(f"7:{'null' if key is None else key}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    i, j = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(m in text for m in fim.MARKERS) or h[2] % 100 >= rate:
        return key, len(units), "plain", None, None, text, text
    if h[3] % 100 < spm:
        return key, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}", text
    return key, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}", text


@pytest.mark.parametrize(
    "unit, pattern, rate", [("line", r"[^\n]*\n|[^\n]+", 100), ("sentence", r"[^\n.!?]*[\n.!?]|[^\n.!?]+", 60), ("word", r"[^\n \t]*[\n \t]|[^\n \t]+", 100)]
)
def test_fill_in_middle(spark, unit, pattern, rate):
    cut = fim.transform(table(spark, texts()), unit, rate)
    got = sorted((tuple(r) for r in cut.withColumn("text", fim.restored("output", "form")).collect()), key=repr)
    assert got == sorted((plain_cut(k, t, pattern, rate) for k, t in texts()), key=repr)


def test_fill_in_middle_other_markers(spark):
    docs = table(spark, [(i, f"one.\\E two|three\n$1 four {i}\nfive") for i in range(50)])
    marks = ("[|PRE.*", "[|SUF$", "[|MID")
    cut = fim.transform(docs, markers=marks).withColumn("back", fim.restored("output", "form", marks))
    assert {r.back for r in cut.collect()} == {r.text for r in docs.collect()}
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.transform(docs, markers=bad)
    assert fim.transform(table(spark, [])).collect() == []


def test_wavelet_ranks():
    codes = np.random.default_rng(1).integers(0, 4, 1000).astype(np.uint8)
    matrix = fim.WaveletMatrix(codes)
    at = np.arange(1001)
    for number in range(4):
        assert matrix.rank(number, at).tolist() == [0, *np.cumsum(codes == number).tolist()]


# ---------------------------------------------------------------- WARC

PAGES = "page_id long, url string, html string, offset long, archive string not null"


def pages():
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(i, f"https://h/{i % 7}", f"<p>{i % 5} é</p>") for i in range(60)]
    rows += [(100, None, None), (101, "https://h/a b\r\nX: 1", ""), (102, "u", fake), (103, "u", fake * 2), (104, "u", "\r\n\r\n" + fake)]
    rows += [(105, "u", "\x1f\x8b" + "é漢" * 400_000), (106, "u", "line\r\n\r\n"), (None, "u", "lone"), (None, "u", "<p>1 é</p>"), (7, "v", "other 7")]
    return [*rows, rows[0], (107, "u", " "), (108, "u", " ")]


def described(rows, min_bytes=0):
    body = lambda r: (r[2] or "").encode()
    first = {}
    for r in rows:
        if r[0] is not None and len(body(r)) >= min_bytes:
            first[body(r)] = min(first.get(body(r), r[0]), r[0])
    out = []
    for r in rows:
        least = first.get(body(r))
        refers = least if least is not None and (r[0] is None or r[0] > least) else None
        digest = base64.b32encode(hashlib.sha1(body(r)).digest()).decode()
        out.append((r[0], len(body(r)), digest, "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def read_back(found):
    page, first = warc.page_of("record_id"), warc.page_of("refers_to_id")
    return found.select(page.alias("p"), "payload_bytes", "payload_digest", "record_type", first.alias("r"), "payload")


@pytest.mark.parametrize("min_bytes, limit", [(0, 100_000), (8, 0)])
def test_warc_round_trip(spark, monkeypatch, min_bytes, limit):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", limit)
    df = spark.createDataFrame([(*r, 1, "a") for r in pages()], PAGES).repartition(3)
    rows = read_back(warc.round_trip(df, min_bytes)).collect()
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == described(pages(), min_bytes)
    payloads = {bytes(r.payload): r.payload_digest for r in rows if r.record_type == "response"}
    assert set(payloads) == {(r[2] or "").encode() for r in pages()}
    assert all(hashlib.sha1(t).digest() == base64.b32decode(d) for t, d in payloads.items())
    assert all(r.payload is None for r in rows if r.record_type == "revisit")


def test_warc_normalised_file(spark):
    df = spark.createDataFrame([(*r, 1, "a") for r in pages()], PAGES).repartition(2)
    raw, target = shared_folder(spark, "raw"), shared_folder(spark, "warc")
    warc.write_archives(df, raw, per_file=20)
    files = warc.normalise(spark, raw, target).collect()
    assert sum(f.records for f in files) == len(pages()) and len(files) >= 4
    index = warc.read_index(spark, target).collect()
    for f in files:
        data = open(f"{target}/{f.archive}", "rb").read()
        own = sorted((r for r in index if r.archive == f.archive), key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1]) and f.bytes == len(data)
        for r in own:
            member = zlib.decompressobj(31)
            text = member.decompress(data[r.offset : r.offset + r.length])
            assert member.eof and not member.unused_data
            assert text.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode()) and text.endswith(b"\r\n\r\n")
    # A chosen part of the index, in many small runs; and repeating the work leaves the same files.
    wanted = warc.read_index(spark, target).where("record_type = 'revisit'")
    assert read_back(warc.read_archives(spark, target, wanted, split=100)).count() == wanted.count() > 5
    warc.normalise(spark, raw, target)
    assert warc.read_index(spark, target).count() == len(pages())
    assert read_back(warc.read_archives(spark, target)).count() == len(pages())


def test_warc_streams():
    record = b"WARC/1.0\r\nContent-Length: 3000000\r\nWARC-Type: resource\r\n\r\n" + b"ab" * 1_500_000 + b"\r\n\r\n"
    whole = gzip.compress(record + record)
    many = gzip.compress(record) + gzip.compress(b"") + gzip.compress(record) + b"\0" * 100
    for data in (whole, many):
        out = io.BytesIO()
        assert [(k, i) for _, _, k, i in warc.rewrite(io.BytesIO(data), out)] == [("resource", "")] * 2
        assert gzip.decompress(out.getvalue()) == record + record
    assert list(warc.rewrite(io.BytesIO(b""), io.BytesIO())) == []
    for broken in (whole[:-20], gzip.compress(record[:-2_000_000]), gzip.compress(b"GET / HTTP"), gzip.compress(b"no WARC record\r\n\r\n")):
        with pytest.raises(ValueError):
            list(warc.rewrite(io.BytesIO(broken), io.BytesIO()))


def test_warc_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []
