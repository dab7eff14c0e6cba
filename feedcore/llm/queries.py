"""The registered queries of this folder: whole tables in, whole results out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedcore.llm import byte_bpe, chat, fim, fingerprint, jaccard, language, packing, pseudo, spelling, substrings
from feedcore.llm import templates, vectors, warc
from feedcore.llm.common import read_table


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=2)


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(read_table(spark, folder, "documents")).drop("removed_spans")


def op3_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.read_back(chat.format_log(chat.log_of_turns(rows.unionByName(own))))


def op4_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.classes(read_table(spark, folder, "documents"), jaccard.Likeness(words=3, num=90, den=100))


def op5_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.nearest(read_table(spark, folder, "embeddings"), F.col("id") % 50 == 0, k=5)


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return byte_bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    told = templates.drop_recurring(docs)
    return told.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    model, _ = language.learn(docs, ~held_out() & F.col("doc_id").isNotNull())
    told = language.predict(docs, model, ["doc_id"])
    return told.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    tokens = pseudo.vocabulary(docs)
    return pseudo.score(docs, tokens, pseudo.train(docs, tokens))


def op10_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.with_next(read_table(spark, folder, "documents"))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    found = spelling.runs(read_table(spark, folder, "documents"))
    return spelling.groups(spelling.count_words(found, spelling.misspelt(found, 97)))


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    cut = fim.transform(read_table(spark, folder, "documents"))
    rebuilt = F.sha2(fim.restored("output", "form"), 256)
    told = cut.withColumn("restored_sha256", rebuilt).withColumn("output_sha256", F.sha2("output", 256))
    return told.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.round_trip(read_table(spark, folder, "pages"))
    page, first = warc.page_of("record_id"), warc.page_of("refers_to_id")
    return found.select(page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", first.alias("refers_to"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, folder)


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_substring_dedup,
        op3_chat_formatting,
        op4_ngram_jaccard,
        op5_nearest_neighbours,
        op6_byte_bpe,
        op7_line_dedup,
        op8_language_id,
        op9_lm_scoring,
        op10_document_fingerprints,
        op11_spelling_variants,
        op12_fill_in_middle,
        op13_warc,
        pipeline,
    )
}
ORACLES = {
    "op2_substring_dedup": r"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS row, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
w AS (
  SELECT row, pos, md5(array_to_string(words[pos : pos + 34], ' ')) AS digest
  FROM (SELECT row, words, unnest(range(1, len(words) - 33)) AS pos FROM d WHERE len(words) >= 35)),
again AS (SELECT digest FROM w GROUP BY digest HAVING count(*) > 1),
starts AS (SELECT row, list(pos) AS spots FROM w JOIN again USING (digest) GROUP BY row),
gone AS (
  SELECT row, list(DISTINCT word) AS gone
  FROM (SELECT row, unnest(range(s, s + 35)) AS word FROM (SELECT row, unnest(spots) AS s FROM starts))
  GROUP BY row),
kept AS (
  SELECT d.row, string_agg(word, ' ' ORDER BY d.i) AS text
  FROM (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d) AS d
  LEFT JOIN (SELECT row, unnest(gone) AS i, true AS hit FROM gone) AS g ON g.row = d.row AND g.i = d.i
  WHERE hit IS NULL GROUP BY d.row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
       CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN gone ON gone.row = d.row LEFT JOIN kept ON kept.row = d.row
""",
    "op11_spelling_variants": r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)
              ORDER BY i) AS steps FROM range(256) AS t(i)),
raw AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS times FROM raw GROUP BY doc_id, run),
hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(
    flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128
      THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)]::BIGINT[] END)),
    lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1]), 4294967295)) AS h
  FROM runs, crc),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
         sum(times)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(times) >= 3),
cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n FROM cut AS a JOIN cut AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut AS a JOIN words AS b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut AS a JOIN words AS b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, min(near) FILTER (n = top) AS near, any_value(top) AS top
  FROM (SELECT *, max(n) OVER (PARTITION BY word) AS top FROM near) GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * w.n THEN near END AS form,
         CASE WHEN top >= 2 * w.n THEN top END AS form_n
  FROM words AS w LEFT JOIN best AS b ON b.word = w.word),
walk AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT walk.word, form FROM walk JOIN forms ON forms.word = walk.at WHERE form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM forms AS f JOIN walk ON walk.word = f.word JOIN forms AS last ON last.word = walk.at AND last.form IS NULL
""",
    "op12_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256('7:' || doc_id) AS h FROM documents),
h AS (
  SELECT doc_id, text, units, len(units) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS x,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS y,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS rate, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS kind
  FROM d),
p AS (
  SELECT *, array_to_string(units[1 : least(x, y)], '') AS pre, array_to_string(units[least(x, y) + 1 : greatest(x, y)], '') AS mid,
         array_to_string(units[greatest(x, y) + 1 :], '') AS suf,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR rate >= 100 THEN 'plain'
              WHEN kind < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM h)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
""",
    "op13_warc": r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha1(coalesce(html, '')) AS h FROM pages),
coded AS (
  SELECT page_id, size, h, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(h, CAST(10 * (i // 8) + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) + 1, 1)), '')
    AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first
  FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM coded
""",
}
