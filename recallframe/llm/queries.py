"""Queries of the training-data operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bytecnn, capfilters, decontaminate, jaccard, langmix, licenses, mixing, packing, passages, repair, severity, spelling
from .common import id_text


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents")).drop("places")


def collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_read(spark, sf_dir, "documents"))


def cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.near_duplicate_vectors(_read(spark, sf_dir, "embeddings"))


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(_read(spark, sf_dir, "documents"))


def language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held = f"{id_text('doc_id')} % 3 = 1"
    model = langmix.fit_languages(docs.where(f"not ({held})"))
    found = langmix.identify_languages(docs, model)
    return found.select("doc_id", F.expr(held).alias("held_out"), "lang_pred", "score", F.array_join("langs", ",").alias("langs"))


def poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return mixing.shuffled(mixing.replicate(docs)).select(*docs.columns, "mix_count", "mix_copy")


def byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    net = bytecnn.fit_quality(docs, _read(spark, sf_dir, "labels"))
    held = F.expr(f"{id_text('doc_id')} % 5 = 0")
    return bytecnn.score_quality(docs, net).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= bytecnn.THRESHOLD).cast("int").alias("predicted"))


def ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = severity.fit_severity(docs, _read(spark, sf_dir, "labels"))
    held = F.expr(f"{id_text('doc_id')} % 5 = 0")
    return severity.score_severity(docs, model).select("doc_id", held.alias("held_out"), "severity", "grade", "score", "toxic")


def best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_file(), digest=packing.ids_crc32, digest_field="ids_crc32 long")


def audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.audio_columns(_read(spark, sf_dir, "documents"), keep_media=False)


def structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(_read(spark, sf_dir, "conversations"))


def spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_read(spark, sf_dir, "documents"))


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": license_scan,
    "op2_collinear_passages": collinear_passages,
    "op3_cap_filters": cap_filters,
    "op4_jaccard_join": jaccard_join,
    "op5_language_mixture": language_mixture,
    "op6_poisson_mix": poisson_mix,
    "op7_byte_cnn": byte_cnn,
    "op8_ordinal_toxicity": ordinal_toxicity,
    "op9_best_fit_pack": best_fit_pack,
    "op10_audio_features": audio_features,
    "op11_structure_repair": structure_repair,
    "op12_spelling_variants": spelling_groups,
    "op13_benchmark_decontamination": benchmark_decontamination,
}

_COMPONENTS = """
both_ways AS (SELECT a AS x, b AS y FROM links UNION SELECT b, a FROM links),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON r.y = e.x),
comp AS (SELECT x, least(x, min(y)) AS c FROM reach GROUP BY x)
"""

#: crc32 of the text in column k: a table of 256 entries (crc_table), then byte by byte.
_CRC_TABLE = "crc_table AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS tab FROM range(256) r(i))"
_CRC_OF = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode({k})) + 1), lambda i: ('0x' || substr(hex(encode({k})), 2 * i - 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"""

ORACLES: dict[str, str] = {
    "op3_cap_filters": f"""
WITH RECURSIVE links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM embeddings p JOIN embeddings q ON p.label = q.label AND p.vec_id < q.vec_id
  WHERE list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= {capfilters.COSINE}
), {_COMPONENTS}, degree AS (SELECT x, count(*) AS n FROM both_ways GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN comp ON comp.x = vec_id LEFT JOIN degree ON degree.x = vec_id
""",
    "op4_jaccard_join": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id), pairs AS (
  SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS i FROM shingles p JOIN shingles q ON p.s = q.s AND p.doc_id < q.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b WHERE 100 * i >= 80 * (m.n + n.n - i)
), {_COMPONENTS}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN comp ON comp.x = d.doc_id
""",
    "op6_poisson_mix": f"""
WITH sizes AS (SELECT source, count(*) AS d FROM documents GROUP BY source),
total AS (SELECT sum(pow(d, {mixing.TEMPERATURE})) AS w, sum(d) AS n FROM sizes),
rates AS (SELECT source, pow(d, {mixing.TEMPERATURE}) / w * n / d AS rate FROM sizes, total),
parts AS (SELECT source, greatest(1, ceil(rate / {mixing.PART_MEAN}))::INT AS parts, rate / greatest(1, ceil(rate / {mixing.PART_MEAN})) AS m FROM rates),
cdf AS (SELECT source, sum(exp(k * ln(m) - m - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM parts, range(0, {mixing.TERMS}) t(k)),
draws AS (
  SELECT doc_id, d.source, ('0x' || substr(md5('{mixing.SEED}:' || doc_id || ':' || j), 1, {mixing.DIGITS}))::BIGINT / {float(16**mixing.DIGITS)!r} AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, unnest(range(1, parts + 1)) t(j)
), counts AS (SELECT doc_id, count(*) AS n FROM draws JOIN cdf ON draws.source IS NOT DISTINCT FROM cdf.source AND c <= u GROUP BY doc_id)
SELECT d.*, n::INT AS mix_count, unnest(range(0, n))::INT AS mix_copy FROM documents d JOIN counts USING (doc_id)
""",
    "op11_structure_repair": rf"""
WITH RECURSIVE {_CRC_TABLE}, raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), fated AS (SELECT raw.*, {_CRC_OF.format(k="k")} % 20 AS fate FROM raw, crc_table),
left_over AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(0, CASE fate WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM fated WHERE fate <> 0
), numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM left_over),
marked AS (
  SELECT conv_id, turn, i, role, text, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS step,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM numbered
), told AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (step NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id
), keeps(initial, p, q) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('a', 2, 3), ('u', 3, 2)),
wanted(p, q, line) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
inserts(p, q, cost, audit, lines) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']),
  (3, 2, 5, 'I', ['user:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])),
edits AS (
  SELECT conv_id, i, p, p AS q, 2 AS cost, 'D' AS audit, []::VARCHAR[] AS lines FROM marked, wanted
  UNION ALL SELECT conv_id, i, p, q, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, 'K', [role || ':' || text] FROM marked JOIN keeps USING (initial) WHERE fault IN ('', 'truncated')
  UNION ALL SELECT conv_id, i, p, q, CASE fault WHEN 'truncated' THEN 6 ELSE 1 END, 'R', [line || ':' || text] FROM marked, wanted WHERE fault IN ('', 'truncated')
), paths(conv_id, i, q, best) AS (
  SELECT conv_id, 0::BIGINT, q, {{'cost': cost, 'audit': audit, 'lines': lines}} FROM told, inserts WHERE p = 0
  UNION ALL
  SELECT e.conv_id, e.i, s.q, min({{'cost': best.cost + e.cost + s.cost, 'audit': best.audit || e.audit || s.audit, 'lines': best.lines || e.lines || s.lines}})
  FROM paths JOIN edits e ON e.conv_id IS NOT DISTINCT FROM paths.conv_id AND e.i = paths.i + 1 AND e.p = paths.q JOIN inserts s ON s.p = e.q GROUP BY e.conv_id, e.i, s.q
), ended AS (SELECT told.conv_id, min(best) AS best FROM told JOIN paths ON paths.conv_id IS NOT DISTINCT FROM told.conv_id AND paths.i = n AND q IN (0, 3) GROUP BY told.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM c.conv_id
""",
    "op12_spelling_variants": rf"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= {spelling.MIN_LENGTH} GROUP BY ALL
), hashed AS (SELECT run, n, {_CRC_OF.format(k="coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc_table),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % {spelling.DAMAGE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= {spelling.MIN_LENGTH} GROUP BY word HAVING sum(n) >= {spelling.MIN_COUNT}
), holes AS (SELECT word, n, unnest(list_transform(range(0, length(word)), lambda i: substr(word, 1, i) || '*' || substr(word, i + 2))) AS hole FROM words),
pairs AS (
  SELECT a.word AS a, b.word AS b, b.n AS n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON replace(a.hole, '*', '') = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON replace(a.hole, '*', '') = b.word
), best AS (SELECT a, count(*) AS n_near, max(n) AS top FROM pairs GROUP BY a),
forms AS (SELECT a, min(b) AS form, any_value(top) AS form_n FROM pairs JOIN best USING (a) JOIN words ON words.word = a WHERE pairs.n = top AND top >= {spelling.RATIO} * words.n GROUP BY a),
up(word, root, step) AS (SELECT a, form, 1 FROM forms UNION ALL SELECT up.word, forms.form, step + 1 FROM up JOIN forms ON forms.a = up.root),
roots AS (SELECT word, arg_max(root, step) AS root FROM up GROUP BY word)
SELECT w.word, form, coalesce(root, w.word) AS root, n, coalesce(n_near, 0)::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM words w LEFT JOIN best ON best.a = w.word LEFT JOIN forms ON forms.a = w.word LEFT JOIN roots ON roots.word = w.word
""",
    "op13_benchmark_decontamination": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{decontaminate.WORD}') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{decontaminate.WORD}') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, m, unnest(list_transform(range(0, len(w) - m + 1), lambda i: array_to_string(w[i + 1:i + m], ' '))) AS s
  FROM (SELECT *, least(len(w), {decontaminate.WINDOW}) AS m FROM b WHERE len(w) > 0)
), tried AS (
  SELECT doc_id, m, unnest(list_transform(range(0, len(w) - m + 1), lambda i: {{'i': i, 's': array_to_string(w[i + 1:i + m], ' ')}})) AS x FROM d, (SELECT DISTINCT m FROM wins)
), hits AS (SELECT doc_id, x.i AS i, wins.m AS m, item_id FROM tried JOIN wins ON x.s = wins.s),
places AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(places.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
