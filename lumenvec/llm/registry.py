"""The queries of the operators and, where SQL can express one, the SQL of its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.llm.ann import nearest_neighbours
from lumenvec.llm.bin_completion import pack_sequences
from lumenvec.llm.chat import rotate_perspectives
from lumenvec.llm.common import table
from lumenvec.llm.decontaminate import find_leaks
from lumenvec.llm.mix import mix_sources
from lumenvec.llm.near_dup import near_duplicates
from lumenvec.llm.packing import pack_documents
from lumenvec.llm.repair import damaged, digests, repair
from lumenvec.llm.repeats import remove_repeats
from lumenvec.llm.shard import shard_documents, temporary_map
from lumenvec.llm.toxic import score_toxicity, train
from lumenvec.llm.url_rules import judge_urls
from lumenvec.llm.variants import spelling_variants

#: The rules of op9.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's perspective; the mask as text ``from-to;from-to``. Null ids and roles are one more each; an empty table gives no rows."""
    out = rotate_perspectives(table(spark, sf_dir, "conversations"))
    return out.withColumn("mask", F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["from"], s["to"])), ";"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item. Null and empty texts hold none; null ids stay null; empty tables give no rows."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector. Odd vectors and null ids take no part; an empty table gives no rows."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new store's map deals slots evenly, as version 1; it is edited for the bytes of the documents and stored as version 2. Null texts have size 1; an empty table gives no rows."""
    return shard_documents(table(spark, sf_dir, "documents"), map_path=temporary_map(spark, 8))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, and for each shard. Null texts have none; a null source is the last; an empty table gives no rows."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.array_join("shard_words", " ").alias("shard_words"), "first_word", "block_words")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labelled ones. Null and empty texts are scored as texts without words; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "toxic")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed token ids; documents without ids, null texts among them, are in no row; an empty table gives no rows."""
    return pack_documents(table(spark, sf_dir, "documents"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without repeated passages. Null texts are empty; null ids stay; an empty table gives no rows."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages. A null url has an empty host and path and the default verdict; an empty table gives no rows."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    return judge_urls(table(spark, sf_dir, "pages"), spark.sql(f"select * from values {values} as rules(verdict, host, path)"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates at 85 percent. Null and empty texts are linked with nothing; an empty table gives no rows."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op11_fewest_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of 2048 ids as the search finds. Null and empty texts are the one id 0; null ids stay; an empty table gives no rows."""
    return pack_sequences(table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, their faults and the cheapest repair. Null ids are a conversation; one that lost all rows has zeros and an empty repair; an empty table gives no rows."""
    turns = table(spark, sf_dir, "conversations")
    report, messages = repair(damaged(turns))
    every = turns.select("conv_id").distinct()
    with_report = every.join(report.withColumnRenamed("conv_id", "__r"), F.col("conv_id").eqNullSafe(F.col("__r")), "left")
    both = with_report.join(digests(messages).withColumnRenamed("conv_id", "__d"), F.col("conv_id").eqNullSafe(F.col("__d")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their forms and roots. Null texts have no words; an empty table gives no rows."""
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chat, op2_decontaminate, op3_ann, op4_shard, op5_mix, op6_toxicity, op7_pack, op8_repeats, op9_urls, op10_near_dup, op11_fewest_sequences, op12_repair, op13_variants)}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_chat"] = r"""
WITH turns AS (
  SELECT conv_id, role, replace(coalesce(text, ''), '<|', '< |') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, replace(coalesce(text, ''), '<|', '< |')) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS n_messages
  FROM conversations),
people AS (SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role IS DISTINCT FROM 'system'),
pieces AS (
  SELECT t.*, place // 1024 AS part, p.perspective, t.role IS NOT DISTINCT FROM p.perspective AS own,
         CASE WHEN t.role IS NOT DISTINCT FROM p.perspective THEN '<|assistant|>' WHEN t.role = 'system' THEN '<|system|>' WHEN t.role IS NULL THEN '<|user|>'
              ELSE '<|user:' || array_to_string(list_transform(string_split(t.role, ''), lambda c: CASE WHEN regexp_matches(c, '^[\p{L}\p{N}_.-]?$') THEN c ELSE '%' || hex(encode(c)) END), '') || '|>' END || chr(10) AS head,
         t.text || '<|end|>' || chr(10) AS body
  FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS spot
  FROM pieces)
SELECT conv_id, perspective, part, part * 1024 AS first_message, cast(count(*) AS INTEGER) AS n_turns, max(n_messages) AS n_messages, string_agg(head || body, '' ORDER BY place) AS rendered,
       coalesce(string_agg(cast(spot AS BIGINT) || '-' || cast(spot + length(body) AS BIGINT), ';' ORDER BY place) FILTER (own), '') AS mask
FROM placed GROUP BY conv_id, perspective, part
"""

ORACLE_SQL["op8_repeats"] = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
starts AS (SELECT r, unnest(range(0, greatest(0, length(h) // 2 - 199))) AS i FROM docs),
keyed AS (SELECT s.r, s.i, md5(substr(d.h, cast(2 * s.i + 1 AS BIGINT), 400)) AS k FROM starts s JOIN docs d USING (r)),
twice AS (SELECT k FROM keyed GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM keyed WHERE k IN (SELECT k FROM twice)),
runs AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM hit),
spans AS (SELECT r, run, min(i) AS a, max(i) + 200 AS b FROM runs GROUP BY r, run),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM spans
         UNION ALL SELECT r, max(b), NULL FROM spans GROUP BY r),
kept AS (SELECT g.r, string_agg(substr(d.h, cast(2 * g.a + 1 AS BIGINT), cast(2 * (coalesce(g.b, length(d.h) // 2) - g.a) AS BIGINT)), '' ORDER BY g.a) AS h FROM gaps g JOIN docs d USING (r) GROUP BY g.r),
sums AS (SELECT r, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY r)
SELECT d.doc_id, cast(length(d.h) // 2 AS BIGINT) AS n_bytes, cast(coalesce(s.removed, 0) AS BIGINT) AS n_removed, cast(coalesce(s.n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM docs d LEFT JOIN sums s USING (r) LEFT JOIN kept k USING (r)
"""

ORACLE_SQL["op9_urls"] = r"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS r
  FROM cut),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT p.r, x.verdict, x.rhost || x.rpath AS rule, row_number() OVER (PARTITION BY p.r ORDER BY length(x.rhost) + length(x.rpath) DESC, length(x.rhost) DESC) AS n
  FROM parts p JOIN rules x ON (p.host = x.rhost OR ends_with(p.host, '.' || x.rhost)) AND starts_with(p.path, x.rpath))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.r = f.r AND f.n = 1
"""

ORACLE_SQL["op10_near_dup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' ')))
                                      WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END) AS s
  FROM words),
sizes AS (SELECT w.doc_id, count(s.s) AS n FROM words w LEFT JOIN shingles s USING (doc_id) GROUP BY w.doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT p.a, p.b FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b WHERE 100 * p.both >= 85 * (x.n + y.n - p.both)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT s.doc_id, s.n AS n_shingles, min(r.c) AS component_id, s.doc_id = min(r.c) AS kept
FROM sizes s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.n
"""

#: DuckDB SQL: a column ``t`` with the table of CRC-32, made by its rule, and the CRC-32 of a text ``{s}`` by that table.
_CRC_TABLE = "(SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
_BYTES = "flatten(list_transform(string_split({s}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [cast(unicode(x) AS BIGINT)] ELSE [cast(192 + (unicode(x) >> 6) AS BIGINT), cast(128 + (unicode(x) & 63) AS BIGINT)] END))"
_CRC = "xor(list_reduce(list_prepend(cast(4294967295 AS BIGINT), " + _BYTES + "), lambda c, b: xor(t[cast((xor(c, b) & 255) + 1 AS BIGINT)], c >> 8)), cast(4294967295 AS BIGINT))"

#: Costs from each state before a row, from those behind it (``a``) and the row's initial and fault; then with insertions before it.
_HERE = [f"least(3 + a.c{q}, CASE WHEN fault < 2 THEN 2 + fault + a.c{n} ELSE 99999999 END, CASE WHEN fault < 2 AND ({keep}) THEN fault + CASE initial {whens} END ELSE 99999999 END)" for q, n, keep, whens in (
    (0, 2, "initial IN ('s', 'u')", "WHEN 's' THEN a.c1 WHEN 'u' THEN a.c2"), (1, 2, "initial = 'u'", "WHEN 'u' THEN a.c2"), (2, 3, "initial = 'a'", "WHEN 'a' THEN a.c3"), (3, 2, "initial = 'u'", "WHEN 'u' THEN a.c2"))]

ORACLE_SQL["op12_repair"] = f"""
WITH RECURSIVE hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format(s="concat(coalesce(cast(conv_id AS VARCHAR), ' '), ':', coalesce(cast(turn AS VARCHAR), ' '))")} % 20 AS kind
  FROM conversations, {_CRC_TABLE} tab),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(0, CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE kind <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged),
placed AS (
  SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN body = '' THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 3 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault
  FROM numbered),
sums AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate,
         count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (i > 1 AND concat(before, initial) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM placed GROUP BY conv_id),
behind(conv_id, i, c0, c1, c2, c3) AS (
  SELECT conv_id, n + 1, 0, 4, 2, 0 FROM sums
  UNION ALL
  SELECT conv_id, i, least(h0, 2 + h2, 4 + h3), least(h1, 2 + h2, 4 + h3), least(h2, 2 + h3), least(h3, 2 + h2)
  FROM (SELECT r.conv_id, r.i, {", ".join(f"{h} AS h{q}" for q, h in enumerate(_HERE))} FROM behind a JOIN placed r ON r.conv_id IS NOT DISTINCT FROM a.conv_id AND r.i = a.i - 1) t),
costs AS (SELECT b.conv_id, b.i, [b.c0, b.c1, b.c2, b.c3] AS c, [a.c0, a.c1, a.c2, a.c3] AS a FROM behind b LEFT JOIN behind a ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND a.i = b.i + 1),
steps AS (
  SELECT c.conv_id, c.i, c.c, c.a, p.role, p.text, p.initial, p.fault, p.i IS NULL AS over FROM costs c LEFT JOIN placed p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = c.i),
walk(conv_id, i, q, audit, lines, done) AS (
  SELECT conv_id, cast(1 AS BIGINT), 0, '', cast([] AS VARCHAR[]), false FROM sums
  UNION ALL
  SELECT conv_id, CASE WHEN act IN ('D', 'K', 'R') THEN i + 1 ELSE i END,
         CASE act WHEN 'D' THEN q WHEN 'K' THEN CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END WHEN '' THEN q ELSE CASE WHEN q = 2 THEN 3 ELSE 2 END END,
         audit || act,
         CASE act WHEN 'K' THEN list_append(lines, concat(role, ':', text)) WHEN 'R' THEN list_append(lines, concat(CASE WHEN q = 2 THEN 'assistant:' ELSE 'user:' END, text))
                  WHEN 'I' THEN list_append(lines, CASE WHEN q = 2 THEN 'assistant:' ELSE 'user:' END) ELSE lines END,
         act = ''
  FROM (SELECT w.*, s.role, s.text, s.initial,
               CASE WHEN s.over THEN CASE WHEN w.q IN (0, 3) THEN '' ELSE 'I' END
                    WHEN 3 + s.a[w.q + 1] = s.c[w.q + 1] THEN 'D'
                    WHEN 2 + s.c[CASE WHEN w.q = 2 THEN 4 ELSE 3 END] = s.c[w.q + 1] THEN 'I'
                    WHEN s.fault < 2 AND ((w.q = 0 AND s.initial = 's' AND s.fault + s.a[2] = s.c[w.q + 1]) OR (w.q IN (0, 1, 3) AND s.initial = 'u' AND s.fault + s.a[3] = s.c[w.q + 1])
                         OR (w.q = 2 AND s.initial = 'a' AND s.fault + s.a[4] = s.c[w.q + 1])) THEN 'K' ELSE 'R' END AS act
        FROM walk w JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i WHERE NOT w.done) t),
repaired AS (SELECT conv_id, audit, array_to_string(lines, chr(10)) AS doc FROM walk WHERE done)
SELECT o.conv_id, cast(coalesce(s.gaps, 0) AS BIGINT) AS gaps, cast(coalesce(s.blank, 0) AS BIGINT) AS blank, cast(coalesce(s.duplicate, 0) AS BIGINT) AS duplicate, cast(coalesce(s.truncated, 0) AS BIGINT) AS truncated,
       cast(coalesce(s.illegal, 0) AS BIGINT) AS illegal, cast(coalesce(b.c0, 0) AS BIGINT) AS cost, coalesce(r.audit, '') AS audit, sha256(coalesce(r.doc, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN behind b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 1 LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""

ORACLE_SQL["op13_variants"] = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, n, {_CRC.format(s="concat(cast(doc_id AS VARCHAR), ':', run)")} AS h FROM counted, {_CRC_TABLE} tab),
slipped AS (SELECT CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, cast(sum(n) AS BIGINT) AS n, length(word) AS size FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
dels AS (SELECT word, n, size, k, concat(substr(word, 1, k - 1), substr(word, k + 1)) AS del FROM (SELECT *, unnest(range(1, size + 1)) AS k FROM words) t),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM dels a JOIN dels b ON a.del = b.del AND a.k = b.k AND a.size = b.size AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM dels a JOIN words b ON a.del = b.word
  UNION SELECT b.word, a.word, a.n FROM dels a JOIN words b ON a.del = b.word),
best AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS rn FROM near),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 5 * w.n THEN b.other END AS form, CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word AND b.rn = 1),
chain(word, here, form) AS (
  SELECT word, word, form FROM forms
  UNION ALL
  SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.form = f.word)
SELECT f.word, f.form, c.here AS root, f.n, cast(f.n_near AS BIGINT) AS n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""
