"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigdiff.llm.common import fold, held_out, table


OP4 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bs AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0
), bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, w[s:s + n - 1] AS win FROM bs
), ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n
), hits AS (SELECT doc_id, s, ds.n AS n, item FROM ds JOIN bw ON ds.n = bw.n AND ds.w[s:s + ds.n - 1] = bw.win
), pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id
), items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), e AS (SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a
), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = doc_id
"""

OP6 = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), o AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN original IS NULL OR original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN original IS NULL OR original = page_id THEN NULL ELSE original END AS refers_to
FROM p LEFT JOIN o USING (payload_digest)
"""


def _op12() -> str:
    from sigdiff.llm.licenses import CONTAINMENT, NOTICES, PHRASES, words_of

    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = ", ".join(f"('{label}', {listed(words_of(text))})" for text, label in PHRASES)
    notices = ", ".join(f"({k}, '{label}', '{family}', {len(words_of(text))}, {listed(sorted(set(words_of(text))))})" for k, (label, family, text) in enumerate(NOTICES))
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), ph(label, q) AS (VALUES {phrases}
), nt(k, label, family, n, t) AS (VALUES {notices}
), tok AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM d
), base AS (SELECT doc_id, label, i FROM tok JOIN ph ON x = q[1] JOIN d USING (doc_id) WHERE w[i + 1:i + len(q)] = q
), hit AS (SELECT doc_id, k, n, tok.x, i FROM tok JOIN (SELECT k, n, unnest(t) AS x FROM nt) USING (x)
), block AS (SELECT doc_id, k, n, x, i // n AS b FROM hit UNION SELECT doc_id, k, n, x, i // n - 1 FROM hit WHERE i >= n
), met AS (
  SELECT doc_id, k, label, family, b * nt.n AS s, (b + 2) * nt.n AS e, count(DISTINCT x) / len(t) AS share, len(t) AS m FROM block JOIN nt USING (k) GROUP BY doc_id, k, label, family, b, nt.n, t HAVING count(DISTINCT x) >= ceil({CONTAINMENT} * len(t) - 1e-9)
), best AS (
  SELECT * FROM met x WHERE NOT EXISTS (SELECT 1 FROM met y WHERE y.doc_id = x.doc_id AND y.family = x.family AND y.label <> x.label AND y.s < x.e AND x.s < y.e
    AND (y.share > x.share OR y.share = x.share AND (y.m > x.m OR y.m = x.m AND y.k < x.k)))
), pl AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id
), bl AS (SELECT doc_id, max(share) AS share FROM best GROUP BY doc_id
), al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM best) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score
FROM d LEFT JOIN pl USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id)
"""


def _op13() -> str:
    add = lambda x, cost, letter, row: f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 't': {x}.t || {row}}} END"
    user, assistant = "['user:']", "['assistant:']"
    keep = lambda x, initial: f"CASE WHEN left(role, 1) = '{initial}' AND fault NOT IN ('blank', 'duplicate') THEN {add(x, 'more', 'K', "[role || ':' || text]")} END"
    turn_to = lambda x, name: f"CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {add(x, '3 + more', 'R', f"['{name}:' || text]")} END"
    drop = lambda x: add(x, 4, "D", "[]::VARCHAR[]")
    value = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])"
    return rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), r0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS key FROM conversations
), r1 AS (SELECT *, xor(list_reduce([4294967295] || list_transform(key, lambda s: CAST(ascii(s) AS BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k FROM r0, crc
), r2 AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM r1 WHERE k <> 0
), r3 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM r2
), r4 AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS step FROM r3
), go(conv_id, n, s0, s1, su, sa) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST({{'c': 0, 'a': '', 't': []}} AS {value}), CAST(NULL AS {value}), CAST({{'c': 3, 'a': 'I', 't': {user}}} AS {value}), CAST({{'c': 6, 'a': 'II', 't': {user} || {assistant}}} AS {value}) FROM conversations
  UNION ALL
  SELECT conv_id, n, d0, d1, u2, list_min([da, {add("u2", 3, "I", assistant)}]) FROM (
    SELECT *, list_min([du, {add("d0", 3, "I", user)}, {add("d1", 3, "I", user)}, {add("da", 3, "I", user)}]) AS u2 FROM (
      SELECT conv_id, n, {drop("s0")} AS d0, list_min([{drop("s1")}, {keep("s0", "s")}]) AS d1,
        list_min([{", ".join([drop("su"), *(f(x, y) for x in ("s0", "s1", "sa") for f, y in ((keep, "u"), (turn_to, "user")))])}]) AS du,
        list_min([{drop("sa")}, {keep("su", "a")}, {turn_to("su", "assistant")}]) AS da
      FROM (SELECT g.*, r.* EXCLUDE (conv_id, n), r.n AS m, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM go g JOIN r4 r ON r.conv_id IS NOT DISTINCT FROM g.conv_id AND r.n = g.n + 1) AS j(conv_id, last, s0, s1, su, sa, turn, role, text, copy, bare, fault, step, n, more)))
), f AS (
  SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated, count_if(step NOT IN ('su', 'ua', 'au')) AS illegal FROM r4 GROUP BY conv_id
), e AS (SELECT conv_id, n, list_min([s0, sa]) AS best FROM go)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  best.c AS cost, best.a AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM e LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id WHERE e.n = coalesce(f.rows, 0)
"""


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigdiff.llm.fingerprints import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigdiff.llm.toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return score_toxicity(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigdiff.llm.lm import fit_language_model, score_documents

    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 7, 2)
    model, counts = fit_language_model(docs, ~out)
    return score_documents(docs, model, counts).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigdiff.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op5_pieces(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    from sigdiff.llm.pieces import encode_decode

    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    return encode_decode(table(spark, sf_dir, "documents"), model_path)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigdiff.llm.common import shared_dir
    from sigdiff.llm.warc import read_archives, write_archives

    path = shared_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("resolved_page_id").alias("refers_to"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigdiff.llm.secret_scan import KINDS, find_secrets, span_text

    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), "base_sha256", span_text("spans").alias("spans"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigdiff.llm.quality import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return score_quality(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigdiff.llm.langid import fit_languages, predict_languages

    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs, fold("doc_id", 3) != 1)
    return predict_languages(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigdiff.llm.neardup import kept, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=4).withColumn("kept", kept())


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigdiff.llm.periods import periodic_runs

    return periodic_runs(table(spark, sf_dir, "documents"), repeat=True)


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigdiff.llm.licenses import find_licenses, license_labels, license_score

    start = F.transform("base", lambda x: x["start"])
    found = find_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"), license_labels(True).alias("base_labels"), license_labels(False).alias("labels"), license_score().alias("score"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigdiff.llm.conversations import repair_conversations

    return repair_conversations(table(spark, sf_dir, "conversations"), damage=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprints, op2_toxicity, op3_language_model, op4_decontaminate, op5_pieces, op6_warc, op7_secrets, op8_quality, op9_language, op10_neardup, op11_periods, op12_licenses, op13_conversations)}


def oracle_sql() -> dict[str, str]:
    return {"op4_decontaminate": OP4, "op6_warc": OP6, "op10_neardup": OP10, "op12_licenses": _op12(), "op13_conversations": _op13()}
