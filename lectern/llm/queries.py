"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import chat, decontaminate, fill_middle, fingerprint, jaccard_join, language_id, line_dedup, lm_score, mixing, packing, quality, spelling, substring_dedup
from lectern.llm.store import bucket_of, small


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(_read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"), min_docs=10, min_length=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    learnt = _read(spark, sf_dir, "labels").where(bucket_of(F.col("doc_id"), 4) != 2).select("doc_id", F.col("quality").alias("label"))
    model = quality.fit_quality(docs.join(small(learnt), "doc_id").select("text", "label"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", (bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_read(spark, sf_dir, "documents"), bucket_of(F.col("doc_id"), 7) == 2)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"), length=200).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), width=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_read(spark, sf_dir, "documents"), shingle=3, percent=90)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = language_id.fit_language_net(docs.where(bucket_of(F.col("doc_id"), 5) != 0).select("text", "lang"))
    out = language_id.predict_languages(docs.select("doc_id", "text"), net)
    return out.select("doc_id", (bucket_of(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


MIX_POWER, MIX_ROUNDS, MIX_SEED = 0.8, 12, 11
#: Token shares that the mix is to have; all other values share the rest by their weights to MIX_POWER.
MIX_TARGETS = {"lang": {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}, "topic": {"table": 0.02}}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixing_probabilities(_read(spark, sf_dir, "documents"), power=MIX_POWER, rounds=MIX_ROUNDS, seed=MIX_SEED, targets=MIX_TARGETS)
    return out.select("doc_id", "n_tokens", "topic", F.round("probability", 6).alias("probability"), "sampled")


#: Arguments that the calls of ``chat.as_tool_log`` must have.
TOOL_SCHEMAS = [("reply", "prompt", "string", True), ("reply", "chars", "integer", True)]


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = spark.createDataFrame(TOOL_SCHEMAS, "name string, param string, type string, required boolean")
    return chat.format_chats(chat.as_tool_log(_read(spark, sf_dir, "conversations")), schemas)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(_read(spark, sf_dir, "documents"), seed=42, rate=50, spm_rate=80)
    digest = [F.sha2(x.cast("binary"), 256) for x in (F.col("output"), fill_middle.restored(F.col("form"), F.col("output")))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest[0].alias("output_sha256"), digest[1].alias("restored_sha256"))


#: The tokenizer that op12 packs by; its file is found by the installed package of public vocabularies.
PACK_TOKENIZER, PACK_CAPACITY, PACK_END = "word_bpe_49k.json", 4096, 1


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.cut_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path(PACK_TOKENIZER), PACK_CAPACITY, PACK_END)
    return packing.pack_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")), "ids_crc32", capacity=PACK_CAPACITY)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_read(spark, sf_dir, "documents"), erase=199, least_chars=6, least=5, factor=5)


def queries() -> dict:
    return {f.__name__: f for f in (op1_fingerprints, op2_line_dedup, op3_quality, op4_lm_score, op5_suffix_dedup, op6_decontamination, op7_jaccard_join, op8_language_id, op9_mixing, op10_chat, op11_fill_middle, op12_packing, op13_spelling)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _mixing_sql() -> str:
    parts = [
        r"""counted AS (SELECT doc_id, source, lang, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
            CASE WHEN contains(coalesce(text, ''), '|') THEN 'table' WHEN regexp_matches(coalesce(text, ''), '[#$%&*]{3}') THEN 'marked'
                 WHEN regexp_matches(coalesce(text, ''), '[0-9]{6}') THEN 'numbers' ELSE 'prose' END AS topic FROM documents)""",
        "r0 AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS weight, CAST(sum(n_tokens) AS DOUBLE) AS raked FROM counted GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for m in mixing.MARGINS:
        asked = " UNION ALL ".join(f"SELECT '{k}', CAST({v} AS DOUBLE)" for k, v in MIX_TARGETS.get(m, {}).items()) or "SELECT '', CAST(0 AS DOUBLE) WHERE false"
        parts.append(f"a_{m}(v, share) AS ({asked})")
        parts.append(f"p_{m} AS (SELECT {m}, share, CASE WHEN share IS NULL THEN pow(w, {MIX_POWER}) END AS p FROM (SELECT {m}, sum(weight) AS w FROM r0 GROUP BY {m}) LEFT JOIN a_{m} ON {m} = v)")
        parts.append(f"g_{m} AS (SELECT coalesce(sum(share), 0) AS given, sum(p) AS rest, CASE WHEN sum(p) IS NULL THEN 0 ELSE greatest(1 - coalesce(sum(share), 0), 0) END AS remain FROM p_{m})")
        parts.append(f"t_{m} AS (SELECT {m}, CASE WHEN share IS NOT NULL THEN share * (1 - remain) / given ELSE p / rest * remain END * (SELECT sum(weight) FROM r0) AS target FROM p_{m}, g_{m})")
    k = 0
    for _ in range(MIX_ROUNDS):
        for m in mixing.MARGINS:
            parts.append(f"s{k} AS MATERIALIZED (SELECT {m}, sum(raked) AS now FROM r{k} GROUP BY {m})")
            parts.append(
                f"r{k + 1} AS MATERIALIZED (SELECT r.source, r.lang, r.topic, r.weight, r.raked * t.target / s.now AS raked FROM r{k} r"
                f" JOIN s{k} s ON r.{m} IS NOT DISTINCT FROM s.{m} JOIN t_{m} t ON r.{m} IS NOT DISTINCT FROM t.{m})"
            )
            k += 1
    parts.append(f"f AS (SELECT source, lang, topic, (raked / weight) / (SELECT max(raked / weight) FROM r{k}) AS p FROM r{k})")
    parts.append(
        f"d AS (SELECT c.doc_id, c.n_tokens, c.topic, coalesce(f.p, 0.0) AS p, CAST(('0x' || substr(md5(coalesce(CAST(c.doc_id AS VARCHAR), '') || ':{MIX_SEED}'), 1, 8)) AS BIGINT) / 4294967296.0 AS draw"
        " FROM counted c LEFT JOIN f ON c.source IS NOT DISTINCT FROM f.source AND c.lang IS NOT DISTINCT FROM f.lang AND c.topic = f.topic AND c.n_tokens > 0)"
    )
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, n_tokens, topic, round(p, 6) AS probability, draw < p AS sampled FROM d"


CHAT_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, CAST('0x' || substr(md5(text), 1, 1) AS BIGINT) AS lot FROM conversations),
c0 AS (SELECT conv_id, turn, text, lot, CASE WHEN lot = 1 AND turn >= 2 THEN 'q' || (turn - 2) ELSE 'q' || turn END AS id,
         CASE WHEN 2 * (turn // 4) + turn % 2 < turn THEN ['q' || (2 * (turn // 4) + turn % 2)] ELSE [] END
         || CASE WHEN lot = 0 THEN ['q' || (turn + 2)] ELSE [] END || CASE WHEN lot = 3 THEN ['none'] ELSE [] END AS after FROM m WHERE role = 'user'),
r AS (SELECT conv_id, turn, text, 'q' || (turn - 1) AS id FROM m WHERE role = 'assistant'),
ans AS (SELECT conv_id, id, min(turn) AS answer FROM r GROUP BY ALL),
c AS (SELECT c0.*, answer, row_number() OVER (PARTITION BY c0.conv_id, c0.id ORDER BY turn) = 1 AS own, min(turn) OVER (PARTITION BY c0.conv_id, c0.id) AS first_turn FROM c0 LEFT JOIN ans ON c0.conv_id = ans.conv_id AND c0.id = ans.id),
o AS (SELECT conv_id, id, turn, greatest(turn, answer) AS free FROM c WHERE own),
n0 AS (SELECT conv_id, id, unnest(list_distinct(after)) AS need FROM c WHERE own),
lost AS (SELECT DISTINCT conv_id, id FROM n0 WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.conv_id = n0.conv_id AND o.id = n0.need)),
n AS (SELECT n0.* FROM n0 WHERE EXISTS (SELECT 1 FROM o WHERE o.conv_id = n0.conv_id AND o.id = n0.need)),
reach AS (SELECT conv_id, id, need FROM n UNION SELECT reach.conv_id, reach.id, n.need FROM reach JOIN n ON reach.conv_id = n.conv_id AND reach.need = n.id),
loops AS (SELECT DISTINCT conv_id, id FROM reach WHERE id = need),
stuck AS (SELECT conv_id, id FROM loops UNION SELECT reach.conv_id, reach.id FROM reach JOIN loops ON reach.conv_id = loops.conv_id AND reach.need = loops.id),
paths AS (SELECT conv_id, id, need, 1 AS len FROM n WHERE NOT EXISTS (SELECT 1 FROM stuck WHERE stuck.conv_id = n.conv_id AND stuck.id = n.id)
  UNION SELECT paths.conv_id, paths.id, n.need, len + 1 FROM paths JOIN n ON paths.conv_id = n.conv_id AND paths.need = n.id),
done AS (SELECT o.conv_id, o.id, greatest(any_value(o.turn), max(f.free)) AS ready, coalesce(max(len), 0) AS depth
  FROM o LEFT JOIN paths ON o.conv_id = paths.conv_id AND o.id = paths.id LEFT JOIN o f ON f.conv_id = paths.conv_id AND f.id = paths.need
  WHERE NOT EXISTS (SELECT 1 FROM stuck WHERE stuck.conv_id = o.conv_id AND stuck.id = o.id) GROUP BY o.conv_id, o.id)
SELECT conv_id, turn, 0 AS idx, role, 'message' AS kind, NULL AS call_id, CAST(NULL AS BIGINT) AS linked_turn, turn AS ready_turn, 0 AS depth, 'ok' AS status,
  '{"content":' || to_json(text) || ',"conv_id":' || conv_id || ',"role":' || to_json(role) || ',"turn":' || turn || '}' AS line
FROM m WHERE role NOT IN ('user', 'assistant')
UNION ALL
SELECT c.conv_id, c.turn, 0, 'assistant', 'call', c.id, CASE WHEN own THEN answer END, CASE WHEN own THEN coalesce(ready, c.turn) ELSE c.turn END, CAST(CASE WHEN own THEN coalesce(depth, 0) ELSE 0 END AS INTEGER),
  CASE WHEN NOT own THEN 'repeated' WHEN lot = 2 THEN 'invalid' WHEN lost.id IS NOT NULL THEN 'missing' WHEN done.id IS NULL THEN 'cycle' WHEN answer IS NULL THEN 'unanswered' ELSE 'ok' END,
  '{"after":[' || array_to_string(list_transform(after, lambda x: '"' || x || '"'), ',') || '],"arguments":{' || CASE WHEN lot <> 2 THEN '"chars":' || length(text) || ',' ELSE '' END || '"prompt":' || to_json(text) || '},"conv_id":' || c.conv_id
  || ',"id":"' || c.id || '","kind":"call","name":"reply","role":"assistant","turn":' || c.turn || '}'
FROM c LEFT JOIN done ON own AND c.conv_id = done.conv_id AND c.id = done.id LEFT JOIN lost ON c.conv_id = lost.conv_id AND c.id = lost.id
UNION ALL
SELECT r.conv_id, r.turn, 0, 'tool', 'result', r.id, first_turn, greatest(r.turn, coalesce(ready, first_turn, r.turn)), CAST(coalesce(depth, 0) + CASE WHEN first_turn IS NULL THEN 0 ELSE 1 END AS INTEGER), CASE WHEN first_turn IS NULL THEN 'orphan' ELSE 'ok' END,
  '{"content":' || to_json(text) || ',"conv_id":' || r.conv_id || ',"id":"' || r.id || '","kind":"result","role":"tool","turn":' || r.turn || '}'
FROM r LEFT JOIN (SELECT DISTINCT conv_id, id, first_turn FROM c) k ON r.conv_id = k.conv_id AND r.id = k.id LEFT JOIN done ON r.conv_id = done.conv_id AND r.id = done.id"""


def oracle_sql() -> dict[str, str]:
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return {
        "op2_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT doc_id, line, pos, trim(translate(line, '{_UPPER}', '{_LOWER}'), {blanks}) AS key FROM lines),
shared AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.doc_id, k.line, k.pos, s.key IS NOT NULL AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
        "op6_decontamination": rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
wins AS (SELECT DISTINCT item_id, array_to_string(list_slice(ws, i, i + 9), ' ') AS win, least(len(ws), 10) AS n
         FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM iw WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM dw),
grams AS (SELECT doc_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS win FROM places, sizes WHERE i + n - 1 <= len(ws)),
hits AS (SELECT DISTINCT g.doc_id, g.i, g.n, w.item_id FROM grams g JOIN wins w ON g.win = w.win AND g.n = w.n),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS pos FROM hits),
c AS (SELECT doc_id, count(*) AS n_hit FROM covered GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN c ON dw.doc_id = c.doc_id LEFT JOIN i ON dw.doc_id = i.doc_id""",
        "op9_mixing": _mixing_sql(),
        "op10_chat": CHAT_SQL,
        "op11_fill_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p""",
    }
