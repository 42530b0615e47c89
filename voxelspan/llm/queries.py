"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html_text, langid, manifest, near_dup, packing, quality, rans, secret_scan, simhash, warc, whitening
from .shared import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, table(spark, sf_dir, "labels")).drop("text")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array(*map(F.lit, secret_scan.KINDS))
    told = lambda s, k, e: F.concat_ws(":", F.get(names, k), s.cast("string"), e.cast("string"))
    join = lambda x: F.array_join(F.transform(x, lambda t: told(t["starts"], t["kinds"], t["ends"])), ",")
    triples = F.arrays_zip("starts", "kinds", "ends")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "n_cnn", F.sha2(join(F.filter(triples, lambda t: t["kinds"] < 3)), 256).alias("base_sha256"), join(triples).alias("spans"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    read = chat.read_back(chat.format_chats(rows.union(more)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.token_ids_query(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op11_columns(docs: DataFrame) -> DataFrame:
    """Manifest of documents, checked against a copy in which texts of a third of the ids are lower-cased."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest.verified(docs, tampered, {"text": F.translate("text", upper, lower)})


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_columns(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


_ESCAPED = "replace({x}, '\\', '\\\\')"
for _c in chat.CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"

OP9_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
told AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum({len(chat.OPEN) + len(chat.MIDDLE) + len(chat.CLOSE)} + length({_ESCAPED.format(x='role')}) + length({_ESCAPED.format(x='text')})) AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM told
"""


_FIELD = "coalesce(concat(strlen(CAST({x} AS VARCHAR)), ':', {x}), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(x=c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {text})"
_LEVELS = "SELECT t, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM {x} WHERE n > 1 GROUP BY t, level, pos // 8, n"
_RUN = "PARTITION BY t, level, pos // 8 ORDER BY pos ROWS BETWEEN"

OP11_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
docs AS (
  SELECT doc_id, coalesce('b' || lang, 'a') AS t, {_LEAF.format(text=_FIELD.format(x='text'))} AS leaf,
    {_LEAF.format(text=_FIELD.format(x="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))} AS low,
    xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0 AS tampered
  FROM documents, crc),
base AS (
  SELECT *, CASE WHEN tampered THEN low ELSE leaf END AS now, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY t) AS n FROM docs),
tree(t, level, pos, digest, n) AS (SELECT t, 0, pos, leaf, n FROM base UNION ALL {_LEVELS.format(x="tree")}),
subroots AS (SELECT t, level, digest, row_number() OVER (ORDER BY t) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top(t, level, pos, digest, n) AS (SELECT 'z', 0, pos, digest, n FROM subroots UNION ALL {_LEVELS.format(x="top")}),
nodes AS (
  SELECT t, level, pos, n, coalesce(string_agg(digest, '') OVER ({_RUN} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(digest, '') OVER ({_RUN} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM (SELECT * FROM tree UNION ALL SELECT * FROM top)),
steps AS (
  SELECT t, level, pos, l, r, t AS up_t, level + 1 AS up_level, pos // 8 AS up_pos FROM nodes WHERE n > 1
  UNION ALL SELECT s.t, s.level, 0, k.l, k.r, 'z', 1, s.pos // 8 FROM subroots s JOIN nodes k ON k.t = 'z' AND k.level = 0 AND k.pos = s.pos WHERE s.n > 1),
climb(own_t, own_pos, k, t, level, pos, proof, folded) AS (
  SELECT t, pos, 0, t, 0, pos, '', now FROM base
  UNION ALL SELECT own_t, own_pos, k + 1, up_t, up_level, up_pos, proof || l || r, sha256(l || folded || r) FROM climb JOIN steps USING (t, level, pos)),
ends AS (SELECT own_t AS t, own_pos AS pos, arg_max(proof, k) AS proof, arg_max(folded, k) AS folded FROM climb GROUP BY ALL),
root AS (SELECT digest AS root FROM top WHERE n = 1)
SELECT b.doc_id, b.leaf, s.digest AS subroot, root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = root AS verified
FROM base b JOIN ends e ON e.t = b.t AND e.pos = b.pos JOIN subroots s ON s.t = b.t, root
"""


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v) and k != "op11_columns"}


def oracle_sql() -> dict[str, str]:
    return {"op9_chat_formatting": OP9_SQL, "op11_merkle_manifest": OP11_SQL}
