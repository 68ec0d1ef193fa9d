"""The numbered queries over the given tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm import (
    chat,
    decontamination,
    embeddings,
    language,
    merkle,
    near_dedup,
    quality,
    repair,
    segmentation,
    suffix_dedup,
    token_counts,
    toxicity,
    warc,
)
from wattline.llm.common import documents, remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def piece_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = token_counts.count_tokens(documents(spark, sf).select("doc_id", "text"), piece_model())
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@_query
def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    found = decontamination.find_passages(docs, documents(spark, sf, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

SQL["op5_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
phrase AS (SELECT DISTINCT item_id, least(len(w), 10) AS k,
  array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS p
  FROM i, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM phrase),
place AS (SELECT doc_id, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') AS p
  FROM d, sizes, unnest(range(1, len(w) - k + 2)) AS t(s)),
found AS (SELECT doc_id, item_id, s, k FROM place JOIN phrase USING (k, p)),
hit AS (SELECT doc_id, count(DISTINCT s + j) AS n FROM found, unnest(range(0, k)) AS t(j) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(listed.n, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)"""


@_query
def op1_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    held = F.col("held_out")
    docs = documents(spark, sf).select("doc_id", "text", (remainder("doc_id", 5) == 0).alias("held_out"))
    scored = quality.score_quality(docs, documents(spark, sf, "labels"), learn=~held)
    return scored.select("doc_id", "held_out", "score", "predicted")


@_query
def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    held = (remainder("doc_id", 4) == 2).alias("held_out")
    docs = documents(spark, sf).select("doc_id", "text", "lang", held)
    return language.identify(docs, learn=~F.col("held_out")).select("doc_id", "held_out", "lang_pred", "score")


@_query
def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    held = (remainder("doc_id", 3) == 1).alias("held_out")
    docs = documents(spark, sf).select("doc_id", "text", held)
    scored = toxicity.score_toxicity(docs, documents(spark, sf, "labels"), learn=~F.col("held_out"), keep_text=False)
    return scored.select("doc_id", "held_out", "score", "predicted")


@_query
def op10_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    cut = suffix_dedup.remove_repeats(docs, keep_text=False)
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


@_query
def op8_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    return near_dedup.near_duplicates(docs, words=3, percent=85)


@_query
def op6_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    vectors = documents(spark, sf, "embeddings").select("vec_id", "embedding")
    return embeddings.near_vectors(vectors).select("vec_id", "n_links", "component_id", "kept")


@_query
def op2_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    return segmentation.encode(docs, piece_model()).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_pieces"),
        "ids_sha256",
        F.col("nbest")["score"].alias("scores"),
        "round_trip",
    )


@_query
def op4_warc_derivatives(spark: SparkSession, sf: str) -> DataFrame:
    return warc.derive(documents(spark, sf, "pages"))


def _sql_crc32(text: str) -> str:
    """crc32 of an ASCII text: each byte is xored in, then come eight steps of the reversed polynomial."""
    step = "xor(c, b)"
    for _ in range(8):
        step = f"list_transform([{step}], lambda c: xor(c >> 1, 3988292384 * (c & 1)))[1]"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(4294967295, list_reduce({codes}, lambda c, b: {step}, CAST(4294967295 AS BIGINT)))"


@_query
def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    names = ["doc_id", "source", "lang", "n_chars"]
    docs = documents(spark, sf).select(*names, "text")
    fields = [F.col(c) for c in names]
    tampered = merkle.leaf(*fields, F.translate("text", "\n", ""))
    keep = {"doc_id": F.col("doc_id"), "tampered": F.when(remainder("doc_id", 2) == 0, tampered)}
    built = merkle.manifest(docs, merkle.leaf(*fields, F.col("text")), "source", ["doc_id"], keep)
    refolded = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    proofs = built.proofs().withColumn("proof", merkle.path_digest(F.col("path"))).withColumn("refolded", refolded)
    return proofs.select(
        "doc_id",
        merkle.written(F.col("leaf")).alias("leaf"),
        merkle.written(F.col("subroot")).alias("subroot"),
        merkle.written(F.col("root")).alias("root"),
        merkle.written(F.col("proof")).alias("proof_sha256"),
        merkle.written(F.col("refolded")).alias("folded_root"),
        (F.col("refolded") == F.col("root")).alias("verified"),
    )


def _sql_field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || {value} END"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _sql_tree(name: str, leaves: str) -> str:
    """Nodes of a forest, and the digests left and right of each in its run."""
    return f"""{name} AS (SELECT tree, 0 AS level, idx, n, hash FROM {leaves}
  UNION ALL SELECT tree, level + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(hash, '' ORDER BY idx))
  FROM {name} WHERE n > 1 GROUP BY tree, level, idx // 3),
{name}_run AS (SELECT a.tree, a.level, a.idx,
  coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
  coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.level = b.level AND a.idx // 3 = b.idx // 3
  WHERE a.n > 1 GROUP BY a.tree, a.level, a.idx)"""


def _sql_fold(name: str, start: str, runs: str) -> str:
    """Each leaf's way to its root: the hash so far and the siblings met."""
    return f"""{name} AS ({start}
  UNION ALL SELECT f.doc, f.tree, f.level + 1, f.idx // 3, sha256(r.l || f.h || r.r), f.p || r.l || r.r
  FROM {name} f JOIN {runs} r ON f.tree = r.tree AND f.level = r.level AND f.idx = r.idx)"""


SQL["op13_merkle_manifest"] = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce('=' || source, '') AS tree, {_sql_leaf("text")} AS leaf,
  CASE WHEN {_sql_crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")} END AS changed FROM documents),
leaves AS (SELECT *, leaf AS hash, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
  count(*) OVER (PARTITION BY tree) AS n FROM d),
{_sql_tree("node", "leaves")},
groups AS (SELECT '' AS tree, tree AS source, hash, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n
  FROM node WHERE n = 1),
{_sql_tree("top", "groups")},
{_sql_fold("way", "SELECT doc, tree, 0 AS level, idx, coalesce(changed, leaf) AS h, '' AS p FROM leaves", "node_run")},
reached AS (SELECT doc, tree, arg_max(h, level) AS h, arg_max(p, level) AS p FROM way GROUP BY doc, tree),
{_sql_fold("rest", "SELECT doc, '' AS tree, 0 AS level, idx, h, p FROM reached JOIN groups ON groups.source = reached.tree", "top_run")},
done AS (SELECT doc, arg_max(h, level) AS h, arg_max(p, level) AS p FROM rest GROUP BY doc)
SELECT doc_id, leaf, groups.hash AS subroot, top.hash AS root, sha256(p) AS proof_sha256, h AS folded_root, h = top.hash AS verified
FROM leaves JOIN done USING (doc) JOIN groups ON groups.source = leaves.tree JOIN top ON top.n = 1"""


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, by crc32 of `conv:turn` modulo 20 (nulls: one space)."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn"))
    name = F.concat(conv, F.lit(":"), turn)
    drawn = rows.withColumn("_draw", F.crc32(name.cast("binary")) % 20).filter("_draw <> 0")
    text = F.when(F.col("_draw") == 1, "").when(F.col("_draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_draw") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(1), F.when(F.col("_draw") == 3, 2).otherwise(1))
    return drawn.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


@_query
def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = repair.rows_of(documents(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    broken = damaged(rows)
    repairs = repair.find_repairs(broken)
    done = repairs.join(repair.repaired_digests(broken, repairs).withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv")))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    all_ids = rows.select(F.col("conv").alias("conv_id")).distinct()
    return all_ids.join(done, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


#: Added to the conversations: control strings of templates as texts.
HOSTILE = [(-7, turn, role, "\\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))]


@_query
def op12_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    talks = documents(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    talks = talks.unionByName(spark.createDataFrame(HOSTILE, "conv_id long, turn long, role string, text string"))
    ranks = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    done = chat.format_chats(talks, tokenizer=ranks, pattern=public_tokenizers.PATTERN)
    return chat.read_back(done).withColumnRenamed("conv", "conv_id")


#: Rows that inserts lead from one last initial to another, and what an edit of a row does: the audits of
#: every beginning of a conversation, the least one for each last initial.
SQL["op11_conversation_repair"] = rf"""
WITH RECURSIVE drawn AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), '~') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_sql_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS draw FROM conversations),
broken AS (SELECT k, turn, CASE draw WHEN 3 THEN 2 ELSE 1 END AS copies, CASE draw WHEN 4 THEN 'user' ELSE role END AS role,
  CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM drawn WHERE draw <> 0),
placed AS (SELECT *, sum(copies) OVER line - copies AS earlier, lag(role) OVER line AS previous,
  row_number() OVER (PARTITION BY k, role, text ORDER BY turn NULLS FIRST) AS time_said, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS shown
  FROM broken WINDOW line AS (PARTITION BY k ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
judged AS MATERIALIZED (SELECT *, CAST(earlier + copy AS BIGINT) AS pos, substr(role, 1, 1) AS initial, CASE WHEN copy > 1 THEN role ELSE previous END AS before,
  CASE WHEN shown = '' THEN 'blank' WHEN time_said > 1 OR copy > 1 THEN 'duplicate' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
  FROM placed, unnest(range(1, copies + 1)) AS t(copy)),
counted AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND substr(before, 1, 1) || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY k),
ins(a, b, c, e) AS (VALUES ('', '', 0, ''), ('s', 's', 0, ''), ('u', 'u', 0, ''), ('a', 'a', 0, ''), ('', 'u', 2, 'I'), ('', 'a', 4, 'II'),
  ('s', 'u', 2, 'I'), ('s', 'a', 4, 'II'), ('u', 'a', 2, 'I'), ('a', 'u', 2, 'I')),
nxt(a, b) AS (VALUES ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
edits AS MATERIALIZED (SELECT k, pos, a, a AS b, 3 AS c, 'D' AS e FROM judged, nxt
  UNION ALL SELECT k, pos, a, b, 2 + (fault IS NOT NULL)::INT, 'R' FROM judged, nxt WHERE fault IS NULL OR fault = 'truncated'
  UNION ALL SELECT k, pos, a, initial, (fault IS NOT NULL)::INT, 'K' FROM judged, nxt
    WHERE (fault IS NULL OR fault = 'truncated') AND (initial = b OR (a = '' AND initial = 's'))),
walk AS (SELECT DISTINCT k, 0 AS pos, '' AS last, {{'c': 0, 'e': ''}} AS best FROM judged
  UNION ALL SELECT w.k, w.pos + 1, d.b, min({{'c': w.best.c + i.c + d.c, 'e': w.best.e || i.e || d.e}})
  FROM walk w JOIN ins i ON i.a = w.last JOIN edits d ON d.k = w.k AND d.pos = w.pos + 1 AND d.a = i.b GROUP BY w.k, w.pos, d.b),
done AS (SELECT w.k, min({{'c': w.best.c + i.c, 'e': w.best.e || i.e}}) AS best FROM walk w JOIN ins i ON i.a = w.last
  JOIN (SELECT k, max(pos) AS pos FROM judged GROUP BY k) USING (k, pos) WHERE i.b IN ('', 'a') GROUP BY w.k),
spelled AS (SELECT k, i, substr(best.e, i, 1) AS edit, len(replace(substr(best.e, 1, i), 'I', '')) AS pos, len(replace(substr(best.e, 1, i), 'D', '')) AS place
  FROM done, unnest(range(1, len(best.e) + 1)) AS t(i)),
met AS (SELECT s.*, role, text, max((place = 1 AND edit = 'K' AND initial = 's')::INT) OVER (PARTITION BY k) AS led
  FROM spelled s LEFT JOIN judged USING (k, pos) WHERE edit <> 'D'),
said AS (SELECT k, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
  CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS words FROM met GROUP BY k)
SELECT conv_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))},
  CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.e, '') AS audit, sha256(coalesce(words, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM drawn) LEFT JOIN counted USING (k) LEFT JOIN done USING (k) LEFT JOIN said USING (k)"""
