"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, embedding_dedup, infill, language, minhash, mixing, packing, quality, substring_dedup, token_counts
from . import token_files, vector_search
from .common import fold_of, table

#: Sources with a stated target weight; every other source has weight 1.
MIX_WEIGHTS = {"src0": 3.0, "src1": 2.0, "src2": 0.5}


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs.select("doc_id", "text", "lang", "source", "n_chars"), MIX_WEIGHTS)
    return mixed.select("doc_id", "source", "lang", "n_chars", "copy", "mix_key", "text")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    probe = spark.sql(
        "SELECT -7L AS conv_id, turn, role, :said AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)",
        args={"said": said},
    )
    return chat.digests(chat.format_conversations(turns.unionByName(probe)), in_order=True)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    held_out = fold_of(F.col("doc_id"), quality.FOLDS) == quality.HELD_OUT
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("quality_score").alias("score"),
        F.col("quality_label").alias("predicted"),
    )


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs, language.fit(docs))
    held_out = fold_of(F.col("doc_id"), language.FOLDS) == language.HELD_OUT
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder)
    return token_files.read_documents(spark, folder)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return moved.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )


OP1_SQL = """
WITH rows AS (
  SELECT *, row_number() OVER () AS row_id, coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) AS key
  FROM documents
),
sizes AS (SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS chars FROM rows GROUP BY source),
weighed AS (
  SELECT *, CASE source WHEN 'src0' THEN 3.0 WHEN 'src1' THEN 2.0 WHEN 'src2' THEN 0.5 ELSE 1.0 END::DOUBLE AS weight
  FROM sizes
),
rates AS (
  SELECT source, CASE WHEN chars > 0 THEN weight / sum(weight) OVER () * sum(chars) OVER () * 1.0 / chars ELSE 0 END AS rate
  FROM weighed
),
parts AS (SELECT source, rate, ceil(rate / 32)::INT AS n_parts FROM rates WHERE rate > 0),
terms AS (
  SELECT source, k, exp(k * ln(rate / n_parts) - rate / n_parts - lgamma(k + 1)) AS p FROM parts, range(110) t(k)
),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
steps AS (
  SELECT r.row_id, r.source, r.key, unnest(generate_series(1, p.n_parts)) AS i
  FROM rows r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source
),
drawn AS (
  SELECT row_id, source, ('0x' || substr(md5('17|' || key || '|' || i), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM steps
),
counts AS (
  SELECT d.row_id, count(*) FILTER (WHERE c.c <= d.u) AS n
  FROM drawn d JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source GROUP BY d.row_id
),
copies AS (SELECT row_id, unnest(generate_series(1, n)) AS copy FROM counts WHERE n > 0)
SELECT r.doc_id, r.source, r.lang, r.n_chars, c.copy::INT AS copy, md5('18|' || r.key || '|' || c.copy) AS mix_key, r.text
FROM copies c JOIN rows r ON r.row_id = c.row_id
"""

OP13_SQL = """
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts,
    sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS draw
  FROM documents
),
drawn AS (
  SELECT *, length(parts) - CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END AS n,
    ('0x' || draw[1:8])::BIGINT AS h1, ('0x' || draw[9:16])::BIGINT AS h2,
    ('0x' || draw[17:24])::BIGINT AS h3, ('0x' || draw[25:32])::BIGINT AS h4
  FROM lines
),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
      THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
),
placed AS (
  SELECT *,
    CASE WHEN a = 0 THEN '' WHEN a = length(parts) THEN text
      ELSE array_to_string(parts[1:a], chr(10)) || chr(10) END AS prefix,
    CASE WHEN b = 0 THEN '' WHEN b = length(parts) THEN text
      ELSE array_to_string(parts[1:b], chr(10)) || chr(10) END AS upto
  FROM cut
),
three AS (
  SELECT *, substr(upto, length(prefix) + 1) AS middle, substr(text, length(upto) + 1) AS suffix FROM placed
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM three
"""


def queries() -> dict:
    own = (
        op1_source_mixing,
        op2_substring_dedup,
        op3_chat_formatting,
        op4_token_counts,
        op5_packing,
        op6_quality_classifier,
        op7_embedding_dedup,
        op8_vector_search,
        op9_minhash_dedup,
        op10_language_id,
        op11_token_files,
        op12_token_alignment,
        op13_fill_in_middle,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict:
    return {"op1_source_mixing": OP1_SQL, "op13_fill_in_middle": OP13_SQL}
