"""Queries over documents: cleaning, gates, dedup, chunks, splits, shuffles and shards, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import intervals, rows
from corpusmill.sources.render import translation

SEED = 20260507


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.clean_rows(documents(spark, sf_dir))


def staged(df: DataFrame) -> DataFrame:
    """A stage for each source, so that precedence between stages matters."""
    return df.withColumn("stage_ord", F.pmod(F.length("source"), F.lit(3))).withColumn("row_idx", F.col("doc_id"))


NOISE_SQL = r"""(trim(l, E' \t\n') <> '' AND (
    trim(l, E' \t\n') IN ('---开始阅读---', '---结束阅读---')
    OR regexp_matches(trim(l, E' \t\n'), '^(【书名】|【作者】|【类别】|【状态】|【更新】|【本册章节】|【简介】)')
    OR regexp_matches(trim(l, E' \t\n'), '^\[\d+\][一二三四五六七八九十百千〇零０-９0-9]+[ 　]')
    OR regexp_matches(trim(l, E' \t\n'), '^\|(\s*\|)+\s*$')
    OR (regexp_matches(trim(l, E' \t\n'), '^[\s|:\-+]+$') AND (contains(l, '|') OR contains(l, '-')) AND length(trim(l, E' \t\n')) > 4)
    OR (regexp_matches(l, '^\s*\d{1,5}(?:[ \t]{2,}|\.\s+)') AND length(l) - length(ltrim(l, E' \t\n')) < 8)
    OR regexp_matches(trim(l, E' \t\n'), '^(句中文翻译成英文：|答：|翻译为英文是：|该英文翻译为中文是：|英文：|中文：)\s*$')))"""
NORMAL_SQL = r"""regexp_replace(regexp_replace(regexp_replace(translate(text, '　' || chr(160) || chr(65279), '  '),
    '[\x00-\x08\x0b-\x1f\x7f-\x9f\p{Cf}\p{Co}]', '', 'g'),
    '(?s)\{\\displaystyle\s+(.+?)\}', '\1', 'g'),
    '([㐀-鿿豈-﫿，。；：、！？）」』])\n([㐀-鿿豈-﫿（「『])', '\1\2', 'g')"""
CLEAN_CTE = rf"""
normal AS (SELECT doc_id, source, lang, {NORMAL_SQL} AS t FROM documents),
kept AS (
  SELECT doc_id, source, lang, array_to_string(list_transform(list_filter(string_split(t, chr(10)), lambda l: NOT {NOISE_SQL}),
    lambda l: regexp_replace(regexp_replace(regexp_replace(rtrim(l, E' \t\n'), '\|[ \t]+', '| ', 'g'), '[ \t]+\|', ' |', 'g'), '[ \t]{{2,}}', ' ', 'g')), chr(10)) AS t
  FROM normal),
cleaned AS (SELECT doc_id, source, lang, trim(regexp_replace(t, '\n{{3,}}', E'\n\n', 'g'), E' \t\n') AS text FROM kept),
gated AS (
  SELECT *, CASE
    WHEN text IS NULL OR text = '' THEN 'empty'
    WHEN length(text) < 20 THEN 'short'
    WHEN (length(text) - length(translate(text, '〈〉', '')))::DOUBLE / length(text) > 0.05 THEN 'angle'
    WHEN (length(text) - length(replace(text, '|', '')))::DOUBLE / length(text) > 0.08 THEN 'pipe'
    WHEN length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g'))::DOUBLE / length(text) < 1 - 0.35::DOUBLE THEN 'letters' END AS reason
  FROM cleaned)"""


def clean_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cleaned(spark, sf_dir)
    return c.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.md5("text").alias("digest"))


CLEAN_TEXT_STATS = f"WITH {CLEAN_CTE} SELECT doc_id, length(text)::BIGINT AS n_chars, len(string_split(text, chr(10)))::BIGINT AS n_lines, md5(text) AS digest FROM cleaned"


def line_noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split(T.join_soft_wraps(T.unwrap_display_style(T.normalize(F.col("text")))), "\n", -1)
    counted = documents(spark, sf_dir).select("doc_id", F.inline(F.array(F.struct(F.size(lines).alias("n"), F.size(T.without_noise(lines)).alias("kept")))))
    return counted.select("doc_id", F.col("kept").cast("long").alias("kept"), (F.col("n") - F.col("kept")).cast("long").alias("dropped"))


LINE_NOISE_FILTER = f"""
WITH {CLEAN_CTE}, counted AS (SELECT doc_id, string_split(t, chr(10)) AS ls FROM normal)
SELECT doc_id, len(list_filter(ls, lambda l: NOT {NOISE_SQL}))::BIGINT AS kept, len(list_filter(ls, lambda l: {NOISE_SQL}))::BIGINT AS dropped FROM counted"""


def quality_gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


QUALITY_GATE_REASONS = f"WITH {CLEAN_CTE} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM gated GROUP BY 1"


def exact_dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = cleaned(spark, sf_dir).where("reason is null").withColumn("row_idx", F.col("doc_id"))
    return rows.dedup_first(good, order=("row_idx",)).select("doc_id", "source")


EXACT_DEDUP = f"WITH {CLEAN_CTE} SELECT doc_id, source FROM gated WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"


def dedup_stage_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.dedup_first(staged(documents(spark, sf_dir).where("text <> ''"))).select("doc_id", "source", F.col("stage_ord").cast("long").alias("stage_ord"))


DEDUP_STAGE = "SELECT doc_id, source, (length(source) % 3)::BIGINT AS stage_ord FROM documents WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY text ORDER BY length(source) % 3, doc_id) = 1"


def clean_summary_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cleaned(spark, sf_dir).withColumn("row_idx", F.col("doc_id"))
    kept = rows.dedup_first(c.where("reason is null"), order=("row_idx",)).groupBy("source").agg(F.count("*").alias("kept"))
    seen = c.groupBy("source").agg(F.count("*").alias("seen")).join(kept, "source", "left")
    k = F.coalesce("kept", F.lit(0))
    return seen.select("source", k.alias("kept"), (F.col("seen") - k).alias("dropped"), F.round((F.col("seen") - k) / F.col("seen"), 9).alias("drop_rate"))


CLEAN_SUMMARY = f"""
WITH {CLEAN_CTE}, first AS ({EXACT_DEDUP.split(CLEAN_CTE)[1]})
SELECT source, count(f.doc_id) AS kept, count(*) - count(f.doc_id) AS dropped, round((count(*) - count(f.doc_id))::DOUBLE / count(*), 9) AS drop_rate
FROM cleaned LEFT JOIN (SELECT doc_id FROM first) f USING (doc_id) GROUP BY source"""


def chunk_2000(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = intervals.chunk_texts(documents(spark, sf_dir).withColumnRenamed("doc_id", "row_idx"))
    return chunks.select("source", "chunk", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


_CHUNK_CTE = r"""
joined AS (SELECT source, string_agg(text || E'\n\n', '' ORDER BY doc_id) AS t FROM texts GROUP BY source),
cut AS (SELECT source, k AS chunk, trim(substr(t, (k * 2000 + 1)::BIGINT, 2000), E' \t\n') AS text FROM joined, unnest(range(0, (length(t) - 1) // 2000 + 1)) AS u(k)),
chunks AS (SELECT * FROM cut WHERE text <> '')"""
CHUNK_2000 = f"WITH texts AS (SELECT doc_id, source, text FROM documents WHERE text <> ''), {_CHUNK_CTE} SELECT source, chunk, length(text)::BIGINT AS n_chars, md5(text) AS digest FROM chunks"


def clean_chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = cleaned(spark, sf_dir).where("reason is null").withColumn("row_idx", F.col("doc_id"))
    chunks = intervals.chunk_texts(rows.dedup_first(good, order=("row_idx",)))
    return chunks.groupBy("source").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


CLEAN_CHUNK_SUMMARY = f"""
WITH {CLEAN_CTE}, texts AS (SELECT * FROM gated WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1), {_CHUNK_CTE}
SELECT source, count(*) AS chunks, sum(length(text))::BIGINT AS chars FROM chunks GROUP BY source"""


def translation_template_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select("doc_id", F.md5(translation(F.col("text"), F.col("source"), F.col("doc_id"))).alias("digest"))


TRANSLATION_ROTATION = r"""
WITH p AS (SELECT doc_id, text AS zh, source AS en FROM documents)
SELECT doc_id, md5(CASE doc_id % 5 WHEN 0 THEN '中文：' || zh || E'\n英文：' || en WHEN 1 THEN zh || E'\n翻译为英文是：\n' || en WHEN 2 THEN '英文：' || en || E'\n\n中文：' || zh
  WHEN 3 THEN en || E'\n该英文翻译为中文是：\n' || zh ELSE '请把下面这句中文翻译成英文：' || chr(10) || zh || chr(10) || '答：' || en END) AS digest FROM p"""


def char_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters in use, numbered from 2; their ranks are over the distinct characters alone."""
    from pyspark.sql import Window

    chars = documents(spark, sf_dir).select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    return chars.select("ch", (F.row_number().over(Window.orderBy(F.ascii("ch"))) + 1).cast("long").alias("id"), "n", F.octet_length("ch").cast("long").alias("n_bytes"))


CHAR_VOCAB = "SELECT ch, row_number() OVER (ORDER BY unicode(ch)) + 1 AS id, n, strlen(ch)::BIGINT AS n_bytes FROM (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch)"


def token_byte_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select(F.explode(F.split("text", " ")).alias("token")).distinct()
    return words.select("token", F.when(F.col("token").startswith("<"), 0).otherwise(F.octet_length("token")).cast("long").alias("n_bytes"))


TOKEN_BYTES = "SELECT token, CASE WHEN starts_with(token, '<') THEN 0 ELSE strlen(token) END::BIGINT AS n_bytes FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM documents)"


def split_train_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.split_by_hash(documents(spark, sf_dir), "doc_id", 0.01, 42).select("doc_id", "is_val")


SPLIT_TRAIN_VAL = """
WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, r <= greatest(1, round_even(n * 0.01, 0)) AS is_val FROM h"""


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_train_val(spark, sf_dir).groupBy("is_val").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


SPLIT_COUNTS = f"SELECT is_val, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM ({SPLIT_TRAIN_VAL}) GROUP BY is_val"


def shard_modulo(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    out = None
    for i in range(3):
        own = rows.shard(d, 3, i, "doc_id").agg(F.lit(i).cast("long").alias("shard"), F.count("*").alias("n"), F.sum("doc_id").alias("ids"))
        out = own if out is None else out.union(own)
    return out


SHARD_MODULO = "SELECT doc_id % 3 AS shard, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1"


def shard_batch_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))
    shards = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("shard"))
    return shards.select(F.col("shard").cast("long").alias("shard"), rows.shard_rows(F.col("n"), 7, F.col("shard")).alias("n_rows"), F.floor(rows.shard_rows(F.col("n"), 7, F.col("shard")) / 64).alias("full_batches"), F.ceil(F.col("n") / 64).alias("batches"))


SHARD_BATCH = """
SELECT s AS shard, count(l_orderkey) AS n_rows, count(l_orderkey) // 64 AS full_batches, ((SELECT count(*) FROM lineitem) + 63) // 64 AS batches
FROM range(7) r(s) LEFT JOIN (SELECT l_orderkey, (row_number() OVER () - 1) % 7 AS k FROM lineitem) ON k = s GROUP BY s"""


def _mul(z: str, k: int) -> str:
    low, high = k & 0xFFFFFFFF, k >> 32
    return f"((((({z} >> 32) * {low}::HUGEINT + ({z} & 4294967295::HUGEINT) * {high}::HUGEINT) & 4294967295::HUGEINT) * 4294967296::HUGEINT + ({z} & 4294967295::HUGEINT) * {low}::HUGEINT) & 18446744073709551615::HUGEINT)"


def shuffle_splitmix64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's key, as 16 hexadecimal digits."""
    d = documents(spark, sf_dir)
    keyed = rows.splitmix64(d, rows.wrapped_sum(F.col("doc_id"), rows.file_seed(SEED, "documents.parquet")))
    return keyed.select("doc_id", F.lpad(F.hex("key"), 16, "0").alias("key"))


SHUFFLE = f"""
WITH a AS (SELECT doc_id, ({(rows.file_seed(SEED, "documents.parquet") + 0x9E3779B97F4A7C15) % (1 << 64)}::HUGEINT + doc_id) & 18446744073709551615::HUGEINT AS z FROM documents),
b AS (SELECT doc_id, xor(z, z >> 30) AS z FROM a), c AS (SELECT doc_id, {_mul("z", 0xBF58476D1CE4E5B9)} AS z FROM b),
d AS (SELECT doc_id, xor(z, z >> 27) AS z FROM c), e AS (SELECT doc_id, {_mul("z", 0x94D049BB133111EB)} AS z FROM d),
f AS (SELECT doc_id, xor(z, z >> 31) AS z FROM e)
SELECT doc_id, printf('%016X', z::UBIGINT) AS key FROM f"""


def epoch_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = rows.repeat_epochs(documents(spark, sf_dir), 3, 7, "doc_id")
    return every.groupBy(F.col("epoch").cast("long").alias("epoch")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"))


EPOCH_REPEAT = "SELECT e AS epoch, count(*) AS n, count(DISTINCT doc_id) AS ids FROM documents, range(3) r(e) GROUP BY e"


def full_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.full_batches(documents(spark, sf_dir), 32, "doc_id").groupBy("batch").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


FULL_BATCHES = "SELECT doc_id // 32 AS batch, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE doc_id < (SELECT count(*) // 32 * 32 FROM documents) GROUP BY 1"


def ordered_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).orderBy(F.length("text").desc(), "doc_id").limit(25).select("doc_id", F.length("text").cast("long").alias("n_chars"))


ORDERED_LIMIT = "SELECT doc_id, length(text)::BIGINT AS n_chars FROM documents ORDER BY length(text) DESC, doc_id LIMIT 25"


def stage_union_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", "lang")
    stages = [d.where(F.col("lang") == lang) for lang in ("en", "de", "fr")]
    return rows.stage_union(stages, "doc_id", 600).select("doc_id", F.col("stage_ord").cast("long").alias("stage_ord"))


STAGE_UNION = "SELECT doc_id, s::BIGINT AS stage_ord FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS s FROM documents WHERE lang IN ('en', 'de', 'fr')) ORDER BY s, doc_id LIMIT 600"

QUERIES = {
    "clean_text_stats": clean_text_stats, "line_noise_filter": line_noise_filter, "quality_gate_reasons": quality_gate_reasons, "exact_dedup_first_wins": exact_dedup_first_wins,
    "dedup_stage_precedence": dedup_stage_precedence, "clean_summary_by_source": clean_summary_by_source, "chunk_2000": chunk_2000, "clean_chunk_summary": clean_chunk_summary,
    "translation_template_rotation": translation_template_rotation, "char_vocab": char_vocab, "token_byte_lengths": token_byte_lengths, "split_train_val": split_train_val, "split_counts": split_counts,
    "shard_modulo": shard_modulo, "shard_batch_math": shard_batch_math, "shuffle_splitmix64": shuffle_splitmix64, "epoch_repeat": epoch_repeat, "full_batches": full_batches,
    "ordered_limit": ordered_limit, "stage_union_cap": stage_union_cap,
}
ORACLES = {
    "clean_text_stats": CLEAN_TEXT_STATS, "line_noise_filter": LINE_NOISE_FILTER, "quality_gate_reasons": QUALITY_GATE_REASONS, "exact_dedup_first_wins": EXACT_DEDUP,
    "dedup_stage_precedence": DEDUP_STAGE, "clean_summary_by_source": CLEAN_SUMMARY, "chunk_2000": CHUNK_2000, "clean_chunk_summary": CLEAN_CHUNK_SUMMARY,
    "translation_template_rotation": TRANSLATION_ROTATION, "char_vocab": CHAR_VOCAB, "token_byte_lengths": TOKEN_BYTES, "split_train_val": SPLIT_TRAIN_VAL, "split_counts": SPLIT_COUNTS,
    "shard_modulo": SHARD_MODULO, "shard_batch_math": SHARD_BATCH, "shuffle_splitmix64": SHUFFLE, "epoch_repeat": EPOCH_REPEAT, "full_batches": FULL_BATCHES,
    "ordered_limit": ORDERED_LIMIT, "stage_union_cap": STAGE_UNION,
}
