"""Registered queries of the text operators, on whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontaminate, fingerprint, langid, lm, packing, pii, simhash_dedup, spelling, warc
from . import quality as quality_filter
from . import token_counts as counting


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Key of the pseudonyms in the registered queries; a real one comes from a secret store.
KEY = b"key of the registered queries"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms, and how many values were replaced."""
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", pii.pseudonyms("text", KEY).alias("p")).select("doc_id", "p.text", F.col("p.found").alias("n_found"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity, limits and verdict of every document."""
    return quality_filter.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(
        _table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.token_counts(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def aged_replica(records: DataFrame) -> DataFrame:
    """A second copy with known damage: of each 101 pages one is lost, one cut short, one altered."""
    case = F.pmod(F.col("page_id"), F.lit(101))
    payload = (
        F.when(case == 7, F.overlay("payload", F.lit("?"), F.lit(12)))
        .when(case == 13, F.substring(F.col("payload"), F.lit(1), F.length("payload") - 5)).otherwise(F.col("payload")))
    return records.where(F.coalesce(case != 11, F.lit(True))).withColumn("payload", payload).withColumn("length", F.octet_length("payload").cast("long"))


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between the pages laid out as WARC files and an aged replica of them."""
    records = warc.layout(_table(spark, sf_dir, "pages"))
    return warc.audit(warc.manifest(records), warc.manifest(aged_replica(records)))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text; near documents of every fiftieth id, among all."""
    return fingerprint.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def transcripts(conversations: DataFrame) -> DataFrame:
    """Raw passages of the turns: markers in one of four styles, left out at every seventh turn, no role."""
    style = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(4))
    names = {"system": ("System: ", "Context: ", "### System\n", "SYSTEM: "), "user": ("User: ", "Human: ", "### Instruction\n", "Q: "),
             "assistant": ("Assistant: ", "AI: ", "### Response\n", "A: ")}
    mark = F.lit("")
    for role, styles in names.items():
        for n, name in enumerate(styles):
            mark = F.when((F.col("role") == role) & (style == n), name).otherwise(mark)
    mark = F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7)) == 0, "").otherwise(mark)
    return conversations.select("conv_id", F.col("turn").alias("seq"), "role", F.concat(mark, F.coalesce("text", F.lit(""))).alias("text"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns recovered from the raw transcripts of all conversations, with labels of two thirds of them."""
    passages = transcripts(_table(spark, sf_dir, "conversations"))
    return chat.formatted(passages.drop("role"), passages.where("crc32(cast(conv_id as string)) % 3 <> 1"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"), "crc32(cast(doc_id as string)) % 7 <> 2")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the more frequent spellings that they are variants of."""
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those outside the held-out third."""
    return langid.identify(_table(spark, sf_dir, "documents"), "crc32(cast(doc_id as string)) % 3 = 1")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of a byte-level vocabulary and of a piece vocabulary meet in every document."""
    return alignment.aligned(
        _table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"),
        tokenizer("byte_bpe_50k.tiktoken"))


def registered() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def statements() -> dict[str, str]:
    return {"op6_warc_fixity": OP6, "op11_spelling": OP11}


OP6 = """
WITH r AS (
  SELECT page_id, CAST(floor(page_id / 4096) AS BIGINT) AS file,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS payload
  FROM pages
), o AS (
  SELECT *, strlen(payload) AS n, CAST(coalesce(sum(strlen(payload)) OVER (
      PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_at
  FROM r
), b AS (
  SELECT *, CASE page_id % 101 WHEN 7 THEN substr(payload, 1, 11) || '?' || substr(payload, 13)
                               WHEN 13 THEN substr(payload, 1, length(payload) - 5) END AS other
  FROM o WHERE page_id % 101 IN (7, 11, 13)
)
SELECT file, start_at AS "offset", CASE WHEN other IS NULL THEN 'missing' ELSE 'corrupt' END AS kind,
       CAST(n AS BIGINT) AS length_a, CAST(coalesce(strlen(other), 0) AS BIGINT) AS length_b, sha256(payload) AS digest_a, coalesce(sha256(other), '') AS digest_b
FROM b
"""

OP11 = r"""
WITH RECURSIVE crc AS (  -- checksum of each byte, by the polynomial
  SELECT list(c ORDER BY n) AS of_byte FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) t(n))
), runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run
    FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL
), hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(
      list_prepend(4294967295, list_transform(range(1, length(hex) + 1, 2), lambda i: CAST('0x' || substr(hex, i, 2) AS BIGINT))),
      lambda c, b: xor(c >> 8, of_byte[xor(c & 255, b) + 1]))) AS h
  FROM (SELECT run, times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS hex FROM runs), crc
), counted AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed
), w AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM counted WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), less AS (  -- each word without each of its letters
  SELECT word, n, length(word) AS size, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.size = b.size AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN w b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS top, min(other) FILTER (n = most) AS form
  FROM (SELECT *, max(n) OVER (PARTITION BY word) AS most FROM near) GROUP BY word
), v AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN form END AS form, CASE WHEN top >= 5 * w.n THEN top END AS form_n
  FROM w LEFT JOIN best USING (word)
), up AS (
  SELECT word, word AS at FROM v
  UNION ALL SELECT up.word, v.form FROM up JOIN v ON up.at = v.word WHERE v.form IS NOT NULL
)
SELECT v.word, v.form, up.at AS root, v.n, v.n_near, v.form_n
FROM v JOIN up USING (word) JOIN v AS ends ON up.at = ends.word WHERE ends.form IS NULL
"""
