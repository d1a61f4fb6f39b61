"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelet.llm import chat, decontaminate, fingerprint, jaccard, langid, lines, packing, secrets, toxicity, warc
from tracelet.llm.common import table

CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(1).select(F.explode(F.array(F.lit("user"), F.lit("assistant"))).alias("role"))
    planted = planted.select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.when(F.col("role") == "user", 0).otherwise(1).cast("long").alias("turn"),
        "role",
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return chat.digests(chat.format_chats(turns.unionByName(planted)))


def spread(docs: DataFrame) -> DataFrame:
    """docs over all cores where its files have fewer splits than that: one shuffle of a small table for operators that are otherwise narrow."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.dedup_lines(docs)
    return out.select(F.col("doc")["doc_id"].alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(spread(table(spark, sf_dir, "documents")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(table(spark, sf_dir, "documents")), tokenizer_path())


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.findings_by_path(docs, secrets.scan_unseen(docs))
    return found.select(F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_packing": op2_packing,
    "op3_chat_format": op3_chat_format,
    "op4_secret_scan": op4_secret_scan,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_warc_derivatives": op6_warc_derivatives,
    "op7_toxicity": op7_toxicity,
    "op8_order_minhash": op8_order_minhash,
    "op9_decontamination": op9_decontamination,
    "op10_line_dedup": op10_line_dedup,
}

SQL = {
    "op3_chat_format": r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), o as (
  select *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</', '\e') as esc,
    replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</', '\e'), ': ', '\c') as esc_role,
    row_number() over w as rn, lag(role) over w as before, lead(role) over w as after
  from c window w as (partition by conv_id order by turn, role, text)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by rn)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by rn) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(esc) + case when before = role then 7 else 6 + length(esc_role) end + case when after = role then 0 else 8 end)::bigint as formatted_chars
from o group by conv_id""",
    "op5_jaccard_join": r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents
), s as (
  select distinct doc_id, unnest(case when len(words) >= 5 then list_transform(range(1, len(words) - 3), lambda i: hash(words[i:i + 4])) else [hash(words)] end) as sh from w where len(words) > 0
), n as (select doc_id, count(*) as n from s group by doc_id
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all
), e as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)
), g as (select a, b from e union all select b, a from e
), r(id, seen) as (
  select doc_id, doc_id from n union select r.id, g.b from r join g on g.a = r.seen
)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.least, w.doc_id) as component_id
from w left join n using (doc_id) left join (select id, min(seen) as least from r group by id) c on c.id = w.doc_id""",
    "op10_line_dedup": r"""
with l as (
  select doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents
), k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
), f as (
  select key, max(doc_id) as keeper from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3
), d as (
  select k.*, f.key is not null and k.doc_id <> f.keeper as dropped from k left join f using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from d group by doc_id""",
}
