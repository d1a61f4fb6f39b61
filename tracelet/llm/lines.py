r"""Line deduplication with DataFrame operations only.

A text is split at \n. A line's key is the line without ASCII white space at
both ends and with A-Z in lower case. Keys of at least min_chars code points
that are found in at least min_docs documents lose all their lines except in
the largest document id that holds them. Other lines stay, joined by \n.

Defined cases: a null text counts as the empty text, which is one empty line;
rows that share an id count as one document, and each keeps or loses its own
lines; rows with a null id are not counted and lose nothing; an empty table
gives no rows; extra columns pass through, whatever their names.

How it scales: keys are counted by a 128-bit hash with a map-side combine, the
lookup of frequent keys is salted by document, and the texts are shuffled once,
by document. Nothing is broadcast or collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelet.llm.common import explode_salts, salt_bits, salt_of

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _hits(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """From (id, text): id, hash of the text, and the positions of the lines that it loses."""
    exploded = docs.filter("id is not null and text is not null").select("id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    key = line_key(F.col("line"))
    lines = exploded.filter(F.length("line") >= min_chars).select("id", "row", "pos", key.alias("key")).filter(F.length("key") >= min_chars)
    lines = lines.select("id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    counted = lines.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper"), salt_bits(salt_of(F.col("id"))).alias("bits"))
    frequent = counted.filter(F.col("n") >= min_docs).select("h1", "h2", "keeper", explode_salts(F.col("bits")).alias("salt"))
    lost = lines.withColumn("salt", salt_of(F.col("id"))).join(frequent, ["h1", "h2", "salt"]).filter("id <> keeper")
    return lost.groupBy("id", "row").agg(F.collect_set("pos").alias("lost"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs as struct column `doc`, with kept string, n_lines long, n_dropped long."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hits = _hits(rows.select("id", "text"), min_chars, min_docs).withColumnsRenamed({"id": "hit_id", "row": "hit_row"})
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    joined = rows.join(hits, (F.col("id") == F.col("hit_id")) & (F.xxhash64("text") == F.col("hit_row")), "left")
    cut = joined.select("doc", "text", "lost", F.split("text", "\n", -1).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    kept = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n"))
    return cut.select("doc", kept.alias("kept"), F.size("lines").cast("long").alias("n_lines"), F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n_dropped"))


def keep_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """docs with the same columns, the text without its dropped lines. A null text stays null."""
    out = dedup_lines(docs, id_col, text_col, **rule)
    return out.select(*[F.when(F.col("doc")[c].isNotNull(), F.col("kept")).alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns])
