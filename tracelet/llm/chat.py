"""Chat formatting with Spark expressions only.

A conversation becomes one string of blocks, one block for each run of
adjacent turns of the same role:

    ### role: text</next>text</turn>\n

Control strings inside roles and texts are escaped reversibly, so that the
string parses back into the very turns it was made of. The loss mask is given
as segments: the pieces of the string in order, each with a flag. Only the
texts of assistant turns carry it; headers, joints and ends don't.

Defined cases: a null role or text is the empty string; rows with the same
turn number are ordered by role, then text; repeated rows stay; a null turn
comes first; rows with a null conversation id form one conversation; an empty
table gives no rows; other columns are ignored, whatever their names.
One conversation is one output value, so its turns must fit in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, JOINT, END, COLON = "### ", "</next>", "</turn>\n", ": "
LEARNT_ROLE = "assistant"


def escape(c: Column, role: bool = False) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit("###"), F.lit("\\h"))
    c = F.replace(c, F.lit("</"), F.lit("\\e"))
    return F.replace(c, F.lit(COLON), F.lit("\\c")) if role else c


def unescape(c: Column) -> Column:
    """Pairs of backslashes are found from the left; what lies between holds single escapes only."""

    def piece(x: Column) -> Column:
        x = F.replace(x, F.lit("\\h"), F.lit("###"))
        x = F.replace(x, F.lit("\\e"), F.lit("</"))
        return F.replace(x, F.lit("\\c"), F.lit(COLON))

    return F.array_join(F.transform(F.split(c, r"\\\\", -1), piece), "\\")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, formatted, segments array<struct<piece, loss>>."""
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    t = F.col("ts")
    starts = F.filter(
        F.sequence(F.lit(1), F.size(t)),
        lambda i: (i == 1) | (F.element_at(t, i)["role"] != F.element_at(t, F.greatest(i - 1, F.lit(1)))["role"]),
    )
    ranged = sorted_turns.select("conv_id", "ts", starts.alias("starts"))
    s = F.col("starts")

    def segment(piece: Column, loss: Column) -> Column:
        return F.struct(piece.alias("piece"), loss.alias("loss"))

    def block(i: Column, k: Column) -> Column:
        after = F.when(k + 1 < F.size(s), F.get(s, k + 1)).otherwise(F.size(t) + 1)
        run = F.slice(t, i, after - i)
        who = F.element_at(t, i)["role"]
        head = segment(F.concat(F.lit(HEAD), escape(who, role=True), F.lit(COLON)), F.lit(False))
        texts = F.flatten(
            F.transform(
                run,
                lambda x, j: F.array(
                    segment(F.when(j > 0, F.lit(JOINT)).otherwise(F.lit("")), F.lit(False)),
                    segment(escape(x["text"]), x["role"] == LEARNT_ROLE),
                ),
            )
        )
        return F.concat(F.array(head), texts, F.array(segment(F.lit(END), F.lit(False))))

    parts = ranged.select("conv_id", F.filter(F.flatten(F.transform(s, block)), lambda x: x["piece"] != "").alias("segments"))
    return parts.select("conv_id", F.array_join(F.col("segments")["piece"], "").alias("formatted"), "segments")


def parse_chats(formatted: DataFrame) -> DataFrame:
    """The turns of each formatted string: adds turns array<struct<role, text>>."""
    blocks = F.split(F.col("formatted"), END, -1)

    def turns(b: Column) -> Column:
        head = F.substring_index(b, COLON, 1)
        body = F.substring(b, F.length(head) + len(COLON) + 1, F.length(b))
        who = unescape(F.substring(head, F.lit(len(HEAD) + 1), F.length(head)))
        return F.transform(F.split(body, JOINT, -1), lambda x: F.struct(who.alias("role"), unescape(x).alias("text")))

    cut = formatted.withColumn("blocks", F.slice(blocks, F.lit(1), F.size(blocks) - 1))
    return cut.withColumn("turns", F.flatten(F.transform("blocks", turns))).drop("blocks")


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda x: x["loss"]), lambda x: unescape(x["piece"])), "")


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted rows."""
    back = parse_chats(formatted).select("conv_id", "formatted", "turns", loss_text(F.col("segments")).alias("loss"))
    spelt = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spelt.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
