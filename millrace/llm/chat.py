r"""Relational chat formatting, with Spark expressions only.

A conversation's turns are collected as structs and sorted, adjacent turns of one role are merged by an array
aggregation, and everything is concatenated:

    <|role|>text<+>next text of the same role</s><|other role|>text</s>

Inside roles and texts ~ < > are written ~0 ~1 ~2, so no control string can occur there and reading back is exact.
The loss mask is an array of (start, length) spans of the assistant's texts in the formatted conversation.

Defined results: null texts and roles are empty. Turns are in order of turn (null first), then role, then text, so
ties and repeated rows have a place. Rows with a null conv_id are one conversation. An empty table gives an empty
result. A conversation is one output row, thus one task's work; conversations themselves are spread by their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<"), F.lit("~1")), F.lit(">"), F.lit("~2"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("~2"), F.lit(">")), F.lit("~1"), F.lit("<")), F.lit("~0"), F.lit("~"))


def _merge(turns: Column) -> Column:
    """Blocks (role, texts): a turn of the last block's role joins it, any other begins a block."""
    one = lambda t: F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))
    none = F.slice(F.transform(turns, one), 1, 0)

    def step(blocks: Column, t: Column) -> Column:
        last = F.try_element_at(blocks, F.lit(-1))
        longer = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))
        joined = F.concat(F.slice(blocks, F.lit(1), F.size(blocks) - 1), F.array(longer))
        return F.when((F.size(blocks) > 0) & (last["role"] == t["role"]), joined).otherwise(F.concat(blocks, F.array(one(t))))

    adjacent = F.exists(F.zip_with(turns, F.slice(turns, 2, F.size(turns)), lambda a, b: F.coalesce(a["role"] == b["role"], F.lit(False))), lambda x: x)
    return F.when(adjacent, F.aggregate(turns, none, step)).otherwise(F.transform(turns, one))


def _spans(blocks: Column) -> Column:
    """(start, length) of the learned role's escaped texts, by a running position over the blocks' pieces."""
    pieces = F.flatten(
        F.transform(
            blocks,
            lambda b: F.concat(
                F.array(F.struct((F.length(escape(b["role"])) + 4).alias("n"), F.lit(False).alias("learned"))),
                F.flatten(
                    F.transform(
                        b["texts"],
                        lambda t: F.array(
                            F.struct(F.length(escape(t)).alias("n"), (b["role"] == LEARNED_ROLE).alias("learned")),
                            F.struct(F.lit(3).alias("n"), F.lit(False).alias("learned")),
                        ),
                    )
                ),
                F.array(F.struct(F.lit(1).alias("n"), F.lit(False).alias("learned"))),  # </s> is one longer than <+>
            ),
        )
    )
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, length: int>>)").alias("spans"))

    def step(s: Column, p: Column) -> Column:
        span = F.array(F.struct(s["at"].alias("start"), p["n"].alias("length")))
        return F.struct((s["at"] + p["n"]).alias("at"), F.when(p["learned"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(pieces, start, step, lambda s: s["spans"])


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss_spans. rows: conv_id, turn, role, text."""
    body = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    turns = F.array_sort(F.collect_list(F.struct("turn", *body))).alias("turns")
    blocks = rows.groupBy("conv_id").agg(turns).select("conv_id", _merge(F.col("turns")).alias("blocks"))
    block = lambda b: F.concat(F.lit("<|"), escape(b["role"]), F.lit("|>"), F.array_join(F.transform(b["texts"], escape), "<+>"), F.lit("</s>"))
    return blocks.select("conv_id", F.array_join(F.transform("blocks", block), "").alias("formatted"), _spans(F.col("blocks")).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """One row for each formatted conversation, with its turns (role, text) and its learned text, read from the output."""
    blocks = F.filter(F.split("formatted", "</s>"), lambda b: b != "")

    def turns_of(b: Column) -> Column:
        role = F.substring_index(F.substr(b, F.lit(3)), "|>", 1)
        texts = F.split(F.substr(b, F.length(role) + 5), r"<\+>", -1)
        return F.transform(texts, lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    learned = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.withColumns({"turns": F.flatten(F.transform(blocks, turns_of)), "learned": F.array_join(learned, "")})
