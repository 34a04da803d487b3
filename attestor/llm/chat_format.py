"""Conversations as training examples: prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context and only its text is under the loss
mask. A conversation whose last turn is no assistant's has one example more, without a target, so that no turn is lost.
A formatted example is `<s>` and for every turn `<role:NAME>`, the text and `</s>`. Control strings inside texts get a
backslash behind their first character, one more where some stand there already, which unescape takes away again; names of roles are percent-encoded.
So a text never opens or closes a turn, and read_back recovers every turn from the formatted string alone.

Built-in functions throughout. Turns are escaped once and meet by conversation in one shuffle; examples are cut out of that row.
An example holds all its context, so a conversation's turns have to fit into a row, and the output grows as the square of its turns: that is what the expansion asks for.

Defined results: null text and null role count as empty; turns go by turn number, null first, and of equal numbers by role, then text; repeated
rows are turns of their own; rows without conv_id are one conversation; a role other than `assistant` is context; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<s>", "</s>"
TARGET = "assistant"

# What opens or closes something for a tokenizer of this template or of common others, each without its first character.
CONTROL = ("s>", "/s>", "role:", "INST]", "/INST]", "unk>", "pad>", "|im_start|>", "|im_end|>", "|endoftext|>")
_REST = "(" + "|".join(c.replace("|", "\\|").replace("]", "\\]") for c in CONTROL) + ")"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, "([<\\[])(\\\\*)" + _REST, "$1$2\\\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "([<\\[])(\\\\*)\\\\" + _REST, "$1$2$3")


def expand(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) to examples: conv_id, example (from 0), formatted, loss_start and loss_chars (code points under the mask;
    0 without a target)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head, body = F.concat(F.lit("<role:"), F.url_encode(role), F.lit(">")), escape(text)
    pieces = turns.select("conv_id", F.struct("turn", role.alias("role"), body.alias("body"), head.alias("head")).alias("piece"))
    held = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list("piece")).alias("turns"))
    last = F.element_at("turns", -1)["role"] != TARGET
    at = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (F.element_at("turns", i)["role"] == TARGET) | (last & (i == F.size("turns"))))
    cut = held.select("conv_id", "turns", F.posexplode(at).alias("example", "at"))
    before = F.transform(F.slice("turns", F.lit(1), F.col("at") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(END)))
    own = F.element_at("turns", F.col("at"))
    cut = cut.select("conv_id", "example", own.alias("own"), F.concat(F.lit(BEGIN), F.array_join(before, ""), own["head"]).alias("context"))
    masked = F.when(F.col("own.role") == TARGET, F.char_length("own.body")).otherwise(0).cast("long")
    return cut.select("conv_id", "example", F.concat("context", "own.body", F.lit(END)).alias("formatted"), F.char_length("context").cast("long").alias("loss_start"), masked.alias("loss_chars"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted example: an array of (role, text)."""
    closed = F.split(F.substr(formatted, F.lit(len(BEGIN) + 1)), END, -1)

    def turn(piece: Column) -> Column:
        close = F.instr(piece, ">")  # names of roles are percent-encoded and hold none
        name = F.substr(piece, F.lit(len("<role:") + 1), close - F.lit(len("<role:") + 1))
        return F.struct(F.url_decode(name).alias("role"), unescape(F.substr(piece, close + 1)).alias("text"))

    return F.transform(F.slice(closed, F.lit(1), F.size(closed) - 1), turn)


def masked_text(formatted: Column, start: Column, chars: Column) -> Column:
    """What stands under the loss mask of an example, unescaped."""
    return unescape(F.substr(formatted, (start + 1).cast("int"), chars.cast("int")))


def digests(examples: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, examples of each conversation, read from
    its examples: turns from the last, which holds all of them, and what may be learned from every mask."""
    shown = examples.select("conv_id", "example", "formatted", masked_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("reply"))
    held = shown.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("last"), F.sort_array(F.collect_list(F.struct("example", "reply"))).alias("replies"), F.sum(F.char_length("formatted")).alias("formatted_chars"),
        F.count(F.lit(1)).alias("examples"),
    )
    read = held.select("conv_id", "formatted_chars", "examples", read_back(F.col("last")).alias("turns"), F.array_join(F.transform("replies", lambda r: r["reply"]), "").alias("learned"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars", "examples",
    )
