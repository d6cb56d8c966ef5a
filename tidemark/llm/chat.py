"""Chat formatting: every assistant turn becomes an example of its own.

An example holds all turns before the reply as context and then the reply; only the reply's
text is under the loss mask. A conversation that does not end with an assistant turn gets
one more example without loss, so every turn can be read back.

Template of a turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts, a ``<`` and a ``|`` with
only backslashes between them get one more backslash, which removing one undoes, and no
text holds a control string any more. Roles write ``%``, ``<`` and line feeds as ``%xx``.

Nulls: a null text or role is empty; turns with equal or null number stand in the order
(turn, role, text), null first; rows without conversation id form one conversation. Repeated
rows are turns of their own. An empty table gives no examples; extra columns are not read.
A conversation is one row while it is formatted: its turns meet in one task by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("\n"), F.lit("%0A"))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def training_examples(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """``conv_id``, ``example`` (from 0), ``formatted``, ``loss_start``, ``loss_end`` (code points), ``is_last``."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    head = lambda t: F.concat(F.lit(START), _role_out(t["role"]), F.lit("\n"))
    whole = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("_turns")
    )
    parts = F.transform("_turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == trained_role).alias("trained")))
    wanted = F.filter(
        F.transform("_parts", lambda p, i: F.struct(i.alias("at"), p["trained"].alias("trained"))),
        lambda x: x["trained"] | (x["at"] == F.size("_parts") - 1),
    )
    context = F.array_join(F.transform(F.slice("_parts", 1, F.col("_at.at")), lambda p: F.concat(p["head"], p["body"], F.lit(f"{END}\n"))), "")
    reply = F.col("_parts")[F.col("_at.at")]
    before, body = F.concat(context, reply["head"]), reply["body"]
    return (
        whole.withColumn("_parts", parts)
        .select("conv_id", "_parts", F.posexplode(wanted).alias("example", "_at"))
        .select(
            "conv_id",
            "example",
            F.concat(before, body, F.lit(f"{END}\n")).alias("formatted"),
            F.length(before).alias("loss_start"),
            (F.length(before) + F.when(F.col("_at.trained"), F.length(body)).otherwise(0)).alias("loss_end"),
            (F.col("_at.at") == F.size("_parts") - 1).alias("is_last"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted example was made from."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    bare = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.substr(p, F.lit(len(START) + 1)))
    return F.transform(
        bare,
        lambda p: F.struct(
            _role_in(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2)).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss_start: Column, loss_end: Column) -> Column:
    """The text under the loss mask, as it was before formatting."""
    return unescape(F.substr(formatted, loss_start + 1, loss_end - loss_start))
