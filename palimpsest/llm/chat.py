"""Chat formatting with typed content parts.

A message is a list of parts. A visitor has one method for each part type; it
turns text into escaped text and an image, audio or document part into a
placeholder, and says how many tokens a model puts in the placeholder's place.
All of it is column expressions. Turns are first joined in blocks of turns and
then to the conversation, so a very long conversation is formatted by many
tasks; only its finished string is one row. Places come from one walk over the
turns, so the cost is linear also where many rows have one turn or none.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. In texts and
roles every ``<``, backslashes, ``|`` gets one more backslash, so no control
string can be formed, and taking one away gives the text back.

Edge cases: null texts, roles and parts are empty; turns are ordered by turn
(null first), then role and text; repeated rows are repeated turns; rows
without a conv_id form one conversation without one; unknown part types raise
an error when the rows are formatted; an empty table gives no rows; other
columns are ignored.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import cut, scan

START, END = "<|im_start|>", "<|im_end|>"
SPANS = "array<struct<start:int,end:int>>"

#: content parts: text has ``text``; image has width and height in pixels, audio seconds, document pages in ``size``
PARTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("type", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("ref", T.StringType()),
            T.StructField("size", T.ArrayType(T.DoubleType())),
        ]
    )
)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """As texts, with line breaks and backslashes spelled out: a role is one line."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


@dataclass(frozen=True)
class PartVisitor:
    """What each type of part becomes: (placeholder or text, tokens it expands to)."""

    patch: int = 28
    tokens_per_second: float = 25.0
    tokens_per_page: int = 1500

    def text(self, part: Column) -> tuple[Column, Column]:
        return escape(F.coalesce(part["text"], F.lit(""))), F.lit(0)

    def image(self, part: Column) -> tuple[Column, Column]:
        side = [F.ceil(F.coalesce(F.get(part["size"], k), F.lit(0.0)) / self.patch) for k in (0, 1)]
        return F.lit("<|image|>"), (side[0] * side[1]).cast("int")

    def audio(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|audio|>"), F.ceil(F.coalesce(F.get(part["size"], 0), F.lit(0.0)) * self.tokens_per_second).cast("int")

    def document(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|document|>"), (F.coalesce(F.get(part["size"], 0), F.lit(0.0)) * self.tokens_per_page).cast("int")

    def visit(self, part: Column) -> Column:
        """A struct (type, ref, piece, tokens)."""
        pieces, tokens = None, None
        for kind in ("text", "image", "audio", "document"):
            piece, n = getattr(self, kind)(part)
            at = part["type"] == kind
            pieces = F.when(at, piece) if pieces is None else pieces.when(at, piece)
            tokens = F.when(at, n) if tokens is None else tokens.when(at, n)
        unknown = F.raise_error(F.concat(F.lit("unknown part type: "), F.coalesce(part["type"], F.lit("null"))))
        return F.struct(
            part["type"].alias("type"),
            part["ref"].alias("ref"),
            F.when(part.isNull(), F.lit("")).otherwise(pieces.otherwise(unknown)).alias("piece"),
            F.when(part.isNull(), F.lit(0)).otherwise(tokens.otherwise(F.lit(0))).alias("tokens"),
        )


def text_part(text: Column) -> Column:
    """A text as the only part of a message."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("array<double>").alias("size")))


def format_chat(messages: DataFrame, visitor: PartVisitor = PartVisitor(), loss_roles: tuple[str, ...] = ("assistant",), block: int = 64) -> DataFrame:
    """Format messages (conv_id, turn, role, parts) into one row per conversation.

    formatted: the string. loss: spans (start, end) of it in code points, end
    exclusive, that are trained on. attachments: (turn, part, type, ref, tokens)
    in order. n_turns, and extra_tokens: what placeholders expand to.
    """
    seen = F.transform(F.coalesce(F.col("parts"), F.array().cast(PARTS)), visitor.visit)
    role = F.coalesce(F.col("role"), F.lit(""))
    turns = messages.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        seen.alias("seen"),
    ).select(
        "conv_id",
        "turn",
        F.expr(f"turn div {block}").alias("block"),
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        F.array_join(F.transform("seen", lambda x: x["piece"]), "").alias("body"),
        F.col("role").isin(*loss_roles).alias("trained"),
        F.transform(
            F.filter(F.transform("seen", lambda x, i: F.struct(i.alias("part"), x["type"].alias("type"), x["ref"].alias("ref"), x["tokens"].alias("tokens"))), lambda x: x["type"] != "text"),
            lambda x: F.struct(F.col("turn").alias("turn"), x["part"].alias("part"), x["type"].alias("type"), x["ref"].alias("ref"), x["tokens"].alias("tokens")),
        ).alias("attached"),
    )
    whole = F.concat("head", "body", F.lit(END + "\n"))
    blocks = turns.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("turn", "head", "body", whole.alias("text"), F.length("head").alias("skip"), F.length("body").alias("size"), F.length(whole).alias("length"), "trained", "attached"))).alias("turns")
    )

    def trained(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["skip"]
        return at + x["length"], F.when(x["trained"], F.array(F.struct(start.alias("start"), (start + x["size"]).alias("end")))).otherwise(F.array().cast(SPANS))

    def moved(at: Column, x: Column) -> tuple[Column, Column]:
        return at + x["length"], F.transform(x["loss"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end")))

    parts = blocks.select(
        "conv_id",
        "block",
        F.array_join(F.transform("turns", lambda x: x["text"]), "").alias("text"),
        scan(F.col("turns"), F.lit(0), trained, SPANS).alias("loss"),
        F.flatten(F.transform("turns", lambda x: x["attached"])).alias("attached"),
        F.size("turns").alias("n"),
    )
    joined = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "text", F.length("text").alias("length"), "loss", "attached", "n"))).alias("blocks"))
    return joined.select(
        "conv_id",
        F.array_join(F.transform("blocks", lambda x: x["text"]), "").alias("formatted"),
        scan(F.col("blocks"), F.lit(0), moved, SPANS).alias("loss"),
        F.flatten(F.transform("blocks", lambda x: x["attached"])).alias("attachments"),
        F.aggregate("blocks", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_turns"),
    ).withColumn("extra_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``turns``: the (role, text) that the formatted string holds, unescaped, and ``loss_text``."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)
    body = lambda x: F.substr(x, F.instr(x, "\n") + F.lit(1), F.length(x) - F.instr(x, "\n") - F.lit(len(END) + 1))
    return formatted.withColumn(
        "turns", F.transform(pieces, lambda x: F.struct(unescape_role(F.substring_index(x, "\n", 1)).alias("role"), unescape(body(x)).alias("text")))
    ).withColumn("loss_text", F.array_join(F.transform(cut(F.col("formatted"), F.col("loss")), unescape), ""))
