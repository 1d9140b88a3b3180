"""Chat formatting with a grammar that is checked by reading the result back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The grammar. A conversation is a sequence of turns; a turn is
#   <s>[INST]role[/INST]text</s>
# Inside role and text no control string stands bare: a backslash after its first character
# marks a literal one, and one more backslash marks a literal that had some already.
OPEN, HEAD_END, CLOSE = "<s>[INST]", "[/INST]", "</s>"
BARE = r"</?s>|\[/?INST\]"
ESCAPE = ((r"<(\\*)(/?s>)", r"<\\$1$2"), (r"\[(\\*)(/?INST\])", r"[\\$1$2"))
UNESCAPE = ((r"<\\(\\*)(/?s>)", r"<$1$2"), (r"\[\\(\\*)(/?INST\])", r"[$1$2"))


def _replaced(x: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, put in rules:
        x = F.regexp_replace(x, pattern, put)
    return x


def escape(x: Column) -> Column:
    return _replaced(x, ESCAPE)


def unescape(x: Column) -> Column:
    return _replaced(x, UNESCAPE)


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(HEAD_END), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """Turns of a rendered conversation: array of struct(role, text), null if the grammar is broken.

    Deterministic, one way to read any string: cut at every closing mark, the header
    ends at its first end mark, what follows is text; a bare control string anywhere else is
    an error.
    """
    pieces = F.split(formatted, CLOSE, -1)

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(OPEN) + 1))
        role = F.substring_index(body, HEAD_END, 1)
        text = F.substr(body, F.length(role) + F.lit(len(HEAD_END) + 1))
        fine = piece.startswith(OPEN) & body.contains(HEAD_END) & ~role.rlike(BARE) & ~text.rlike(BARE)
        return F.when(fine, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))

    turns = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)
    ended = F.element_at(pieces, -1) == F.lit("")
    return F.when(ended & ~F.exists(turns, lambda t: t.isNull()), turns)


def _reads_back(role: Column, text: Column, put_role: Column, put_text: Column) -> Column:
    """Whether the turn, rendered as ``put_*``, is recovered as ``role`` and ``text``."""
    want = F.array(F.struct(role.alias("role"), text.alias("text")))
    return F.coalesce(parse(render_turn(put_role, put_text)) == want, F.lit(False))


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, identical.

    Rows are ordered by turn (null first), ties by role and text; a repeated row is a turn of its
    own. Null role or text counts as empty, a null conversation id is one conversation, further
    columns are not read, no rows give no rows. ``loss_spans`` holds struct(start, length) of
    every text with role ``learn`` inside ``formatted`` in code points, start from 0.
    ``identical``: the whole string parses back to the source turns.

    Each turn is first rendered as it is and reparsed; where the recovered turn differs from the source,
    its content is escaped, and the reparse is repeated on the escaped form. Escaping leaves no
    bare control string and is undone exactly, so the second reading always agrees
    (``identical`` shows it for the whole conversation). Work is linear in the text; a
    conversation becomes one string and so meets in one task.
    """
    r, t = F.coalesce(F.col("_role"), F.lit("")), F.coalesce(F.col("_text"), F.lit(""))
    src = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("_turn"), F.col(role).alias("_role"), F.col(text).alias("_text"))
    src = src.select("conv_id", "_turn", r.alias("_role"), t.alias("_text"))
    role_, text_ = F.col("_role"), F.col("_text")
    raw_ok = _reads_back(role_, text_, role_, text_)
    put = src.withColumn("_ok", raw_ok).select(
        "*", F.when(F.col("_ok"), role_).otherwise(escape(role_)).alias("_put_role"),
        F.when(F.col("_ok"), text_).otherwise(escape(text_)).alias("_put_text"),
    )
    put = put.withColumn("_piece", render_turn(F.col("_put_role"), F.col("_put_text")))
    order = Window.partitionBy("conv_id").orderBy("_turn", "_role", "_text")
    before = F.coalesce(F.sum(F.length("_piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    head = F.length("_put_role").cast("long") + F.lit(len(OPEN) + len(HEAD_END))
    span = F.struct((before + head).alias("start"), F.length("_put_text").cast("long").alias("length"))
    placed = put.select(
        "conv_id", F.row_number().over(order).alias("pos"), F.col("_piece").alias("piece"),
        F.struct(role_.alias("role"), text_.alias("text")).alias("source"), F.when(role_ == learn, span).alias("loss"),
    )
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "piece", "source", "loss"))).alias("_turns"))
    formatted = F.array_join(F.col("_turns.piece"), "")
    return whole.select(
        "conv_id", formatted.alias("formatted"), F.filter(F.col("_turns.loss"), lambda s: s.isNotNull()).alias("loss_spans"),
        F.coalesce(parse(formatted) == F.col("_turns.source"), F.lit(False)).alias("identical"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted strings say when read back: turn and loss digests per conversation."""
    turns = parse(F.col("formatted"))
    said = F.array_join(F.transform(F.col("_read"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.transform(F.col("loss_spans"), lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    read = formatted.select("conv_id", "formatted", "identical", turns.alias("_read"), F.array_join(learned, "").alias("_loss"))
    return read.select(
        "conv_id", F.size("_read").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "identical",
    )
