"""Chat formatting that is checked by parsing it back (DataFrame functions only).

One turn is rendered as ``<s>[INST] role [/INST]text</s>``; a conversation is its turns
behind each other.  Inside roles and texts no control string may stand as it is: a tilde
goes after its first character, and control strings that already have tildes get one
more, so removing one tilde from each restores the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Control strings, with any number of tildes after the first character.
CONTROL = r"([<\[])(~*)(/?s>|/?INST\])"
TILDED = r"([<\[])~(~*)(/?s>|/?INST\])"
PLAIN = r"<s>|</s>|\[INST\]|\[/INST\]"
TURN = r"(?s)\A<s>\[INST\] (.*?) \[/INST\](.*)\z"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, TILDED, "$1$2$3")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<s>[INST] "), role, F.lit(" [/INST]"), text, F.lit("</s>"))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation; null if it doesn't follow the grammar."""
    pieces = F.split(formatted, "</s>", -1)
    turns = F.transform(
        F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct(F.regexp_extract(p, TURN, 1).alias("role"), F.regexp_extract(p, TURN, 2).alias("text"), p.rlike(TURN).alias("fits")),
    )
    fits = (F.element_at(pieces, -1) == "") & F.forall(
        turns, lambda t: t["fits"] & ~t["role"].rlike(PLAIN) & ~t["text"].rlike(PLAIN))
    return F.when(fits, F.transform(
        turns, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))))


def _round_trips(rendered: Column) -> Column:
    found = parse(rendered)
    return F.coalesce((F.size(found) == 1) & (found[0]["role"] == F.col("role")) & (found[0]["text"] == F.col("text")), F.lit(False))


def format_chats(rows: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (code points, end exclusive), n_escaped; one row per conversation.

    Each turn is rendered as it stands and parsed back.  Where the parser doesn't return
    the source, its conflicting control strings are escaped and the turn is rendered and
    compared again.  The whole conversation is parsed at last and must equal its turns;
    otherwise the job fails.  The loss mask covers the texts of `trained_role`.

    One row holds a whole conversation, as its formatted text does; nothing larger is gathered.

    Cases: null text or role is empty; turns with equal numbers are ordered by role and
    text, null numbers come first; repeated rows are repeated turns; a null conv_id is a
    conversation of its own; no rows give no rows; further columns are ignored.
    """
    turns = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tried = turns.withColumn("first", render(F.col("role"), F.col("text"))).withColumn("fits", _round_trips(F.col("first")))
    tried = tried.withColumn("rendered", F.when(F.col("fits"), F.col("first")).otherwise(render(escape(F.col("role")), escape(F.col("text")))))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    length = F.char_length("rendered").cast("long")
    head = F.char_length(render(F.when(F.col("fits"), F.col("role")).otherwise(escape(F.col("role"))), F.lit(""))) - len("</s>")
    placed = (
        tried.select("conv_id", "turn", "role", "text", "rendered", "fits", length.alias("length"), head.cast("long").alias("head"))
        .withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")))
    )
    item = F.struct("start", "length", "head", "rendered", "role", "text")
    whole = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(item)).alias("turns"), F.sum((~F.col("fits")).cast("long")).alias("n_escaped"))
    whole = whole.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"),
        F.transform(
            F.filter("turns", lambda t: t["role"] == trained_role),
            lambda t: F.struct((t["start"] + t["head"]).alias("start"), (t["start"] + t["length"] - len("</s>")).alias("end")),
        ).alias("loss_spans"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"), "n_escaped")
    same = F.coalesce(parse(F.col("formatted")) == F.col("source"), F.lit(False))
    return whole.select(
        "conv_id",
        F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation doesn't survive the round trip"))).alias("formatted"),
        "loss_spans", "n_escaped")


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
