"""Chat formatting with Spark expressions only: sorted turn structs, merged runs of a role, reversible escapes, loss spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template. `<` never occurs inside an escaped text or role, so every `<` is the template's own.
OPEN, HEAD_END, JOIN, CLOSE = "<|", "|>\n", "<+>", "<.>\n"
#: Turns of a conversation that one aggregation buffer gathers before the parts are put together.
CHUNK = 512
#: Pieces whose spans are added up one by one.
BLOCK = 128


def escape(c: Column) -> Column:
    """Backslash to `\\b`, `<` to `\\l`, `|` to `\\p`: no escaped text can hold a marker."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("|"), F.lit("\\p"))


def unescape(c: Column) -> Column:
    """Inverse of escape(): every backslash of an escaped text starts a two-character code."""
    return F.replace(F.replace(F.replace(c, F.lit("\\p"), F.lit("|")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row a conversation: conv, `formatted` and `loss_spans` (start and length in code points of every text of the
    role `learn`, adjacent turns of a role being merged under one header and told apart by a join mark).

    Rows go by turn, ties by role and text; a null turn comes first; a null role or text is empty; a null conversation
    is a conversation of its own; repeated rows stay; other columns are ignored. No rows give no rows.
    """
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("at"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    part = F.coalesce(F.floor(F.col("at") / CHUNK), F.lit(-(2**62)))
    parts = rows.groupBy("conv", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))
    whole = parts.groupBy("conv").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "turns"))), lambda p: p["turns"])).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        before, after = F.get(F.col("turns"), i - 1)["role"], F.get(F.col("turns"), i + 1)["role"]
        head = F.when((i > 0) & (before == t["role"]), F.lit(JOIN)).otherwise(F.concat(F.lit(OPEN), escape(t["role"]), F.lit(HEAD_END)))
        foot = F.when(F.coalesce(after == t["role"], F.lit(False)), F.lit("")).otherwise(F.lit(CLOSE))
        body = escape(t["text"])
        return F.struct(F.concat(head, body, foot).alias("s"), F.length(head).alias("lead"), F.length(body).alias("n"), F.length(foot).alias("tail"), (t["role"] == learn).alias("learn"))

    whole = whole.withColumn("pieces", F.transform("turns", piece))
    # Spans of each BLOCK of pieces from 0, then the blocks' own places: an array that grows is copied whenever it does, so that one
    # over all turns would cost their square.
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size("pieces") - 1, F.lit(0)), F.lit(BLOCK)), lambda at: _spans(F.slice("pieces", at + 1, BLOCK)))
    whole = whole.withColumn("blocks", blocks)
    places = F.aggregate(
        "blocks", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("begin")),
        lambda acc, p: F.struct((acc["at"] + p["at"]).alias("at"), F.concat(acc["begin"], F.array(acc["at"])).alias("begin")),
    )["begin"]
    whole = whole.withColumn("places", places)
    spans = F.flatten(F.transform("blocks", lambda p, i: F.transform(p["spans"], lambda s: F.struct((s["start"] + F.get(F.col("places"), i)).alias("start"), s["length"].alias("length")))))
    return whole.select(F.col("conv").alias(conv), F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), spans.alias("loss_spans"))


def _spans(pieces: Column) -> Column:
    """at, the length of all pieces, and spans, the learned ones among them."""
    return F.aggregate(
        pieces,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + p["lead"] + p["n"] + p["tail"]).alias("at"),
            F.when(p["learn"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["lead"]).alias("start"), p["n"].cast("long").alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )


def read_turns(formatted: Column) -> Column:
    """The array<struct<role, text>> that a formatted conversation was made of, one struct for each row that went in."""
    parts = F.split(formatted, r"<\|")
    runs = F.slice(parts, F.lit(2), F.size(parts))
    return F.flatten(
        F.transform(
            runs,
            lambda run: F.transform(
                F.split(F.substring_index(F.substr(run, F.instr(run, HEAD_END) + F.lit(len(HEAD_END))), CLOSE, 1), r"<\+>", -1),
                lambda text: F.struct(unescape(F.substring_index(run, HEAD_END, 1)).alias("role"), unescape(text).alias("text")),
            ),
        )
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and in order."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))), ""))


def digest(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the formatted conversations hold, read back from them."""
    read = chats.select(conv, "formatted", read_turns(F.col("formatted")).alias("back"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        conv,
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
