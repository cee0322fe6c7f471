"""Chat formatting of typed content parts, with DataFrame operations only.

A turn is written as `<|role|>`, newline, body, `<|end|>`, newline. A body joins its parts in order: text escaped, and one
placeholder for each image, audio or document. `&`, `<`, `[` and `|` inside texts and roles are written as character
references, so no control string of this or another template survives inside them, and unescaping gives the text back.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>\n"
#: Escapes in the order of writing; reading goes backwards.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("|", "&#124;"))
#: Tokens that a part's placeholder stands for, for each unit: an image's patch, a second of audio, a page.
TOKENS = {"image": 1, "audio": 25, "document": 600}
PARTS = "array<struct<type:string,text:string,ref:string,units:long>>"


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def text_part(text: Column) -> Column:
    """A content of one text part."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), none.cast("string").alias("ref"), none.cast("long").alias("units"))).cast(PARTS)


def _visit(part: Column) -> Column:
    kind = F.lower(part["type"])
    media = F.when(kind.isin(*TOKENS), F.concat(F.lit("<|"), kind, F.lit("|>")))
    return F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.coalesce(media, F.lit("<|unknown|>")))


def _tokens(part: Column) -> Column:
    rate = F.element_at(F.create_map(*[F.lit(x) for kv in TOKENS.items() for x in kv]), F.lower(part["type"]))
    return F.coalesce(part["units"] * rate, F.lit(0)).cast("long")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Rows of turns with typed parts (PARTS) -> one row per conversation: conv, formatted, spans, attachments.

    spans are the (start, length) in code points, from 0, of the bodies of the roles in `learn`: the loss mask. attachments
    are the parts that are not text, in the order of their placeholders, with turn, type, ref and expanded tokens.
    Turns stand in the order of turn, then role, then the texts of the content, as they are unescaped; null turns first. A null role or text is empty, null content
    has no parts, an unknown type becomes `<|unknown|>`, repeated rows are turns of their own, a null conversation is one
    conversation, an empty table gives no rows. Offsets come from a running sum over rows; a conversation's text is
    gathered once, as its one output cell needs. Other columns are not read.
    """
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(content).cast(PARTS), F.array().cast(PARTS)).alias("parts"))
    rows = rows.withColumn("body", F.array_join(F.transform("parts", _visit), ""))
    rows = rows.withColumn("head", F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n")))
    rows = rows.withColumn("size", F.length("head") + F.length("body") + len(END))
    raw = F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), "")
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", raw, "body")
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn("from", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + F.length("head"))
    media = F.filter("parts", lambda p: F.coalesce(F.lower(p["type"]) != "text", F.lit(True)))
    media = F.transform(media, lambda p: F.struct(F.col("turn").cast("long").alias("turn"), F.lower(p["type"]).alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    rows = rows.select("conv", F.struct("nth", F.concat("head", "body", F.lit(END)).alias("line"), F.struct(F.col("from").alias("start"), F.length("body").cast("long").alias("length")).alias("span"), F.col("role").isin(*learn).alias("learn"), media.alias("media")).alias("t"))
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return whole.select(
        F.col("conv").alias(conv), F.array_join(F.transform("t", lambda x: x["line"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["learn"]), lambda x: x["span"]).alias("spans"), F.flatten(F.transform("t", lambda x: x["media"])).alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text)."""
    pieces = F.split(formatted, "<\\|end\\|>\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    return F.transform(
        pieces,
        lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(3)), "|>\n", 1)).alias("role"), unescape(F.substr(p, F.locate("|>\n", p) + 3)).alias("text")),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
