"""Chat formatting of typed content parts, with DataFrame functions only.

A message has a role and an array of parts: ``text``, ``image``, ``audio`` or ``document`` (any other kind is an
``attachment``). A visitor over the parts of each message keeps their order, escapes texts, puts a placeholder
for every other part, and records for each its reference (uri), its place and the number of tokens that it
will be expanded to. Messages are then joined per conversation::

    <|start|>role<|message|>content<|end|>

Escaping is reversible: in a text or role, ``<`` before ``|``, ``s>`` or ``/s>``, and ``[`` before ``INST]`` or
``/INST]``, get a backslash behind them, and what looks like that already gets one more. So no control string
of this template or of others with such marks survives in a text, and taking one backslash away restores it.
Two text parts in a row are kept apart by ``<|part|>``.

``format_messages`` returns one row per conversation: ``formatted``, ``turn_starts`` (code points), ``loss_spans``
(the contents of assistant turns: index of the turn, start and length in code points) and ``attachments``.
``read_back`` recovers the turns and the text under the mask from these alone.

A conversation is one output row, so its turns meet in one task by nature: its text must fit one. Turns are
ordered and their places summed by a window that can spill; the shuffle by conversation is the only one.

Defined cases: a null or empty text is empty; a null role is an empty role; no parts or null parts are an empty
message; a null part is left out; rows of one turn are ordered by role, then content, and repeated rows stay
repeated; null turns come first; rows with a null conversation id are one conversation; an empty table gives
an empty result. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_TYPE = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
KINDS = ("image", "audio", "document")
START, MESSAGE, END, PART = "<|start|>", "<|message|>", "<|end|>", "<|part|>"
_MARK = r"\||/?s>|/?INST\]"
_ESCAPE, _UNESCAPE = rf"(<|\[)(\\*)({_MARK})", rf"(<|\[)\\(\\*)({_MARK})"
_CONTROL = r"<\|[a-z]+\|>"

#: Tokens that a part is expanded to.
IMAGE_PATCH, AUDIO_TOKENS_A_SECOND, DOCUMENT_TOKENS_A_PAGE, UNKNOWN_TOKENS = 28, 25, 1024, 1


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"] == "text", F.lit(False))


def expanded_tokens(part: Column) -> Column:
    """Tokens of a part that is not text; at least 1, and ``UNKNOWN_TOKENS`` where its measure is not given."""
    patches = lambda side: F.ceil(part[side] / IMAGE_PATCH)
    tokens = (F.when(part["kind"] == "image", patches("width") * patches("height"))
              .when(part["kind"] == "audio", F.ceil(part["seconds"] * AUDIO_TOKENS_A_SECOND))
              .when(part["kind"] == "document", part["pages"].cast("long") * DOCUMENT_TOKENS_A_PAGE))
    return F.greatest(F.coalesce(tokens, F.lit(UNKNOWN_TOKENS)), F.lit(1)).cast("long")


def _placeholder(part: Column) -> Column:
    return F.concat(F.lit("<|"), F.when(part["kind"].isin(*KINDS), part["kind"]).otherwise("attachment"), F.lit("|>"))


def visit(parts: Column) -> Column:
    """struct(content, refs) of an array of parts; refs: kind, uri, at (code points into content), tokens."""
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART_TYPE}>")), lambda p: p.isNotNull())

    def written(part: Column, i: Column) -> Column:
        apart = _is_text(part) & (i > 0) & _is_text(F.get(parts, i - 1))
        return F.struct(
            F.when(_is_text(part), F.concat(F.when(apart, PART).otherwise(""), escape(part["text"]))).otherwise(_placeholder(part)).alias("out"),
            (~_is_text(part)).alias("ref"), part["kind"].alias("kind"), part["uri"].alias("uri"), expanded_tokens(part).alias("tokens"))

    pieces = F.transform(parts, written)
    none = F.array().cast("array<struct<kind:string,uri:string,at:bigint,tokens:bigint>>")

    def record(seen: Column, piece: Column) -> Column:
        ref = F.struct(piece["kind"].alias("kind"), piece["uri"].alias("uri"), seen["at"].alias("at"), piece["tokens"].alias("tokens"))
        return F.struct((seen["at"] + F.char_length(piece["out"])).alias("at"),
                        F.when(piece["ref"], F.concat(seen["refs"], F.array(ref))).otherwise(seen["refs"]).alias("refs"))

    refs = F.aggregate(pieces, F.struct(F.lit(0).cast("long").alias("at"), none.alias("refs")), record)["refs"]
    content = F.array_join(F.transform(pieces, lambda p: p["out"]), "")
    return F.struct(content.alias("content"), F.when(F.exists(pieces, lambda p: p["ref"]), refs).otherwise(none).alias("refs"))


def text_parts(text: Column) -> Column:
    """One text part for a plain message."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("uri"),
                            *(F.lit(None).cast(t).alias(n) for n, t in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))


def format_messages(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, turn_starts, loss_spans, attachments."""
    seen = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
                           F.coalesce(F.col(role), F.lit("")).alias("role"), visit(F.col(parts)).alias("v"))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(MESSAGE))
    seen = seen.select("conv_id", "turn", "role", head.alias("head"), F.col("v.content").alias("content"), F.col("v.refs").alias("refs"))
    seen = seen.withColumn("size", (F.char_length("head") + F.char_length("content") + len(END)).cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content", F.to_json("refs"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = seen.select("*", (F.row_number().over(order) - 1).alias("nth"), (F.sum("size").over(upto) - F.col("size")).alias("start"))
    one = F.struct("nth", "start", (F.col("role") == "assistant").alias("loss"), F.char_length("head").alias("skip"),
                   F.char_length("content").cast("long").alias("length"), F.concat("head", "content", F.lit(END)).alias("out"), "refs")
    whole = seen.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    masked = F.filter("t", lambda x: x["loss"])
    spans = F.transform(masked, lambda x: F.struct(x["nth"].alias("nth"), (x["start"] + x["skip"]).alias("start"), x["length"].alias("length")))
    refs = F.flatten(F.transform("t", lambda x: F.transform(x["refs"], lambda r: F.struct(
        x["nth"].alias("nth"), r["kind"].alias("kind"), r["uri"].alias("uri"), (x["start"] + x["skip"] + r["at"]).alias("at"), r["tokens"].alias("tokens")))))
    return whole.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["out"]), "").alias("formatted"),
                        F.transform("t", lambda x: x["start"]).alias("turn_starts"), spans.alias("loss_spans"), refs.alias("attachments"))


def _plain(content: Column) -> Column:
    """The text of a content: between control strings, unescaped."""
    return F.array_join(F.transform(F.split(content, _CONTROL), unescape), "")


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns`` (array of role and text) and ``loss_text``, read from the output columns."""
    segments = F.split(F.col("formatted"), F.lit(r"<\|end\|>"))
    out = formatted.withColumn("segments", F.slice(segments, F.lit(1), F.size(segments) - 1))  # the last one is empty
    turns = F.transform("segments", lambda s: F.split(s, r"<\|message\|>"))
    turns = F.transform(turns, lambda s: F.struct(unescape(F.substr(s[0], F.lit(len(START) + 1))).alias("role"), _plain(s[1]).alias("text")))
    masked = F.transform("loss_spans", lambda x: _plain(F.substr(
        F.get("segments", x["nth"]), (x["start"] - F.get("turn_starts", x["nth"]) + 1).cast("int"), x["length"].cast("int"))))
    return out.withColumn("turns", turns).withColumn("loss_text", F.array_join(masked, "")).drop("segments")
