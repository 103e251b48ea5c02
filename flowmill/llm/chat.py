"""Chat formatting with typed content parts, in DataFrame operations only.

A visitor turns every part of a message into text by its kind: text is escaped, an image, an audio clip or a document
becomes a placeholder, and its reference and token count are recorded in the same order as the placeholders stand.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDER = r"<\|(\w+)\|>"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    """No control string can stand in the result, nor begin in it: every `<` gets a tilde after it, whatever part of a message follows."""
    return F.replace(text, F.lit("<"), F.lit("<~"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<~"), F.lit("<"))


def _zero(part: Column) -> Column:
    return F.lit(0).cast("long")


def _image(part: Column) -> Column:
    side = lambda x: F.ceil(F.coalesce(x, F.lit(0)) / 28)
    return (side(part.width) * side(part.height) + 2).cast("long")


def _audio(part: Column) -> Column:
    return F.ceil(F.coalesce(part.seconds, F.lit(0.0)) * 25).cast("long")


def _document(part: Column) -> Column:
    return (F.coalesce(part.pages, F.lit(0)) * 256).cast("long")


@dataclass(frozen=True)
class Visitor:
    """How each kind of part that isn't text is counted; its placeholder is `<|kind|>`. Other kinds: `<|other|>`, 0 tokens."""

    tokens: dict[str, Callable[[Column], Column]] = field(default_factory=lambda: {"image": _image, "audio": _audio, "document": _document})

    def text(self, part: Column) -> Column:
        out = F.when(part.kind == "text", escape(F.coalesce(part.text, F.lit(""))))
        for kind in self.tokens:
            out = out.when(part.kind == kind, F.lit(f"<|{kind}|>"))
        return out.otherwise(F.lit("<|other|>"))

    def attachment(self, part: Column) -> Column:
        count = F.when(part.kind == "text", _zero(part))
        for kind, f in self.tokens.items():
            count = count.when(part.kind == kind, f(part))
        return F.struct(F.coalesce(part.kind, F.lit("other")).alias("kind"), part.ref.alias("ref"), F.coalesce(count, F.lit(0).cast("long")).alias("tokens"))


def text_part(text: Column) -> Column:
    """One part that holds a plain text."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learn: tuple[str, ...] = ("assistant",), visitor: Visitor | None = None) -> DataFrame:
    """One row per conversation: conv, n_turns, formatted, loss (array of start and length in code points), attachments, expanded_tokens.

    Messages stand by turn; equal turns by role, then by their rendered text; null turns first. A null role is empty, a
    null part list or text is empty, repeated rows are repeated turns, and a null conv is a conversation of its own.
    Other columns are ignored, whatever their names. An empty table gives no rows. A message's place is a running sum
    in a window, so that only the result itself is held for a conversation, which is one training example.
    """
    visitor = visitor or Visitor()
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")).alias("parts"))
    rows = rows.select(
        "conv", "turn", "role",
        F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY)).alias("head"),
        F.array_join(F.transform("parts", visitor.text), "").alias("body"),
        F.transform(F.filter("parts", lambda p: F.coalesce(p.kind, F.lit("other")) != "text"), visitor.attachment).alias("attached"),
    )
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("head") + F.length("body") + len(END)
    rows = rows.select("*", F.row_number().over(order).alias("nth"), (F.sum(size).over(before) - F.length("body") - len(END)).alias("start"))
    turns = F.sort_array(F.collect_list(F.struct("nth", "start", "role", "head", "body", "attached")))
    grouped = rows.groupBy("conv").agg(turns.alias("turns"))
    return grouped.select(
        F.col("conv").alias(conv),
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit(END))), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t.role.isin(*learn)), lambda t: F.struct(t.start.alias("start"), F.length(t.body).alias("length"))).alias("loss"),
        F.flatten(F.transform("turns", lambda t: t.attached)).alias("attachments"),
        F.aggregate(F.flatten(F.transform("turns", lambda t: t.attached)), F.lit(0).cast("long"), lambda n, a: n + a.tokens).alias("expanded_tokens"),
    )


def without_placeholders(body: Column) -> Column:
    """A rendered body's text parts alone. No text can be mistaken for a placeholder, since every `<` of a text is escaped."""
    return F.regexp_replace(body, PLACEHOLDER, "")


def read_turns(formatted: Column, placeholders: bool = True) -> Column:
    """The turns in a formatted conversation: array of role, text (unescaped) and placeholders (kinds of the parts that aren't text, in order).

    Placeholders stay in the text unless told otherwise: `formatted` tells them from texts that look like them, whose `<` is escaped.
    """
    pieces = F.split(formatted, r"<\|end\|>", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    role = lambda p: F.substring_index(p, BODY, 1)
    body = lambda p: F.substr(p, F.length(role(p)) + len(BODY) + 1)
    shown = (lambda x: x) if placeholders else without_placeholders
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substr(role(p), F.lit(len(TURN) + 1))).alias("role"), unescape(shown(body(p))).alias("text"), F.regexp_extract_all(body(p), F.lit(PLACEHOLDER), F.lit(1)).alias("placeholders"),
    ))


def read_loss(formatted: Column, loss: Column, placeholders: bool = True) -> Column:
    """All text under the loss mask, unescaped, in order; with or without placeholders."""
    shown = (lambda x: x) if placeholders else without_placeholders
    return F.array_join(F.transform(loss, lambda s: unescape(shown(F.substr(formatted, (s.start + 1).cast("int"), s.length)))), "")


#: The conversation that op10 adds: control strings of other templates, a backslash, and what looks like an end.
HARD = r"\### Assistant: </turn> ok"


def page_part(url: Column, html: Column, page: Column) -> Column:
    """A part for a web page: by its number an image (a screenshot), an audio clip (read out), or a document (printed), as large as the page is long."""
    n = F.length(html)
    kind = F.element_at(F.array(*map(F.lit, ATTACHED)), (F.pmod(page, F.lit(len(ATTACHED))) + 1).cast("int"))
    of = lambda name, value, kind_of: F.when(kind == name, value).cast(kind_of)
    return F.struct(
        kind.alias("kind"), F.lit(None).cast("string").alias("text"), url.alias("ref"), of("image", 640 + n % 640, "int").alias("width"), of("image", 480 + n % 480, "int").alias("height"),
        of("audio", n / 16, "double").alias("seconds"), of("document", F.ceil(n / 3000), "int").alias("pages"),
    )


#: Kinds of parts that the query attaches.
ATTACHED = ("image", "audio", "document")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of typed parts: a user's first turn (turn 0) shows the page with the conversation's number, before its text, where there is one."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD).alias("text"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").groupBy(F.col("page_id").alias("_page")).agg(F.min(page_part(F.col("url"), F.col("html"), F.col("page_id"))).alias("_part"))
    shown = (F.col("turn") == 0) & (F.col("role") == "user")
    rows = rows.unionByName(extra).join(pages, (F.col("conv_id") == F.col("_page")) & shown, "left")
    texts = text_part(F.coalesce("text", F.lit("")))
    chats = format_chats(rows.select("conv_id", "turn", "role", F.when(F.col("_part").isNotNull(), F.concat(F.array("_part"), texts)).otherwise(texts).alias("parts")))
    read = chats.select("*", read_turns(F.col("formatted"), False).alias("turns"), read_loss(F.col("formatted"), F.col("loss"), False).alias("learned"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.array_join(F.flatten(F.transform("turns", lambda t: t.placeholders)), ",").alias("placeholders"),
        F.array_join(F.transform("attachments", lambda a: F.coalesce(a.ref, F.lit(""))), ",").alias("references"),
        "expanded_tokens",
    )


_KIND = " ".join(f"WHEN {k} THEN '{kind}'" for k, kind in enumerate(ATTACHED))
OP10_SQL = rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{HARD}'), (-7, 1, 'assistant', '{HARD}')
),
shown AS (SELECT page_id, url, length(html) AS n, CASE page_id % {len(ATTACHED)} {_KIND} END AS kind FROM pages),
sized AS (SELECT *, CASE kind WHEN 'image' THEN ceil((640 + n % 640) / 28.0) * ceil((480 + n % 480) / 28.0) + 2 WHEN 'audio' THEN ceil(n / 16.0 * 25) ELSE ceil(n / 3000.0) * 256 END AS tokens FROM shown),
rows AS (SELECT * FROM said LEFT JOIN sized ON conv_id = page_id AND turn = 0 AND role = 'user')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(replace(role, '<', '<~')) + length(replace(text, '<', '<~')) + {len(TURN + BODY + END)} + CASE WHEN kind IS NULL THEN 0 ELSE length(kind) + 4 END) AS BIGINT) AS formatted_chars,
  coalesce(string_agg(kind, ',' ORDER BY turn), '') AS placeholders, coalesce(string_agg(url, ',' ORDER BY turn), '') AS "references", CAST(coalesce(sum(tokens), 0) AS BIGINT) AS expanded_tokens
FROM rows GROUP BY conv_id
"""
