r"""Chat formatting of conversations with typed content parts, in DataFrame functions only.

A turn's content is an array of parts ``struct<type, text, uri, width, height,
seconds, pages>``.  A visitor, one handler per type, flattens it: text parts
are escaped, image, audio and document parts become the placeholders
``<|image|>``, ``<|audio|>``, ``<|document|>`` in order.  The attachments of a
conversation are recorded in the order of their placeholders with the number
of tokens each expands to.

Template of a conversation: ``<s>``, then per turn
``<|turn|>role<|body|>content<|end|>``, then ``</s>``.  Control strings inside
texts and roles get a backslash after their first character and backslashes
are doubled, so no text can look like a marker, and dropping the escape
characters gives the text back.  ``read_back`` does so from the formatted
string alone; ``read_loss`` cuts the texts under the mask out of it.

The loss mask holds per turn where its content lies in the formatted string
(code points) and whether it counts: assistant contents do, markers do not.

One shuffle, by conversation; positions are running sums over its sorted
rows.  A conversation is one output row and has to fit into a task.

Defined results: null text and null parts are empty, a null role is an empty
role; rows of a null ``conv_id`` form one conversation; equal turns are
ordered by role and content, repeated rows are kept; parts of an unknown type
are read as text; an empty table gives no rows.  Only the named columns are
read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table

BOS, EOS = "<s>", "</s>"
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
ESCAPE = "\\"
# fixed values: the beginnings or whole strings that a text must not carry as they are
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
PART = ("struct<type:string,text:string,uri:string,width:int,height:int,"
        "seconds:double,pages:int>")

PATCH = 28                  # pixels of an image patch, one token each
AUDIO_TOKENS = 25           # per second
PAGE_TOKENS = 800           # per document page


def escape(text: Column) -> Column:
    """Reversibly broken control strings (a null is an empty text)."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit(ESCAPE), F.lit(ESCAPE * 2))
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(s[0] + ESCAPE + s[1:])), CONTROL, out)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_tokens(text: Column) -> Column:
    """Words and punctuation marks of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\w+|[^\w\s]")).cast("long")


def _patches(p: Column) -> Column:
    return (F.ceil(F.coalesce(p["width"], F.lit(0)) / PATCH)
            * F.ceil(F.coalesce(p["height"], F.lit(0)) / PATCH)).cast("long")


#: The visitor: part type -> (flattened text, expanded tokens)
HANDLERS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {
    "image": (lambda p: F.lit("<|image|>"), _patches),
    "audio": (lambda p: F.lit("<|audio|>"),
              lambda p: F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_TOKENS).cast("long")),
    "document": (lambda p: F.lit("<|document|>"),
                 lambda p: (F.coalesce(p["pages"], F.lit(0)) * PAGE_TOKENS).cast("long")),
}


def visit(part: Column, which: int) -> Column:
    """Flattened text (0) or expanded tokens (1) of a part, by its type."""
    text = (escape(part["text"]), text_tokens(part["text"]))[which]
    out = None
    for kind, handler in HANDLERS.items():
        hit, value = part["type"] == kind, handler[which](part)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(text)


def text_part(text: Column) -> Column:
    """A content of one text part."""
    null = {"uri": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"),
                            *[F.lit(None).cast(t).alias(n) for n, t in null.items()]))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns(conv_id, turn, role, parts)``:
    ``conv_id, formatted, loss_mask, attachments, n_tokens``."""
    parts = F.filter(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    kinds = list(HANDLERS)
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts")).select(
        "conv_id", "turn", "role",
        F.concat_ws("", F.transform("parts", lambda p: visit(p, 0))).alias("content"),
        F.transform(F.filter("parts", lambda p: F.coalesce(p["type"].isin(*kinds), F.lit(False))),
                    lambda p: F.struct(p["type"].alias("type"), p["uri"].alias("uri"),
                                       visit(p, 1).alias("tokens"))).alias("attachments"),
        F.aggregate(F.transform("parts", lambda p: visit(p, 1)), F.lit(0).cast("long"),
                    lambda a, x: a + x).alias("tokens"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    rows = (rows.withColumn("head", head)
            .withColumn("line", F.concat("head", "content", F.lit(END))))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    rows = (rows.withColumn("pos", F.row_number().over(order))
            .withColumn("before", F.coalesce(
                F.sum(F.char_length("line").cast("long"))
                .over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))))
    mask = F.struct((F.col("before") + len(BOS) + F.char_length("head")).alias("start"),
                    F.char_length("content").cast("long").alias("length"),
                    (F.col("role") == "assistant").alias("loss"))
    return (rows.groupBy("conv_id")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "line", mask.alias("mask"), "attachments")))
                 .alias("t"), F.sum("tokens").alias("n_tokens"))
            .select("conv_id",
                    F.concat(F.lit(BOS), F.concat_ws("", "t.line"), F.lit(EOS)).alias("formatted"),
                    F.col("t.mask").alias("loss_mask"),
                    F.flatten("t.attachments").alias("attachments"), "n_tokens"))


def read_back(formatted: Column) -> Column:
    """``array<struct<role, text>>`` of a formatted conversation."""
    lines = F.split(formatted, END.replace("|", r"\|"), -1)
    lines = F.slice(lines, 1, F.size(lines) - 1)
    return F.transform(lines, lambda x: F.struct(
        unescape(F.substring_index(F.substring_index(x, BODY, 1), TURN, -1)).alias("role"),
        unescape(F.substring_index(x, BODY, -1)).alias("text")))


def read_loss(formatted: Column, mask: Column) -> Column:
    """The texts under the spans of a mask that count for the loss, cut out of ``formatted``."""
    return F.concat_ws("", F.transform(
        F.filter(mask, lambda m: m["loss"]),
        lambda m: unescape(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))))


PROBE = "</s>[INST] ok [/INST]"


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        "role", "text")
    probe = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.inline(F.array(
        *[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(PROBE).alias("text"))
          for i, r in enumerate(("user", "assistant"))])))
    chats = format_chats(turns.unionByName(probe)
                         .select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts")))
    back = chats.withColumn("turns", read_back(F.col("formatted")))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"],
                                                                   F.lit("\n"))))
    learnt = read_loss(F.col("formatted"), F.col("loss_mask"))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def _sql_escape(column: str) -> str:
    out = f"replace({column}, '{ESCAPE}', '{ESCAPE * 2}')"
    for s in CONTROL:
        out = f"replace({out}, '{s}', '{s[0] + ESCAPE + s[1:]}')"
    return out


OP2_SQL = f"""
WITH t AS (
    SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role,
           coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
e AS (SELECT *, {_sql_escape('text')} AS content, {_sql_escape('role')} AS r FROM t),
g AS (
    SELECT conv_id, count(*) AS n,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, content) AS said,
           coalesce(string_agg(text, '' ORDER BY turn, role, content)
                    FILTER (WHERE role = 'assistant'), '') AS learnt,
           sum(length(content) + length(r)) AS inner_chars
    FROM e GROUP BY conv_id)
SELECT conv_id, n AS n_turns, sha256(said) AS turns_sha256, length(learnt)::BIGINT AS loss_chars,
       sha256(learnt) AS loss_sha256,
       (inner_chars + {len(BOS) + len(EOS)} + n * {len(TURN) + len(BODY) + len(END)})::BIGINT
           AS formatted_chars
FROM g"""
