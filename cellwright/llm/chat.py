"""Chat formatting by perspective rotation.

A dialogue is rendered once for every participant: that speaker's messages become the assistant's,
those of all others become user messages that carry the speaker's name, and only the assistant's
text and its end mark are trained on.  Messages of role ``system`` belong to no participant: they
stay system messages in every rendering.

Messages are ordered by turn (those without come last), role and text, so that ties and repeated rows have a fixed order.
The rendering of a long dialogue comes in chunks of ``CHUNK`` messages, so that no task has to hold it: ``part`` numbers them from 0 and
``start`` is where the chunk begins, in characters of the whole rendering.  Chunks one after the other are the whole
rendering; ``mask`` has the trained spans in characters of the chunk, which with ``start`` added are those of the whole.

Texts can't forge marks: each ``<|`` in them gets a backslash (``<\\|`` two, and so on, so that it can be undone).  Names are
roles with ``% < > |`` and line ends written as ``%25 %3C %3E %7C %0D %0A``; the speaker of messages without a role is
named ``%unknown``, which no role can be.  Null texts are empty.  Messages of a null conv_id are one dialogue.  A
dialogue without participants gives no rows; an empty table gives an empty result.  Long dialogues are looked for when a plan is built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fills import numbered, running_sum
from ..plans.scratch import materialize

CHUNK = 256
#: Up to so many keys of long dialogues are broadcast, after a count.
MOST_BROADCAST = 100_000
SYSTEM = "system"
NOBODY = "%unknown"
#: Characters of a text that ranges of messages are told apart by.
_HEAD = 64
#: Characters that names can't have, and what is written for them; the first is written before the others.
_WRITTEN = [("%", "%25"), ("<", "%3C"), (">", "%3E"), ("|", "%7C"), ("\r", "%0D"), ("\n", "%0A")]
_START, _END = "<|im_start|>", "<|im_end|>\n"


def speaker_name(role: Column) -> Column:
    return F.coalesce(reduce(lambda c, w: F.replace(c, F.lit(w[0]), F.lit(w[1])), _WRITTEN, role), F.lit(NOBODY))


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def _ranked(m: DataFrame, long: DataFrame, chunk: int) -> DataFrame:
    """The messages of the dialogues ``long`` (key), with chunk numbers as ``part``.

    Messages are ranked over ranges of all of them, so that no task has to sort or hold one dialogue.  Equal texts are told apart by
    a number, if they are short, so that no range has to hold them all; of two texts that are equal so far, one is longer.
    """
    many = m.join(long, "key", "left_semi").withColumn("late", F.col("turn").isNull()).withColumn("head", F.substring("text", 1, _HEAD))
    many = many.withColumn("id", F.when(F.length("text") < _HEAD, F.monotonically_increasing_id()).otherwise(0))
    many = numbered(many, ["key", "late", "turn", "name", "head", "id"], "at", ["key", "late", "turn", "name", "text"])
    firsts = many.groupBy("key").agg(F.min("at").alias("first"))
    return many.join(firsts, "key").withColumn("part", F.floor((F.col("at") - F.col("first")) / chunk).cast("long")).select(m.columns)


def _starts(many: DataFrame, speakers: DataFrame) -> DataFrame:
    """(key, part, speaker, start) of the chunks of long dialogues, from the lengths of those before, without texts."""
    sizes = many.groupBy("key", "part", "name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    others = F.when(F.col("name") == SYSTEM, len(_START + SYSTEM)).otherwise(F.length("name") + len(_START + "user name="))
    sizes = sizes.withColumn("size", F.col("chars") + F.col("n") * (others + 1 + len(_END)))
    # what the speaker's own messages are shorter or longer by
    own = sizes.where(F.col("name") != SYSTEM).select("key", "part", F.col("name").alias("speaker"), (F.col("n") * (len("assistant") - len("user name=") - F.length("name"))).alias("change"))
    grid = sizes.groupBy("key", "part").agg(F.sum("size").alias("size")).join(speakers.select("key", F.explode("speakers").alias("speaker")), "key")
    grid = grid.join(own, ["key", "part", "speaker"], "left").select("key", "part", "speaker", (F.col("size") + F.coalesce("change", F.lit(0))).alias("size"))
    return running_sum(grid, ["part"], "size", "start", ["key", "speaker"]).select("key", "part", "speaker", "start")


def rotate(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, speaker, part, start, n_messages, rendered, mask ("start-end,..." in characters of ``rendered``, ends excluded), n_trained."""
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))
    m = turns.select(key.alias("key"), "conv_id", F.lit(0).cast("long").alias("part"), F.col("turn").cast("long").alias("turn"), speaker_name(F.col("role")).alias("name"), escaped(F.col("text")).alias("text"))
    long = materialize(m.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk).select("key"), "chat-long")
    some = long.count()
    if some:
        # so that texts of other dialogues aren't dealt for it
        long = F.broadcast(long) if some <= MOST_BROADCAST else long
        many = _ranked(m, long, chunk)
        m = m.join(long, "key", "left_anti").unionByName(many)
    # who speaks in each dialogue: narrow rows, so that the texts are dealt once, by dialogue and chunk
    speakers = m.where(F.col("name") != SYSTEM).groupBy("key").agg(F.collect_set("name").alias("speakers"))
    whose = m.select("key", "part").distinct().join(speakers, "key")
    message = F.struct(F.col("turn").isNull().alias("late"), "turn", F.col("name").alias("role"), "text")
    parts = m.groupBy("key", "part").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(message)).alias("msgs"))
    parts = parts.join(whose, ["key", "part"]).select("key", "conv_id", "part", "msgs", F.explode("speakers").alias("speaker"))
    if some:
        parts = parts.join(_starts(many, speakers), ["key", "part", "speaker"], "left").withColumn("start", F.coalesce("start", F.lit(0)))
    else:
        parts = parts.withColumn("start", F.lit(0).cast("long"))
    head = lambda x: F.concat(F.lit(_START), F.when(x.role == SYSTEM, F.lit(SYSTEM)).when(x.role == F.col("speaker"), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), x.role)), F.lit("\n"))
    body = lambda x: F.concat(x.text, F.lit(_END))
    rendered = F.array_join(F.transform("msgs", lambda x: F.concat(head(x), body(x))), "")
    span = lambda acc, x: F.concat((acc.at + F.length(head(x))).cast("string"), F.lit("-"), (acc.at + F.length(head(x)) + F.length(body(x))).cast("string"))
    spans = F.aggregate(
        "msgs",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("spans")),
        lambda acc, x: F.struct(
            (acc.at + F.length(head(x)) + F.length(body(x))).alias("at"),
            (acc.n + F.when(x.role == F.col("speaker"), F.length(body(x))).otherwise(0)).alias("n"),
            F.when(x.role == F.col("speaker"), F.concat(acc.spans, F.array(span(acc, x)))).otherwise(acc.spans).alias("spans"),
        ),
    )
    out = parts.select("conv_id", "speaker", "part", "start", F.size("msgs").cast("long").alias("n_messages"), rendered.alias("rendered"), spans.alias("s"))
    return out.select("conv_id", "speaker", "part", "start", "n_messages", "rendered", F.array_join("s.spans", ",").alias("mask"), F.col("s.n").alias("n_trained"))


def _sql() -> str:
    name = "role"
    for a, b in _WRITTEN:
        name = f"replace({name}, {f'chr({ord(a)})'}, '{b}')"
    return rf"""
WITH m AS (SELECT conv_id, turn, coalesce({name}, '{NOBODY}') AS role, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS text FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) - 1 AS nr FROM m),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM m WHERE role <> '{SYSTEM}'),
x AS (SELECT k.conv_id, speaker, nr, nr // {CHUNK} AS part, text || '<|im_end|>' || chr(10) AS body, role = speaker AS own,
    CASE WHEN role = '{SYSTEM}' THEN '<|im_start|>system' WHEN role = speaker THEN '<|im_start|>assistant' ELSE '<|im_start|>user name=' || role END || chr(10) AS head
  FROM k JOIN s ON k.conv_id IS NOT DISTINCT FROM s.conv_id),
y AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY nr) AS upto FROM x),
z AS (SELECT *, min(upto - length(head) - length(body)) OVER (PARTITION BY conv_id, speaker, part) AS start FROM y)
SELECT conv_id, speaker, part, CAST(start AS BIGINT) AS start, count(*) AS n_messages, string_agg(head || body, '' ORDER BY nr) AS rendered,
  coalesce(string_agg(CAST(upto - start - length(body) AS VARCHAR) || '-' || CAST(upto - start AS VARCHAR), ',' ORDER BY nr) FILTER (WHERE own), '') AS mask,
  CAST(coalesce(sum(length(body)) FILTER (WHERE own), 0) AS BIGINT) AS n_trained
FROM z GROUP BY conv_id, speaker, part, start"""


SQL = _sql()
