"""Chat formatting with Spark expressions only.

Template: `<<SYS>>..<</SYS>>`, `[INST]..[/INST]` and `<s>..</s>` for system, user and assistant, `<<ROLE:name>>..<</ROLE>>`
for other roles, and `<br>` between merged turns of one role.  Inside texts `&`, `<` and `[` are written as entities,
so that a formatted conversation holds those characters in marks only and can be read back without loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BREAK = "<br>"
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<<ROLE:", ">>", "<</ROLE>>")
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), (">", "&gt;"))
TURNS = "array<struct<role:string,text:string>>"


def escaped(text: Column, entities: tuple = ENTITIES[:3]) -> Column:
    for raw, entity in entities:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def unescaped(text: Column) -> Column:
    for raw, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def _by_role(role: Column, side: int, other: Column) -> Column:
    found = other
    for name, marks in MARKS.items():
        found = F.when(role == name, F.lit(marks[side])).otherwise(found)
    return found


def _opening(role: Column) -> Column:
    return _by_role(role, 0, F.concat(F.lit(OTHER[0]), escaped(role, ENTITIES), F.lit(OTHER[1])))


def _closing(role: Column) -> Column:
    return _by_role(role, 1, F.lit(OTHER[2]))


def _pieces(turns: Column) -> Column:
    """For each turn (head, body, loss): what stands before its text, the text, and whether that is under the loss.

    Adjacent turns of one role are one block, so a head is a break or closes the block before and opens another one.
    """

    def of(turn: Column, i: Column) -> Column:
        role, before = turn["role"], F.get(turns, i - 1)["role"]
        head = F.when(i == 0, _opening(role)).when(before == role, F.lit(BREAK)).otherwise(F.concat(_closing(before), _opening(role)))
        return F.struct(head.alias("head"), escaped(turn["text"]).alias("body"), (role == "assistant").alias("loss"))

    return F.transform(turns, of)


def _spans(pieces: Column) -> Column:
    """(start, chars) of the bodies under the loss, start from 0, in code points.

    Sums up to each piece: of stretches of about the square root of their number, and inside these.  An array that grows by
    one is copied each time, so no array that grows is longer than that.
    """
    size = F.size(pieces)
    step = F.ceil(F.sqrt(size)).cast("int")
    sizes = F.transform(pieces, lambda p: F.struct(F.length(p["head"]).alias("head"), F.length(p["body"]).alias("body"), p["loss"].alias("loss")))
    # In an array of one, so that they are made once and not for each stretch.
    stretches = F.transform(F.array(sizes), lambda all_sizes: F.transform(F.sequence(F.lit(1), size, step), lambda lo: F.slice(all_sizes, lo, step)))
    total = lambda part: F.aggregate(part, F.lit(0), lambda n, p: n + p["head"] + p["body"])
    none = F.array().cast("array<int>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("starts"))
    starts = lambda parts: F.aggregate(parts, begin, lambda acc, p: F.struct((acc["at"] + total(p)).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts")), lambda acc: acc["starts"])

    def inside(part: Column, start: Column) -> Column:
        def more(acc: Column, p: Column) -> Column:
            one = F.struct((acc["at"] + p["head"]).alias("start"), p["body"].alias("chars"))
            return F.struct((acc["at"] + p["head"] + p["body"]).alias("at"), F.when(p["loss"], F.array_append(acc["found"], one)).otherwise(acc["found"]).alias("found"))

        return F.aggregate(part, F.struct(start.alias("at"), F.array().cast("array<struct<start:int,chars:int>>").alias("found")), more, lambda acc: acc["found"])

    return F.flatten(F.flatten(F.transform(stretches, lambda parts: F.zip_with(parts, starts(parts), inside))))


def format_chats(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text).  One row for each conversation: conv_id, formatted, loss_spans.

    Turns are sorted by turn; ties by role, then text; a null turn comes first.  Null texts and roles are empty
    strings.  Repeated rows stay repeated turns.  Rows with a null conv_id are one conversation.  Other columns are
    ignored.  An empty table gives no row.  A conversation is one row in the end, so all its turns meet in one task.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    pieces = sorted_turns.select("conv_id", _closing(F.element_at("turns", -1)["role"]).alias("end"), _pieces(F.col("turns")).alias("pieces"))
    text = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), ""), F.col("end"))
    return pieces.select("conv_id", text.alias("formatted"), _spans(F.col("pieces")).alias("loss_spans"))


def parse_chats(chats: DataFrame) -> DataFrame:
    """chats (conv_id, formatted, loss_spans): adds turns (role, text) and loss_text, read from formatted alone.

    Turns come in the order in which they were formatted; roles and texts that were null are empty strings.  Repeated rows
    are repeated; other columns stay.  An empty table gives no row.
    """
    starts = "|".join([r"<<SYS>>", r"\[INST\]", r"<s>", r"<<ROLE:"])
    blocks = F.filter(F.split("formatted", f"(?={starts})"), lambda x: x != "")

    def turns_of(block: Column) -> Column:
        other = unescaped(F.regexp_extract(block, r"^<<ROLE:([^>]*)>>", 1))
        role = F.when(F.startswith(block, F.lit(OTHER[0])), other)
        for name, (opening, _) in MARKS.items():
            role = F.when(F.startswith(block, F.lit(opening)), F.lit(name)).otherwise(role)
        body = F.regexp_replace(block, r"^(<<SYS>>|\[INST\]|<s>|<<ROLE:[^>]*>>)|(<</SYS>>|\[/INST\]|</s>|<</ROLE>>)$", "")
        return F.transform(F.split(body, BREAK), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    # A place in a string is found by going through it, so a stretch of spans is cut out first.
    size = F.size("loss_spans")
    step = F.ceil(F.sqrt(F.greatest(size, F.lit(1)))).cast("int")
    parts = F.transform(F.when(size > 0, F.sequence(F.lit(1), size, step)).otherwise(F.array().cast("array<int>")), lambda lo: F.slice("loss_spans", lo, step))

    def cut(part: Column) -> Column:
        first, last = part[0], F.element_at(part, -1)
        text = F.substring(F.col("formatted"), first["start"] + 1, last["start"] + last["chars"] - first["start"])
        inner = F.transform(F.array(text), lambda t: F.transform(part, lambda s: unescaped(F.substring(t, s["start"] - first["start"] + 1, s["chars"]))))
        return F.flatten(inner)

    loss = F.flatten(F.transform(parts, cut))
    return chats.withColumns({"turns": F.flatten(F.transform(blocks, turns_of)).cast(TURNS), "loss_text": F.array_join(loss, "")})


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    read = parse_chats(format_chats(turns))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
     o AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
     m AS (SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))
                  + CASE WHEN role = before THEN 4 WHEN role = 'system' THEN 15 WHEN role = 'user' THEN 13 WHEN role = 'assistant' THEN 7
                         ELSE 18 + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), '>', '&gt;')) END AS chars FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""
