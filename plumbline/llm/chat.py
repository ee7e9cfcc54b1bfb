"""Chat formatting from an event log, with DataFrame functions only.

An event has ``conv_id, msg (long), seq (long), event, role, text``; ``event`` is one of

* ``message``     a turn with its text; rows with the same (conv_id, msg) are turns of their own, by seq
* ``delta``       text streamed onto the turn(s) of ``msg``; one that arrives twice (equal in all columns) counts once
* ``edit``        replaces what ``msg`` said so far (deltas after it count on)
* ``regenerate``  like edit, and removes what later messages said before it (events of smaller seq)

A log may have a column ``copy`` (long) that tells apart messages which share ``msg``; without it they share their changes.

``fold_events`` gives the final turns, ``format_turns`` renders them and ``parse_segments`` reads them back.

Skew: a conversation is never gathered before it is rendered. Its turns are grouped by blocks of
``SEGMENT_TURNS`` message numbers, with partial aggregation before the shuffle, and the formatted output is
one row per block: a conversation is the concatenation of its segments. What a regeneration removes is found by running
maxima in blocks of messages, in blocks of these blocks, and over what is left of a conversation then.

Defined results: null text, role and event count as empty text, empty role and ``message``; a null ``msg`` or
``seq`` sorts first; ties are ordered by seq, role, text and repeated rows stay as repeated turns; an empty log gives
no rows; further columns are ignored; text of any length is kept whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENT_TURNS = 64
#: Of the log made of a finished conversation: deltas of a text, seq numbers a turn, the largest turn that has such.
PIECES, EVENTS, FAR = 3, 16, 1 << 50
TURN, END = "<|turn|>", "<|end|>\n"
LOSS_ROLES = ("assistant",)
#: Control strings that are broken up inside texts, each by escaping its first character.
CONTROL = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
_CODE = {"<": "\\l", "[": "\\b"}
_FIRST = -(2**63)


def escape(c: Column) -> Column:
    """Every backslash becomes ``\\e``; the first character of a control string becomes ``\\l`` or ``\\b``."""
    c = F.replace(c, F.lit("\\"), F.lit("\\e"))
    for s in CONTROL:
        c = F.replace(c, F.lit(s), F.lit(_CODE[s[0]] + s[1:]))
    return c


def unescape(c: Column) -> Column:
    for char, code in _CODE.items():
        c = F.replace(c, F.lit(code), F.lit(char))
    return F.replace(c, F.lit("\\e"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\n"), F.lit("\n")))


def _clean(events: DataFrame) -> DataFrame:
    return events.select(
        "conv_id",
        F.coalesce(F.col("msg").cast("long"), F.lit(_FIRST)).alias("msg"),
        (F.coalesce("copy", F.lit(0)) if "copy" in events.columns else F.lit(0)).cast("long").alias("copy"),
        F.coalesce(F.col("seq").cast("long"), F.lit(_FIRST)).alias("seq"),
        F.coalesce("event", F.lit("message")).alias("event"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def _joined(texts: Column) -> Column:
    return F.array_join(texts, "")


def _removed(e: DataFrame) -> DataFrame:
    """``conv_id, msg, cut``: the largest seq of a regeneration of an earlier message, where that removes anything."""
    up = lambda c: F.floor(F.col(c) / SEGMENT_TURNS)
    msgs = e.groupBy("conv_id", "msg").agg(F.max(F.when(F.col("event") == "regenerate", F.col("seq"))).alias("cut"), F.min("seq").alias("since"))
    msgs = msgs.withColumn("block", up("msg"))
    blocks = msgs.groupBy("conv_id", "block").agg(F.max("cut").alias("cut")).withColumn("area", F.floor(F.col("block") / 1024))
    areas = blocks.groupBy("conv_id", "area").agg(F.max("cut").alias("cut"))
    before = lambda by, order: F.max("cut").over(Window.partitionBy("conv_id", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    a = areas.select("conv_id", "area", before([], "area").alias("far")).alias("a")
    b = blocks.select("conv_id", "block", "area", before(["area"], "block").alias("near")).alias("b")
    m = msgs.select("conv_id", "msg", "block", "since", before(["block"], "msg").alias("here")).alias("m")
    b = b.join(a, _same("a", "b") & (F.col("a.area") == F.col("b.area"))).select("b.conv_id", "b.block", F.greatest("near", "far").alias("cut")).alias("b")
    out = m.join(b, _same("m", "b") & (F.col("m.block") == F.col("b.block")))
    return out.select("m.conv_id", "m.msg", "since", F.greatest("m.here", "b.cut").alias("cut")).where("cut >= since").drop("since")


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final turns ``conv_id, msg, seq, role, text`` of an event log.

    The events of a message meet in one row, as its text has to; what regenerations of earlier messages removed, its last
    replacement and the deltas after that are found inside the row.
    """
    e = _clean(events)
    said = F.struct("seq", "role", "text")
    of = lambda kind: F.when(kind, said)
    message, delta = F.col("event") == "message", F.col("event") == "delta"
    met = e.groupBy("conv_id", "msg", "copy").agg(
        F.collect_list(of(message)).alias("messages"), F.collect_set(of(delta)).alias("deltas"), F.collect_list(of(~message & ~delta)).alias("resets")
    )
    there = F.col("r.cut").isNull()
    kept = lambda c: F.filter(c, lambda x: there | (x["seq"] > F.col("r.cut")))
    cut = met.alias("m").join(_removed(e).alias("r"), _same("m", "r") & (F.col("m.msg") == F.col("r.msg")), "left")
    cut = cut.select("m.conv_id", "m.msg", kept("messages").alias("messages"), kept("deltas").alias("deltas"), F.array_max(kept("resets")).alias("reset"))
    live = cut.select("conv_id", "msg", "messages", "reset", F.sort_array(F.filter("deltas", lambda x: F.col("reset").isNull() | (x["seq"] > F.col("reset.seq")))).alias("deltas"))
    live = live.select("conv_id", "msg", "messages", "reset", F.try_element_at("deltas", F.lit(1)).alias("head"), _joined(F.col("deltas.text")).alias("tail"))
    none = F.struct(F.lit(None).cast("long").alias("seq"), F.lit("").alias("role"), F.lit("").alias("text"))
    change = F.col("reset").isNotNull() | F.col("head").isNotNull()
    turns = F.when(F.size("messages") > 0, F.col("messages")).when(change, F.array(none)).otherwise(F.array().cast("array<struct<seq:bigint,role:string,text:string>>"))
    return live.select("conv_id", "msg", "reset", "head", "tail", F.explode(turns).alias("m")).select(
        "conv_id",
        "msg",
        F.coalesce("m.seq", "reset.seq", "head.seq").alias("seq"),
        F.coalesce(F.nullif("m.role", F.lit("")), F.nullif("reset.role", F.lit("")), "head.role", F.lit("")).alias("role"),
        F.concat(F.coalesce("reset.text", "m.text", F.lit("")), "tail").alias("text"),
    )


def format_turns(turns: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """``conv_id, segment, n_turns, formatted, loss_spans``: spans are (start, length) in code points of the segment."""
    role, text = escape_role(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    t = turns.select(
        "conv_id",
        F.floor(F.coalesce("msg", F.lit(_FIRST)) / SEGMENT_TURNS).alias("segment"),
        F.struct(
            F.coalesce("msg", F.lit(_FIRST)).alias("msg"),
            "seq",
            role.alias("role"),
            text.alias("text"),
            F.coalesce("role", F.lit("")).isin(*loss_roles).alias("loss"),
        ).alias("t"),
    )
    t = t.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list("t")).alias("t"))
    head = lambda x: F.concat(F.lit(TURN), x["role"], F.lit("\n"))
    span = "struct<start:long,length:long>"
    spans = F.aggregate(
        "t",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{span}>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(head(x)) + F.length(x["text"]) + len(END)).cast("long").alias("at"),
            F.when(x["loss"], F.array_append(a["spans"], F.struct((a["at"] + F.length(head(x))).cast("long").alias("start"), F.length(x["text"]).cast("long").alias("length"))))
            .otherwise(a["spans"])
            .alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return t.select(
        "conv_id",
        "segment",
        F.size("t").cast("long").alias("n_turns"),
        _joined(F.transform("t", lambda x: F.concat(head(x), x["text"], F.lit(END)))).alias("formatted"),
        spans.alias("loss_spans"),
    )


def format_conversations(events: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    return format_turns(fold_events(events), loss_roles)


def parse_segments(segments: DataFrame) -> DataFrame:
    """``segments`` with ``turns`` (array of role, text) and ``loss_texts``, both read from ``formatted`` alone."""
    rows = F.split("formatted", r"<\|turn\|>")
    rows = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    turns = F.transform(
        rows,
        lambda x: F.struct(
            unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
            unescape(F.substr(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x) - F.length(F.substring_index(x, "\n", 1)) - 1 - len(END))).alias("text"),
        ),
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return segments.withColumns({"turns": turns, "loss_texts": loss})


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Each row of ``conversations`` as the log that would lead to it, so that its text comes out of the fold.

    What a loss role says is streamed as a draft, regenerated and streamed anew in ``PIECES`` deltas; others send a
    draft, edit it to the first part of the text and add the rest. Rows of one turn are told apart by what they say, so
    that equal rows are one log that arrives several times. Turns that are null or beyond ``FAR`` stay plain messages.
    """
    text, turn = F.coalesce("text", F.lit("")), F.col("turn").cast("long")
    step = F.ceil(F.length(text) / PIECES).cast("int")
    piece = lambda i, k: F.substr(text, step * i + 1, k)
    event = lambda i, kind, said: F.struct((turn * EVENTS + i).alias("seq"), F.lit(kind).alias("event"), said.alias("text"))
    streamed = [event(0, "message", F.lit("")), event(1, "delta", piece(PIECES - 1, step)), event(2, "regenerate", F.lit(""))]
    streamed += [event(3 + i, "delta", piece(i, step)) for i in range(PIECES)]
    sent = [event(0, "message", F.concat(F.lit("draft "), piece(0, step))), event(1, "edit", piece(0, step)), event(2, "delta", piece(1, F.length(text)))]
    plain = [F.struct(turn.alias("seq"), F.lit("message").alias("event"), text.alias("text"))]
    log = F.when(turn.isNull() | (F.abs(turn) > FAR), F.array(*plain)).when(F.col("role").isin(*LOSS_ROLES), F.array(*streamed)).otherwise(F.array(*sent))
    copy = F.xxhash64(F.coalesce("role", F.lit("")), text)
    return conversations.select("conv_id", turn.alias("msg"), copy.alias("copy"), "role", F.explode(log).alias("e")).select("conv_id", "msg", "copy", "e.seq", "e.event", "role", "e.text")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.common import table

    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = parse_segments(format_conversations(conversation_events(rows))).select(
        "conv_id",
        "n_turns",
        F.length("formatted").cast("long").alias("chars"),
        F.struct(
            "segment",
            _joined(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))).alias("turns"),
            _joined(F.col("loss_texts")).alias("loss"),
        ).alias("s"),
    )
    c = back.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("s")).alias("s"))
    loss = _joined(F.col("s.loss"))
    return c.select(
        "conv_id",
        "n_turns",
        F.sha2(_joined(F.col("s.turns")), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _sql_escape(c: str) -> str:
    c = f"replace({c}, '\\', '\\e')"
    for s in CONTROL:
        c = f"replace({c}, '{s}', '{_CODE[s[0]] + s[1:]}')"
    return c


OP1_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN) + 1 + len(END)} + length(replace({_sql_escape('role')}, chr(10), '\\n')) + length({_sql_escape('text')})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
