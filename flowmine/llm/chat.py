"""Chat formatting by event sourcing.

A chat log is a table of events: ``start`` opens a message with its role,
``delta`` adds streamed text, ``edit`` replaces the text so far, ``regenerate``
throws it away. Events are folded message by message (a long conversation is
many small groups), the messages of a conversation are then sorted and rendered
in one template:

    <|im_start|>role\\ntext<|im_end|>\\n

A text may hold control strings: between ``<`` and ``|`` one backslash more is
written than the text has, so ``<|`` never occurs inside a message and reading
back takes one away again. Roles have ``%`` and line feeds percent-encoded
besides. The loss mask is a run-length list over the formatted characters:
three runs a turn (head, text, tail), true for texts of the assistant.

Edge cases: null texts and roles are empty; messages without a sequence number
come last; ties are ordered by role, then text; equal rows are messages of
their own. Events of an unknown kind are ignored, a null conversation id is a
conversation, an empty table gives an empty result, and clashing columns of the
input are not read. One conversation's text must fit into a row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
LEARNT_ROLE = "assistant"
EVENT = ("conv_id", "message", "seq", "step", "kind", "role", "text")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def events_of(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """The event log behind a table of turns.

    Every text is streamed in two deltas; an answer is drafted once and
    regenerated, a system text is edited. Equal rows share a message key and are
    told apart by the number of their start events.
    """
    body, who = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    half = F.floor(F.length(body) / 2).cast("int")
    left, right = F.substring(body, F.lit(1), half), F.substring(body, half + 1, F.length(body))

    def event(step: int, kind: str, value: Column) -> Column:
        return F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"),
                        F.when(F.lit(kind == "start"), who).alias("role"), value.alias("text"))

    nothing = F.lit("")
    plain = F.array(event(0, "start", nothing), event(1, "delta", left), event(2, "delta", right))
    drafted = F.array(event(0, "start", nothing), event(1, "delta", right), event(2, "regenerate", nothing),
                      event(3, "delta", left), event(4, "delta", right))
    edited = F.array(event(0, "start", nothing), event(1, "delta", left), event(2, "edit", body))
    log = F.when(who == LEARNT_ROLE, drafted).when(who == "system", edited).otherwise(plain)
    return turns.select(
        F.col(conv).alias("conv_id"), F.xxhash64(F.col(turn), who, body).alias("message"),
        F.col(turn).cast("long").alias("seq"), F.explode(log).alias("e")).select(
        "conv_id", "message", "seq", "e.step", "e.kind", "e.role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text, copies): the final text of each message."""
    log = F.array_sort(F.collect_set(F.struct("step", "kind", "text")))
    grouped = events.groupBy("conv_id", "message").agg(
        F.min("seq").alias("seq"), F.max("role").alias("role"), log.alias("log"),
        F.count_if(F.col("kind") == "start").alias("copies"))
    reset = F.coalesce(F.array_max(F.transform(
        "log", lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i))), F.lit(-1))
    based = grouped.withColumn("reset", reset)
    base = F.get("log", F.col("reset"))
    parts = F.filter("log", lambda e, i: (i > F.col("reset")) & (e["kind"] == "delta"))
    text = F.concat(F.when(base["kind"] == "edit", F.coalesce(base["text"], F.lit(""))).otherwise(F.lit("")),
                    F.array_join(F.transform(parts, lambda e: F.coalesce(e["text"], F.lit(""))), ""))
    return based.select("conv_id", "seq", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"),
                        F.greatest("copies", F.lit(1)).cast("int").alias("copies"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask) of each conversation; the mask is an array of (length, loss)."""
    turn = F.struct(F.col("seq").isNull().alias("late"), "seq", "role", "text", "copies")
    sorted_ = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    turns = sorted_.select("conv_id", F.flatten(F.transform("turns", lambda t: F.array_repeat(F.struct(
        (t["role"] == LEARNT_ROLE).alias("loss"),
        F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")).alias("head"),
        escape(t["text"]).alias("text")), t["copies"]))).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(END))), "")

    def run(length: Column, loss: Column) -> Column:
        return F.struct(length.cast("long").alias("length"), loss.alias("loss"))

    mask = F.flatten(F.transform("turns", lambda t: F.array(
        run(F.length(t["head"]), F.lit(False)), run(F.length(t["text"]), t["loss"]),
        run(F.lit(len(END)), F.lit(False)))))
    return turns.select("conv_id", formatted.alias("formatted"), mask.alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds to ``formatted`` its turns (role, text) and loss_texts, the texts under the mask, as first written."""
    blocks = F.slice(F.split("formatted", r"<\|im_start\|>"), F.lit(2), F.greatest(
        F.size(F.split("formatted", r"<\|im_start\|>")) - 1, F.lit(0)))
    turns = F.transform(blocks, lambda b: F.struct(
        _unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
        unescape(F.substring(b, F.length(F.substring_index(b, "\n", 1)) + 2,
                             F.length(b) - F.length(F.substring_index(b, "\n", 1)) - 1 - len(END))).alias("text")))
    parsed = formatted.withColumn("turns", turns)
    learnt = F.filter(F.transform("turns", lambda t, i: F.when(F.get("loss_mask", i * 3 + 1)["loss"], t["text"])),
                      lambda x: x.isNotNull())
    return parsed.withColumn("loss_texts", learnt)


def format_report(turns: DataFrame) -> DataFrame:
    """Digests of every conversation, read back from its formatted text."""
    formatted = render(fold(events_of(turns)))
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    back = read_back(formatted)
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(plain, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
