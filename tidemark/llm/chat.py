"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context and only that reply is trainable.  Examples of one conversation are
prefixes of one formatted string, so the output keeps each turn once, with its
place in that string (``start_char``), the number of the first example that
contains it (``example``) and the span under the loss mask; example ``k`` is
the text of all rows with ``example <= k``, masked to the span of its last one.
The output thus grows with the input even where one conversation holds a third
of all turns; :func:`expand` gives the examples as spans of that string, and
:func:`digests` reads each of them back.  Turns after the last reply are one last example without a mask.

Formatting is a pure column expression; the places come from a running window
that spills, and reading back streams sorted turns through incremental digests,
so no conversation is ever held in memory.

Control strings inside texts and roles get a backslash after their first
character, and backslashes are doubled; :func:`unescape` undoes exactly that.
Defined cases: null text or role is empty; rows of one turn number are ordered
by role and text; repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

#: Opening and closing mark of each role; another role is written out between the last two.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
_CONTROL = [*(m for pair in MARKS.values() for m in pair), ROLE, TEXT, END]
_PATTERN = "|".join(rf"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in _CONTROL)
_TURN = re.compile("|".join(f"(?P<{r}>{re.escape(a)}(.*){re.escape(b)})" for r, (a, b) in MARKS.items()) + f"|{re.escape(ROLE)}(.*){re.escape(TEXT)}(.*){re.escape(END)}", re.DOTALL)
_BACK = re.compile(r"\\(.)", re.DOTALL)


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), _PATTERN, r"\\")


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    m = _TURN.fullmatch(formatted)
    if not m:
        raise ValueError("no formatted turn")
    for role, (a, b) in MARKS.items():
        if m[role] is not None:
            return role, unescape(formatted[len(a) : len(formatted) - len(b)])
    other, text = formatted[len(ROLE) : len(formatted) - len(END)].split(TEXT)
    return unescape(other), unescape(text)


def format_turns(df: DataFrame) -> DataFrame:
    """conv_id, turn, formatted, loss_from and loss_to (code points in
    ``formatted``; null but for the assistant), start_char, example, last_of."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    body, reply = escape(text), role == "assistant"
    formatted = F.concat(F.lit(ROLE), escape(role), F.lit(TEXT), body, F.lit(END))
    for r, (a, b) in MARKS.items():
        formatted = F.when(role == r, F.concat(F.lit(a), body, F.lit(b))).otherwise(formatted)
    opening, closing = map(len, MARKS["assistant"])
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = df.select("conv_id", "turn", "role", "text").withColumn("formatted", formatted).withColumn("n", F.length("formatted"))
    out = out.withColumn("start_char", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint")).withColumn("example", F.count(F.when(reply, 1)).over(before))
    return out.select(
        "conv_id",
        "turn",
        "formatted",
        "start_char",
        "example",
        F.when(reply, F.lit(opening)).cast("bigint").alias("loss_from"),
        F.when(reply, F.col("n") - closing).cast("bigint").alias("loss_to"),
    )


def expand(turns: DataFrame) -> DataFrame:
    """The expansion: a row for each example with its number, the characters of its
    context and of the whole, and the span under the mask, all within the example's
    own text.  Turns after the last reply are one example whose mask is null."""
    at = lambda c: F.col("start_char") + c
    end = at(F.length("formatted")).alias("end_char")
    replies = turns.where("loss_from is not null").select("conv_id", "example", F.col("start_char").alias("context_chars"), end, at(F.col("loss_from")).alias("loss_from"), at(F.col("loss_to")).alias("loss_to"))
    last = turns.groupBy("conv_id").agg(F.max(F.struct("start_char", "example", at(F.length("formatted")).alias("end_char"), "loss_from")).alias("last"))
    none = F.lit(None).cast("bigint")
    rest = last.where("last.loss_from is null").select("conv_id", "last.example", F.col("last.end_char").alias("context_chars"), "last.end_char", none.alias("loss_from"), none.alias("loss_to"))
    return replies.unionByName(rest)


def examples(turns: DataFrame) -> DataFrame:
    """The expanded examples themselves, with their whole context as text (for
    conversations of bounded length: the texts grow with the square of the turns);
    turns after the last reply are context of an example with an empty target."""
    order = Window.partitionBy("conv_id").orderBy("start_char")
    context = F.array_join(F.collect_list("formatted").over(order.rowsBetween(Window.unboundedPreceding, -1)), "")
    rows = turns.withColumn("context", context).withColumn("last", F.lead("start_char").over(order).isNull())
    reply = F.col("loss_from").isNotNull()
    target = F.when(reply, F.col("formatted")).otherwise(F.lit(""))
    return rows.where(reply | F.col("last")).select("conv_id", "example", F.when(reply, F.col("context")).otherwise(F.concat("context", "formatted")).alias("context"), target.alias("target"), "loss_from", "loss_to")


def digests(turns: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Read formatted turns and the examples of :func:`expand` back: for each
    conversation n_turns, turns_sha256, loss_chars, loss_sha256, n_examples and
    formatted_chars (of all examples).  An example's mask is cut out of its text by
    its own span; one that does not lie in its last turn raises."""
    kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())]
    schema = pa.schema(kinds)
    give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, schema.types, strict=True)], schema=schema)

    def run(batches):
        now, n, chars, loss_chars, total, made, last = None, 0, 0, 0, 0, 0, ""
        turns_sha = loss_sha = None
        rows: list[tuple] = []

        def close():
            if turns_sha is not None:
                rows.append((now, n, turns_sha.hexdigest(), loss_chars, loss_sha.hexdigest(), total, made))

        for batch in batches:
            for conv, formatted, end, a, b in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if turns_sha is None or conv != now:
                    close()
                    now, n, chars, loss_chars, total, made, last = conv, 0, 0, 0, 0, 0, ""
                    turns_sha, loss_sha = hashlib.sha256(), hashlib.sha256()
                if formatted is not None:
                    role, text = parse_turn(formatted)
                    turns_sha.update(f"{role}\n{text}\n".encode())
                    n, chars, last = n + 1, chars + len(formatted), formatted
                    continue
                if end != chars or (a is not None and not chars - len(last) <= a <= b <= chars):
                    raise ValueError(f"an example of conversation {conv} does not end with its turns")
                total, made = total + end, made + 1
                if a is not None:
                    target = unescape(last[a - chars + len(last) : b - chars + len(last)])
                    loss_sha.update(target.encode())
                    loss_chars += len(target)
            yield give(rows)
            rows.clear()
        close()
        yield give(rows)

    none = F.lit(None).cast("bigint")
    told = turns.select("conv_id", "formatted", none.alias("end_char"), none.alias("loss_from"), none.alias("loss_to"), "start_char", F.lit(0).alias("kind"))
    asked = (expand(turns) if index is None else index).select("conv_id", F.lit(None).cast("string").alias("formatted"), "end_char", "loss_from", "loss_to", F.col("context_chars").alias("start_char"), F.lit(1).alias("kind"))
    rows = small_batches(told.unionByName(asked)).repartition("conv_id").sortWithinPartitions("conv_id", "start_char", "kind")
    return rows.drop("start_char", "kind").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_examples bigint")
