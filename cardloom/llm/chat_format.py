r"""Chat formatting that is proved by reading it back, in DataFrame functions only.

A turn is ``<s>``, a mark of its role, its text and ``</s>``; the marks are ``[INST]`` (user), ``[ANS]``
(assistant), ``[SYS]`` (system) and, for any other role, ``[ROLE]name[/ROLE]``. A deterministic parser, one
regular expression over the whole string, recovers the turns. Each conversation is formatted with its
texts as they are and parsed; only where that does not give back the source, turn by turn, are the
control strings in its texts escaped (a backslash behind their bracket, one more where there are some
already) and the result parsed again. Reading back takes one backslash away. Escaped texts hold no
control string, so that the second reading always equals the source; a row for which it did not
would raise an error rather than pass.

``loss`` is a run-length mask over the code points of ``formatted``: learn from assistants' texts only.

Defined results: null roles and texts are empty; turns in ascending order, null first, equal ones by
role and text; rows without ``conv_id`` are one conversation of the id null; no rows give none. Other
columns are ignored. A conversation is one string, and is held whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.columns import bound
from cardloom.llm.common import quoted

# --- fixed values: the grammar --------------------------------------------------------------
BEGIN, END = "<s>", "</s>"
MARKS = {"user": "[INST]", "assistant": "[ANS]", "system": "[SYS]"}
NAMED, NAMED_END = "[ROLE]", "[/ROLE]"
#: What follows a bracket in a control string, behind any number of backslashes.
ANGLE, SQUARE = r"\\*/?s>", r"\\*(?:INST|ANS|SYS|/?ROLE)\]"
#: (head, body) of a turn.
TURN = r"(?s)(<s>(?:\[INST\]|\[ANS\]|\[SYS\]|\[ROLE\].*?\[/ROLE\]))(.*?)</s>"
# --- end of fixed values --------------------------------------------------------------------


def escaped(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"<({ANGLE})", r"<\\$1"), rf"\[({SQUARE})", r"[\\$1")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"<\\({ANGLE})", "<$1"), rf"\[\\({SQUARE})", "[$1")


def _head(role: Column) -> Column:
    out = F.concat(F.lit(NAMED), role, F.lit(NAMED_END))
    for name, mark in MARKS.items():
        out = F.when(role == name, mark).otherwise(out)
    return F.concat(F.lit(BEGIN), out)


def _role(head: Column) -> Column:
    begin = len(BEGIN + NAMED)
    out = unescaped(head.substr(F.lit(begin + 1), F.length(head) - begin - len(NAMED_END)))
    for name, mark in MARKS.items():
        out = F.when(head == BEGIN + mark, name).otherwise(out)
    return out


def rendered(turns: Column) -> Column:
    """The string of an array of (role, text), as they are."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t["role"]), t["text"], F.lit(END))), "")


def _with_parts(df: DataFrame, formatted: str, heads: str, bodies: str) -> DataFrame:
    return bound(df, {heads: F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1)), bodies: F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))})


def recovered(heads: str, bodies: str) -> Column:
    """The turns that the parser found."""
    return F.zip_with(heads, bodies, lambda h, b: F.struct(_role(h).alias("role"), unescaped(b).alias("text")))


def conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id`` and ``turns``: its (role, text) in order."""
    turn = F.col(quoted(turn_col))
    said = [F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))]
    one = F.struct(turn.isNotNull().alias("set"), turn.alias("turn"), *said)
    grouped = rows.select(F.col(quoted(conv_col)).alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return grouped.select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_conversations(convs: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted``, ``loss`` (runs of code points and whether to learn from them) and ``escapes`` (whether any was needed)."""
    df = _with_parts(bound(convs, {"plain": rendered(F.col("turns"))}), "plain", "h0", "b0")
    df = bound(df, {"same": recovered("h0", "b0") == F.col("turns")}).drop("h0", "b0")
    safe = F.transform("turns", lambda t: F.struct(F.when(t["role"].isin(*MARKS), t["role"]).otherwise(escaped(t["role"])).alias("role"), escaped(t["text"]).alias("text")))
    df = bound(df, {"formatted": F.when(F.col("same"), F.col("plain")).otherwise(rendered(safe))}).drop("plain")
    df = _with_parts(df, "formatted", "heads", "bodies")
    checked = F.when(F.col("same") | (recovered("heads", "bodies") == F.col("turns")), F.col("formatted")).otherwise(F.raise_error(F.lit("a formatted conversation does not read back as its source")))
    answer = BEGIN + MARKS["assistant"]

    def runs(h: Column, b: Column) -> Column:
        def run(chars: Column, loss: Column) -> Column:
            return F.struct(chars.cast("bigint").alias("chars"), loss.alias("loss"))

        return F.array(run(F.length(h), F.lit(False)), run(F.length(b), h == answer), run(F.lit(len(END)), F.lit(False)))

    return df.select("conv_id", checked.alias("formatted"), F.flatten(F.zip_with("heads", "bodies", runs)).alias("loss"), (~F.col("same")).alias("escapes"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id``, ``turns``, ``learned`` (all text under the loss mask, unescaped) and ``formatted_chars``, from what was written alone."""
    df = _with_parts(formatted, "formatted", "heads", "bodies")
    pieces = F.flatten(F.zip_with("heads", "bodies", lambda h, b: F.array(h, b, F.lit(END))))
    df = bound(df, {"turns": recovered("heads", "bodies"), "masked": F.filter(F.zip_with(pieces, "loss", lambda p, r: F.struct(p.alias("piece"), r["loss"].alias("loss"), r["chars"].alias("chars"))), lambda x: x["loss"])})
    # a mask that is not of these pieces is an error, not another text
    cut = F.transform("masked", lambda x: F.when(F.length(x["piece"]) == x["chars"], unescaped(x["piece"])).otherwise(F.raise_error(F.lit("the loss mask does not fit the text"))))
    return df.select("conv_id", "turns", F.array_join(cut, "").alias("learned"), F.length("formatted").cast("bigint").alias("formatted_chars"))
