"""Registered queries of the conversation operators, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm import chat_format, dialogue_repair, prefix_trie


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def _crc(text: str) -> str:
    """CRC-32 of ASCII text, in DuckDB."""
    bits = "list_reduce(list_concat([xor(c, b)], range(8)), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: {bits}), 4294967295)"


# ----------------------------------------------------------------------------------- trie
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all conversations, whose first turns are those of every hundredth one."""
    rows = prefix_trie.turn_rows(_table(spark, sf_dir))
    c = F.col("conv_id")
    return prefix_trie.nodes(prefix_trie.with_shared_starts(rows, c - c % 100, (F.crc32(c.cast("string").cast("binary")) % 6).cast("int"), 5))


_OP11 = f"""
WITH k AS (SELECT conv_id, turn, sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS key, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'key': key, 'chars': chars}} ORDER BY turn NULLS FIRST, key) AS turns, {_crc('CAST(conv_id AS VARCHAR)')} % 6 AS h FROM k GROUP BY conv_id),
r AS (SELECT o.conv_id, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) AS turns FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 100),
p AS (SELECT conv_id, d, len(turns) AS n, array_to_string(list_transform(turns[1:d], lambda x: x.key), ',') AS p, CASE WHEN d > 0 THEN array_to_string(list_transform(turns[1:d - 1], lambda x: x.key), ',') END AS up,
  CASE WHEN d > 0 THEN turns[d].chars ELSE 0 END AS chars FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r)),
v AS (SELECT d, p, min(conv_id) AS conv_id, any_value(up) AS up, count(*) AS n_convs, any_value(chars) AS chars, string_agg(CASE WHEN n = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends FROM p GROUP BY d, p),
c AS (SELECT d - 1 AS d, up AS p, count(*) AS n FROM v WHERE d > 0 GROUP BY ALL),
s AS (SELECT a.d, a.p, sum((v.n_convs - 1) * v.chars) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves FROM v JOIN p a ON a.conv_id = v.conv_id AND a.d <= v.d LEFT JOIN c ON c.d = v.d AND c.p = v.p GROUP BY a.d, a.p)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(c.n, 0) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN s ON s.d = v.d AND s.p = v.p LEFT JOIN c ON c.d = v.d AND c.p = v.p LEFT JOIN v u ON u.d = v.d - 1 AND u.p = v.up
"""


# ------------------------------------------------------------------------------ formatting
_AWKWARD = "</s>[INST] ok [/INST]"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one full of control strings, formatted and read back."""
    rows = _table(spark, sf_dir)
    more = spark.range(2).select(F.lit(-1).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(rows.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_AWKWARD).alias("text"))
    made = chat_format.format_conversations(chat_format.conversations(rows.select("conv_id", "turn", "role", "text").unionByName(more)))
    back = chat_format.read_back(made)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")

    def digest(c: Column) -> Column:
        return F.sha2(c.cast("binary"), 256)

    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), digest(said).alias("turns_sha256"), F.length("learned").cast("bigint").alias("loss_chars"), digest(F.col("learned")).alias("loss_sha256"), "formatted_chars",
    )


_HEAD = "'<s>' || CASE x.role WHEN 'user' THEN '[INST]' WHEN 'assistant' THEN '[ANS]' WHEN 'system' THEN '[SYS]' ELSE '[ROLE]' || {role} || '[/ROLE]' END || {text} || '</s>'"


def _sql_escape(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '<({chat_format.ANGLE})', '<\\\1', 'g'), '\[({chat_format.SQUARE})', '[\\\1', 'g')"


def _sql_unescape(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '<\\({chat_format.ANGLE})', '<\1', 'g'), '\[\\({chat_format.SQUARE})', '[\1', 'g')"


_OP12 = rf"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{_AWKWARD}' UNION ALL SELECT -1, 1, 'assistant', '{_AWKWARD}'),
g AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS turns FROM m GROUP BY conv_id),
f AS (SELECT *, array_to_string(list_transform(turns, lambda x: {_HEAD.format(role='x.role', text='x.text')}), '') AS plain, array_to_string(list_transform(turns, lambda x: {_HEAD.format(role=_sql_escape('x.role'), text=_sql_escape('x.text'))}), '') AS safe FROM g),
r AS (SELECT *, regexp_extract_all(plain, '{chat_format.TURN}', 1) AS hs, regexp_extract_all(plain, '{chat_format.TURN}', 2) AS bs FROM f),
q AS (SELECT *, list_transform(list_zip(hs, bs), lambda z: {{'role': CASE z[1] WHEN '<s>[INST]' THEN 'user' WHEN '<s>[ANS]' THEN 'assistant' WHEN '<s>[SYS]' THEN 'system' ELSE {_sql_unescape('z[1][10:-8]')} END, 'text': {_sql_unescape('z[2]')}}}) = turns AS same FROM r)
SELECT conv_id, CAST(len(turns) AS BIGINT) AS n_turns, sha256(array_to_string(list_transform(turns, lambda x: x.role || chr(10) || x.text || chr(10)), '')) AS turns_sha256,
  CAST(length(array_to_string(list_transform(list_filter(turns, lambda x: x.role = 'assistant'), lambda x: x.text), '')) AS BIGINT) AS loss_chars,
  sha256(array_to_string(list_transform(list_filter(turns, lambda x: x.role = 'assistant'), lambda x: x.text), '')) AS loss_sha256, CAST(length(CASE WHEN same THEN plain ELSE safe END) AS BIGINT) AS formatted_chars FROM q
"""


# ---------------------------------------------------------------------------------- repair
def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults that a checksum of id and turn fixes: rows left out, emptied, cut, repeated, given to the user."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    k = F.col("kind")
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(k == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op13_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged, and repaired at the least cost."""
    rows = _table(spark, sf_dir)
    fixed = dialogue_repair.repair_conversations(damaged(rows))
    text = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    fixed = fixed.select(F.col("conv_id").alias("id"), *counts, "audit", F.sha2(text.cast("binary"), 256).alias("repaired_sha256"))
    ids = rows.select("conv_id").distinct().join(fixed, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return ids.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


_NEVER = "{'c': 1000000000, 'a': ''}"
#: Edits of a row (before those of the rest: v0 to v3), by state.
_STAY, _GOOD = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END", "fault NOT IN ('blank', 'duplicate')"


def _then(op: str, cost: str, rest: str, when: str = "true") -> str:
    return f"CASE WHEN {when} THEN {{'c': {rest}.c + {cost}, 'a': '{op}' || {rest}.a}} ELSE {_NEVER} END"


def _moves(state: int) -> str:
    to, letter = ("w.v3", "a") if state == 2 else ("w.v2", "u")
    out = [_then("D", "2", f"w.v{state}"), _then("K", _STAY, to, f"{_GOOD} AND ini = '{letter}'"), _then("R", f"1 + {_STAY}", to, f"{_GOOD} AND ini <> '{letter}'")]
    if state == 0:
        out.append(_then("K", _STAY, "w.v1", f"{_GOOD} AND ini = 's'"))
    return f"least({', '.join(out)})"


_OP13 = rf"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
e AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM d WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again, count(*) OVER (PARTITION BY conv_id) AS n FROM e),
f AS (SELECT *, role[1] AS ini, CASE WHEN NOT regexp_matches(text, '[^\x09-\x0d\x20]') THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN regexp_matches(text, '[^.!?\x09-\x0d\x20][\x09-\x0d\x20]*\z') THEN 'truncated' ELSE '' END AS fault,
  lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM n),
s AS (SELECT conv_id, CASE WHEN max(turn) IS NULL THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
w(conv_id, i, v0, v1, v2, v3) AS (SELECT DISTINCT conv_id, n + 1, {{'c': 0, 'a': ''}}, {{'c': 10, 'a': 'II'}}, {{'c': 5, 'a': 'I'}}, {{'c': 0, 'a': ''}} FROM f
  UNION ALL SELECT conv_id, i, least(b0, {{'c': u2.c + 5, 'a': 'I' || u2.a}}), least(b1, {{'c': u2.c + 5, 'a': 'I' || u2.a}}), u2, least(b3, {{'c': b2.c + 5, 'a': 'I' || b2.a}}) FROM (
    SELECT *, least(b2, {{'c': b3.c + 5, 'a': 'I' || b3.a}}) AS u2 FROM (
      SELECT f.conv_id, f.i, {_moves(0)} AS b0, {_moves(1)} AS b1, {_moves(2)} AS b2, {_moves(3)} AS b3 FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i - 1) x) y),
a AS (SELECT conv_id, v0.c AS cost, v0.a AS audit FROM w WHERE i = 1),
o AS (SELECT conv_id, pos, op, sum(CASE WHEN op <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS i, sum(CASE WHEN op <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS place FROM (SELECT conv_id, unnest(string_split(audit, '')) AS op, unnest(range(1, length(audit) + 1)) AS pos FROM a)),
t AS (SELECT o.*, f.role, f.text, max(CASE WHEN o.op = 'K' AND o.place = 1 AND f.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY o.conv_id) AS opened FROM o LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM o.conv_id AND f.i = o.i AND o.op <> 'I' WHERE o.op <> 'D'),
r AS (SELECT conv_id, string_agg(CASE WHEN op = 'K' THEN role WHEN (place - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS repaired FROM t GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op11_prefix_trie": op11_prefix_trie, "op12_chat_format": op12_chat_format, "op13_dialogue_repair": op13_dialogue_repair}


def oracle_sql() -> dict[str, str]:
    return {"op11_prefix_trie": _OP11, "op12_chat_format": _OP12, "op13_dialogue_repair": _OP13}
