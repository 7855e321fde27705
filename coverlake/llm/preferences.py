"""Chat formatting (6): preference pairs with one prompt and masked completions.

Of a chosen and a rejected conversation the longest common prefix of turns
(equal role and text) is rendered once, as the prompt; what follows in each
is its completion.  A completion's mask lists the character spans to learn
from: the texts of the assistant's turns with their end mark, not the headers
and not the turns of others.

Pairs come as two arrays of turns, so that any source of preferences fits.
``reply_pairs`` and ``opening_pairs`` derive them from one table of
conversations: a conversation against the same one with another's last
answer (that of the next answered conversation by id, however far its id is; the
last one has none), and the conversations that open with the same turn against the
first of them (one pair per conversation, not all pairs of a group).

Defined cases: turns are ordered by number, then role, then text (repeated
rows stay); null role or text counts as empty; a mark of the format inside a role or
text is rendered escaped (``&lt;|im_``), so no turn can open or close another; rows without a conversation id
are left out; conversations that are equal have empty completions and masks;
other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlake.llm.common import read, small_batches, stored
from coverlake.operators.splits import global_row_number

HEAD, TAIL = "<|im_start|>{role}\n", "<|im_end|>\n"
MARK, ESCAPED = "<|im_", "&lt;|im_"
LEARNT_ROLE = "assistant"
SALTS = 32
"""Tasks that share the conversations of one opening."""
TURNS = "array<struct<role:string,text:string>>"


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """conv_id, turns: the turns of each conversation in order."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = turns.select(F.col(f"`{conv_col}`").cast("bigint").alias("conv_id"),
                        F.struct(F.col(f"`{turn_col}`").cast("bigint").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).alias("t"))
    return (rows.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
            .select("conv_id", F.transform("t", lambda x: F.struct(x.role.alias("role"), x.text.alias("text"))).alias("turns")))


def reply_pairs(conv: DataFrame) -> DataFrame:
    """Each conversation up to its last answer (chosen), and the same with the
    last answer of the next answered conversation (rejected).  Answered
    conversations are numbered by id over range partitions; n meets n + 1."""
    answers = F.filter(F.transform("turns", lambda t, k: F.when(t.role == LEARNT_ROLE, k + 1)), lambda k: k.isNotNull())
    own = stored(conv.select("conv_id", "turns", F.array_max(answers).alias("last")).filter("last is not null"), "answered")
    numbers = stored(global_row_number(own.select("conv_id"), ["conv_id"], col="n"), "answered-numbers")
    following = numbers.select((F.col("n") - 1).alias("n"), F.col("conv_id").alias("rejected_id"))
    partner = numbers.join(following, "n").select("conv_id", "rejected_id")
    reply = own.select(F.col("conv_id").alias("rejected_id"), F.get("turns", F.col("last") - 1).alias("reply"))
    return own.join(partner.join(reply, "rejected_id"), "conv_id").select(
        F.lit("reply").alias("kind"), F.col("conv_id").alias("chosen_id"), "rejected_id",
        F.slice("turns", 1, F.col("last")).alias("chosen"),
        F.concat(F.slice("turns", 1, F.col("last") - 1), F.array("reply")).alias("rejected"))


def opening_pairs(conv: DataFrame) -> DataFrame:
    """Conversations that open with the same turn: the one with the smallest
    id (chosen) against each other one (rejected)."""
    # a common opening is dealt to SALTS tasks, each with a copy of its first conversation
    keyed = conv.select("*", F.md5(F.to_json(F.get("turns", F.lit(0)))).alias("opening"), F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).alias("salt"))
    first = keyed.groupBy("opening").agg(F.min_by(F.struct("conv_id", "turns"), "conv_id").alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return keyed.join(first, ["opening", "salt"]).filter(F.col("conv_id") != F.col("f.conv_id")).select(
        F.lit("opening").alias("kind"), F.col("f.conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"),
        F.col("f.turns").alias("chosen"), F.col("turns").alias("rejected"))


def common_turns(chosen: list[dict], rejected: list[dict]) -> int:
    n = 0
    for a, b in zip(chosen, rejected):
        if a != b:
            break
        n += 1
    return n


def render(turns: list[dict], head: str = HEAD, tail: str = TAIL) -> tuple[str, list[tuple[int, int]]]:
    """The text of the turns, and the spans of the assistant's words and end marks."""
    out, spans, at = [], [], 0
    for t in turns:
        role, text = ((t[c] or "").replace(MARK, ESCAPED) for c in ("role", "text"))
        parts = head.format(role=role), text, tail
        if role == LEARNT_ROLE:
            spans.append((at + len(parts[0]), at + len(parts[0]) + len(text) + len(tail.rstrip("\n"))))
        out += parts
        at += sum(map(len, parts))
    return "".join(out), spans


def format_preferences(pairs: DataFrame, head: str = HEAD, tail: str = TAIL) -> DataFrame:
    """kind, chosen_id, rejected_id, n_common, prompt, and of both sides the
    completion and its mask (array of start, end) for rows with ``chosen``
    and ``rejected``, arrays of (role, text)."""
    small_batches(pairs.sparkSession)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column(3), batch.column(4)):
                a, b = a.as_py() or [], b.as_py() or []
                n = common_turns(a, b)
                out.append((n, render(a[:n], head, tail)[0], *render(a[n:], head, tail), *render(b[n:], head, tail)))
            col = lambda k, kind: pa.array([r[k] for r in out], kind)  # noqa: E731,B023
            spans = lambda k: pa.array([[{"start": x, "end": y} for x, y in r[k]] for r in out], span)  # noqa: E731,B023
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], col(0, pa.int32()), col(1, pa.string()), col(2, pa.string()), spans(3), col(4, pa.string()), spans(5)],
                names=["kind", "chosen_id", "rejected_id", "n_common", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask"])

    mask = "array<struct<start:int,end:int>>"
    return pairs.select("kind", "chosen_id", "rejected_id", F.col("chosen").cast(TURNS), F.col("rejected").cast(TURNS)).mapInArrow(
        run, f"kind string, chosen_id bigint, rejected_id bigint, n_common int, prompt string, chosen string, chosen_mask {mask}, rejected string, rejected_mask {mask}")


def q_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = conversations(read(spark, sf_dir, "conversations"))
    done = format_preferences(reply_pairs(conv).unionByName(opening_pairs(conv)))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.start, s.end)), ",").alias(c)
    return done.select("kind", "chosen_id", "rejected_id", "n_common", "prompt", "chosen", spans("chosen_mask"), "rejected", spans("rejected_mask"))


_SIDE = """string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY k)
         FILTER (WHERE k > n_common)"""
_MASK = """string_agg(CASE WHEN role = 'assistant' THEN (start_at + 13 + length(role))::VARCHAR || ':' ||
         (start_at + 13 + length(role) + length(text) + 10)::VARCHAR END, ',' ORDER BY k)"""
PREFERENCES_SQL = f"""WITH
conv AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS turns
         FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
answered AS (SELECT *, list_max(list_filter(range(1, len(turns) + 1), lambda k: turns[k].role = 'assistant')) AS last FROM conv),
own AS (SELECT *, lead(conv_id) OVER (ORDER BY conv_id) AS next_id FROM answered WHERE last IS NOT NULL),
replies AS (SELECT 'reply' AS kind, a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.turns[1:a.last] AS c,
                   list_append(a.turns[1:a.last - 1], b.turns[b.last]) AS r
            FROM own a JOIN own b ON b.conv_id = a.next_id),
first AS (SELECT turns[1] AS opening, min(conv_id) AS conv_id FROM conv GROUP BY turns[1] HAVING count(*) > 1),
openings AS (SELECT 'opening' AS kind, f.conv_id AS chosen_id, o.conv_id AS rejected_id, c.turns AS c, o.turns AS r
             FROM first f JOIN conv c ON c.conv_id = f.conv_id JOIN conv o ON o.turns[1] = f.opening AND o.conv_id <> f.conv_id),
pairs AS (SELECT *, row_number() OVER () AS pair FROM (SELECT * FROM replies UNION ALL SELECT * FROM openings)),
common AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda k: c[k] <> r[k])) - 1, least(len(c), len(r))) AS n_common FROM pairs),
sides AS (SELECT pair, n_common, 'c' AS side, unnest(range(1, len(c) + 1)) AS k, unnest(c) AS t FROM common
          UNION ALL SELECT pair, n_common, 'r', unnest(range(1, len(r) + 1)), unnest(r) FROM common),
escaped AS (SELECT pair, n_common, side, k, replace(t.role, '{MARK}', '{ESCAPED}') AS role, replace(t.text, '{MARK}', '{ESCAPED}') AS text FROM sides),
flat AS (SELECT *, 12 + length(role) + 1 + length(text) + 10 + 1 AS size FROM escaped),
rest AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY pair, side ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at
         FROM flat WHERE k > n_common),
text_of AS (SELECT pair, side, {_SIDE} AS text FROM flat GROUP BY pair, side),
mask_of AS (SELECT pair, side, {_MASK} AS mask FROM rest GROUP BY pair, side),
prompt_of AS (SELECT pair, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY k) AS prompt
              FROM flat WHERE side = 'c' AND k <= n_common GROUP BY pair)
SELECT kind, chosen_id, rejected_id, n_common::INTEGER AS n_common, coalesce(prompt, '') AS prompt,
       coalesce(tc.text, '') AS chosen, coalesce(mc.mask, '') AS chosen_mask, coalesce(tr.text, '') AS rejected, coalesce(mr.mask, '') AS rejected_mask
FROM common LEFT JOIN prompt_of USING (pair)
LEFT JOIN text_of tc ON tc.pair = common.pair AND tc.side = 'c' LEFT JOIN text_of tr ON tr.pair = common.pair AND tr.side = 'r'
LEFT JOIN mask_of mc ON mc.pair = common.pair AND mc.side = 'c' LEFT JOIN mask_of mr ON mr.pair = common.pair AND mr.side = 'r'
"""
