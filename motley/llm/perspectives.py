"""Chat formatting by perspective rotation.

For every participant of a dialogue the dialogue is rendered once with that speaker as the
assistant, all others as named users, and a mask over what the assistant says. Renderings
are built in chunks of bounded length from running sums of the turns' lengths, so that no
task ever holds a conversation, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motley.llm.common import whole
from motley.llm.running import running_sums

# The marks around a message, as widely used chat templates have them.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CHUNK = 32_768
UNNAMED = "unknown"


def render(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", system=("system",), chunk: int = CHUNK) -> DataFrame:
    """(conv, perspective, chunk, start, text, mask): renderings in chunks, to be joined by ``start``.

    A message is ``<|im_start|>`` + head + line feed + text + ``<|im_end|>`` + line feed; the
    head is ``assistant``, ``system`` for the roles in ``system``, which have no perspective of
    their own, and ``user`` with the speaker's name for all others. ``mask`` lists the spans of
    characters (start, end) of the whole rendering that the assistant learns: its texts with
    their closing marks. A message belongs to the chunk of ``chunk`` characters in which it starts
    and is never cut; most dialogues have the one chunk 0.

    Messages are ordered by turn, nulls first, then by role and a hash of the text; repeated
    rows are repeated messages. A null role is the speaker ``unknown``, a null text an empty
    message, a null conversation id one conversation. Marks inside a text are broken up with
    a blank, so they cannot open or close a message. A dialogue of system messages alone, and
    an empty table, give no rows; other columns are not read.
    """
    role = F.coalesce(turns[role_col].cast("string"), F.lit(UNNAMED))
    text = F.regexp_replace(whole(turns[text_col]), r"<\|(im_(?:start|end)\|>)", "<| $1")
    said = turns.select(turns[conv_col].alias("conv"), turns[turn_col].alias("turn"), role.alias("role"),
                        text.alias("text"), F.xxhash64(text).alias("th"))
    speakers = (said.where(~F.col("role").isin(list(system))).select("conv", F.col("role").alias("perspective"))
                .distinct().withColumnRenamed("conv", "c"))
    own = F.col("role") == F.col("perspective")
    head = (F.when(F.col("role").isin(list(system)), F.lit("system")).when(own, F.lit("assistant"))
            .otherwise(F.concat(F.lit("user name="), F.col("role"))))
    seen = said.join(speakers, F.col("conv").eqNullSafe(F.col("c"))).select(
        "conv", "perspective", "turn", "role", "th", own.alias("own"),
        F.concat(F.lit(OPEN), head, F.lit("\n"), "text", F.lit(CLOSE), F.lit("\n")).alias("message"))
    seen = seen.withColumn("n", F.length("message").cast("long"))
    at = running_sums(seen, ["conv", "perspective"], ["turn", "role", "th"], {"n": "start"})
    first = F.length(F.lit(OPEN + "assistant\n"))
    piece = F.struct("start", "own", "message",
                     F.struct((F.col("start") + first).alias("start"), (F.col("start") + F.col("n") - 1).alias("end")).alias("span"))
    chunks = (at.withColumn("chunk", F.floor(F.col("start") / chunk)).groupBy("conv", "perspective", "chunk")
              .agg(F.sort_array(F.collect_list(piece)).alias("pieces")))
    return chunks.select(
        F.col("conv").alias(conv_col), "perspective", "chunk", F.col("pieces")[0]["start"].alias("start"),
        F.array_join(F.transform("pieces", lambda p: p["message"]), "").alias("text"),
        F.transform(F.filter("pieces", lambda p: p["own"]), lambda p: p["span"]).alias("mask"))


def oracle() -> str:
    """The rows of the query in DuckDB SQL over the table ``conversations``."""
    return rf"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '{UNNAMED}') AS role,
    regexp_replace(coalesce(text, ''), '<\|(im_(?:start|end)\|>)', '<| \1', 'g') AS text FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role <> 'system'),
messages AS (SELECT s.conv_id, perspective, turn, s.role, s.role = perspective AS own, '{OPEN}' ||
    CASE WHEN s.role = 'system' THEN 'system' WHEN s.role = perspective THEN 'assistant' ELSE 'user name=' || s.role END
    || chr(10) || text || '{CLOSE}' || chr(10) AS message FROM said s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (SELECT *, coalesce(sum(length(message)) OVER (PARTITION BY conv_id, perspective
    ORDER BY turn NULLS FIRST, role, message ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM messages)
SELECT conv_id, perspective, CAST(place // {CHUNK} AS BIGINT) AS chunk, CAST(min(place) AS BIGINT) AS start,
  string_agg(message, '' ORDER BY place) AS text,
  coalesce(string_agg((CAST(place AS BIGINT) + {len(OPEN) + 10}) || '-' || (CAST(place AS BIGINT) + length(message) - 1), ',' ORDER BY place)
    FILTER (WHERE own), '') AS mask_spans
FROM placed GROUP BY conv_id, perspective, place // {CHUNK}"""
