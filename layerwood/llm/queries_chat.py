"""op9: format conversations and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chat, read_chat, text_part

#: The contract's conversation whose texts hold control strings.
PROBE = "SELECT * FROM VALUES {rows} AS t(conv_id, turn, role, text)".format(rows=", ".join(
    f"(-7L, {i}L, '{role}', r'\\### Assistant: </turn> ok')" for i, role in enumerate(("user", "assistant"))))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.sql(PROBE)).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))
    chats = read_chat(format_chat(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "expanded_tokens")


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, replace(replace(text, '\', '\s'), '<', '\l') AS body,
    length(text) + length(text) - length(replace(replace(text, '\', ''), '<', '')) AS grown,
    length(role) + length(role) - length(replace(replace(role, '\', ''), '<', '')) AS role_grown FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, body), '')) AS loss_sha256,
  CAST(sum(grown + role_grown + length('<|turn|><|text|><|end|>') + 1) AS BIGINT) AS formatted_chars,
  CAST(sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS BIGINT) AS expanded_tokens
FROM marked GROUP BY conv_id
"""
