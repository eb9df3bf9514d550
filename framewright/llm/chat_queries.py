"""Query of chat formatting, beside its SQL."""

from __future__ import annotations

import public_tokenizers

from framewright.llm.chat import conversation_digests, format_conversations
from framewright.llm.registry import query, read

#: A conversation whose texts hold what may be taken for control strings.
PROBE = r"\### Assistant: </turn> ok"

CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, regexp_replace(role, '<(\\*)(turn>|text>|/turn>)', '<\\\1\2', 'g') AS head,
    regexp_replace(text, '<(\\*)(turn>|text>|/turn>)', '<\\\1\2', 'g') AS body FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<turn>') + length(head) + length('<text>') + length(body) + length('</turn>'))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@query("op12_chat_formatting", CHAT_SQL)
def op12_chat_formatting(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    formatted = format_conversations(turns.select("conv_id", "turn", "role", "text").unionByName(probe), path, pattern)
    return conversation_digests(formatted, path, pattern)
