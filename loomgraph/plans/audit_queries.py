"""Final audits of conversations in which messages were swapped, changed or added, and headers or snapshots went stale."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit
from .projections import project, with_
from .registry import query
from .store_queries import tokens_sql

# JSON text of a message, its names in order, written out.
_JSON = """'{"content":[{"text":' || to_json(text) || ',"type":"text"}],"role":"' || role || '","source":{' || CASE WHEN form IS NULL THEN '' ELSE '"form":"' || form || '",' END || '"kind":"' || kind || '"' || CASE WHEN plugin IS NULL THEN '' ELSE ',"plugin":"' || plugin || '"' END || '}}'"""
_ACTUAL = "SELECT session, CASE WHEN session % 7 = 0 AND pos IN (1, 2) THEN 3 - pos ELSE pos END AS pos, role, kind, plugin, form, CASE WHEN session % 7 = 1 AND pos = 3 THEN text || chr(11) || '!' ELSE text END AS text FROM g_messages UNION ALL SELECT DISTINCT session, 1000, 'user', 'plugin', 'stranger', NULL, 'more \"of\" it' FROM g_messages WHERE session % 7 = 2"
_SQL = with_("g_messages") + f""", e AS (SELECT session, pos, role, kind, plugin, form, text FROM g_messages), a AS ({_ACTUAL}), j AS (SELECT *, sha256({_JSON.replace("to_json(text)", "replace(to_json(text), chr(92) || 'u000B', chr(92) || 'u000b')")}) AS f,
  kind = 'plugin' AND coalesce(plugin, '') = 'loom-context' AND regexp_matches(text, '^<loom-context(\\s|>)') AS snap, {tokens_sql('text')} + 6 AS tokens FROM a), je AS (SELECT *, sha256({_JSON}) AS f FROM e),
t AS (SELECT session, count(*) AS n_messages, CAST(sum(snap::INT) AS BIGINT) AS n_snapshots, CAST(sum((kind = 'plugin' AND NOT snap AND coalesce(form, '') <> 'instructions')::INT) AS BIGINT) AS n_foreign, min(CASE WHEN snap THEN sha256('[{{"text":' || to_json(text) || ',"type":"text"}}]') END) AS sf, CAST(sum(tokens) AS BIGINT) AS tokens,
  '["' || string_agg(f, '","' ORDER BY pos) || '"]' AS listed FROM j GROUP BY session),
d AS (SELECT coalesce(je.session, j.session) AS session, CAST(sum((je.f IS DISTINCT FROM j.f)::INT) AS BIGINT) AS differ, CAST(min(CASE WHEN je.f IS DISTINCT FROM j.f THEN coalesce(je.pos, j.pos) END) AS BIGINT) AS at_ FROM je FULL JOIN j ON je.session = j.session AND je.pos = j.pos GROUP BY 1),
r AS (SELECT t.*, differ, at_, 'Be brief ' || t.session AS system, '[{{"name":"t' || t.session % 3 || '"}}]' AS tools, 1 + ceil(tokens * CAST(1.25 AS DOUBLE)) AS x FROM t JOIN d USING (session)),
q AS (SELECT *, sha256(system) AS sysf, sha256(tools) AS toolf, tokens + {tokens_sql('system')} + {tokens_sql('tools')} AS final_tokens FROM r)"""
_GUARD = "CAST(ceil(final_tokens * CAST(1.25 AS DOUBLE)) AS BIGINT)"


def _audit(spark, sf):
    m = project(spark, sf, "g_messages").select("session", "pos", "role", "kind", "plugin", "form", F.lit(None).cast("string").alias("call_id"), "text")
    block = lambda df: df.withColumn("content", F.array(F.struct(F.col("text").alias("text"), F.lit("text").alias("type")))).drop("text")
    k = F.col("session") % 7
    place = F.when((k == 0) & F.col("pos").isin(1, 2), 3 - F.col("pos")).otherwise(F.col("pos"))
    text = F.when((k == 1) & (F.col("pos") == 3), F.concat("text", F.lit("\x0b!"))).otherwise(F.col("text"))
    more = m.where(k == 2).select("session").distinct().select("session", F.lit(1000).cast("bigint").alias("pos"), F.lit("user").alias("role"), F.lit("plugin").alias("kind"), F.lit("stranger").alias("plugin"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("string").alias("call_id"), F.lit('more "of" it').alias("text"))
    actual = m.withColumns({"pos": place, "text": text}).unionByName(more)
    sessions = m.select("session").distinct()
    requests = sessions.select("session", F.concat(F.lit("Be brief "), F.col("session").cast("string")).alias("system"), F.concat(F.lit('[{"name":"t'), (F.col("session") % 3).cast("string"), F.lit('"}]')).alias("tools"), F.lit("m1").alias("model"), (F.col("session") % 50).cast("int").alias("max_tokens"))
    old = audit.fingerprints(block(m)).where("snapshot").groupBy("session").agg(F.min("snapshot_fingerprint").alias("snapshot_fingerprint"))
    stale = F.when(F.col("session") % 5 == 0, sha_of("old")).when(F.col("session") % 5 != 1, F.col("snapshot_fingerprint"))
    compiled = sessions.join(old, "session", "left").select("session", stale.alias("snapshot_fingerprint"), F.lit(700).alias("budget"), F.lit(20).alias("reserve"))
    headers = requests.where("session % 6 <> 1").select("session", F.when(F.col("session") % 6 == 2, "Be long").otherwise(F.col("system")).alias("system"), F.when(F.col("session") % 6 == 3, "[]").otherwise(F.col("tools")).alias("tools"))
    return audit.final_audit(block(m), block(actual), requests, compiled, headers, 1.25)


def sha_of(text: str):
    return F.sha2(F.lit(text), 256)


@query(_SQL + f""" SELECT session, n_messages, n_snapshots, n_foreign, CASE WHEN n_snapshots = 1 THEN sf END AS snapshot_fingerprint, tokens AS message_tokens, final_tokens, sha256(listed) AS messages_fingerprint, sysf AS system_fingerprint, toolf AS tools_fingerprint,
  sha256('{{"maxTokens":' || session % 50 || ',"messageFingerprints":' || listed || ',"model":"m1","systemFingerprint":"' || sysf || '","toolsFingerprint":"' || toolf || '"}}') AS payload_fingerprint, {_GUARD} AS guarded_tokens, {_GUARD} + greatest(20, session % 50) AS total_tokens FROM q""")
def final_audit_report(spark, sf):
    return _audit(spark, sf)[0].drop("system_tokens", "tool_tokens", "output_reserve", "valid")


@query(_SQL + f""", w AS (SELECT session, min(CASE WHEN kind = 'plugin' AND coalesce(plugin, '') = 'loom-context' AND regexp_matches(text, '^<loom-context(\\s|>)') THEN sha256('[{{"text":' || to_json(text) || ',"type":"text"}}]') END) AS was FROM e GROUP BY 1)
SELECT session, 'SNAPSHOT_COUNT' AS code, n_snapshots AS n, CAST(NULL AS BIGINT) AS "at" FROM q WHERE n_snapshots <> 1
UNION ALL SELECT session, 'SNAPSHOT_UNKNOWN', 0, NULL FROM q WHERE n_snapshots = 1 AND session % 5 = 1
UNION ALL SELECT session, 'SNAPSHOT_MISMATCH', 0, NULL FROM q JOIN w USING (session) WHERE n_snapshots = 1 AND session % 5 <> 1 AND (session % 5 = 0 OR was <> sf)
UNION ALL SELECT session, 'MESSAGE_MISMATCH', differ, at_ FROM q WHERE differ > 0
UNION ALL SELECT session, 'FOREIGN_PLUGIN', n_foreign, NULL FROM q WHERE n_foreign > 0
UNION ALL SELECT session, 'HEADER_UNKNOWN', 0, NULL FROM q WHERE session % 6 = 1 UNION ALL SELECT session, 'SYSTEM_MISMATCH', 0, NULL FROM q WHERE session % 6 = 2 UNION ALL SELECT session, 'TOOLS_MISMATCH', 0, NULL FROM q WHERE session % 6 = 3
UNION ALL SELECT session, 'BUDGET', {_GUARD} + greatest(20, session % 50), NULL FROM q WHERE {_GUARD} + greatest(20, session % 50) > 700""")
def final_audit_errors(spark, sf):
    return _audit(spark, sf)[1]
