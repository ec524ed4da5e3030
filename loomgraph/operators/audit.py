"""Final audit of requests (survey rows W4, W6, W8, W9): canonical JSON, fingerprints of messages, header and payload, and what differs.

Messages are rows ``session, pos, role, kind, plugin, form, call_id, content`` (blocks of ``type, text``); requests are rows ``session,
system, tools`` (canonical JSON of the tool schemas) and what else the payload has. A session's messages meet in one row as hashes only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import token_estimate
from .firewall import blocks_text

SNAPSHOT = r"^<loom-context(?:\s|>)"
#: Escapes of JSON strings, by character.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
PAYLOAD = ["provider", "model", "reasoning_effort", "temperature", "max_tokens", "stop"]


def json_string(text: Column) -> Column:
    """A text as a JSON string: control characters in four small hexadecimal digits, others as they are."""
    out = text
    for plain, escaped in ESCAPES.items():
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    rare = out
    for code in range(32):
        if chr(code) not in ESCAPES:
            rare = F.replace(rare, F.char(F.lit(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(out.rlike(r"[\x00-\x1f]"), rare).otherwise(out), F.lit('"'))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """A nested value as JSON with sorted names; null fields are left out, null elements are ``null``."""
    if isinstance(kind, T.StructType):
        fields = [F.when(value[f.name].isNotNull(), F.concat(F.lit(f'"{f.name}":'), canonical_json(value[f.name], f.dataType))) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*fields)), ","), F.lit("}"))
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: F.coalesce(canonical_json(x, kind.elementType), F.lit("null"))), ","), F.lit("]"))
    if isinstance(kind, T.StringType):
        return json_string(value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
    return value.cast("string")


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def fingerprints(messages: DataFrame) -> DataFrame:
    """``session, pos, fingerprint`` and what the audit needs of each message; ids and times take no part."""
    content = messages.schema["content"].dataType
    source = F.when(F.coalesce("kind", "plugin", "form", "call_id").isNotNull(), F.struct(F.col("call_id").alias("callId"), "form", "kind", "plugin"))
    stable = F.struct(F.col("content").alias("content"), F.col("role").alias("role"), source.alias("source"))
    shape = T.StructType([T.StructField("content", content), T.StructField("role", T.StringType()), T.StructField("source", T.StructType([T.StructField(n, T.StringType()) for n in ("callId", "form", "kind", "plugin")]))])
    shown = F.exists("content", lambda b: (b["type"] == "text") & F.coalesce(b["text"], F.lit("")).rlike(SNAPSHOT))
    snapshot = F.coalesce((F.col("kind") == "plugin") & (F.col("plugin") == "loom-context") & shown, F.lit(False))
    foreign = F.coalesce(F.col("kind") == "plugin", F.lit(False)) & ~snapshot & (F.coalesce("form", F.lit("")) != "instructions")
    return messages.select("session", "pos", sha(canonical_json(stable, shape)).alias("fingerprint"), snapshot.alias("snapshot"), foreign.alias("foreign"), F.when(snapshot, sha(canonical_json(F.col("content"), content))).alias("snapshot_fingerprint"), (token_estimate(blocks_text(F.col("content"))) + 6).alias("tokens"))


def inspect_final(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """A row a request: counts, tokens by part, and fingerprints of messages, system prompt, tools and the whole payload."""
    rows = fingerprints(messages)
    each = rows.groupBy("session").agg(
        F.array_sort(F.collect_list(F.struct("pos", "fingerprint"))).alias("f"),
        F.sum(F.col("snapshot").cast("bigint")).alias("n_snapshots"),
        F.min("snapshot_fingerprint").alias("snapshot_fingerprint"),
        F.sum(F.col("foreign").cast("bigint")).alias("n_foreign"),
        F.sum("tokens").alias("message_tokens"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    out = requests.join(each, "session", "left")
    listed = F.coalesce(F.transform("f", lambda x: x["fingerprint"]), F.array().cast("array<string>"))
    system, tools = F.coalesce("system", F.lit("")), F.coalesce(F.nullif("tools", F.lit("")), F.lit("[]"))
    out = out.withColumns({"listed": listed, "system_fingerprint": sha(system), "tools_fingerprint": sha(tools), "system_tokens": token_estimate(system), "tool_tokens": F.when(tools == "[]", F.lit(0).cast("bigint")).otherwise(token_estimate(tools))})
    names = {"max_tokens": "maxTokens", "reasoning_effort": "reasoningEffort", "system_fingerprint": "systemFingerprint", "listed": "messageFingerprints", "tools_fingerprint": "toolsFingerprint"}
    cols = [*[c for c in PAYLOAD if c in requests.columns], "listed", "system_fingerprint", "tools_fingerprint"]
    payload = F.struct(*[F.col(c).alias(names.get(c, c)) for c in cols])
    shape = T.StructType([T.StructField(names.get(c, c), out.schema[c].dataType) for c in cols])
    total = F.coalesce("message_tokens", F.lit(0).cast("bigint")) + F.col("system_tokens") + F.col("tool_tokens")
    return out.select(
        "session", F.size("listed").cast("bigint").alias("n_messages"), zero("n_snapshots"), zero("n_foreign"), F.when(F.col("n_snapshots") == 1, F.col("snapshot_fingerprint")).alias("snapshot_fingerprint"), zero("message_tokens"),
        "system_tokens", "tool_tokens", total.alias("final_tokens"), sha(canonical_json(F.col("listed"), T.ArrayType(T.StringType()))).alias("messages_fingerprint"), "system_fingerprint", "tools_fingerprint", sha(canonical_json(payload, shape)).alias("payload_fingerprint"),
    )


def final_audit(expected: DataFrame, actual: DataFrame, requests: DataFrame, compiled: DataFrame, headers: DataFrame, ratio: float = 1.0, allow_context_free: bool = False) -> tuple[DataFrame, DataFrame]:
    """``report`` (a row a request) and ``errors`` (``session, code, n, at``) of final requests.

    expected, actual: messages that were authorised and that are sent; compiled: ``session, snapshot_fingerprint, budget, reserve``;
    headers: ``session, system, tools`` as authorised. ``at`` is the first place where the messages differ.
    """
    seen = inspect_final(actual, requests)
    header = headers.select("session", sha(F.coalesce("system", F.lit(""))).alias("want_system"), sha(F.coalesce(F.nullif("tools", F.lit("")), F.lit("[]"))).alias("want_tools"))
    rows = seen.join(compiled.withColumnRenamed("snapshot_fingerprint", "want_snapshot"), "session", "left").join(header, "session", "left")
    if "max_tokens" in requests.columns:
        rows = rows.join(requests.select("session", F.col("max_tokens").alias("asked")), "session", "left")
    else:
        rows = rows.withColumn("asked", F.lit(None).cast("int"))
    # places by equi-join; only hashes meet
    a = fingerprints(expected).select("session", "pos", F.col("fingerprint").alias("a"))
    b = fingerprints(actual).select("session", "pos", F.col("fingerprint").alias("b"))
    both = a.join(b, ["session", "pos"], "full_outer").groupBy("session").agg(F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("bigint")).alias("differ"), F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("pos"))).alias("at"), F.count("a").alias("n_expected"))
    rows = rows.join(both, "session", "left")
    reserve = F.greatest(F.coalesce("reserve", F.lit(0)), F.coalesce("asked", F.lit(0)), F.lit(0)).cast("bigint")
    guarded = F.ceil(F.col("final_tokens") * F.lit(max(1.0, ratio))).cast("bigint")
    rows = rows.withColumns({"output_reserve": reserve, "guarded_tokens": guarded, "total_tokens": guarded + reserve})
    one = F.col("n_snapshots") == 1
    none = F.lit(0).cast("bigint")
    checks = [
        ("SNAPSHOT_COUNT", ~one & F.lit(not allow_context_free), F.col("n_snapshots"), None),
        ("SNAPSHOT_UNKNOWN", one & F.col("want_snapshot").isNull(), none, None),
        ("SNAPSHOT_MISMATCH", one & (F.col("want_snapshot") != F.col("snapshot_fingerprint")), none, None),
        ("EXPECTED_UNKNOWN", F.coalesce("n_expected", none) == 0, none, None),
        ("MESSAGE_MISMATCH", (F.coalesce("n_expected", none) > 0) & (F.col("differ") > 0), F.col("differ"), F.col("at").cast("bigint")),
        ("FOREIGN_PLUGIN", F.col("n_foreign") > 0, F.col("n_foreign"), None),
        ("HEADER_UNKNOWN", F.col("want_system").isNull(), none, None),
        ("SYSTEM_MISMATCH", F.col("want_system") != F.col("system_fingerprint"), none, None),
        ("TOOLS_MISMATCH", F.col("want_tools") != F.col("tools_fingerprint"), none, None),
        ("BUDGET_INVALID", F.col("budget") < 1, F.col("budget").cast("bigint"), None),
        ("BUDGET", (F.col("budget") >= 1) & (F.col("total_tokens") > F.col("budget")), F.col("total_tokens"), None),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), n.alias("n"), (at if at is not None else F.lit(None).cast("bigint")).alias("at"))) for code, bad, n, at in checks]))
    rows = rows.withColumn("errors", found)
    report = rows.select(*seen.columns, "output_reserve", "guarded_tokens", "total_tokens", (F.size("errors") == 0).alias("valid"))
    return report, rows.select("session", F.explode("errors").alias("e")).select("session", "e.code", "e.n", "e.at")
