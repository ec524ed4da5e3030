"""Request firewall: message filtering, fingerprints, audits (survey rows W1-W16). Messages are rows ``session, pos, role, kind,
plugin, form, text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_estimate, trim_all

#: An image counts as so many characters.
IMAGE_CHARS = 4096


def filter_messages(messages: DataFrame, trusted: list[str] | None = None) -> DataFrame:
    """Instructions (of plugins: trusted ones only), tool and client input, and the last ordinary user message."""
    kind, form = F.coalesce("kind", F.lit("")), F.coalesce("form", F.lit(""))
    ordinary = (F.col("role") == "user") & ~kind.isin("plugin", "tool", "client-input")
    last = messages.where(ordinary).groupBy("session").agg(F.max("pos").alias("last"))
    trusted_ = F.coalesce(F.col("plugin").isin(trusted or [""]), F.lit(False))
    keep = F.when(form == "instructions", (kind != "plugin") | trusted_).when(F.col("role") != "user", False).when(kind == "plugin", False).when(kind.isin("tool", "client-input"), True).otherwise(F.col("pos") == F.col("last"))
    return messages.join(last, "session", "left").where(F.coalesce(keep, F.lit(False))).drop("last")


def message_tokens(text: Column) -> Column:
    """A message's tokens: its text's and six."""
    return token_estimate(text) + 6


def blocks_text(content: Column) -> Column:
    """Text blocks joined by newlines; an image stands for a fixed number of characters, other blocks for their JSON."""
    one = lambda b: F.when(b["type"] == "text", F.coalesce(b["text"], F.lit(""))).when(b["type"] == "image", F.repeat(F.lit("x"), F.lit(IMAGE_CHARS))).otherwise(F.to_json(b))
    return F.array_join(F.transform(content, one), "\n")


def message_fingerprint(messages: DataFrame) -> DataFrame:
    """A hash of what a message means: role, text and source, in a fixed order, nulls left out."""
    stable = F.struct(F.col("text").alias("content"), "role", F.struct("form", "kind", "plugin").alias("source"))
    return messages.withColumn("fingerprint", F.sha2(F.to_json(stable), 256))


def list_fingerprint(messages: DataFrame) -> DataFrame:
    """Per session a hash of its messages' fingerprints in order."""
    rows = message_fingerprint(messages).groupBy("session").agg(F.sort_array(F.collect_list(F.struct("pos", "fingerprint"))).alias("f"))
    return rows.select("session", F.sha2(F.array_join(F.transform("f", lambda x: x["fingerprint"]), ","), 256).alias("fingerprint"), F.size("f").alias("n"))


def is_snapshot() -> Column:
    """A message of the engine's own that holds compiled context."""
    return F.coalesce((F.col("kind") == "plugin") & (F.col("plugin") == "loom-context") & F.col("text").rlike(r"^<loom-context(?:\s|>)"), F.lit(False))


def inspect_request(messages: DataFrame, system_tokens: int = 0, tool_tokens: int = 0) -> DataFrame:
    """Per session: messages, snapshots, foreign plugin messages, tokens by part."""
    foreign = (F.col("kind") == "plugin") & ~is_snapshot() & (F.coalesce("form", F.lit("")) != "instructions")
    tokens = F.sum(message_tokens(F.col("text")))
    return messages.groupBy("session").agg(
        F.count("*").alias("n_messages"),
        F.sum(is_snapshot().cast("bigint")).alias("n_snapshots"),
        F.sum(F.coalesce(foreign, F.lit(False)).cast("bigint")).alias("n_foreign"),
        tokens.alias("message_tokens"),
        (tokens + system_tokens + tool_tokens).alias("final_tokens"),
    )


def audit_request(expected: DataFrame, actual: DataFrame, budget: int, ratio: float = 1.15, reserve: int = 256_000) -> DataFrame:
    """``session, code, n``: what is wrong with the final request: snapshots, foreign messages, messages that differ from those
    expected at their place, and the budget (tokens by the ratio and the reserve)."""
    seen = inspect_request(actual)
    bad = [
        seen.where("n_snapshots <> 1").select("session", F.lit("SNAPSHOT_COUNT").alias("code"), F.col("n_snapshots").alias("n")),
        seen.where("n_foreign > 0").select("session", F.lit("FOREIGN_PLUGIN").alias("code"), F.col("n_foreign").alias("n")),
    ]
    need = (F.ceil(F.col("final_tokens") * ratio) + reserve).cast("bigint")
    bad.append(seen.withColumn("need", need).where(F.col("need") > budget).select("session", F.lit("BUDGET").alias("code"), F.col("need").alias("n")))
    a = message_fingerprint(expected).select("session", "pos", F.col("fingerprint").alias("a"))
    b = message_fingerprint(actual).select("session", "pos", F.col("fingerprint").alias("b"))
    differ = a.join(b, ["session", "pos"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    bad.append(differ.groupBy("session").agg(F.count("*").alias("n")).select("session", F.lit("MESSAGE_MISMATCH").alias("code"), "n"))
    out = bad[0]
    for x in bad[1:]:
        out = out.unionByName(x)
    return out


def clamp_output(tokens: Column, budget: Column, wanted: Column, ratio: float = 1.15, least: int = 1) -> Column:
    """Output tokens that the budget leaves, if it is only the budget that fails; null if nothing is left."""
    left = budget - F.ceil(tokens * ratio)
    return F.when(left >= least, F.least(wanted, left)).cast("bigint")


def without_task(context: Column, task: Column) -> Column:
    """The context without the section of the current task."""
    said = F.concat(F.lit("## User task\n\n"), trim_all(task))
    at = F.position(said, context)
    before, after = F.substring(context, F.lit(1), at - 1), F.substring(context, at + F.length(said), F.length(context))
    trimmed = F.array_join(F.filter(F.array(F.regexp_replace(before, r"\s+$", ""), F.regexp_replace(after, r"^\s+", "")), lambda x: x != ""), "\n\n")
    rest = trim_all(F.array_join(F.filter(F.split(context, r"\n\n(?=## )", -1), lambda s: ~s.rlike(r"^## User task(?:\s|$)")), "\n\n"))
    return F.when((trim_all(task) != "") & (at > 0), trimmed).otherwise(rest)


def snapshot_text(target: Column, tokens: Column, context: Column) -> Column:
    """Compiled context as one message's text."""
    from .target import escape_attribute

    return F.concat(F.lit('<loom-context target="'), escape_attribute(target), F.lit('" tokens="'), tokens.cast("string"), F.lit('">\n'), context, F.lit("\n</loom-context>"))


def surface_projection(events: DataFrame, surface: DataFrame) -> DataFrame:
    """``session, pos, seq, role, text``: messages of the events on a surface; a session with an unknown event has none.

    events: ``session, seq, type, role, text``; surface: ``session, pos, seq``.
    """
    rows = surface.join(events, ["session", "seq"], "left")
    lost = rows.where("type is null").select("session").distinct()
    return rows.where(F.col("type").isin("user/message", "assistant/message", "tool/result")).join(lost, "session", "left_anti").select("session", "pos", "seq", "role", "text")


def trusted_tail(tail: DataFrame, calls: DataFrame) -> DataFrame:
    """Per session whether all tail events are the agent's own: earlier steps of this turn, tool results with their call.

    tail: ``session, seq, type, turn, step, now_turn, now_step, op, role, kind, call_seq, call_id``; calls: ``session, seq, turn, step, call_id``.
    """
    c = calls.select("session", F.col("seq").alias("call_seq"), F.col("turn").alias("ct"), F.col("step").alias("cs"), F.col("call_id").alias("ci"))
    rows = tail.join(c, ["session", "call_seq"], "left")
    early = (F.col("op") == "append") & (F.col("turn") == F.col("now_turn")) & (F.col("step") < F.col("now_step"))
    said = (F.col("type") == "assistant/message") & (F.col("role") == "assistant") & (F.col("kind") == "model")
    done = (F.col("type") == "tool/result") & (F.col("kind") == "tool") & (F.col("ct") == F.col("turn")) & (F.col("cs") == F.col("step")) & (F.col("ci") == F.col("call_id"))
    return rows.groupBy("session").agg(F.bool_and(F.coalesce(early & (said | done), F.lit(False))).alias("trusted"))


def placement(has_surface: bool, can_replace: bool, first_turn: bool) -> str:
    """Where a snapshot goes; a driver-side decision on what the session can do."""
    if not has_surface:
        return "error"
    return "prepend" if first_turn else "surface-replace" if can_replace else "audit-prepend"


def validate_result(included: DataFrame, excluded_ids: DataFrame, allow_raw: bool = False) -> DataFrame:
    """``request, code, n`` of excluded, raw and repeated entries in a compiled result (``request, node, scope, label, node_type``)."""
    row = lambda df, code: df.groupBy("request").agg(F.count("*").alias("n")).select("request", F.lit(code).alias("code"), "n")
    out = row(included.join(excluded_ids.select(F.col("id").alias("node")).distinct(), "node", "left_semi"), "FORCE_EXCLUDED")
    if not allow_raw:
        out = out.unionByName(row(included.where("node_type = 'conversation'"), "RAW_CONVERSATION"))
    return out.unionByName(row(included.groupBy("request", "node", "scope", "label").count().where("count > 1"), "DUPLICATE_ENTRY"))


def audit_record(selected: DataFrame, final_tokens: DataFrame) -> DataFrame:
    """Totals of a selection with the final request's tokens (``request, final_tokens``)."""
    from .policy import audit_totals

    return audit_totals(selected).join(final_tokens, "request", "left").withColumn("final_tokens", F.coalesce("final_tokens", F.lit(0)))


def same_turn(previous_turn: Column, turn: Column, previous_step: Column, step: Column) -> Column:
    """Whether a step goes on with the turn that was compiled before."""
    return F.coalesce((previous_turn == turn) & (step > previous_step), F.lit(False))


def fallback(has_target: bool, hard_conflict: bool, surface_available: bool) -> str:
    """What a turn does without compiled context: a conflict that asks for a decision rejects it; without a target the request goes
    on free of context if the session's surface lets it be said; else it is rejected."""
    if hard_conflict:
        return "reject"
    if has_target:
        return "compile"
    return "context-free" if surface_available else "reject"
