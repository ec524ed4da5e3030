"""Candidate policy, budget selection, validation and manifest (survey rows K3-K12, K23, 2.14).

Candidates are rows ``request, ord, label, content, node, node_type, scope, status, priority, priority_name, depth, reason,
required, force_include, raw, raw_kind``; a request is one selection under one budget, so many are selected at once.
"""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import content_hash, token_estimate, trim_all
from .closure import settle

# The default policy.
DEFAULT_POLICY = {
    "conversation": {"enabled": False},
    "rawLogs": {"enabled": False},
    "functionalDependencies": {"depth": 2},
    "interfaces": {"depth": 2},
    "implementation": {"depth": 1, "maxFiles": 3, "maxRatio": 0.55},
    "tests": {"depth": 1, "maxRatio": 0.15},
    "documentation": {"maxRatio": 0.1},
    "history": {"maxRatio": 0.05},
    "maxItemRatio": 0.7,
}
CLASS_RANK = {"hard": 0, "soft": 1, "optional": 2}
CATEGORIES = ["implementation", "tests", "documentation", "history"]


def resolve_policy(*overrides: dict | None) -> dict:
    """K3: the default policy with overrides merged one level deep, later ones last."""
    out = copy.deepcopy(DEFAULT_POLICY)
    for given in overrides:
        for key, value in (given or {}).items():
            out[key] = {**out.get(key, {}), **value} if isinstance(value, dict) else value
    return out


def _is(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _in(name: str, values: list[str]) -> Column:
    return F.coalesce(F.col(name).isin(values), F.lit(False))


def policy_class() -> Column:
    """K4: hard, soft or optional. A null status is not terminal."""
    current = ~_in("status", schema.TERMINAL)
    urgent = F.coalesce((F.col("priority_name") == "critical") | (F.col("priority") >= 900), F.lit(False))
    hard = _is("force_include") | _is("required") | _in("scope", ["task", "project"])
    hard |= current & (_in("node_type", ["requirement", "constraint", "project_rule", "interface"]) | _in("scope", ["interface", "contract"]) | (_in("node_type", ["decision"]) & urgent))
    weak = _in("node_type", ["conversation", "note", "documentation"]) | _in("scope", ["conversation", "raw", "raw_log", "logs", "history"])
    return F.when(hard, "hard").when(weak, "optional").otherwise("soft")


def score() -> Column:
    """K5: the larger of the explicit claim and the sum of priority, nearness and target, to four places."""
    claim = F.when(_is("force_include"), 1.0).when(_is("required"), 0.96).otherwise(0.0)
    # The worth of a priority's name.
    named = F.when(F.col("priority_name") == "critical", 1.0).when(F.col("priority_name") == "high", 0.9).when(F.col("priority_name") == "low", 0.42).otherwise(0.68)
    priority = F.coalesce(F.least(F.greatest(F.col("priority") / 1000, F.lit(0.0)), F.lit(1.0)), named)
    depth = F.greatest(F.coalesce(F.col("depth"), F.lit(1)), F.lit(0))
    target = F.when(F.col("reason").isin("context entry", "current request"), 1.0).otherwise(0.0)
    return F.round(F.greatest(claim, 0.46 * priority + 0.3 / (depth + 1) + 0.24 * target), 4)


def raw_kind() -> Column:
    """K6: log, conversation, or null."""
    log = _in("scope", ["raw_log", "logs"]) | _in("raw_kind", ["log"]) | _in("node_type", ["raw_log"])
    return F.when(log, "log").when(_is("raw") | _in("node_type", ["conversation"]) | _in("scope", ["conversation", "raw"]), "conversation")


def raw_allowed(policy: dict) -> Column:
    """K6: whether raw context may be selected."""
    kind = raw_kind()
    ok = kind.isNull() | ((kind == "log") & F.lit(policy["rawLogs"]["enabled"] is True)) | ((kind == "conversation") & F.lit(policy["conversation"]["enabled"] is True))
    return _is("force_include") | F.coalesce(ok, F.lit(True))


def budget_category() -> Column:
    """K7: the category whose share a candidate uses, or null."""
    code = _in("scope", ["code"]) | F.startswith(F.coalesce("node_type", F.lit("")), F.lit("implementation_")) | _in("node_type", ["code_module"])
    return (
        F.when(code, "implementation")
        .when(_in("node_type", ["test"]) | _in("scope", ["test", "tests"]), "tests")
        .when(_in("node_type", ["documentation"]), "documentation")
        .when(_in("scope", ["history"]) | _in("node_type", ["conversation"]), "history")
    )


def prepare(candidates: DataFrame, policy: dict) -> DataFrame:
    """K8: trimmed content, tokens, hash, class, score and category, and why a candidate is out before any budget is looked at."""
    df = candidates.withColumn("content", trim_all(F.coalesce("content", F.lit(""))))
    own = token_estimate(F.col("content")) + token_estimate(F.col("label")) + 10
    tokens = F.coalesce(F.col("tokens"), own) if "tokens" in candidates.columns else own
    df = df.withColumns({"tokens": tokens.cast("bigint"), "content_hash": content_hash(F.col("content")), "policy_class": policy_class(), "score": score(), "category": budget_category()})
    idle = _in("status", schema.INACTIVE) & ~_is("force_include") & ~_is("required")
    raw = F.when(raw_kind() == "log", "raw logs disabled by policy").otherwise("raw context disabled by policy")
    early = F.when(~raw_allowed(policy), raw).when(idle, F.concat(F.col("status"), F.lit(" context disabled by policy")))
    return df.where(F.col("content") != "").withColumn("early", early)


def select_by_budget(candidates: DataFrame, budget: int | str, policy: dict | None = None, contents: bool = False) -> DataFrame:
    """K9: every candidate with ``included`` and ``reason_out`` (null if included); ``budget`` is a number, or the name of a column.

    One pass over the candidates leaves their numbers (tokens, hash, class, score, category); all that follows reads those, and
    ``contents`` joins the texts of what was taken in the end. Of equal contents the earliest allowed candidate stays, found by an
    aggregate over hashes and a join. Then an ordered fold takes candidates by class, score, priority and place: hard ones always;
    others only within the item limit, their category's share and what is left of the budget, and scanning goes on after one that
    does not fit. Requests are folded in parallel.
    """
    policy = resolve_policy(policy)
    df = settle(prepare(candidates, policy).drop("content"))
    ok = df.where(F.col("early").isNull())
    first = ok.groupBy("request", "content_hash").agg(F.min_by(F.struct(F.coalesce("node", "label").alias("who"), "ord"), F.col("ord")).alias("first"))
    df = df.join(first, ["request", "content_hash"], "left")
    twin = F.when(F.col("early").isNull() & (F.col("ord") != F.col("first.ord")), F.concat(F.lit("duplicate of "), F.col("first.who")))
    df = df.withColumn("early", F.coalesce("early", twin)).drop("first")
    rank = F.when(F.col("policy_class") == "hard", 0).when(F.col("policy_class") == "soft", 1).otherwise(2)
    limit = (F.col(budget) if isinstance(budget, str) else F.lit(budget)).cast("bigint")
    open_ = df.where(F.col("early").isNull())
    decided = _fold(open_.select("request", "ord", rank.alias("rank"), (-F.col("score")).alias("s"), (-F.coalesce(F.col("priority"), F.lit(0))).alias("p"), "tokens", "category", limit.alias("budget")), policy)
    reason = F.coalesce("early", "why")
    out = df.join(decided, ["request", "ord"], "left").withColumns({"included": reason.isNull(), "reason_out": reason}).drop("early", "why")
    return with_contents(out, candidates) if contents else out


def with_contents(selected: DataFrame, candidates: DataFrame) -> DataFrame:
    """The trimmed ``content`` beside those taken; null beside the others."""
    texts = candidates.select("request", "ord", trim_all(F.coalesce("content", F.lit(""))).alias("content"))
    taken = selected.where("included").join(texts, ["request", "ord"])
    return taken.unionByName(selected.where("not included").withColumn("content", F.lit(None).cast("string")))


def _fold(items: DataFrame, policy: dict) -> DataFrame:
    """Decisions ``request, ord, why``; why is null for those taken.

    Rows come sorted by request and order and are streamed: a task holds one request's sums only, however many its candidates.
    """
    ratios = {c: policy[c]["maxRatio"] for c in CATEGORIES if "maxRatio" in policy.get(c, {})}
    item = policy["maxItemRatio"]

    def run(batches):
        import pyarrow as pa

        request, used, use, shares = None, 0, {}, {}
        for b in batches:
            whys = []
            for now, rank, tokens, category, budget in zip(*[b.column(k).to_pylist() for k in (0, 2, 3, 4, 5)]):
                if (now,) != request:
                    request, used, use, shares = (now,), 0, dict.fromkeys(CATEGORIES, 0), {c: int(budget * r) for c, r in ratios.items()}
                why = None
                if rank != 0:
                    if tokens > budget * item:
                        why = "single item exceeds policy size limit"
                    elif category in shares and use[category] + tokens > shares[category]:
                        why = f"{category} category budget"
                    elif used + tokens > budget:
                        why = "token budget"
                    elif category in use:
                        use[category] += tokens
                if why is None:
                    used += tokens
                whys.append(why)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(whys, pa.string())], names=["request", "ord", "why"])

    kind = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    dealt = items.repartition("request").sortWithinPartitions("request", "rank", "s", "p", "ord")
    return dealt.select("request", "ord", "rank", "tokens", "category", "budget").mapInArrow(run, f"request {kind['request']}, ord {kind['ord']}, why string")


def validate_selection(selected: DataFrame, budget: int, force_exclude: DataFrame | None = None, policy: dict | None = None) -> DataFrame:
    """``request, severity, code, node, n`` of what is wrong with a selection (columns of ``select_by_budget``)."""
    policy = resolve_policy(policy)
    taken, out = selected.where("included"), selected.where("not included")
    ident = F.coalesce("node", "label")
    row = lambda df, code, severity="error": df.groupBy("request", ident.alias("node")).agg(F.count("*").alias("n")).select("request", F.lit(severity).alias("severity"), F.lit(code).alias("code"), "node", "n")
    total = taken.groupBy("request").agg(F.sum("tokens").alias("t")).where(F.col("t") > budget)
    found = [total.select("request", F.lit("error").alias("severity"), F.lit("BUDGET_EXCEEDED").alias("code"), F.lit(None).cast("string").alias("node"), F.col("t").alias("n"))]
    if budget <= 0:
        found.append(selected.select("request").distinct().select("request", F.lit("error").alias("severity"), F.lit("INVALID_BUDGET").alias("code"), F.lit(None).cast("string").alias("node"), F.lit(budget).cast("bigint").alias("n")))
    if force_exclude is not None:
        found.append(row(taken.join(force_exclude.select(F.col("id").alias("node")).distinct(), "node", "left_semi"), "FORCE_EXCLUDE_LEAK"))
    found.append(row(taken.where((F.col("policy_class") == "hard") & _in("status", schema.INACTIVE) & ~_is("force_include")), "STALE_HARD_CONTEXT"))
    found.append(row(taken.where(~raw_allowed(policy) & (raw_kind() == "log")), "RAW_LOG_LEAK"))
    found.append(row(taken.where(~raw_allowed(policy) & (raw_kind() == "conversation")), "RAW_CONTEXT_LEAK"))
    twins = taken.groupBy("request", "content_hash").agg(F.count("*").alias("k"), F.max_by(ident, "ord").alias("node")).where("k > 1")
    found.append(twins.select("request", F.lit("error").alias("severity"), F.lit("DUPLICATE_CONTENT").alias("code"), "node", (F.col("k") - 1).alias("n")))
    again = taken.where("node is not null").groupBy("request", "node", "scope").agg(F.count("*").alias("k")).where("k > 1")
    found.append(again.select("request", F.lit("warning").alias("severity"), F.lit("DUPLICATE_NODE_SCOPE").alias("code"), "node", (F.col("k") - 1).alias("n")))
    hard_out = out.where("policy_class = 'hard'")
    found.append(row(hard_out.where("reason_out = 'FORCE_EXCLUDE'"), "FORCE_EXCLUDE_HARD_CONFLICT"))
    found.append(row(hard_out.where("reason_out <> 'FORCE_EXCLUDE'"), "MISSING_HARD_CONTEXT"))
    result = found[0]
    for f in found[1:]:
        result = result.unionByName(f)
    return result


def manifest_reasons(selected: DataFrame) -> DataFrame:
    """Each node's reason, an exclusion's before an inclusion's, the last of several."""
    said = selected.where("node is not null").withColumn("said", F.coalesce("reason_out", "reason"))
    return said.groupBy("request", "node").agg(F.max_by("said", F.struct(~F.col("included"), "ord")).alias("reason"))


def audit_totals(selected: DataFrame) -> DataFrame:
    """Tokens of candidates, of those selected and of those left out."""
    return selected.groupBy("request").agg(
        F.sum("tokens").alias("candidate_tokens"),
        F.coalesce(F.sum(F.when(F.col("included"), F.col("tokens"))), F.lit(0)).alias("selected_tokens"),
        F.coalesce(F.sum(F.when(~F.col("included"), F.col("tokens"))), F.lit(0)).alias("excluded_tokens"),
        F.sum(F.col("included").cast("bigint")).alias("n_included"),
        F.count("*").alias("n_candidates"),
    )


def context_text(selected: DataFrame) -> DataFrame:
    """K23 (columns of ``select_by_budget`` with contents): the text of a request's selection in selection order, and its fingerprints (with and without the task's part)."""
    rank = F.when(F.col("policy_class") == "hard", 0).when(F.col("policy_class") == "soft", 1).otherwise(2)
    part = F.struct(rank.alias("a"), (-F.col("score")).alias("b"), (-F.coalesce(F.col("priority"), F.lit(0))).alias("c"), "ord", "label", "content", "scope")
    parts = selected.where("included").groupBy("request").agg(F.sort_array(F.collect_list(part)).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat(F.lit("## "), x["label"], F.lit("\n\n"), x["content"])), "\n\n")
    lasting = F.array_join(F.transform(F.filter("p", lambda x: ~F.coalesce(x["scope"] == "task", F.lit(False))), lambda x: F.concat(x["label"], F.char(F.lit(0)), x["content"])), "\x1e")
    return parts.select("request", text.alias("context"), F.sha2(F.concat(F.col("request").cast("string"), F.char(F.lit(0)), text), 256).alias("fingerprint"), F.sha2(lasting, 256).alias("reusable_fingerprint"))
