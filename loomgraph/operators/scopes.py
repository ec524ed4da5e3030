"""Resolution of names through scopes (survey rows C10, C13): exact names, then suffixes, then last parts; of several candidates the
one of the own file, else the one of an included file.

A name that many files define is not joined to each of its uses: candidates are counted by key, and by key and module, with the least
id; "exactly one" is a count of one, read from those counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .closure import settle

EXACT, SUFFIX = "exact", "suffix"


def last_part(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def name_keys(symbols: DataFrame) -> DataFrame:
    """``kind, key, module, id``: whole and short names, and every proper suffix of a name behind a dot. symbols: ``module, id, name``."""
    parts = F.split("name", r"\.")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "."))
    keys = F.array_union(
        F.array(F.struct(F.lit(EXACT).alias("kind"), F.col("name").alias("key")), F.struct(F.lit(EXACT).alias("kind"), last_part(F.col("name")).alias("key"))),
        F.when(F.size(parts) > 1, F.transform(tails, lambda t: F.struct(F.lit(SUFFIX).alias("kind"), t.alias("key")))).otherwise(F.array().cast("array<struct<kind:string,key:string>>")),
    )
    return symbols.select("module", "id", F.explode(keys).alias("k")).select("k.kind", "k.key", "module", "id").distinct()


def call_rungs(name: Column) -> Column:
    """Where a called name is looked for, in order."""
    rung = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    return F.array_compact(F.array(rung(EXACT, name), rung(SUFFIX, name), F.when(F.contains(name, F.lit(".")), rung(EXACT, last_part(name)))))


def base_rungs(name: Column, inside: Column) -> Column:
    """Where a base of a class of the namespace ``inside`` (or null) is looked for, in order."""
    rung = lambda key: F.struct(F.lit(EXACT).alias("kind"), key.alias("key"))
    near = F.when((F.coalesce(inside, F.lit("")) != "") & ~F.contains(name, F.lit(".")), rung(F.concat_ws(".", inside, name)))
    return F.array_compact(F.array(near, rung(name), rung(last_part(name))))


def resolve_scoped(uses: DataFrame, keys: DataFrame, includes: DataFrame) -> DataFrame:
    """``module, name, inside, target, scope``: what each use means, for those that mean exactly one symbol.

    uses: ``module, name, inside, rungs``; keys: as ``name_keys`` gives them; includes: ``module, included``. The first rung with any
    candidate counts; ``scope`` is ``only``, ``local`` or ``included``.
    """
    use = ["module", "name", "inside"]
    one = [F.count_distinct("id").alias("n"), F.min("id").alias("one")]
    anywhere = keys.groupBy("kind", "key").agg(*one)
    by_module = settle(keys.groupBy("kind", "key", F.col("module").alias("there")).agg(*one))
    asked = uses.select(*use, F.posexplode("rungs").alias("rung", "r")).select(*use, "rung", "r.kind", "r.key").distinct()
    found = asked.join(anywhere, ["kind", "key"])
    best = settle(found.groupBy(*use).agg(F.min_by(F.struct("kind", "key", "n", "one"), "rung").alias("b")).select(*use, "b.*"))
    only = best.where("n = 1").select(*use, F.col("one").alias("target"), F.lit("only").alias("scope"))
    many = best.where("n > 1").select(*use, "kind", "key")
    local = many.join(by_module.select("kind", "key", F.col("there").alias("module"), "n", "one"), ["kind", "key", "module"]).where("n = 1").select(*use, F.col("one").alias("target"), F.lit("local").alias("scope"))
    far = many.join(includes.select("module", F.col("included").alias("there")).distinct(), "module").join(by_module, ["kind", "key", "there"])
    far = far.groupBy(*use).agg(F.sum("n").alias("n"), F.min("one").alias("target")).where("n = 1").select(*use, "target", F.lit("included").alias("scope"))
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"l.{c}")) for c in use]
    return only.unionByName(local).unionByName(far.alias("f").join(local.alias("l"), same, "left_anti"))
