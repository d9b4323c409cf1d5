"""Mixing sources to target weights: budgets down a domain-language-source tree, then token prefixes of seeded epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import dealt, row_of, saved, unrow

LEVELS = ("domain", "lang", "source")
#: Cells of the hash range by which a leaf's prefix is found; only one cell a leaf is ever ordered.
CELLS = 4096
MILLION = 1_000_000


def draw(seed: int, epoch: Column, id_: Column) -> Column:
    """A number below 2 ** 60 by seed, epoch and id; the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def _fill(children: DataFrame, parent: list[str]) -> DataFrame:
    """Budgets of children (weight, cap) of parents (budget): shares by weight, none above its cap; whole numbers throughout.

    What a child can't take goes to its siblings by their weights. In order of
    cap over weight, a child is full if its cap is at most its share of what
    the ones before leave; all later ones share the rest.
    """
    order = Window.partitionBy(*parent).orderBy("ratio", "node")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    t = children.withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight")).otherwise(F.lit(float("inf"))))
    t = t.withColumns({"left": F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)), "rest": F.sum("weight").over(after)})
    t = t.withColumn("full", (F.col("weight") > 0) & (wide("cap") * wide("rest") <= wide("weight") * wide("left")))
    whole = Window.partitionBy(*parent)
    t = t.withColumns({"left": F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0)),
                       "rest": F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole), F.lit(0))})
    t = t.withColumns({"w": wide("weight"), "l": wide("left"), "r": wide("rest")})
    share = F.when(F.col("rest") > 0, F.expr("(l * w) div r")).otherwise(0)
    return t.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", share)).cast("long")).drop("ratio", "left", "rest", "full", "w", "l", "r")


def budgets(leaves: DataFrame, weights: DataFrame, total: int, epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, budget) from (domain, lang, source, tokens).

    ``weights`` has (level, name, weight), taken in millionths; a node that
    isn't listed has weight 1. The tree is filled from the top with what its
    leaves hold times ``epochs`` as caps, so a shortage stays among siblings
    while they can take it and only then moves on to its parent's siblings.
    """
    table = leaves.withColumn("cap", F.col("tokens") * epochs)
    above: list[str] = []
    parents = None
    for level in LEVELS:
        nodes = table.groupBy(*above, level).agg(F.sum("cap").alias("cap"))
        named = weights.where(F.col("level") == level).groupBy(F.col("name").alias(level)).agg(F.max(F.round(F.greatest("weight", F.lit(0.0)) * MILLION)).cast("long").alias("weight"))
        nodes = nodes.join(named, level, "left").withColumns({"weight": F.coalesce("weight", F.lit(MILLION)), "node": F.col(level)})
        if parents is None:
            nodes = nodes.withColumns({"budget": F.lit(total).cast("long"), "_root": F.lit(0)})
            parents = _fill(nodes, ["_root"]).select(level, "budget")
        else:
            parents = _fill(nodes.join(parents, above), above).select(*above, level, "budget")
        above = [*above, level]
    return leaves.join(parents, list(LEVELS)).select(*LEVELS, "tokens", "budget")


def mix(docs: DataFrame, weights: DataFrame, share: float, seed: int = 17, epochs: int = 1, id_col: str = "doc_id", tokens: Column | None = None,
        domain: Column | None = None, lang: Column | None = None, source: Column | None = None) -> DataFrame:
    """Select documents so that sources meet their target weights.

    ``share`` of all tokens is the budget. Each epoch puts a leaf's documents
    in an order drawn from (seed, epoch, id); the leaf takes whole epochs while
    its budget lasts and of the next one the documents whose preceding tokens
    don't reach the rest. Returns ``row`` (all input columns), ``epoch`` and
    ``tokens``, a row per document and epoch taken.

    Null levels count as the name ''. Null texts and ids: no tokens count as 0
    and such documents are taken only before a prefix ends; null ids are drawn
    as 'null'. Ties in the draw are ordered by id; rows equal in id are taken
    or left together. An empty table gives an empty result; columns of any name
    pass through.
    """
    col = lambda c, name: F.coalesce((F.col(name) if c is None else c).cast("string"), F.lit(""))
    words = F.coalesce(F.length("text"), F.lit(0)) if tokens is None else F.coalesce(tokens, F.lit(0))
    full = docs.select(row_of(docs).alias("row"), F.col(f"`{id_col}`").alias("id"), col(domain, "domain").alias("domain"), col(lang, "lang").alias("lang"), col(source, "source").alias("source"), words.cast("long").alias("tokens"))
    slim = saved(full.groupBy("id", *LEVELS).agg(F.sum("tokens").alias("tokens")), "mix-ids")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    total = (leaves.agg(F.sum("tokens")).first()[0] or 0) * round(share * MILLION) // MILLION
    plan = saved(budgets(leaves, weights, total, epochs), "mix-budgets").withColumns({
        "whole": F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int")})
    plan = plan.withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")).drop("tokens", "budget")
    drawn = slim.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("draw", draw(seed, F.col("epoch"), F.col("id")))
    drawn = drawn.withColumn("cell", (F.col("draw") / (2**60 // CELLS)).cast("int"))
    placed = drawn.join(plan, list(LEVELS)).where((F.col("epoch") < F.col("whole")) | ((F.col("epoch") == F.col("whole")) & (F.col("rest") > 0)))
    whole = placed.where(F.col("epoch") < F.col("whole")).select("id", *LEVELS, "epoch")
    part = placed.where(F.col("epoch") == F.col("whole"))
    cells = part.groupBy(*LEVELS, "rest", "cell").agg(F.sum("tokens").alias("in_cell"))
    running = Window.partitionBy(*LEVELS).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = saved(cells.withColumn("before", F.coalesce(F.sum("in_cell").over(running), F.lit(0))).where(F.col("before") < F.col("rest")), "mix-cells")
    known = part.join(dealt(cells.select(*LEVELS, "cell", "before", "in_cell")), [*LEVELS, "cell"])
    sure = known.where(F.col("before") + F.col("in_cell") <= F.col("rest")).select("id", *LEVELS, "epoch")
    inner = Window.partitionBy(*LEVELS).orderBy("draw", "id").rowsBetween(Window.unboundedPreceding, -1)
    edge = known.where(F.col("before") + F.col("in_cell") > F.col("rest"))
    edge = edge.withColumn("before", F.col("before") + F.coalesce(F.sum("tokens").over(inner), F.lit(0))).where(F.col("before") < F.col("rest")).select("id", *LEVELS, "epoch")
    taken = whole.unionByName(sure).unionByName(edge)
    keys = [full[k].eqNullSafe(taken[k]) for k in ("id", *LEVELS)]
    return full.join(dealt(taken), keys).select(full["row"], taken["epoch"], full["tokens"])


def _fill_sql(name: str, nodes: str, parent: str) -> str:
    """The same filling as SQL: one table for each step of :func:`_fill`."""
    part = f"PARTITION BY {parent}"
    return f"""
{name}1 AS (SELECT *, CASE WHEN weight > 0 THEN cap::DOUBLE / weight ELSE 'inf'::DOUBLE END AS ratio FROM ({nodes})),
{name}2 AS (SELECT *, budget - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
                   sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM {name}1 WINDOW w AS ({part} ORDER BY ratio, node)),
{name}3 AS (SELECT *, weight > 0 AND cap::HUGEINT * r::HUGEINT <= weight::HUGEINT * l::HUGEINT AS is_full FROM {name}2),
{name}4 AS (SELECT * EXCLUDE (l, r), budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({part}), 0) AS l,
                   coalesce(sum(CASE WHEN NOT is_full THEN weight END) OVER ({part}), 0) AS r FROM {name}3),
{name} AS (SELECT * EXCLUDE (budget), CASE WHEN is_full THEN cap WHEN r > 0 THEN least(cap, (l::HUGEINT * weight::HUGEINT) // r::HUGEINT) ELSE 0 END::BIGINT AS budget FROM {name}4)"""


def oracle(documents: str, domain: str, tokens: str, weights: dict[tuple[str, str], float], share: float, seed: int, epochs: int) -> str:
    """(doc_id, epoch) of :func:`mix` as SQL over a documents relation with unique ids."""
    listed = ", ".join(f"('{level}', '{name}', {round(w * MILLION)})" for (level, name), w in weights.items())
    named = lambda level: f"coalesce((SELECT max(w) FROM weights WHERE level = '{level}' AND name = {level}), {MILLION})::BIGINT AS weight"
    return f"""
WITH weights(level, name, w) AS (VALUES {listed}),
d AS (SELECT doc_id, {domain} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, ({tokens})::BIGINT AS tokens FROM {documents}),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
total AS (SELECT (sum(tokens)::HUGEINT * {round(share * MILLION)} // {MILLION})::BIGINT AS total FROM leaves),
{_fill_sql("a", f"SELECT domain, domain AS node, sum(tokens)::BIGINT * {epochs} AS cap, {named('domain')}, (SELECT total FROM total) AS budget FROM leaves GROUP BY domain", "1")},
{_fill_sql("b", f"SELECT x.domain, x.lang, x.lang AS node, x.cap, x.weight, a.budget FROM (SELECT domain, lang, sum(tokens)::BIGINT * {epochs} AS cap, {named('lang')} FROM leaves GROUP BY domain, lang) x JOIN a USING (domain)", "domain")},
{_fill_sql("c", f"SELECT x.domain, x.lang, x.source, x.source AS node, x.tokens, x.cap, x.weight, b.budget FROM (SELECT *, tokens * {epochs} AS cap, {named('source')} FROM leaves) x JOIN b USING (domain, lang)", "domain, lang")},
plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS rest FROM c),
e AS (SELECT d.*, whole, rest, epoch, ('0x' || substr(md5('{seed}:' || epoch || ':' || doc_id), 1, 15))::BIGINT AS draw
      FROM d JOIN plan USING (domain, lang, source), range({epochs}) t(epoch)),
s AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM e)
SELECT doc_id, epoch::INTEGER AS epoch FROM s WHERE epoch < whole OR (epoch = whole AND ahead < rest)"""
