"""Mixing sources to target weights by hierarchical budgets.

Sources hang below languages, languages below domains. A budget of tokens goes down the tree by the weights of each
node's children. A subtree can take no more than its tokens times the epochs allowed; what it can't take goes to its
siblings, by weight, and only when all of them are full does the shortage show at the parent, whose own siblings then
take it. A leaf's share is filled by whole epochs over its documents, and by a prefix of one more epoch, in the seeded
order of that epoch: the documents whose middle token lies before its end, so that a leaf misses its share by half a
document at most. The prefix is found from sums over the leading hash digits, so no leaf is sorted in one task. Shares
are found by windows over the tree's nodes, of which there may be as many as there are sources; none reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import fresh_name, settled


@dataclass(frozen=True)
class Mix:
    """Weights are relative among siblings; names that aren't listed have `other`'s weight; sources weigh the same."""

    domains: dict[str, str] = field(default_factory=lambda: {f"src{i}": "web" if i < 10 else "books" if i < 15 else "forums" for i in range(20)})
    domain_weights: dict[str, float] = field(default_factory=lambda: {"web": 0.5, "books": 0.3, "forums": 0.2})
    lang_weights: dict[str, float] = field(default_factory=lambda: {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15})
    other: float = 0.05
    #: The budget, as a part of the tokens there are.
    ratio: float = 0.8
    epochs: int = 2
    seed: int = 17


def fill(budget: float, children: list[tuple[str, float, float]]) -> dict[str, float]:
    """Shares of children (name, capacity, weight): by weight, what a full one leaves going to the others."""
    out: dict[str, float] = {}
    rest = sorted(children, key=lambda c: (c[1] / c[2], c[0]))
    budget = min(budget, sum(c[1] for c in rest))
    weight = sum(c[2] for c in rest)
    for i, (name, capacity, w) in enumerate(rest):
        level = budget / weight
        if level * w <= capacity:
            return out | {n: level * x for n, _, x in rest[i:]}
        out[name] = capacity
        budget, weight = budget - capacity, sum(c[2] for c in rest[i + 1 :])
    return out


def allocate(leaves: dict[tuple[str, str, str], int], mix: Mix) -> dict[tuple[str, str, str], int]:
    """Whole tokens for each leaf (domain, language, source), from the tokens that each has."""
    tree: dict[str, dict[str, dict[str, int]]] = {}
    for (d, lang, s), n in leaves.items():
        if n:
            tree.setdefault(d, {}).setdefault(lang, {})[s] = n * mix.epochs
    room = {d: {k: sum(x.values()) for k, x in langs.items()} for d, langs in tree.items()}
    out = dict.fromkeys(leaves, 0)
    weight = lambda table, name: table.get(name, mix.other)
    budget = float(int(mix.ratio * sum(leaves.values())))
    for d, db in fill(budget, [(d, sum(x.values()), weight(mix.domain_weights, d)) for d, x in room.items()]).items():
        for k, kb in fill(db, [(k, n, weight(mix.lang_weights, k)) for k, n in room[d].items()]).items():
            for s, sb in fill(kb, [(s, n, 1.0) for s, n in tree[d][k].items()]).items():
                out[d, k, s] = int(sb + 1e-6)
    return out


def token_count(text: Column) -> Column:
    """Tokens for budgets are runs of other characters than blanks, tabs and line ends."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("bigint")


def domain_of(source: Column, mix: Mix) -> Column:
    pairs = [F.lit(x) for pair in sorted(mix.domains.items()) for x in pair]
    return F.coalesce(F.create_map(*pairs)[source], F.lit("other")) if pairs else F.lit("other")


LEAF = ["domain", "lang", "source"]


def _weight(name: Column, table: dict[str, float], other: float) -> Column:
    pairs = [F.lit(x) for k, w in sorted(table.items()) for x in (k, float(w))]
    return F.coalesce(F.create_map(*pairs)[name], F.lit(float(other))) if pairs else F.lit(float(other))


def _filled(leaves: DataFrame, parent: list[str], child: str, above: DataFrame, weight: Column) -> DataFrame:
    """(*parent, child, b): fill() of each parent's share b (in `above`) over its children, in closed form.

    Children are ordered by capacity over weight. If the first i of them are full, the others' level is what is left over
    their weights; the level that holds is the first at which the next child isn't full.
    """
    nodes = leaves.groupBy(*parent, child).agg(F.sum("cap").alias("cap"))
    nodes = (nodes.join(above, parent) if parent else nodes.crossJoin(F.broadcast(above))).withColumn("w", weight)  # above is one row
    whole = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))  # without a parent: domains, of which the mix lists all
    ordered = whole.orderBy(F.col("cap") / F.col("w"), child)
    full = F.coalesce(F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    levels = nodes.withColumn("level", (F.least("b", F.sum("cap").over(whole)) - full) / rest)
    level = F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(whole)
    return levels.select(*parent, child, F.least("cap", F.col("w") * F.coalesce(level, F.lit(1e300))).alias("b"))


def targets(own: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, whole, rest): each leaf's whole epochs, and the tokens of its last."""
    leaves = settled(own.groupBy(*LEAF).agg(F.sum("n_tokens").alias("have")).withColumn("cap", F.col("have").cast("double") * mix.epochs), "mix-leaves")
    root = leaves.agg(F.floor(F.lit(float(mix.ratio)) * F.coalesce(F.sum("have"), F.lit(0)).cast("double")).cast("double").alias("b"))
    domains = _filled(leaves, [], "domain", root, _weight(F.col("domain"), mix.domain_weights, mix.other))
    langs = _filled(leaves, ["domain"], "lang", domains, _weight(F.col("lang"), mix.lang_weights, mix.other))
    sources = _filled(leaves, ["domain", "lang"], "source", langs, F.lit(1.0))
    goal = leaves.join(sources, LEAF).withColumn("t", F.floor(F.col("b") + 1e-6).cast("bigint")).filter("t > 0")
    return goal.select(*LEAF, F.expr("t div have").alias("whole"), F.expr("t % have").alias("rest"))


def select(df: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, domain, lang, source, epoch, n_tokens): the documents of the mixture, once for each epoch they are in.

    Null languages and sources count as "unknown"; their weights are `other`'s. Rows without a token (null or empty
    texts) are in no epoch. Very long texts are one document, in or out as a whole. Rows with the same id are selected
    each by itself; full ties in the seeded order are equal in all that counts. A null id is ordered as the empty text.
    An empty table gives no rows. df needs the columns lang and source; others are left out, whatever their names.
    """
    mix = mix or Mix()
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in ("lang", "source"))
    own = df.select(F.col(f"`{id_col}`"), domain_of(source, mix).alias("domain"), lang.alias("lang"), source.alias("source"), token_count(F.col(f"`{text_col}`")).alias("n_tokens"))
    own = settled(own.filter("n_tokens > 0"), "mix-tokens")
    placed = own.join(settled(targets(own, mix), "mix-targets"), LEAF)
    epochs = placed.filter("whole > 0").select(id_col, *LEAF, F.explode(F.expr("sequence(0, cast(whole - 1 AS int))")).alias("epoch"), "n_tokens")
    text_id = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    order = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("whole").cast("string"), text_id))
    last = placed.filter("rest > 0").withColumn("order", order).withColumn("bin", F.substring("order", 1, 3))
    bins = last.groupBy(*LEAF, "bin").agg(F.sum("n_tokens").alias("bin_tokens"))
    before = Window.partitionBy(*LEAF).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*LEAF, "bin", F.coalesce(F.sum("bin_tokens").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy(*LEAF, "bin").orderBy("order", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    reached = last.join(bins, [*LEAF, "bin"]).filter("before < rest").withColumn("upto", F.col("before") + F.sum("n_tokens").over(within))
    prefix = reached.filter("2 * upto - n_tokens <= 2 * rest").select(id_col, *LEAF, F.col("whole").cast("int").alias("epoch"), "n_tokens")
    return epochs.unionByName(prefix)


def mixed_rows(df: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's own columns of the mixture's rows, a row occurring once for each epoch it is in.

    Rows are told apart by id and text, so that repeated ids with different texts keep to their own decisions; of
    rows that are equal in both, as many stay as were selected. Null, empty and very long texts, ties and empty tables are
    as select() has them. Extra columns may have any name.
    """
    key, turn, n, epoch = (fresh_name(df, x) for x in ("mix_key", "mix_turn", "mix_n", "mix_epoch"))
    same = Window.partitionBy(key).orderBy(F.lit(0))
    named = df.withColumn(key, F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("\0")), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    chosen = select(named, mix, key, text_col).groupBy(F.col(key).alias(turn), F.col("epoch").alias(epoch)).agg(F.count(F.lit(1)).alias(n))
    beside = chosen.withColumnRenamed(turn, epoch + "_key")
    numbered = named.withColumn(turn, F.row_number().over(same))
    out = numbered.join(beside, F.col(key) == F.col(epoch + "_key")).filter(F.col(turn) <= F.col(n))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def mixing_sql(mix: Mix | None = None) -> str:
    """DuckDB's SQL for select(documents, mix): shares by the closed form of the levels, prefixes by one running sum."""
    mix = mix or Mix()
    case = lambda col, table, other: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items()) + f" ELSE {other!r} END"

    def level(name: str, parent: str, child: str, of: str, weight: str) -> str:
        """Shares of `child` below `parent`, whose own share is b in `of`."""
        on = f"USING ({parent})" if parent else "ON true"
        part = f"PARTITION BY {parent} " if parent else ""
        keys = f"{parent}, " if parent else ""
        return f"""
{name}0 AS (SELECT {keys}{child}, cap, {weight} AS w, b FROM (SELECT {keys}{child}, sum(cap) AS cap FROM leaf GROUP BY ALL) JOIN {of} {on}),
{name}1 AS (SELECT *, (least(b, sum(cap) OVER ({part})) - coalesce(sum(cap) OVER ({part}ORDER BY cap / w, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(w) OVER ({part}ORDER BY cap / w, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM {name}0),
{name} AS (SELECT {keys}{child}, least(cap, w * coalesce(max(CASE WHEN lam * w <= cap THEN lam END) OVER ({part}), 1e300)) AS b FROM {name}1)"""

    return f"""
WITH tok AS (SELECT doc_id, {case("coalesce(source, 'unknown')", {k: v for k, v in mix.domains.items()}, 'other')} AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
  len(regexp_extract_all(text, '[^ \\t\\r\\n]+'))::BIGINT AS n_tokens FROM documents),
d AS (SELECT * FROM tok WHERE n_tokens > 0),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS have, sum(n_tokens)::DOUBLE * {mix.epochs} AS cap FROM d GROUP BY ALL),
root AS (SELECT floor({mix.ratio!r} * sum(n_tokens)) AS b FROM d),
{level("dom", "", "domain", "root", case("domain", mix.domain_weights, mix.other))},
{level("lan", "domain", "lang", "dom", case("lang", mix.lang_weights, mix.other))},
{level("src", "domain, lang", "source", "lan", "1.0::DOUBLE")},
goal AS (SELECT leaf.*, floor(b + 1e-6)::BIGINT AS t FROM leaf JOIN src USING (domain, lang, source)),
plan AS (SELECT *, t // have AS whole, t % have AS rest FROM goal),
run AS (SELECT d.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{mix.seed}:' || whole || ':' || doc_id), n_tokens ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, unnest(range(0, whole))::INT AS epoch, n_tokens FROM run
UNION ALL SELECT doc_id, domain, lang, source, whole::INT AS epoch, n_tokens FROM run WHERE rest > 0 AND 2 * upto - n_tokens <= 2 * rest"""
