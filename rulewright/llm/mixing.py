"""Mixing sources to target weights over a tree of domain, language and source.

Budgets go down the tree by weight. A node's capacity is what its subtree can give (tokens times max_epochs). Under a
node, children whose share exceeds their capacity give all they have, and what they lack is dealt to their siblings
by weight; only what all siblings together lack is missing one level up, where the same rule holds. A leaf reads its
documents in a seeded order that differs in each epoch, whole epochs first, then the longest prefix within budget.

All of it is DataFrame code in integer arithmetic. A leaf's order is by md5, so the md5's first digits cut a leaf into
buckets of about bucket_rows rows: running sums go over bucket totals first and over rows inside one bucket only, so
no task needs a whole leaf however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LEVELS = ("domain", "lang", "source")
#: Production weights: (level, key) -> weight. What isn't listed weighs DEFAULT_WEIGHT.
WEIGHTS = {("domain", "d0"): 4, ("domain", "d1"): 3, ("domain", "d2"): 2, ("lang", "en"): 6, ("lang", "de"): 2, ("lang", "es"): 2, ("lang", "fr"): 2, ("source", "src0"): 1}
DEFAULT_WEIGHT = 2


def n_tokens(text: Column) -> Column:
    """Space-separated words; 0 for null and empty texts."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, "[^ \t\r\n]+", "x"), "[ \t\r\n]+", "")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """Production tree: sources are dealt to three domains by the number in their name."""
    return F.concat(F.lit("d"), F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]{1,9})', 1) as int)") % 3, F.lit(0)))


def weight_of(level: str, key: Column, weights: dict[tuple[str, str], int], default: int) -> Column:
    got = F.lit(default)
    for (at, name), w in weights.items():
        if at == level:
            got = F.when(key == name, w).otherwise(got)
    return got.cast("long")


def allocate(leaves: DataFrame, total: int, max_epochs: int, weights: dict, default: int, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Leaf budgets in tokens. leaves: one row per leaf with the level columns and `tokens`.

    Under a parent with budget B, children are taken in order of capacity / weight. Child i, with what is left R and
    the weights not yet served W, is satisfied in full if capacity_i * W <= R * weight_i. From the first that is not,
    each child gets floor(R * weight / W) of that first R and W.
    """
    exact = "decimal(19,0)"
    budgets = None
    for depth, level in enumerate(levels):
        parent, path = list(levels[:depth]), list(levels[: depth + 1])
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * max_epochs).alias("cap")).withColumn("weight", weight_of(level, F.col(level), weights, default))
        # a table of nodes, not of documents: it is joined by key whatever its estimated size
        nodes = nodes.withColumn("parent", F.lit(total).cast("long")) if budgets is None else nodes.join(budgets.withColumnRenamed("budget", "parent").hint("merge"), parent)
        by = Window.partitionBy(*(parent or [F.lit(0)])).orderBy((F.col("cap") / F.col("weight")).asc(), level)
        before = by.rowsBetween(Window.unboundedPreceding, -1)
        nodes = nodes.withColumns({"left": F.col("parent") - F.coalesce(F.sum("cap").over(before), F.lit(0)), "rest": F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))})
        nodes = nodes.withColumn("short", F.col("cap").cast(exact) * F.col("rest").cast(exact) <= F.col("left").cast(exact) * F.col("weight").cast(exact))
        first = F.first(F.when(~F.col("short"), F.struct("left", "rest")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
        nodes = nodes.withColumn("at", first)
        # decimals of 38 digits lose places when divided, so the quotient is taken as a long and its remainder apart
        share = F.expr("(at.left div at.rest) * weight + ((at.left % at.rest) * weight) div at.rest")
        budgets = nodes.select(*path, F.when(F.col("at").isNull(), F.col("cap")).otherwise(share).alias("budget"))
    return budgets


def _order(seed: int) -> Column:
    """A row's place in its leaf for the epoch that is read in part; the order is a new one for every epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full_epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("hash")))


def _keys(docs: DataFrame) -> DataFrame:
    return docs.withColumns({
        "doc_id": F.col("doc_id").cast("long"), "lang": F.coalesce(F.col("lang").cast("string"), F.lit("unknown")), "source": F.coalesce(F.col("source").cast("string"), F.lit("unknown")),
        "n_tokens": n_tokens(F.col("text")), "hash": F.md5(F.coalesce("text", F.lit(""))),
    }).withColumn("domain", domain_of(F.col("source"))).select("doc_id", *LEVELS, "n_tokens", "hash")


def _small(table: DataFrame, most: int) -> DataFrame:
    """A written table, to be broadcast if it has so many rows at most, else joined by a shuffle that AQE may split."""
    return F.broadcast(table) if table.count() <= most else table.hint("merge")


def _decided(docs: DataFrame, total: int | None, part: tuple[int, int], max_epochs: int, seed: int, weights: dict | None, default: int, bucket_rows: int, max_plan_rows: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """All rows with full_epochs, place and in_prefix; and the plan, a row for each leaf."""
    keys = common.saved(_keys(docs), "mixing")
    leaves = common.saved(keys.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs")), "leaves")
    sums = leaves.agg(F.sum("tokens").alias("t"), F.max("n_docs").alias("n")).first()
    if total is None:
        total = (sums["t"] or 0) * part[0] // part[1]
    budgets = allocate(leaves, total, max_epochs, WEIGHTS if weights is None else weights, default)
    plan = leaves.join(budgets.hint("merge"), list(LEVELS))
    plan = plan.select(*LEVELS, F.expr("if(tokens = 0, 0, budget div tokens)").alias("full_epochs"), F.expr("if(tokens = 0, 0, budget % tokens)").alias("prefix"))
    # the plan has a row per source and language; written and read back, its size is known to the join
    plan = common.saved(plan, "plan")
    digits = 0
    while 16**digits * bucket_rows < (sums["n"] or 0):
        digits += 1
    rows = keys.join(_small(plan, max_plan_rows), list(LEVELS)).withColumn("place", _order(seed))
    rows = rows.withColumn("bucket", F.substring("place", 1, digits))
    sizes = rows.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("held"), F.first("prefix").alias("prefix"))
    running = Window.partitionBy(*LEVELS).orderBy("bucket")
    edges = sizes.withColumn("before", F.sum("held").over(running) - F.col("held")).where("before <= prefix").select(*LEVELS, "bucket", "before", F.expr("before + held <= prefix").alias("whole"))
    edges = common.saved(edges, "edges")
    # by bucket too, or a hot leaf would stay in the one task that its join has put it in
    placed = rows.repartition(*LEVELS, "bucket").join(edges.hint("merge"), [*LEVELS, "bucket"], "left")
    sure = placed.where("whole is null or whole").withColumn("in_prefix", F.coalesce("whole", F.lit(False)))
    inside = Window.partitionBy(*LEVELS, "bucket").orderBy("place")  # range frame: equal places are taken together
    cut = placed.where("not whole").withColumn("in_prefix", F.col("before") + F.sum("n_tokens").over(inside) <= F.col("prefix"))
    return sure.unionByName(cut), plan


def mix(docs: DataFrame, total: int | None = None, part: tuple[int, int] = (3, 5), max_epochs: int = 4, seed: int = 17, weights: dict | None = None, default: int = DEFAULT_WEIGHT, bucket_rows: int = 4096) -> DataFrame:
    """Which documents are read how often: doc_id, domain, lang, source, n_tokens, full_epochs, in_prefix, copies.

    docs has doc_id, text, lang, source; other columns are ignored. total is the budget in tokens (default: part of
    what docs has, as a fraction). A null lang or source is the leaf `unknown`. Null and empty texts have no tokens:
    they are read whenever their place in the order is within the prefix. Rows with the same id, or without one, are
    ordered by their text; repeated rows that are alike in all of these are taken together or not at all. Documents
    that are not read at all are not returned.
    """
    rows, _ = _decided(docs, total, part, max_epochs, seed, weights, default, bucket_rows)
    out = rows.withColumn("copies", F.col("full_epochs") + F.col("in_prefix").cast("long"))
    return out.where("copies > 0").select("doc_id", *LEVELS, "n_tokens", "full_epochs", "in_prefix", "copies")


def select_documents(docs: DataFrame, total: int | None = None, part: tuple[int, int] = (4, 5), seed: int = 17, weights: dict | None = None, default: int = DEFAULT_WEIGHT, bucket_rows: int = 4096, max_plan_rows: int = 50_000) -> DataFrame:
    """The rows of docs that mix() reads with one epoch at most, with all their columns.

    A leaf's prefix ends at a place in its order, so the texts need no shuffle: each row is held against its leaf's
    last place. The table of last places has a row for each leaf and is broadcast if it has max_plan_rows at most.
    """
    rows, plan = _decided(docs, total, part, 1, seed, weights, default, bucket_rows, max_plan_rows)
    last = rows.where("in_prefix").groupBy(*LEVELS).agg(F.max("place").alias("last"))
    ends = common.saved(plan.join(last.hint("merge"), list(LEVELS), "left").select(*(F.col(c).alias(f"_{c}") for c in LEVELS), "full_epochs", "last"), "ends")
    keyed = docs.withColumn("_row", F.struct(*docs.columns))
    keyed = keyed.withColumns({"lang": F.coalesce(F.col("lang").cast("string"), F.lit("unknown")), "source": F.coalesce(F.col("source").cast("string"), F.lit("unknown")), "hash": F.md5(F.coalesce("text", F.lit("")))})
    keyed = keyed.select("_row", F.col("doc_id").cast("long").alias("doc_id"), "hash", F.col("lang").alias("_lang"), F.col("source").alias("_source"), domain_of(F.col("source")).alias("_domain"))
    kept = keyed.join(_small(ends, max_plan_rows), ["_domain", "_lang", "_source"]).where((F.col("full_epochs") > 0) | (_order(seed) <= F.col("last")))
    return kept.select("_row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production mixture of all documents; odd input as in mix()."""
    return mix(common.load(spark, sf_dir, "documents"))


_PATH = {1: "domain", 2: "domain, lang", 3: "domain, lang, source"}


def oracle_sql(part: tuple[int, int] = (3, 5), max_epochs: int = 4, seed: int = 17, weights: dict | None = None, default: int = DEFAULT_WEIGHT) -> str:
    """The same in plain SQL: water-filling by level, then one running sum over each leaf."""
    weights = WEIGHTS if weights is None else weights

    def weight(level: str) -> str:
        cases = " ".join(f"WHEN {level} = '{k}' THEN {w}" for (at, k), w in weights.items() if at == level)
        return f"CASE {cases} ELSE {default} END" if cases else str(default)

    ctes = [
        f"""d AS (SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, md5(coalesce(text, '')) AS hash,
      CAST(coalesce(length(regexp_replace(regexp_replace(text, '[^ \\t\\r\\n]+', 'x', 'g'), '[ \\t\\r\\n]+', '', 'g')), 0) AS BIGINT) AS n_tokens,
      'd' || coalesce(TRY_CAST(nullif(regexp_extract(coalesce(source, 'unknown'), '([0-9]{{1,9}})', 1), '') AS INT) % 3, 0) AS domain FROM documents)""",
        "leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens FROM d GROUP BY ALL)",
        f"b0 AS (SELECT CAST(sum(tokens) * {part[0]} // {part[1]} AS HUGEINT) AS budget FROM leaves)",
    ]
    for i, level in enumerate(LEVELS, 1):
        parent = _PATH.get(i - 1)
        over = f"PARTITION BY {parent} " if parent else ""
        join = f"JOIN b{i - 1} USING ({parent})" if parent else "CROSS JOIN b0"
        ctes += [
            f"n{i} AS (SELECT {_PATH[i]}, sum(tokens) * {max_epochs} AS cap, {weight(level)} AS w FROM leaves GROUP BY {_PATH[i]})",
            f"""o{i} AS (SELECT *, budget - coalesce(sum(cap) OVER ({over}ORDER BY CAST(cap AS DOUBLE) / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r,
      sum(w) OVER ({over}ORDER BY CAST(cap AS DOUBLE) / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM n{i} {join})""",
            f"""f{i} AS (SELECT *, first_value(CASE WHEN cap * rest > r * w THEN {{'r': r, 'rest': rest}} END IGNORE NULLS) OVER ({over}ORDER BY CAST(cap AS DOUBLE) / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cut FROM o{i})""",
            f"b{i} AS (SELECT {_PATH[i]}, CASE WHEN cut IS NULL THEN cap ELSE cut.r * w // cut.rest END AS budget FROM f{i})",
        ]
    ctes += [
        "plan AS (SELECT domain, lang, source, CASE WHEN tokens = 0 THEN 0 ELSE budget // tokens END AS full_epochs, CASE WHEN tokens = 0 THEN 0 ELSE budget % tokens END AS prefix FROM leaves JOIN b3 USING (domain, lang, source))",
        f"p AS (SELECT *, md5(concat_ws(':', '{seed}', CAST(full_epochs AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), ''), hash)) AS place FROM d JOIN plan USING (domain, lang, source))",
        "q AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= prefix AS in_prefix FROM p)",
    ]
    return "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, domain, lang, source, n_tokens, CAST(full_epochs AS BIGINT) AS full_epochs, in_prefix, CAST(full_epochs AS BIGINT) + CAST(in_prefix AS BIGINT) AS copies FROM q WHERE full_epochs > 0 OR in_prefix"
