"""Temperature mixing of sources: a bisected exponent, then budgeted permutations of blocks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import digest_of, materialize, number_of, repeated, salted_lookup
from .packing import count_words

#: Rows of a block, and blocks of a super-block, about.
BLOCK, SUPER = 4096, 1024


def _grid(sources: DataFrame, exponents: list[float]) -> dict[float, tuple]:
    """For each exponent a: sum s^a, sum s^a ln s, least and greatest s^(a - 1), over the shares s."""
    a = F.col("a")
    rows = sources.select("share", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
    found = rows.groupBy("a").agg(
        F.sum(F.pow("share", a)), F.sum(F.pow("share", a) * F.log("share")), F.min(F.pow("share", a - 1)), F.max(F.pow("share", a - 1))
    )
    return {r[0]: tuple(r)[1:] for r in found.collect()}


def solve_exponent(sources: DataFrame, max_epochs: float | None, entropy: float | None, budget: float | None, rounds: int = 7) -> float:
    """The exponent in [0, 1] by bisection, five halvings a pass: the least whose greatest number of epochs is within
    max_epochs, or the greatest whose entropy (nats) reaches the target. budget is in units of all tokens."""

    def flat_enough(a: float, found: tuple) -> bool:
        z, zl, low, high = found
        if entropy is not None:
            return math.log(z) - a * zl / z >= entropy
        return (high / low if budget is None else budget * high / z) > max_epochs

    low, high = 0.0, 1.0  # flat_enough holds at low and not at high, if it changes at all
    edge = _grid(sources, [0.0, 1.0])
    if flat_enough(1.0, edge[1.0]):
        return 1.0
    if not flat_enough(0.0, edge[0.0]):
        return 0.0
    for _ in range(rounds):
        points = [low + (high - low) * i / 32 for i in range(1, 32)]
        found = _grid(sources, points)
        inside = [x for x in points if flat_enough(x, found[x])]
        low, high = max([low, *inside]), min([high, *(x for x in points if x not in inside)])
    return low if entropy is not None else high


def mix(docs: DataFrame, max_epochs: float | None = 2.0, entropy: float | None = None, budget_tokens: float | None = None, seed: int = 11) -> DataFrame:
    """One row per time a document is drawn: doc_id, source, n_tokens, epoch, block, position (0 to 1).

    A document has its words and one end token, so that none is free; weights are source token shares to the power a,
    made to sum to 1; a is bisected to max_epochs or, if given, the target entropy. Without budget_tokens the budget
    is the least at which every document is drawn once, so mixing never loses one. A source's documents are dealt
    into blocks by hash; every epoch permutes super-blocks, blocks and the documents of a block anew, and the last,
    partial epoch stops at the document that reaches the source's budget. Sorting by position interleaves sources in
    proportion. Rows of equal doc_id, source and length stand together as one run, each drawn in its turn, so repeats are
    no hot key; a null doc_id is a value like others. Null sources are one source "", null texts are empty, an empty table
    gives no rows; other columns are ignored.
    """
    schema = "doc_id, source, n_tokens, epoch, block, position"
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), (count_words() + 1).alias("n_tokens"))
    rows = materialize(rows.groupBy("doc_id", "source", "n_tokens").agg(F.count(F.lit(1)).alias("same")), "mix-rows")
    per = rows.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("same")).alias("tokens"), F.count(F.lit(1)).alias("n_rows"))
    total = rows.agg(F.sum(F.col("n_tokens") * F.col("same"))).first()[0] or 1
    per = materialize(per.withColumn("share", F.col("tokens") / F.lit(total)), "mix-sources")
    if per.isEmpty():
        return rows.select("doc_id", "source", "n_tokens", F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("block"), F.lit(0.0).alias("position"))
    a = solve_exponent(per, max_epochs, entropy, budget_tokens and budget_tokens / total)
    z, _, low, _ = _grid(per, [a])[a]
    budget = total * z / low if budget_tokens is None else budget_tokens  # in tokens
    epochs = F.pow("share", F.lit(a - 1)) * F.lit(budget / (z * total))
    per = per.withColumn("epochs", epochs).withColumn("quota", F.round(F.col("epochs") * F.col("tokens")).cast("long"))
    per = per.withColumn("n_blocks", F.ceil(F.col("n_rows") / BLOCK)).where("quota > 0")
    rows = salted_lookup(rows, per.select("source", "tokens", "quota", "n_blocks", "n_rows"), ["source"], "n_rows", ["doc_id"])
    rows = rows.withColumn("block", F.pmod(number_of(seed, "source", "doc_id", "n_tokens"), F.col("n_blocks"))).withColumn("w", F.col("n_tokens") * F.col("same"))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.expr("cast(ceil(quota / tokens) as int) - 1"))))
    rows = rows.withColumn("sup", F.expr(f"block div {SUPER}"))
    order = lambda *c: digest_of(seed, "epoch", "source", *c)
    before = lambda keys, *by: F.coalesce(
        F.sum("w").over(Window.partitionBy("source", "epoch", *keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    blocks = materialize(rows.groupBy("source", "epoch", "sup", "block").agg(F.sum("w").alias("w")), "mix-blocks")
    sups = blocks.groupBy("source", "epoch", "sup").agg(F.sum("w").alias("w"))
    sups = sups.withColumn("s0", before((), order("sup"), "sup")).drop("w")
    blocks = blocks.withColumn("s1", before(("sup",), order("block"), "block")).drop("w")
    starts = blocks.join(sups, ["source", "epoch", "sup"]).select("source", "epoch", "block", (F.col("s0") + F.col("s1")).alias("start"))
    rows = rows.withColumn("s2", before(("block",), order("doc_id", "n_tokens"), "doc_id", "n_tokens"))
    rows = rows.join(starts, ["source", "epoch", "block"]).withColumn("at", F.col("epoch") * F.col("tokens") + F.col("start") + F.col("s2"))
    rows = rows.withColumn("_times", F.least("same", F.expr("cast(ceil((quota - at) / n_tokens) as long)"))).where("_times > 0")
    rows = repeated(rows, "_times", "_copy").withColumn("at", F.expr("at + _copy * n_tokens"))
    return rows.withColumn("position", F.col("at") / F.col("quota")).selectExpr(*schema.split(", "))


#: The exponent in closed form: shares s to the power a - 1 are at most twice apart.
QUERY_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS n_tokens FROM documents),
p AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS n_rows FROM t GROUP BY source),
a AS (SELECT CASE WHEN max(tokens) <= 2 * min(tokens) THEN 0.0 ELSE (1 - ln(2) / ln(max(tokens) / min(tokens))) END AS a, CAST(max(tokens) AS DOUBLE) AS most FROM p),
q AS (SELECT source, tokens, CAST(round(pow(tokens / most, a - 1) * tokens) AS BIGINT) AS quota, (n_rows + 4095) // 4096 AS n_blocks FROM p, a),
r AS (SELECT t.*, q.tokens, q.quota, CAST(concat('0x', substr(md5(concat_ws('|', 11, t.source, doc_id, n_tokens)), 1, 15)) AS BIGINT) % n_blocks AS block,
             unnest(range(0, (q.quota + q.tokens - 1) // q.tokens)) AS epoch FROM t JOIN q ON q.source = t.source),
b AS (SELECT source, epoch, block, block // 1024 AS sup, sum(n_tokens) AS w FROM r GROUP BY ALL),
u AS (SELECT source, epoch, sup, coalesce(sum(sum(w)) OVER (PARTITION BY source, epoch ORDER BY md5(concat_ws('|', 11, epoch, source, sup)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0
      FROM b GROUP BY source, epoch, sup),
v AS (SELECT source, epoch, sup, block, coalesce(sum(w) OVER (PARTITION BY source, epoch, sup ORDER BY md5(concat_ws('|', 11, epoch, source, block)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s1 FROM b),
x AS (SELECT r.*, coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch, block ORDER BY md5(concat_ws('|', 11, epoch, source, doc_id, n_tokens)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s2 FROM r),
y AS (SELECT x.*, CAST(x.epoch * x.tokens + s0 + s1 + s2 AS BIGINT) AS place FROM x JOIN v USING (source, epoch, block) JOIN u USING (source, epoch, sup))
SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(epoch AS INTEGER) AS epoch, CAST(block AS BIGINT) AS block, CAST(place AS DOUBLE) / quota AS position FROM y WHERE place < quota
"""
