"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's share p of all tokens is raised to an exponent a and normalised: w ~ p**a. The smallest a from 0 to
1, in steps of one millionth, that meets the targets is found by bisection, five halvings in each pass over the
table of sources, which may be as many as domains: no source may be repeated more than `max_repeat` times as
often as the least repeated one, and the entropy of the weights may be at most `max_entropy` of that of equal
weights. The budget is the least in which every source is passed over once at least; a source's quota is its
weight of it.

A source is drawn in passes (epochs), each a permutation of its documents by a hash of seed, epoch and id; the
last pass ends with the document that reaches the quota. The sequence is cut into blocks of equal budget that
hold all sources in their weights. A document's block follows from the tokens of its source that come before its
cell, cells being 256 equal ranges of the hash: counts by (source, epoch, cell) decide, so that no source is
ever sorted in one place. In a block, rows go by the second half of the hash, which knows nothing of cells; a
block is as many partitions as its size asks for.

Tokens are runs of characters other than white space. A null source is a source of its own; null and empty texts
have no tokens and cost nothing. A source without tokens has weight 0 and is passed over once. Rows of one id,
and rows without an id, tie and are taken together. Extra columns are ignored (draw) or kept (mix).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, materialise, small

MAX_REPEAT, BLOCKS, SEED = 2.0, 64, "mix"
#: Steps of the exponent from 0 to 1, and how many of them are tried in a pass: those of five halvings.
STEPS, TRIED = 1_000_000, 31
#: Tokens of a partition of the mixed table.
PARTITION = 32_000_000


def exponent(sources: DataFrame, total: int, max_repeat: float | None = MAX_REPEAT, max_entropy: float | None = None) -> int:
    """The smallest step of the exponent that meets the targets, for sources (source, t) with tokens."""
    lo, hi = 0, STEPS
    while lo < hi:
        tried = sorted({lo + (hi - lo) * k // (TRIED + 1) for k in range(1, TRIED + 1)} | {(lo + hi) // 2})
        r = F.pow(F.col("t") / F.lit(float(total)), F.col("step") / F.lit(float(STEPS)))
        each = sources.withColumn("step", F.explode(F.array(*map(F.lit, tried)))).withColumn("r", r)
        got = each.groupBy("step").agg(F.sum("r").alias("sum"), F.sum(F.col("r") * F.log("r")).alias("log"), F.max(F.col("r") / F.col("t")).alias("most"), F.min(F.col("r") / F.col("t")).alias("least"), F.count("*").alias("n"))
        for x in got.orderBy("step").collect():  # a row for each step that is tried
            fits = max_repeat is None or x["most"] <= max_repeat * x["least"]
            fits = fits and (max_entropy is None or x["n"] < 2 or math.log(x["sum"]) - x["log"] / x["sum"] <= max_entropy * math.log(x["n"]))
            if fits:
                hi = x["step"]
                break
            lo = x["step"] + 1
    return lo


def weigh(sources: DataFrame, max_repeat: float | None = MAX_REPEAT, max_entropy: float | None = None) -> DataFrame:
    """(source, t, weight, quota, last) for sources (source, t): tokens, weight, tokens to draw and the last pass."""
    some = sources.where("t > 0")
    total = some.agg(F.sum("t").alias("t")).first()["t"]
    nothing = sources.where("t = 0").select("source", "t", F.lit(0.0).alias("weight"), F.lit(0).cast("bigint").alias("quota"), F.lit(0).alias("last"))
    if not total:
        return nothing
    step = exponent(some, total, max_repeat, max_entropy)
    raw = some.withColumn("r", F.pow(F.col("t") / F.lit(float(total)), F.lit(step / STEPS)))
    weight = raw.crossJoin(F.broadcast(raw.agg(F.sum("r").alias("sum")))).withColumn("weight", F.col("r") / F.col("sum"))
    quota = F.greatest("t", F.round(F.col("budget") * F.col("weight")).cast("bigint"))
    quotas = weight.crossJoin(F.broadcast(weight.agg(F.max(F.col("t") / F.col("weight")).alias("budget")))).withColumn("quota", quota)
    return quotas.select("source", "t", "weight", "quota", F.expr("quota div t").cast("int").alias("last")).unionByName(nothing)


def n_tokens(text: Column) -> Column:
    """Tokens of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("bigint")


def _key(epoch: Column, id_col: Column) -> Column:
    return F.md5(F.concat_ws("/", F.lit(SEED), epoch.cast("string"), F.coalesce(id_col.cast("string"), F.lit(""))))


def _cell(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 2), 16, 10).cast("int")


def _order(key: Column) -> Column:
    return F.substring(key, 17, 16)


def _schedule(docs: DataFrame, id_col: str, source_col: str, text_col: str, max_repeat: float | None, max_entropy: float | None, blocks: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Light rows (id, source, n); sources (s, t, weight, quota, last); cells (s, e, c, block, stop) that are drawn, a stop being the last key of a cell that is drawn in part; the tokens drawn."""
    light = materialise(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_tokens(F.col(text_col)).alias("n")), "tokens")
    counted = materialise(light.groupBy("source").agg(F.sum("n").alias("t")), "sources")
    quotas = materialise(weigh(counted, max_repeat, max_entropy).withColumnRenamed("source", "s"), "quotas")
    many, drawn = quotas.agg(F.count("*"), F.sum("quota")).first()
    keyed = light.join(small(quotas.select("s", "last"), many), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    keyed = keyed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("last")))).withColumn("key", _key(F.col("epoch"), F.col("id"))).withColumn("cell", _cell(F.col("key")))
    counts = keyed.groupBy("source", "epoch", "cell").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("source").orderBy("epoch", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.withColumn("done", F.coalesce(F.sum("n").over(before), F.lit(0))).join(small(quotas.select("s", "quota"), many), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    block = F.expr(f"if(quota = 0, 0, least({blocks - 1}, done * {blocks} div quota))").cast("int")
    cells = cells.where("epoch = 0 OR done < quota").select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("cell").alias("c"), block.alias("block"), F.expr("done + n > quota").alias("part"), (F.col("quota") - F.col("done")).alias("room"))
    cells = materialise(cells, "cells")
    # one cell of each source holds the end of its quota: the documents that begin before the end are drawn
    edge = cells.where("part").select("s", "e", "c", "room")
    on = F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("cell") == F.col("c"))
    ties = keyed.join(small(edge, many), on).groupBy("s", "e", "c", "room", "key").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("s").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    stops = ties.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where("before < room").groupBy("s", "e", "c").agg(F.max("key").alias("stop"))
    stops = small(stops.withColumnsRenamed({"s": "s2", "e": "e2", "c": "c2"}), many)
    same = F.col("s").eqNullSafe(F.col("s2")) & (F.col("e") == F.col("e2")) & (F.col("c") == F.col("c2"))
    drawn_cells = materialise(cells.join(stops, same, "left").select("s", "e", "c", "block", "stop"), "cells")
    discard(counted, cells)
    return light, quotas, drawn_cells, drawn or 0


def _drawn(rows: DataFrame, source: Column, id_col: Column, quotas: DataFrame, cells: DataFrame, names: list[str]) -> DataFrame:
    """rows, as often as they are drawn, with their epoch, key and block; names: of these and of other columns that rows don't have."""
    epoch, key, block, cell, stop, s, e, c, last = names
    many, n = quotas.count(), cells.count()
    out = rows.join(small(quotas.select(F.col("s").alias(s), F.col("last").alias(last)), many), source.eqNullSafe(F.col(s))).drop(s)
    out = out.withColumn(epoch, F.explode(F.sequence(F.lit(0), F.col(last)))).withColumn(key, _key(F.col(epoch), id_col)).withColumn(cell, _cell(F.col(key)))
    cells = small(cells.select(F.col("s").alias(s), F.col("e").alias(e), F.col("c").alias(c), F.col("block").alias(block), F.col("stop").alias(stop)), n)
    on = source.eqNullSafe(F.col(s)) & (F.col(epoch) == F.col(e)) & (F.col(cell) == F.col(c))
    return out.join(cells, on).where(F.col(stop).isNull() | (F.col(key) <= F.col(stop)))


def draw(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", max_repeat: float | None = MAX_REPEAT, max_entropy: float | None = None, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, source, epoch, block, order_key, n_tokens) for each drawn document and pass; within a block, rows go by the last 16 digits of order_key."""
    light, quotas, cells, _ = _schedule(docs, id_col, source_col, text_col, max_repeat, max_entropy, blocks)
    drawn = _drawn(light, F.col("source"), F.col("id"), quotas, cells, ["epoch", "order_key", "block", "cell", "stop", "s", "e", "c", "last"])
    return drawn.select(F.col("id").alias("doc_id"), "source", "epoch", "block", "order_key", F.col("n").alias("n_tokens"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", max_repeat: float | None = MAX_REPEAT, max_entropy: float | None = None, blocks: int = BLOCKS) -> DataFrame:
    """docs' columns, a row for each drawn document and pass, in the order of blocks and of the keys' second halves in a block."""
    light, quotas, cells, tokens = _schedule(docs, id_col, source_col, text_col, max_repeat, max_entropy, blocks)
    discard(light)
    names = fresh(docs, "epoch", "key", "block", "cell", "stop", "s", "e", "c", "last")
    drawn = _drawn(docs, F.col(source_col).cast("string"), F.col(id_col), quotas, cells, names)
    key, block = F.col(names[1]), F.col(names[2])
    # partitions in order: a block is one, or equal ranges of the keys' second halves
    each = max(1, math.ceil(tokens / blocks / PARTITION))
    part = F.conv(F.substring(key, 17, 6), 16, 10).cast("bigint") * each / F.lit(1 << 24)
    return drawn.repartitionById(blocks * each, (block * each + F.floor(part)).cast("int")).sortWithinPartitions(block, _order(key)).select(*docs.columns)


#: draw() with its defaults, for DuckDB.
SQL = f"""
WITH RECURSIVE light AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0) AS BIGINT) AS n FROM documents
), tok AS (
    SELECT source, CAST(sum(n) AS BIGINT) AS t FROM light GROUP BY source
), total AS (
    SELECT CAST(sum(t) AS DOUBLE) AS total FROM tok
), bis AS (
    SELECT 0 AS i, 0 AS lo, {STEPS} AS hi
    UNION ALL
    SELECT i + 1,
        CASE WHEN (SELECT max(pow(t / total, ((lo + hi) // 2) / {STEPS}.0) / t) <= {MAX_REPEAT} * min(pow(t / total, ((lo + hi) // 2) / {STEPS}.0) / t) FROM tok, total WHERE t > 0) THEN lo ELSE (lo + hi) // 2 + 1 END,
        CASE WHEN (SELECT max(pow(t / total, ((lo + hi) // 2) / {STEPS}.0) / t) <= {MAX_REPEAT} * min(pow(t / total, ((lo + hi) // 2) / {STEPS}.0) / t) FROM tok, total WHERE t > 0) THEN (lo + hi) // 2 ELSE hi END
    FROM bis WHERE lo < hi
), raw AS (
    SELECT source, t, CASE WHEN t > 0 THEN pow(t / total, (SELECT max(lo) FROM bis WHERE lo >= hi) / {STEPS}.0) ELSE 0 END AS r FROM tok, total
), weight AS (
    SELECT source, t, r / (SELECT sum(r) FROM raw) AS w FROM raw
), quota AS (
    SELECT source, t, greatest(t, CAST(round((SELECT max(t / w) FROM weight WHERE t > 0) * w) AS BIGINT)) AS q FROM weight WHERE t > 0
    UNION ALL SELECT source, 0, 0 FROM tok WHERE t = 0
), keyed AS (
    SELECT doc_id, source, epoch, n, md5('{SEED}/' || epoch || '/' || coalesce(CAST(doc_id AS VARCHAR), '')) AS order_key
    FROM light, (SELECT unnest(range(0, 1 + (SELECT CAST(max(CASE WHEN t > 0 THEN q // t ELSE 0 END) AS BIGINT) FROM quota))) AS epoch)
), cell AS (
    SELECT source, epoch, substr(order_key, 1, 2) AS c, CAST(sum(n) AS BIGINT) AS n FROM keyed GROUP BY ALL
), cum AS (
    SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY source ORDER BY epoch, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS done FROM cell
), placed AS (
    SELECT cum.*, q, CASE WHEN q = 0 THEN 0 ELSE least({BLOCKS - 1}, done * {BLOCKS} // q) END AS block
    FROM cum JOIN quota ON cum.source IS NOT DISTINCT FROM quota.source WHERE epoch = 0 OR done < q
), drawn AS (
    SELECT k.*, p.block, p.q, p.done,
        coalesce(sum(k.n) OVER (PARTITION BY k.source, k.epoch, p.c ORDER BY k.order_key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
            - sum(k.n) OVER (PARTITION BY k.source, k.epoch, p.c, k.order_key) AS before, p.n AS cell_n
    FROM keyed k JOIN placed p ON k.source IS NOT DISTINCT FROM p.source AND k.epoch = p.epoch AND substr(k.order_key, 1, 2) = p.c
)
SELECT doc_id, source, CAST(epoch AS INTEGER) AS epoch, CAST(block AS INTEGER) AS block, order_key, n AS n_tokens
FROM drawn WHERE done + cell_n <= q OR done + before < q
"""
