"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import n_words, read, running, stored

GOLDEN = 0.6180339887498949
CELLS = 4096
CHUNK = 65_536


def shares(sized: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0) -> DataFrame:
    """Target of each source: source, source_size, target, rank.

    Sources in code point order, null last, take ``weights`` in turn and share the sum of all sizes. A target stops at
    ``cap`` times its source's size and the excess is shared again by weight: with sources in order of cap by weight,
    the capped ones come first, so one running sum finds the level of the rest. The table has one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = per.withColumn("rank", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    w = w.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("level", F.col("most") / F.col("weight"))
    every, low = Window.partitionBy(), Window.orderBy("level", "rank")
    w = (w.withColumn("total", F.sum("source_size").over(every))
         .withColumn("capped", F.coalesce(F.sum("most").over(low.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("left", F.sum("weight").over(low.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("share", (F.col("total") - F.col("capped")) / F.col("left")))
    w = w.withColumn("cut", F.min(F.when(F.col("share") <= F.col("level"), F.struct("level", "rank", "share"))).over(every)["share"])
    return w.select("source", "source_size", "rank",
                    F.least("most", F.col("cut") * F.col("weight")).alias("target"))


def plan_blocks(targets: DataFrame, block: int, least: int, cap: float) -> DataFrame:
    """Words per block, number of blocks and slots of each source, with its interval of the cumulative weights."""
    t = (targets.filter("source_size > 0")
         .withColumn("len", F.greatest(F.lit(1), F.least(F.lit(block), F.ceil(F.col("source_size") / least))).cast("long"))
         .withColumn("blocks", F.ceil(F.col("source_size") / F.col("len")).cast("long"))
         .withColumn("quota", F.least(F.floor(F.col("target") / F.col("len") + 0.5), F.floor(F.col("blocks") * cap)).cast("long")))
    cum = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("high", F.sum("quota").over(cum)).withColumn("slots", F.sum("quota").over(Window.partitionBy()))
    return t.filter("quota > 0").withColumn("lo", (F.col("high") - F.col("quota")) / F.col("slots")).withColumn(
        "hi", F.col("high") / F.col("slots"))


def schedule(plan: DataFrame) -> DataFrame:
    """Slots in order: n, source_rank, slot_rank, block. Each source gets exactly its quota of slots.

    Slot n takes the source whose interval holds the fractional part of (n + 1/2) times the golden ratio. Four times as
    many points as slots are laid, which by the three-gap theorem reaches every interval often enough; a source takes
    its first ``quota`` hits. Points meet intervals through equal cells of [0, 1), an equi-join.
    """
    cells = plan.select("rank", "quota", "blocks", "lo", "hi", F.explode(F.sequence(
        F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    total = plan.agg(F.coalesce(F.max("slots"), F.lit(0)).alias("slots"))
    n = (total.select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("slots") * 4 / CHUNK))).alias("chunk"), "slots")
         .repartition("chunk").select("chunk", F.explode(F.sequence(
             F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("slots") * 4) - 1)).alias("n"),
             "slots").filter("slots > 0"))
    x = (F.col("n") + 0.5) * F.lit(GOLDEN)
    points = n.withColumn("u", x - F.floor(x)).withColumn("cell", F.floor(F.col("u") * CELLS))
    hit = points.join(cells, "cell").filter("u >= lo AND u < hi").select("n", "chunk", "rank", "quota", "blocks")
    ranked = running(hit, ["rank"], "chunk", [F.col("n")], F.lit(1), "slot_rank")
    return ranked.filter("slot_rank < quota").select("n", F.col("rank").alias("source_rank"), "slot_rank",
                                                     (F.col("slot_rank") % F.col("blocks")).alias("block"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, block: int = 4096,
        least_blocks: int = 1024, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted).

    A source's documents are laid end to end in the order of a hash; its words are cut into equal blocks of at most
    ``block`` words, at least ``least_blocks`` of them where it has as many words. Slot r of a source takes its block
    r modulo the number of blocks, so whole rounds come before repeats, and a document's ``taken`` is what the taken
    blocks hold of it. Positions come from two-level running sums, so a source with most rows is no single task.

    Null or blank texts have size 0 and take 0; a null source is a source of its own, last in order; repeated rows are
    mixed as separate documents; ties in the hash go by doc_id, then size. An empty table gives an empty result.
    Other columns of ``docs`` are not read. Reruns agree. Points are doubles, good for about 10^11 slots.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size")).withColumn(
        "h", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    targets = shares(sized, weights, cap)
    plan = plan_blocks(targets, block, least_blocks, cap)
    times = schedule(plan).groupBy("source_rank", F.col("block").alias("slot_block")).agg(F.count(F.lit(1)).alias("times"))
    sources = targets.join(plan.select("rank", "len"), "rank", "left").select(
        F.col("source").alias("src"), "rank", "source_size", "target", F.coalesce("len", F.lit(1).cast("long")).alias("len"))
    placed = running(sized.withColumn("chunk", F.shiftright("h", 48)), ["source"], "chunk",
                     [F.col("h"), F.col("doc_id"), F.col("size")], F.col("size"), "start")
    placed = placed.join(sources, F.col("source").eqNullSafe(F.col("src"))).drop("src", "chunk")
    full = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(
        F.expr("start div len"), F.expr("(start + size - 1) div len"))))
    part = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("len")) - F.greatest(
        F.col("start"), F.col("block") * F.col("len"))
    joined = full.join(times, (F.col("rank") == F.col("source_rank")) & (F.col("block") == F.col("slot_block")), "left")
    got = joined.groupBy("doc_id", "source", "h", "start", "size", "source_size", "target").agg(
        F.sum(part * F.coalesce("times", F.lit(0))).alias("taken"))
    out = ["doc_id", "source", "size", "source_size", "target", "taken"]
    return got.select(*out).unionByName(placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*out))


def repeat_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: a document stands as often as the mix takes its words, rounded to whole times.

    Documents without words, and those that the mix takes less than half of, go; all columns stay as they were.
    Rows equal in doc_id, source and size share what the mix takes of them.
    """
    per = mix(docs).filter("size > 0").groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("rows"))
    times = F.floor(F.col("taken") / (F.col("size") * F.col("rows")) + 0.5).cast("int")
    copies = stored(per.select(F.col("doc_id").alias("id"), F.col("source").alias("src"), F.col("size").alias("n"), times.alias("times")).filter("times > 0"), "mix-copies")
    own = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    met = own.join(copies, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("src")) & (F.col("size") == F.col("n")))
    return met.select("doc", F.explode(F.sequence(F.lit(1), "times"))).select("doc.*")


def op2_source_mix(spark, sf_dir: str) -> DataFrame:
    """All documents at weights 5, 2, 1: doc_id, size, source_size, target, taken."""
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
per AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
    FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
wt AS (SELECT *, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[(rank % 3 + 1)::INT] AS weight, source_size * 3.0::DOUBLE AS most FROM per),
lv AS (SELECT *, most / weight AS level, sum(source_size) OVER ()::BIGINT AS total FROM wt),
cu AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY level, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (ORDER BY level, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM lv),
tg AS (SELECT source, source_size, rank, least(most, weight * (SELECT share FROM cu WHERE share <= level ORDER BY level, rank LIMIT 1)) AS target
    FROM cu),
ln AS (SELECT *, greatest(1, least(4096, ceil(source_size / 1024.0::DOUBLE)))::BIGINT AS len FROM tg WHERE source_size > 0),
bl AS (SELECT *, ceil(source_size / len::DOUBLE)::BIGINT AS blocks FROM ln),
qt AS (SELECT *, least(floor(target / len + 0.5::DOUBLE), blocks * 3)::BIGINT AS quota FROM bl),
hg AS (SELECT *, sum(quota) OVER (ORDER BY rank)::BIGINT AS high, sum(quota) OVER ()::BIGINT AS slots FROM qt),
pl AS (SELECT *, (high - quota)::DOUBLE / slots AS lo, high::DOUBLE / slots AS hi FROM hg WHERE quota > 0),
pt AS (SELECT n, (n + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE AS x FROM range(0, (SELECT coalesce(max(slots), 0) * 4 FROM pl)::BIGINT) r(n)),
hit AS (SELECT n, rank, quota, blocks, row_number() OVER (PARTITION BY rank ORDER BY n) - 1 AS slot_rank
    FROM pt JOIN pl ON x - floor(x) >= lo AND x - floor(x) < hi),
tm AS (SELECT rank, slot_rank % blocks AS block, count(*) AS times FROM hit WHERE slot_rank < quota GROUP BY ALL),
pos AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sized),
pc AS (SELECT doc_id, size, start, rank, len, unnest(range(start // len, (start + size - 1) // len + 1)) AS block
    FROM pos JOIN ln ON pos.source IS NOT DISTINCT FROM ln.source WHERE size > 0),
tk AS (SELECT pc.doc_id, pc.rank, pc.start, sum((least(start + size, (pc.block + 1) * len) - greatest(start, pc.block * len)) * times)::BIGINT AS taken
    FROM pc JOIN tm ON pc.rank = tm.rank AND pc.block = tm.block GROUP BY ALL)
SELECT pos.doc_id, pos.size, tg.source_size, tg.target, CASE WHEN size = 0 THEN 0 ELSE coalesce(tk.taken, 0) END::BIGINT AS taken
FROM pos JOIN tg ON pos.source IS NOT DISTINCT FROM tg.source
LEFT JOIN tk ON pos.size > 0 AND tk.doc_id IS NOT DISTINCT FROM pos.doc_id AND tk.rank = tg.rank AND tk.start = pos.start"""
