"""One-permutation minhash fingerprints with optimal densification, in packed low-order bits (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import read, stored, words

BINS = 128  # a power of two
SHINGLE = 5
ROWS = 1024
RANGES = 10_000


def with_codes(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: array of BINS bytes for the non-null column ``text``, empty for a text without words.

    Each five-word shingle (of fewer words, the whole sequence) is hashed once. The high bits of the hash name its bin,
    the smallest hash of a bin stands for it by its low byte. An empty bin copies a bin that has shingles: it probes the
    others in an order of its own, that of hash(bin, other), so the first that is not empty is uniform among them and
    the same for any two texts that fill the same bins.
    """
    t = {k: f"{out} {k}" for k in ("words", "hashes", "sorted", "first", "bins")}
    n = F.size(F.col(t["words"]))
    df = df.withColumn(t["words"], words(F.col(text)))
    df = df.withColumn(t["hashes"], F.transform(t["words"], lambda w: F.xxhash64(w)))
    h = F.col(t["hashes"])
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - SHINGLE + 1, F.lit(1))), lambda i: F.xxhash64(*[F.get(h, i + (k - 1)) for k in range(SHINGLE)]))
    shingles = F.when(n >= SHINGLE, many).when(n > 0, F.array(F.xxhash64(F.col(t["words"])))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(t["sorted"], F.sort_array(shingles))
    shift = 64 - (BINS.bit_length() - 1)

    def bin_of(x: Column) -> Column:
        return (F.shiftright(x, shift) + BINS // 2).cast("int")
    s = F.col(t["sorted"])
    df = df.withColumn(t["first"], F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1)))))
    df = df.withColumn(t["bins"], F.transform(t["first"], bin_of))
    bins, first = F.col(t["bins"]), F.col(t["first"])

    def low(position: Column) -> Column:
        return F.get(first, position).bitwiseAND(255).cast("int")

    def fill(i: Column) -> Column:
        own = F.array_position(bins, i).cast("int")
        probe = F.array_min(F.transform(bins, lambda j, p: F.xxhash64(i, j).bitwiseAND(-BINS).bitwiseOR(p.cast("bigint"))))
        return F.when(own > 0, low(own - 1)).otherwise(low(probe.bitwiseAND(BINS - 1).cast("int")))
    dense = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), fill)
    return df.withColumn(out, F.when(F.size(bins) > 0, dense).otherwise(F.array().cast("array<int>"))).drop(*t.values())


def packed(codes: Column) -> Column:
    """Hexadecimal string of the codes, two digits each."""
    return F.array_join(F.transform(codes, lambda v: F.lpad(F.lower(F.hex(v)), 2, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two code arrays: the share of equal codes less what chance gives to bytes, 0 at least.

    Two empty texts are alike (1), an empty one and another are not (0).
    """
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda acc, x: acc + x) / F.lit(float(BINS))
    chance = 1 / 256
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance))))


def _longs(values: list[int]) -> Column:
    """An array that Spark folds into one literal before any row is read."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') AS array<bigint>)") if values else F.array().cast("array<bigint>")


def chunks(docs: DataFrame, rows: int) -> Column:
    """Number of the range of (doc_id, h) that a document is in, rising as doc_id falls, then as the hash of the text ``h`` falls; ranges have about ``rows`` documents.

    Borders are quantiles of the ids, ``RANGES`` at most, so ids that are far from all others do not widen the rest. Each range is then cut evenly between the least and the
    greatest id that it has, as its count asks for; the range of one id that very many rows share is cut by their hashes. Ids are
    subtracted as decimals. Only the borders and the ranges' counts reach the driver.
    """
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL")
    n, pieces = docs.count(), min(RANGES, max(1, ids.count() // rows))
    found = ids.agg(F.percentile_approx("doc_id", [i / pieces for i in range(1, pieces)], 10 * RANGES)).first()[0] if pieces > 1 else None
    found = found or []
    borders = sorted({*found, *(a + 1 for a, b in zip(found, found[1:]) if a == b and a < (1 << 63) - 1)})  # an id that is several quantiles is a range of its own
    step = max(1, int(len(borders) ** 0.5))
    blocks = _longs(borders[step - 1::step])

    def part_of(coarse: Column) -> Column:
        """The part of an id that ``coarse`` blocks of borders lie below."""
        inner = F.size(F.filter(F.slice(_longs(borders), coarse * step + 1, step), lambda b: b <= F.col("doc_id"))) if borders else F.lit(0)
        return (F.lit(len(borders)) - coarse * step - inner).cast("bigint")

    def once(value: Column, then) -> Column:
        """``then`` of a value that is found once for each row, however often ``then`` names it."""
        return F.get(F.transform(F.array(value), then), F.lit(0))
    part = once(F.size(F.filter(blocks, lambda b: b <= F.col("doc_id"))), part_of)
    held = {r["part"]: r for r in ids.groupBy(part.alias("part")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).collect()}
    of = range(len(borders) + 1)
    lows, highs, counts = (_longs([v(held[k]) if k in held else 0 for k in of]) for v in (lambda r: r["low"], lambda r: r["high"], lambda r: -(-r["n"] // rows)))
    wide, h = F.lit(str(1 << 63)).cast("decimal(20,0)"), F.col("h").cast("decimal(20,0)")

    def numbered(part: Column) -> Column:
        low, high, cuts = (F.get(x, part.cast("int")).cast("decimal(20,0)") for x in (lows, highs, counts))
        below = F.when(low == high, wide - 1 - h).otherwise(high - F.col("doc_id").cast("decimal(20,0)"))
        size = F.when(low == high, wide * 2).otherwise(high - low + 1)
        inside = F.floor(below.cast("decimal(21,0)") * cuts.cast("decimal(12,0)") / size.cast("decimal(21,0)")).cast("bigint")
        return part * F.lit(1 << 40) + inside
    nulls = F.lit(1 << 60) - F.floor(F.col("h") / F.lit(((1 << 63) - 1) // max(1, -(-n // rows))))
    return F.when(F.col("doc_id").isNull(), nulls).otherwise(once(part, numbered))


def with_next(docs: DataFrame, prepare, carried: list[str], rows: int = ROWS) -> DataFrame:
    """(doc_id, text, carried, next_text, next_<carried>): each document beside the next in descending order of doc_id, the last beside the first.

    Ids are cut into ranges of about ``rows`` documents (see ``chunks``). Each range gets a copy of the first document of the range after it, so
    the next document is found inside the range and texts move once. Only the table of ranges, one row for ``rows``
    documents and without texts, is ordered as a whole. Documents without id come last, in order of a hash of the text,
    as do ties.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ranged = own.withColumn("chunk", chunks(docs, rows))
    heads = ranged.groupBy("chunk").agg(F.max_by("h", F.struct("doc_id", "h")).alias("head_h"), F.max("doc_id").alias("head_id"))
    order = Window.orderBy("chunk")
    before = F.coalesce(F.lag("chunk").over(order), F.max("chunk").over(Window.partitionBy()))
    heads = stored(heads.select("head_id", "head_h", before.alias("before")), "range-heads")
    met = ranged.join(heads, F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h")), "left")
    ready = prepare(met.drop("head_id", "head_h"))
    both = ready.withColumn("place", F.explode(F.filter(F.array(F.struct(F.lit(False).alias("copy"), F.col("chunk").alias("chunk")),
                                                                F.struct(F.lit(True).alias("copy"), F.col("before").alias("chunk"))),
                                                        lambda p: p["chunk"].isNotNull())))
    both = both.select("doc_id", "text", "h", *carried, F.col("place.copy").alias("copy"), F.col("place.chunk").alias("chunk"))
    w = Window.partitionBy("chunk").orderBy("copy", F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    return both.select("doc_id", "text", *carried, "copy", F.lead("text").over(w).alias("next_text"),
                       *[F.lead(c).over(w).alias(f"next_{c}") for c in carried]).filter(~F.col("copy")).drop("copy")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many of the next
    document. Null texts are empty; an empty text has an empty fingerprint. A table of one document is its own next.
    Equal texts have equal fingerprints; repeated rows are documents of their own. Other columns are not read; an
    empty table gives no rows.
    """
    df = with_next(docs, lambda d: with_codes(d, "text", "codes"), ["codes"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    df = df.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(
        F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    df = with_codes(df.drop("text", "next_text"), "edited", "edited_codes")
    return df.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), packed(F.col("codes")).alias("fingerprint"),
                     packed(F.col("edited_codes")).alias("edited_fingerprint"), likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"),
                     likeness(F.col("codes"), F.col("next_codes")).alias("near_next"))


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(read(spark, sf_dir, "documents"))
