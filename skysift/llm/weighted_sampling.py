"""Document fingerprints by consistent weighted sampling, in built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.session import cut

#: Samples of a fingerprint: GROUPS rows of WIDTH each.
GROUPS, WIDTH = 8, 4
#: Chunks of neighbouring documents for each shuffle partition.
CHUNKS = 4
EMPTY = "f" * 8 * GROUPS * WIDTH


def draws(term: Column, group: Column, i: int) -> dict[str, Column]:
    """What a term draws for one sample by hash: r and c from Gamma(2, 1), of c the logarithm, and b uniform."""
    one = F.xxhash64(term, group, F.lit(i))
    two = F.xxhash64(one, F.lit(i))

    def part(h: Column, shift: int, bits: int) -> Column:
        cut_off = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1))
        return (cut_off.cast("double") + 0.5) * 2.0**-bits

    return {
        f"_r{i}": -F.log(part(one, 0, 21) * part(one, 21, 21)),
        f"_b{i}": part(one, 42, 21),
        f"_c{i}": F.log(-F.log(part(two, 0, 32) * part(two, 32, 32))),
    }


def sample(log_weight: Column, i: int) -> Column:
    """Log of the gamma-based sample of a weighted term; the least over a document's terms is its sample.

    t = floor(ln(weight) / r + b) and the sample is ln(c) - r (t - b + 1). It depends on the weight by t only, so two
    documents have the same least sample exactly if they choose the same term and t, of which the probability is their
    generalised Jaccard similarity. Null without a weight.
    """
    r, b, c = (F.col(f"_{name}{i}") for name in "rbc")
    return c - r * (F.floor(log_weight / r + b) - b + 1)


def words(text: Column) -> Column:
    """Words between white space with A-Z lower-cased, each byte as a Latin-1 character, and perhaps empty ones; lower-casing these keeps different words apart."""
    return F.split(F.lower(F.decode(text.cast("binary"), "ISO-8859-1")), "[ \\t-\\r]+")


def signatures(texts: DataFrame, keys: list[str], text_cols: tuple[str, str]) -> DataFrame:
    """``keys`` and one string ``fp_<column>`` for each of two text columns, eight hex digits a sample; no row where neither text has a word.

    Terms are words between white space with A-Z lower-cased, weighted by how often they occur in each text. They are counted per row
    before samples are drawn; a term of both texts draws once. Least samples are kept up in the map-side sums, two of them
    packed into a long. The keys must tell rows apart; where ``texts`` is dealt by one of them nothing is shuffled.
    """
    split = texts.select(*keys, F.posexplode(F.array(*(words(F.col(c)) for c in text_cols))).alias("_text", "_words"))
    terms = split.select(*keys, "_text", F.explode("_words").alias("_word")).where("_word <> ''").select(*keys, "_text", F.xxhash64("_word").alias("_term"))
    counted = terms.groupBy(*keys, "_term").agg(F.sum(1 - F.col("_text")).alias("_n0"), F.sum("_text").alias("_n1"))
    weighted = counted.select(*keys, "_term", *(F.when(F.col(f"_n{k}") > 0, F.log(F.col(f"_n{k}").cast("double"))).alias(f"_log{k}") for k in range(2)))
    spread = weighted.select(*keys, "_term", "_log0", "_log1", F.explode(F.array(*(F.lit(g) for g in range(GROUPS)))).alias("_group"))
    drawn = spread.select(*keys, "_group", "_log0", "_log1", *(c.alias(name) for i in range(WIDTH) for name, c in draws(F.col("_term"), F.col("_group"), i).items()))
    least = drawn.groupBy(*keys, "_group").agg(*(F.min(sample(F.col(f"_log{k}"), i)).alias(f"_a{k}_{i}") for k in range(2) for i in range(WIDTH)))
    low = F.lit(0xFFFFFFFF)

    def packed(k: int, i: int) -> Column:
        one, two = (F.xxhash64(f"_a{k}_{j}").bitwiseAND(low) for j in (i, i + 1))
        return F.when(F.col(f"_a{k}_{i}").isNotNull(), F.shiftleft(one, 32).bitwiseOR(two))

    longs = least.select(*keys, "_group", *(packed(k, i).alias(f"_p{k}_{i}") for k in range(2) for i in range(0, WIDTH, 2)))
    names = [(k, g, i) for k in range(2) for g in range(GROUPS) for i in range(0, WIDTH, 2)]
    whole = longs.groupBy(*keys).agg(*(F.max(F.when(F.col("_group") == g, F.col(f"_p{k}_{i}"))).alias(f"_w{k}_{g}_{i}") for k, g, i in names))

    def written(k: int) -> Column:
        digits = F.concat(*(F.lpad(F.lower(F.hex(f"_w{k}_{g}_{i}")), 16, "0") for m, g, i in names if m == k))
        return F.coalesce(digits, F.lit(EMPTY))

    return whole.select(*keys, *(written(k).alias(f"fp_{c}") for k, c in enumerate(text_cols)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints, an estimate of their texts' generalised Jaccard similarity."""
    equal = [(F.substring(a, 1 + 8 * i, 8) == F.substring(b, 1 + 8 * i, 8)).cast("int") for i in range(GROUPS * WIDTH)]
    total = equal[0]
    for e in equal[1:]:
        total = total + e
    return total / float(GROUPS * WIDTH)


def among(value: Column, bounds: list) -> Column:
    """How many of the sorted bounds are not above the value, found in two steps of about the square root of their number."""
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[at : at + step] for at in range(0, len(bounds), step)]

    def below(found: Column) -> Column:
        return F.size(F.filter(found, lambda b: b <= value))

    first = below(F.array(*(F.lit(p[0]) for p in parts)))
    inside = F.get(F.array(*(F.array(*(F.lit(b) for b in p)) for p in parts)), first - 1)
    return F.when(first > 0, (first - 1) * step + below(inside)).when(first == 0, 0)


def in_chunks(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows in descending order of id, dealt into chunks of neighbours, with their place there; and each chunk's follower.

    Bounds are approximate quantiles of the ids, a few for each shuffle partition whatever the input's size; one shuffle deals the texts.
    Null ids come last. Rows of one id are in order of their texts' hashes. The second frame has, for each chunk, the
    chunk whose first row follows its last one: the next lower one that isn't empty, or the highest after the lowest.
    """
    spark = docs.sparkSession
    chunks = max(CHUNKS * int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    bounds = docs.agg(F.percentile_approx(id_col, [i / chunks for i in range(1, chunks)], 20 * chunks)).first()[0]
    bounds = sorted(set(bounds or []))
    chunk = F.coalesce(among(F.col(id_col), bounds), F.lit(-1)) if bounds else F.lit(-1)
    dealt = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), chunk.alias("_chunk"))
    order = Window.partitionBy("_chunk").orderBy(F.col(id_col).desc_nulls_last(), F.xxhash64("_text"))
    rows = dealt.withColumns({"_place": F.row_number().over(order), "_next": F.lead("_text").over(order)})
    full = sorted((r[0] for r in dealt.select("_chunk").distinct().collect()), reverse=True)
    follower = F.array(*(F.struct(F.lit(a).alias("_chunk"), F.lit(b).alias("_head_chunk")) for a, b in zip(full, [*full[1:], *full[:1]]))) if full else None
    pairs = spark.range(1).select(F.explode(follower).alias("x")).select("x.*") if full else spark.range(0).selectExpr("cast(id as int) as _chunk", "cast(id as int) as _head_chunk")
    return rows, pairs


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they are to each other and to the next document's.

    The edited text has the last third (rounded down) of the code points replaced by the first as many, or all, of the
    next document's; the next document is the one of the next smaller id, after the last one the first. One row per row of ``docs``,
    repeated rows included; a single document is its own next one. Null texts count as empty. Other columns are not looked at.
    """
    rows, pairs = in_chunks(docs, id_col, text_col)
    heads = pairs.join(rows.where("_place = 1").select(F.col("_chunk").alias("_head_chunk"), F.col("_text").alias("_head")), "_head_chunk").select("_chunk", "_head")
    k = F.floor(F.length("_text") / 3).cast("int")
    edited = F.concat(F.expr("substring(_text, 1, length(_text) - cast(floor(length(_text) / 3) as int))"), F.substring(F.coalesce("_next", "_head"), F.lit(1), k))
    both = rows.join(heads, "_chunk", "left").select(F.col(id_col).alias("_id"), "_chunk", "_place", "_text", edited.alias("_edited"))
    keys = ["_chunk", "_place"]
    meta = both.select(*keys, "_id", F.length("_text").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"))
    prints = meta.join(signatures(both, keys, ("_text", "_edited")), keys, "left")
    found = cut(prints.withColumns({c: F.coalesce(c, F.lit(EMPTY)) for c in ("fp__text", "fp__edited")}))
    order = Window.partitionBy("_chunk").orderBy("_place")
    head_prints = pairs.join(found.where("_place = 1").select(F.col("_chunk").alias("_head_chunk"), F.col("fp__text").alias("_head_fp")), "_head_chunk").select("_chunk", "_head_fp")
    next_print = F.coalesce(F.lead("fp__text").over(order), F.col("_head_fp"))
    return found.join(head_prints, "_chunk", "left").withColumn("_next_fp", next_print).select(
        F.col("_id").alias(id_col), "n_chars", "edited_sha256", F.col("fp__text").alias("fingerprint"), F.col("fp__edited").alias("edited_fingerprint"),
        likeness(F.col("fp__text"), F.col("fp__edited")).alias("near_edited"), likeness(F.col("fp__text"), F.col("_next_fp")).alias("near_next"),
    )
