"""Mixing sources to target weights with DataFrame operations only.

Each source's words, in document order, form a stream packed into blocks of fixed length.
Output shards draw multinomial source counts slot by slot; a source's slots, numbered across
shards, run through a pseudorandom permutation of its block indices (a Feistel network, keyed
by source and epoch); blocks are then joined by (source, index).  Draws beyond a source's quota go to the sources
whose draws fell short, so that totals meet the targets to within a block.

A source may hold any share of the rows: positions come from sums per (source, bucket), and
every join has the block index or the bucket in its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticeflow.llm.common import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
BLOCK_WORDS = 128
SHARD_SLOTS = 4096
BUCKET_ROWS = 16384
CELLS = 4096
ROUNDS = 4
WALK = 64


def permuted(i: str, n: str, key: str) -> str:
    """SQL of a keyed pseudorandom permutation of ``0 .. n - 1`` at ``i``.

    A Feistel network over pairs ``(l, r)`` of a grid of ``a * b >= n`` cells, whose halves
    are added to in turn; it is one to one on the grid.  A place beyond ``n`` is walked on
    from until one within is met, which keeps it one to one on ``0 .. n - 1``.  The grid has
    less than ``a`` places beyond, a share of ``1 / sqrt(n)`` at most, and a walk ends with
    their number.
    """
    a, b = f"cast(ceil(sqrt({n})) as bigint)", f"cast(ceil({n} / ceil(sqrt({n}))) as bigint)"
    left = "(t.l + pmod(xxhash64(t.r, g.key, k), g.a)) % g.a"
    turn = f"transform(array({left}), l -> struct(l as l, (t.r + pmod(xxhash64(l, g.key, -k), g.b)) % g.b as r))[0]"
    step = f"aggregate(sequence(1, {ROUNDS}), struct(x div g.b as l, x % g.b as r), (t, k) -> {turn}, t -> t.l * g.b + t.r)"
    walk = f"aggregate(sequence(1, {WALK}), {step.replace('x div', 'g.i div').replace('x % ', 'g.i % ')}, (x, j) -> if(x < g.n, x, {step}))"
    return f"transform(array(struct({a} as a, {b} as b, {n} as n, {i} as i, {key} as key)), g -> {walk})[0]"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``(source, s, source_size, target)`` from ``(source, source_size)``, a row per source.

    Sources by code point, null last, take the weights in turn.  Shares of all words by
    weight stop at ``most`` times a source's size and the excess is shared again by weight:
    with sources in the order of ``most * size / weight``, the first k are at their limit,
    for the smallest k at which nobody else exceeds theirs.
    """
    ranked = sizes.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("s") % len(weights) + 1).cast("int")))
    limited = weighed.withColumn("top", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("top") / F.col("w"))
    order = Window.orderBy("ratio", "s")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    levelled = limited.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("ratio"))
    settled = F.min(F.when(F.col("fits"), F.struct("ratio", "s", "level"))).over(everything)
    return levelled.withColumn("at", settled).select(
        "source", "s", "source_size", F.least(F.col("top"), F.coalesce(F.col("at.level"), F.lit(0.0)) * F.col("w")).alias("target")
    )


def _placed(documents: DataFrame, weights: tuple[int, ...], block: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in their source's stream, and the sources with their quotas."""
    buckets = documents.count() // BUCKET_ROWS + 1
    sized = staged(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.expr(f"cast(regexp_count(cast(text as string), r'{WORD}') as long)"), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string")).alias("row"),
        ).withColumn("bucket", F.pmod("row", F.lit(buckets))),
        "sizes",
    )
    n = F.ceil(F.col("source_size") / block)
    quota = (
        source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
        .withColumn("words", F.round("target").cast("long"))
        .withColumn("n", n.cast("long"))
        .withColumn("full", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("over", F.col("words") - F.col("full") * F.col("source_size"))
        .withColumn("cut", F.col("over") % block)
        .withColumn("slots", F.col("full") * F.col("n") + F.expr(f"over div {block}") + (F.col("cut") > 0).cast("long"))
    )
    sources = staged(quota, "quota")
    keyed = sized.join(sources.select(F.col("source").alias("src"), "s"), F.col("source").eqNullSafe(F.col("src"))).drop("src")
    sums = keyed.groupBy("s", "bucket").agg(F.sum("size").alias("sum"))
    before = sums.select("s", "bucket", (F.sum("sum").over(Window.partitionBy("s").orderBy("bucket")) - F.col("sum")).alias("before"))
    run = Window.partitionBy("s", "bucket").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = keyed.withColumn("inside", F.sum("size").over(run) - F.col("size"))
    placed = inside.join(before, ["s", "bucket"]).select("doc_id", "row", "s", "size", (F.col("inside") + F.col("before")).alias("start"))
    return staged(placed, "placed"), sources


def _slots(sources: DataFrame, total: int, block: int, seed: int) -> DataFrame:
    """``(shard, slot, s, epoch, index, words)``: what each slot of the output takes."""
    spark = sources.sparkSession
    cell = max(1, -(-total // CELLS))
    bounds = sources.where("slots > 0").withColumn("high", F.sum("slots").over(Window.orderBy("s"))).withColumn("low", F.col("high") - F.col("slots"))
    cells = bounds.select("s", "low", "high", F.explode(F.sequence(F.expr(f"low div {cell}"), F.expr(f"(high - 1) div {cell}"))).alias("cell"))
    drawn = (
        spark.range(total)
        .select(F.col("id").alias("slot"), F.expr(f"id div {SHARD_SLOTS}").alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total)).alias("at"))
        .withColumn("cell", F.expr(f"at div {cell}"))
        .join(cells, "cell")
        .where("at >= low and at < high")
        .select("shard", "slot", "s")
    )
    counts = drawn.groupBy("s", "shard").agg(F.count("*").alias("c"))
    before = counts.select("s", "shard", (F.sum("c").over(Window.partitionBy("s").orderBy("shard")) - F.col("c")).alias("before"))
    numbered = drawn.withColumn("k", F.row_number().over(Window.partitionBy("s", "shard").orderBy("slot")) - 1).join(before, ["s", "shard"]).withColumn("j", F.col("k") + F.col("before"))
    got = counts.groupBy("s").agg(F.sum("c").alias("got"))
    balance = (
        sources.where("slots > 0").select("s", "slots").join(got, "s", "left").withColumn("got", F.coalesce("got", F.lit(0)))
        .withColumn("more", F.greatest(F.col("got") - F.col("slots"), F.lit(0)))
        .withColumn("less", F.greatest(F.col("slots") - F.col("got"), F.lit(0)))
        .withColumn("more_before", F.sum("more").over(Window.orderBy("s")) - F.col("more"))
        .withColumn("less_before", F.sum("less").over(Window.orderBy("s")) - F.col("less"))
    )
    marked = numbered.join(balance.select("s", "slots", "more_before"), "s")
    own = marked.where("j < slots").select("shard", "slot", "s", "j")
    surplus = marked.where("j >= slots").select("shard", "slot", (F.col("j") - F.col("slots") + F.col("more_before")).alias("g"))
    wanting = balance.where("less > 0").select("s", "got", "less_before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("less") - 1)).alias("k"))
    given = surplus.join(wanting.select((F.col("less_before") + F.col("k")).alias("g"), "s", (F.col("got") + F.col("k")).alias("j")), "g").select("shard", "slot", "s", "j")
    known = own.unionByName(given).join(sources.select("s", "n", "slots", "cut", "source_size"), "s")
    epoch = known.withColumn("epoch", F.expr("j div n")).withColumn("i", F.col("j") % F.col("n"))
    index = F.expr(permuted("i", "n", f"xxhash64(s, epoch, {seed})"))
    whole = F.least(F.lit(block), F.col("source_size") - F.col("index") * block)
    last = (F.col("cut") > 0) & (F.col("j") == F.col("slots") - 1)
    return epoch.withColumn("index", index).select("shard", "slot", "s", "epoch", "index", F.when(last, F.least(whole, F.col("cut"))).otherwise(whole).alias("words"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK_WORDS, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(placed documents, sources, slots)`` of a mix of the size of all words.

    ``documents`` needs ``doc_id``, ``text`` and ``source``; other columns are not read.  A
    null source is one of the sources, a null or blank text has size 0 and is never taken,
    null or repeated doc_ids keep their rows.  Equal input gives equal output, however it
    is partitioned; an empty table gives no rows.
    """
    placed, sources = _placed(documents, weights, block)
    total = sources.agg(F.sum("slots")).first()[0] or 0
    slots = _slots(sources, total, block, seed)
    return placed, sources, slots


def pieces_taken(placed: DataFrame, slots: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, row, s, start, size, epoch, first, last, uses)``: words ``first .. last - 1`` of a document that the mix takes."""
    uses = slots.groupBy("s", "index", "epoch", "words").agg(F.count("*").alias("uses"))
    spans = placed.where("size > 0").select("*", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("index"))
    return (
        spans.join(uses, ["s", "index"])
        .withColumn("first", F.greatest(F.col("start"), F.col("index") * block) - F.col("start"))
        .withColumn("last", F.least(F.col("start") + F.col("size"), F.col("index") * block + F.col("words")) - F.col("start"))
        .where("last > first")
        .select("doc_id", "row", "s", "start", "size", "epoch", "first", "last", "uses")
    )


def taken_words(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``, a row per document; see :func:`mix`."""
    placed, sources, slots = mix(documents, weights, block, seed)
    taken = pieces_taken(placed, slots, block).groupBy("s", "start").agg(F.sum((F.col("last") - F.col("first")) * F.col("uses")).alias("taken"))
    some = placed.where("size > 0").join(taken, ["s", "start"], "left").select("doc_id", "s", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    none = placed.where("size = 0").select("doc_id", "s", "size", F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none).join(sources.select("s", "source_size", "target"), "s").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """The mix as documents: a row per document and epoch it is taken in, with the columns of ``documents``.

    A text that an epoch takes in part keeps the words taken, each with the white space
    after it; ``n_chars``, if there, counts what is left.  Identical rows stand for each other.
    """
    placed, _, slots = mix(documents, weights, block, seed)
    parts = pieces_taken(placed, slots, block).groupBy("row", "s", "start", "size", "epoch").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("parts"))
    rows = documents.withColumn("__row", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"))).dropDuplicates(["__row"])
    words = rows.join(parts.select(F.col("row").alias("__row"), F.col("size").alias("__size"), F.col("parts").alias("__parts")), "__row")
    covered = F.aggregate("__parts", F.lit(0).cast("long"), lambda t, p: t + p["last"] - p["first"])
    cut = F.expr(
        f"array_join(flatten(transform(__parts, p -> slice(regexp_extract_all(cast(text as string), r'{WORD}[\\x20\\x09-\\x0D]*', 0), cast(p.first + 1 as int), cast(p.last - p.first as int)))), '')"
    )
    out = words.withColumn("text", F.when(covered >= F.col("__size"), F.col("text").cast("string")).otherwise(cut))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*documents.columns)
