"""Mixing sources to target weights, with DataFrame functions only.

1. Documents of a source are laid end to end, in an order by chunks of a hash of their ids; the stream of words is cut
   into blocks of BLOCK_WORDS words. The positions are two-level prefix sums, so a source with a third of all rows is
   spread over as many tasks as it needs.
2. A source's target is its weight's share of all words to take, at most MOST times its size; what is above goes to the
   others by weight. A target is so many slots, of one block each.
3. Slots come in output shards of SHARD_SLOTS. Each slot of a shard draws a source with the sources' shares as chances, so a
   shard's counts are a multinomial draw. A draw is a place on the line of all targets; the line is cut into BINS, so that a
   draw meets the few sources of its bin. Slots beyond a source's target are left out, missing ones make up one last shard.
4. A source's slot j takes block perm(j mod blocks) of epoch j div blocks. perm is a swap-or-not shuffle: a pseudorandom
   permutation of 0 .. blocks-1, for each source and epoch, that needs no table. So each block is taken equally often, but
   for one. Blocks and the documents in them are joined by index: by the block where the mix's order counts, by pages of
   PAGE_BLOCKS blocks, with a bit for each block that an epoch takes, where only what is taken does.

Defined cases: null text has size 0 and is taken 0 times; null source is a source of its own, last in order; rows that
share a doc_id are documents of their own in the mix of blocks; an empty table, or one without words, gives an empty mix;
other columns are ignored, whatever their names. Draws depend on ids, sources, sizes and SEED alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, Scratch, row_key, sent_if_small, text_or_empty, word_count

#: Words of a block, slots of an output shard, documents of a chunk (about), rounds of the shuffle, bins of the line of targets.
BLOCK_WORDS, SHARD_SLOTS, CHUNK_DOCS, ROUNDS, BINS = 32, 16_384, 2_048, 10, 1_024
#: Blocks of a page, the bits of a long: 2 to the power PAGE_POWER.
PAGE_BLOCKS, PAGE_POWER = 64, 6
SEED, LAST_SHARD = 20_240_601, (1 << 62)
#: Weights of the sources in order, repeating; words to take, and words of a source to take at most, by its size.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes: (source, source_size), a row a source. Adds sid (order by code point, null last) and target."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("sid", (F.row_number().over(order) - 1).cast("int")).withColumn("weight", F.element_at(cycle, F.col("sid") % len(weights) + 1))
    # A source is at its limit if those with less room for their weight, and it itself, are: so one pass in that order is enough.
    every = Window.partitionBy()
    before = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), "sid").rowsBetween(Window.unboundedPreceding, -1)
    limit = F.col("source_size") * most
    all_words, all_weight = F.sum("source_size").over(every) * share, F.sum("weight").over(every)
    rest = all_words - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    level = rest / (all_weight - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    shares = ranked.withColumn("limit", limit).withColumn("level", level)
    # The first source that is not at its limit sets the level of all that follow.
    free = shares.withColumn("free", F.col("weight") * F.col("level") < F.col("limit"))
    set_by = F.min(F.when(F.col("free"), F.struct((F.col("source_size") / F.col("weight")).alias("room"), "sid", "level"))).over(every)["level"]
    target = F.when(F.col("weight") * set_by < F.col("limit"), F.col("weight") * set_by).otherwise(F.col("limit"))
    return free.withColumn("target", F.coalesce(target, F.col("limit"))).select("source", "source_size", "sid", "target")


def shuffled(x: Column, n: Column, *seeds: Column) -> Column:
    """Swap-or-not: the place of x under a permutation of 0 .. n-1 that the seeds choose."""

    def swap(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*seeds, r), n) - at, n)
        return F.when(F.xxhash64(*seeds, r + 1000, F.greatest(at, partner)) % 2 == 0, partner).otherwise(at)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), x, swap)


class Mix:
    """The parts of one mix. documents: doc_id, source, sid, size, source_size, target, start (place in the stream).

    key: a column of docs (a struct of two longs) that documents keep and that orders rows with one doc_id; else a hash of
    the text does."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, key: str | None = None):
        self.keys = keys = [key or "__text_hash"]
        docs = docs if key else docs.withColumn("__text_hash", F.xxhash64(text_or_empty()))
        self.scratch = Scratch(docs.sparkSession, "source_mix")
        sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text_or_empty()).alias("size"), *keys)
        sized = self.scratch.table(sized, "sized")
        chunks = max(1, sized.count() // CHUNK_DOCS)
        targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
        blocks = F.ceil(F.col("source_size") / BLOCK_WORDS)
        slots = F.round(F.col("target") / F.col("source_size") * F.col("blocks")).cast("long")
        self.sources = self.scratch.table(targets.withColumn("blocks", blocks).withColumn("slots", F.when(F.col("blocks") > 0, slots).otherwise(F.lit(0).cast("long"))), "sources")

        known = sized.join(self.sources.select(F.col("source").alias("s"), "sid", "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        known = known.withColumn("chunk", F.pmod(F.xxhash64("doc_id", *[F.when(F.col("doc_id").isNull(), F.col(k)) for k in keys]), F.lit(chunks)))
        sums = known.groupBy("sid", "chunk").agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        bases = sums.select("sid", "chunk", F.coalesce(F.sum("words").over(upto), F.lit(0).cast("long")).alias("base"))
        within = Window.partitionBy("sid", "chunk").orderBy("doc_id", "size", *keys).rowsBetween(Window.unboundedPreceding, -1)
        placed = known.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0).cast("long"))).join(bases, ["sid", "chunk"])
        self.documents = self.scratch.table(placed.withColumn("start", F.col("base") + F.col("within")).drop("base", "within", "chunk"), "documents")
        self.scratch.drop("sized")

    def drawn(self) -> DataFrame:
        """shard, sid, count: how many of a shard's slots drew a source."""
        upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        line = self.sources.filter("slots > 0").select("sid", (F.sum("slots").over(upto) - F.col("slots")).alias("low"), F.sum("slots").over(upto).alias("high"))
        total = line.agg(F.max("high").alias("total")).filter("total > 0").withColumn("bin_slots", F.ceil(F.col("total") / BINS))
        in_bin = lambda place: F.floor(F.col(place) / F.col("bin_slots")).cast("long")
        bins = line.crossJoin(total).withColumn("last", F.col("high") - 1).select("sid", "low", "high", F.explode(F.sequence(in_bin("low"), in_bin("last"))).alias("bin"))  # total: one row
        shards = total.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("total") / SHARD_SLOTS) - 1)))
        tasks = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        size = F.least(F.lit(SHARD_SLOTS).cast("long"), F.col("total") - F.col("shard") * SHARD_SLOTS)
        draws = shards.repartition(tasks, "shard").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), size)))
        draws = draws.withColumn("place", F.pmod(F.xxhash64(F.lit(SEED), F.lit("draw"), "shard", "i"), "total"))
        # The draws are many more than Spark expects, whom a sequence says nothing: they must not be the side that is sent.
        draws = draws.withColumn("bin", in_bin("place")).select("shard", "place", "bin").hint("merge")
        met = draws.join(sent_if_small(bins), "bin").filter("place >= low and place < high")
        return met.groupBy("shard", "sid").agg(F.count("*").alias("count"))

    def slots(self) -> DataFrame:
        """The mix: shard, slot (order in the shard), sid, epoch, block; a row a slot."""
        counts = self.drawn()
        before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0).cast("long"))).join(self.sources.select("sid", "slots", "blocks"), "sid")
        counts = counts.withColumn("count", F.greatest(F.lit(0).cast("long"), F.least("count", F.col("slots") - F.col("first")))).filter("count > 0")
        got = counts.groupBy(F.col("sid").alias("of")).agg(F.sum("count").alias("got"))
        have = F.coalesce("got", F.lit(0).cast("long"))
        missing = self.sources.join(got, F.col("sid") == F.col("of"), "left").filter(have < F.col("slots"))
        last = missing.select("sid", "blocks", F.lit(LAST_SHARD).alias("shard"), have.alias("first"), (F.col("slots") - have).alias("count"))
        runs = counts.select("sid", "blocks", "shard", "first", "count").unionByName(last)
        # A run of a shard's slots of one source holds SHARD_SLOTS at most, but for the last shard's. The few rows of runs become
        # all slots of the mix: they are dealt out first, to a fixed number of tasks.
        tasks = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        slots = runs.repartition(tasks, "sid", "shard").withColumn("j", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)))
        slots = slots.withColumn("epoch", F.floor(F.col("j") / F.col("blocks")))
        block = shuffled(F.col("j") % F.col("blocks"), F.col("blocks"), F.lit(SEED), F.col("sid"), F.col("epoch"))
        block = F.coalesce(block, F.lit(0).cast("long"))  # never null, but else Spark shuffles twice: once to see that
        return slots.select("shard", F.xxhash64(F.lit(SEED), "sid", "j").alias("slot"), "sid", "epoch", block.alias("block"))

    def pieces(self) -> DataFrame:
        """The mix with what its blocks hold: shard, slot, sid, epoch, block, doc_id, start, size, first (word), words, and the key."""
        length = F.lit(BLOCK_WORDS).cast("long")
        held = self.documents.filter("size > 0").select("sid", "doc_id", "start", "size", *self.keys)
        end = F.col("start") + F.col("size")
        held = held.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((end - 1) / length))))
        first = F.greatest(F.lit(0).cast("long"), F.col("block") * length - F.col("start"))
        held = held.withColumn("first", first).withColumn("words", F.least(F.col("size"), (F.col("block") + 1) * length - F.col("start")) - F.col("first"))
        # Both sides are larger than their plans' estimates, which don't know how many rows a sequence gives: no broadcast.
        return self.slots().hint("merge").join(held.hint("merge"), ["sid", "block"])

    def taken(self) -> DataFrame:
        """What each epoch takes of a document, by pages: sid, epoch, page, bits (of the blocks that are taken), doc_id, start,
        size, words, and the key; no row for a page of which the epoch takes nothing that the document holds.

        These are the pieces, put together before they are joined: a row stands for PAGE_BLOCKS blocks."""
        pages = F.lit(PAGE_BLOCKS).cast("long")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("block") % pages).cast("int"))
        drawn = self.slots().groupBy("sid", F.shiftright("block", PAGE_POWER).alias("page"), "epoch").agg(F.bit_or(bit).alias("drawn"))
        low, high = held_blocks()
        held = self.documents.filter("size > 0").select("sid", "doc_id", "start", "size", *self.keys)
        held = held.withColumn("page", F.explode(F.sequence(F.shiftright(low, PAGE_POWER), F.shiftright(high, PAGE_POWER))))
        # The bits from first to last: all ones, shifted right until as many are left, and left to their place.
        first, last = (F.greatest(low, F.col("page") * pages) % pages).cast("int"), (F.least(high, F.col("page") * pages + pages - 1) % pages).cast("int")
        own = F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), F.lit(PAGE_BLOCKS - 1) - last + first), first)
        met = drawn.hint("merge").join(held.hint("merge"), ["sid", "page"]).withColumn("bits", F.col("drawn").bitwiseAND(own)).filter("bits <> 0").drop("drawn")
        length = F.lit(BLOCK_WORDS).cast("long")
        takes = lambda block: (F.shiftright(block, PAGE_POWER) == F.col("page")) & (F.bit_get("bits", (block % pages).cast("int")) == 1)
        # Blocks at both ends hold words of other documents as well.
        before = F.when(takes(low), F.col("start") - low * length).otherwise(F.lit(0))
        after = F.when(takes(high), (high + 1) * length - F.col("start") - F.col("size")).otherwise(F.lit(0))
        return met.withColumn("words", F.bit_count("bits") * length - before - after)


def held_blocks() -> tuple[Column, Column]:
    """The first and the last block of a document of one word or more, by its start and size."""
    length = F.lit(BLOCK_WORDS).cast("long")
    return F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("size") - 1) / length)


def runs_of(pages: str) -> Column:
    """(first, words) of the blocks that an array of structs (page, bits) names, in order, of a document with start and size."""
    length, every = F.lit(BLOCK_WORDS).cast("long"), F.lit(PAGE_BLOCKS).cast("long")
    low, high = held_blocks()

    def run(block: Column) -> Column:
        first = F.greatest(F.lit(0).cast("long"), block * length - F.col("start"))
        return F.struct(first.alias("first"), (F.least(F.col("size"), (block + 1) * length - F.col("start")) - first).alias("words"))

    def of_page(p: Column) -> Column:
        blocks = F.sequence(F.greatest(low, p["page"] * every), F.least(high, p["page"] * every + every - 1))
        return F.transform(F.filter(blocks, lambda b: F.bit_get(p["bits"], (b % every).cast("int")) == 1), run)

    return F.flatten(F.transform(F.array_sort(pages), of_page))


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of docs."""
    mix = Mix(docs)
    taken = mix.taken().groupBy("sid", "start").agg(F.sum("words").alias("taken"))
    rows = mix.documents.withColumn("key", F.when(F.col("size") > 0, F.col("start")))
    found = rows.join(taken.select(F.col("sid").alias("s"), F.col("start").alias("key2"), "taken"), (F.col("sid") == F.col("s")) & (F.col("key") == F.col("key2")), "left")
    return found.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents with the columns of docs: a row for each epoch in which a document is taken.

    An epoch that takes all of a document's blocks gives its whole text, another one the words that are taken, in order.
    Every row is a document of its own, whatever its doc_id, if it has one; rows without words are not in the mix."""
    keyed = docs.withColumn("__key", row_key(docs))
    mix = Mix(keyed, key="__key")
    runs = mix.taken().groupBy("__key", "sid", "start", "size", "epoch").agg(F.sum("words").alias("__taken"), F.collect_list(F.struct("page", "bits")).alias("pages"))
    runs = runs.select(F.col("__key.a").alias("__of_a"), F.col("__key.b").alias("__of_b"), F.when(F.col("__taken") < F.col("size"), runs_of("pages")).alias("__runs"))
    # Whole copies of a row share its key, and have a run each: one of them is joined with all of their runs. By the key's two
    # numbers: a struct that went through a table has another type, and Spark would shuffle the texts again to cast it.
    rows = keyed.withColumns({"__a": F.col("__key.a"), "__b": F.col("__key.b")}).dropDuplicates(["__a", "__b"])
    taken = rows.join(runs, (rows["__a"] == runs["__of_a"]) & (rows["__b"] == runs["__of_b"]))
    words = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[^{SPACES}]+[{SPACES}]*"), F.lit(0))
    cut = F.aggregate(
        F.col("__runs"),
        F.struct(F.lit("").alias("text"), words.alias("words")),
        lambda acc, r: F.struct(F.concat(acc["text"], F.array_join(F.slice(acc["words"], (r["first"] + 1).cast("int"), r["words"].cast("int")), "")).alias("text"), acc["words"].alias("words")),
        lambda acc: F.rtrim(acc["text"]),
    )
    taken = taken.withColumn("text", F.when(F.col("__runs").isNull(), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        taken = taken.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return taken.select(*docs.columns)
