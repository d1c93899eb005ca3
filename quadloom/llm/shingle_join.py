"""N-gram Jaccard join by parity sketches.

A document's set: the distinct n-word shingles of its words (ASCII letters lower-cased, split at ASCII white space); with
fewer words the whole sequence is the one shingle. Shingles are 64-bit hashes. Documents link when
den * |A and B| >= num * |A or B|. The result has each document's component under links.

1. Sketches. Sets of sizes a <= b that link differ in at most (den - num) (a + b) / (den + num) shingles. Within a band
   of sizes (a doubling) a set's sketch is an array of parity bits, one for each hash value, cut into S segments; XORing
   hashes gives each segment's fingerprint. Hamming distance between sketches is at most the symmetric difference d, so
   two linked sets agree in S - d segments or more. By pigeonhole it is enough to index the first d + 1 segments in one
   order that all sets share, and that order puts segments with few set bits, which tell little, last.
2. Pigeonhole join. Documents with the same set are one class; only classes go on. Classes that share a key (band,
   segment, fingerprint) are candidates. In each key every class is paired with the key's smallest one only, which
   costs as many pairs as rows, however large a group of near copies is.
3. Verification. Pairs pass the size ratio and a 1,024-bit sketch's Hamming bound, and are then verified on the sets.
4. Components, by rounds of large-star and small-star joins. What is left are pairs of one key whose classes are in
   different components: those are enumerated inside tasks in square blocks, filtered by the sketch, verified, and
   components are taken again. So no link between different components is lost, and none inside one is needed.

Classes have numbers of their own inside, so rows that share a doc_id but not the text are not mixed up.

Defined cases: null or wordless text has an empty set, links with nothing and is its own component; rows that share a
doc_id give one row each, with the component of their own text; rows with a null doc_id are left out; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, sent_if_small, text_or_empty
from .components import connected_components, merged_components

#: Bits of the sketch that filters candidates; rows of one side of a block of left-over pairs; words, and sets, that a task
#: remembers; rows whose sets are made at a time. Texts go to Python BATCH_ROWS at a time too: ten thousand of them would be
#: held by the JVM, by Arrow and as Python strings at once, in each of an executor's tasks.
SKETCH_BITS, BLOCK_ROWS, REMEMBERED, BATCH_ROWS = 1024, 1024, 100_000, 500
#: Bits of the map that spares keys which no two classes share the second shuffle. Past some tens of millions of shared keys
#: it lets most keys through, which costs that shuffle and loses nothing.
BITMAP_BITS = 1 << 26
U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and ASCII white space only
        if not words:
            return np.empty(0, dtype=U)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        try:
            hashes = [known[w] for w in words]
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            hashes = [known[w] for w in words]
        h = np.array(hashes, dtype=U)
        k = min(self.words, len(words))
        out = np.full(len(h) - k + 1, U(k))
        for i in range(k):
            out = _mixed(out * U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
        return np.unique(out)


def _band(n: int) -> int:
    return n.bit_length() - 1


def _segments(band: int, num: int, den: int) -> int:
    """Segments of a band's sketches: a quarter more than its largest possible distance needs."""
    most = (den - num) * 2 * ((2 << band) - 1) // (den + num)
    return (most + 1) * 5 // 4 + 1


def pigeonhole_keys(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of a set; two linked sets have one in common."""
    n = len(shingles)
    if not n:
        return np.empty(0, dtype=U)
    largest = n * den // num  # of a set that may link with this one
    keys = []
    for band in range(_band(n), _band(largest) + 1):
        s = _segments(band, num, den)
        partner = min(largest, (2 << band) - 1)
        differ = (den - num) * (n + partner) // (den + num)
        segment = (shingles >> U(20)) % U(s)
        order = np.argsort(segment, kind="stable")
        counts = np.bincount(segment.astype(np.int64), minlength=s)
        print_ = np.zeros(s, dtype=U)
        filled = np.flatnonzero(counts)
        starts = np.concatenate([[0], np.cumsum(counts)])[filled]
        print_[filled] = np.bitwise_xor.reduceat(_mixed(shingles[order] + U(band)), starts)
        key = _mixed(print_ + _mixed(np.arange(s, dtype=U) + U(band << 32)))
        keys.append(key[np.lexsort((key, -counts))[: differ + 1]])
    return np.unique(np.concatenate(keys))


def sketch(shingles: np.ndarray) -> bytes:
    bits = np.bincount((shingles % U(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def text_key():
    """A text's hash, of 96 bits."""
    return F.struct(F.xxhash64("text").alias("a"), F.hash("text").alias("b"))


def _with_sets(rows: DataFrame, words: int, make: Callable[[pd.DataFrame, list[np.ndarray]], pd.DataFrame], schema: str) -> DataFrame:
    """make(rows, the sets of their texts), a few hundred rows at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(words)
        for batch in batches:
            for i in range(0, len(batch), BATCH_ROWS):
                part = batch.iloc[i : i + BATCH_ROWS]
                yield make(part, [shingle(t) for t in part["text"]])

    return rows.mapInPandas(run, schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).filter("doc_id is not null")


def _set_hash(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _mark(set_hash: bytes) -> int:
    return int.from_bytes(set_hash[:8], "big", signed=True)


def signatures(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """doc_id, a, b (hashes of the text), n, set_hash, mark (a part of it), bits (the sketch), keys of every row with a doc_id.

    A task gives a set's keys about once: texts that repeat have none."""
    seen: set[int] = set()

    def sign(part: pd.DataFrame, sets: list[np.ndarray]) -> pd.DataFrame:
        hashes = [_set_hash(s) for s in sets]
        marks = [_mark(h) for h in hashes]
        if len(seen) > REMEMBERED:
            seen.clear()
        keys = []
        for s, m in zip(sets, marks, strict=True):
            keys.append(np.empty(0, dtype=np.int64) if m in seen else pigeonhole_keys(s, num, den).view(np.int64))
            seen.add(m)
        bits = [np.frombuffer(sketch(s), dtype=">i8").astype(np.int64) for s in sets]
        return pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "a": part["a"].to_numpy(), "b": part["b"].to_numpy(), "n": [len(s) for s in sets], "set_hash": hashes, "mark": marks, "bits": bits, "keys": keys})

    rows = _texts(docs).select("doc_id", "text", text_key().alias("key")).select("doc_id", "text", "key.a", "key.b")
    return _with_sets(rows, words, sign, "doc_id long, a long, b int, n long, set_hash binary, mark long, bits array<long>, keys array<long>")


def _in_map(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & U(BITMAP_BITS - 1)
    return (bitmap[(slot >> U(6)).astype(np.int64)] >> (slot & U(63))) & U(1) == 1


def _mapped_keys(signed: DataFrame, bitmap: Broadcast) -> DataFrame:
    """(key, mark) of the keys whose bit is set."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            key = np.concatenate([np.empty(0, dtype=np.int64), *batch["keys"]])
            of = np.repeat(batch["mark"].to_numpy(dtype=np.int64), batch["keys"].map(len).to_numpy(dtype=np.int64))
            mapped = _in_map(bitmap.value, key.view(U))
            yield pd.DataFrame({"key": key[mapped], "mark": of[mapped]})

    return signed.select("mark", "keys").mapInPandas(keys, "key long, mark long")


def _bitmap(hashes: DataFrame, name: str) -> Broadcast:
    """Bits of the hashes' low ends: of BITMAP_BITS, whatever their number. The driver gets a row for each 64 bits at most."""
    word = F.shiftrightunsigned(F.col(name).bitwiseAND(BITMAP_BITS - 1), 6).alias("word")
    rows = hashes.groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({name} & 63 as int))")).alias("bits")).toArrow()  # no Python object a row
    bits = np.zeros(BITMAP_BITS // 64, dtype=U)
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(U)
    return hashes.sparkSession.sparkContext.broadcast(bits)


def _distance(a: str, b: str):
    """Hamming distance of two sketches held as arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def _may_link(n1, n2, distance, num: int, den: int):
    return (F.least(n1, n2) * den >= F.greatest(n1, n2) * num) & (distance * (den + num) <= (n1 + n2) * (den - num))


class _Join:
    def __init__(self, docs: DataFrame, words: int, num: int, den: int):
        self.docs, self.words, self.num, self.den = docs, words, num, den
        self.scratch = Scratch(docs.sparkSession, "shingle_join")
        self.sets: DataFrame | None = None

    def run(self) -> DataFrame:
        """doc_id, a, b, set_hash, n_shingles, component_id, stands (is of the component's first class and id), one row per row with a doc_id."""
        scratch = self.scratch
        signed = self.signed = self.text_table(signatures(self.docs, self.words, self.num, self.den), "signed")
        # A class's number is its smallest doc_id; of classes that share it, the others have a hash.
        sets = signed.filter("n > 0").groupBy("set_hash").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("mark").alias("mark"), F.first("bits").alias("bits"))
        place = F.row_number().over(Window.partitionBy("first").orderBy("set_hash"))
        classes = self.classes = scratch.table(sets.withColumn("id", F.when(place == 1, F.col("first")).otherwise(F.xxhash64("first", "set_hash"))), "classes")

        # Nearly all keys belong to one class. Those that several share are found by an aggregation, combined before its
        # shuffle; only their rows, and few others, are shuffled again.
        marks = signed.select(F.explode("keys").alias("key"), "mark").groupBy("key").agg(F.min("mark").alias("low"), F.max("mark").alias("high"))
        shared = scratch.table(marks.filter("low <> high").select("key"), "shared")
        again = _mapped_keys(signed, _bitmap(shared, "key")).join(shared, "key", "left_semi").distinct()
        members = scratch.table(again.join(classes.select("mark", "id"), "mark").select("key", "id"), "members")
        sizes = members.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("size"))
        held = scratch.table(members.join(sizes, "key"), "held")  # the classes of keys that two or more share
        stars = held.filter("id <> first").groupBy("first", "id").agg(F.count("*").alias("common")).select(F.col("first").alias("a"), F.col("id").alias("b"), "common")
        near = scratch.table(self.filtered(stars, classes), "near")

        # Most of a component hangs together by each class's best pair; the others matter only where they join two components.
        best = near.groupBy("b").agg(F.min_by("a", F.struct("distance", "a")).alias("a")).select("a", "b")
        links = scratch.table(self.verified(best, near), "links1")
        parts = connected_components(links, scratch, "parts1")
        across = self.across(near.join(best, ["a", "b"], "left_anti").select("a", "b"), parts)
        parts = merged_components(parts, scratch.table(self.verified(across, near), "links2"), scratch, "parts2")
        left = scratch.table(self.left_over(held, classes, parts), "left")
        if not left.isEmpty():
            parts = merged_components(parts, scratch.table(self.verified(left, None), "links3"), scratch, "parts3")

        placed = classes.join(parts, classes["id"] == parts["node"], "left").select("set_hash", "first", F.coalesce("component", "id").alias("part"))
        firsts = placed.groupBy("part").agg(F.min(F.struct("first", "set_hash")).alias("of"))
        named = placed.select("set_hash", "part").join(firsts, "part").select("set_hash", "of")
        found = signed.select("doc_id", "a", "b", F.col("n").alias("n_shingles"), "set_hash").join(named, "set_hash", "left")
        stands = F.coalesce((F.col("doc_id") == F.col("of.first")) & (F.col("set_hash") == F.col("of.set_hash")), F.lit(True))
        return found.select("doc_id", "a", "b", "set_hash", "n_shingles", F.coalesce("of.first", "doc_id").alias("component_id"), stands.alias("stands"))

    def filtered(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """Pairs (a, b) that sizes and sketches allow, with their distance."""
        side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("distance", _distance("bits_a", "bits_b"))
        return both.filter(_may_link(F.col("n_a"), F.col("n_b"), F.col("distance"), self.num, self.den)).select("a", "b", "distance")

    def verified(self, pairs: DataFrame, candidates: DataFrame | None) -> DataFrame:
        """The pairs (a, b) that link, by their sets. candidates: a table that pairs are from, whose sets are made once; or
        None, and then pairs are a table with classes that may be in no candidate so far."""
        if self.sets is None:
            self.sets = self.shingles_of(candidates)
        known = self.sets
        if candidates is None:
            known = known.unionByName(self.shingles_of(pairs, known))
        side = lambda x: known.select(F.col("id").alias(x), F.col("shingles").alias(f"s_{x}"))
        both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
        common = F.size(F.array_intersect("s_a", "s_b"))
        return both.filter(common * self.den >= (F.size("s_a") + F.size("s_b") - common) * self.num).select("a", "b")

    def shingles_of(self, pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """id, shingles of the classes in pairs, without those that are known; made again from the texts."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        if known is not None:
            ids = ids.join(known.select("id"), "id", "left_anti")
        self.made = getattr(self, "made", 0) + 1
        wanted = self.scratch.table(self.classes.join(ids, "id", "left_semi").select("id", "first", "set_hash", F.xxhash64("first").alias("hash")), f"wanted{self.made}")
        bitmap, words = _bitmap(wanted, "hash"), self.words

        def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shingle = Shingler(words)
            for batch in batches:
                batch = batch[_in_map(bitmap.value, batch["hash"].to_numpy(dtype=np.int64).view(U))]
                for i in range(0, len(batch), BATCH_ROWS):
                    part = batch.iloc[i : i + BATCH_ROWS]
                    made = [shingle(t) for t in part["text"]]
                    yield pd.DataFrame({"first": part["doc_id"].to_numpy(), "set_hash": [_set_hash(x) for x in made], "shingles": [x.astype(np.int64) for x in made]})

        # Few texts are wanted: a map of bits picks them, and some others, where they are read; texts are not shuffled.
        rows = _texts(self.docs).select("doc_id", "text", F.xxhash64("doc_id").alias("hash"))
        found = rows.mapInPandas(sets, "first long, set_hash binary, shingles array<long>")
        sets_ = found.join(wanted.select("id", "first", "set_hash"), ["first", "set_hash"]).select("id", "shingles").dropDuplicates(["id"])
        return self.text_table(sets_, f"sets{self.made}")

    def text_table(self, df: DataFrame, name: str) -> DataFrame:
        """A table made from texts by Python, which gets them in batches of BATCH_ROWS."""
        conf, setting = self.docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = conf.get(setting)
        conf.set(setting, min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS)
        try:
            return self.scratch.table(df, name)
        finally:
            conf.set(setting, before)

    def across(self, pairs: DataFrame, parts: DataFrame) -> DataFrame:
        """The pairs whose sides are in different components."""
        side = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
        both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
        return both.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")

    def left_over(self, held: DataFrame, classes: DataFrame, parts: DataFrame) -> DataFrame:
        """Pairs that share a key, without that key's first class, are in different components, and may link."""
        rest = held.filter("size > 2 and id <> first").join(parts, held["id"] == parts["node"], "left").select("key", "id", "size", F.coalesce("component", "id").alias("component"))
        several = rest.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
        rows = rest.join(several, "key").join(classes.select("id", "n", "bits"), "id")
        # A key's classes are dealt to groups of about BLOCK_ROWS; each pair of groups is a square of its own.
        groups = F.ceil(F.col("size") / BLOCK_ROWS)
        rows = rows.withColumn("g", F.pmod(F.xxhash64("id"), groups)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)))
        rows = rows.select("key", F.least("g", "other").alias("g1"), F.greatest("g", "other").alias("g2"), "g", "id", "component", "n", "bits")
        num, den = self.num, self.den

        def squares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in _runs(batches, ["key", "g1", "g2"]):
                ids, comp, n, g = (part[c].to_numpy() for c in ("id", "component", "n", "g"))
                bits = np.stack(part["bits"].to_numpy()).astype(np.int64).view(U)
                two_groups = part["g1"].iloc[0] != part["g2"].iloc[0]
                for i in range(len(ids)):
                    other = np.arange(len(ids)) if two_groups else np.arange(i + 1, len(ids))
                    ok = comp[other] != comp[i]
                    if two_groups:
                        if g[i] != part["g1"].iloc[0]:
                            continue
                        ok &= g[other] != g[i]
                    ok &= np.minimum(n[other], n[i]) * den >= np.maximum(n[other], n[i]) * num
                    other = other[ok]
                    if len(other):
                        distance = np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1)
                        other = other[distance.astype(np.int64) * (den + num) <= (n[other] + n[i]) * (den - num)]
                    if len(other):
                        yield pd.DataFrame({"a": np.minimum(ids[other], ids[i]), "b": np.maximum(ids[other], ids[i])})

        count = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartition(count, "key", "g1", "g2").sortWithinPartitions("key", "g1", "g2")
        return dealt.mapInPandas(squares, "a long, b long").distinct()


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The stretches of sorted batches that agree in keys, also across batches."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if batch.empty:
            continue
        new = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
        starts = np.flatnonzero(new)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b - a > 1:
                yield batch.iloc[a:b]
        held = batch.iloc[starts[-1] :]
    if held is not None and len(held) > 1:
        yield held


def shingle_join(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of docs with a doc_id: doc_id, n_shingles, component_id. Links need num/den of Jaccard similarity."""
    if not 0 < num <= den:
        raise ValueError("the similarity must be over 0 and at most 1")
    found = _Join(docs, words, num, den).run()
    return found.select("doc_id", "n_shingles", "component_id")


def keep_representatives(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs that are the first of their component (rows without words or doc_id stay), with all columns.

    Rows count once if they share doc_id and text. Texts are not shuffled unless many rows go: what goes, and what is there
    several times, is joined with the rows, not what stays."""
    join = _Join(docs, words, num, den)
    found = join.run().filter("stands")
    text = F.when(F.col("n_shingles") == 0, F.struct("a", "b"))  # wordless rows are all kept; of a set's texts the first is
    found = found.groupBy("doc_id", "set_hash", text.alias("each")).agg(F.min(F.struct("a", "b")).alias("text"))
    stay = found.select("doc_id", "text.a", "text.b").distinct().withColumn("stays", F.lit(True))
    times = join.signed.groupBy("doc_id", "a", "b").agg(F.count("*").alias("times"))
    others = times.join(stay, ["doc_id", "a", "b"], "left").filter("stays is null or times > 1")
    others = join.scratch.table(others.select(F.col("doc_id").alias("__id"), F.col("a").alias("__of_a"), F.col("b").alias("__of_b"), "stays"), "others")
    join.scratch.drop_but("others")
    keyed = docs.withColumn("__a", F.xxhash64(text_or_empty())).withColumn("__b", F.hash(text_or_empty()))
    same = (keyed["doc_id"].cast("long") == others["__id"]) & (keyed["__a"] == others["__of_a"]) & (keyed["__b"] == others["__of_b"])
    kept = keyed.join(sent_if_small(others), same, "left_anti")
    if not (several := others.filter("stays")).isEmpty():
        kept = kept.unionByName(keyed.join(sent_if_small(several), same, "left_semi").dropDuplicates(["doc_id", "__a", "__b"]))
    return kept.drop("__a", "__b")
