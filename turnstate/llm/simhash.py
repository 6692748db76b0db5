"""SimHash near-duplicates with pivot distance tables.

Every text gets a 64-bit fingerprint. A table holds the Hamming distances of each fingerprint
to many reference fingerprints (pivots). The distance of two fingerprints is at least the
largest difference of their table rows, so a pair is discarded when any coordinate differs by
more than the radius; survivors are verified on the fingerprints themselves.

Pairs come from blocks, never from all rows: `bit_blocks` for fingerprints (exact, for small
radii) and `prefixes` for similarities on shingle sets (exact). A large block is cut into parts
that meet two by two, and only where they are not joined already. Only one of equal texts or
fingerprints takes part.

Near-duplicates by similarity are joined by fingerprints and pivots first and checked on the whole
texts; `prefixes` then finds the similar texts whose fingerprints are further apart.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstate.llm.tables import stored

SEED = 42
PIVOTS = 128
RADIUS = 3
BLOCKS, EQUAL = 5, 2  # at most 3 differing bits leave 2 of 5 blocks equal
HOT = 512  # members of a block from which it is divided, and of a part of what stays large

# Near-duplicates by shingle sets: 5 words, similarity 0.8.
WORDS, SIMILARITY = 5, 0.8
SAMPLED, COMMON = 16, 100_000  # one text of so many is searched for common shingles, and how many are listed
TILE = 128  # members of a part of a block; a list holds two parts at most


# --- fingerprints


def shingles(text: str | None, words: int) -> list[bytes]:
    """Space-joined runs of `words` words, A-Z lower-cased; a shorter text is its own shingle."""
    parts = (text or "").encode("utf-8").lower().split()
    if len(parts) <= words:
        return [b" ".join(parts)] if parts else []
    line = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    return [line[a:b] for a, b in zip(starts, ends[words - 1 :].tolist())]


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles(text, words)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit by bit, whether it is set in over half of the hashes; zero for none."""
    ones = np.zeros(64, dtype=np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(words: int, read: Callable[[str | None, int], np.ndarray] = shingle_hashes):
    """A Pandas UDF: text to fingerprint, of the hashes that `read` gives, as a signed long."""

    def run(texts: pd.Series) -> pd.Series:
        found = np.array([fingerprint(read(t, words)) for t in texts], dtype=np.uint64)
        return pd.Series(found.view(np.int64))

    return F.pandas_udf(run, "long")


# --- pivots


def pivot_fingerprints(count: int = PIVOTS, seed: int = 7) -> np.ndarray:
    """Random reference fingerprints: the same on every machine."""
    return np.random.default_rng(seed).integers(0, 2**64, count, dtype=np.uint64)


def distance_table(prints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[:, None] ^ pivots[None, :]).astype(np.int8)


# --- links inside blocks


def links_in_block(prints: np.ndarray, pivots: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links among fingerprints: indices of a pair within the radius.

    Grown from one member after another: what is reached is compared with what is not yet
    reached only, so a block full of near copies costs about its size.
    """
    coordinates = distance_table(prints, pivots)
    rest, found = np.arange(len(prints)), []
    while len(rest) > 1:
        frontier, rest = [int(rest[0])], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = rest
            for column in range(0, len(pivots), 16):
                part = np.abs(coordinates[near, column : column + 16] - coordinates[at, column : column + 16])
                near = near[part.max(axis=1) <= radius]
                if not len(near):
                    break
            near = near[np.bitwise_count(prints[near] ^ prints[at]) <= radius]
            if len(near):
                found += [(at, int(x)) for x in near]
                frontier += near.tolist()
                rest = np.setdiff1d(rest, near, assume_unique=True)
    return found


def tiles(rows: DataFrame, name: str, size: int) -> DataFrame:
    """Rows with their block's number of `members`, repeated with columns `own`, `lo` and `hi`.

    Any two rows of a block meet in a tile (lo, hi); `own` is the row's part. A block is
    cut into parts of about `size` by hash, and every two parts are a tile, so no tile grows
    with its block.
    """
    parts = F.ceil(F.col("members") / size)
    rows = rows.withColumn("own", F.pmod(F.xxhash64(name), parts))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    rows = rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    return rows.drop("other")


def link_batches(radius: int, count: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots = pivot_fingerprints(count)
        for batch in batches:
            left, right = [], []
            for members in batch["members"]:
                prints = np.asarray(members, dtype=np.int64)
                for a, b in links_in_block(prints.view(np.uint64), pivots, radius):
                    left.append(prints[a])
                    right.append(prints[b])
            yield pd.DataFrame({"a": np.array(left, dtype=np.int64), "b": np.array(right, dtype=np.int64)})

    return run


def bit_blocks(prints: DataFrame, blocks: int = BLOCKS, equal: int = EQUAL) -> DataFrame:
    """(block, bits) for each choice of `equal` out of `blocks` bit blocks.

    At most blocks - equal differing bits leave so many blocks without a difference, so a
    pair within that radius shares a row.
    """
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    chosen = [np.uint64(sum(c)).astype(np.int64).item() for c in itertools.combinations(masks, equal)]
    keys = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("bits").bitwiseAND(F.lit(m)).alias("value")) for k, m in enumerate(chosen)])
    return prints.select("bits", F.explode(keys).alias("block"))


def linked_prints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Spanning links (a, b) among distinct fingerprints `bits` at `radius` or fewer bits."""
    if radius > BLOCKS - EQUAL:
        raise ValueError(f"bit blocks are exact to a radius of {BLOCKS - EQUAL}")
    rows = bit_blocks(prints)
    sizes = rows.groupBy("block").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
    shared = rows.join(sizes, "block")
    # One of radius + 1 parts of all bits is equal, too: that divides a hot block further.
    edges = [round(64 * k / (radius + 1)) for k in range(radius + 2)]
    masks = [np.uint64(((1 << b) - 1) ^ ((1 << a) - 1)).astype(np.int64).item() for a, b in itertools.pairwise(edges)]
    cell = lambda k, value: F.struct(F.lit(k).alias("part"), value.cast("long").alias("value"))
    finer = F.array(*[cell(k, F.col("bits").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)])
    dealt = shared.select("block", "bits", F.explode(F.when(F.col("size") > HOT, finer).otherwise(F.array(cell(-1, F.lit(0))))).alias("cell"))
    sizes = dealt.groupBy("block", "cell").agg(F.count("*").alias("members")).filter("members > 1")
    rows = stored(dealt.join(sizes, ["block", "cell"]), "blocks")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("bits"), F.ceil(F.col("members") / HOT)))
    lists = rows.groupBy("block", "cell", "own").agg(F.collect_list("bits").alias("members")).filter(F.size("members") > 1)
    links = lists.select("members").mapInPandas(link_batches(radius, PIVOTS), "a long, b long").distinct()
    large = rows.filter(F.col("members") > HOT)
    if large.isEmpty():
        return links
    # What is not joined yet in a cell of several parts meets in tiles of two parts.
    links = stored(links, "part-links")
    joined = components(links).withColumnRenamed("node", "bits")
    large = large.drop("own").join(joined, "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    open_ = large.groupBy("block", "cell").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most")
    met = tiles(large.join(open_.select("block", "cell"), ["block", "cell"]), "bits", HOT).filter("lo < hi")
    lists = met.groupBy("block", "cell", "lo", "hi").agg(F.collect_list("bits").alias("members")).filter(F.size("members") > 1)
    more = lists.select("members").mapInPandas(link_batches(radius, PIVOTS), "a long, b long")
    return links.union(more).distinct()


# --- components


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link: the smallest node that can be reached.

    Alternates two star steps until nothing changes: each node's larger neighbours, then its
    smaller ones, are linked to the smallest neighbour. Every step is a grouping and a join
    whose skewed keys adaptive execution can split; the state is a written table.
    """
    state = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    seen = None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        both = state.union(state.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("v", "m").union(least.select("u", "m")).toDF("u", "v").filter("u <> v").distinct()
        state = stored(small, "links")


def groups(docs: DataFrame, words: int = 3, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) per row of `docs`.

    `fingerprint` is 16 lowercase hex digits; `component_id` the smallest key reachable over
    links of at most `radius` differing bits. Null and empty texts have fingerprint zero and
    are linked like any other. Rows with a null key belong to their component without giving
    it a key; a component of such rows alone has a null one. Repeated rows stay repeated.
    """
    rows = docs.select(F.col(key).alias("key"), fingerprints(words)(F.col(text)).alias("bits"))
    rows = stored(rows, "fingerprints")
    first = stored(rows.groupBy("bits").agg(F.min("key").alias("first")), "distinct-prints")
    joined = components(linked_prints(first.select("bits")))
    roots = first.join(joined.withColumnRenamed("node", "bits"), "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(least, "root").select("bits", "component_id")
    return rows.join(named, "bits").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


# --- near-duplicates by similarity of shingle sets


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The different shingle hashes of a text, in order; texts without words share one of their own."""
    found = np.unique(shingle_hashes(text, words))
    return found if len(found) else np.array([xxhash.xxh64_intdigest(b"", SEED)], dtype=np.uint64)


def common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and ranks of shingles that recur in a sample of (id, text).

    They only set the order in which shingles are taken; no order changes the pairs that are found.
    """

    def run(part: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(text, words).view(np.int64) for text in part], dtype=object)

    sample = texts.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0)
    sample = sample.select(F.explode(F.pandas_udf(run, "array<long>")("text")).alias("shingle"))
    counts = sample.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 2")
    found = counts.orderBy(F.desc("n"), "shingle").limit(COMMON).collect()
    hashes = np.array([r["shingle"] for r in found], dtype=np.int64)
    order = np.argsort(hashes)
    return hashes[order], np.arange(len(found), 0, -1)[order]


def can_reach(n, pos, m, at, similarity: float):
    """Whether sets of n and m whose first shared shingle is at these places can be similar."""
    needed = (n + m) * (similarity / (1 + similarity)) - 1e-6
    return (n - pos >= needed) & (m - at >= needed)


def prefixes(texts: DataFrame, common: tuple[np.ndarray, np.ndarray], words: int, similarity: float) -> DataFrame:
    """(id, n, pos, shingle): the shingles of each text of which similar texts share at least one.

    In any one order of all shingles, sets of n and m with this similarity share one of the first
    n - ceil(similarity n) + 1 and m - ceil(similarity m) + 1. Common shingles come last.
    """
    held = texts.sparkSession.sparkContext.broadcast(common)

    def run(part: pd.Series) -> pd.DataFrame:
        hashes, ranks = held.value
        sizes, found = [], []
        for text in part:
            own = np.sort(shingle_set(text, words).view(np.int64))
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                own = own[np.argsort(np.where(hashes[at] == own, ranks[at], 0), kind="stable")]
            sizes.append(len(own))
            found.append(own[: len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1])
        return pd.DataFrame({"n": sizes, "first": pd.Series(found, dtype=object)})

    read = F.pandas_udf(run, "n int, first array<long>")("text").alias("p")
    return texts.select("id", read).select("id", "p.n", F.posexplode("p.first").alias("pos", "shingle"))


def similar_pairs(words: int, similarity: float):
    """A Pandas UDF: whether the whole shingle sets of two texts have at least this similarity."""

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        found, last, hub = [], None, None
        for a, b in zip(left, right):
            if hub is None or b != last:
                last, hub = b, shingle_set(b, words)
            own = shingle_set(a, words)
            same = len(np.intersect1d(own, hub, assume_unique=True))
            found.append(same >= similarity * (len(own) + len(hub) - same))
        return pd.Series(found, dtype=bool)

    return F.pandas_udf(run, "boolean")


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar. Texts travel, as they are smaller than their shingles."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("s"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("t"))
    both = pairs.join(left, "a").join(right, "b")
    return both.filter(similar_pairs(words, similarity)("s", "t")).select("a", "b")


def close_pairs(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts (id, bits) that join all whose fingerprints reach each other within RADIUS.

    Texts of one fingerprint meet its smallest id; those ids meet where `linked_prints` has a link.
    """
    first = stored(texts.groupBy("bits").agg(F.min("id").alias("first")), "distinct-prints")
    equal = texts.join(first, "bits").filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    near = linked_prints(first.select("bits")).join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b")
    return equal.union(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def star_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(id, hub, shared): each text with one text of its shingle in its own class of sizes and in the next.

    `shared` is the number of shingles for which that text is the hub.
    """
    rows = rows.withColumn("class", F.floor(F.log("n") / -np.log(similarity)))
    first = F.min(F.struct(F.xxhash64("id").alias("h"), "id", "n", "pos")).alias("hub")
    hubs = rows.groupBy("shingle", "class").agg(first)
    hubs = hubs.select("shingle", "hub", F.explode(F.array("class", F.col("class") - 1)).alias("class"))
    met = rows.join(hubs, ["shingle", "class"]).filter(F.col("id") != F.col("hub.id"))
    met = met.filter(can_reach(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"), similarity))
    return met.groupBy("id", F.col("hub.id").alias("hub")).agg(F.count("*").alias("shared"))


def not_joined(stars: DataFrame, links: DataFrame) -> DataFrame:
    """The rows (id, hub, shared) whose two texts the links do not join."""
    joined = components(links)
    rows = stars.join(joined.toDF("id", "root"), "id", "left").join(joined.toDF("hub", "other"), "hub", "left")
    return rows.filter(F.coalesce("root", "id") != F.coalesce("other", "hub")).select("id", "hub", "shared")


def tile_pairs(similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, size = [], 0
            for row in batch.itertuples(index=False):
                ids, roots, parts, n, pos = (np.asarray(x, dtype=np.int64) for x in (row.ids, row.roots, row.parts, row.sizes, row.places))
                for k in range(len(ids) - 1):
                    rest = slice(k + 1, None)
                    fits = (roots[rest] != roots[k]) & can_reach(n[k], pos[k], n[rest], pos[rest], similarity)
                    if row.lo != row.hi:
                        fits &= parts[rest] != parts[k]
                    other = ids[rest][fits]
                    found.append(np.stack([np.minimum(other, ids[k]), np.maximum(other, ids[k])], axis=1))
                    size += len(other)
                    if size > 100_000:
                        yield tile_frame(found)
                        found, size = [], 0
            if size:
                yield tile_frame(found)

    return run


def tile_frame(found: list[np.ndarray]) -> pd.DataFrame:
    """Each pair once: what a batch has several times need not travel several times."""
    return pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"])


def similar_texts(texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) that join what similar texts (id, text, bits) reach, and no others.

    All pairs are decided on the whole texts. First come those of close fingerprints. The others
    are proposed where a shingle of both prefixes is equal, which leaves none out: each text
    meets the hub it shares most shingles with, then its other hubs, and then all those meet that
    share a shingle and can be similar by its places, each time only where not joined yet.
    """
    close = stored(verified(close_pairs(texts.select("id", "bits")), texts, words, similarity), "close")
    rows = prefixes(texts, common_shingles(texts, words), words, similarity)
    # One shuffle finds both the shingles that are shared and their rows.
    members = F.count("*").over(Window.partitionBy("shingle"))
    rows = stored(rows.withColumn("members", members).filter("members > 1"), "prefixes")
    stars = stored(not_joined(star_pairs(rows, similarity), close), "star-pairs")
    best = stars.groupBy("id").agg(F.max_by("hub", F.struct("shared", "hub")).alias("hub"))
    pair = [F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")]
    tried = best.select(*pair).distinct()
    links = stored(close.union(verified(tried, texts, words, similarity)), "stars")
    apart = not_joined(stars, links).select(*pair).distinct()
    links = stored(links.union(verified(apart.join(tried, ["a", "b"], "left_anti"), texts, words, similarity)), "stars")
    joined = components(links).withColumnRenamed("node", "id")
    rows = rows.drop("members").join(joined, "id", "left").withColumn("root", F.coalesce("root", "id"))
    open_ = rows.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("members"))
    open_ = open_.filter("least <> most").select("shingle", "members")
    dealt = tiles(rows.join(open_, "shingle"), "id", TILE)
    lists = dealt.groupBy("shingle", "lo", "hi").agg(F.collect_list(F.struct("id", "root", "own", "n", "pos")).alias("m")).filter(F.size("m") > 1)
    lists = lists.select("lo", "hi", *[F.col(f"m.{c}").alias(d) for c, d in (("id", "ids"), ("root", "roots"), ("own", "parts"), ("n", "sizes"), ("pos", "places"))])
    pairs = lists.mapInPandas(tile_pairs(similarity), "a long, b long").distinct()
    return links.union(verified(pairs, texts, words, similarity))


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates in `docs`, unchanged and with the same columns.

    A group is what links of at least this similarity reach; close fingerprints propose
    links first, shared shingles the rest. Its smallest non-null key stays; of
    rows that repeat key and text, one. Texts without words, null ones too, are one group.
    """
    whole = F.substring(F.unhex(F.sha2(F.col(text), 256)), 1, 16)
    name = F.coalesce(whole, F.lit(b"").cast("binary"))
    source = docs.select(F.col(key).alias("key"), name.alias("name"), F.col(text).alias("text"))
    own = F.min(F.struct(F.col("key").isNull().alias("none"), "key")).alias("own")
    # Rows of one name have one text, so any of their texts is the text. The short number stands
    # for the name in everything that follows; it is fixed once the table is written.
    texts = source.groupBy("name").agg(own, F.first("text").alias("text"))
    bits = fingerprints(words, shingle_set)("text").alias("bits")
    texts = stored(texts.select(F.monotonically_increasing_id().alias("id"), "name", "own", "text", bits), "texts", compression="zstd")
    joined = components(similar_texts(texts.select("id", "text", "bits"), words, similarity)).withColumnRenamed("node", "id")
    members = texts.select("id", "own", "name").join(joined, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = members.groupBy("root").agg(F.min(F.struct("own", "name")).alias("least")).select("least.*")
    mark = F.coalesce(F.col("key").cast("string"), F.lit("\\N")).alias("mark")
    kept = least.select(F.col("own.key").alias("key"), "name").select("name", mark)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), name.alias("name"), F.col(key).alias("key"))
    rows = rows.select("row", "name", mark)
    return rows.join(kept, ["name", "mark"], "left_semi").dropDuplicates(["name", "mark"]).select("row.*")
