"""SimHash fingerprints and near-duplicate groups by meet-in-the-middle ball hashing; near copies by verified similarity of shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskin.llm.textcols import fresh, small_batches
from corpuskin.plans.shared import connected_components, materialize, release

#: Texts are taken in pieces of about so many bytes, cut at white space, so that a long one needs no more memory than its own size.
PIECE_BYTES = 1 << 20
SEED = 42
#: Jaccard similarity of shingle sets at which near copies are dropped, the minima kept of a set, and the bands of them that find candidates.
SIMILAR = 0.8
MINIMA = 256
BANDS, BAND = 24, 6
#: A key with more exact members than this is split by the bits that it doesn't fix.
HOT_KEY = 128


def word_pieces(data: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words (runs of other bytes than ASCII white space) in lists, a piece of the text each."""
    if len(data) <= size:
        yield data.split()
        return
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            cuts = [p for c in b" \t\n\r\x0b\x0c" if (p := data.find(c, end, end + size)) >= 0]
            while not cuts and end < len(data):  # one word longer than a piece
                end += size
                cuts = [p for c in b" \t\n\r\x0b\x0c" if (p := data.find(c, end, end + size)) >= 0]
            end = min(cuts) if cuts else len(data)
        yield data[at:end].split()
        at = end


def _mixed(values: np.ndarray, number: int) -> np.ndarray:
    """Further hash values of the shingles, from their first ones (SplitMix64's finalizer); number 0 is the first itself."""
    if not number:
        return values
    x = values + np.uint64(number * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles, repeats included, an array for each piece of the text; of fewer words, the whole sequence. Nothing without words."""
    data = (text or "").encode("utf-8", "replace").lower()  # bytes.lower() folds A-Z only
    held: list[bytes] = []
    some = False
    digest = xxhash.xxh64_intdigest
    for piece in word_pieces(data):
        words = held + piece
        if len(words) >= width:
            some = True
            yield np.fromiter((digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(width)), strict=False)), np.uint64)
            held = words[-(width - 1) :] if width > 1 else []
        else:
            held = words
    if not some and held:
        yield np.array([digest(b" ".join(held), SEED)], np.uint64)


def _bit_counts(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _majority(ones: np.ndarray, total: int) -> np.ndarray:
    """Fingerprints of counts of ones: a bit is set if it is in over half of the hashes."""
    bits = (2 * ones > total) if total else np.zeros(ones.shape, bool)
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8")[..., 0]


def fingerprints(text: str | None, width: int = 3, prints: int = 1) -> list[int]:
    """``prints`` times 64 bits: each is 1 if it is set in over half of the shingles' hashes (repeats count). 0 without words.

    The first fingerprint's hashes are XXH64, the others' are made from it, independent of it and each other.
    """
    ones = np.zeros((prints, 64), np.int64)
    total = 0
    for values in shingle_hashes(text, width):
        for k in range(prints):
            ones[k] += _bit_counts(_mixed(values, k))
        total += len(values)
    return _majority(ones, total).tolist()


def fingerprint(text: str | None, width: int = 3) -> int:
    return fingerprints(text, width)[0]


def with_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, prints: int = 1) -> DataFrame:
    """(``key``, fp, fp1, ...): a row's fingerprints, as the signed longs of the same 64 bits."""
    small_batches(docs.sparkSession)
    named = docs.select(F.col(key).alias(key), F.col(text).alias("text"))
    columns = ["fp", *(f"fp{k}" for k in range(1, prints))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            made = np.array([fingerprints(texts[i].as_py(), width, prints) for i in range(len(texts))], np.uint64).reshape(-1, prints).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(made[:, k]) for k in range(prints))], names=[key, *columns])

    return named.mapInArrow(run, f"`{key}` {named.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in columns))


def _popcount(x: Column) -> Column:
    return F.bit_count(x)


def _part(fp: Column, low: int, bits: int) -> Column:
    """``bits`` bits of a fingerprint from bit ``low``."""
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1))


def _ball(value: Column, bits: int) -> Column:
    """All variants within distance 1, half of the radius rounded down, of a part of a fingerprint."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    return F.concat(F.array(value), flips)


def _halves(rows: DataFrame, keys: list[str], low: int, bits: int, ball: bool) -> DataFrame:
    """Rows dealt by both halves of the ``bits`` bits from ``low``: (keys..., half, value, fp); with all variants if ``ball``."""
    half = bits // 2
    sides = []
    for side, at in ((0, low + half), (1, low)):
        value = _part(F.col("fp"), at, half)
        made = F.explode(_ball(value, half)) if ball else value
        sides.append(rows.select(*keys, F.lit(side).alias("half"), made.alias("value"), "fp"))
    return sides[0].unionByName(sides[1])


def _meet(balls: DataFrame, exact: DataFrame, on: list[str]) -> DataFrame:
    """Variants (fp as a) with the fingerprints (fp as b) that have them: never a broadcast, whatever the session's threshold, as Spark takes an exploded table for no larger than what it is made of."""
    return balls.withColumnRenamed("fp", "a").join(exact.withColumnRenamed("fp", "b").hint("merge"), on)


def links(prints: DataFrame, radius: int = 3, hot: int = HOT_KEY, within: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst), src > dst: all pairs of distinct fingerprints (``fp`` long) that differ in ``radius`` (at most 3) bits or fewer.

    With columns ``within``, only pairs that agree in them, which come along.

    Meet in the middle: of two fingerprints within 3 bits, one half differs in at most 1 bit, half of the radius. Each
    fingerprint emits all variants of each half within that distance (2 x 33 rows) and meets the fingerprints whose half
    is exactly the variant. (Variants of all 64 bits at once would need distance 2 on one side: 2,081 rows each, 31 times
    the shuffle, for the same pairs.) Pairs that meet are verified over all 64 bits, each at one of its keys only.

    A key that many fingerprints share is split again by the halves of the bits that it leaves open, down to keys that
    fix all but 8 bits on the exact side, which at most 256 fingerprints can share: no key gathers an unbounded group.
    Each split is a query of its own, and only of halves that have crowded keys: the driver plans, compiles and adapts all
    of a query's stages at once, so that its memory would grow with the splits.
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius must be 0 to 3")
    keys = list(within)
    on = [*keys, "half", "value"]
    near = lambda a, b: _popcount(a.bitwiseXOR(b)) <= radius
    exact = _halves(prints, keys, 0, 64, False)
    balls = _halves(prints, keys, 0, 64, True)
    crowd = materialize(exact.groupBy(*on).count().where(F.col("count") > hot).select(*on), "hot-keys")
    any_hot = bool(crowd.head(1))
    e0, b0 = exact, balls
    if any_hot:
        e0 = exact.join(crowd, on, "left_anti")
        b0 = balls.join(crowd, on, "left_anti")
    once = (F.col("half") == 0) | (_popcount(_part(F.col("a").bitwiseXOR(F.col("b")), 32, 32)) > 1)
    met = _meet(b0, e0, on)
    out = met.where((F.col("a") > F.col("b")) & near(F.col("a"), F.col("b")) & once).select(*keys, "a", "b")
    if any_hot:
        for side, low in ((0, 0), (1, 32)):  # a key that fixes the upper half leaves the lower 32 bits open
            for found in _hot(exact, balls, crowd, side, keys, "k", low, 32, near, hot):
                out = out.unionByName(found.select(*keys, "a", "b"))
        out = out.distinct()  # keys of split groups can find a pair more than once
    return out.select(*keys, F.col("a").alias("src"), F.col("b").alias("dst"))


def _hot(exact: DataFrame, balls: DataFrame, crowd: DataFrame, side: int, keys: list[str], name: str, low: int, bits: int, near, hot: int) -> list[DataFrame]:
    """Pairs within the keys of ``crowd`` that fix half ``side``, as written tables: by halves of the ``bits`` open bits from ``low``, those with crowded keys again."""
    here = crowd.where(F.col("half") == side).select(*keys, "value")
    if not here.head(1):
        return []
    pick = lambda x: x.where(F.col("half") == side).join(here, [*keys, "value"], "left_semi").select(*keys, F.col("value").alias(name), "fp")
    own = [*keys, name]
    on = [*own, "half", "value"]
    e, b = _halves(materialize(pick(exact), "hot"), own, low, bits, False), _halves(pick(balls), own, low, bits, True)
    if bits == 16:  # the last split: a key leaves 8 bits open
        e0, b0, deeper = e, b, []
    else:
        more = materialize(e.groupBy(*on).count().where(F.col("count") > hot).select(*on), "hot-keys")
        e0, b0 = e.join(more, on, "left_anti"), b.join(more, on, "left_anti")
        deeper = [x for half, at in ((0, low), (1, low + 16)) for x in _hot(e, b, more, half, own, f"{name}2", at, 16, near, hot)]
    met = _meet(b0, e0, on)
    return [materialize(met.where((F.col("a") > F.col("b")) & near(F.col("a"), F.col("b"))), "hot-pairs"), *deeper]


def near_duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3, prints: int = 1) -> DataFrame:
    """One row per input row: ``key``, fp (long), component_id: the smallest key reachable over linked fingerprints.

    With several ``prints``, rows link that are within ``radius`` bits in any of their fingerprints, each of which has its
    own hashes: pairs that one fingerprint misses by chance are found by another. Equal fingerprints are one node, combined
    before the shuffle, so that a group of copies costs a row. A null or empty text has the fingerprint 0 and is linked
    like any other. Null keys are kept; a group of null keys only has a null component. Repeated keys give a row each.
    Other columns are left out. An empty table gives an empty result.
    """
    return linked_prints(materialize(with_fingerprints(docs, key, text, width, prints), "prints"), key, radius, prints)


def linked_prints(made: DataFrame, key: str, radius: int = 3, prints: int = 1) -> DataFrame:
    """(``key``, fp, component_id) of a written table (``key``, fp, fp1, ...), see :func:`near_duplicate_groups`."""
    nodes = materialize(made.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    if prints == 1:
        edges = links(nodes.select("fp"), radius)
    else:
        # a fingerprint stands for the least first one that it occurs with, and connects the others with it
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("print"), F.col(f"fp{k}" if k else "fp").alias("other")) for k in range(prints)]))
        pairs = made.select("fp", each.alias("x")).select("fp", "x.print", "x.other").distinct()
        stands = materialize(pairs.groupBy("print", "other").agg(F.min("fp").alias("node")), "stands")
        same = pairs.join(stands, ["print", "other"]).where("fp <> node").select(F.col("fp").alias("src"), F.col("node").alias("dst"))
        found = links(stands.select("print", F.col("other").alias("fp")), radius, within=("print",))
        found = found.join(stands.select("print", F.col("other").alias("src"), F.col("node").alias("a")), ["print", "src"])
        found = found.join(stands.select("print", F.col("other").alias("dst"), F.col("node").alias("b")), ["print", "dst"])
        edges = same.unionByName(found.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    graph = connected_components(edges)
    # only fingerprints with links are in the graph; the rest are their own component
    placed = nodes.join(graph.select(F.col("node").alias("fp"), "component"), "fp", "left")
    placed = placed.withColumn("component", F.coalesce("component", "fp"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = placed.join(least, "component").select("fp", "component_id")
    return made.select(key, "fp").join(placed, "fp").select(key, "fp", "component_id")


def hex_print(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicate_groups(docs).select("doc_id", hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct shingles' XXH64, sorted: the shingles of :func:`fingerprints`, but repeats don't count. Empty without words."""
    made = [np.unique(x) for x in shingle_hashes(text, width)]
    return made[0] if len(made) == 1 else np.unique(np.concatenate(made)) if made else np.zeros(0, np.uint64)


_FACTORS, _TERMS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, MINIMA), np.uint64) | np.array([[1], [0]], np.uint64)


def _minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of ``MINIMA`` hashes over the shingles (at least one)."""
    least = np.full(MINIMA, (1 << 64) - 1, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(least, (shingles[at : at + 512, None] * _FACTORS + _TERMS).min(0), out=least)
    return least


def with_sketches(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(``key``, node, n, fp, e0, ..., bands): the set's own hash, its size, the fingerprint, a bit of each minimum, and the hashes of bands of minima."""
    small_batches(docs.sparkSession)
    named = docs.select(F.col(key).alias(key), F.col(text).alias("text"))
    longs = MINIMA // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, size, prints, bits, bands = [], [], [], np.zeros((b.num_rows, longs), np.int64), []
            for i in range(b.num_rows):
                sets, ones, total = [], np.zeros(64, np.int64), 0
                for values in shingle_hashes(b.column(1)[i].as_py(), width):
                    ones += _bit_counts(values)
                    total += len(values)
                    sets.append(np.unique(values))
                prints.append(int(_majority(ones, total)))
                shingles = sets[0] if len(sets) == 1 else np.unique(np.concatenate(sets or [np.zeros(0, np.uint64)]))
                node.append(xxhash.xxh64_intdigest(shingles.tobytes(), SEED))
                size.append(len(shingles))
                if not len(shingles):
                    bands.append([])
                    continue
                least = _minima(shingles)
                bits[i] = np.packbits((least >> np.uint64(31) & np.uint64(1)).astype(bool), bitorder="little").view("<i8")
                made = [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least[: BANDS * BAND].reshape(BANDS, BAND))]
                bands.append(np.array(made, np.uint64).view(np.int64))
            longs_of = lambda values: pa.array(np.array(values, np.uint64).view(np.int64))
            estimates = [pa.array(bits[:, k]) for k in range(longs)]
            columns = [b.column(0), longs_of(node), pa.array(size, pa.int32()), longs_of(prints), *estimates, pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "node", "n", "fp", *(f"e{k}" for k in range(longs)), "bands"])

    kind = named.schema[key].dataType.simpleString()
    return named.mapInArrow(run, f"`{key}` {kind}, node bigint, n int, fp bigint, " + ", ".join(f"e{k} bigint" for k in range(longs)) + ", bands array<bigint>")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held, at = [], 0, 0
            for i in range(b.num_rows):
                rows.append(shingle_set(b.column(1)[i].as_py(), width).view(np.int64))
                held += len(rows[-1])
                if held > 1 << 19 or i == b.num_rows - 1:  # 4 MB
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(rows)), pa.array(rows, pa.list_(pa.int64()))], names=["node", "shingles"])
                    rows, held, at = [], 0, i + 1

    return texts.select("node", "text").mapInArrow(run, "node bigint, shingles array<bigint>")


def near_copies(docs: DataFrame, key: str, text: str = "text", width: int = 5, threshold: float = SIMILAR) -> DataFrame:
    """(``key``, node, component_id): rows whose sets of shingles have a Jaccard similarity of ``threshold`` or more are linked.

    Every link is verified on the sets themselves. Candidates are the groups of :func:`linked_prints` (ball hashing), and
    sets that share a band of ``BAND`` minima in any of ``BANDS``: a pair at 0.8 is missed by the bands with probability
    (1 - 0.8 ** 6) ** 24 = 0.0007, closer ones with less. Equal sets are one node.

    All nodes are compared with one node of their group and of each of their bands first, the one that shares the most of
    its shingles with others. All pairs of a band that are then still in different components follow, so that a large
    group of copies costs its size and no candidate that could join two components is left out. Of these pairs those go
    unverified that can't reach ``threshold`` by their sizes, by how many of their shingles no other candidate has, or
    whose ``MINIMA`` bits are over 4.5 standard deviations from those of a pair at it.
    """
    bits = [f"e{k}" for k in range(MINIMA // 64)]
    made = materialize(with_sketches(docs, key, text, width), "sketches")
    nodes = materialize(made.groupBy("node").agg(F.min(key).alias("least"), *[F.first(c).alias(c) for c in ("n", "fp", *bits, "bands")]), "nodes")
    dealt = nodes.where("n > 0").select(F.explode("bands").alias("band"), "node")
    # what a join meets a hot key with is written first: right above an aggregate adaptive execution can't split it
    heads = materialize(dealt.groupBy("band").agg(F.count("*").alias("_c")).where("_c > 1").select("band"), "crowds")
    shared = materialize(dealt.join(heads, "band"), "bands")
    printed = linked_prints(nodes.where("n > 0").select("node", "fp"), "node").select("node", F.col("component_id").alias("group"))
    crowds = printed.groupBy("group").count().where("count > 1").select("group")
    printed = materialize(printed.join(crowds, "group"), "printed")
    release(docs.sparkSession)  # also of what the driver has held for the queries so far

    texts = docs.select(F.col(key).alias("least"), F.col(text).alias("text"))
    met = nodes.join(shared.select("node").union(printed.select("node")).distinct(), "node", "left_semi").select("node", "least", "n")
    sets = materialize(_sets(texts.join(met, "least").dropDuplicates(["least"]), width), "sets")
    alive = _common(sets, met.select("node", "n"), threshold)

    need = lambda m, n: threshold / (1 + threshold) * (m + n) - 1e-6  # noqa: E731  the shingles that two sets must have in common
    enough = lambda a, b: F.least(F.col(f"{a}common"), F.col(f"{b}common")) >= need(F.col(f"{a}n"), F.col(f"{b}n"))
    row = F.struct((F.col("common") / F.col("n")).alias("share"), "node", "n", "common")

    def with_head(members: DataFrame, group: str) -> DataFrame:
        """Each node with the one of its group that has the largest share of common shingles."""
        own = members.join(alive, "node")
        head = materialize(own.groupBy(group).agg(F.max(row).alias("h")), "heads")
        both = own.join(head, group).select("node", "n", "common", F.col("h.node").alias("head"), F.col("h.n").alias("hn"), F.col("h.common").alias("hcommon"))
        return both.where((F.col("node") != F.col("head")) & enough("", "h")).select(F.greatest("node", "head").alias("src"), F.least("node", "head").alias("dst"))

    first = materialize(with_head(shared, "band").union(with_head(printed, "group")).distinct(), "pairs")
    release(docs.sparkSession)

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        a = sets.select(F.col("node").alias("src"), F.col("shingles").alias("a"))
        b = sets.select(F.col("node").alias("dst"), F.col("shingles").alias("b"))
        both = F.size(F.array_intersect("a", "b"))
        alike = both >= threshold * (F.size("a") + F.size("b") - both) - 1e-9
        return materialize(pairs.join(a, "src").join(b, "dst").where(alike).select("src", "dst"), label)

    edges = verified(first, "links")
    graph = materialize(connected_components(edges), "parts")
    release(docs.sparkSession)
    placed = shared.join(alive, "node").join(graph, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    split = materialize(split.select("band"), "split")
    rest = placed.join(split, "band").join(nodes.select("node", "bands", *bits), "node")
    rest = materialize(rest, "open")
    other = rest.select("band", *[F.col(c).alias(f"_{c}") for c in ("node", "n", "common", "component", "bands", *bits)])
    p = (1 - threshold) / 2
    most = MINIMA * p + 4.5 * (MINIMA * p * (1 - p)) ** 0.5
    apart = sum((_popcount(F.col(c).bitwiseXOR(F.col(f"_{c}"))) for c in bits), F.lit(0))
    once = F.array_intersect("bands", "_bands")[0] == F.col("band")  # a pair is made in the first band that it shares
    open_ = (F.col("node") > F.col("_node")) & (F.col("component") != F.col("_component"))
    pairs = rest.join(other.hint("merge"), "band").where(open_ & enough("", "_") & (apart <= most) & once)
    pairs = pairs.select(F.col("node").alias("src"), F.col("_node").alias("dst")).join(first, ["src", "dst"], "left_anti")
    graph = connected_components(edges.unionByName(verified(materialize(pairs, "pairs"), "links")))

    found = nodes.select("node", "least").join(graph, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = found.groupBy("component").agg(F.min("least").alias("component_id"))
    return made.select(key, "node").join(found.join(least, "component").select("node", "component_id"), "node").select(key, "node", "component_id")


def _common(sets: DataFrame, sizes: DataFrame, threshold: float, rounds: int = 2) -> DataFrame:
    """(node, n, common): how many of a node's shingles another node has too; nodes too few of whose are for any link are left out.

    Nodes that are left out link with none, so their shingles don't count in the next round.
    """
    kept = sizes
    for _ in range(rounds):
        words = sets.join(kept.select("node"), "node", "left_semi").select("node", F.explode("shingles").alias("shingle"))
        own = words.groupBy("shingle").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count("*").alias("own"))
        kept = sizes.join(kept.select("node"), "node", "left_semi").join(own, "node", "left").select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common"))
        kept = materialize(kept.where(F.col("common") >= threshold * F.col("n") - 1e-6), "common")
    return kept


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, threshold: float = SIMILAR) -> DataFrame:
    """``docs`` with one row of each group of :func:`near_copies`: the one with the smallest key, nulls last, then an arbitrary but fixed one.

    Rows are told apart by a hash of key and text, so that rows that repeat a key are judged by their own texts; of rows
    that repeat both, one stays.
    """
    row = F.xxhash64(F.col(key), F.col(text))
    named = docs.select(F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), row.alias("r")).alias("_id"), F.col(text).alias("text"))
    groups = near_copies(named, "_id", "text", width, threshold)
    at = fresh(docs, "_row")
    keep = groups.where("_id <=> component_id").select(F.col("_id.r").alias("_keep")).distinct()
    numbered = docs.withColumn(at, row)
    return numbered.join(keep, numbered[at] == keep["_keep"], "left_semi").dropDuplicates([at]).drop(at)
