"""Archetypes: files of one structural skeleton whose description tokens hang together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuskin.functions.labels import identity
from corpuskin.plans.shared import connected_components, discard, materialize, ranked, release

TOKEN_THRESHOLD = 0.5
SKELETON = ["compression", "is_tiled", "tile_width", "tile_height", "role"]


def skeletons(profiles: DataFrame) -> DataFrame:
    """(file_id, skeleton, description_tokens): the skeleton is the section count and each section without its dimensions."""
    per = F.transform("ifds", lambda x: F.struct(*[x[k].alias(k) for k in SKELETON]))
    return profiles.select("file_id", F.struct(F.col("ifd_count").alias("ifd_count"), per.alias("per_ifd")).alias("skeleton"), "description_tokens")


def skeleton_groups(profiles: DataFrame) -> DataFrame:
    """(skeleton, n_files, first_file)."""
    return skeletons(profiles).groupBy("skeleton").agg(F.count("*").alias("n_files"), F.min("file_id").alias("first_file"))


#: Longs of a set's sketch.
SKETCH = 16


def _sketch(tokens: Column) -> Column:
    """``SKETCH`` times 64 bits, those set that some token's hash names."""
    at = F.transform(tokens, lambda x: F.pmod(F.xxhash64(x), F.lit(64 * SKETCH)).cast("int"))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x % 64)
    word = lambda h, w: F.aggregate(F.filter(h, lambda x: F.shiftright(x, 6) == w), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(bit(x)))
    return F.transform(F.array(at), lambda h: F.transform(F.sequence(F.lit(0), F.lit(SKETCH - 1)), lambda w: word(h, w)))[0]


#: Tokens that are numbered by how many files have them; the order of others is that of their hashes.
COMMON_TOKENS = 1 << 16


def most_common(rows: DataFrame) -> np.ndarray:
    """Hashes of the ``COMMON_TOKENS`` tokens of most files at most, rarest first; ``rows`` have sets as ``t``."""
    often = rows.select(F.explode(F.transform("t", lambda x: F.xxhash64(x))).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    some = often.where("n > 1").orderBy(F.desc("n"), "h").limit(COMMON_TOKENS).toArrow()
    return some.column("h").to_numpy()[::-1].copy()


def in_order(rows: DataFrame, common: np.ndarray) -> DataFrame:
    """(file_id, _s, t): sets as numbers in one order of all tokens: hashes of the rare ones, then places in ``common``."""
    by_hash = np.argsort(common)
    keys = common[by_hash]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            values, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            place = np.full(len(values), -1)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
                place = np.where(keys[at] == values, by_hash[at], -1)
            order = np.lexsort((values, place, np.repeat(np.arange(len(sizes)), sizes)))
            numbers = np.where(place < 0, values, place)[order]
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, pa.array(numbers))], names=["file_id", "_s", "t"])

    hashed = rows.select("file_id", "_s", F.transform("t", lambda x: F.xxhash64(x)).alias("t"))
    kinds = ", ".join(f"{c} {hashed.schema[c].dataType.simpleString()}" for c in ("file_id", "_s"))
    return hashed.mapInArrow(run, f"{kinds}, t array<bigint>")


def token_links(rows: DataFrame, threshold: float = TOKEN_THRESHOLD) -> DataFrame:
    """(a, b), a < b: files of one skeleton whose token sets have a Jaccard similarity of at least ``threshold``.

    A prefix join: tokens are ordered by how many files have them, and two sets that similar share one of each one's
    rarest tokens, the first of them early enough for what follows it to suffice. Any one order of all tokens gives the
    same links, so that only ``COMMON_TOKENS`` are ordered by their files, after all others: no token of a set is dealt
    to be told its number of files. Tokens are told apart by 64 bits. Files without tokens are equal to each
    other: they link to the first of them, which connects them.
    """
    held = rows.select("file_id", identity(F.to_json("skeleton")).alias("_s"), F.col("description_tokens").alias("t"))
    some = held.where(F.size("t") > 0)
    ordered = materialize(in_order(some, most_common(some)), "ordered")
    n = F.size("t")
    prefix = ordered.select("file_id", "_s", n.alias("n"), F.posexplode(F.slice("t", F.lit(1), n - F.ceil(n * threshold).cast("int") + 1)).alias("i", "p"))
    a, b = (prefix.select(F.col("file_id").alias(k), "_s", "p", F.col("n").alias(f"n{k}"), (F.col("n") - F.col("i")).alias(f"r{k}")) for k in "ab")
    sizes = (F.col("na") >= F.col("nb") * threshold) & (F.col("nb") >= F.col("na") * threshold)
    # from the first token that two sets share, they need so many
    need = (F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-6
    met = a.join(b, ["_s", "p"]).where("a < b").where(sizes & (F.least("ra", "rb") >= need)).select("a", "b").distinct()
    # a bit that only one set has is a token that only one has: most pairs go by that, before whole sets are dealt to the rest
    marked = ordered.select("file_id", n.alias("n"), _sketch(F.col("t")).alias("s"))
    met = met.join(marked.select(F.col("file_id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")), "a").join(marked.select(F.col("file_id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb")), "b")
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    met = materialize(met.where(apart <= (F.col("na") + F.col("nb")) * ((1 - threshold) / (1 + threshold)) + 1e-6).select("a", "b"), "near")
    # each pair that is left is verified once, over all of its tokens
    met = met.join(ordered.select(F.col("file_id").alias("a"), F.col("t").alias("ta")), "a").join(ordered.select(F.col("file_id").alias("b"), F.col("t").alias("tb")), "b")
    both = F.size(F.array_intersect("ta", "tb"))
    near = met.where(both / (F.size("ta") + F.size("tb") - both) >= threshold).select("a", "b")
    none = held.where(F.size("t") == 0).select("file_id", "_s")
    first = none.groupBy("_s").agg(F.min("file_id").alias("a"))
    return near.union(none.join(first, "_s").where("a < file_id").select("a", F.col("file_id").alias("b")))


def _token_classes(profiles: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(named, placed, sets): (file_id, _k); of each class _k its least file, its number of files and first_file, the smallest one of its cluster; the skeleton and the tokens of each least file.

    Files of one skeleton and equal tokens are a class, which is one node of the token graph: copies cost a row each.
    """
    release(profiles.sparkSession)  # shuffle files of the profiles
    rows = skeletons(profiles)
    named = materialize(rows.select("file_id", identity(F.to_json("skeleton"), F.lit("|"), "description_tokens").alias("_k")), "named")
    nodes = materialize(named.groupBy("_k").agg(F.min("file_id").alias("least"), F.count("*").alias("n")), "nodes")
    sets = materialize(rows.join(nodes.select(F.col("least").alias("file_id")), "file_id", "left_semi"), "sets")
    release(profiles.sparkSession)
    found = connected_components(token_links(sets, threshold), "a", "b")
    placed = nodes.join(found.select(F.col("node").alias("least"), F.col("component").alias("first_file")), "least", "left")
    placed = materialize(placed.select("_k", "least", "n", F.coalesce("first_file", "least").alias("first_file")), "placed")
    release(profiles.sparkSession)
    return named, placed, sets


def token_clusters(profiles: DataFrame, threshold: float = TOKEN_THRESHOLD) -> DataFrame:
    """(file_id, first_file): components of the token graph within skeletons, named by their smallest file."""
    named, placed, sets = _token_classes(profiles, threshold)
    discard(sets)
    return named.join(placed, "_k").select("file_id", "first_file")


def derive_archetypes(profiles: DataFrame, threshold: float = TOKEN_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(archetypes, members). Archetypes: archetype_id, n_files, first_file, skeleton, common_tokens, variable_tokens. Members: file_id, archetype_id.

    Numbered from 0: most files first, then fewer sections, fewer common tokens, the skeleton's order, the first file.
    Tokens are counted by classes, and only those of archetypes that have several: one class alone has no variable ones.
    """
    named, placed, sets = _token_classes(profiles, threshold)
    sizes = placed.groupBy("first_file").agg(F.sum("n").alias("n_files"), F.count("*").alias("classes"))
    told = placed.select(F.col("least").alias("file_id"), "n", "first_file").join(sizes, "first_file")
    held = materialize(sets.join(told, "file_id"), "classes")
    discard(sets)
    none = F.array().cast("array<string>")
    several = held.where("classes > 1")
    tokens = several.select("first_file", "n_files", "n", F.explode("description_tokens").alias("token"))
    tokens = tokens.groupBy("first_file", "n_files", "token").agg(F.sum("n").alias("n"))
    pick = lambda which: F.array_sort(F.collect_list(F.when(which, F.col("token"))))
    counted = tokens.groupBy("first_file").agg(pick(F.col("n") == F.col("n_files")).alias("common_tokens"), pick(F.col("n") < F.col("n_files")).alias("variable_tokens"))
    heads = several.where("file_id = first_file").select("first_file", "n_files", "skeleton").join(counted, "first_file", "left")
    heads = heads.withColumn("common_tokens", F.coalesce("common_tokens", none)).withColumn("variable_tokens", F.coalesce("variable_tokens", none))
    alone = held.where("classes = 1").select("first_file", "n_files", "skeleton", F.col("description_tokens").alias("common_tokens"), none.alias("variable_tokens"))
    full = materialize(heads.unionByName(alone), "full")
    discard(held)
    release(profiles.sparkSession)
    # tokens aren't dealt to be numbered
    order = F.struct((-F.col("n_files")).alias("a"), F.col("skeleton.ifd_count").alias("b"), F.size("common_tokens").alias("c"), F.col("skeleton").alias("d"), F.col("first_file").alias("e"))
    numbered = ranked(full.select("first_file", order.alias("_order"), F.lit(0).alias("_all")), "_all", ["_order"], "archetype_id", "archetypes").select("first_file", "archetype_id")
    numbered = materialize(numbered, "numbered")
    members = named.join(placed.select("_k", "first_file"), "_k").join(numbered, "first_file").select("file_id", "archetype_id")
    return full.join(numbered, "first_file"), members


def _code(x: Column) -> Column:
    return F.when(x.isNull(), "None").otherwise(F.concat(F.lit("Some("), x.cast("string"), F.lit(")")))


def skeleton_diff(a: Column, b: Column) -> Column:
    """What differs from skeleton ``a`` to ``b``: section count, and by position compression and layout. The wording is fixed: reports are compared as text."""
    gap = b["ifd_count"] - a["ifd_count"]
    count = F.when(gap != 0, F.concat(F.lit("IFD count "), F.when(gap > 0, "+").otherwise(""), gap.cast("string"), F.lit(" ("), b["ifd_count"], F.lit(" vs "), a["ifd_count"], F.lit(")")))
    shared = F.least(F.size(a["per_ifd"]), F.size(b["per_ifd"]))

    def at(i: Column) -> Column:
        x, y = a["per_ifd"][i], b["per_ifd"][i]
        code = F.when(~x["compression"].eqNullSafe(y["compression"]), F.concat(F.lit("IFD "), i, F.lit(" compression "), _code(x["compression"]), F.lit("→"), _code(y["compression"])))
        flip = F.when(x["is_tiled"], "tiled→strip").otherwise("strip→tiled")
        layout = F.when(x["is_tiled"] != y["is_tiled"], F.concat(F.lit("IFD "), i, F.lit(" layout "), flip))
        return F.array_compact(F.array(code, layout))

    positions = F.when(shared > 0, F.sequence(F.lit(0), shared - 1)).otherwise(F.array().cast("array<int>"))
    parts = F.concat(F.array_compact(F.array(count)), F.flatten(F.transform(positions, at)))
    return F.when(F.size(parts) == 0, "structural difference").otherwise(F.array_join(parts, "; "))


def archetype_relations(archetypes: DataFrame) -> DataFrame:
    """(archetype_id, other_id, relation, note): same_tokens (with a note), subset_of, superset_of, by common tokens.

    Empty sets equal each other, but are no subsets. Equal sets meet on their hash; subsets meet on the smaller set's
    rarest token, which the larger must have, so that only archetypes that share it are compared.
    """
    rows = archetypes.select("archetype_id", "skeleton", F.col("common_tokens").alias("t"))
    a = rows.select(F.col("archetype_id").alias("i"), F.col("skeleton").alias("si"), F.col("t").alias("ti"), F.xxhash64("t").alias("h"))
    b = rows.select(F.col("archetype_id").alias("j"), F.col("skeleton").alias("sj"), F.col("t").alias("tj"), F.xxhash64("t").alias("h"))
    equal = a.join(b, "h").where("i < j and ti = tj").select("i", "j", skeleton_diff(F.col("si"), F.col("sj")).alias("note"))
    same = equal.select(F.explode(F.array(F.struct(F.col("i").alias("x"), F.col("j").alias("y")), F.struct(F.col("j").alias("x"), F.col("i").alias("y")))).alias("p"), "note")
    same = same.select(F.col("p.x").alias("archetype_id"), F.col("p.y").alias("other_id"), F.lit("same_tokens").alias("relation"), "note")

    tokens = rows.select("archetype_id", F.explode("t").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("n"))
    rarest = tokens.join(often, "token").groupBy("archetype_id").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    small = rarest.join(rows.select("archetype_id", "t"), "archetype_id").select(F.col("archetype_id").alias("i"), "token", F.col("t").alias("ti"))
    large = tokens.join(rows.select("archetype_id", "t"), "archetype_id").select(F.col("archetype_id").alias("j"), "token", F.col("t").alias("tj"))
    within = small.join(large, "token").where("i <> j").where(F.size("ti") < F.size("tj")).where(F.size(F.array_except("ti", "tj")) == 0)
    none = F.lit(None).cast("string").alias("note")
    below = within.select(F.col("i").alias("archetype_id"), F.col("j").alias("other_id"), F.lit("subset_of").alias("relation"), none)
    above = within.select(F.col("j").alias("archetype_id"), F.col("i").alias("other_id"), F.lit("superset_of").alias("relation"), none)
    return same.unionByName(below).unionByName(above)


def first_equal(archetypes: DataFrame) -> DataFrame:
    """(archetype_id, same_as): the lowest other archetype with equal common tokens, for those that have a lower one."""
    w = Window.partitionBy("common_tokens")
    low = archetypes.select("archetype_id", "common_tokens", F.min("archetype_id").over(w).alias("same_as"))
    return low.where("same_as < archetype_id").select("archetype_id", "same_as")


def section_runs(archetypes: DataFrame) -> DataFrame:
    """(archetype_id, run, first, last, compression, is_tiled, tile_width, tile_height, role): consecutive sections of equal compression, layout and role."""
    slots = archetypes.select("archetype_id", F.posexplode("skeleton.per_ifd").alias("pos", "x"))
    slots = slots.select("archetype_id", "pos", *[f"x.{k}" for k in SKELETON])
    w = Window.partitionBy("archetype_id").orderBy("pos")
    now = F.struct(*SKELETON)
    changed = F.coalesce(~now.eqNullSafe(F.lag(now).over(w)), F.lit(True)) | (F.col("pos") == 0)
    numbered = slots.withColumn("_c", changed.cast("int")).withColumn("run", F.sum("_c").over(w) - 1)
    runs = numbered.groupBy("archetype_id", "run")
    return runs.agg(F.min("pos").alias("first"), F.max("pos").alias("last"), *[F.first(k).alias(k) for k in SKELETON])
