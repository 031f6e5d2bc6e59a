"""The registered queries of the engine's operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskin.functions.labels import compression_label, format_size, kind_label
from corpuskin.operators import archetype as at
from corpuskin.operators import archive, corpus, dedup, graph, overlap, reports, stats, structural
from corpuskin.operators import profile as pr
from corpuskin.plans.shared import materialize
from corpuskin.sources import slides, tables
from corpuskin.sources.writer import write_slides


def _candidates(spark: SparkSession, d: str, payload: bool = False) -> tuple[dedup.Report, DataFrame, DataFrame]:
    """Payloads only where content is confirmed; the fingerprints, which several aggregates read, are computed once."""
    files, units = tables.document_files(spark, d), tables.document_lines(spark, d)
    units = materialize(units if payload else units.drop("payload"), "units")
    return dedup.find_candidates(units, files), units, files


def _confirmed(spark: SparkSession, d: str) -> tuple[dedup.Report, dedup.Report, DataFrame, DataFrame]:
    candidates, units, files = _candidates(spark, d, payload=True)
    return dedup.confirm_candidates(candidates, units, files), candidates, units, files


def unit_manifest(spark: SparkSession, d: str) -> DataFrame:
    return tables.with_offsets(tables.document_lines(spark, d)).drop("payload")


def file_entries(spark: SparkSession, d: str) -> DataFrame:
    return overlap.file_entries(tables.document_files(spark, d), tables.document_lines(spark, d, fingerprints=False))


def candidate_groups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.in_order(_candidates(spark, d)[0].groups)


def candidate_totals(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d)[0].totals


def candidate_per_file(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d)[0].per_file.drop("path", "file_size")


def confirmed_groups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.in_order(_confirmed(spark, d)[0].groups)


def confirmed_totals(spark: SparkSession, d: str) -> DataFrame:
    return _confirmed(spark, d)[0].totals


def confirmed_per_file(spark: SparkSession, d: str) -> DataFrame:
    return _confirmed(spark, d)[0].per_file.drop("path", "file_size")


def false_positive_groups(spark: SparkSession, d: str) -> DataFrame:
    confirmed, candidates, _, _ = _confirmed(spark, d)
    return dedup.false_positives(candidates, confirmed)


def _members(spark: SparkSession, d: str) -> tuple[DataFrame, list[str], DataFrame, DataFrame]:
    """(lines with their hashes, their group key, entries, files). Content alone decides: equal bytes have equal samples."""
    files, units = tables.document_files(spark, d), tables.document_lines(spark, d, fingerprints=False)
    groups = [k for k in dedup.KEY if k != "coarse_fp"] + ["strong_hash"]
    return units.withColumn("strong_hash", F.sha2("payload", 256)).drop("payload"), groups, overlap.file_entries(files, units), files


def pair_overlaps(spark: SparkSession, d: str) -> DataFrame:
    members, groups, _, _ = _members(spark, d)
    return overlap.pair_overlaps(members, groups)


def pair_scores_all(spark: SparkSession, d: str) -> DataFrame:
    files, units = tables.source_files(spark, d)
    overlaps = overlap.pair_overlaps(units, ["length", "strong_hash"])
    return overlap.score_pairs(overlap.file_entries(files, units), overlaps, exhaustive=True)


def pair_scores_top(spark: SparkSession, d: str) -> DataFrame:
    members, groups, entries, _ = _members(spark, d)
    return overlap.best_similar_pairs(entries, members, groups, 100)


def similarity_edges(spark: SparkSession, d: str) -> DataFrame:
    members, groups, entries, _ = _members(spark, d)
    return graph.similarity_edges(overlap.similar_pairs(entries, members, groups))


def node_degrees(spark: SparkSession, d: str) -> DataFrame:
    files = tables.document_files(spark, d)
    edges = materialize(similarity_edges(spark, d), "similar")
    return graph.node_degrees(graph.graph_nodes(files, edges), edges)


def edge_count(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_count(similarity_edges(spark, d))


def components(spark: SparkSession, d: str) -> DataFrame:
    files = tables.document_files(spark, d)
    edges = materialize(similarity_edges(spark, d), "similar")
    return graph.clusters(graph.graph_nodes(files, edges), edges)


def cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    """Scores within clusters only, of pairs below the graph's threshold too."""
    members, groups, entries, _ = _members(spark, d)
    placed = materialize(components(spark, d), "clusters")
    scores = overlap.score_pairs(entries, overlap.pair_overlaps_within(members, groups, placed))
    return graph.cluster_stats(placed, entries, scores)


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    return pr.build_profiles(tables.conversation_ifds(spark, d))


def _document_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of which many are alike: documents and their copies."""
    return pr.build_profiles(tables.document_ifds(spark, d))


def profiles(spark: SparkSession, d: str) -> DataFrame:
    p = _profiles(spark, d)
    return p.select("file_id", "ifd_count", F.size("description_tokens").alias("n_tokens"), F.array_join("description_tokens", " ").alias("tokens"), "description_preamble")


def description_tokens(spark: SparkSession, d: str) -> DataFrame:
    from corpuskin.functions.labels import description_tokens as tokens

    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.col("doc_id").alias("file_id"), F.explode(tokens(F.col("text"))).alias("token"))


def token_freq(spark: SparkSession, d: str) -> DataFrame:
    return corpus.token_frequencies(_profiles(spark, d))


def common_tokens(spark: SparkSession, d: str) -> DataFrame:
    return corpus.common_tokens(token_freq(spark, d), 5)


def unique_tokens(spark: SparkSession, d: str) -> DataFrame:
    return corpus.unique_tokens(token_freq(spark, d))


def preamble_freq(spark: SparkSession, d: str) -> DataFrame:
    return corpus.preamble_frequencies(_document_profiles(spark, d))


def ifd_count_dist(spark: SparkSession, d: str) -> DataFrame:
    return corpus.ifd_count_distribution(_profiles(spark, d))


def mode_ifd_count(spark: SparkSession, d: str) -> DataFrame:
    return corpus.mode_ifd_count(ifd_count_dist(spark, d))


def position_dist(spark: SparkSession, d: str) -> DataFrame:
    return corpus.position_distributions(_profiles(spark, d))


def position_modes(spark: SparkSession, d: str) -> DataFrame:
    return corpus.position_modes(position_dist(spark, d))


def dist_top3(spark: SparkSession, d: str) -> DataFrame:
    return corpus.top_values(position_dist(spark, d))


def structural_signature(spark: SparkSession, d: str) -> DataFrame:
    return pr.structural_signature(_profiles(spark, d))


def structural_pairs(spark: SparkSession, d: str) -> DataFrame:
    return structural.score_profiles(materialize(_profiles(spark, d), "profiles"))


def structural_pairs_min_score(spark: SparkSession, d: str) -> DataFrame:
    return structural.best_profile_pairs(materialize(_profiles(spark, d), "profiles"), n=200, least=0.6)


def pair_json(spark: SparkSession, d: str) -> DataFrame:
    names = tables.conversation_files(spark, d).select("file_id", F.col("path").alias("name"))
    return reports.all_pairs_json(materialize(_profiles(spark, d).drop("description_preamble"), "profiles"), names)


def skeleton_groups(spark: SparkSession, d: str) -> DataFrame:
    g = at.skeleton_groups(_profiles(spark, d))
    per = F.transform("skeleton.per_ifd", lambda x: F.concat(F.coalesce(x["compression"].cast("string"), F.lit("?")), F.when(x["is_tiled"], "t").otherwise("s"), F.coalesce(x["role"], F.lit(""))))
    return g.select("first_file", "n_files", F.array_join(per, " ").alias("skeleton"))


def token_clusters(spark: SparkSession, d: str) -> DataFrame:
    return at.token_clusters(materialize(_token_profiles(spark, d), "profiles"))


def _token_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Without preambles, which are most of the text where descriptions have no bars."""
    return _document_profiles(spark, d).drop("description_preamble")


def archetypes(spark: SparkSession, d: str) -> DataFrame:
    found, _ = at.derive_archetypes(materialize(_token_profiles(spark, d), "profiles"))
    return found.select("archetype_id", "n_files", "first_file", F.col("skeleton.ifd_count").alias("ifd_count"), F.array_join("common_tokens", " ").alias("common_tokens"), F.size("variable_tokens").alias("n_variable"))


def archetype_relations(spark: SparkSession, d: str) -> DataFrame:
    return at.archetype_relations(_turn_sizes(spark, d)).drop("note")


def archetype_lines(spark: SparkSession, d: str) -> DataFrame:
    found, _ = at.derive_archetypes(materialize(_token_profiles(spark, d), "profiles"))
    return reports.archetype_lines(materialize(found, "archetypes"))


def _turn_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Archetype-shaped rows of which many are related: a conversation, with its turns' lengths in hundreds of characters, four at a time, as tokens."""
    ifds = tables.conversation_ifds(spark, d)
    sizes = ifds.groupBy("file_id").agg(F.array_sort(F.collect_set(F.floor(F.length("description") / 400).cast("string"))).alias("common_tokens"))
    rows = at.skeletons(pr.build_profiles(ifds)).join(sizes, "file_id")
    return materialize(rows.select(F.col("file_id").alias("archetype_id"), "skeleton", "common_tokens"), "turn-sizes")


def skeleton_diff_notes(spark: SparkSession, d: str) -> DataFrame:
    return at.archetype_relations(_turn_sizes(spark, d)).where("relation = 'same_tokens'").select("archetype_id", "other_id", "note")


def same_as(spark: SparkSession, d: str) -> DataFrame:
    return at.first_equal(_turn_sizes(spark, d))


def ifd_runs(spark: SparkSession, d: str) -> DataFrame:
    return at.section_runs(at.skeletons(_profiles(spark, d)).withColumnRenamed("file_id", "archetype_id"))


def label_macro_roles(spark: SparkSession, d: str) -> DataFrame:
    """Turns as strips without a role unless their text names one."""
    ifds = tables.conversation_ifds(spark, d)
    marked = ifds.withColumn("role", pr.detect_role(F.col("tile_width").isNull(), F.when(F.col("ifd_index") == 0, 0), F.col("description")))
    return pr.resolve_label_macro(marked).select("file_id", "ifd_index", "role")


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.file_stats(tables.conversation_files(spark, d), tables.conversation_ifds(spark, d), tables.conversation_units(spark, d))


def file_stats(spark: SparkSession, d: str) -> DataFrame:
    s = _stats(spark, d)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return s.select(*[c for c in s.columns if c not in ("roles", "tile_sizes", "compressions")], text("roles"), text("tile_sizes"), text("compressions"))


def stats_lines(spark: SparkSession, d: str) -> DataFrame:
    return reports.stats_lines(_stats(spark, d), tables.conversation_ifds(spark, d))


def corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    return stats.corpus_totals(_stats(spark, d))


def compression_files(spark: SparkSession, d: str) -> DataFrame:
    return stats.compression_files(_stats(spark, d))


def geometry_files(spark: SparkSession, d: str) -> DataFrame:
    return stats.geometry_files(_stats(spark, d))


def ambiguous_strips(spark: SparkSession, d: str) -> DataFrame:
    return stats.ambiguous_strips(tables.conversation_ifds(spark, d)).select("file_id", "ifd_index")


def file_size_range(spark: SparkSession, d: str) -> DataFrame:
    return corpus.size_range(tables.document_files(spark, d))


def _by_skeleton(spark: SparkSession, d: str) -> DataFrame:
    rows = at.skeletons(_profiles(spark, d))
    first = rows.groupBy("skeleton").agg(F.min("file_id").alias("group_id"))
    return tables.conversation_descriptions(spark, d, rows.select("file_id", "skeleton").join(first, "skeleton"))


def shared_runs(spark: SparkSession, d: str) -> DataFrame:
    return archive.shared_runs(_by_skeleton(spark, d), 2)


def arch_segments(spark: SparkSession, d: str) -> DataFrame:
    s = archive.segments(_by_skeleton(spark, d), 2)
    return s.select("group_id", "ifd_index", "seg_no", "kind", F.hex("bytes").alias("bytes"))


def arch_bytes(spark: SparkSession, d: str) -> DataFrame:
    return archive.archetype_bytes(_by_skeleton(spark, d), 2).select("group_id", F.lower(F.hex("bytes")).alias("bytes"))


def compression_labels(spark: SparkSession, d: str) -> DataFrame:
    return tables.conversation_ifds(spark, d).groupBy("compression").agg(F.count("*").alias("n")).select("compression", compression_label(F.col("compression")).alias("label"), "n")


def size_labels(spark: SparkSession, d: str) -> DataFrame:
    return tables.document_files(spark, d).select("file_id", format_size(F.col("file_size") * 1000).alias("size"))


def unit_kinds(spark: SparkSession, d: str) -> DataFrame:
    return tables.conversation_units(spark, d).groupBy(kind_label(F.col("kind")).alias("kind")).agg(F.count("*").alias("n_units"), F.sum("length").alias("bytes"))


def _slides(spark: SparkSession, d: str) -> str:
    """A folder of containers, one per conversation, some of them spoiled: sections are its turns, units their lines."""
    ifds = tables.conversation_ifds(spark, d)
    bad = F.when(F.col("file_id") % 11 == 3, "magic").when(F.col("file_id") % 11 == 5, "order").when(F.col("file_id") % 11 == 7, "cycle")
    sections = ifds.select(
        F.concat(F.lit("c"), F.lpad(F.col("file_id").cast("string"), 10, "0"), F.lit(".svs")).alias("name"),
        (F.col("file_id") % 3 == 0).alias("big"),
        F.when(F.col("file_id") % 2 == 0, "<").otherwise(">").alias("order"),
        bad.alias("broken"),
        "ifd_index", "width", "height", "compression", "tile_width", "tile_height",
        F.when(F.col("ifd_index") == 0, 0).otherwise(1).alias("subfile_type"),
        "description",
        F.transform(F.split("description", "\n", -1), lambda x: x.cast("binary")).alias("payloads"),
    )
    return write_slides(sections, "broken")


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return slides.read_slides(spark, _slides(spark, d), table, filesPerPartition="8")


def _name():
    return F.substring_index("path", "/", -1).alias("name")


def slide_files(spark: SparkSession, d: str) -> DataFrame:
    return slides.with_rows(_read(spark, d, "files")).select("file_id", _name(), "byte_order", "big", "ifd_count")


def slide_errors(spark: SparkSession, d: str) -> DataFrame:
    return slides.warnings(_read(spark, d, "ifds")).select(_name(), "error")


def slide_ifds(spark: SparkSession, d: str) -> DataFrame:
    rows = slides.with_rows(_read(spark, d, "ifds"))
    return rows.select("file_id", "ifd_index", "width", "height", "compression", "tile_width", "tile_height", "unit_count", "role", "description", F.hex("raw_description").alias("raw"))


def slide_units(spark: SparkSession, d: str) -> DataFrame:
    return slides.with_rows(_read(spark, d, "units")).drop("path", "file_size")


def slide_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints by ranged reads of the units' positions."""
    units = slides.with_rows(_read(spark, d, "units"))
    idx = F.row_number().over(Window.partitionBy("file_id").orderBy("ifd_index", "unit_index")) - 1
    return slides.with_prints(units).select("file_id", idx.alias("idx"), "ifd_index", "unit_index", "kind", "offset", "length", "compression", "coarse_fp")


def inspect_lines(spark: SparkSession, d: str) -> DataFrame:
    folder = _slides(spark, d)
    files, ifds, units = (slides.with_rows(slides.read_slides(spark, folder, t, filesPerPartition="8")) for t in ("files", "ifds", "units"))
    return reports.inspect_lines(files.withColumn("path", F.substring_index("path", "/", -1)), ifds, units)


def unit_lines(spark: SparkSession, d: str) -> DataFrame:
    return reports.unit_lines(slides.with_rows(_read(spark, d, "manifest")))


def unit_json(spark: SparkSession, d: str) -> DataFrame:
    return reports.unit_json(slides.with_rows(_read(spark, d, "manifest")))


def slide_confirmed(spark: SparkSession, d: str) -> DataFrame:
    """Groups of equal tiles of containers, one per document with its lines as tiles: only candidates' bytes are hashed."""
    docs = tables.document_ifds(spark, d)
    none = F.lit(None)
    sections = docs.select(
        F.concat(F.lit("d"), F.lpad(F.col("file_id").cast("string"), 10, "0"), F.lit(".svs")).alias("name"),
        (F.col("file_id") % 2 == 0).alias("big"),
        F.lit("<").alias("order"),
        F.lit(0).alias("ifd_index"), F.lit(1).alias("width"), F.lit(1).alias("height"), "compression", F.lit(1).alias("tile_width"), F.lit(1).alias("tile_height"),
        none.cast("int").alias("subfile_type"), none.cast("string").alias("description"),
        F.transform(F.split(F.coalesce("description", F.lit("")), "\n", -1), lambda x: x.cast("binary")).alias("payloads"),
    )
    units = materialize(slides.with_rows(slides.read_slides(spark, write_slides(sections), "manifest", filesPerPartition="64")), "manifest")
    files = units.select("file_id", "path", "file_size").distinct()
    found = dedup.confirm_candidates(dedup.find_candidates(units, files), units, files, read=slides.with_hashes)
    return dedup.in_order(found.groups)


QUERIES = {
    f.__name__: f
    for f in (
        unit_manifest, file_entries, candidate_groups, candidate_totals, candidate_per_file, confirmed_groups, confirmed_totals,
        confirmed_per_file, false_positive_groups, pair_overlaps, pair_scores_all, pair_scores_top, similarity_edges, node_degrees,
        components, cluster_stats, profiles, description_tokens, token_freq, common_tokens, unique_tokens, preamble_freq,
        ifd_count_dist, mode_ifd_count, edge_count, position_dist, position_modes, dist_top3, structural_signature, structural_pairs,
        structural_pairs_min_score, skeleton_groups, token_clusters, archetypes, archetype_relations, skeleton_diff_notes, same_as,
        ifd_runs, label_macro_roles, file_stats, corpus_totals, compression_files, geometry_files, ambiguous_strips,
        file_size_range, shared_runs, arch_segments, arch_bytes, compression_labels, size_labels, unit_kinds,
        slide_files, slide_errors, slide_ifds, slide_units, slide_manifest, slide_confirmed, inspect_lines, unit_lines, unit_json, pair_json, stats_lines, archetype_lines,
    )
}
