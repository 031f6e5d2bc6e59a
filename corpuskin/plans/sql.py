"""DuckDB SQL for the queries of :mod:`corpuskin.plans.queries`, over the same tables."""

from __future__ import annotations

_UNITS = r"""
WITH RECURSIVE lines AS (
  SELECT doc_id AS file_id, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 5 WHEN 'fr' THEN 7 WHEN 'es' THEN 8 END AS compression,
    string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT file_id, compression, unnest(ls) AS line, unnest(range(len(ls)))::INTEGER AS unit_index FROM lines
), u0 AS (
  SELECT file_id, 0 AS ifd_index, unit_index, 0 AS kind, compression, strlen(line)::BIGINT AS length, line FROM l
), files AS (
  SELECT doc_id AS file_id, 'doc-' || doc_id AS path, strlen(coalesce(text, ''))::BIGINT AS file_size FROM documents
)"""

_FP = (
    _UNITS
    + r""", w AS (
  SELECT *, hex(encode(line)) AS h,
    list_transform(range(8), lambda i: ((length >> (8 * i)) & 255)::INTEGER) AS le,
    range(1, least(length, 64) + 1) || CASE WHEN length > 128 THEN range(length // 2 + 1, length // 2 + 65) ELSE [] END || CASE WHEN length > 64 THEN range(length - 63, length + 1) ELSE [] END AS ps
  FROM u0
), u AS (
  SELECT * EXCLUDE (h, le, ps, line), line, lower(lpad(hex(list_reduce(
    [14695981039346656037::UHUGEINT, 0] || list_transform(le || CASE WHEN compression IS NULL THEN [] ELSE [compression & 255, compression >> 8] END
      || list_transform(ps, lambda i: (strpos('0123456789ABCDEF', h[2*i-1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2*i]) - 1), lambda x: x::UHUGEINT),
    lambda s, x: (xor(s, x) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT), 16, '0')) AS coarse_fp FROM w
)"""
)

_GROUPS = (
    _FP
    + r""", g AS (
  SELECT kind, compression, length, coarse_fp, count(*) AS n_units, min(file_id) <> max(file_id) AS cross_file, length * (count(*) - 1) AS reusable_bytes
  FROM u GROUP BY kind, compression, length, coarse_fp HAVING count(*) >= 2
), m AS (
  SELECT u.*, g.cross_file FROM u JOIN g ON u.kind = g.kind AND u.compression IS NOT DISTINCT FROM g.compression AND u.length = g.length AND u.coarse_fp = g.coarse_fp
), c AS (
  SELECT kind, compression, length, coarse_fp, sha256(line) AS strong_hash, count(*) AS n_units, min(file_id) <> max(file_id) AS cross_file, length * (count(*) - 1) AS reusable_bytes
  FROM m GROUP BY kind, compression, length, coarse_fp, sha256(line) HAVING count(*) >= 2
), cm AS (
  SELECT m.* EXCLUDE (cross_file), c.cross_file FROM m JOIN c ON m.kind = c.kind AND m.compression IS NOT DISTINCT FROM c.compression AND m.length = c.length AND m.coarse_fp = c.coarse_fp AND sha256(m.line) = c.strong_hash
), fp AS (
  SELECT g.* FROM g ANTI JOIN c ON g.kind = c.kind AND g.compression IS NOT DISTINCT FROM c.compression AND g.length = c.length AND g.coarse_fp = c.coarse_fp
)"""
)


def _totals(table: str, units: str) -> str:
    return f"SELECT count(*) AS groups, coalesce(sum(cross_file::INT), 0)::BIGINT AS cross_file_groups, coalesce(sum(n_units), 0)::BIGINT AS {units}, coalesce(sum(reusable_bytes), 0)::BIGINT AS reusable_bytes"


def _per_file(members: str, prefix: str) -> str:
    return f"""
SELECT f.file_id, coalesce(a.n, 0) AS total_units, coalesce(a.b, 0)::BIGINT AS total_bytes, coalesce(s.n, 0) AS {prefix}_units, coalesce(s.b, 0)::BIGINT AS {prefix}_bytes
FROM files f LEFT JOIN (SELECT file_id, count(*) AS n, sum(length) AS b FROM u GROUP BY 1) a ON f.file_id = a.file_id
LEFT JOIN (SELECT file_id, count(*) AS n, sum(length) AS b FROM {members} WHERE cross_file GROUP BY 1) s ON f.file_id = s.file_id"""


_SCORES = (
    _UNITS
    + r""", held AS (SELECT DISTINCT file_id, kind, compression, length, sha256(line) AS h FROM u0),
e AS (SELECT f.file_id, f.path, coalesce(sum(length), 0)::BIGINT AS eligible_bytes, count(length) AS eligible_units FROM files f LEFT JOIN u0 ON f.file_id = u0.file_id GROUP BY 1, 2),
o AS (
  SELECT x.file_id AS a, y.file_id AS b, sum(x.length)::BIGINT AS shared_bytes, count(*) AS shared_groups FROM held x JOIN held y
  ON x.kind = y.kind AND x.compression IS NOT DISTINCT FROM y.compression AND x.length = y.length AND x.h = y.h AND x.file_id < y.file_id GROUP BY 1, 2
), sc AS (
  SELECT a, b, shared_bytes, ea.eligible_bytes AS eligible_a, eb.eligible_bytes AS eligible_b,
    CASE WHEN greatest(ea.eligible_bytes, eb.eligible_bytes) = 0 THEN 0.0::DOUBLE ELSE shared_bytes::DOUBLE / greatest(ea.eligible_bytes, eb.eligible_bytes) END AS score
  FROM o JOIN e ea ON ea.file_id = o.a JOIN e eb ON eb.file_id = o.b
), ed AS (SELECT a, b, score FROM sc WHERE score >= 0.35), both_ AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed)"""
)

_CLUSTERS = (
    _SCORES
    + r""", r AS (SELECT file_id AS n, file_id AS c FROM files UNION SELECT both_.b, r.c FROM r JOIN both_ ON r.n = both_.a),
k AS (SELECT n AS file_id, min(c) AS c FROM r GROUP BY 1),
cl AS (SELECT file_id, dense_rank() OVER (ORDER BY c) - 1 AS cluster_id FROM k)"""
)

_IFDS = r"""
WITH RECURSIVE i AS (
  SELECT conv_id AS file_id, turn::INTEGER AS ifd_index, length(text)::INTEGER AS width, len(string_split(text, ' '))::INTEGER AS height,
    CASE role WHEN 'user' THEN 7 WHEN 'assistant' THEN 33003 END AS compression, CASE WHEN role = 'assistant' THEN 256 END AS tile_width, CASE WHEN role = 'assistant' THEN 128 + 64 * (conv_id % 2) END AS tile_height,
    len(string_split(text, chr(10)))::INTEGER AS unit_count, CASE WHEN role = 'system' THEN 'macro' END AS role, text AS description FROM conversations
), files AS (
  SELECT conv_id AS file_id, 'conv-' || conv_id AS path, sum(strlen(coalesce(text, '')))::BIGINT AS file_size FROM conversations GROUP BY conv_id
)"""


_DOC_IFDS = r"""
WITH RECURSIVE i AS (
  SELECT doc_id AS file_id, 0 AS ifd_index, length(text)::INTEGER AS width, len(string_split(text, chr(10)))::INTEGER AS height,
    CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 5 WHEN 'fr' THEN 7 WHEN 'es' THEN 8 END AS compression, NULL::INTEGER AS tile_width, NULL::INTEGER AS tile_height,
    1 AS unit_count, NULL::VARCHAR AS role, text AS description FROM documents
)"""


def _label(code: str) -> str:
    names = {1: "uncompressed", 5: "LZW", 7: "JPEG", 8: "deflate", 33003: "JPEG 2000"}
    return f"CASE {code} " + " ".join(f"WHEN {n} THEN '{name} ({n})'" for n, name in names.items()) + " END"


def _bytes(size: str) -> str:
    return f"CASE WHEN {size} < 1024 THEN {size} || ' B' WHEN {size} < 1048576 THEN printf('%.1f KiB', {size} / 1024.0::DOUBLE) WHEN {size} < 1073741824 THEN printf('%.1f MiB', {size} / 1048576.0::DOUBLE) ELSE printf('%.1f GiB', {size} / 1073741824.0::DOUBLE) END"


def _files(n: str) -> str:
    return f"({n} || ' file' || CASE WHEN {n} = 1 THEN '' ELSE 's' END)"


def _letter(n: str) -> str:
    return f"chr((65 + {n} % 26)::INTEGER) || CASE WHEN {n} < 26 THEN '' ELSE ({n} // 26)::VARCHAR END"


def _tokens(source: str, key: str) -> str:
    return rf"""SELECT DISTINCT {key} AS file_id, token FROM (
    SELECT {key}, lower(regexp_replace(word, '[^\p{{L}}\p{{N}}]', '', 'g')) AS token FROM (
      SELECT {key}, unnest(regexp_split_to_array(split_part(part, '=', 1), '\s+')) AS word FROM (
        SELECT {key}, unnest(regexp_split_to_array({source}, '[|;\n\r]')) AS part FROM SRC)))
  WHERE strlen(token) >= 2 AND NOT regexp_full_match(token, '[0-9]+')"""


def _profiles(ifds: str) -> str:
    return (
        ifds
        + ", t AS ("
    + _tokens("description", "file_id").replace("SRC", "i")
    + r"""), tk AS (SELECT file_id, list(token ORDER BY token) AS tokens FROM t GROUP BY file_id),
pre AS (SELECT file_id, ifd_index, trim(split_part(description, '|', 1), E' \t\n\r') AS p FROM i),
pf AS (SELECT file_id, arg_min(p, ifd_index) AS preamble FROM pre WHERE p <> '' GROUP BY file_id),
p AS (
  SELECT i.file_id, count(*) AS ifd_count, list({'x': ifd_index, 'w': width, 'h': height, 'c': compression, 'tw': tile_width, 'r': role} ORDER BY ifd_index) AS ifds,
    list({'c': compression, 't': tile_width IS NOT NULL, 'r': role} ORDER BY ifd_index) AS skel,
    string_agg(coalesce(compression::VARCHAR, '?') || CASE WHEN tile_width IS NULL THEN 's' ELSE 't' END || coalesce(role, ''), ' ' ORDER BY ifd_index) AS shown,
    string_agg(coalesce(compression::VARCHAR, '?') || '/' || coalesce(tile_width || 'x' || tile_height, 's') || '/' || coalesce(role, ''), ' ' ORDER BY ifd_index) AS skeleton FROM i GROUP BY 1
), pp AS (SELECT p.*, coalesce(tk.tokens, []) AS tokens, preamble FROM p LEFT JOIN tk ON p.file_id = tk.file_id LEFT JOIN pf ON p.file_id = pf.file_id)"""
    )


_PROFILES = _profiles(_IFDS)
_DOC_PROFILES = _profiles(_DOC_IFDS)

_DIST = (
    _IFDS
    + r""", d AS (
  SELECT position, field, value, count(*) AS n_files FROM (
    SELECT ifd_index AS position, 'width' AS field, width::VARCHAR AS value FROM i UNION ALL SELECT ifd_index, 'height', height::VARCHAR FROM i
    UNION ALL SELECT ifd_index, 'compression', compression::VARCHAR FROM i UNION ALL SELECT ifd_index, 'tile', tile_width || 'x' || tile_height FROM i) GROUP BY ALL
)"""
)
_VALUE_ORDER = "coalesce(split_part(value, 'x', 1)::BIGINT, -1), coalesce(split_part(value, 'x', -1)::BIGINT, -1)"

_PAIRS = (
    _PROFILES
    + r""", sp0 AS (
  SELECT a.file_id AS a, b.file_id AS b, abs(a.ifd_count - b.ifd_count) AS gap, least(a.ifd_count, b.ifd_count) AS n, a.ifds AS ia, b.ifds AS ib, a.tokens AS ta, b.tokens AS tb
  FROM pp a JOIN pp b ON a.file_id < b.file_id
), sp1 AS (
  SELECT a, b, CASE gap WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS ifd_count_score,
    list_sum(list_transform(range(1, n + 1), lambda k: 0.4::DOUBLE * (ia[k].c IS NOT DISTINCT FROM ib[k].c)::INT
      + 0.3::DOUBLE * CASE WHEN greatest(ia[k].w, ib[k].w) = 0 THEN 1 WHEN least(ia[k].w, ib[k].w) = 0 THEN 0 WHEN greatest(ia[k].w, ib[k].w) / least(ia[k].w, ib[k].w) <= 1.25 THEN 1 ELSE 0 END
      + 0.3::DOUBLE * CASE WHEN greatest(ia[k].h, ib[k].h) = 0 THEN 1 WHEN least(ia[k].h, ib[k].h) = 0 THEN 0 WHEN greatest(ia[k].h, ib[k].h) / least(ia[k].h, ib[k].h) <= 1.25 THEN 1 ELSE 0 END)) / n AS structure_score,
    CASE WHEN len(ta) + len(tb) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(ta, tb))::DOUBLE / (len(ta) + len(tb) - len(list_intersect(ta, tb))) END AS token_score FROM sp0
), sp AS (SELECT *, 0.30::DOUBLE * ifd_count_score + 0.50::DOUBLE * structure_score + 0.20::DOUBLE * token_score AS score FROM sp1)"""
)

_TOKEN_CLUSTERS = (
    _DOC_PROFILES
    + r""", tl AS (
  SELECT a.file_id AS a, b.file_id AS b FROM pp a JOIN pp b ON a.skeleton = b.skeleton AND a.file_id <> b.file_id
  WHERE CASE WHEN len(a.tokens) + len(b.tokens) = 0 THEN 1.0 ELSE len(list_intersect(a.tokens, b.tokens))::DOUBLE / (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens))) END >= 0.5
), r AS (SELECT file_id AS n, file_id AS c FROM pp UNION SELECT tl.b, r.c FROM r JOIN tl ON r.n = tl.a),
tc AS (SELECT n AS file_id, min(c) AS first_file FROM r GROUP BY 1)"""
)

_ARCHETYPES = (
    _TOKEN_CLUSTERS
    + r""", mt AS (SELECT first_file, token, count(*) AS n FROM t JOIN tc ON t.file_id = tc.file_id GROUP BY 1, 2),
b AS (SELECT first_file, count(*) AS n_files, any_value(ifd_count) AS ifd_count, any_value(skel) AS skel FROM tc JOIN pp ON pp.file_id = tc.file_id GROUP BY 1),
ct AS (SELECT b.first_file, list(token ORDER BY token) FILTER (n = n_files) AS c, count(*) FILTER (n < n_files) AS v FROM b JOIN mt ON b.first_file = mt.first_file GROUP BY 1),
x AS (SELECT b.*, coalesce(c, []) AS c, coalesce(v, 0) AS v FROM b LEFT JOIN ct ON b.first_file = ct.first_file),
y AS (SELECT *, list_transform(skel, lambda s: [coalesce(s.c, -1), s.t::INT, (s.r IS NOT NULL)::INT]) AS k FROM x)"""
)

_TURN_SIZES = (
    _PROFILES
    + r""", ls AS (SELECT DISTINCT file_id, (length(description) // 400)::VARCHAR AS w FROM i), fw AS (
  SELECT pp.file_id, any_value(skel) AS skel, any_value(ifd_count) AS ifd_count, list(w ORDER BY w) AS tk FROM pp JOIN ls ON ls.file_id = pp.file_id GROUP BY 1
), eq AS (SELECT a.file_id AS i, b.file_id AS j, a.skel AS si, b.skel AS sj FROM fw a JOIN fw b ON a.file_id < b.file_id AND a.tk = b.tk),
note AS (SELECT i, j, list_filter([CASE WHEN len(sj) <> len(si) THEN 'IFD count ' || CASE WHEN len(sj) > len(si) THEN '+' ELSE '' END || (len(sj) - len(si)) || ' (' || len(sj) || ' vs ' || len(si) || ')' END]
  || flatten(list_transform(range(1, least(len(si), len(sj)) + 1), lambda k: [
    CASE WHEN si[k].c IS DISTINCT FROM sj[k].c THEN 'IFD ' || (k - 1) || ' compression ' || coalesce('Some(' || si[k].c || ')', 'None') || '→' || coalesce('Some(' || sj[k].c || ')', 'None') END,
    CASE WHEN si[k].t <> sj[k].t THEN 'IFD ' || (k - 1) || ' layout ' || CASE WHEN si[k].t THEN 'tiled→strip' ELSE 'strip→tiled' END END])), lambda x: x IS NOT NULL) AS parts FROM eq),
notes AS (SELECT i, j, CASE WHEN len(parts) = 0 THEN 'structural difference' ELSE array_to_string(parts, '; ') END AS note FROM note)"""
)

_RUNS = (
    _PROFILES
    + r""", gr AS (SELECT file_id, min(file_id) OVER (PARTITION BY skeleton) AS group_id FROM p),
ds AS (SELECT group_id, lpad(i.file_id::VARCHAR, 10, '0') AS path, ifd_index, hex(encode(description)) AS h FROM i JOIN gr ON i.file_id = gr.file_id),
lead_ AS (SELECT group_id, ifd_index, h, len(h) // 2 AS n FROM ds WHERE path = lpad(group_id::VARCHAR, 10, '0')),
mem AS (SELECT group_id, ifd_index, count(*) AS members FROM ds GROUP BY ALL),
by_ AS (SELECT d.group_id, d.ifd_index, unnest(range(least(len(d.h) // 2, l.n))) AS pos, d.h AS h FROM ds d JOIN lead_ l ON d.group_id = l.group_id AND d.ifd_index = l.ifd_index),
ag AS (SELECT b.group_id, b.ifd_index, pos FROM (SELECT group_id, ifd_index, pos, count(*) AS n, count(DISTINCT h[2*pos+1:2*pos+2]) AS k FROM by_ GROUP BY ALL) b JOIN mem m ON b.group_id = m.group_id AND b.ifd_index = m.ifd_index WHERE n = members AND k = 1),
isl AS (SELECT *, pos - row_number() OVER (PARTITION BY group_id, ifd_index ORDER BY pos) AS q FROM ag),
runs AS (SELECT group_id, ifd_index, min(pos)::INTEGER AS run_start, (max(pos) + 1)::INTEGER AS run_end FROM isl GROUP BY group_id, ifd_index, q HAVING max(pos) + 1 - min(pos) >= 2),
cut AS (SELECT *, lag(run_end, 1, 0) OVER (PARTITION BY group_id, ifd_index ORDER BY run_start) AS prev FROM runs),
seg AS (
  SELECT c.group_id, c.ifd_index, run_start * 2 + 1 AS o, 'shared' AS kind, l.h[2*run_start+1:2*run_end] AS bytes FROM cut c JOIN lead_ l ON c.group_id = l.group_id AND c.ifd_index = l.ifd_index
  UNION ALL SELECT group_id, ifd_index, run_start * 2, 'gap', NULL FROM cut WHERE run_start > prev
  UNION ALL SELECT l.group_id, l.ifd_index, 2000000000, 'gap', NULL FROM lead_ l LEFT JOIN (SELECT group_id, ifd_index, max(run_end) AS e FROM runs GROUP BY ALL) x ON l.group_id = x.group_id AND l.ifd_index = x.ifd_index WHERE e IS NULL OR e < n
), segs AS (SELECT group_id, ifd_index, (row_number() OVER (PARTITION BY group_id, ifd_index ORDER BY o) - 1)::INTEGER AS seg_no, kind, bytes FROM seg)"""
)

_STATS = (
    _IFDS
    + r""", un AS (SELECT file_id, tile_width, unnest(string_split(description, chr(10))) AS line FROM i),
us AS (SELECT file_id, count(*) FILTER (tile_width IS NOT NULL) AS tile_count, count(*) FILTER (tile_width IS NULL) AS strip_count, sum(strlen(line))::BIGINT AS payload_bytes FROM un GROUP BY 1),
st AS (
  SELECT f.file_id, path, file_size, tile_count, strip_count, payload_bytes, pyramid_levels, roles, tile_sizes, compressions FROM files f JOIN us ON f.file_id = us.file_id JOIN (
    SELECT file_id, count(*) FILTER (role IS NULL) AS pyramid_levels, coalesce(string_agg(role, ',' ORDER BY ifd_index), '') AS roles, coalesce(array_to_string(list_sort(list_distinct(list(tile_width || 'x' || tile_height) FILTER (tile_width IS NOT NULL))), ','), '') AS tile_sizes,
      coalesce(array_to_string(list_sort(list_distinct(list(compression) FILTER (compression IS NOT NULL))), ','), '') AS compressions FROM i GROUP BY 1) x ON f.file_id = x.file_id
)"""
)

_ROLES = r""", r AS (SELECT *, CASE WHEN tile_width IS NULL THEN CASE WHEN contains(lower(description), 'label') THEN 'label' WHEN contains(lower(description), 'macro') THEN 'macro' WHEN ifd_index = 0 THEN 'thumbnail' END END AS r0 FROM i),
o AS (SELECT *, tile_width IS NULL AND r0 IS NULL AS op FROM r),
n AS (SELECT *, count(*) FILTER (op) OVER (PARTITION BY file_id) AS k, count(*) FILTER (r0 IN ('label', 'macro')) OVER (PARTITION BY file_id) AS kn, max(r0) FILTER (r0 IN ('label', 'macro')) OVER (PARTITION BY file_id) AS kr, row_number() OVER (PARTITION BY file_id, op ORDER BY width::BIGINT * height, ifd_index) AS rk FROM o),
roles AS (SELECT file_id, ifd_index, CASE WHEN op AND k = 2 THEN CASE WHEN rk = 1 THEN 'label' ELSE 'macro' END WHEN op AND k = 1 THEN CASE WHEN kn = 1 THEN CASE WHEN kr = 'label' THEN 'macro' ELSE 'label' END END ELSE r0 END AS role FROM n)"""

#: Containers of conversations: numbered by name, spoiled ones left out; payloads stand one after another behind the header.
_SLIDES = (
    _IFDS
    + _ROLES
    + r""", named AS (SELECT conv_id, (row_number() OVER (ORDER BY conv_id) - 1) AS file_id, 'c' || lpad(conv_id::VARCHAR, 10, '0') || '.svs' AS name, conv_id % 3 = 0 AS big FROM (SELECT DISTINCT conv_id FROM conversations)),
sound AS (SELECT * FROM named WHERE conv_id % 11 NOT IN (3, 5, 7)),
su AS (SELECT s.file_id, s.conv_id, big, i.ifd_index, compression, tile_width, string_split(description, chr(10)) AS ls FROM i JOIN sound s ON i.file_id = s.conv_id),
sl AS (SELECT * EXCLUDE (ls), unnest(ls) AS line, unnest(range(len(ls)))::INTEGER AS unit_index FROM su),
unit AS (SELECT sl.file_id, sl.ifd_index, unit_index, CASE WHEN tile_width IS NULL THEN 1 ELSE 0 END AS kind,
  (CASE WHEN big THEN 16 ELSE 8 END + coalesce(sum(strlen(line)) OVER (PARTITION BY sl.file_id ORDER BY sl.ifd_index, unit_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset",
  strlen(line)::BIGINT AS length, compression, role, line FROM sl JOIN roles ON roles.file_id = sl.conv_id AND roles.ifd_index = sl.ifd_index)"""
)

_SLIDE_PRINTS = (
    _SLIDES
    + r""", w AS (SELECT *, hex(encode(line)) AS h, list_transform(range(8), lambda i: ((length >> (8 * i)) & 255)::INTEGER) AS le,
  range(1, least(length, 64) + 1) || CASE WHEN length > 128 THEN range(length // 2 + 1, length // 2 + 65) ELSE [] END || CASE WHEN length > 64 THEN range(length - 63, length + 1) ELSE [] END AS ps FROM unit),
fpu AS (SELECT *, lower(lpad(hex(list_reduce([14695981039346656037::UHUGEINT, kind::UHUGEINT] || list_transform(le || CASE WHEN compression IS NULL THEN [] ELSE [compression & 255, compression >> 8] END
  || list_transform(ps, lambda i: (strpos('0123456789ABCDEF', h[2*i-1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2*i]) - 1), lambda x: x::UHUGEINT),
  lambda s, x: (xor(s, x) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT), 16, '0')) AS coarse_fp FROM w)"""
)

ORACLE_SQL: dict[str, str] = {
    "unit_manifest": _FP + "SELECT * EXCLUDE (line), (coalesce(sum(length + 1) OVER (PARTITION BY file_id ORDER BY unit_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"offset\" FROM u",
    "file_entries": _SCORES + "SELECT * FROM e",
    "candidate_groups": _GROUPS + "SELECT * FROM g",
    "candidate_totals": _GROUPS + _totals("g", "candidate_units") + " FROM g",
    "candidate_per_file": _GROUPS + _per_file("m", "candidate"),
    "confirmed_groups": _GROUPS + "SELECT * FROM c",
    "confirmed_totals": _GROUPS + _totals("c", "confirmed_units") + ", (SELECT count(*) FROM fp) AS false_positive_groups FROM c",
    "confirmed_per_file": _GROUPS + _per_file("cm", "confirmed"),
    "false_positive_groups": _GROUPS + "SELECT * FROM fp",
    "pair_overlaps": _SCORES + "SELECT * FROM o",
    "pair_scores_all": r"""
WITH u AS (SELECT coalesce(regexp_replace(source, '[^0-9]', '', 'g')::BIGINT, -1) AS file_id, strlen(coalesce(text, ''))::BIGINT AS length, sha256(coalesce(text, '')) AS h FROM documents),
e AS (SELECT file_id, sum(length)::BIGINT AS n FROM u GROUP BY 1), held AS (SELECT DISTINCT * FROM u),
o AS (SELECT x.file_id AS a, y.file_id AS b, sum(x.length)::BIGINT AS s FROM held x JOIN held y ON x.h = y.h AND x.length = y.length AND x.file_id < y.file_id GROUP BY 1, 2)
SELECT x.file_id AS a, y.file_id AS b, coalesce(s, 0) AS shared_bytes, x.n AS eligible_a, y.n AS eligible_b, CASE WHEN greatest(x.n, y.n) = 0 THEN 0.0::DOUBLE ELSE coalesce(s, 0)::DOUBLE / greatest(x.n, y.n) END AS score
FROM e x JOIN e y ON x.file_id < y.file_id LEFT JOIN o ON o.a = x.file_id AND o.b = y.file_id""",
    "pair_scores_top": _SCORES + "SELECT * FROM sc ORDER BY score DESC, a, b LIMIT 100",
    "similarity_edges": _SCORES + "SELECT * FROM ed",
    "node_degrees": _SCORES + "SELECT f.file_id, count(both_.b) AS degree FROM files f LEFT JOIN both_ ON both_.a = f.file_id GROUP BY 1",
    "components": _CLUSTERS + "SELECT * FROM cl",
    "cluster_stats": _CLUSTERS
    + r""", pr AS (SELECT x.cluster_id, coalesce(s.score, 0.0::DOUBLE) AS score FROM cl x JOIN cl y ON x.cluster_id = y.cluster_id AND x.file_id < y.file_id LEFT JOIN sc s ON s.a = x.file_id AND s.b = y.file_id)
SELECT cl.cluster_id, count(*) AS member_count, count(*) = 1 AS is_singleton, sum(eligible_bytes)::BIGINT AS total_bytes, any_value(mi) AS min_score, any_value(ma) AS max_score, any_value(av) AS avg_score
FROM cl JOIN e ON e.file_id = cl.file_id LEFT JOIN (SELECT cluster_id, min(score) AS mi, max(score) AS ma, avg(score) AS av FROM pr GROUP BY 1) q ON q.cluster_id = cl.cluster_id GROUP BY 1""",
    "profiles": _PROFILES + "SELECT file_id, ifd_count, len(tokens)::INTEGER AS n_tokens, array_to_string(tokens, ' ') AS tokens, preamble AS description_preamble FROM pp",
    "description_tokens": _tokens("text", "doc_id").replace("SRC", "documents"),
    "token_freq": _PROFILES + "SELECT token, count(*) AS n_files FROM t GROUP BY 1",
    "common_tokens": _PROFILES + "SELECT token, count(*) AS n_files FROM t GROUP BY 1 HAVING count(*) >= 5 ORDER BY 2 DESC, 1",
    "unique_tokens": _PROFILES + "SELECT token FROM t GROUP BY 1 HAVING count(*) = 1 ORDER BY 1",
    "preamble_freq": _DOC_PROFILES + "SELECT preamble, count(*) AS n_files FROM pf GROUP BY 1",
    "ifd_count_dist": _PROFILES + "SELECT ifd_count, count(*) AS n_files FROM p GROUP BY 1",
    "position_dist": _DIST + "SELECT * FROM d",
    "mode_ifd_count": _PROFILES + "SELECT ifd_count, count(*) AS n_files FROM p GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 1",
    "edge_count": _SCORES + "SELECT count(*) AS n_edges FROM ed",
    "position_modes": _DIST + f"SELECT position, field, value, n_files FROM d QUALIFY row_number() OVER (PARTITION BY position, field ORDER BY n_files DESC, {_VALUE_ORDER.replace(', coalesce', ' DESC, coalesce')} DESC) = 1",
    "dist_top3": _DIST + f"SELECT *, row_number() OVER (PARTITION BY position, field ORDER BY n_files DESC, {_VALUE_ORDER})::INTEGER AS rank, greatest(count(*) OVER (PARTITION BY position, field) - 3, 0) AS more FROM d QUALIFY rank <= 3",
    "structural_signature": _IFDS + "SELECT file_id, 'n=' || count(*) || ' ' || string_agg('[' || ifd_index || ':' || width || 'x' || height || '/c=' || coalesce(compression::VARCHAR, '?') || '/' || CASE WHEN tile_width IS NULL THEN 'strip' ELSE 'tiled=' || tile_width || 'x' || tile_height END || ']', ' ' ORDER BY ifd_index) AS signature FROM i GROUP BY 1",
    "structural_pairs": _PAIRS + "SELECT * FROM sp",
    "structural_pairs_min_score": _PAIRS + "SELECT * FROM sp WHERE score >= 0.6 ORDER BY score DESC, a, b LIMIT 200",
    "skeleton_groups": _PROFILES + "SELECT min(file_id) AS first_file, count(*) AS n_files, any_value(shown) AS skeleton FROM p GROUP BY skeleton",
    "token_clusters": _TOKEN_CLUSTERS + "SELECT * FROM tc",
    "archetypes": _ARCHETYPES + "SELECT row_number() OVER (ORDER BY n_files DESC, ifd_count, len(c), k, first_file) - 1 AS archetype_id, n_files, first_file, ifd_count, array_to_string(c, ' ') AS common_tokens, v::INTEGER AS n_variable FROM y",
    "archetype_relations": _TURN_SIZES
    + r"""SELECT i AS archetype_id, j AS other_id, 'same_tokens' AS relation FROM eq UNION ALL SELECT j, i, 'same_tokens' FROM eq
UNION ALL SELECT a.file_id, b.file_id, 'subset_of' FROM fw a JOIN fw b ON a.file_id <> b.file_id WHERE len(a.tk) > 0 AND len(a.tk) < len(b.tk) AND len(list_intersect(a.tk, b.tk)) = len(a.tk)
UNION ALL SELECT b.file_id, a.file_id, 'superset_of' FROM fw a JOIN fw b ON a.file_id <> b.file_id WHERE len(a.tk) > 0 AND len(a.tk) < len(b.tk) AND len(list_intersect(a.tk, b.tk)) = len(a.tk)""",
    "skeleton_diff_notes": _TURN_SIZES + "SELECT i AS archetype_id, j AS other_id, note FROM notes UNION ALL SELECT j, i, note FROM notes",
    "same_as": _TURN_SIZES + "SELECT j AS archetype_id, min(i) AS same_as FROM eq GROUP BY j",
    "ifd_runs": _IFDS
    + r""", s AS (SELECT *, tile_width IS NOT NULL AS is_tiled FROM i),
c AS (SELECT *, CASE WHEN lag(file_id) OVER w IS NULL OR lag(compression) OVER w IS DISTINCT FROM compression OR lag(is_tiled) OVER w IS DISTINCT FROM is_tiled OR lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS ch, row_number() OVER w - 1 AS pos FROM s WINDOW w AS (PARTITION BY file_id ORDER BY ifd_index)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY file_id ORDER BY pos) - 1 AS run FROM c)
SELECT file_id AS archetype_id, run::BIGINT AS run, min(pos)::INTEGER AS first, max(pos)::INTEGER AS last, any_value(compression) AS compression, any_value(is_tiled) AS is_tiled, any_value(tile_width) AS tile_width, any_value(tile_height) AS tile_height, any_value(role) AS role FROM r GROUP BY file_id, run""",
    "label_macro_roles": _IFDS + _ROLES + "SELECT * FROM roles",
    "file_stats": _STATS + "SELECT * FROM st",
    "corpus_totals": _STATS + "SELECT count(*) AS files, sum(file_size)::BIGINT AS total_bytes, sum(tile_count)::BIGINT AS tiles, sum(strip_count)::BIGINT AS strips, sum(payload_bytes)::BIGINT AS payload_bytes, greatest(sum(file_size) - sum(payload_bytes), 0)::BIGINT AS overhead_bytes FROM st",
    "compression_files": _IFDS + "SELECT compression, count(DISTINCT file_id) AS n_files FROM i WHERE compression IS NOT NULL GROUP BY 1",
    "geometry_files": _IFDS + "SELECT tile_width || 'x' || tile_height AS tile_size, count(DISTINCT file_id) AS n_files FROM i WHERE tile_width IS NOT NULL GROUP BY 1",
    "ambiguous_strips": _IFDS + "SELECT file_id, ifd_index FROM (SELECT *, count(*) OVER (PARTITION BY file_id) AS n FROM i) WHERE role IS NULL AND tile_width IS NULL AND NOT contains(lower(description), 'label') AND NOT contains(lower(description), 'macro') AND unit_count > 0 AND n >= 4 AND ifd_index > 0",
    "file_size_range": _UNITS + "SELECT min(file_size) AS min_size, max(file_size) AS max_size FROM files",
    "shared_runs": _RUNS + "SELECT * FROM runs",
    "arch_segments": _RUNS + "SELECT * FROM segs",
    "arch_bytes": _RUNS + "SELECT group_id, lower(string_agg(CASE WHEN kind = 'gap' THEN 'FFFFFFFF' ELSE array_to_string(list_transform(range(4), lambda k: lpad(hex(((len(bytes) // 2) >> (8 * k)) & 255), 2, '0')), '') || bytes END, '' ORDER BY ifd_index, seg_no)) AS bytes FROM segs GROUP BY 1",
    "compression_labels": _IFDS + "SELECT compression, CASE compression WHEN 7 THEN 'JPEG (7)' WHEN 33003 THEN 'JPEG 2000 (33003)' END AS label, count(*) AS n FROM i GROUP BY 1",
    "size_labels": _UNITS + "SELECT file_id, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.1f KiB', s / 1024.0::DOUBLE) WHEN s < 1073741824 THEN printf('%.1f MiB', s / 1048576.0::DOUBLE) ELSE printf('%.1f GiB', s / 1073741824.0::DOUBLE) END AS size FROM (SELECT file_id, file_size * 1000 AS s FROM files)",
    "unit_kinds": _STATS + "SELECT CASE WHEN tile_width IS NULL THEN 'strip' ELSE 'tile' END AS kind, count(*) AS n_units, sum(strlen(line))::BIGINT AS bytes FROM un GROUP BY 1",
    "slide_files": _SLIDES + "SELECT s.file_id, name, CASE WHEN conv_id % 2 = 0 THEN 'II' ELSE 'MM' END AS byte_order, big, n::INTEGER AS ifd_count FROM sound s JOIN (SELECT conv_id AS c, count(*) AS n FROM conversations GROUP BY 1) ON c = conv_id",
    "slide_errors": _SLIDES + "SELECT name, 'SlideError: ' || CASE conv_id % 11 WHEN 3 THEN 'unsupported magic number 99' WHEN 5 THEN 'unknown byte order 0xcdab' ELSE 'over 1024 sections' END AS error FROM named WHERE conv_id % 11 IN (3, 5, 7)",
    "slide_ifds": _SLIDES + "SELECT s.file_id, i.ifd_index, width::BIGINT AS width, height::BIGINT AS height, compression, tile_width::BIGINT AS tile_width, tile_height::BIGINT AS tile_height, unit_count, roles.role, description, hex(encode(description)) || '00' AS raw FROM i JOIN sound s ON i.file_id = conv_id JOIN roles ON roles.file_id = conv_id AND roles.ifd_index = i.ifd_index",
    "slide_units": _SLIDES + "SELECT * EXCLUDE (line) FROM unit",
    "slide_manifest": _SLIDE_PRINTS + "SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY ifd_index, unit_index) - 1)::INTEGER AS idx, ifd_index, unit_index, kind, \"offset\", length, compression, coarse_fp FROM fpu",
    "slide_confirmed": _GROUPS + "SELECT * FROM c",
    "inspect_lines": _SLIDES
    + rf""", secs AS (SELECT s.file_id, i.* EXCLUDE (file_id, role), roles.role FROM i JOIN sound s ON i.file_id = conv_id JOIN roles ON roles.file_id = conv_id AND roles.ifd_index = i.ifd_index)
SELECT s.file_id, -1 AS ifd_index, 0 AS part, unnest(range(4))::INTEGER AS n, unnest(['file:       ' || name, 'byte order: ' || CASE WHEN conv_id % 2 = 0 THEN 'little-endian' ELSE 'big-endian' END, 'tiff:       ' || CASE WHEN big THEN 'BigTIFF (43)' ELSE 'classic (42)' END,
  'IFD count:  ' || (SELECT count(*) FROM conversations c WHERE c.conv_id = s.conv_id)]) AS line FROM sound s
UNION ALL SELECT file_id, ifd_index, 1, 0, '  IFD[' || ifd_index || ']  ' || width || '×' || height || '  ' || CASE WHEN tile_width IS NULL THEN 'strip  ' || unit_count || ' strips' ELSE 'tile ' || tile_width || '×' || tile_height || '  ' || unit_count || ' tiles' END
  || coalesce('  ' || {_label("compression")}, '') || coalesce('  [associated: ' || role || ']', '') FROM secs
UNION ALL SELECT file_id, ifd_index, 2, 0, '    description: ' || CASE WHEN length(description) > 80 THEN left(description, 80) || '…' ELSE description END FROM secs WHERE description <> ''
UNION ALL SELECT file_id, ifd_index, 3, unit_index, printf('    unit[%4d]  offset=%-12d  length=%d', unit_index, "offset", length) FROM unit WHERE unit_index < 8
UNION ALL SELECT file_id, ifd_index, 4, 0, '    … ' || (unit_count - 8) || ' more units' FROM secs WHERE unit_count > 8""",
    "unit_lines": _SLIDE_PRINTS
    + rf""", nu AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ifd_index, unit_index) - 1 AS idx FROM fpu)
SELECT file_id, idx::INTEGER AS idx, printf('%6d  %4d  %5d  %-10s  %14d  %12d  %16s  %s', idx, ifd_index, unit_index, CASE kind WHEN 0 THEN 'tile' ELSE 'strip' END, "offset", length, coarse_fp, coalesce({_label("compression")}, 'none')) AS line FROM nu""",
    "unit_json": _SLIDE_PRINTS
    + """, nu AS (SELECT *, (row_number() OVER (PARTITION BY file_id ORDER BY ifd_index, unit_index) - 1)::INTEGER AS idx FROM fpu)
SELECT file_id, idx, to_json({'idx': idx, 'ifd_index': ifd_index, 'unit_index': unit_index, 'kind': CASE kind WHEN 0 THEN 'tile' ELSE 'strip' END, 'offset': "offset", 'length': length, 'compression': compression, 'role': role, 'coarse_fp': coarse_fp})::VARCHAR AS json FROM nu""",
    "pair_json": _PAIRS
    + """SELECT a, b, '{"file_a":"conv-' || a || '","file_b":"conv-' || b || '","score":' || round(score, 6)::DECIMAL(9,6) || ',"ifd_count":' || round(ifd_count_score, 4)::DECIMAL(9,4)
  || ',"structure":' || round(structure_score, 4)::DECIMAL(9,4) || ',"description":' || round(token_score, 4)::DECIMAL(9,4) || '}' AS json FROM sp""",
    "stats_lines": _STATS
    + rf""", ic AS (SELECT file_id, count(*) AS n FROM i GROUP BY 1),
tot AS (SELECT count(*) AS files, (SELECT count(*) FROM i) AS secs, sum(tile_count)::BIGINT AS t, sum(strip_count)::BIGINT AS s, sum(payload_bytes)::BIGINT AS p, sum(file_size)::BIGINT AS f, greatest(sum(file_size) - sum(payload_bytes), 0)::BIGINT AS o FROM st)
SELECT 0 AS part, path AS key, printf('%s %9s  %5d  %6d  %8d  %7d  %s', rpad(left(path, 28), 28, ' '), {_bytes("file_size")}, n, pyramid_levels, tile_count, strip_count, replace(roles, ',', ' ')) AS line FROM st JOIN ic ON ic.file_id = st.file_id
UNION ALL SELECT 1, lpad(compression::VARCHAR, 10, '0'), printf('  %-30s %2s', {_label("compression")}, {_files("n")}) FROM (SELECT compression, count(DISTINCT file_id) AS n FROM i WHERE compression IS NOT NULL GROUP BY 1)
UNION ALL SELECT 2, lpad(w, 10, '0') || 'x' || lpad(h, 10, '0'), '  ' || lpad(w, 4, ' ') || '×' || rpad(h, 4, ' ') || '  ' || {_files("n")} FROM (SELECT tile_width::VARCHAR AS w, tile_height::VARCHAR AS h, count(DISTINCT file_id) AS n FROM i WHERE tile_width IS NOT NULL GROUP BY 1, 2)
UNION ALL SELECT 3, unnest(range(8))::VARCHAR, unnest(['files:                ' || files, '  total IFDs:           ' || secs, '  total data units:     ' || (t + s), '    tiles:              ' || t, '    strips:             ' || s,
  '  total payload bytes:  ' || {_bytes("p")}, '  total file size:      ' || {_bytes("f")}, '  metadata overhead:    ' || {_bytes("o")}]) FROM tot""",
    "archetype_lines": _ARCHETYPES
    + rf""", ar AS (SELECT row_number() OVER (ORDER BY n_files DESC, ifd_count, len(c), k, first_file) - 1 AS id, * FROM y),
sm AS (SELECT a.id, (SELECT min(b.id) FROM ar b WHERE b.id <> a.id AND b.c = a.c) AS other FROM ar a)
SELECT id AS archetype_id, 0 AS part, 0 AS n, '  archetype ' || {_letter("id")} || '  (' || {_files("n_files")} || ', ' || ifd_count || ' IFDs)' AS line FROM ar
UNION ALL SELECT id, 1, 0, '    IFD 0:  ' || coalesce({_label("skel[1].c")}, 'untagged') || '  strip' FROM ar
UNION ALL SELECT ar.id, 2, 0, CASE WHEN len(c) = 0 AND v = 0 THEN '    tokens: (none)' ELSE '    tokens (' || len(c) || ' common): ' || CASE WHEN other IS NOT NULL THEN '[same as ' || {_letter("other")} || ']' ELSE array_to_string(c[1:12], ', ') || CASE WHEN len(c) > 12 THEN ', +' || (len(c) - 12) || ' more' ELSE '' END END END FROM ar JOIN sm ON sm.id = ar.id
UNION ALL SELECT id, 3, 0, '    tokens (' || v || ' variable, not shown)' FROM ar WHERE v > 0""",
}
