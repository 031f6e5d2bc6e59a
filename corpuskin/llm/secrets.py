"""Secret scanning over a trigram inverted index. DataFrame functions only.

Each rule's regular expression gives a Boolean query over trigrams that any match must contain. Postings (trigram,
document) for the trigrams of the rules are intersected clause by clause, and only the documents that satisfy a rule's
query have the rule's expression run on them. A rule without mandatory trigrams runs on every text.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskin.llm.textcols import fresh, let, prefix_sums

#: Trigrams that a clause asks for at most: those with the fewest letters, which texts have more rarely. Verification settles the rest.
_CLAUSE_TRIGRAMS = 3
#: More alternatives than this for one stretch of literals give up on that stretch (it then demands nothing).
_MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The first three are the contract's; the expression of ``hex`` has its least length built in, which for maximal runs is the same.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{20,}"),
    Rule("gitlab", r"glpat-[0-9A-Za-z_-]{20,}"),
    Rule("npm", r"npm_[0-9A-Za-z]{36}"),
    Rule("jwt", r"eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}"),
)

Clause = frozenset[str]


def trigram_clauses(pattern: str) -> list[Clause] | None:
    """Trigrams (lower case) that a match must contain: any one of the clauses, each with all of its trigrams.

    None if some match contains no known trigram: then every text has to be scanned.
    """
    clauses = [frozenset()]
    for options in _stretches(rp.parse(pattern)):
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in options}
        if frozenset() in sets:
            continue  # one alternative of this stretch is too short: it demands nothing
        clauses = list({a | b for a in clauses for b in sets})
        if len(clauses) > _MOST_STRINGS:
            return None
    letters = lambda t: (sum(c.isalpha() for c in t), t)
    clauses = list({frozenset(sorted(c, key=letters)[:_CLAUSE_TRIGRAMS]) for c in clauses})
    clauses = [c for c in clauses if not any(d < c for d in clauses)]
    return None if frozenset() in clauses else sorted(clauses, key=sorted)


def _stretches(tree) -> list[set[str]]:
    """The runs of adjoining literals that any match has, each as the set of its possible strings."""
    done: list[set[str]] = []
    now = {""}
    for options in _pieces(tree):
        joined = {a + b for a, b in product(now, options)} if options is not None else None
        if joined is None or len(joined) > _MOST_STRINGS:
            done.append(now)
            now = {""}
        else:
            now = joined
    return [*done, now]


def _pieces(tree):
    """For each item of a parsed expression: the strings that it matches, or None if they are too many to list."""
    for op, arg in tree:
        if op is rc.LITERAL:
            yield {chr(arg).lower()}
        elif op is rc.IN and arg[0][0] is not rc.NEGATE and all(k is rc.LITERAL for k, _ in arg) and len(arg) <= 8:
            yield {chr(v).lower() for _, v in arg}
        elif op is rc.SUBPATTERN:
            yield from _pieces(arg[3])
        elif op is rc.BRANCH:
            options: set[str] | None = set()
            for branch in arg[1]:
                strings = _strings(branch)
                options = None if options is None or strings is None else options | strings
            yield options
        elif op is rc.MAX_REPEAT and arg[1] <= 8:
            inner = _strings(arg[2])
            low, high = arg[0], int(arg[1])
            yield None if inner is None else {"".join(x) for n in range(low, high + 1) for x in product(inner, repeat=n)}
        elif op is rc.AT:
            continue
        else:
            yield None


def _strings(tree) -> set[str] | None:
    all_of = {""}
    for options in _pieces(tree):
        if options is None or len(all_of) * len(options) > _MOST_STRINGS:
            return None
        all_of = {a + b for a, b in product(all_of, options)}
    return all_of


def candidates(docs: DataFrame, rules: Sequence[Rule], key: str = "doc_id", text: str = "text") -> DataFrame | None:
    """(``_key``, ``_rules``): for each key whose texts satisfy some rule's trigram query, the kinds of those rules.

    None if no rule has such a query. Repeated keys share their candidates: a superset, which verification settles.
    """
    plans = {r.kind: c for r in rules if (c := trigram_clauses(r.pattern)) is not None}
    if not plans:
        return None
    vocabulary = sorted({t for clauses in plans.values() for c in clauses for t in c})
    # folded in a projection of its own, which isn't merged into one that uses it often: once a text, not once a trigram
    folded = docs.select(F.col(key).alias("_key"), F.lower(F.col(text)).alias("_folded"))
    present = F.array_compact(F.array(*[F.when(F.contains("_folded", F.lit(t)), F.lit(t)) for t in vocabulary]))
    postings = folded.select("_key", F.explode(present).alias("_trigram"))
    spark = docs.sparkSession
    # one row for each (rule, clause, trigram): as many as the rules' text gives, whatever the input
    wanted = [(kind, n, t, 1 << i, (1 << len(c)) - 1) for kind, cs in plans.items() for n, c in enumerate(cs) for i, t in enumerate(sorted(c))]
    wanted = spark.createDataFrame(wanted, "_kind string, _clause int, _trigram string, _bit long, _all long")
    met = (
        postings.join(F.broadcast(wanted), "_trigram")
        .groupBy("_key", "_kind", "_clause", "_all")
        .agg(F.bit_or("_bit").alias("_got"))  # intersects the clause's postings, combined before the shuffle
        .where("_got = _all")
    )
    return met.groupBy("_key").agg(F.collect_set("_kind").alias("_rules"))


def rule_table(rules: Sequence[Rule]) -> Column:
    """The rules as an array of structs: a constant."""
    one = lambda n, r: {"rank": n, "kind": r.kind, "pattern": r.pattern, "group": r.group, "least": r.least, "full": trigram_clauses(r.pattern) is None}
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in one(n, r).items()]) for n, r in enumerate(rules)])


def find_spans(text: Column, rule: Column) -> Column:
    """array<struct<start, rank, kind, end>> (long, code points, end exclusive) of a rule's spans in a text.

    ``rule`` is an item of :func:`rule_table`. A text is searched once if nothing matches; else once more for the group and
    once for what lies between the matches. What is used more than once is bound first, as an expression is computed wherever it stands.
    """
    lengths = lambda strings: F.transform(strings, lambda m: F.char_length(m).cast("long"))
    search = lambda group: F.regexp_extract_all(text, rule["pattern"], group)

    def located(found: Column) -> Column:
        parts = F.struct(
            lengths(found).alias("sizes"),
            lengths(F.split(text, rule["pattern"], -1)).alias("gaps"),
            lengths(F.when(rule["group"] == 0, found).otherwise(search(rule["group"]))).alias("checked"),
        )
        return F.when(F.size(found) > 0, let(parts, placed))

    def placed(p: Column) -> Column:
        # the i-th match begins after i matches and i + 1 gaps
        after = F.zip_with(prefix_sums(p["gaps"]), p["gaps"], lambda a, b: a + b)
        begun = F.zip_with(prefix_sums(p["sizes"]), F.slice(after, F.lit(1), F.size(p["sizes"])), lambda a, b: a + b)
        ends = F.zip_with(begun, p["sizes"], lambda b, n: F.struct(b.alias("start"), (b + n).alias("end")))
        spans = F.zip_with(ends, p["checked"], lambda x, n: F.struct(x["start"].alias("start"), rule["rank"].alias("rank"), rule["kind"].alias("kind"), x["end"].alias("end"), n.alias("n")))
        kept = F.filter(spans, lambda x: x["n"] >= rule["least"])
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end")))

    return F.coalesce(let(search(F.lit(0)), located), F.array().cast(_SPANS))


_SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text", out: str = "secret_spans") -> DataFrame:
    """``docs``' rows with ``out``: array<struct<start, rank, kind, end>> by start, then the rules' order.

    A null text has no spans. Repeated keys and rows are scanned row by row. All columns of ``docs`` stay, whatever their
    names; one that is named ``out`` is replaced.
    """
    docs = docs.drop(out)
    found = candidates(docs, rules, key, text)
    k, r = fresh(docs, "_key"), fresh(docs, "_rules")
    rows, chosen = docs, F.array().cast("array<string>")
    if found is not None:
        found = found.select(F.col("_key").alias(k), F.col("_rules").alias(r))
        rows = docs.join(found, docs[key].eqNullSafe(found[k]), "left")
        chosen = F.coalesce(F.col(r), chosen)
    # one expression for all rules, so that the plan's size doesn't grow with them
    mine = F.filter(rule_table(rules), lambda x: x["full"] | F.array_contains(chosen, x["kind"]))
    spans = F.array_sort(F.flatten(F.transform(mine, lambda x: find_spans(F.col(text), x))))
    return rows.withColumn(out, F.when(F.col(text).isNotNull(), spans).otherwise(F.array().cast(_SPANS))).drop(k, r)


def span_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def mask_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text", mask: str = "[secret]", length: str | None = None) -> DataFrame:
    """``docs`` with each secret replaced by ``mask``: spans that overlap are replaced together. Texts without secrets stay as they are.

    ``length`` names a column, if there is one, that holds the text's length in characters and follows the text.
    """
    held = fresh(docs, "_spans")
    scanned = scan_secrets(docs, rules, key, text, held)
    spans = F.col(held)

    def apart(done: Column, x: Column) -> Column:
        """Spans that overlap become one."""
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        more = F.struct(x["start"].alias("start"), x["end"].alias("end"))
        over = F.coalesce(x["start"] < last["end"], F.lit(False))
        return F.when(over, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(more)))

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    # four bytes a character, so that a place in the text is found without reading what comes before it
    wide = F.struct(F.encode(F.col(text), "UTF-32").alias("text"), F.aggregate(spans, none, apart).alias("cuts"))

    def cut(w: Column) -> Column:
        piece = lambda start, end: F.decode(F.substring(w["text"], (start * 4 + 1).cast("int"), ((end - start) * 4).cast("int")), "UTF-32")
        starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(w["cuts"], lambda c: c["end"]))
        ends = F.concat(F.transform(w["cuts"], lambda c: c["start"]), F.array((F.length(w["text"]) / 4).cast("long")))
        return F.array_join(F.zip_with(starts, ends, piece), mask)

    changed = scanned.withColumn(text, F.when(F.size(spans) > 0, let(wide, cut)).otherwise(F.col(text))).drop(held)
    if length is not None and length in docs.columns:
        changed = changed.withColumn(length, F.char_length(text).cast(docs.schema[length].dataType))
    return changed


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scanned = scan_secrets(docs).select("doc_id", "secret_spans")
    count = lambda kind: F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long")
    base = [r.kind for r in RULES if r.base]
    return scanned.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(span_text(F.filter("secret_spans", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        span_text(F.col("secret_spans")).alias("spans"),
    )


def _sql_spans(kind: str, rank: int, pattern: str, checked: str, least: int) -> str:
    """DuckDB: the spans of a kind as a list of structs, by the lengths of the matches and of what lies between them."""
    m = f"regexp_extract_all(t, '{pattern}')"
    c = f"regexp_extract_all(t, '{pattern}', {checked})"
    g = f"regexp_split_to_array(t, '{pattern}')"
    start = f"list_sum(list_transform(({g})[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(({m})[1:i-1], lambda x: length(x))), 0)"
    made = f"list_transform(range(1, len({m}) + 1), lambda i: {{'s': ({start})::BIGINT, 'r': {rank}, 'k': '{kind}', 'n': length(({m})[i]), 'c': length(({c})[i])}})"
    return f"list_filter({made}, lambda x: x.c >= {least})"


_NONE_SQL = "[]::STRUCT(s BIGINT, r INTEGER, k VARCHAR, n BIGINT, c BIGINT)[]"
#: (kind, what a text has to match to be looked at, expression, group, least length), in the rules' order.
_SQL_RULES = (
    ("assign", "(?i)passw|secret|token|api_?key", """((?i:password|passwd|secret|token|api_?key))["'']?[ ]*[:=][ ]*["'']?([A-Za-z0-9+/_.=-]+)""", "2", 6),
    ("access", "AKIA", "AKIA[A-Z0-9]+", "0", 20),
    ("hex", "[0-9a-f]{24,}", "[0-9a-f]{24,}", "0", 24),
    ("pem", "PRIVATE KEY", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "0", 1),
    ("github", "gh[pousr]_", "gh[pousr]_[A-Za-z0-9]{36,}", "0", 1),
    ("slack", "xox", "xox[abprs]-[A-Za-z0-9-]{10,}", "0", 1),
    ("google", "AIza", "AIza[0-9A-Za-z_-]{35}", "0", 1),
    ("stripe", "k_live_", "[rs]k_live_[0-9A-Za-z]{20,}", "0", 1),
    ("gitlab", "glpat-", "glpat-[0-9A-Za-z_-]{20,}", "0", 1),
    ("npm", "npm_", "npm_[0-9A-Za-z]{36}", "0", 1),
    ("jwt", "eyJ", r"eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}", "0", 1),
)
_SQL_COLUMNS = ",\n  ".join(f"CASE WHEN regexp_matches(t, '{first}') THEN {_sql_spans(kind, n, pattern, group, least)} ELSE {_NONE_SQL} END AS k{n}" for n, (kind, first, pattern, group, least) in enumerate(_SQL_RULES))
_SQL_TEXT = "array_to_string(list_transform(list_sort({}), lambda y: y.k || ':' || y.s || ':' || (y.s + y.n)), ',')"

ORACLE_OP2 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id,
  {_SQL_COLUMNS} FROM d)
SELECT doc_id, len(k0)::BIGINT AS n_assign, len(k1)::BIGINT AS n_access, len(k2)::BIGINT AS n_hex,
  sha256({_SQL_TEXT.format("k0 || k1 || k2")}) AS base_sha256,
  {_SQL_TEXT.format(" || ".join(f"k{n}" for n in range(len(_SQL_RULES))))} AS spans FROM s
"""
