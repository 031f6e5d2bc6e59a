"""Packing documents into sequences: a configuration linear program over the histogram of piece lengths.

The histogram has a row for each length up to the sequence's, whatever the input. The program (cover each length's pieces
with configurations, as few sequences as possible) is solved by multiplicative weights, each step priced by a knapsack
dynamic program. Its solution is rounded down to whole sequences; for what that leaves, further configurations are priced
one by one with the program's prices, now bounded by the pieces that are left. The shortest few go best fit into the
gaps. Pieces take the places of their length's configurations by rank.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskin.llm.textcols import small_batches
from corpuskin.plans.shared import ranked

CAPACITY = 2048
#: Shares of the program's solution that rounding tries: a smaller one leaves more pieces to fill gaps with.
ROUND_PARTS = (1.0, 0.95, 0.85, 0.7)
#: Weights of the program's prices beside the lengths themselves that rounding tries: the prices are as exact as the tolerance.
PRICE_PARTS = (1.0, 0.2, 0.02)
#: Lengths that one pricing of a rounding step looks at; the share of the pieces, the shortest ones, that best fit gets to fill gaps with.
LOOK, LAST = 100, 0.07
#: Neighbouring lengths are pooled to so many for the program, which takes the longest of a pool for all of it.
POOLS = 160
#: The program is solved once its cover takes at most this share more than the least that its prices prove.
TOLERANCE = 0.01
#: Sequences of one kind: ((length, times), ...) longest first, and how many of them.
Plan = list[tuple[tuple[tuple[int, int], ...], int]]


@dataclass(frozen=True)
class Solution:
    """A plan; the sequences that its prices prove to be needed; the pieces shorter than a sequence, and how many of them the program placed."""

    plan: Plan
    bound: float
    pieces: int
    placed: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.plan)


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids of the byte-level BPE of a tokenizers file, as tokenizers gives them without special tokens.

    The same merges run faster in tiktoken, which has no special tokens of its own; texts that hold one's string, or that
    tiktoken gives up on, go through tokenizers itself.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    @lru_cache(maxsize=1)
    def whole() -> Tokenizer:  # loaded where it is needed only
        return Tokenizer.from_file(path)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    marks = [t["content"] for t in spec.get("added_tokens") or []]
    plain = lambda t: whole().encode(t, add_special_tokens=False).ids
    pre = spec.get("pre_tokenizer") or {}
    model = spec["model"]
    odd = [model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix")]
    odd += [spec.get(k) for k in ("normalizer", "truncation", "padding")] + [pre.get("add_prefix_space"), not pre.get("use_regex", True)]
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model.get("merges") or []]
    # tiktoken merges the lowest id first, tokenizers the first merge: the same where the ids follow the merges
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or any(odd) or not merged or -1 in merged or any(a >= b for a, b in zip(merged, merged[1:])):  # noqa: B905
        return plain
    # the printable stand-ins that byte-level vocabularies use for bytes
    direct = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(direct)]
    byte_of = {chr(b): b for b in direct} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in marks}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(text: str) -> list[int]:
        if any(m in text for m in marks):
            return plain(text)
        try:
            return fast(text)
        except BaseException as e:  # the library's panics are no Exceptions
            if isinstance(e, KeyboardInterrupt | SystemExit | GeneratorExit):
                raise
            return plain(text)

    return ids


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """(``key``, piece, start, length, ids_crc32[, ids]): each document's ids and a final 0, cut to pieces if they exceed ``capacity``.

    All pieces but the first are full. A null text is empty: the id 0 alone. ``ids`` (array<int>) only if asked for.
    """
    small_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer_path()
    named = docs.select(F.col(key).alias(key), F.col(text).alias("_text"))
    kind = named.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            at, rows, kept = [], [], []
            for i in range(b.num_rows):
                ids = np.array([*encode(b.column(1)[i].as_py() or ""), 0], "<u4")
                start, piece = 0, 0
                length = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
                while start < len(ids):
                    part = ids[start : start + length]
                    at.append(i)
                    rows.append((piece, start, len(part), zlib.crc32(part.tobytes())))
                    if with_ids:
                        kept.append(part.astype(np.int32))
                    start, piece, length = start + len(part), piece + 1, capacity
            cols = list(zip(*rows, strict=True)) or [()] * 4
            arrays = [b.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return named.mapInArrow(run, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def best_fit(histogram: dict[int, int], capacity: int, begun: Plan | None = None) -> Plan:
    """Best fit, longest first, over a histogram: sequences of equal content are one entry, however many they are.

    Sequences ``begun`` with some content are filled up and returned with the others.
    """
    open_: dict[int, Counter] = defaultdict(Counter)  # space left -> contents -> how many
    spaces: list[int] = []
    full: Counter = Counter()

    def put(content: tuple, space: int, n: int) -> None:
        if space == 0:
            full[content] += n
            return
        if space not in open_:
            bisect.insort(spaces, space)
        open_[space][content] += n

    for content, n in begun or []:
        put(content, capacity - sum(length * times for length, times in content), n)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            i = bisect.bisect_left(spaces, length)
            if i == len(spaces):
                each = capacity // length
                n, rest = divmod(left, each)
                if n:
                    put(((length, each),), capacity - each * length, n)
                if rest:
                    put(((length, rest),), capacity - rest * length, 1)
                break
            space = spaces[i]
            content, n = next(iter(open_[space].items()))
            each = min(space // length, left)
            n = min(n, left // each)
            open_[space][content] -= n
            if not open_[space][content]:
                del open_[space][content]
            if not open_[space]:
                del open_[space]
                spaces.pop(i)
            put((*content, (length, each)), space - each * length, n)
            left -= n * each
    for kinds in open_.values():
        full.update(kinds)
    return list(full.items())


def _price(lengths: np.ndarray, weights: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of the greatest weight, as times per length: an unbounded knapsack, cut to the pieces there are."""
    order = np.argsort(lengths)
    size, value = lengths[order], weights[order]
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    ends = np.searchsorted(size, np.arange(capacity + 1), side="right")
    for c in range(int(size[0]), capacity + 1):
        got = best[c - size[: ends[c]]] + value[: ends[c]]
        k = int(got.argmax())
        best[c], last[c] = (got[k], k) if got[k] > best[c - 1] else (best[c - 1], -1)
    times = np.zeros(len(lengths), np.int64)
    c = capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
            continue
        times[order[last[c]]] += 1
        c -= int(size[last[c]])
    return np.minimum(times, most)


def _pools(histogram: dict[int, int], lengths: list[int]) -> list[list[int]]:
    """The lengths, longest first, in at most about ``POOLS`` runs of about as many pieces each; each length alone if they are few."""
    if len(lengths) <= POOLS:
        return [[k] for k in lengths]
    most = sum(histogram[k] for k in lengths) / POOLS
    pools: list[list[int]] = []
    held = most
    for k in lengths:
        if held + histogram[k] > most:
            pools.append([])
            held = 0
        pools[-1].append(k)
        held += histogram[k]
    return pools


def solve(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = 1200, rate: float = 0.3) -> Solution:
    """Covers the histogram's pieces with sequences, as few as it can.

    Multiplicative weights for the covering program: a pool of lengths weighs the more the less of it is covered; each step
    adds the configuration of the greatest weight, by as much as its scarcest pool allows, until the cover is within
    ``TOLERANCE`` of the bound of its prices or ``steps`` are done. The solution is scaled to a full cover and rounded to
    whole sequences at each of ``ROUND_PARTS`` of it; what is left is packed best fit, into the gaps too. The fewest
    sequences win, and of equally few those of which the program placed the most pieces. Best fit alone is the last resort.
    """
    histogram = {int(k): int(n) for k, n in histogram.items() if n}
    # full pieces are sequences of their own in any packing
    own = sorted((k for k in histogram if k < capacity), reverse=True)
    plain = best_fit(histogram, capacity)
    if not own:
        return Solution(plain, float(sum(histogram.values())), 0, 0)
    pools = _pools(histogram, own)
    lengths = np.array([p[0] for p in pools])
    counts = np.array([sum(histogram[k] for k in p) for p in pools], float)
    covered = np.zeros(len(lengths))
    share: dict[tuple[int, ...], float] = defaultdict(float)
    total, bound = 0.0, 0.0
    prices = lengths / capacity
    for _ in range(steps):
        done = covered / counts
        weights = np.exp(-rate * 20 * (done - done.min())) / counts
        # lengths of equal need are worth their length, so that full configurations win among them
        weights = weights / weights.max() + lengths / capacity * 1e-3
        whole = _price(lengths, weights * lengths, np.full(len(lengths), capacity), capacity)
        times = np.minimum(whole, counts.astype(np.int64))
        used = times > 0
        step = float((counts[used] / times[used]).min()) / 20
        covered[used] += step * times[used]
        share[tuple(times)] += step
        total += step
        value = weights * lengths
        proved = float(counts @ value) / float(whole @ value)
        if proved > bound:  # no configuration costs more than 1 at these prices
            bound, prices = proved, value / float(whole @ value)
        least = float((covered / counts).min())
        if least > 0 and total / least <= (1 + TOLERANCE) * bound:
            break
    scales = {1 / x for x in (float((covered / counts).min()), float(np.median(covered / counts))) if x > 0}
    plans = [_rounded(histogram, pools, lengths, share, scale * part, capacity, up) for scale in sorted(scales) for part in ROUND_PARTS for up in (False, True)]
    price = {k: float(y) for pool, y in zip(pools, prices, strict=True) for k in pool}
    for part in PRICE_PARTS:
        # what whole sequences of the solution leave, by its prices; a little more for long pieces, which are harder to place later
        value = {k: (part * y + (1 - part) * k / capacity) * (1 + 1e-2 * k / capacity) for k, y in price.items()}
        plans.append(_rounded(histogram, pools, lengths, share, min(scales), capacity, False, value))
    plan, placed = min([*plans, (plain, 0)], key=lambda p: (sum(n for _, n in p[0]), -p[1]))
    return Solution(plan, bound + histogram.get(capacity, 0), int(counts.sum()), placed)


def _rounded(histogram: dict[int, int], pools: list[list[int]], lengths: np.ndarray, share: dict, scale: float, capacity: int, up: bool, value: dict[int, float] | None = None) -> tuple[Plan, int]:
    """(plan, pieces placed by it). Whole sequences of the solution's full configurations, the most used first, while pieces last; the rest best fit.

    With ``up`` fractions of sequences follow as whole ones, the largest first; with ``value`` configurations of what is left, by those prices.
    """
    stock = [[[k, histogram[k]] for k in reversed(p)] for p in pools]  # a pool's longest pieces go first
    left = np.array([sum(n for _, n in s) for s in stock], np.int64)
    begun: Counter = Counter()

    def take(t: np.ndarray, n: int) -> None:
        left[:] -= n * t
        used = np.nonzero(t)[0]
        while n:
            # sequences of equal lengths at once, as many as the lengths at hand give
            m = min(n, *(max(1, stock[i][-1][1] // int(t[i])) for i in used))
            content: Counter = Counter()
            for i in used:
                need = int(t[i]) * m if stock[i][-1][1] >= t[i] else int(t[i])
                each = m if stock[i][-1][1] >= t[i] else 1
                while need:
                    k, have = stock[i][-1]
                    got = min(have, need)
                    content[k] += got // each
                    need -= got
                    stock[i][-1][1] -= got
                    if not stock[i][-1][1]:
                        stock[i].pop()
            begun[tuple(sorted(content.items(), reverse=True))] += m
            n -= m

    ordered = sorted(share.items(), key=lambda s: (-s[1], s[0]))
    # with further pricing only sequences that are as good as full whichever of the pools' pieces they get
    size, least = (lengths, 0.99) if value is None else (np.array([p[-1] for p in pools]), 0.998)
    full = [(np.array(t), x * scale) for t, x in ordered if int(np.array(t) @ size) >= capacity * least]
    for t, x in full:
        n = int(min(x, (left[t > 0] // t[t > 0]).min()))
        if n:
            take(t, n)
    if up:
        for t, _ in sorted(full, key=lambda f: -(f[1] % 1)):
            if (left >= t).all():
                take(t, 1)
    rest = Counter()
    for s in stock:
        for k, n in s:
            rest[k] += n
    if value is not None:
        short, most = Counter(), int(LAST * left.sum())
        for k in sorted(rest):
            short[k] = min(rest[k], most)
            most -= short[k]
        begun.update(_dive(rest - short, value, capacity))
        rest = short
    placed = sum(n * sum(times for _, times in content) for content, n in begun.items())
    rest[capacity] = histogram.get(capacity, 0)
    return best_fit({k: n for k, n in rest.items() if n}, capacity, list(begun.items())), placed


def _dive(rest: Counter, value: dict[int, float], capacity: int) -> Counter:
    """Configurations that take all pieces of ``rest``, which is emptied.

    Each holds the longest piece left, and beside it the most valuable pieces that there are: a knapsack bounded by their
    numbers, over ``LOOK`` of the lengths that fit, others each time. It is used as often as its pieces last.
    """
    made: Counter = Counter()
    lengths = sorted(k for k, n in rest.items() if n)
    turn = 0
    while lengths:
        longest = lengths[-1]
        room = capacity - longest
        fit = lengths[: bisect.bisect_right(lengths, room)]
        step = max(1, len(fit) // LOOK)
        turn += 1
        best = np.zeros(room + 1)
        taken: list[tuple[int, int, np.ndarray]] = []
        for k in fit[turn % step :: step][::-1]:
            have, n = min(rest[k] - (k == longest), room // k), 1
            while have > 0:  # 1, 2, 4, ... pieces together
                n = min(n, have)
                with_it = best[: room + 1 - n * k] + n * value[k]
                better = with_it > best[n * k :]
                best[n * k :] = np.where(better, with_it, best[n * k :])
                taken.append((k, n, better))
                have -= n
                n *= 2
        times = Counter({longest: 1})
        c = int(best.argmax()) if room else 0
        for k, n, better in reversed(taken):
            if c >= n * k and better[c - n * k]:
                times[k] += n
                c -= n * k
        uses = min(rest[k] // n for k, n in times.items())
        made[tuple(sorted(times.items(), reverse=True))] += uses
        for k, n in times.items():
            rest[k] -= uses * n
            if not rest[k]:
                lengths.pop(bisect.bisect_left(lengths, k))
    return made


def _places(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, times, first sequence, offset of the first of them) of each length in each configuration."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for content, n in plan:
        offset = 0
        for length, times in content:
            rows.append((length, taken[length], n * times, times, sequence, offset))
            taken[length] += n * times
            offset += length * times
        sequence += n
    return rows


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``key``, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    Every row of ``docs`` is packed, repeated rows and rows without a key too. Sequences are gapless from offset 0. Pieces of
    a length take its places by key (null first), then piece, then in any order. An empty table gives none.
    """
    pieces = token_pieces(docs, key, text, capacity, tokenizer, with_ids)
    placed = ranked(pieces, "length", [key, "piece"], "_rank", "pieces")
    histogram = {r["length"]: r["count"] for r in placed.groupBy("length").count().collect()}  # at most ``capacity`` rows
    places = _places(solve(histogram, capacity).plan)
    # a length's ranks lie in its configurations' ranges, of which the solution has a bounded number
    spark = docs.sparkSession
    by_length: dict[int, list[tuple]] = defaultdict(list)
    for length, first, _n, times, sequence, offset in places:
        by_length[length].append((first, times, sequence, offset))
    sent = spark.sparkContext.broadcast({k: tuple(np.array(c) for c in zip(*v, strict=True)) for k, v in by_length.items()})
    schema = T.StructType([f for f in placed.schema.fields if f.name != "_rank"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for b in batches:
            lengths = b.column(b.schema.get_field_index("length")).to_numpy()
            ranks = b.column(b.schema.get_field_index("_rank")).to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                first, times, seq, off = table[int(length)]
                here = np.nonzero(lengths == length)[0]
                k = np.searchsorted(first, ranks[here], side="right") - 1
                nth = ranks[here] - first[k]
                sequence[here] = seq[k] + nth // times[k]
                offset[here] = off[k] + nth % times[k] * length
            kept = [b.column(i) for i, n in enumerate(b.schema.names) if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[n for n in b.schema.names if n != "_rank"] + ["sequence_id", "offset"])

    return placed.mapInArrow(run, schema)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
