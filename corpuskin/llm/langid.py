"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskin.llm.textcols import small_batches
from corpuskin.plans.shared import materialize

#: Blanks ASCII marks and digits, which say nothing about a language.
_BLANK = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))
#: Rows that training takes at most, a documented bound; an even share of each language, drawn by a hash of key and text.
SAMPLE_ROWS = 6000
#: Hash buckets of subwords (as many as two bytes tell apart), and the runs of bytes that are subwords beside the word itself.
BUCKETS, RUNS = 1 << 16, (1, 2, 3, 4)
#: Words of the short pieces that training adds to a whole text, as short texts have to be told too.
PIECES = (10, 4)
#: One of so many sampled rows calibrates; of those, the share that may score less than what is rejected.
APART, REJECTED = 10, 0.001
#: Bytes of words that a worker keeps the sums of, then it starts anew; and of words whose subwords are made at once.
CACHE_BYTES, CHUNK_BYTES = 16 << 20, 1 << 18


@dataclass(frozen=True)
class LangModel:
    """``table``: each bucket's embedding, or, for fewer languages than it is wide, that times the output weights (then ``out`` is None).

    Texts of ``sizes`` subwords are rejected if they score below ``least``; between and beyond the sizes the line is interpolated.
    """

    langs: tuple[str, ...]
    table: np.ndarray
    out: np.ndarray | None
    bias: np.ndarray
    heat: float
    sizes: tuple[float, ...]
    least: tuple[float, ...]

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        z = (mean if self.out is None else mean @ self.out) + self.bias
        return _softmax(z / self.heat)

    def rejects(self, score: float, size: float) -> bool:
        return bool(self.least) and score < float(np.interp(np.log(max(size, 1.0)), np.log(self.sizes), self.least))


def words_of(text: str) -> list[bytes]:
    """Lower-cased UTF-8 words: ASCII other than letters parts them."""
    return text.lower().encode("utf-8", "replace").translate(_BLANK).split()


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def bucket(run: bytes) -> int:
    """The bucket of a run of up to four bytes."""
    return (int.from_bytes(run, "little") + (len(run) << 40)) * 0x9E3779B97F4A7C15 % (1 << 64) >> 48


def word_bucket(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, sizes): the buckets of all runs of ``RUNS`` bytes of each word, with its ends marked.

    ``ids`` has a column for each byte of the marked words and a row for each length of runs, ``BUCKETS`` where a run
    would pass the word's end, and a last row that has the word's own bucket at its first byte. ``starts`` are the words'
    columns, ``sizes`` their numbers of subwords.
    """
    data = np.frombuffer(b"".join([b"<%b>" % w for w in words]), np.uint8).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    left = np.repeat(ends, lengths) - np.arange(len(data))
    ids = np.full((len(RUNS) + 1, len(data)), BUCKETS, np.int64)
    code = np.zeros(len(data), np.uint64)
    for row, n in enumerate(RUNS):
        code[: len(data) - n + 1] += data[n - 1 :] << np.uint64(8 * (n - 1))
        hashed = (code + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)
        ids[row] = np.where(left >= n, hashed.astype(np.int64), BUCKETS)
    ids[-1, starts] = [word_bucket(w) for w in words]
    sizes = 1 + sum(np.maximum(0, lengths - n + 1) for n in RUNS)
    return ids, starts, sizes


def _chunks(words: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for w in words:
        held.append(w)
        size += len(w) + 2
        if size >= CHUNK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def bag(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, how often each): all subwords of a text's words."""
    total = np.zeros(BUCKETS + 1)
    counts = Counter(words)
    for chunk in _chunks(list(counts)):
        ids, starts, _ = subwords(chunk)
        often = np.repeat([counts[w] for w in chunk], np.diff([*starts, ids.shape[1]]))
        for row in ids:
            total += np.bincount(row, often, BUCKETS + 1)
    at = np.nonzero(total[:-1])[0]
    return at, total[at]


def bags_of(text: str | None, h: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The bag of the whole text, and those of runs of ``PIECES`` words from places that ``h`` decides; empty ones left out."""
    words = words_of(text or "")
    starts = [zlib.crc32(b"%d:%d" % (h, n)) % max(1, len(words) - n + 1) for n in PIECES]
    made = [bag(words), *(bag(words[s : s + n]) for s, n in zip(starts, PIECES, strict=True))]
    return [b for b in made if len(b[0])]


def training_rows(docs: DataFrame, limit: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> pd.DataFrame:
    """(lang, h, bags) of up to ``limit`` rows, an even share of each language where it has as many; the same whatever the partitions.

    Of a language, the rows with the smallest hashes are taken, at least one each: only of more languages than ``limit``
    the rarest go. Whole texts are counted, on the executors; a row's bags have at most ``BUCKETS`` items each, however
    long its text is. Rows without a text or language teach nothing.
    """
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    named = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = named.groupBy(F.col(lang).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(limit).collect()
    if not counts:
        return pd.DataFrame({"lang": [], "h": [], "bags": []})
    share = max(1, limit // len(counts))
    whole = 1 << 40
    # hashes below a language's bound: half as many again as its share, and then some
    bounds = [(r["lang"], int(whole * min(1.0, (1.5 * share + 20) / r["count"]))) for r in counts]
    table = F.broadcast(spark.createDataFrame(bounds, "lang string, most long"))  # ``limit`` rows at most
    hashed = named.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(whole)).alias("h"))
    near = materialize(hashed.join(table, "lang").where("h <= most").select("lang", "h", "text"), "sample")
    # rows that repeat a key and a text count once
    least = near.groupBy("lang").agg(F.slice(F.array_sort(F.collect_set("h")), 1, share).alias("h")).select("lang", F.explode("h").alias("h"))
    chosen = near.dropDuplicates(["lang", "h"]).join(F.broadcast(least), ["lang", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [bags_of(t.as_py(), h.as_py()) for t, h in zip(b.column(2), b.column(1), strict=True)]
            packed = [[_packed(*x) for x in bags] for bags in made]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.list_(pa.binary()))], names=["lang", "h", "bags"])

    got = chosen.select("lang", "h", "text").mapInArrow(run, "lang string, h bigint, bags array<binary>").toPandas()
    return got.sort_values(["lang", "h"], ignore_index=True)


def _packed(ids: np.ndarray, often: np.ndarray) -> bytes:
    """A bag in about two bytes an item: its buckets, as differences, and how often each occurs."""
    return zlib.compress(np.diff(ids, prepend=0).astype("<u2").tobytes() + often.astype("<u4").tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, shares, number of subwords)."""
    raw = zlib.decompress(data)
    n = len(raw) // 6
    often = np.frombuffer(raw, "<u4", n, 2 * n).astype(np.float32)
    return np.cumsum(np.frombuffer(raw, "<u2", n).astype(np.int64)), often / often.sum(), float(often.sum())


def train(rows: pd.DataFrame, width: int = 16, epochs: int = 4, rate: float = 0.5, seed: int = 7) -> LangModel:
    """Embeddings of subwords, averaged over a text, with a linear softmax; a tenth of the rows calibrates.

    The calibration finds the temperature with the least loss on the rows set apart, and for whole texts and for each
    length of short pieces the score that all but a share of ``REJECTED`` of those exceed, with its odds halved.
    """
    rng = np.random.default_rng(seed)
    langs = tuple(sorted(set(rows["lang"]))) or ("und",)
    at = {x: i for i, x in enumerate(langs)}
    emb = rng.normal(0, 0.1, (BUCKETS, width)).astype(np.float32)
    out = np.zeros((width, len(langs)))
    bias = np.zeros(len(langs))
    fit: list[tuple[bytes, int]] = []
    held: list[tuple[bytes, int, int]] = []
    for h, lang, bags in zip(rows["h"], rows["lang"], rows["bags"], strict=True):
        for kind, x in enumerate(bags):
            if zlib.crc32(b"%d" % h) % APART == 0:
                held.append((x, at[lang], kind))
            else:
                fit.append((x, at[lang]))
    for e in range(epochs if len(langs) > 1 else 0):
        step = rate * (1 - e / epochs)
        for k in rng.permutation(len(fit)):
            x, y = fit[k]
            ids, part, _ = _unpacked(x)
            h = part @ emb[ids]
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            g = out @ p
            out -= step * np.outer(h, p)
            bias -= step * 0.1 * p
            emb[ids] -= np.outer(part, step * g).astype(np.float32)  # buckets of a bag are distinct
    folded = len(langs) < width
    model = LangModel(langs, (emb @ out if folded else emb).astype(np.float32), None if folded else out, bias, 1.0, (), ())
    if not held or len(langs) < 2:
        return model
    means = np.array([part @ model.table[ids] for ids, part, _ in (_unpacked(x) for x, _, _ in held)])
    z = (means if folded else means @ out) + bias
    y = np.array([y for _, y, _ in held])
    heats = (0.05, 0.1, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0)
    losses = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in heats}
    heat = min(losses, key=lambda t: (losses[t], t))
    best = _softmax(z / heat).max(1)
    kinds = np.array([k for _, _, k in held])
    lines = {}
    for k in range(1 + len(PIECES)):
        here = kinds == k
        if here.any():
            size = float(np.median([_unpacked(x)[2] for (x, _, _), own in zip(held, here, strict=True) if own]))
            odds = float(np.quantile(best[here], REJECTED))
            odds = 0.5 * odds / max(1 - odds, 1e-9)
            lines[size] = odds / (1 + odds)
    sizes = sorted(lines)
    least = np.minimum.accumulate([lines[x] for x in sizes][::-1])[::-1]  # no shorter text needs a higher score
    return LangModel(langs, model.table, model.out, bias, heat, tuple(sizes), tuple(least.tolist()))


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def scorer(model: LangModel):
    """text -> (probabilities, number of subwords), or None without a letter. Keeps the sums of words that it has seen, up to ``CACHE_BYTES``."""
    width = model.table.shape[1]
    table = np.concatenate([model.table, np.zeros((1, width), np.float32)])  # the last row for runs beyond a word's end
    place: dict[bytes, int] = {}
    sums = np.zeros((1024, width + 1))  # of a word's subwords, and their number
    held = 0

    def learn(words: list[bytes]) -> None:
        nonlocal sums, held
        while len(place) + len(words) > len(sums):
            sums = np.concatenate([sums, np.zeros_like(sums)])
        for chunk in _chunks(words):
            ids, starts, sizes = subwords(chunk)
            first = len(place)
            each = sum((table[row] for row in ids[1:]), table[ids[0]])
            sums[first : first + len(chunk), :width] = np.add.reduceat(each, starts, axis=0, dtype=np.float64)
            sums[first : first + len(chunk), width] = sizes
            place.update(zip(chunk, range(first, first + len(chunk)), strict=True))
            held += sum(map(len, chunk)) + 120 * len(chunk)

    def score(text: str | None) -> tuple[np.ndarray, float] | None:
        nonlocal held
        if not has_letter(text):
            return None
        if held > CACHE_BYTES:
            place.clear()
            held = 0
        counts = Counter(words_of(text))
        new = [w for w in counts if w not in place]
        if new:
            learn(new)
        rows = [place[w] for w in counts]
        if not rows:  # letters beyond what words are made of
            return model.probabilities(np.zeros(width)), 0.0
        total = np.fromiter(counts.values(), np.float64, len(counts)) @ sums[rows]
        return model.probabilities(total[:width] / total[width]), float(total[width])

    return score


def best_of(model: LangModel, got: tuple[np.ndarray, float] | None) -> tuple[str, float, bool]:
    """(language, score, rejected) of what a scorer gives."""
    if got is None:
        return "und", 0.0, True
    k = int(got[0].argmax())
    value = float(got[0][k])
    return model.langs[k], value, model.rejects(value, got[1])


def with_language(docs: DataFrame, model: LangModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score (0 to 1) and lang_rejected.

    A null text, or one without a letter, is ``und`` with score 0 and is rejected; so is a text whose best score is below
    the model's line for its length. All other columns of ``docs`` stay; ones of these three names are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages or the width of embeddings, whatever the input
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string("lang_pred string, lang_score double, lang_rejected boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        score = scorer(model)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text))
            found = [best_of(model, score(texts[i].as_py())) for i in range(b.num_rows)]
            made = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "lang_pred", "lang_score", "lang_rejected"])

    return docs.mapInArrow(run, schema)


def fold(key: str, parts: int):
    """crc32 of the key as text, modulo ``parts``; -1 for a null key, which is in no fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts, F.lit(-1))


def fit_language_model(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LangModel:
    """Learns from the rows of all folds but one; rows without a key don't teach, as their fold isn't known."""
    return train(training_rows(docs.where(~fold(key, 4).isin(2, -1)), key=key, text=text, lang=lang))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_language_model(docs.select("doc_id", "text", "lang"))
    found = with_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def keep_known_languages(docs: DataFrame, model: LangModel, text: str = "text") -> DataFrame:
    """``docs`` without the texts that the model rejects; its columns stay as they are, whatever their names."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        score = scorer(model)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text))
            yield b.filter(pa.array([not best_of(model, score(texts[i].as_py()))[2] for i in range(b.num_rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
