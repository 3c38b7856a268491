"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import ddl, map_batches, quantile, slices, text_bytes, written
from tracewell.llm.grams import add_counts, count_keys, gram_keys, look_up, text_grams

#: Bytes of context at most.
ORDER = 4
#: The sample that the trees are grown from: documents of a language at most.
SAMPLE_ROWS = 1500
UNDETERMINED = "und"
#: A text is in its language if its bits a byte lie no further above the middle of the language's held-out texts than REACH
#: times their HIGH quantile; the bits of few bytes stray further, with the root of 1 + SHORT / n_bytes.
HIGH, REACH, SHORT = 0.99, 1.25, 100
#: A language's held-out texts are weighed against the overall quantile as if this came from so many texts, and that one
#: against PRIOR; where no text is held out, MOST_BITS is the limit.
POOL, PRIOR, MOST_BITS = 20, 0.5, 5.0
_LETTER = regex.compile(r"\p{L}")


def held_out(key: Column) -> Column:
    """Whether a document is of the fifth that nothing is learned from."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


class Tree:
    """One language's context tree with frozen counts.

    Order k has the grams of k + 1 bytes with their counts, and for each context of k
    bytes the total, the number of different next bytes, and what exclusion takes from
    the next lower order: the lower counts of the bytes seen here.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER):
        self.order, self.levels = order, []
        for k in range(order + 1):
            own = keys & _mask(k + 1)
            at = np.argsort(own, kind="stable")
            grams, times = add_counts((own[at], counts[at]), (own[:0], counts[:0]))
            context = grams >> np.uint64(8)
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
            level = {"grams": grams, "times": times, "contexts": context[first], "total": _sums(times, first), "kinds": np.diff(np.append(first, len(grams)))}
            if k:
                lower = self.levels[-1]
                at, _ = look_up(lower["grams"], grams & _mask(k))
                level["taken"] = _sums(lower["times"][at], first)
            self.levels.append(level)

    def code_lengths(self, keys: np.ndarray) -> np.ndarray:
        """Bits for the last byte of each gram after the bytes before it (method C, with exclusion)."""
        bits, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
        taken, gone = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            c, known = look_up(level["contexts"], (keys & _mask(k + 1)) >> np.uint64(8))
            g, seen = look_up(level["grams"], keys & _mask(k + 1))
            if not len(level["contexts"]):
                continue
            kinds = np.where(known, level["kinds"][c] - gone, 0)
            total = np.where(known, level["total"][c] - taken, 0) + kinds
            live = open_ & known & (kinds > 0)
            coded = live & seen
            bits[coded] -= np.log2(level["times"][g[coded]] / total[coded])
            escaped = live & ~seen
            bits[escaped] -= np.log2(kinds[escaped] / total[escaped])
            open_ &= ~coded
            gone = np.where(known, level["kinds"][c], gone)
            if k:
                taken = np.where(known, level["taken"][c], taken)
        bits[open_] += np.log2(np.maximum(256 - gone[open_], 1))
        return bits


def _mask(size: int) -> np.uint64:
    return np.uint64((1 << 8 * size) - 1)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else np.zeros(0, np.int64)


class Model:
    """The trees of all languages, with the code lengths of all grams of the sample worked out."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.order, self.langs = order, sorted(counts)
        self.trees = [Tree(*counts[lang], order) for lang in self.langs]
        self.known = np.unique(np.concatenate([counts[lang][0] for lang in self.langs])) if counts else np.zeros(0, np.uint64)
        self.bits = self._work_out(self.known).astype(np.float32)

    def _work_out(self, keys: np.ndarray) -> np.ndarray:
        return np.stack([t.code_lengths(keys) for t in self.trees], axis=1) if self.trees else np.zeros((len(keys), 0))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, languages) bits of each whole text."""
        size = self.order + 1
        text, keys, times = text_grams(data, offsets, size)
        at, known = look_up(self.known, keys)
        new, which = np.unique(keys[~known], return_inverse=True)
        fresh = self._work_out(new)
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for i in range(len(self.langs)):
            bits = np.zeros(len(keys))
            if len(self.known):
                bits = self.bits[at, i].astype(np.float64)
            bits[~known] = fresh[which, i]
            out[:, i] = np.bincount(text, bits * times, len(offsets) - 1)
        return out


def sample(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(lang, text) of about SAMPLE_ROWS documents of each language and never more, those of least hash.

    A language's count gives the hash below which twice as many lie, so only these are
    shuffled and ranked, however many rows the language has.  Repeated rows count once.
    """
    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(key, text).alias("h"), F.pmod(F.xxhash64(text, key), F.lit(1 << 30)).alias("u"), F.col(key).alias("key"))
    rows = rows.where(~held_out(F.col("key")) & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    if not counts:
        return rows.where(F.lit(False)).select("lang", "text")
    below = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, 2 * SAMPLE_ROWS / r["n"]) * (1 << 30)))])
    near = rows.where(F.col("u") < F.element_at(below, F.col("lang"))).groupBy("lang", "u", "h").agg(F.first("text").alias("text"))
    least = Window.partitionBy("lang").orderBy("u", "h")
    return near.withColumn("i", F.row_number().over(least)).where(F.col("i") <= SAMPLE_ROWS).select("lang", "text")


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Count the sample's grams on the executors and grow the trees.

    What reaches the driver is bounded by the sample: the different grams of SAMPLE_ROWS
    texts of each language, however many rows there are.
    """
    size = ORDER + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in slices(batches, 1):
            for own in set(batch.column(0).to_pylist()):
                part = batch.filter(pa.compute.equal(batch.column(0), own))
                new = count_keys(gram_keys(*text_bytes(part.column(1)), size))
                held[own] = add_counts(held[own], new) if own in held else new
        for own, (keys, times) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([own] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(times, pa.int64())], ["lang", "gram", "times"])

    grams = map_batches(sample(df, key, text, lang), run, "lang string, gram long, times long")
    found = grams.groupBy("lang", "gram").agg(F.sum("times").alias("times")).toArrow()
    counts = {}
    for own in pa.compute.unique(found.column("lang")).to_pylist():
        part = found.filter(pa.compute.equal(found.column("lang"), own)).sort_by("gram")
        counts[own] = part.column("gram").to_numpy().view(np.uint64), part.column("times").to_numpy()
    return Model(counts)


def identify(df: DataFrame, model: Model, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns to carry, ``lang_pred``, ``score`` and ``bits_per_byte`` of every whole text.

    The prediction is the language whose tree codes the text in the fewest bits, ties
    to the first by name; the score is its share of 2 to the minus bits over all
    languages.  A text that is null or has no letter is ``und`` with score 0, and so
    is every text where no language was learned.  Repeated rows give repeated rows.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in slices(batches, 0):
            data, offsets = text_bytes(batch.column(0))
            letters = np.array([bool(t and _LETTER.search(t)) for t in batch.column(0).to_pylist()], bool)
            bits = own.score(data, offsets)
            if own.langs:
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(bits)), best]
                share = 1 / np.exp2(np.minimum(least[:, None] - bits, 0)).sum(axis=1)
                each = least / np.maximum(np.diff(offsets), 1)
            else:
                letters[:] = False
            langs = [own.langs[best[i]] if ok else UNDETERMINED for i, ok in enumerate(letters)]
            score = np.where(letters, share, 0.0) if own.langs else np.zeros(len(letters))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(each if own.langs else score, pa.float64(), mask=~letters)],
                [*carry, "lang_pred", "score", "bits_per_byte"],
            )

    return map_batches(df.select(F.col(text).alias("__text"), *carry), run, f"{ddl(df, list(carry))}, lang_pred string, score double, bits_per_byte double")


def identify_known(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", lang: str = "lang", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``identify`` and ``known``: whether a text of any length codes as texts of its best language do that were held out.

    The limit is set for each language by its held-out texts that were told right
    (one pair of numbers for each language, a literal).  An undetermined text is not known.
    """
    rows = df.where(held_out(F.col(key)) & F.col(lang).isNotNull()).select(F.col(lang).alias("own"), F.col(text).alias("text"), F.octet_length(text).alias("n"))
    right = identify(rows, model, "text", ("own", "n")).where("own = lang_pred").select("own", F.col("bits_per_byte").alias("bits"), F.sqrt(1 + SHORT / F.col("n")).alias("wide"))
    right = written(right, "held-out")
    middle = quantile("bits", 0.5).alias("mid")
    total = right.agg(F.count("*").alias("n"), middle).first()
    each = written(right.groupBy("own").agg(F.count("*").alias("n"), middle), "middles")  # written, so that it is broadcast
    away = ((F.col("bits") - F.col("mid")) / F.col("wide")).alias("away")
    far = right.withColumn("mid", F.lit(total["mid"]).cast("double")).select(away).agg(quantile("away", HIGH).alias("far")).first()["far"]
    far = max(far, (total["n"] * far + POOL * PRIOR) / (total["n"] + POOL)) if total["n"] else None
    limits = {}
    for own, n, mid, own_far in each.join(right.join(each, "own").select("own", away).groupBy("own").agg(quantile("away", HIGH).alias("far")), "own").collect():
        drawn = max(own_far, (n * own_far + POOL * far) / (n + POOL)) * (1 + 1 / n) ** 0.5
        limits[own] = (n * mid + POOL * max(mid, total["mid"])) / (n + POOL), REACH * drawn
    found = identify(df, model, text, tuple(dict.fromkeys((*carry, text))))
    limit = F.lit(MOST_BITS if far is None else total["mid"]), F.lit(0.0 if far is None else REACH * far)
    if limits:
        maps = (F.create_map(*[F.lit(x) for own, pair in limits.items() for x in (own, pair[i])]) for i in (0, 1))
        limit = tuple(F.coalesce(F.element_at(m, F.col("lang_pred")), rest) for m, rest in zip(maps, limit, strict=True))
    wide = F.sqrt(1 + SHORT / F.octet_length(text))
    known = (F.col("lang_pred") != UNDETERMINED) & F.coalesce(F.col("bits_per_byte") <= limit[0] + limit[1] * wide, F.lit(False))
    return found.select(*carry, "lang_pred", "score", "bits_per_byte", known.alias("known"))
