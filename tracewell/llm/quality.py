"""Quality by the perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import bloom_semi, ddl, map_batches, quantile, slices, text_bytes, written
from tracewell.llm.grams import add_counts, count_keys, gram_keys, long_text_grams, look_up

#: Grams of bytes: the last byte and four bytes of context.
SIZE = 5
#: Grams whose probabilities are sent to the workers at a time: 12 bytes each.
SHARD_ROWS = 2_000_000
#: Grams that a task gathers before it hands them on.
HELD_ROWS = 500_000
#: Bytes of a long text that are scored at a time.
PART_BYTES = 4 << 20


def _grams(df: DataFrame, text: str) -> DataFrame:
    """(gram, times) of all texts, summed within tasks as far as HELD_ROWS allows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in slices(batches, 0):
            held = add_counts(held, text_grams_of(batch.column(0)))
            if len(held[0]) > HELD_ROWS:
                yield _counted(*held)
                held = held[0][:0], held[1][:0]
        yield _counted(*held)

    return map_batches(df.select(text), run, "gram long, times long")


def text_grams_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a slice of texts and how often each comes."""
    data, offsets = text_bytes(column)
    if len(offsets) == 2:
        return long_text_grams(data, SIZE, 4 << 20)
    return count_keys(gram_keys(data, offsets, SIZE))


def _counted(keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(times, pa.int64())], ["gram", "times"])


def _tail(gram: str | Column, size: int) -> Column:
    """The last ``size`` bytes of a gram."""
    return (F.col(gram) if isinstance(gram, str) else gram).bitwiseAND(F.lit((1 << 8 * size) - 1))


class KneserNey:
    """Counts of trusted text as distributed tables, one for each order.

    Order SIZE has raw counts; a lower order counts the different bytes before a gram.
    The three discounts of an order come from its numbers of grams with count 1 to 4
    (Chen and Goodman, 1998); where these are too few to tell, from 1/2, 1 and 3/2.
    """

    def __init__(self, trusted: DataFrame, text: str = "text"):
        top = _grams(trusted, text).groupBy("gram").agg(F.sum("times").alias("c"))
        self.tables = {SIZE: written(top, "grams")}
        for k in range(SIZE - 1, 0, -1):
            self.tables[k] = written(self.tables[k + 1].groupBy(_tail("gram", k).alias("gram")).agg(F.count("*").alias("c")), "grams")
        few = [t.where("c < 5").groupBy("c").agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "c", "n") for k, t in self.tables.items()]
        n = {(k, c): x for k, c, x in reduce(DataFrame.union, few).collect()}
        self.discounts = {k: self._discounts([n.get((k, c), 0) for c in range(1, 5)]) for k in self.tables}

    @staticmethod
    def _discounts(n: list[int]) -> list[float]:
        if 0 in n:
            return [0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.01), i - 0.01) for i in (1, 2, 3)]

    def _discount(self, k: int) -> Column:
        one, two, three = self.discounts[k]
        return F.when(F.col("c") == 1, one).when(F.col("c") == 2, two).when(F.col("c") > 2, three).otherwise(0.0)

    def probabilities(self, wanted: DataFrame) -> DataFrame:
        """(gram, bits) of distinct wanted grams: minus log2 of the last byte's probability after the others.

        Each order joins the wanted grams with its counts, with its contexts, and with
        what the next lower order found: shuffles on grams, nothing else.
        """
        asked = {SIZE: wanted.select("gram")}
        for k in range(SIZE - 1, 0, -1):
            asked[k] = written(asked[k + 1].select(_tail("gram", k).alias("gram")).distinct(), "asked")
        lower = None
        for k in range(1, SIZE + 1):
            table = self.tables[k]
            contexts = table.groupBy(F.shiftright("gram", 8).alias("h")).agg(F.sum("c").alias("total"), F.sum(self._discount(k)).alias("mass"))
            rows = asked[k].join(table, "gram", "left").withColumn("h", F.shiftright("gram", 8)).join(contexts, "h", "left")
            if lower is None:
                rows = rows.withColumn("q", F.lit(1 / 256))
            else:
                rows = rows.withColumn("low", _tail("gram", k - 1)).join(lower.select(F.col("gram").alias("low"), F.col("p").alias("q")), "low")
            own = (F.coalesce("c", F.lit(0)) - self._discount(k)) / F.col("total") + F.col("mass") / F.col("total") * F.col("q")
            lower = rows.select("gram", F.when(F.col("total").isNull(), F.col("q")).otherwise(own).alias("p"))
            if k in (3, SIZE):
                lower = written(lower, "probabilities")
        return lower.select("gram", (-F.log2("p")).cast("float").alias("bits"))


#: Runs of bytes whose worst mean is scored beside the whole text: a word, and a sentence or two.
WINDOWS = {"peak": 8, "stretch": 128}


def worst_runs(bits: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """The most bits a byte that ``size`` neighbouring bytes of each text need; a shorter text counts as if filled up with bytes of none."""
    counts = np.diff(offsets)
    sums = np.concatenate([np.zeros(1), np.cumsum(bits, dtype=np.float64)])
    out = sums[offsets[1:]] - sums[offsets[:-1]]
    full = np.flatnonzero(counts >= size)
    if len(full):
        runs = sums[size:] - sums[:-size]
        runs[np.arange(size, len(sums)) > np.repeat(offsets[1:], counts)[: len(runs)]] = -np.inf  # these run into the next text
        out[full] = np.maximum.reduceat(runs, offsets[:-1][full])
    return out / size


def perplexity(df: DataFrame, model: KneserNey, key: str = "doc_id", text: str = "text", lang: str = "lang", carry: Sequence[str] = ()) -> DataFrame:
    """key, lang, the other columns to carry, ``n_bytes``, ``perplexity`` (a byte; null for an empty text) and the worst run of each of WINDOWS, in bits a byte, of every whole text.

    The distinct grams of all texts are looked up once, by joins; the answers come
    back to the texts in shards of SHARD_ROWS grams, so that texts are never shuffled
    and a worker holds one shard at a time.
    """
    wanted = written(_grams(df, text).select("gram").distinct(), "wanted")
    answers = written(model.probabilities(wanted), "answers")
    shards = max(1, -(-answers.count() // SHARD_ROWS))
    held = []
    for i in range(shards):
        part = (answers if shards == 1 else answers.where(F.pmod(F.xxhash64("gram"), F.lit(shards)) == i)).toArrow().sort_by("gram")
        held.append(df.sparkSession.sparkContext.broadcast((part.column("gram").to_numpy().view(np.uint64), part.column("bits").to_numpy())))

    def answers_of(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted grams and their bits: a worker goes through the shards once for a batch of texts, and holds one at a time."""
        found = np.zeros(len(own))
        for shard in held:
            grams, bits = shard.value
            at, known = look_up(grams, own)
            found[known] = bits[at[known]]
            del grams, bits, shard._value
        return own, found

    def score(data: np.ndarray, offsets: np.ndarray, answers: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """Total bits and worst runs; a text by itself is worked through in parts, each after the last bytes of the one before."""

        def bits_of(keys: np.ndarray) -> np.ndarray:
            own, place = np.unique(keys, return_inverse=True)
            at, known = look_up(answers[0], own)
            bits = np.zeros(len(own))  # sums need more digits than the answers have
            bits[known] = answers[1][at[known]]
            return bits[place]

        if len(offsets) > 2:
            bits = bits_of(gram_keys(data, offsets, SIZE))
            sums = np.concatenate([np.zeros(1), np.cumsum(bits)])
            return [sums[offsets[1:]] - sums[offsets[:-1]], *(worst_runs(bits, offsets, size) for size in WINDOWS.values())]
        out, tail = np.zeros((1 + len(WINDOWS), 1)), np.zeros(0)
        for at in range(0, len(data), PART_BYTES):
            before = min(at, SIZE - 1)
            part = data[at - before : at + PART_BYTES]
            bits = bits_of(gram_keys(part, np.array([0, len(part)]), SIZE)[before:])
            out[0] += bits.sum()
            run_on = np.concatenate([tail, bits])
            for i, size in enumerate(WINDOWS.values(), 1):
                out[i] = np.maximum(out[i], worst_runs(run_on, np.array([0, len(run_on)]), size))
            tail = run_on[-max(WINDOWS.values()) + 1 :]
        return list(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if len(held) == 1:
                answers = held[0].value
            else:
                own_grams = np.zeros(0, np.uint64)
                for batch in slices([whole], 1):
                    own_grams = np.union1d(own_grams, text_grams_of(batch.column(1))[0])
                answers = answers_of(own_grams)
            for batch in slices([whole], 1):
                data, offsets = text_bytes(batch.column(1))
                total, *worst = score(data, offsets, answers)
                n = np.diff(offsets)
                each = np.exp2(total / np.maximum(n, 1))
                measured = [pa.array(x, pa.float64(), mask=n == 0) for x in (each, *worst)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(n, pa.int64()), *measured], [*own, "n_bytes", "perplexity", *WINDOWS])

    own = list(dict.fromkeys((key, lang, *carry)))
    rows = df.select(F.col(key).cast("long").alias(key), text, lang, *(c for c in own if c not in (key, text, lang)))
    schema = f"{ddl(rows, own)}, n_bytes long, perplexity double, {', '.join(f'{w} double' for w in WINDOWS)}"
    return map_batches(rows, run, schema)


def trusted_ids(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents that every label row calls good and none toxic."""
    rows = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.coalesce("quality", F.lit(0))).alias("good"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return rows.where("good = 1 and toxic = 0").select(F.col(key).cast("long").alias(key))


def _for_thresholds(key: str) -> Column:
    """The fifth of the trusted documents that the counts leave out."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


#: The quantiles of trusted texts that fence a language's texts.  The low one is of all trusted texts, as those that the
#: model has learned lie lower than others; the high ones are of those left out.
LOW, HIGH = 0.005, 0.995
#: The mean of few bytes strays further from the middle: with the root of 1 + SHORT / n_bytes.
SHORT = 2500
#: While a language has few texts, its quantiles are drawn out towards the overall ones, as if these came from so many texts,
#: and the overall ones towards PRIOR: distances from the middle of the mean (low, high), of the peak and of the stretch, in
#: bits.  They are never drawn in.  The middle that a distance is counted from is drawn towards the overall one likewise.
POOL = 20
PRIOR = {"low": -0.15, "high": 0.15, "peak": 3.0, "stretch": 0.8}


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", carry: Sequence[str] = ()) -> DataFrame:
    """key, lang, the other columns to carry, n_bytes, perplexity, the worst runs of WINDOWS, ``low``, ``high``, the runs' fences (``peak_high``) and ``keep`` for every row.

    The model is trained on all trusted texts (``trusted_ids``) but a fifth, whose
    quantiles set each language's fences; few texts of a language count little beside
    the overall quantiles (POOL), and a language, or null, with none takes those.  A
    text is kept if its perplexity lies between ``low`` and ``high``, which part for
    shorter texts, and none of its worst runs lies above its fence.  An empty text
    and, where no trusted text was left out, every text is kept.  Repeated rows give
    repeated rows.
    """
    trusted = written(trusted_ids(labels, key), "trusted")
    rows = df.select(F.col(key).cast("long").alias(key), F.col(text).alias(text)).where(~_for_thresholds(key) & F.col(text).isNotNull())
    learned = bloom_semi(rows, key, trusted).join(trusted, key, "left_semi")
    scores = written(perplexity(df, KneserNey(learned, text), key, text, lang, carry), "perplexity")
    known = scores.where("n_bytes > 0").join(trusted, key, "left_semi")
    known = known.select(lang, _for_thresholds(key).alias("left_out"), F.log2("perplexity").alias("mean"), *WINDOWS, F.sqrt(1 + SHORT / F.col("n_bytes")).alias("wide"))
    known = written(known, "known")
    measures = ["mean", *WINDOWS]
    middles = [F.count("*").alias("n"), *(quantile(m, 0.5).alias(f"{m}_mid") for m in measures)]
    whole = known.where("left_out").agg(*middles).first()
    if not whole["n"]:
        none = F.lit(None).cast("double")
        return scores.select("*", none.alias("low"), none.alias("high"), *(none.alias(f"{w}_high") for w in WINDOWS), F.lit(True).alias("keep"))

    def measure_of(end: str) -> str:
        return end if end in WINDOWS else "mean"

    def distances(middle: dict[str, Column]) -> list[Column]:
        away = {m: F.col(m) - middle[m] for m in measures} | {"mean": (F.col("mean") - middle["mean"]) / F.col("wide")}
        high = {"high" if m == "mean" else m: F.when(F.col("left_out"), away[m]) for m in measures}
        return [x.alias(end) for end, x in ({"low": away["mean"]} | high).items()]

    quantiles = [quantile(end, LOW if end == "low" else HIGH).alias(f"{end}_own") for end in PRIOR]
    overall = known.select(*distances({m: F.lit(whole[f"{m}_mid"]) for m in measures})).agg(*quantiles).first()
    outer = {end: (overall[f"{end}_own"], (whole["n"] * overall[f"{end}_own"] + POOL * far) / (whole["n"] + POOL)) for end, far in PRIOR.items()}
    pooled = {end: min(pair) if end == "low" else max(pair) for end, pair in outer.items()}
    each = written(known.where(F.col("left_out") & F.col(lang).isNotNull()).groupBy(lang).agg(*middles), "middles")  # written, so that it is broadcast
    each = each.join(known.join(each, lang).select(lang, *distances({m: F.col(f"{m}_mid") for m in measures})).groupBy(lang).agg(*quantiles), lang)
    # one more text of a language strays from the middle of its n by the root of 1 + 1 / n
    drawn = {end: (F.col(f"{end}_own"), (F.col("n") * F.col(f"{end}_own") + POOL * far) / (F.col("n") + POOL)) for end, far in pooled.items()}
    reach = {end: F.sqrt(1 + 1 / F.col("n")) * (F.least(*pair) if end == "low" else F.greatest(*pair)) for end, pair in drawn.items()}
    base = {}
    for end in pooled:
        own, total = F.col(f"{measure_of(end)}_mid"), F.lit(whole[f"{measure_of(end)}_mid"])
        further = F.least(own, total) if end == "low" else F.greatest(own, total)
        base[end] = (F.col("n") * own + POOL * further) / (F.col("n") + POOL)
    each = written(each.select(lang, *(x.alias(f"{end}_base") for end, x in base.items()), *(x.alias(f"{end}_reach") for end, x in reach.items())), "fences")
    base = {end: F.coalesce(f"{end}_base", F.lit(whole[f"{measure_of(end)}_mid"])) for end in pooled}
    reach = {end: F.coalesce(f"{end}_reach", F.lit(far)) for end, far in pooled.items()}
    wide = F.sqrt(1 + SHORT / F.greatest("n_bytes", F.lit(1)))
    fenced = scores.join(each, lang, "left").select(
        *scores.columns,
        *(F.pow(F.lit(2.0), base[end] + reach[end] * wide).alias(end) for end in ("low", "high")),
        *((base[w] + reach[w]).alias(f"{w}_high") for w in WINDOWS),
    )
    inside = F.col("perplexity").between(F.col("low"), F.col("high"))
    for w in WINDOWS:
        inside = inside & (F.col(w) <= F.col(f"{w}_high"))
    return fenced.withColumn("keep", F.coalesce(inside, F.lit(True)))
