"""Language identification by mixture inference (operator 4).

A document's words are drawn from a mixture of languages; expectation-maximisation estimates the
proportions from n-gram likelihoods, and of the sets of the s likeliest languages, for every s, the
one of highest penalised likelihood is kept. Texts that are null or have no letter get `und` and score
0; so does every text when nothing could be learned. Ties go to the language that sorts first. Rows are
independent, so repeated rows and rows with repeated or null ids are judged alike; very long texts are
judged whole. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import CHUNK_BYTES, LOWER, byte_set, chunks, utf8, word_spans
from .ngrams import BUCKETS, class_counts, gram_buckets
from .shared import map_batches

#: Bytes of words: letters, and all bytes of characters beyond ASCII.
LETTER = byte_set([*range(65, 91), *range(97, 123), *range(128, 256)])
ANY_LETTER = regex.compile(r"\p{L}")
#: Expectation-maximisation ends where no share of a document moves by more, or after so many steps.
TOLERANCE, STEPS = 1e-3, 100
#: Numbers (languages x letters) that one chunk of texts may have.
CHUNK_NUMBERS = 4 << 20


@dataclass
class LanguageModel:
    """Log-probabilities of buckets, one row per language (languages x 65,536 floats: at 200
    languages 52 MB, the bound of what is broadcast)."""

    languages: list[str]
    log_p: np.ndarray


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets at each byte (a gram does not reach beyond its word) and the word spans."""
    starts, ends, rows = word_spans(data, offsets, LETTER)
    codes = np.where(LETTER[data], LOWER[data], np.uint8(32))
    return gram_buckets(codes, offsets, 32), starts, ends, rows


def _row_buckets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    found, *_ = _codes(data, offsets)
    letters = LETTER[data]
    for row in range(len(offsets) - 1):
        part = slice(offsets[row], offsets[row + 1])
        yield row, found[part][letters[part]]


def learn(documents: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Counts over all rows with a language, gathered by Spark; only the sums reach the driver."""
    rows = documents.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    counts = class_counts(rows, _row_buckets).where("bucket >= 0").toPandas()
    languages = sorted(counts.label.unique())
    table = np.zeros((BUCKETS, len(languages)))
    at = {x: i for i, x in enumerate(languages)}
    table[counts.bucket.to_numpy(dtype=np.int64), counts.label.map(at).to_numpy(dtype=np.int64)] = counts.n.to_numpy(dtype=float)
    table += 0.5
    return LanguageModel(languages, np.ascontiguousarray(np.log(table / table.sum(axis=0)).T.astype(np.float32)))


def _shares(p: np.ndarray, count: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Proportions (languages x rows) of the allowed languages in rows whose words are consecutive,
    by expectation-maximisation from equal shares; p has each word's likelihoods up to a factor.
    Rows that have settled are left out of further steps."""
    pi = (allowed / allowed.sum(axis=0)).astype(np.float32)
    out, live = pi.copy(), np.arange(len(count))
    for step in range(1, STEPS + 1):
        r = p * np.repeat(pi, count, axis=1)
        r /= np.maximum(r.sum(axis=0), np.float32(1e-30))
        new = np.add.reduceat(r, np.cumsum(count) - count, axis=1) * allowed
        new /= np.maximum(new.sum(axis=0), np.float32(1e-30))
        settled = np.abs(new - pi).max(axis=0) < TOLERANCE
        pi = new
        if step % 4 == 0 or step == STEPS or settled.all():
            out[:, live] = pi
            if settled.all():
                break
            on = ~settled
            p, pi, allowed, live, count = p[:, np.repeat(on, count)], pi[:, on], allowed[:, on], live[on], count[on]
    return out


def _likelihoods(p: np.ndarray, top: np.ndarray, count: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Log-likelihood of each row under its proportions; p is over exp(top)."""
    total = (p * np.repeat(pi, count, axis=1)).sum(axis=0)
    return np.add.reduceat(np.log(np.maximum(total, np.float32(1e-30))) + top, np.cumsum(count) - count)


def choose(ll: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (languages x rows; 0 outside the chosen set) and log-likelihoods of rows, from the
    log-likelihoods (languages x words) of their consecutive words.

    A language more costs twice the logarithm of the number of words. A row whose best language alone
    is not beaten even by every word taking its own best language, less the cost of two, is settled;
    the others try the sets of all sizes.
    """
    n_langs, rows = len(ll), len(count)
    first = np.cumsum(count) - count
    top = ll.max(axis=0)
    single = np.add.reduceat(ll, first, axis=1)
    pick = np.zeros((n_langs, rows), dtype=np.float32)
    pick[single.argmax(axis=0), np.arange(rows)] = 1
    best = single.max(axis=0).astype(float)
    likelihood, cost = best.copy(), 2.0 * np.log(count + 1.0)
    bound = np.add.reduceat(top, first)
    open_ = np.flatnonzero(best < bound - cost) if n_langs > 1 else np.zeros(0, dtype=np.int64)
    if not len(open_):
        return pick, likelihood
    words = np.repeat(np.isin(np.arange(rows), open_), count)
    part, n, high = ll[:, words], count[open_], top[words]
    p = np.exp(part - high)
    full = _shares(p, n, np.ones((n_langs, len(open_)), dtype=np.float32))
    rank = np.argsort(np.argsort(-full, axis=0, kind="stable"), axis=0, kind="stable")
    for size in range(2, n_langs + 1):
        left = best[open_] < bound[open_] - cost[open_] * (size - 1)  # the others cannot gain any more
        if not left.all():
            on = np.repeat(left, n)
            p, high, n, rank, open_ = p[:, on], high[on], n[left], rank[:, left], open_[left]
        if not len(open_):
            break
        pi = _shares(p, n, (rank < size).astype(np.float32))
        value = _likelihoods(p, high, n, pi)
        better = value - cost[open_] * (size - 1) > best[open_] + 1e-9
        at = open_[better]
        best[at], likelihood[at], pick[:, at] = (value - cost[open_] * (size - 1))[better], value[better], pi[:, better]
    return pick, likelihood


def infer(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the languages (indices, best first, -1 unused) with their proportions, its fit,
    and whether it has any word. The fit is the mean log-likelihood of its n-grams under its mixture
    over that under equal chances for all buckets: above 0, the learned languages explain it."""
    n, count_langs = len(offsets) - 1, len(model.languages)
    chosen, shares, fit = np.full((n, count_langs), -1), np.zeros((n, count_langs)), np.zeros(n)
    found, starts, ends, rows = _codes(data, offsets)
    some, count = np.unique(rows, return_counts=True)
    has = np.zeros(n, dtype=bool)
    if not len(some):
        return chosen, shares, fit, has
    # The letters alone are the words, one after another.
    grams = found[LETTER[data]]
    lengths = ends - starts
    begin = np.cumsum(lengths) - lengths
    pick, likelihood = choose(np.stack([np.add.reduceat(column[grams], begin) for column in model.log_p]), count)
    pick = pick.T.astype(float)
    by = np.argsort(-pick, axis=1, kind="stable")
    shares[some] = np.take_along_axis(pick, by, axis=1)
    chosen[some] = np.where(shares[some] > 0, by, -1)
    fit[some] = likelihood / np.add.reduceat(lengths, np.cumsum(count) - count) + np.log(BUCKETS)
    has[some] = True
    return chosen, shares, fit, has


def identify(documents: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, languages, shares, fit): the chosen set with its proportions,
    largest first; lang_pred and score are the first of them, fit is as in `infer` (null for `und`)."""
    shared = documents.sparkSession.sparkContext.broadcast((model.languages, model.log_p))
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, log_p = shared.value
        own = LanguageModel(languages, log_p)
        for batch in batches:
            texts = batch.column(1)
            data, offsets = utf8(texts)
            for i, j in chunks(offsets, max(1 << 16, min(CHUNK_BYTES, CHUNK_NUMBERS // max(1, len(languages))))):
                part = data[offsets[i] : offsets[j]]
                fits = [None] * (j - i)
                names, shares = [[] for _ in range(i, j)], [[] for _ in range(i, j)]
                if languages:
                    chosen, share, fit, has = infer(own, part, offsets[i : j + 1] - offsets[i])
                    for k in np.flatnonzero(has):
                        if ANY_LETTER.search(texts[i + int(k)].as_py()):
                            used = chosen[k] >= 0
                            names[k], shares[k] = [languages[x] for x in chosen[k][used]], share[k][used].tolist()
                            fits[k] = float(fit[k])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([x[0] if x else "und" for x in names], type=pa.string()),
                        pa.array([min(1.0, max(0.0, x[0])) if x else 0.0 for x in shares], type=pa.float64()),
                        pa.array(names, type=pa.list_(pa.string())),
                        pa.array(shares, type=pa.list_(pa.float64())),
                        pa.array(fits, type=pa.float64()),
                    ],
                    names=[id_col, "lang_pred", "score", "languages", "shares", "fit"],
                )

    return map_batches(documents.select(id_col, F.col(text_col).cast("string").alias("text")), run, f"`{id_col}` {id_type}, lang_pred string, score double, languages array<string>, shares array<double>, fit double")
