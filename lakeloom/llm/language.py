"""Language identification of texts in several languages by expectation-maximisation.

A language's model is the distribution of its letter trigrams (of UTF-8 bytes, lower case, words bounded by a blank), hashed
into ``BINS`` bins. The words of a document are draws from a mixture of languages; expectation-maximisation estimates the
proportions from the words' trigram likelihoods. The set of languages is grown from the most likely single one by the order
of the full mixture's proportions, as long as twice the gain in log likelihood is above ``PENALTY`` * log(words); nothing else bounds it.

Models are fitted on a bounded sample: of each language about ``SAMPLE`` documents, chosen by a hash of the id, with their whole
texts. Every language of the sample is learned; where the model would take more than ``MODEL_BYTES`` that is an error.

Memory: texts are taken in parts of at most ``PART_CHARS`` characters (cut at blanks, or anywhere in a longer word) and so many words that
words times languages stay under ``CELLS``. A text of more parts than that is fitted part by part in each round.

Defined results: ``und`` with score 0 if the text is null or has no letter, or nothing was learned; repeated rows are treated
alike; rows with null lang teach nothing; ids and other columns aren't inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import ROW, ROW_TYPE, by_bytes, cut, numbered, prepare_workers, task, texts_of, without

BINS = 1 << 16
SAMPLE = 3000
#: Bytes that the model may take in the driver and in each worker: 4 for each bin and language.
MODEL_BYTES = 256_000_000
#: Cost of a language, share that a language needs; expectation-maximisation ends when no proportion moves by more than STILL, or
#: after ROUNDS, which proportions that creep on reach.
PENALTY, SHARE, STILL, ROUNDS = 8.0, 0.03, 1e-3, 200
#: Characters of a part of a text, and cells of words and languages held at once.
PART_CHARS, CELLS = 200_000, 1_000_000
_SMOOTH = 0.5
#: UTF-8 bytes to 7 bits: 0 for what isn't a letter.
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[128:192] = np.arange(27, 91)
_CODE[192:256] = 91 + (np.arange(64) & 31)


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of all trigrams with a letter in the middle or at the end, the first of each word, the first word of each text."""
    encoded = [t.lower().encode("utf-8", "replace") + b" " for t in texts]
    codes = _CODE[np.frombuffer(b" " + b"".join(encoded), np.uint8)]
    at = np.flatnonzero((codes[1:] > 0) | (codes[:-1] > 0)) + 1  # ends of trigrams
    before = codes[np.maximum(at - 2, 0)] * (codes[at - 1] > 0)
    code = (before << 14) | (codes[at - 1] << 7) | codes[at]
    bins = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    starts = np.flatnonzero(codes[at - 1] == 0)  # a word's first trigram ends in its first letter
    ends = np.cumsum([len(e) for e in encoded])
    return bins, starts, np.searchsorted(at[starts], np.concatenate([[0], ends]), side="right")


@task
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in by_bytes(batches, "text", 1_000_000):
        langs = np.array(batch.column(1).to_pylist(), object)
        texts = texts_of(batch, "text")
        for lang in set(langs):
            bins, _, _ = _trigrams([t for t, x in zip(texts, langs, strict=True) if x == lang])
            counts.setdefault(lang, np.zeros(BINS, np.int64))
            counts[lang] += np.bincount(bins, minlength=BINS)
    for lang, c in counts.items():
        full = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full), pa.string()), pa.array(full), pa.array(c[full])], names=["lang", "bin", "n"])


def _in_parts(text: str) -> list[str]:
    """``text`` cut at blanks into parts of at most PART_CHARS characters; where there is none in reach, anywhere."""
    out, at = [], 0
    while len(text) - at > PART_CHARS:
        end = text.rfind(" ", at, at + PART_CHARS) + 1
        end = end if end > at else at + PART_CHARS
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


class Model:
    """Log likelihoods by bin and language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        used = max(1, int((counts.sum(axis=1) > 0).sum()))
        self.log = np.log((counts + _SMOOTH) / (counts.sum(axis=0) + _SMOOTH * 2 * used)).astype(np.float32) if langs else None

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood of each word by language, first word of each text)."""
        bins, starts, first = _trigrams(texts)
        out = np.empty((len(starts), len(self.langs)), np.float32)
        ends = np.append(starts[1:], len(bins))
        # a run of words whose trigrams have CELLS cells at a time
        most, a = max(1, CELLS // len(self.langs)), 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + most, side="right")))
            out[a:b] = np.add.reduceat(self.log[bins[starts[a] : ends[b - 1]]], starts[a:b] - starts[a], axis=0)
            a = b
        return out, first

    def mixtures(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(proportions by text and language, 0 outside the chosen set; likelihood share of the best single language)."""
        shares, sure = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        most = max(1000, 8 * CELLS // len(self.langs))  # characters; a word has some eight
        start = held = 0
        for i, t in enumerate([*texts, None]):
            n = len(t) if t is not None else most
            if held + n > most or n > PART_CHARS:
                if i > start:
                    shares[start:i], sure[start:i] = self._fitted([texts[start:i]], i - start)
                start, held = i, 0
                if t is not None and n > min(most, PART_CHARS):
                    shares[i], sure[i] = (x[0] for x in self._fitted([[p] for p in _in_parts(t)], 1))
                    start, held, n = i + 1, 0, 0
            held += n
        return shares, sure

    def _fitted(self, parts: list[list[str]], n: int) -> tuple[np.ndarray, np.ndarray]:
        """``mixtures`` of n texts: of one part with all of them, or of the parts of one text."""
        m = len(self.langs)
        kept: list[tuple | None] = [None] * len(parts)
        cells = 0

        def looked() -> Iterator[tuple]:
            """(likelihoods of words up to a factor, text of each word, first word of each text, log of the factors) of each part."""
            nonlocal cells
            for i, part in enumerate(parts):
                if kept[i] is not None:
                    yield kept[i]
                    continue
                word, first = self._words(part)
                peak = word.max(axis=1, initial=-np.inf)
                got = (np.exp(word - peak[:, None]), np.repeat(np.arange(len(part)), np.diff(first)), first, peak.astype(np.float64), word.sum(axis=0, dtype=np.float64) if n == 1 else _summed(word, first))
                if cells + word.size <= 2 * CELLS:
                    cells += word.size
                    kept[i] = got
                yield got

        single, sizes, offset = np.zeros((n, m)), np.zeros(n), np.zeros(n)
        for _, _, first, peak, log in looked():
            single += log
            sizes += np.diff(first)
            offset += _summed(peak, first)
        full = sizes > 0
        per = np.maximum(sizes, 1)[:, None]

        def fit(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            pi = allowed / allowed.sum(axis=1, keepdims=True)
            for _ in range(ROUNDS):
                new = np.zeros((n, m))
                for likely, owner, first, _, _ in looked():
                    part = likely * pi[owner].astype(np.float32)
                    part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
                    new += _summed(part, first)
                new /= per
                moved = float(np.abs(new - pi)[full].max(initial=0.0))
                pi = np.where(full[:, None], new, pi)
                if moved <= STILL:
                    break
            total = offset.copy()
            for likely, owner, first, _, _ in looked():
                total += _summed(np.log(np.maximum((likely * pi[owner].astype(np.float32)).sum(axis=1), 1e-30)).astype(np.float64), first)
            return pi, total

        rows = np.arange(n)
        best = single.argmax(axis=1)
        exact = np.exp(single - single.max(axis=1, keepdims=True))
        sure = np.where(full, exact[rows, best] / exact.sum(axis=1), 0.0)
        pi = np.zeros((n, m))
        pi[rows, best] = 1
        score = single.max(axis=1)
        if m > 1 and full.any():
            mixed, _ = fit(np.ones((n, m)))
            mixed[rows, best] += 1  # the single best comes first, then by proportion
            order = np.argsort(-mixed, axis=1, kind="stable")
            growing = full.copy()
            for k in range(2, m + 1):
                added = order[:, k - 1]
                growing &= mixed[rows, added] >= SHARE
                if not growing.any():
                    break
                allowed = np.zeros((n, m))
                for j in range(k):
                    allowed[rows, order[:, j]] = 1
                new, total = fit(allowed)
                growing &= 2 * (total - score) > PENALTY * np.log(sizes + 1)
                pi[growing], score[growing] = new[growing], total[growing]
        return np.where(full[:, None], pi, 0.0), sure


def _summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows of each text; 0 for a text without any."""
    out = np.zeros((len(first) - 1, *values.shape[1:]))
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        out[some] = np.add.reduceat(values, first[:-1][some], axis=0, dtype=np.float64)
    return out


def _packed(key: tuple, table: pa.Table) -> pa.Table:
    counts = np.zeros(BINS, "<i8")
    counts[table.column("bin").to_numpy()] = table.column("n").to_numpy()
    return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "counts": pa.array([counts.tobytes()], pa.binary())})


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on rows whose crc32(id as text) mod 5 is not 0 and whose language is known."""
    spark = docs.sparkSession
    prepare_workers(spark)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and id is not null and text is not null").filter(F.crc32(F.col("id").cast("binary")) % 5 != 0)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(MODEL_BYTES // (4 * BINS) + 1).collect()}
    if 4 * BINS * len(sizes) > MODEL_BYTES:
        raise ValueError(f"more than {MODEL_BYTES // (4 * BINS)} languages: the model would take more than MODEL_BYTES")
    if not sizes:
        return Model([], np.zeros((BINS, 0)))
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, sample / n)))])
    chosen = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0 < share[F.col("lang")])
    grams = chosen.select("id", "lang", "text").mapInArrow(_counted, "lang string, bin long, n long")
    langs, counts = sorted(sizes), np.zeros((BINS, len(sizes)), np.float32)
    at = {lang: i for i, lang in enumerate(langs)}
    packed = grams.groupBy("lang", "bin").agg(F.sum("n").alias("n")).groupBy("lang").applyInArrow(_packed, "lang string, counts binary")
    for r in packed.toLocalIterator():  # a row for each language
        counts[:, at[r["lang"]]] = np.frombuffer(r["counts"], "<i8")
    return Model(langs, counts)


@task
def _predicted(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", 1_000_000):
        texts = texts_of(batch, "text")
        preds, scores, sets = [], [], []
        shares, sure = model.mixtures(texts) if model.langs else (None, None)
        for i, t in enumerate(texts):
            if shares is None or not shares[i].any() or not any(map(str.isalpha, t)):
                preds.append("und")
                scores.append(0.0)
                sets.append([])
                continue
            top = int(shares[i].argmax())
            preds.append(model.langs[top])
            scores.append(float(min(1.0, shares[i, top] * (sure[i] if shares[i, top] >= 1 else 1.0))))
            sets.append([(model.langs[j], float(shares[i, j])) for j in np.argsort(-shares[i], kind="stable") if shares[i, j] > 0])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))], names=["doc_id", "lang_pred", "score", "proportions"])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: ``doc_id, held_out, lang_pred, score, proportions`` (map of the chosen languages)."""
    spark = docs.sparkSession
    prepare_workers(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = ROW_TYPE if id_col == ROW else "long"
    texts = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = texts.mapInArrow(lambda it: _predicted(shared.value, it), f"doc_id {kind}, lang_pred string, score double, proportions map<string,double>")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "proportions")


def drop_unidentified(docs: DataFrame, least_score: float = 0.35, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without those of no identified language (``und``, or a score under ``least_score``); all columns stay."""
    docs = numbered(docs)
    found = identify(docs, learn(docs, id_col, text_col, lang_col), ROW, text_col)
    return without(docs, cut(found.filter((F.col("lang_pred") == "und") | (F.col("score") < least_score)).select(F.col("doc_id").alias(ROW)), "unidentified"))
