"""Language identification by language-bitmask n-gram filters.

Training: from a sample of labelled documents (bounded: SAMPLE_DOCS a language, chosen by a hash of the id) the
character n-grams that MIN_DOCS documents of a language hold go into a Bloom filter. The filters of all languages share
their slots and hash functions and are stored by slot, as a bit mask with one bit a language (bit-sliced). So one read of
HASHES slots and one AND give all languages that hold an n-gram.

Prediction: all n-grams of a whole text are looked up at once; the population count of each language's bit over the text,
corrected by that filter's rate of false positives, decides. score is the share of the n-grams that the winner holds.

Defined cases: und with score 0 if the text is null or has no letter, or if nothing could be learned; no n-gram known: the
language with most training documents, score 0; ties go to the language with more training documents, then by code point;
a null doc_id is not held out and not learned from; rows with a null lang are predicted, not learned from; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sent_if_small

#: n-gram lengths, training documents of a language (about), documents of a language that must hold an n-gram.
GRAMS, SAMPLE_DOCS, MIN_DOCS = (2, 3, 4, 5), 600, 2
#: Slots of the filters and hash functions.
SLOTS, HASHES = 1 << 22, 2
U = np.uint64


@dataclass(frozen=True)
class LanguageFilter:
    languages: tuple[str, ...]
    #: (words of 64 languages, SLOTS)
    masks: np.ndarray
    #: Of each language: the chance that an n-gram that it doesn't hold seems to be held.
    false_rate: np.ndarray


_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


def gram_hashes(text: str | None) -> np.ndarray:
    """Hashes of the n-grams of a text's words, in lower case and padded with a space; empty if it has no letter."""
    if not text:
        return np.empty(0, dtype=U)
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[code]
    if not letter.any():
        return np.empty(0, dtype=U)
    keep = letter | np.r_[False, letter[:-1]]  # a run of other characters becomes one space
    keep[0] = True
    code, letter = np.where(letter, code, 32)[keep].astype(U), letter[keep]
    found = []
    rolled = np.full(len(code), U(0))
    inner = np.zeros(len(code), dtype=bool)  # a space inside the n-gram
    for n in range(1, max(GRAMS) + 1):
        if n > len(code):
            break
        last = code[n - 1 :]
        rolled = rolled[: len(last)] * U(0x9E3779B97F4A7C15) + last + U(1)
        if n > 2:
            inner = inner[: len(last)] | ~letter[n - 2 : len(code) - 1]
        else:
            inner = inner[: len(last)]
        if n in GRAMS:
            x = rolled[~inner] + U(n << 40)
            x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
            found.append(x ^ (x >> U(32)))
    return np.concatenate(found)


def _slots(hashes: np.ndarray) -> list[np.ndarray]:
    return [((hashes >> U(24 * k)) % U(SLOTS)).astype(np.int64) for k in range(HASHES)]


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LanguageFilter | None:
    """The filters of docs' labelled documents that are not held out; None if there are none.

    The driver gets a row a language, and at most SLOTS masks."""
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    usable = usable.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = tuple(sorted(counts, key=lambda x: (-counts[x], x)))
    number = {x: i for i, x in enumerate(languages)}
    spark = docs.sparkSession
    table = spark.createDataFrame([(x, i, min(1.0, sample_docs / counts[x])) for x, i in number.items()], "lang string, language int, share double")
    picked = usable.join(sent_if_small(table), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.col("share") * 1_000_003)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for language, part in batch.groupby("language"):
                held = [np.unique(gram_hashes(t)) for t in part["text"]]
                hashes, docs_with = np.unique(np.concatenate(held), return_counts=True)
                yield pd.DataFrame({"language": np.int32(language), "gram": hashes.view(np.int64), "docs": docs_with})

    dfs = picked.select("language", "text").mapInPandas(grams, "language int, gram long, docs long").groupBy("language", "gram").agg(F.sum("docs").alias("docs"))

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in _slots(batch["gram"].to_numpy().view(U)):
                yield pd.DataFrame({"word": batch["language"] // 64, "slot": at, "mask": (U(1) << (batch["language"].to_numpy() % 64).astype(U)).view(np.int64)})

    # A language with a single document keeps what that one holds.
    least = F.when(F.col("language").isin([i for x, i in number.items() if counts[x] < 2 * MIN_DOCS]), 1).otherwise(MIN_DOCS)
    filled = dfs.filter(F.col("docs") >= least).mapInPandas(slots, "word int, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()  # no Python object a row
    masks = np.zeros((-(-len(languages) // 64), SLOTS), dtype=U)
    masks[filled["word"].to_numpy(), filled["slot"].to_numpy()] = filled["mask"].to_numpy().view(U)
    fill = np.array([np.count_nonzero(masks[i // 64] >> U(i % 64) & U(1)) for i in range(len(languages))]) / SLOTS
    return LanguageFilter(languages, masks.astype(np.uint8) if len(languages) <= 8 else masks, fill**HASHES)


def predict(model: LanguageFilter | None, text: str | None) -> tuple[str, float]:
    hashes = gram_hashes(text)
    if model is None or not len(hashes):
        return "und", 0.0
    hits = np.zeros(len(model.languages))
    at = _slots(hashes)
    for w, row in enumerate(model.masks):
        held = row[at[0]]
        for a in at[1:]:
            held = held & row[a]
        values, times = (np.arange(256), np.bincount(held, minlength=256)) if row.dtype == np.uint8 else np.unique(held, return_counts=True)
        for i in range(w * 64, min(len(hits), w * 64 + 64)):
            hits[i] = times[(values >> values.dtype.type(i % 64)) & values.dtype.type(1) == 1].sum()
    true = np.maximum(0.0, hits - len(hashes) * model.false_rate) / (1 - model.false_rate)
    best = int(np.argmax(true))
    return model.languages[best], float(min(1.0, true[best] / len(hashes)))


def identify(docs: DataFrame, model: LanguageFilter | None, keep: list[str]) -> DataFrame:
    """The columns keep of docs, with lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS masks: a fixed size

    def predicted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [predict(sent.value, t) for t in batch["__text"]]
            yield batch.drop(columns="__text").assign(lang_pred=[x for x, _ in found], score=[s for _, s in found])

    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInPandas(predicted, f"{kept}, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from docs' own labels that are not held out."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = identify(ids, train(docs), ["doc_id"])
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def has_language(model: LanguageFilter | None, text: str | None, labelled: bool) -> bool:
    """Whether a text with a letter has n-grams of a learned language, beyond false positives, or at least a label.

    Without learned languages nothing speaks against a text with a letter."""
    if model is None:
        return len(gram_hashes(text)) > 0
    language, score = predict(model, text)
    return language != "und" and (score > 0 or labelled)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text has a language (has_language), with all columns of docs.

    The text goes through Python once, together with a flag; no join puts rows together again."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs))

    def flagged(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, labelled in columns:
            yield pd.Series([has_language(sent.value, t, x) for t, x in zip(texts, labelled, strict=True)], dtype=bool)

    flagged.__annotations__ = {"columns": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return docs.filter(F.pandas_udf(flagged, "boolean")(F.col("text").cast("string"), F.col("lang").isNotNull()))
