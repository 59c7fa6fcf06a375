"""Language identification by a bit-sliced Bloom filter over letter n-grams.

One table of bit masks serves all languages: bit l of an entry belongs to language l, so the AND of the entries that
an n-gram hashes to says at once which languages have it. A text's n-grams are looked up together, hits are counted
for each language, the hits expected from false positives are taken off, and the rest is held against the share of
n-grams that the language's own training texts reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SIZES = (3, 4)
BLOCK = 1 << 19  # characters of a text that are looked at together
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)


def _blocks(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = min(len(text), at + BLOCK)
        if end < len(text):
            end = max(text.rfind(" ", at, end) + 1, 0) or end
            end = end if end > at else min(len(text), at + BLOCK)
        yield text[at:end]
        at = end


def grams(text: str) -> np.ndarray:
    """64-bit hashes of all letter n-grams of a block; words are padded by a space, no n-gram spans two words."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    letter = _letters()[chars]
    if not letter.any():
        return np.empty(0, dtype=np.uint64)
    keep = letter | np.concatenate([[False], letter[:-1]])
    padded = np.concatenate([[0], np.where(letter, chars, 0)[keep], [0]]).astype(np.uint64)
    space, out = padded == 0, []
    for n in SIZES:
        m = len(padded) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, dtype=np.uint64)
        inner = np.ones(m, dtype=bool)
        for j in range(n):
            h = (h ^ padded[j : j + m]) * _MIX
            h ^= h >> np.uint64(29)
            if 0 < j < n - 1:
                inner &= ~space[j : j + m]
        out.append(h[inner])
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (positions, words) of uint64, or positions of uint8 if there are 8 languages at most
    hashes: int
    false_rate: np.ndarray
    coverage: np.ndarray

    def masks(self, h: np.ndarray) -> np.ndarray:
        step = (h >> np.uint64(32)) | np.uint64(1)
        size = np.uint64(len(self.table))
        got = self.table[(h % size).astype(np.int64)]
        for j in range(1, self.hashes):
            got = got & self.table[((h + np.uint64(j) * step) % size).astype(np.int64)]
        return got

    def hits(self, text: str) -> tuple[np.ndarray, int]:
        total, n = np.zeros(len(self.languages)), 0
        for block in _blocks(text):
            h = grams(block)
            n += len(h)
            if not len(h):
                continue
            masks = self.masks(h)
            if masks.dtype == np.uint8:
                total += np.bincount(masks, minlength=256) @ _BITS[:, : len(self.languages)]
            else:
                for i in range(len(self.languages)):
                    total[i] += np.count_nonzero(masks[:, i // 64] & np.uint64(1 << (i % 64)))
        return total, n

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score; `und` and 0 for a text without a letter. Ties go to the first in order of name."""
        if not text or not self.languages:
            return "und", 0.0
        hits, n = self.hits(text)
        if not n:
            return "und", 0.0
        own = np.maximum(0, (hits / n - self.false_rate) / (1 - self.false_rate)) / self.coverage
        best = int(np.argmax(own))
        return self.languages[best], float(min(1.0, own[best]))


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1].astype(float)


def train(docs: DataFrame, max_chars: int = 4_000_000, max_languages: int = 1000, profile: int = 6000, share: float = 0.1, positions: int = 1 << 18, hashes: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit the filter on labelled rows: all rows of docs with a text and a label are eligible.

    max_chars bounds the sample: rows of a language are taken by a hash of the id, so that about so many characters
    are read whatever the size of docs. max_languages bounds the labels that are learned: those with most text. profile is how many of a language's most frequent n-grams go into its slice, if
    they are at least `share` times as frequent there as in the language that has them most often.
    """
    text = F.col(text_col)
    labelled = docs.where(text.isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.pmod(F.xxhash64(id_col), F.lit(1 << 30)).alias("h"))
    chars = {r["lang"]: r["n"] or 1 for r in labelled.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    languages = sorted(chars)
    if not languages:
        return Model([], np.zeros(1, dtype=np.uint8), hashes, np.zeros(0), np.zeros(0))
    limits = F.create_map(*[F.lit(x) for lang in languages for x in (lang, int(min(1.0, max_chars / chars[lang]) * (1 << 30)))])
    sample = labelled.where(F.col("h") < limits[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                h, n = np.unique(np.concatenate([grams(b) for t in texts for b in _blocks(t)] or [np.empty(0, np.uint64)]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "h": h.astype(np.int64), "n": n})

    found = sample.mapInPandas(count, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    ranked = found.selectExpr("*", "row_number() over (partition by lang order by n desc, h) r", "sum(n) over (partition by lang) total")
    rows = ranked.where(F.col("r") <= profile).toPandas()
    rows["rate"] = rows["n"] / rows["total"]
    rows = rows[rows["rate"] >= share * rows.groupby("h")["rate"].transform("max")]
    words = -(-len(languages) // 64)
    table = np.zeros((positions, words), dtype=np.uint64)
    coverage = np.ones(len(languages))
    for i, lang in enumerate(languages):
        own = rows[rows["lang"] == lang]
        h = own["h"].to_numpy(dtype=np.int64).astype(np.uint64)
        step = (h >> np.uint64(32)) | np.uint64(1)
        for j in range(hashes):
            at = ((h + np.uint64(j) * step) % np.uint64(positions)).astype(np.int64)
            np.bitwise_or.at(table[:, i // 64], at, np.uint64(1 << (i % 64)))
        if len(own):
            coverage[i] = max(own["rate"].sum(), 1e-6)
    fill = np.array([np.count_nonzero(table[:, i // 64] & np.uint64(1 << (i % 64))) / positions for i in range(len(languages))])
    if len(languages) <= 8:
        table = table[:, 0].astype(np.uint8)
    return Model(languages, table, hashes, np.minimum(fill**hashes, 0.99), coverage)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, from the whole text alone. Columns of those names are replaced, others kept.

    A null text, one without a letter, and any text where no language was learned are `und` with score 0. Rows that
    repeat are judged alike; an empty table gives no rows.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model)  # positions x languages bits: its size is a parameter

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])
        common.trim()
        return found

    return docs.withColumn("_found", predict(F.col(text_col))).withColumns({"lang_pred": F.col("_found.lang_pred"), "score": F.col("_found.score")}).drop("_found")


def held_out(id_col: str = "doc_id", n: int = 5):
    """Rows that training must not see; a row without an id is never learned from, so it counts as held out."""
    return F.coalesce(common.crc_bucket(F.col(id_col), n) == 0, F.lit(True))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all whole documents, learned from those that are not held out; odd input as in identify()."""
    docs = common.load(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
