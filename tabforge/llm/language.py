"""Language ID by language-bitmask n-gram filters.

One Bloom filter per language, bit-sliced: a slot holds one bit for each language, so the
AND of a gram's slots is the set of all languages that (may) contain it. A text's grams are
counted per language and corrected for each filter's false positives; the highest share wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.llm.batches import bounded
from tabforge.session import materialize

#: Labelled documents of each language that the filters are fitted on, about (chosen by hash).
SAMPLE_PER_LANG = 20_000
#: A gram belongs to a language with at least this share of the language's grams (so there are at
#: most 1 / LEAST_SHARE of them) and this part of its largest share in any language.
LEAST_SHARE, LEAST_RELATIVE = 1e-5, 0.2
SLOTS, HASHES = 1 << 20, 3
#: Code points of a text that are in numpy arrays at once.
SEGMENT = 1 << 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def grams(text: str) -> Iterator[np.ndarray]:
    """64-bit hashes of the 3- and 4-grams of lower-case letters, a word's ends being blanks; by segment.

    A gram's inner characters are letters. Texts without a letter have none.
    """
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype="<u4")
    for at in range(0, len(points) - 2, SEGMENT):
        c = points[at : at + SEGMENT + 3]
        letter = _letters()[c]
        c = np.where(letter, c, 32).astype(np.uint64)
        if at + SEGMENT < len(points) - 2:
            ends3, ends4 = SEGMENT, SEGMENT
        else:
            ends3, ends4 = len(c) - 2, max(0, len(c) - 3)
        three = (c[:ends3] << np.uint64(42)) | (c[1 : 1 + ends3] << np.uint64(21)) | c[2 : 2 + ends3]
        four = three[:ends4] * np.uint64(0xD6E8FEB86659FD93) + c[3 : 3 + ends4] + np.uint64(1 << 63)
        inner = letter[1 : 1 + ends3]
        yield _mix(np.concatenate((three[inner], four[inner[:ends4] & letter[2 : 2 + ends4]])))


@dataclass(frozen=True)
class LanguageFilters:
    langs: tuple[str, ...]
    #: (words of 64 languages, SLOTS)
    table: np.ndarray
    false_positives: np.ndarray
    most_common: int

    @classmethod
    def build(cls, grams_of: dict[str, np.ndarray], counts: dict[str, int]) -> LanguageFilters:
        langs = tuple(sorted(grams_of))
        kind = np.uint8 if len(langs) <= 8 else np.uint64
        table = np.zeros((-(-len(langs) // 64) or 1, SLOTS), dtype=kind)
        fill = np.zeros(len(langs))
        for n, lang in enumerate(langs):
            for at in _slots(grams_of[lang]):
                table[n // 64, at] |= kind(1 << (n % 64))
            fill[n] = np.count_nonzero(table[n // 64] >> kind(n % 64) & kind(1)) / SLOTS
        return cls(langs, table, fill**HASHES, max(range(len(langs)), key=lambda n: (counts[langs[n]], -n), default=0))

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Per language, how many of the grams its filter contains."""
        out = np.zeros(len(self.langs), dtype=np.int64)
        slots = list(_slots(hashes))
        for w, row in enumerate(self.table):
            both = row[slots[0]]
            for at in slots[1:]:
                both = both & row[at]
            for n in range(64 * w, min(len(self.langs), 64 * w + 64)):
                out[n] = np.count_nonzero(both & self.table.dtype.type(1 << (n % 64)))
        return out

    def decide(self, text: str | None) -> tuple[str, float]:
        """(language, share of the grams that are its own). UNKNOWN for NULL, no letter or nothing learned."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        hits, n = np.zeros(len(self.langs)), 0
        for hashes in grams(text):
            hits += self.hits(hashes)
            n += len(hashes)
        true = np.clip((hits - n * self.false_positives) / (1 - self.false_positives), 0, n)
        best = int(np.argmax(true)) if true.max() > 0 else self.most_common
        return self.langs[best], float(true[best] / n) if n else 0.0


def _slots(hashes: np.ndarray) -> Iterator[np.ndarray]:
    bits = SLOTS.bit_length() - 1
    for k in range(HASHES):
        yield (hashes >> np.uint64(k * bits) & np.uint64(SLOTS - 1)).astype(np.int64)


def held_out(id_: Column) -> Column:
    """crc32 of the id as text is divisible by 5; a NULL id counts as the empty text and is held out."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageFilters:
    """Fit the filters on labelled documents that are not held out: about SAMPLE_PER_LANG of each language.

    Gram counts are summed by Spark; at most 1 / LEAST_SHARE grams of a language reach the driver.
    """
    rows = bounded(docs).where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageFilters.build({}, {})
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, SAMPLE_PER_LANG / n))))
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found.setdefault(lang, []).extend(grams(text.as_py() or ""))
            for lang, parts in found.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, int))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

    one = chosen.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    one = one.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    one = materialize(one)
    total = {r["lang"]: r["n"] for r in one.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    totals = F.create_map(*(F.lit(x) for k, n in total.items() for x in (k, float(n)))) if total else None
    grams_of = {lang: np.zeros(0, np.uint64) for lang in counts}
    if total:
        shares = one.withColumn("share", F.col("n") / F.element_at(totals, F.col("lang"))).where(F.col("share") >= LEAST_SHARE)
        most = shares.groupBy("gram").agg(F.max("share").alias("most"))
        own = shares.join(most, "gram").where(F.col("share") >= LEAST_RELATIVE * F.col("most"))
        table = own.select("lang", "gram").toArrow()
        langs = np.array(table.column("lang").to_pylist(), dtype=object)
        values = table.column("gram").to_numpy().view(np.uint64)
        grams_of |= {lang: values[langs == lang] for lang in total}
    return LanguageFilters.build(grams_of, counts)


def predict(docs: DataFrame, filters: LanguageFilters, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``__id``, ``__lang_pred`` and ``__score`` for every row, with the columns ``keep`` before them."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            langs, scores = zip(*(model.decide(t.as_py()) for t in batch.column(batch.num_columns - 1)), strict=True) if batch.num_rows else ((), ())
            columns = [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "__lang_pred", "__score"])

    rows = docs.select(*keep, F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    schema = rows.drop("__text").schema.add("__lang_pred", "string").add("__score", "double")
    return rows.mapInArrow(decide, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score.

    Learns from labelled documents whose id isn't held out; a prediction sees the text only. NULL
    texts and texts without a letter are UNKNOWN with score 0, and so is every text when there is
    nothing to learn from. A text whose letters form no known gram gets the most common language
    with score 0; ties go to the first language in alphabetical order. Repeated rows stay repeated.
    """
    out = predict(docs, learn(docs, id_col, text_col, lang_col), id_col, text_col)
    return out.select(F.col("__id").alias(id_col), held_out(F.col("__id")).alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"))
