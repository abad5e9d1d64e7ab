"""Language identification as inference of a mixture (operator 8).

Each language has a distribution over hashed byte trigrams, counted from all
training rows.  For a document, expectation maximisation estimates which share of
its trigrams each language wrote; sets of languages are compared by likelihood
less a penalty for each language, and the largest share of the best set names the
document.  All languages together bound the likelihood of every set, so sets that
are too large to win by that bound are not tried, and all others are.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

GRAM_BITS = 16
ROUNDS = 15
PENALTY = 3.0
#: Languages that a model may have; more are an error. The driver holds 512 kB for each.
MOST_LANGUAGES = 512
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def grams(text: str) -> np.ndarray:
    """Hashed trigrams of the letters, ASCII other than letters read as space."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(_FOLD), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    code = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    code = code[code & 0xFFFF != 0x2020]  # at most one space at the end
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)).astype(np.int64)


def train(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities from (text, lang) rows.

    Counts cover all rows.  The driver gets one row per language and hashed
    trigram, at most 65,536 for each of at most MOST_LANGUAGES, whatever the input's
    size.  Rows without text or language teach nothing; no rows give no languages;
    repeated rows teach as often as they occur; other columns are ignored.
    """
    c.ship(rows.sparkSession)

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for b in c.slices(batches):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if lang not in held:
                    held[lang] = np.zeros(1 << GRAM_BITS, np.int64)
                held[lang] += np.bincount(grams(text), minlength=1 << GRAM_BITS) if len(text) > 4000 else 0
                if len(text) <= 4000:
                    np.add.at(held[lang], grams(text), 1)
        for lang, n in held.items():
            g = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g, pa.int32()), pa.array(n[g], pa.int64())], ["lang", "gram", "n"])

    seen = rows.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counted = c.settle(seen.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    if counted.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = counted.toPandas()
    c.drop(counted)
    langs = sorted(counts["lang"].unique())
    table = np.zeros((len(langs), 1 << GRAM_BITS))
    for i, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        table[i, own["gram"].to_numpy()] = own["n"].to_numpy()
    table += 0.1
    return langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def mixture(p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Shares of the languages and the log likelihood. p: likelihoods by language and gram; n: counts of the grams."""
    share = np.full(len(p), 1 / len(p))
    total = n.sum()
    for _ in range(rounds):
        mixed = share @ p
        new = share * (p @ (n / mixed)) / total
        if np.abs(new - share).max() < 1e-4:
            share = new
            break
        share = new
    return share, float(n @ np.log(share @ p))


def best_set(p: np.ndarray, n: np.ndarray, cost: float, base: float = 0.0) -> tuple[tuple[int, ...], np.ndarray, float]:
    """(languages, shares, penalised likelihood) of the set with the highest likelihood less cost for each language but the first.

    p: likelihoods by language and gram, over a common factor whose logarithm sums to
    base; n: counts of the grams.  Ties go to smaller sets and earlier languages.
    """
    single = np.log(p) @ n
    k = int(single.argmax())
    best = (k,), np.ones(1), float(single[k]) + base
    most = mixture(p, n)[1] + base if len(p) > 1 else best[2]
    for size in range(2, len(p) + 1):
        if most - cost * (size - 1) <= best[2]:
            break
        for own in combinations(range(len(p)), size):
            share, ll = mixture(p[list(own)], n)
            if ll + base - cost * (size - 1) > best[2]:
                best = own, share, ll + base - cost * (size - 1)
    return best


def identify(text: str | None, langs: list[str], logp: np.ndarray, penalty: float = PENALTY) -> tuple[str, float, list[str], float]:
    """(language, score, languages of the chosen set, share of trigrams that they know); und and 0 for texts without a letter."""
    if not text or not langs or not _LETTER.search(text):
        return "und", 0.0, [], 0.0
    g = grams(text)
    if not len(g):
        return "und", 0.0, [], 0.0
    g, n = np.unique(g, return_counts=True)
    lp = logp[:, g].astype(np.float64)
    top = lp.max(0)
    chosen, share, _ = best_set(np.exp(lp - top), n, penalty * np.log(n.sum() + 1), float(n @ top))
    k = int(np.argmax(share))
    single = lp @ n
    sure = 1 / np.exp(np.minimum(single - single[chosen[k]], 50)).sum() if len(chosen) == 1 else 1.0
    own = list(chosen)
    known = float(n @ (lp[own] > logp[own].min(1, keepdims=True) + 0.5).any(0) / n.sum())  # the least is a gram never seen
    return langs[chosen[k]], float(min(1.0, share[k] * sure)), [langs[i] for i in chosen], known


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def label(docs: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """docs with lang_pred, score, lang_set and lang_known, which displace columns of these names.

    Null texts and texts without a letter are und; other columns stay.  Rows may
    repeat, each is told by its own text; an empty table gives an empty result.  The
    table of likelihoods is broadcast (256 kB a language).  A text is worked on
    whole, in memory of some thirty times its size.
    """
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score", "lang_set", "lang_known")
    c.ship(spark)
    model = spark.sparkContext.broadcast((langs, logp))
    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_set", T.ArrayType(T.StringType())), T.StructField("lang_known", T.DoubleType())]
    schema = T.StructType([*docs.schema.fields, *more])

    def run(batches):
        names, table = model.value
        for b in c.slices(batches):
            found = [identify(t, names, table) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.list_(pa.string())), pa.array([f[3] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "lang_pred", "score", "lang_set", "lang_known"])

    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, lang_set) of every document, learnt from the rows that are not held out.

    A null id is held out of nothing; repeated rows give repeated rows; an empty
    table gives an empty result, and one without a learnt language only und.
    """
    flagged = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    langs, logp = train(flagged.where(~F.coalesce("held_out", F.lit(False))))
    return label(flagged.select("doc_id", "text", "held_out"), langs, logp).select("doc_id", "held_out", "lang_pred", "score", "lang_set")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(c.table(spark, sf_dir, "documents"))
