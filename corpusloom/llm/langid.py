"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language's dictionary is raw content: the words of a bounded sample of the labelled rows outside the held-out
fold (at most SAMPLE_ROWS rows, SAMPLE_CHARS of each, those of the lowest hashes), lower-cased, each once, those of most texts last, DICT_BYTES in
all; words that belong to another language (OWN_SHARE), such as quotations have, are left out. Words rather than passages, as a passage quoted in the sample would outweigh the language. A text is lower-cased
and cut into blocks of BLOCK bytes, so that a repetitive text can't become its own dictionary; the sizes of all its
blocks add up. Short texts, where whole bytes are coarse, are compressed at a higher level. A margin below NARROW between the best two rejects
the prediction (confident is false); the best language is reported all the same.

The prediction is "und" with score 0 if a text is null or has no letter, or if nothing could be learned. Ties go to
the language first in the alphabet; repeated rows are predicted each for itself; extra columns are ignored; an empty
table gives an empty result; rows with a letter count for the sample only; a text of any length is compressed whole, block by block.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, held_out, table

SAMPLE_ROWS, SAMPLE_CHARS, DICT_BYTES, SPARE = 300, 2000, 16_000, 8
#: A word goes to the languages that have it in at least this share of the texts that the language with most has.
OWN_SHARE = 0.5
BLOCK, SHORT, LEVEL, FINE_LEVEL = 512, 200, 9, 19
NARROW = 0.02
#: Languages up to which their counts are broadcast. Each has a dictionary in every worker, so more would be rare.
FEW = 10_000


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary of each language, from a sample whose size is bounded as the module says."""
    # Rows without a letter teach nothing, so they don't count towards the share that is looked at either.
    own = docs.where(docs[lang_col].isNotNull() & ~held_out(id_col) & docs[text_col].cast("string").rlike(r"\p{L}")).withColumn("__l", F.col(lang_col).cast("string"))
    # The rows of the lowest hashes, SPARE times as many as are used, are told by a share of all hashes; so few rows are ranked, however common the language.
    counts = cut(own.groupBy("__l").agg(F.count("*").alias("__n")), "languages")
    # Texts stay where they are until the share is taken: a join that moves them would deal them by language.
    counts = F.broadcast(counts) if counts.limit(FEW + 1).count() <= FEW else counts
    rows = own.select("__l", F.col(text_col).cast("string").alias("t"), F.xxhash64(id_col, text_col).alias("h")).join(counts, "__l").where((F.col("h") / 2.0**64 + 0.5) * F.col("__n") <= SPARE * SAMPLE_ROWS)
    rows = rows.select(F.col("__l").alias("lang"), F.substring("t", 1, SAMPLE_CHARS).alias("t"), "h").distinct()
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))).where(F.col("r") <= SAMPLE_ROWS)
    texts: dict[str, set[str]] = {}
    for r in first.select("lang", "t").collect():
        texts.setdefault(r["lang"], set()).add(r["t"].lower())
    rate = {lang: Counter() for lang in texts}
    for lang, own in texts.items():
        for w, n in Counter(w for t in own for w in set(t.split())).items():
            rate[lang][w] = n / len(own)
    out = {}
    for lang, own in rate.items():
        # What matches nearest the end costs least, so the words of most texts stand there.
        fit = [w for w, r in own.items() if r >= OWN_SHARE * max(x[w] for x in rate.values())]
        out[lang] = b" ".join(w.encode() for w in sorted(fit, key=lambda w: (own[w], w)))[-DICT_BYTES:]
    return out


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, confident of each row."""
    langs = sorted(dictionaries)

    def run(batches):
        import zstandard as z

        def compressors(level):
            out = []
            for name in langs:
                d = z.ZstdCompressionDict(dictionaries[name], dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                out.append(z.ZstdCompressor(level=level, dict_data=d, write_content_size=False))
            return out

        coarse, fine = compressors(LEVEL), compressors(FINE_LEVEL)
        for b in batches:
            pred, score, sure = [], [], []
            for t in b.column(1).to_pylist():
                if not t or not langs or not any(map(str.isalpha, t)):
                    pred.append("und")
                    score.append(0.0)
                    sure.append(False)
                    continue
                raw = b" " + t.lower().encode() + b" "
                if len(raw) <= SHORT:
                    sizes = np.array([len(c.compress(raw)) for c in fine])
                else:
                    parts = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
                    sizes = np.array([sum(len(c.compress(p)) for p in parts) for c in coarse])
                best = int(sizes.argmin())
                rest = np.delete(sizes, best)
                margin = (rest.min() - sizes[best]) / rest.min() if len(rest) else 1.0
                pred.append(langs[best])
                score.append(margin / (margin + NARROW))
                sure.append(bool(margin >= NARROW))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.bool_())], ["doc_id", "lang_pred", "score", "confident"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, confident boolean")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, learn(docs))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "confident")
