"""Language by compression: the language whose dictionary makes a text smallest.

Each language gets a zstandard raw-content dictionary out of sampled training
text. A text is lower-cased, what is no letter becomes one space, and it is cut
into short pieces, so that its own past says little and the dictionary much.
Every piece is compressed with every dictionary. The language with the smallest
sum wins; a narrow margin rejects the document. A short piece is padded with
spaces, as zstandard stores what it can hardly shrink, and then all languages
would be equal.

One pass, no shuffle of text. What every task gets is the dictionaries, at most
``max_languages * dictionary_bytes``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from .common import fields, pack, packed, unpack

UNKNOWN = "und"
PAD_BELOW, PAD = 512, b" " * 128
_NO_LETTERS = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    return _NO_LETTERS.sub(" ", text.lower()).strip()


def train(
    labelled: DataFrame, *, dictionary_bytes: int = 96 << 10, sample_docs: int = 384, max_languages: int = 256,
) -> dict[str, bytes]:
    """Dictionary per language from (doc_id, text, lang), the most frequent language first.

    The classifier is fitted on a bounded sample: of each language (more than
    ``max_languages`` are an error), the ``sample_docs`` documents with the smallest hash
    of doc_id give a piece of equal length each, at most ``dictionary_bytes``.
    """
    usable = labelled.filter("lang is not null and octet_length(text) > 0")
    narrow = usable.select("lang", F.xxhash64("doc_id").alias("_h"))
    # One row per language.
    langs = [r["lang"] for r in narrow.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages + 1).collect()]
    if len(langs) > max_languages:
        raise ValueError(f"more than {max_languages} languages: raise max_languages, or none of the others would ever be predicted")
    best = Window.partitionBy("lang").orderBy("_h")
    picked = (
        narrow.filter(F.col("lang").isin(langs)).withColumn("_r", F.row_number().over(best))
        .filter(F.col("_r") <= sample_docs).select("lang", "_h").distinct()
    )
    size = dictionary_bytes // sample_docs
    # At most max_languages * sample_docs keys.
    pieces = (
        usable.withColumn("_h", F.xxhash64("doc_id")).join(F.broadcast(picked), ["lang", "_h"])
        .select("lang", "_h", F.expr(f"substring(text, 1 + cast(pmod(_h, greatest(1, char_length(text) - {size})) as int), {size})").alias("t"))
        .groupBy("lang", "_h").agg(F.min("t").alias("t")).orderBy("lang", "_h").collect()
    )
    whole: dict[str, list[bytes]] = {}
    for row in pieces:
        whole.setdefault(row["lang"], []).append(fold(row["t"]).encode())
    learned = {lang: b" ".join(whole.get(lang, []))[:dictionary_bytes] for lang in langs}
    return {lang: d for lang, d in learned.items() if len(d) >= 8}  # the least zstandard takes


def pieces_of(text: str, size: int) -> list[bytes]:
    raw = fold(text).encode()
    cut = [raw[i:i + size] for i in range(0, len(raw), size)]
    return [p + PAD if len(p) < PAD_BELOW else p for p in cut]


def packer(dictionary: bytes, level: int, piece_bytes: int):
    shape = zstandard.ZstdCompressionParameters.from_level(
        level, dict_size=len(dictionary), source_size=piece_bytes, min_match=3,
        write_checksum=False, write_content_size=False, write_dict_id=False)
    own = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(compression_params=shape)
    return zstandard.ZstdCompressor(compression_params=shape, dict_data=own).compress


def classify(
    docs: DataFrame, dictionaries: dict[str, bytes], *, narrow: float = 0.01, piece_bytes: int = 4096, level: int = 7,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per document: doc_id, lang_pred, score, rejected and the columns in ``carry``.

    ``score`` is how far the best language is ahead: (second - best) / best of
    the compressed sizes, from 0 to 1. ``rejected`` where that is below
    ``narrow`` and where the language is ``und``: null text, no letter in it, or
    nothing learned. With a single language there is no margin and no rejection.
    Ties go to the language that comes first in ``dictionaries``. Very long texts
    are packed whole, 4 KB at a time. Columns in
    ``carry`` with a name of this operator's own are left out; no other column is
    read. Empty input gives no
    rows.
    """
    names = [c for c in dict.fromkeys(carry) if c not in ("doc_id", "lang_pred", "score", "rejected")]
    columns = ["doc_id", *packed(names)]
    langs = list(dictionaries)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = [packer(shared.value[lang], level, piece_bytes) for lang in langs]
        for batch in batches:
            pred, score, out = [], [], []
            for text in batch.column("text").to_pylist():
                if not packers or text is None or not any(map(str.isalpha, text)):
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    out.append(True)
                    continue
                pieces = pieces_of(text, piece_bytes)
                sizes = np.array([sum(len(pack(p)) for p in pieces) for pack in packers])
                best = int(sizes.argmin())
                rest = np.delete(sizes, best)
                ahead = min(1.0, float(rest.min() - sizes[best]) / float(sizes[best])) if len(rest) else 1.0
                pred.append(langs[best])
                score.append(ahead)
                out.append(ahead < narrow)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())],
                [*columns, "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", "text", *pack(names))
    shape = fields(rows, columns, "lang_pred string, score double, rejected boolean")
    return rows.mapInArrow(guess, shape).select("doc_id", "lang_pred", "score", "rejected", *unpack(names))


def held_out():
    """Documents never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 3 == 1
