"""Language by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetscope.llm.shared import free_name, text_slices

#: Bytes of a language's dictionary, and texts they are taken from.
DICTIONARY_BYTES = 96 << 10
TRAINING_TEXTS = 192
#: Sub-keys over which a language's texts are dealt while its sample is drawn.
SAMPLE_SALTS = 64
#: Characters compressed at once: a longer text is compressed in blocks, so that each of them meets the
#: dictionary and not its own earlier part.
BLOCK_CHARS = 2_000
#: At level 6 two thirds fewer held-out texts are judged wrongly than at 3; levels from 15 on do worse.
LEVEL = 6
#: The best language must save this share of the bytes of the second best.
MARGIN = 0.001
UNDETERMINED = "und"


def train_dictionaries(
    labelled: DataFrame, text: str = "text", lang: str = "lang", size: int = DICTIONARY_BYTES, texts: int = TRAINING_TEXTS
) -> dict[str, bytes]:
    """A raw-content dictionary of at most ``size`` bytes for each language.

    Taken from the ``texts`` distinct texts of each language with the least hashes of their content,
    ``size // texts`` bytes from the middle of each that is longer. Only this bounded sample reaches the
    driver. Rows without text, letters or language are left out; texts are lower-cased.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    share = max(1, size // texts)
    start = F.greatest(F.lit(1), ((F.length("text") - share) / 2).cast("int"))
    pieces = rows.select("lang", F.xxhash64("text").alias("hash"), F.substring("text", start, F.lit(share)).alias("piece"))
    least = pieces.select("lang", "hash", F.pmod("hash", F.lit(SAMPLE_SALTS)).alias("salt")).distinct()
    # The least of a language are among the least of its sub-keys, so one task sees a bounded number of rows.
    for keys in (["lang", "salt"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("hash"))
        least = least.withColumn("rank", rank).filter(F.col("rank") <= texts)
    least = least.drop("salt")
    # At most ``texts`` narrow rows a language, so they can go to every task.
    chosen = pieces.join(F.broadcast(least), ["lang", "hash"]).select("lang", "rank", "piece").distinct().orderBy("lang", "rank", "piece").collect()
    found: dict[str, list[bytes]] = {}
    for row in chosen:
        found.setdefault(row.lang, []).append(row.piece.lower().encode("utf-8")[:share])
    return {name: b"\n".join(parts)[:size] for name, parts in sorted(found.items())}


def blocks(text: str, size: int = BLOCK_CHARS) -> list[bytes]:
    """The whole text in blocks of about equal length."""
    count = max(1, -(-len(text) // size))
    step = -(-len(text) // count)
    return [text[i : i + step].encode("utf-8", "surrogatepass") for i in range(0, len(text), step)]


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL) -> None:
        self.languages = list(dictionaries)
        self.compressors = []
        for content in dictionaries.values():
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level)
            self.compressors.append(
                zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=False, write_content_size=False, write_dict_id=False)
            )

    def judge(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the margin is wide enough."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, False
        parts = blocks(text.lower())
        sizes = [sum(len(c.compress(part)) for part in parts) for c in self.compressors]
        least = min(sizes)
        best = sizes.index(least)
        second = min([s for i, s in enumerate(sizes) if i != best], default=None)
        saved = 1.0 if second is None else (second - least) / second
        return self.languages[best], saved, saved >= margin


def identify_language(
    docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = MARGIN,
    lang: str = "lang_pred", score: str = "score", accepted: str = "accepted",
) -> DataFrame:
    """``docs`` with the language of each whole text, the share of bytes it saves over the second best
    (0 to 1), and whether that share reaches ``margin``.

    Null, empty and letterless texts, and every text where no language was learned, are ``und`` with
    score 0 and not accepted. Of equal sizes the first language by name wins with score 0. With one
    language the score is 1. Columns of ``docs`` keep their names; a new one that would clash gets
    underscores. The dictionaries (at most :data:`DICTIONARY_BYTES` a language) travel to the tasks.
    """
    names = []
    for wanted in (lang, score, accepted):
        names.append(free_name([*docs.columns, *names], wanted))
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for whole in batches:
            for batch in text_slices(whole, at):
                found = [classifier.judge(t, margin) for t in batch.column(at).to_pylist()]
                columns = zip(*found, strict=True) if found else ((), (), ())
                new = [pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    schema = StructType([*docs.schema.fields]).add(names[0], "string").add(names[1], "double").add(names[2], "boolean")
    return docs.mapInArrow(add, schema)
