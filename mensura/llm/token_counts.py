"""Token counts by pre-token: each distinct pre-token's pieces are counted once and summed by frequency.

In a piece vocabulary no piece has a space mark after another character, so no merge crosses from
a word into the spaces before the next one, and a text's count is the sum over its pre-tokens: the
runs of spaces with the word after them.  Each task counts the pre-tokens of a part of its
documents, asks the tokenizer about those it has not met, and joins counts to frequencies where
the documents are, so neither ids nor (document, pre-token) pairs are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.llm.common import free_name, held, lean, slices

#: Pre-tokens a worker remembers at most, and the length beyond which it remembers none.
CACHE_WORDS, CACHE_CHARS = 1_000_000, 40

#: Fixed value: the mark that stands for a space in pieces.
SPACE = "▁"

_RUNS = re.compile(r" *[^ ]+| +").findall


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without the one space that the tokenizer puts before what it is given."""
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [w[1:] for w in _RUNS(" " + text)]
    return text.split(" ")


class PieceCounter:
    """Counts of a sentencepiece model, by pre-token."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces) or self.model.encode("a", out_type=str)[0][0] != SPACE:
            raise ValueError("pieces of this model cross spaces; its texts can't be counted by pre-token")
        self.known = {"": 1}

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > CACHE_WORDS:  # of bounded size: begun anew when full
            self.known = {"": 1}
        known = self.known
        bags = [Counter(pre_tokens(t)) for t in texts]
        new = list(set().union(*bags).difference(known))
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            known.update(zip(some, map(len, self.model.encode(some, num_threads=1))))
        out = [sum([known[w] * n for w, n in bag.items()]) for bag in bags]
        for w in new:
            if len(w) > CACHE_CHARS:
                del known[w]
        return out


def count_tokens(docs: DataFrame, model: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """docs, without the text, with n_bytes, n_tokens and over_limit (n_tokens > limit).

    model: path of a sentencepiece BPE model, which every executor must have; no begin, end or
    other special tokens are counted, and their strings in a text are plain text.  A null text
    counts as empty: 0 bytes, 0 tokens.  Rows are answered one by one, repeated ones too; result
    columns replace columns of the same names.
    """
    names = ["n_bytes", "n_tokens", "over_limit"]
    keep = [c for c in docs.columns if c != text and c.lower() not in names]
    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(free_name(docs, "own_text")))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        counter = held(("pieces", model), lambda: PieceCounter(model))
        for batch in batches:
            for texts, part in slices(batch):
                size = pc.fill_null(pc.binary_length(part.column(part.num_columns - 1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], size, pa.array(counter.count(texts), pa.int64())], schema.names)

    return given.mapInArrow(lean(run), schema).withColumn("over_limit", F.col("n_tokens") > limit)
