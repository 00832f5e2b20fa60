"""Token counts without token ids: pieces are counted once per distinct pre-token.

A text is cut into pre-tokens by the vocabulary's own split pattern. The pieces of a pre-token do not depend on
its neighbours, so a text's count is the sum over its distinct pre-tokens of frequency times pieces. Each task
keeps the table pre-token -> pieces, adds the distinct pre-tokens of a batch that it lacks, and joins the table to
the frequencies of each document. No list of ids is built and no row leaves its task: moving all (document,
pre-token) rows through a shuffle would cost more than the corpus itself.

Rows: null text counts as empty (0 tokens, 0 bytes). Nulls and repeats in other columns do not matter: every row
gets the count of its own text. Existing columns with the names of the results are replaced.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from unicodedata import category

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType

from .common import read
from .registry import query

#: Fixed value: the split pattern of byte-level vocabularies with "use_regex".
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A task's table of pre-tokens is dropped and begun anew beyond this many entries.
TABLE_ENTRIES = 500_000


class PieceTable:
    """Pieces of each distinct pre-token, filled on demand."""

    def __init__(self, vocabulary: str, entries: int = TABLE_ENTRIES):
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary)
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("only plain byte-level vocabularies are counted by pre-token")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that take in white space are not supported")
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.entries = entries
        self.pieces: dict[str, int] = {}

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens of a text. Characters without a class in this Python's Unicode tables may have one in the
        library's, so a text with such characters is cut by the library."""
        if text.isascii() or not any(category(c) == "Cn" for c in set(text)):
            return self.split.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Frequency of each pre-token, and how many special tokens the text holds."""
        if self.cut is None or not any(s in text for s in self.special):
            return Counter(self.pretokens(text)), 0
        parts = self.cut.split(text)
        found: Counter = Counter()
        for part in parts:
            found.update(self.pretokens(part))
        return found, len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; the table is joined in steps of bounded size."""
        out = []
        step, held = [], 0
        for text in texts:
            step.append(self.frequencies(text))
            held += len(step[-1][0])
            if held > 200_000:
                out += self._join(step)
                step, held = [], 0
        return out + self._join(step)

    def _join(self, step: list[tuple[Counter, int]]) -> list[int]:
        if len(self.pieces) > self.entries:
            self.pieces = {}
        new = list({p for f, _ in step for p in f if p not in self.pieces})
        for i in range(0, len(new), 20_000):
            part = new[i:i + 20_000]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.pieces[p] = len(e)
        pieces = self.pieces
        return [special + sum(n * pieces[p] for p, n in f.items()) for f, special in step]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int, text: str = "text") -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit; ``vocabulary`` is the content of a tokenizer file (about 1 MB)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf(LongType())
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        table = PieceTable(shared.value)
        for batch in batches:
            yield pd.Series(table.count(batch.tolist()), dtype="int64")

    plain = F.coalesce(F.col(text), F.lit(""))
    return (docs.withColumn("n_bytes", F.octet_length(plain).cast("long"))
            .withColumn("n_tokens", tokens(plain)).withColumn("over_limit", F.col("n_tokens") > limit))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    return (count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, 1024)
            .select("doc_id", "n_bytes", "n_tokens", "over_limit"))
