"""Token counts by heap-and-linked-list byte-pair merging, without emitting identifiers.

Every word starts as one symbol a byte; the lowest-rank adjacent pair is merged again and again;
the count is the number of initial symbols minus the number of merges.  Counts of words and of
pieces between white space are remembered in bounded tables, because most of a text repeats.

The pass is a narrow map over the text column: no shuffle, one Arrow batch in memory at a time.

Nulls and empty texts: a null text counts as empty and gives 0 tokens; a null id is passed on.
Very long texts: time grows as n log n in the longest unbroken word.  Ties and repeated rows:
each row is counted by itself.  Empty tables: an empty result.  Extra columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import WordCache, WordPieces, heap_merge, load_table, split_special
from .tables import arrow_map, batch, texts_of


class TokenCounter:
    """Counts the tokens of texts for a word-level vocabulary file.

    ``merge``: another function of (symbols, merges) that returns the ids left over.
    """

    def __init__(self, path: str, merge=None):
        table = load_table(path)
        pre = WordPieces(table)
        merges, symbols = table.merges, table.symbols

        def count(piece: str) -> int:
            words = pre.words(piece)
            if len(words) == 1 and words[0] == piece:
                raw = symbols(piece.encode())
                return len(merge(raw, merges)) if merge else heap_merge(raw, merges, count_only=True)
            return sum(map(known, words))

        cache = WordCache(count, 600_000)
        known = self._piece = cache.__getitem__
        self._pieces, self._special = pre.pieces, table.special

    def count(self, text: str) -> int:
        total, look = 0, self._piece
        for part, special in split_special(text, self._special):
            total += sum(map(look, self._pieces(part))) + (special is not None)
        return total


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""

    def make():
        counter = TokenCounter(path)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(b)
            n = [counter.count(t) for t in texts]
            return batch({"id": (b.column(0), None), "n_bytes": ([len(t.encode()) for t in texts], pa.int64()), "n_tokens": (n, pa.int64()), "over_limit": ([x > limit for x in n], pa.bool_())})

        return run

    slim = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    kind = slim.schema["id"].dataType.simpleString()
    return arrow_map(slim, make, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
