"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of the vocabulary has a whitespace marker after another
character, merges never cross from one marked word (a run of markers and the
characters up to the next marker) into the next. Each distinct marked word is
then segmented once, and its ids are joined back at every position it has. The
table is kept per task (bounded, refilled when full) rather than in one
cluster-wide relation: joining every position of every text to a global table
would shuffle about 20 bytes a word twice, several times the input.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

MARK = "▁"
CHUNK = re.compile(r" *[^ ]+| +")
#: Distinct chunks kept by a task, and the longest that is kept.
TABLE, LONGEST = 150_000, 64


def separable(processor) -> bool:
    """No piece holds a marker behind another character."""
    return not any(MARK in processor.id_to_piece(i).lstrip(MARK) for i in range(processor.vocab_size()))


class ChunkTable:
    """Distinct marked words with their ids, and the ids' decimal form."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = separable(self.processor)
        self.lone = [self.processor.piece_to_id(MARK)]
        self.table: dict[str, tuple[list[int], str]] = {}

    def _segment(self, chunks: list[str]) -> list[list[int]]:
        # the library puts one marker in front: chunks go in without their first
        ids = self.processor.encode([c[1:] for c in chunks], num_threads=1)
        return [self.lone if c == " " else i for c, i in zip(chunks, ids, strict=True)]

    def encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """Of each text, its ids and the ids in decimal joined by commas."""
        if not self.split:
            return [(i, ",".join(map(str, i))) for i in self.processor.encode(texts, num_threads=1)]
        rows = [CHUNK.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        fresh = list(set(chain.from_iterable(rows)).difference(self.table))
        if len(self.table) + len(fresh) > TABLE:
            self.table.clear()
            fresh = list(set(chain.from_iterable(rows)))
        table = self.table
        new = {c: (i, ",".join(map(str, i))) for c, i in zip(fresh, self._segment(fresh), strict=True)}
        table.update(new)
        out = []
        for row in rows:
            got = [table[c] for c in row]
            out.append((list(chain.from_iterable([g[0] for g in got])), ",".join([g[1] for g in got])))
        for c in new:
            if len(c) > LONGEST:
                del table[c]
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.processor.decode(ids) if ids else []


def _runs(texts: list[str], size: int = 1 << 20):
    """Row ranges of about size characters, whole texts always."""
    lo = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield lo, i
            lo, total = i, 0
        total += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _encoded(model: bytes, want_ids: bool, want_text: bool):
    def run(batches):
        table = ChunkTable(model)
        for b in batches:
            all_texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in _runs(all_texts):
                got = table.encode(all_texts[lo:hi])
                ids = [g[0] for g in got]
                back = table.decode(ids)
                cols = {
                    "doc_id": b.column(0)[lo:hi],
                    "n_tokens": pa.array([len(i) for i in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(g[1].encode()).hexdigest() for g in got]),
                    "decoded_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back]),
                }
                if want_ids:
                    cols["ids"] = pa.array(ids, pa.list_(pa.int32()))
                if want_text:
                    cols["decoded"] = pa.array(back, pa.string())
                yield pa.RecordBatch.from_pydict(cols)

    return run


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, model_path: str | None = None, ids: bool = True, decoded: bool = False) -> DataFrame:
    """Every text's SentencePiece ids, as the library's encode gives them
    (no begin or end id, no sampling), and the digests of ids and of decode(ids).

    docs: any columns; doc_id and text are read, whole. A null text counts as
    empty, an empty one has no ids. Returns doc_id, n_tokens, ids_sha256 (of
    the decimal ids joined by commas), decoded_sha256, and if asked for ids
    (array<int>) and decoded (string). Repeated rows come back repeated. A
    vocabulary whose pieces do cross markers is encoded text by text.
    """
    with open(model_path or default_model(), "rb") as f:
        model = f.read()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_encoded(model, ids, decoded)), schema)


def decoded(tokens: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, ids -> doc_id, text: the library's decode(ids); null ids are a null text."""
    with open(model_path or default_model(), "rb") as f:
        model = f.read()

    def run(batches):
        table = ChunkTable(model)
        for b in batches:
            ids = b.column(1).to_pylist()
            back = iter(table.decode([i for i in ids if i is not None]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if i is None else next(back) for i in ids], pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
