"""SentencePiece encoding and decoding through a table of distinct chunks.

The model's pieces never hold a white-space marker behind another character, so no merge can
cross the place where a marker follows a word. A text falls into chunks there (a run of
markers and the word behind it); each distinct chunk is segmented once by the library and its
ids are joined back by position. Models whose pieces do cross markers, or that rewrite or
strip text first, are refused rather than encoded wrongly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.chunks import ChunkTable
from quire.llm.quality_rules import _ddl
from quire.llm.text import row, slices

MARK = "▁"
#: A run of blanks and the characters up to the next blank; a literal marker counts as a blank.
_CHUNKS = re.compile(r" *[^ ]+| +")
_PROBES = ("  a  b ", "é́ ﬁ\n\tＡ　b", " a", "", "a▁b")


def load(model: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model)


def check_model(model: str) -> None:
    """Raise unless chunks can be encoded alone: one marker in front, no rewriting, no piece across a marker."""
    sp = load(model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        raise ValueError("a piece of this model crosses a white-space marker")
    for text in _PROBES:
        whole = sp.encode(text)
        if sp.decode(whole) != text.replace(MARK, " ") or _encode_chunks(sp, chunks(text)) != [whole]:
            raise ValueError("this model changes its input, so chunks cannot be encoded alone")


def chunks(text: str) -> list[str]:
    """Chunks of a text, the marker in front of it included: each begins with a blank."""
    return _CHUNKS.findall(" " + text.replace(MARK, " ")) if text else []


def segment(sp: sentencepiece.SentencePieceProcessor, parts: list[str]) -> list[list[int]]:
    """Ids of each chunk. The library puts a chunk's first marker in front by itself, except to an empty text."""
    coded = sp.encode([p[1:] for p in parts], num_threads=1)
    return [ids if p != " " else [sp.piece_to_id(MARK)] for p, ids in zip(parts, coded)]


def _encode_chunks(sp: sentencepiece.SentencePieceProcessor, parts: list[str]) -> list[list[int]]:
    return [[i for ids in segment(sp, parts) for i in ids]]


def encode(docs: DataFrame, carry: list[str], model: str, text: str = "text") -> DataFrame:
    """(row, ids array<int>, decoded string): the library's ids of every whole text, and its decoding of them.

    Null and empty texts have no ids and decode to the empty text. ``model`` is a path that every
    executor can open.
    """
    check_model(model)
    chosen = docs.select(row(docs, carry).alias("row"), docs[f"`{text}`"].cast("string").alias("text"))
    out = chosen.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = load(model)
        table = ChunkTable(lambda new: segment(sp, new))
        for part in slices(batches, "text"):
            texts = [chunks(t or "") for t in part.column("text").to_pylist()]
            ids, sizes = table.lookup([c for t in texts for c in t])
            ends, done, k = [0], 0, 0
            for t in texts:
                done += int(sizes[k : k + len(t)].sum())
                k += len(t)
                ends.append(done)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            decoded = sp.decode([ids[a:b].tolist() for a, b in zip(ends, ends[1:])], num_threads=1)
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), lists, pa.array(decoded, pa.string())], ["row", "ids", "decoded"]
            )

    return chosen.mapInArrow(run, f"{_ddl(out)}, ids array<int>, decoded string")


def digests(coded: DataFrame, more: list[str] = ()) -> DataFrame:
    """(row, n_tokens, ids_sha256, decoded_sha256) of encoded documents, and the columns in ``more``."""
    return coded.select(
        "row", *more, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
