"""Encode a corpus with a public byte-level BPE vocabulary by forced-boundary splitting.

A pair of bytes that occurs inside no token of the vocabulary can never be joined by a merge, so a text may be
cut between them, each fragment encoded on its own, and the ids concatenated. Fragments recur, so each
distinct one is encoded once a worker. The pre-tokenisation pattern looks only at white space and apostrophes
across a cut; cuts after white space and next to an apostrophe are therefore not used.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("TARNWELL_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"

#: Fixed value: the pre-tokenisation pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CACHED = 400_000  # fragments a worker remembers; it starts anew beyond that, which changes no result
LONGEST_CACHED = 64  # bytes


@lru_cache(maxsize=4)
def _coder(path: str):
    """(tiktoken encoding, 256 × 256 table of pairs that force a boundary)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    forced = np.ones((256, 256), dtype=bool)
    for token in ranks:
        b = np.frombuffer(token, dtype=np.uint8)
        forced[b[:-1], b[1:]] = False
    # only between characters: the second byte may not continue one
    forced[:, 0x80:0xC0] = False
    # never after white space (also of more than one byte, whose last bytes these are) nor beside an apostrophe
    ends_space = sorted({ch.encode()[-1] for ch in map(chr, range(0x3001)) if ch.isspace()})
    forced[ends_space, :] = False
    forced[0x27, :] = forced[:, 0x27] = False
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), forced


def fragments(raw: bytes, forced: np.ndarray) -> list[bytes]:
    """The text's bytes cut at every forced boundary."""
    b = np.frombuffer(raw, dtype=np.uint8)
    cuts = (np.flatnonzero(forced[b[:-1], b[1:]]) + 1).tolist()
    return [raw[i:j] for i, j in zip([0, *cuts], [*cuts, len(raw)], strict=True)]


_memory: dict[str, dict[bytes, list[int]]] = {}


def encode_text(text: str | None, path: str = VOCABULARY) -> list[int]:
    """The ids of a text without special tokens; null and empty texts give an empty list."""
    if not text:
        return []
    coder, forced = _coder(path)
    known = _memory.setdefault(path, {})
    out: list[int] = []
    for piece in fragments(text.encode("utf-8", "replace"), forced):
        ids = known.get(piece)
        if ids is None:
            ids = coder.encode_ordinary(piece.decode("utf-8"))
            if len(piece) <= LONGEST_CACHED:
                if len(known) >= CACHED:
                    known.clear()
                known[piece] = ids
        out += ids
    return out


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``id_col`` and ids of every row, in one pass without a shuffle. Repeated rows come out as often as they come in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "ids": [encode_text(t, path) for t in pdf["text"]]})

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, ids array<int>")
    return rows.withColumnRenamed("id", id_col)
