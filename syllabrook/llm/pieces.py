"""Problem 1: oversized texts cut into pieces at natural boundaries, with overlap.

Method: token offsets of a text form a prefix array; the positions after which a topic, a sentence or
a line ends form a sorted boundary array. From a piece's start the last boundary within the limit is
found by binary search, the next piece steps back by the overlap, and where no boundary lies ahead the
cut is hard, at the limit. Texts within the limit never leave the JVM; only oversized ones are handed
to Python.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A token: a longest run of characters other than blank, tab, line feed and no-break space.
TOKEN = r"[^ \t\n\u00a0]+"
_TOKEN = re.compile(TOKEN)
# Shortened words after which a full stop ends no sentence.
SHORT = frozenset("art cap cf dr dra ed ex fig fl fls h inc n núm p pág par prof profa profs s sr sra srta séc ss t tab tit univ v vol vols aprox av coord depto dept obs op".split())
_ENDS = ".!?…。！？।؟"
_CLOSERS = "\"'”’»)]}"
_DASHES = frozenset("-–—•▪·*")


def boundaries(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Numbers of tokens after which a topic, a sentence or a line ends, ascending."""
    out = []
    for i in range(len(spans) - 1):
        (a, b), (c, d) = spans[i], spans[i + 1]
        token, following = text[a:b], text[c:d]
        if "\n" in text[b:c] or token[-1] == ";" or (following in _DASHES and token not in _DASHES):
            out.append(i + 1)
            continue
        bare = token.rstrip(_CLOSERS)
        if bare and bare[-1] in _ENDS:
            stem = bare[:-1].lower().lstrip("([{\"'“‘«")
            if bare[-1] == "." and (stem in SHORT or (len(stem) == 1 and stem.isalpha()) or following[0].islower()):
                continue
            out.append(i + 1)
    return out


def cut(spans: list[tuple[int, int]], bounds: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Token ranges of the pieces. Each after the first starts ``overlap`` tokens before the end of the one before."""
    out, start, total = [], 0, len(spans)
    while True:
        if total - start <= limit:
            out.append((start, total))
            return out
        at = bisect_right(bounds, start + limit) - 1
        least = start + (overlap if out else 0)
        # a boundary serves if the piece then holds more than it repeats and the next start moves on
        end = bounds[at] if at >= 0 and bounds[at] > max(least, start + overlap) else start + limit
        out.append((start, end))
        start = end - overlap


def _words(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def pieces(texts: DataFrame, id_col: str, text_col: str, limit: int = 128, overlap: int = 16, spans: Callable[[str], list[tuple[int, int]]] | None = None) -> DataFrame:
    """Cut texts of more than ``limit`` tokens: (id, peca, inicio, fim, tokens, texto).

    ``peca`` counts from 0, ``inicio`` and ``fim`` are code points of the text, so texts can be rebuilt;
    a piece runs from its first token to its last. A text within the limit, blank ones included, comes
    out whole as its only piece; null texts give no row. Equal rows each give their pieces. One token
    longer than any limit stays one token. ``spans`` replaces the token rule (offsets of a text's tokens).
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    data = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    kind = dict(data.dtypes)["id"]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                own = (spans or _words)(text)
                if len(own) <= limit:
                    rows.append((key, 0, 0, len(text), len(own), text))
                    continue
                for n, (a, b) in enumerate(cut(own, boundaries(text, own), limit, overlap)):
                    lo, hi = own[a][0], own[b - 1][1]
                    rows.append((key, n, lo, hi, b - a, text[lo:hi]))
            yield pd.DataFrame(rows, columns=["id", "peca", "inicio", "fim", "tokens", "texto"])

    schema = f"id {kind}, peca int, inicio int, fim int, tokens int, texto string"
    if spans is not None:
        return data.mapInPandas(split, schema)
    counted = data.withColumn("n", F.regexp_count("text", F.lit(TOKEN)))
    small = counted.filter(F.col("n") <= limit).select("id", F.lit(0).alias("peca"), F.lit(0).alias("inicio"), F.char_length("text").alias("fim"), F.col("n").cast("int").alias("tokens"), F.col("text").alias("texto"))
    return small.unionByName(counted.filter(F.col("n") > limit).select("id", "text").mapInPandas(split, schema))
