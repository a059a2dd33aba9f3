"""Problem 5: repair of text from scanned pages.

Method: sequence labelling of lines with a hidden Markov model. States are running header, page
mark, body line and paragraph break; emissions are layout features of a line (its shape, its width
against the text's, how it opens and ends, whether its wording runs through the collection).
The model is estimated from a bounded sample of multi-line texts: counts of weakly labelled lines,
then rounds of Viterbi re-estimation. Labelled texts are reassembled: headers and page marks go,
words broken at a line end are joined, body lines run on, breaks stay.

Misread characters are found against counts over all texts: a word that is rare and turns into a
frequent one when known confusions of character recognition are undone (0 for o, rn for m ...).

What a feature needs from the collection has a proven bound: lines and hyphenated words count as
running only if they stand in at least a share ``SHARE`` of all texts, so at most (lines a text) /
SHARE of them exist. The table of misread words grows with the data; it is broadcast only below
``BROADCAST_ROWS`` rows, counted first, and joined by shuffle beyond.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syllabrook.session import keep

SHARE = 5e-4
SAMPLE = 3000
BROADCAST_ROWS = 200_000
#: A word whose digits can be read in more ways than this (seven digits and more) is a code, not a misread word.
READINGS = 2_000
HEADER, PAGE, BODY, BREAK = range(4)

# Words that running headers of course documents consist of, as folded stems.
HEADER_STEMS = (
    "departamento", "depto", "dept", "nucleo de", "colegiado", "camara de", "secretaria", "coordenadoria", "coordenacao", "pro-reitoria", "reitoria", "conselho de", "diretoria", "ministerio",
    "plano de ensino", "plano de curso", "programa de disciplina", "programa da disciplina", "ementario", "projeto pedagogico", "sistema academico", "relatorio de", "documento sem valor",
    "registro escolar", "campus de", "centro universitario", "universidade", "faculdade", "instituto",
)
# What character recognition reads (left) for what stands on the page (right).
CONFUSIONS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("1", "í"), ("5", "s"), ("9", "g"), ("6", "ó"), ("6", "o"), ("6", "é"), ("8", "b"), ("4", "a"), ("3", "e"), ("2", "z"),
    ("c", "e"), ("e", "c"), ("rn", "m"), ("m", "rn"), ("ii", "u"), ("u", "ii"), ("cl", "d"), ("d", "cl"), ("n", "ri"), ("ri", "n"), ("ü", "ti"), ("ä", "ã"), ("ö", "õ"),
    ("ƈ", "ç"), ("aʼ", "á"), ("eʼ", "é"), ("iʼ", "í"), ("oʼ", "ó"), ("uʼ", "ú"), ("f", "e"), ("vv", "w"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("li", "h"), ("h", "li"), ("l", "i"), ("i", "l"), ("í", "i"), ("q", "g"), ("g", "q"), ("iii", "m"), ("in", "m"), ("m", "in"), ("ni", "m"), ("nn", "m"), ("o", "a"), ("f", "t"), ("t", "f"), ("é", "ê"),
)
DIGIT_CONFUSIONS = {a for a, _ in CONFUSIONS if a.isdigit()}
# "ƈ" is the mark under which this module keeps a c and a comma inside a word, "ʼ" an apostrophe inside one.
# Confusions whose left side is ordinary in words and which typing slips could give as well are not undone alone.
SLIPPERY = {("o", "a"), ("f", "t"), ("t", "f"), ("é", "ê"), ("í", "i"), ("l", "i"), ("i", "l"), ("g", "q"), ("q", "g")}

HYPHENS = "-‐‑¬­"
_FOLD = str.maketrans("áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")
_DIGITS = str.maketrans("01569", "oisog")
_MASK = re.compile(r"\d+")
_PAGE = re.compile(r"^\W*(?:(?:p[áa]g(?:[il1]na)?s?|fls?|fo[il1]ha)\s*[.:]?\s*|p\s*[.:]\s*)?[\dOolI]{1,4}(?:\s*(?:de|/|of)\s*[\dOolI]{1,4})?\W*$", re.I)
_ROMAN = re.compile(r"^\W*(?=[ivxlc])(?:x{0,3}(?:ix|iv|v?i{0,3})|[xl]+(?:ix|iv|v?i{0,3}))\W*$")
_SUFFIX = re.compile(r"[–—|-]\s*(?:p[áa]g\.?\s*)?\d+(?:\s*(?:/|de)\s*\d+)?$")
_ITEM = re.compile(r"^\s*(?:[•▪◦*·–—-]\s|\d{1,2}(?:\.\d{1,2})*[.)]?\s|[a-z]\)\s|[IVX]+\s*[.–—-]\s|unidade\b|m[óo]dulo\b)", re.I)
_STEMS = re.compile(rf"(?:^|[—–|] )(?:{'|'.join(HEADER_STEMS)})\b")
_APART = re.compile(r"\S {3,}\S|\S — ")
_LETTER = re.compile(r"[^\W\d_]")


def line_form(line: str) -> str:
    """A line without case, accents and numbers, so that one running header has one form."""
    return _MASK.sub("9", line.strip().lower()).translate(_FOLD)


def _features(lines: list[str], running: frozenset[str]) -> list[tuple[int, ...]]:
    """Codes of each line: kind of mark, header wording, opening, ending, width, running, ending of the line before."""
    width = max(map(len, lines)) or 1
    capital = sum(x.isupper() for x in lines) * 2 > len(lines)
    out, before = [], 3
    for i, line in enumerate(lines):
        s = line.strip()
        if not s:
            out.append((3, 0, 4, 3, 0, 0, before, 0))
            before = 3
            continue
        mark = 0
        if len(s) <= 24:
            if _PAGE.match(s) and any(c.isdigit() for c in s):
                mark = 1 if not s.isdigit() else 2
            elif len(s) <= 8 and _ROMAN.match(s):
                mark = 1
        wording = 0
        if len(s) <= 110 and (s[0].isupper() or " — " in s) and s[-1] not in ".;:,":
            form = line_form(s)
            wording = (2 if _STEMS.search(s.lower().translate(_FOLD).translate(_DIGITS)) else 0) + (1 if _SUFFIX.search(s) or _APART.search(s) else 0)
            run = 1 if form in running else 0
        else:
            run = 0
        first = s[0]
        opening = 3 if _ITEM.match(s) else 0 if first.islower() else 1 if first.isupper() else 2
        last = s[-1]
        ending = 1 if last in HYPHENS and len(s) > 1 and s[-2].isalpha() else 0 if last in ".!?" else 2 if last in ";:" else 3
        share = len(s) / width
        out.append((mark, wording, opening, ending, 0 if share < 0.35 else 1 if share < 0.75 else 2, run, before, int(s.isupper() and not capital)))
        before = ending
    return out


SIZES = (4, 4, 5, 4, 3, 2, 4, 2)


def _weak(codes: tuple[int, ...]) -> int | None:
    """The state of lines that leave little doubt, for the first counts; None for the others."""
    mark, wording, opening, _, width, run, before, _ = codes
    if mark in (1, 2):
        return PAGE
    if wording >= 2 or (wording == 1 and run):
        return HEADER
    if opening == 3:
        return BREAK
    if opening == 0 or before == 1:
        return BODY
    if before == 0 and width == 2:
        return BREAK
    return None


class LineModel:
    """Start, transition and emission log-probabilities of the four states."""

    def __init__(self) -> None:
        self.start, self.move = np.full(4, np.log(0.25)), np.full((4, 4), np.log(0.25))
        self.emit = [np.zeros((4, n)) for n in SIZES]

    def fit(self, texts: list[list[tuple[int, ...]]], rounds: int = 2) -> LineModel:
        """Counts of weakly labelled lines, then Viterbi re-estimation; sure labels stay."""
        weak = [[_weak(c) for c in t] for t in texts]
        labels = [[x if x is not None else BODY if c[2] == 0 or c[6] == 3 and c[2] != 1 else BREAK for x, c in zip(w, t, strict=True)] for w, t in zip(weak, texts, strict=True)]
        for _ in range(rounds + 1):
            start, move, emit = np.full(4, 0.5), np.full((4, 4), 0.5), [np.full((4, n), 0.2) for n in SIZES]
            for t, own in zip(texts, labels, strict=True):
                if not own:
                    continue
                start[own[0]] += 1
                for a, b in zip(own, own[1:], strict=False):
                    move[a, b] += 1
                for c, s in zip(t, own, strict=True):
                    for table, value in zip(emit, c, strict=True):
                        table[s, value] += 1
            self.start, self.move = np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True))
            self.emit = [np.log(table / table.sum(1, keepdims=True)) for table in emit]
            labels = [[w if w is not None else int(v) for w, v in zip(ws, vs, strict=True)] for ws, vs in zip(weak, self.label(texts), strict=True)]
        return self

    def label(self, texts: list[list[tuple[int, ...]]]) -> list[np.ndarray]:
        """The likeliest states of every text's lines (Viterbi over all texts side by side)."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        if not sizes.sum():
            return [np.zeros(0, np.int64) for _ in texts]
        codes = np.array([c for t in texts for c in t], dtype=np.int64)
        e = reduce(np.add, (table[:, codes[:, f]] for f, table in enumerate(self.emit))).T
        offset = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        order = np.argsort(-sizes, kind="stable")
        most = int(sizes.max())
        score = np.zeros((len(texts), 4))
        back = np.zeros((len(e), 4), np.int8)
        for t in range(most):
            live = order[: int((sizes > t).sum())]
            at = offset[live] + t
            if t == 0:
                score[live] = self.start + e[at]
            else:
                total = score[live][:, :, None] + self.move[None]
                back[at] = total.argmax(1)
                score[live] = total.max(1) + e[at]
        state = score.argmax(1)
        out = np.zeros(len(e), np.int64)
        for t in range(most - 1, -1, -1):
            live = order[: int((sizes > t).sum())]
            at = offset[live] + t
            out[at] = state[live]
            state[live] = back[at, state[live]]
        return [out[o : o + n] for o, n in zip(offset, sizes, strict=True)]


def rebuild(lines: list[str], states: np.ndarray, compounds: frozenset[str]) -> tuple[str, bool, bool, bool]:
    """Paragraphs from labelled lines, and whether a broken word, a header or a page mark was found."""
    out: list[str] = []
    broken = header = page = False
    for line, state in zip(lines, states, strict=True):
        s = line.strip()
        if state == HEADER and s:
            header = True
        elif state == PAGE and s:
            page = True
        elif not s:
            out.append("")
        else:
            prev = out[-1] if out else ""
            # only a line that the model takes for a going-on carries a broken word on
            if state == BODY and prev and prev[-1] in HYPHENS and len(prev) > 1 and prev[-2].isalpha() and (s[0].islower() or s[0].isupper() and prev[-2].isupper()):
                left, right = re.search(r"[^\W\d_]+$", prev[:-1]), re.match(r"[^\W\d_]+", s)
                if prev[-1] in "-‐‑" and left and right and f"{left[0]}-{right[0]}".lower() in compounds:
                    out[-1] = prev + s
                else:
                    broken = True
                    out[-1] = prev[:-1] + s
            elif prev and state == BODY:
                out[-1] = f"{prev} {s}"
            else:
                out.append(s)
    return "\n".join(out).strip("\n"), broken, header, page


_WORD = re.compile(r"[^\W_]+")
_APOSTROPHE = re.compile(r"(?<=[^\W\d_])'(?=[^\W\d_])")
_CEDILLA = re.compile(r"(?<=[^\W\d_])[cC],(?=[^\W\d_])")


def undo(word: str, deep: bool = True) -> set[str]:
    """Words that recognition may have turned into ``word`` (lower case): confusions undone at one place, all digits at once, or two places."""
    digits = any(c.isdigit() for c in word)
    if digits:
        if not _LETTER.search(word):
            return set()
        found = {""}
        for c in word:
            options = [b for a, b in CONFUSIONS if a == c] if c.isdigit() else [c]
            if not options:
                return set()
            found = {x + o for x in found for o in options}
            if len(found) > READINGS:
                return set()
        return found | ({y for x in found for y in undo(x, False)} if deep else set())
    if len(word) < 4:
        return set()
    out = set()
    for a, b in CONFUSIONS:
        if a.isdigit() or (a, b) in SLIPPERY:
            continue
        at = word.find(a)
        while at >= 0:
            out.add(word[:at] + b + word[at + len(a) :])
            at = word.find(a, at + 1)
    return out | ({y for x in out for y in undo(x, False)} if deep else set())


def _variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(w, n, v) for w, n in zip(batch["word"], batch["n"], strict=True) for v in undo(w)]
        yield pd.DataFrame(rows, columns=["word", "n", "variant"])


def _word_rows(texts: DataFrame, distinct: bool, *keys: str) -> DataFrame:
    """The words (lower case, 3 to 40 characters) of the column ``text``, one row each, with the key columns."""
    low = F.lower("text")
    # marks inside words are rare: only texts that hold them pay for the replacement
    low = F.when(F.contains(low, F.lit("c,")), F.regexp_replace(low, r"(?<=\p{L})c,(?=\p{L})", "ƈ")).otherwise(low)
    low = F.when(F.contains(low, F.lit("'")), F.regexp_replace(low, r"(?<=\p{L})'(?=\p{L})", "ʼ")).otherwise(low)
    words = F.split(low, r"[^\p{L}\p{N}]+")
    return texts.select(*keys, F.explode(F.array_distinct(words) if distinct else words).alias("word")).filter("length(word) between 3 and 40")


def misread_words(texts: DataFrame, ratio: int = 10, least: int = 4) -> DataFrame:
    """Misread words of a collection (column ``text``) with what they stand for: (word, meant).

    A word counts as misread if undoing confusions gives a word at least ``ratio`` times as frequent
    and seen ``least`` times or more in all texts. Ties go to the more frequent, then the smaller word.
    """
    counts = keep(_word_rows(texts, False).groupBy("word").agg(F.count("*").alias("n")))
    odd = counts.filter(F.col("word").rlike(r"\p{L}"))
    tried = odd.mapInPandas(_variants, "word string, n long, variant string")
    meant = counts.select(F.col("word").alias("variant"), F.col("n").alias("seen")).filter((F.col("seen") >= least) & ~F.col("variant").rlike(r"\d"))
    found = tried.join(meant, "variant").filter(F.col("seen") >= F.col("n") * ratio)
    return found.groupBy("word").agg(F.min_by("variant", F.struct(-F.col("seen"), F.col("variant"))).alias("meant"))


def _restore(text: pd.Series, words: pd.Series) -> pd.Series:
    out = []
    for t, pairs in zip(text, words, strict=True):
        if t is not None and pairs is not None and len(pairs):
            table = {p["word"]: p["meant"] for p in pairs}

            def put(m: re.Match, table: dict[str, str] = table) -> str:
                new = table.get(m[0].lower())
                if new is None:
                    return m[0]
                return new.upper() if m[0].isupper() and len(m[0]) > 1 else new[0].upper() + new[1:] if m[0][0].isupper() else new

            marked = _APOSTROPHE.sub("ʼ", _CEDILLA.sub(lambda m: "ƈ" if m[0][0] == "c" else "Ƈ", t))
            t = _WORD.sub(put, marked).replace("ƈ", "c,").replace("Ƈ", "C,").replace("ʼ", "'")
        out.append(t)
    return pd.Series(out, dtype=object)


def label_texts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (key, campo, text) with their lines labelled and reassembled, and the misread words (key, campo, word, meant) in them."""
    texts = keep(texts.select("key", "campo", "text").filter("text is not null"))
    spark = texts.sparkSession
    least = max(3, int(SHARE * texts.count()))
    several = texts.filter(F.contains("text", F.lit("\n")))
    form = F.regexp_replace(F.translate(F.lower(F.trim("line")), "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn"), r"\d+", "9")
    lines = several.select(F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).filter(F.col("line").rlike(r"^\s*\p{Lu}.{2,78}[^.;:,\s]\s*$"))
    joined = texts.filter(F.contains("text", F.lit("-"))).select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+-\p{L}+)"), F.lit(1)))).alias("form"))
    # both sets are bounded: each member stands in a share of all texts
    often = lines.select(F.lit(True).alias("line"), form.alias("form")).union(joined.select(F.lit(False), "form")).groupBy("line", "form").count().filter(F.col("count") >= least).select("line", "form").collect()
    running, compounds = frozenset(f for x, f in often if x), frozenset(f for x, f in often if not x)
    shown = [r[0].split("\n") for r in several.select("text").orderBy(F.xxhash64("text"), "text").limit(SAMPLE).toLocalIterator()]
    model = LineModel().fit([_features(x, running) for x in shown])
    known = spark.sparkContext.broadcast((model, running, compounds))

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, running, compounds = known.value
        for batch in batches:
            split = [t.split("\n") if "\n" in t else [] for t in batch["text"]]
            coded = [_features(x, running) if x else [] for x in split]
            found = [rebuild(x, s, compounds) if x else (t, False, False, False) for t, x, s in zip(batch["text"], split, model.label(coded), strict=True)]
            clean, broken, header, page = (list(c) for c in zip(*found, strict=True)) if found else ([], [], [], [])
            yield pd.DataFrame({"key": batch["key"], "campo": batch["campo"], "text": clean, "original": [t if not (b or h or p) else None for t, (_, b, h, p) in zip(batch["text"], found, strict=True)], "quebra_hifen": broken, "cabecalho": header, "numero_pagina": page})

    labelled = keep(texts.mapInPandas(label, "key long, campo string, text string, original string, quebra_hifen boolean, cabecalho boolean, numero_pagina boolean"))
    wrong = keep(misread_words(labelled))
    few = wrong.count() <= BROADCAST_ROWS
    hits = _word_rows(labelled, True, "key", "campo").join(F.broadcast(wrong) if few else wrong, "word")
    return labelled, hits


def repaired(texts: DataFrame) -> DataFrame:
    """Repair scanned texts: (key, campo, text) to (key, campo, texto, quebra_hifen, cabecalho, numero_pagina, caractere_trocado).

    (key, campo) names a text. Null texts give no row; blank ones and those without scanning noise come
    out letter for letter, whatever their line wraps. Very long texts are handled like others, in time
    linear in their lines. An empty table gives an empty one; other columns are not read.
    """
    labelled, hits = label_texts(texts)
    restore = F.pandas_udf(_restore, "string")
    each = hits.groupBy("key", "campo").agg(F.collect_list(F.struct("word", "meant")).alias("pairs"))
    joined = labelled.join(each, ["key", "campo"], "left")
    wrong = F.col("pairs").isNotNull()
    # texts without noise come out as they were; with misread characters alone, only these change
    base = F.coalesce("original", "text")
    return joined.select(
        "key", "campo", F.when(wrong, restore(base, "pairs")).otherwise(base).alias("texto"), "quebra_hifen", "cabecalho", "numero_pagina", wrong.alias("caractere_trocado")
    )


def defects(texts: DataFrame) -> DataFrame:
    """Kinds of noise of every text: (key, campo, defeito), one row for each kind that occurs."""
    labelled, hits = label_texts(texts)
    kinds = F.array(*(F.when(F.col(k), F.lit(k)) for k in ("quebra_hifen", "cabecalho", "numero_pagina")))
    plain = labelled.select("key", "campo", F.explode(F.array_compact(kinds)).alias("defeito"))
    wrong = hits.select("key", "campo", F.lit("caractere_trocado").alias("defeito"))
    return plain.unionByName(wrong).distinct()
