"""Problem 10: sentence boundaries across languages and scripts.

Method: document-centred disambiguation. Whether a full stop ends a sentence depends on whether the
word before it is an abbreviation and the word after it a proper name. Both are decided from
unambiguous occurrences elsewhere in the same document (a stop before a small letter, a word in small
letters, a capital in mid-sentence); where the document is silent, from counts over all documents.
Other scripts have their own terminators: ideographic and Devanagari full stops, the Arabic question
mark, and for Thai the blank between two Thai letters.

Counts cover all documents. What each task is told of them has a proven bound: words that make up at
least a share ``SHARE`` of all words, so at most 1 / SHARE of them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 5e-6
# Abbreviations known beforehand, those that often end a sentence, those before names, and German months.
KNOWN = frozenset("art arts cap cf cfr dept depto ed ex fig fl inc n no nr núm num p pp pág pag par s séc sec v vol vols vs ver z b d h bzw ca abs aufl hrsg jan fev mar abr jun jul ago set out nov dez bl coord secr univ tel obs ms mr mrs st sr sra srta dr dra prof profa m mme e.g i.e p.ex".split())
ENDING = frozenset("etc usw p.m a.m jr ltda cia s.a u.s.w ff".split())
BEFORE_NAMES = frozenset("dr dra prof profa sr sra srta mr mrs ms mme m d dona st eng".split())
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember".split())
OPENERS = {"“": "”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "《": "》", "„": "“", "‘": "’"}
BRACKETS = frozenset("(（[")
CLOSING = "\"”’»」』)）]》"
_WORD = re.compile(r"[^\W\d_]+(?:\.[^\W\d_]+)*")
_TOKEN_BEFORE = re.compile(r"(?:[^\W_]\.)*[^\W_]+$")
_MARK = re.compile(r"[.!?…。！？।؟]+")
_ITEM = re.compile(r"[ \t]*(?:[-•*–▪]|\(?\d{1,3}[.)]|\(?[a-zA-Z]\)|\(?[ivxIVX]{1,5}\))[ \t]+(?=\S)")
_BLANK = re.compile(r"\n[ \t\r 　]*(?:\n[ \t\r 　]*)+")


def _thai(c: str) -> bool:
    return "฀" <= c <= "๿"


def _cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "＀" <= c <= "￯" or "가" <= c <= "힣"


def evidence(text: str) -> dict[str, list[int]]:
    """Of each word, in small letters: how often small, capital in mid-sentence, before a stop, before a stop and a going-on, without stop."""
    out: dict[str, list[int]] = {}
    size = len(text)
    for m in _WORD.finditer(text):
        w = m[0]
        a, e = m.span()
        own = out.setdefault(w.lower(), [0, 0, 0, 0, 0])
        if w[0].islower():
            own[0] += 1
        elif w[0].isupper() and a > 1:
            k = a - 1
            while k > 0 and text[k] == " ":
                k -= 1
            if text[k].islower() or text[k] == ",":
                own[1] += 1
        if e < size and text[e] == ".":
            own[2] += 1
            k = e + 1
            spaced = False
            while k < size and text[k] in "  \n":
                spaced, k = True, k + 1
            if k < size and (text[k] in ",;:)" or (spaced and (text[k].islower() or text[k].isdigit()))):
                own[3] += 1
        else:
            own[4] += 1
    return out


def _regions(text: str, start: int, stop: int) -> list[tuple[int, int]]:
    """Quotations and brackets of a paragraph (open, close), outermost only; what is never closed is none."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for i in range(start, stop):
        c = text[i]
        if c == '"':
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), None)
            if at is None:
                stack.append(('"', i))
            else:
                found.append((stack[at][1], i))
                del stack[at:]
            continue
        if c in CLOSING or c == "“":
            at = next((k for k in range(len(stack) - 1, -1, -1) if OPENERS.get(stack[k][0]) == c or (stack[k][0] == "„" and c == "”")), None)
            if at is not None:
                found.append((stack[at][1], i))
                del stack[at:]
                continue
        if c in OPENERS and c != "‘":
            stack.append((c, i))
    found.sort()
    outer: list[tuple[int, int]] = []
    for o, c in found:
        if not outer or o > outer[-1][1]:
            outer.append((o, c))
    return outer


def _around(regions: list[tuple[int, int]], i: int) -> tuple[int, int] | None:
    """The region that opens before ``i`` and closes at it or later; regions are apart and in order."""
    at = bisect_left(regions, (i, -1)) - 1
    return regions[at] if at >= 0 and regions[at][1] >= i else None


class Splitter:
    """Ends of the sentences of a document, given what the collection tells of common words and abbreviations."""

    def __init__(self, common: frozenset[str] = frozenset(), short: frozenset[str] = frozenset()) -> None:
        self.common, self.short = common, short

    def _is_short(self, word: str, own: dict[str, list[int]]) -> bool:
        if len(word) == 1 or "." in word:
            return True
        seen = own.get(word)
        if seen and seen[3] and seen[2] > seen[4]:
            return True
        if seen and seen[4] and not seen[3]:
            return word in self.short and word in KNOWN
        return word in self.short or word in KNOWN or word in ENDING

    def _is_common(self, word: str, own: dict[str, list[int]]) -> bool:
        seen = own.get(word)
        if seen and seen[0]:
            return True
        if seen and seen[1]:
            return False
        return word in self.common

    def _stop_ends(self, text: str, dot: int, after: int, own: dict[str, list[int]]) -> bool:
        """Whether the full stop at ``dot``, its closing marks reaching to ``after``, ends a sentence."""
        size = len(text)
        if after < size and not text[after].isspace():
            return _cjk(text[after]) and not text[dot - 1 : dot].isdigit() and not text[dot - 1 : dot].isascii()
        k = after
        while k < size and text[k].isspace():
            k += 1
        if k >= size:
            return True
        following = text[k]
        if following.islower():
            return False
        before = _TOKEN_BEFORE.search(text, max(0, dot - 40), dot)
        if before is None:
            return True
        word = before[0]
        if "ऀ" <= word[-1] <= "෿":
            return False
        lower = word.lower()
        m = _WORD.match(text, k)
        nxt = m[0].lower() if m else ""
        if word.isdigit():
            return not (following.isdigit() or nxt in MONTHS)
        if not self._is_short(lower, own):
            return True
        if lower in ENDING:
            return True
        if following.isdigit():
            return False
        if not following.isupper():
            # scripts without capitals: a single letter before the stop is an initial
            return following in "“«\"(¿¡-•–" and lower not in BEFORE_NAMES and len(lower) > 1
        if lower in BEFORE_NAMES and len(lower) > 1:
            return False
        if m and len(m[0]) == 1:
            e = m.end()
            # a letter before a stop or comma is an initial or a label, before a word an article
            if e < size and text[e] in ".,;:)":
                return False
        return self._is_common(nxt, own)

    def ends(self, text: str) -> list[int]:
        """Offsets of the ends of all sentences of ``text``."""
        own = evidence(text)
        out: list[int] = []
        at = 0
        for m in [*_BLANK.finditer(text), None]:
            stop = m.start() if m else len(text)
            self._paragraph(text, at, stop, own, out)
            if m:
                at = m.end()
        return out

    def _paragraph(self, text: str, start: int, stop: int, own: dict[str, list[int]], out: list[int]) -> None:
        while start < stop and text[start].isspace():
            start += 1
        while stop > start and text[stop - 1].isspace():
            stop -= 1
        if start >= stop:
            return
        regions = _regions(text, start, stop)
        lines, a = [], start
        while a <= stop:
            b = text.find("\n", a, stop)
            b = stop if b < 0 else b
            lines.append((a, b))
            a = b + 1
        width = max(len(text[a:b].rstrip()) for a, b in lines)
        sentence = start  # where the open sentence begins
        listed = False
        for n, (a, b) in enumerate(lines):
            line_start = a
            while line_start < b and text[line_start].isspace():
                line_start += 1
            if line_start >= b:
                continue
            item = _ITEM.match(text, a, b)
            if item and sentence < line_start and (listed or text[line_start] in "-•*▪–" or n == 0):
                # a new item closes what is open
                self._close(text, sentence, a, out)
                sentence = line_start
            body = line_start
            if item and sentence >= line_start:
                sentence, body, listed = line_start, item.end(), True
            elif sentence >= line_start:
                listed = False
            pos = body
            while True:
                cut = self._next(text, pos, b, stop, sentence, regions, own)
                if cut is None:
                    break
                end, goes_on = cut
                if goes_on:
                    pos = end
                    continue
                out.append(end)
                sentence = end
                while sentence < stop and text[sentence].isspace():
                    sentence += 1
                pos = sentence  # past the blank that ended a Thai sentence, or it would be found again
            if n + 1 < len(lines) and sentence < b and sentence >= line_start and not _around(regions, b):
                nxt = text[lines[n + 1][0] : lines[n + 1][1]].strip()
                own_line = text[sentence:b].rstrip()
                if nxt and self._stands_alone(own_line, nxt, width, sentence == line_start, len(lines)):
                    self._close(text, sentence, b, out)
                    sentence = lines[n + 1][0]
                    while sentence < stop and text[sentence].isspace():
                        sentence += 1
        if sentence < stop:
            self._close(text, sentence, stop, out)

    @staticmethod
    def _close(text: str, start: int, stop: int, out: list[int]) -> None:
        while stop > start and text[stop - 1].isspace():
            stop -= 1
        if stop > start and (not out or out[-1] < stop):
            out.append(stop)

    @staticmethod
    def _stands_alone(line: str, following: str, width: int, whole: bool, count: int) -> bool:
        """Whether a line without a closing mark is a title or item of its own, not the first line of a wrapped sentence."""
        first = following[0]
        if first.islower() or first in ",;:.)":
            return False
        last = line[-1]
        if last in ",;-" or (last == "." and len(line) > 60):
            return False
        if _thai(last) and _thai(first):
            return True
        if not whole or len(line) > 70:
            return False
        if _cjk(last) or _cjk(first):
            return len(line) <= 20 or len(line) < 0.6 * width
        word = following.split(None, 1)[0]
        return len(line) + 1 + len(word) < 0.8 * width or count <= 2 and len(line) < 50

    def _next(self, text: str, pos: int, stop: int, paragraph: int, sentence: int, regions: list[tuple[int, int]], own: dict[str, list[int]]) -> tuple[int, bool] | None:
        """The next place after ``pos`` on this line that may end a sentence: (offset, whether the sentence goes on there)."""
        mark = _MARK.search(text, pos, stop)
        limit = mark.start() if mark else stop
        # Thai: a blank between Thai letters
        k = text.find(" ", pos, limit)
        while k >= 0:
            j = k
            while j < stop and text[j] == " ":
                j += 1
            if k > 0 and j < stop and _thai(text[k - 1]) and _thai(text[j]) and not ((r := _around(regions, k)) and k < r[1]):
                return k, False
            k = text.find(" ", j, limit)
        if mark is None:
            return None
        i, end = mark.start(), mark.end()
        inside = _around(regions, i)
        inside = inside if inside and i < inside[1] else None
        k = end
        while k < paragraph and (text[k] in CLOSING or (text[k] == "“" and inside and text[inside[0]] == "„") or (text[k] in "   " and text[k + 1 : k + 2] == "»")):
            if text[k] == '"' and not (inside and inside[1] == k):
                break
            k += 1
        if inside and k <= inside[1]:
            return end, True
        kind = text[i:end]
        j = k
        while j < paragraph and text[j].isspace():
            j += 1
        following = text[j] if j < paragraph else ""
        spaced = j > k
        if inside:
            if text[inside[0]] in BRACKETS:
                return (k, text[sentence : inside[0]].strip() != "")
            if not following:
                return k, False
            if _cjk(following) or _cjk(text[i]) or kind[0] in "。！？":
                return k, not (spaced and "\n" in text[k:j])
            return k, not (spaced and (following.isupper() or following.isdigit() or following in "“«\"(¿¡„-•–" or not following.isalpha() or not (following.islower() or following.isupper())))
        if kind[0] in "。！？।؟":
            return k, False
        if kind[0] == "…" or kind.startswith(".."):
            if not following:
                return k, False
            return k, not (spaced and not following.islower()) or _cjk(following) and not spaced
        if kind[0] in "!?":
            return k, bool(following) and (not spaced and not _cjk(following) or following.islower())
        return k, not self._stop_ends(text, i, k, own)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        total: dict[str, list[int]] = {}
        for text in batch["text"]:
            for w, c in evidence(text).items():
                if len(w) <= 40:
                    have = total.setdefault(w, [0] * 5)
                    for i in range(5):
                        have[i] += c[i]
        yield pd.DataFrame([(w, *c) for w, c in total.items()], columns=["word", "small", "capital", "stop", "goes_on", "plain"])


def collection_words(texts: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """Common words (seen in small letters) and abbreviations of a collection (column ``text``), from counts over all of it."""
    names = ("small", "capital", "stop", "goes_on", "plain")
    counts = texts.select("text").mapInPandas(_count, "word string, " + ", ".join(f"{n} long" for n in names)).groupBy("word").agg(*(F.sum(n).alias(n) for n in names)).persist()
    total = counts.agg(F.sum(F.col("stop") + F.col("plain"))).first()[0] or 0
    often = counts.filter(F.col("stop") + F.col("plain") >= max(2, SHARE * total))
    common = often.filter((F.col("small") > 0) & (F.col("small") * 3 >= F.col("capital"))).select("word")
    short = often.filter((F.col("goes_on") > 0) & (F.col("stop") >= 4 * F.col("plain")) & (F.length("word") <= 8)).select("word")
    out = frozenset(r[0] for r in common.toLocalIterator()), frozenset(r[0] for r in short.toLocalIterator())
    counts.unpersist()
    return out


def sentences(documents: DataFrame, id_col: str, text_col: str, spell: bool = True) -> DataFrame:
    """The sentences of every document: (id, ordem, fim, frase); without ``spell`` only (id, fim).

    ``fim`` is the number of code points up to the sentence's end. Null and blank texts give no row;
    other texts at least one. Repeated rows each give their sentences. Very long texts take time
    linear in their length, but for the nesting of quotations. An empty table gives an empty result.
    """
    data = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(r"text rlike '(?U)\\S'")
    known = data.sparkSession.sparkContext.broadcast(collection_words(data))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter = Splitter(*known.value)
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                start = 0
                for n, end in enumerate(splitter.ends(text)):
                    rows.append((key, n, end, text[start:end].strip()) if spell else (key, end))
                    start = end
            yield pd.DataFrame(rows, columns=["id", "ordem", "fim", "frase"] if spell else ["id", "fim"])

    return data.mapInPandas(split, "id long, ordem int, fim int, frase string" if spell else "id long, fim int")
