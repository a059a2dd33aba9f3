"""Sums of shared character n-grams over Arrow batches, for TF-IDF cosines within groups of texts.

A group of texts makes some thousand n-grams; as rows they would be shuffled, sorted and joined, a
hundred times the size of the texts. Here texts arrive sorted by group and n-grams never leave the
arrays of a batch: every n-gram is a number, and one sort of (group, n-gram, text) counts all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Kinds of texts in a group, in their order: targets to be scored, sources, targets that are scored elsewhere.
OWN, SOURCE, OTHER = 0, 1, 2
#: Letters handled together (more only if one group has more), n-grams sorted together and products summed together.
LETTERS, SORTED, PRODUCTS = 400_000, 4_000_000, 4_000_000
_WIDE = 1 << 62


def _changes(a: pa.Array) -> np.ndarray:
    """Whether a row differs from the row before; the first one does, nulls always do."""
    out = np.ones(len(a), bool)
    if len(a) > 1:
        out[1:] = pc.fill_null(pc.not_equal(a.slice(1), a.slice(0, len(a) - 1)), True).to_numpy(zero_copy_only=False)
    return out


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from every start on, as many as counted, one list after the other."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _digits(letters: np.ndarray) -> tuple[np.ndarray, int]:
    """Letters (code points) numbered from 1, blanks as 0, and the bound of the numbers."""
    known = np.zeros(0x110000, bool)
    known[letters] = True
    known[32] = False
    rank = np.cumsum(known)
    base = int(rank[-1]) + 1
    rank[32] = 0
    return rank[letters], base


def _windows(digits: np.ndarray, base: int, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """All n-grams without an inner blank: (place, number, bound of the numbers). Equal numbers mean equal n-grams."""
    places = max(len(digits) - n + 1, 0)
    code, size, whole = digits[:places], base, np.ones(places, bool)
    for k in range(1, n):
        if size * base >= _WIDE:
            seen, code = np.unique(code, return_inverse=True)
            size = len(seen)
        code, size = code * base + digits[k : k + places], size * base
        if k < n - 1:
            whole &= digits[k : k + places] != 0
    at = np.flatnonzero(whole)
    return at, code[at], size


def _scored(rows: pa.Table) -> pa.RecordBatch:
    """Cosines of a table of whole groups."""
    par, block, kind, ids, text = (rows.column(c).combine_chunks() for c in ("par", "block", "kind", "id", "plain"))
    kind = kind.to_numpy()
    opens = _changes(par) | _changes(block)
    group = np.cumsum(opens) - 1
    # a text that comes twice is one, as its rows are neighbours
    first = opens | _changes(ids) | np.append(True, kind[1:] != kind[:-1])
    row = np.flatnonzero(first)
    doc_of_row = np.cumsum(first) - 1
    n = np.bincount(group)
    group, kind = group[row], kind[row]
    head = np.flatnonzero(opens[row])
    docs = np.diff(np.append(head, len(row)))
    local = np.arange(len(row)) - head[group]
    most = int(docs.max())
    own, sources = (np.bincount(group[kind == k], minlength=len(n)) for k in (OWN, SOURCE))
    # the pairs of a group lie together, those of one target in a row
    pairs = own * sources
    base = np.cumsum(pairs) - pairs
    line = base[group] + local * sources[group]
    column = local - own[group]
    dots, squares = np.zeros(int(pairs.sum())), np.zeros(len(row))

    digits, letters = _digits(np.frombuffer("".join(text.to_pylist()).encode("utf-32-le"), np.uint32))
    doc_at = np.repeat(doc_of_row, pc.utf8_length(text).to_numpy())
    for size in (3, 4, 5):
        at, code, bound = _windows(digits, letters, size)
        doc = doc_at[at]
        if bound * len(n) * most >= _WIDE:
            seen, code = np.unique(code, return_inverse=True)
            bound = len(seen)
        key = (group[doc] * bound + code) * most + local[doc]
        parts = max(1, -(-len(key) // SORTED))
        for part in range(parts):
            _add(np.sort(key if parts == 1 else key[code % parts == part]), bound, most, n, head, kind, line, column, dots, squares)
    t = np.flatnonzero(kind == OWN)
    target = np.repeat(t, sources[group[t]])
    source = _spread(head[group[t]] + own[group[t]], sources[group[t]])
    some = np.flatnonzero(dots > 0)
    target, source = target[some], source[some]
    value = dots[some] / np.sqrt(squares[target] * squares[source])
    target, source = pa.array(row[target]), pa.array(row[source])
    return pa.RecordBatch.from_arrays([par.take(target), ids.take(target), ids.take(source), pa.array(value)], ["par", "destino", "origem", "lexical"])


def _add(key: np.ndarray, bound: int, most: int, n: np.ndarray, head: np.ndarray, kind: np.ndarray, line: np.ndarray, column: np.ndarray, dots: np.ndarray, squares: np.ndarray) -> None:
    """Add what sorted n-grams (group, n-gram, text) give to the products of pairs and to the squares of texts."""
    if not len(key):
        return
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    tf = np.diff(np.append(starts, len(key)))
    gram, local = np.divmod(key[starts], most)
    opens = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    df = np.diff(np.append(opens, len(gram)))
    group = gram[opens] // bound
    idf = np.log((1 + n[group]) / (1 + df)) + 1
    gram = np.repeat(np.arange(len(opens)), df)
    weight = tf * idf[gram]
    doc = head[group][gram] + local
    squares += np.bincount(doc, weight * weight, len(squares))
    # texts of an n-gram are in the order of their kinds
    kinds = kind[doc]
    own, sources = (np.bincount(gram[kinds == k], minlength=len(opens)) for k in (OWN, SOURCE))
    left = np.flatnonzero((kinds == OWN) & (sources[gram] > 0))
    count = sources[gram[left]]
    begin = opens[gram[left]] + own[gram[left]]
    ends = np.cumsum(count)
    for lo, hi in _runs(ends, PRODUCTS):
        a = np.repeat(left[lo:hi], count[lo:hi])
        b = _spread(begin[lo:hi], count[lo:hi])
        np.add(dots, np.bincount(line[doc[a]] + column[doc[b]], weight[a] * weight[b], len(dots)), out=dots)


def _runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` units each, of at least one element; ``ends`` are the running sums of the units."""
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (par, block, kind, id, plain) sorted by the first four: (par, destino, origem, lexical) of all scored targets and sources of each (par, block).

    ``plain`` has its words between single blanks, one before and one after. A group is held until it is
    complete; of a large one the letters and the pairs are in memory, its n-grams ``SORTED`` at a time.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        begins = np.flatnonzero(_changes(batch.column("par")) | _changes(batch.column("block")))
        if held:
            same = all(held[-1].column(c)[-1] == batch.column(c)[0] for c in ("par", "block"))
            begins = begins[1:] if same else begins
        else:
            begins = begins[1:]
        if len(begins):
            cut = int(begins[-1])
            yield from _whole(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield from _whole(pa.Table.from_batches(held))


def _whole(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    begins = np.flatnonzero(_changes(rows.column("par").combine_chunks()) | _changes(rows.column("block").combine_chunks()))
    letters = np.append(0, np.cumsum(pc.utf8_length(rows.column("plain").combine_chunks()).to_numpy() + 1))
    edges = np.append(begins, rows.num_rows)
    for lo, hi in _runs(letters[edges[1:]], LETTERS):
        yield _scored(rows.slice(int(edges[lo]), int(edges[hi] - edges[lo])))
