"""Periodic runs of words, found by matching aligned blocks.

The words of a text become numbers.  At the least scale, its aligned blocks are the integer-sequence
keys of an Aho-Corasick automaton, which is run over the text; at each further scale a block is twice as
long, and its key is the pair of its halves' names.  A run with three periods or
more holds an aligned block that occurs again one period later, at the scale whose block is at most as
long as the period; so an occurrence at a distance of one to two blocks (the least scale: of anything shorter too) is a seed,
and a seed is extended in both directions, word by word, as far as words one distance apart are equal.

What stays near linear in long or very regular texts:
  - seeds inside a known run at a multiple of its period would find that period again, and are dropped;
  - a seed between two runs of one short period can grow past them only if their starts or ends lie
    one distance apart;
  - a seed within what its distance has already grown to is dropped;
  - a text none of whose blocks occurs twice has no run, at this scale or a larger one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.llm.common import free_name, lean, slices

#: Words whose blocks one automaton holds (longer texts take several); bytes of a text that are split at once.
SPAN, PIECE = 1 << 20, 1 << 22

Run = tuple[int, int, int]


def numbered(text: str) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text (between ASCII white space) as numbers, and the distinct words."""
    flat, known, parts, start = text.encode("utf-8", "surrogatepass"), {}, [], 0
    if len(flat) > PIECE:
        flat = flat.translate(bytes(32 if b in b"\t\n\v\f\r" else b for b in range(256)))
    while start < len(flat):
        end = flat.find(b" ", start + PIECE) if len(flat) - start > PIECE else -1
        end = end if end >= 0 else len(flat)
        words = flat[start:end].split()
        parts.append(np.array([known.setdefault(w, len(known)) for w in words], np.int64))
        start = end
    return (parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.int64), *parts])), list(known)


def occurrences(values: np.ndarray, starts: range, size: int) -> np.ndarray:
    """For each place of values: a place of `starts` with the same `size` values from there on (one for all such places), else -1."""
    import ahocorasick

    found, whole = np.full(len(values), -1, np.int64), tuple(values.tolist())
    for first in range(0, len(starts), max(SPAN // size, 1)):
        a = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for s in starts[first : first + max(SPAN // size, 1)]:
            if found[s] < 0:  # else an earlier automaton had it
                a.add_word(whole[s : s + size], s)
        if len(a):
            a.make_automaton()
            hits = np.array(list(a.iter(whole)), np.int64).reshape(-1, 2)
            found[hits[:, 0] - size + 1] = hits[:, 1]
    return found


def named_blocks(words: np.ndarray, block: int, halves: np.ndarray | None) -> np.ndarray:
    """For each word, an aligned place with the same block of words (one for all such places), else -1.

    halves: the same for blocks of half the size; then keys are pairs of their names, searched in the sequences of
    names half a block apart, so that keys stay short however long blocks are.
    """
    n = len(words)
    if halves is None:
        return occurrences(words, range(0, n - block + 1, block), block)
    h = block // 2
    rows = -(-n // h) + 1  # a name is 0 where there is none, also after the last of each sequence
    names = np.zeros(rows * h, np.int64)
    names[:n] = halves + 1
    found = occurrences(names.reshape(rows, h).T.ravel(), range(0, 2 * (n // block), 2), 2)
    found = np.where(found < 0, -1, found * h).reshape(h, rows).T.ravel()[:n]
    return found


def _forward(words: np.ndarray, j: int, d: int) -> int:
    """The first place from j on whose word differs from that d before."""
    size = 32
    while j < len(words):
        here = words[j : j + size]
        differ = here != words[j - d : j - d + len(here)]
        k = int(differ.argmax())
        if differ[k]:
            return j + k
        j, size = j + len(here), size * 2
    return len(words)


def _backward(words: np.ndarray, i: int, d: int) -> int:
    """The first of the places before i from which on every word equals that d after."""
    size = 32
    while i > 0:
        low = max(0, i - size)
        differ = np.flatnonzero(words[low:i] != words[low + d : i + d])
        if len(differ):
            return low + int(differ[-1]) + 1
        i, size = low, size * 2
    return 0


def _covered(n: int, runs: list[Run], window: Callable[[int], int]) -> np.ndarray:
    """For each place, the number of a run that holds a window of its period from there on, else -1."""
    out = np.full(n, -1, np.int64)
    for k, (start, length, period) in enumerate(runs):
        if (size := window(period)) and length >= size:
            out[start : start + length - size + 1] = k
    return out


def _unexplained(at: np.ndarray, d: np.ndarray, block: int, n: int, runs: list[Run]) -> np.ndarray:
    """Which seeds (a block at `at` and again d later) known runs of less than a block do not explain."""
    if not runs:
        return np.ones(len(at), bool)
    start, length, period = (np.array(c, np.int64) for c in zip(*runs))
    whole = _covered(n, runs, lambda p: 2 * block if p < block else 0)[at]  # two runs can't share so long a window
    inside = (whole >= 0) & (at + d + block <= (start + length)[whole]) & (d % period[whole] == 0)
    short = _covered(n, runs, lambda p: block if 4 * p <= block else 0)
    a, b = short[at], short[at + d]
    between = (a >= 0) & (b >= 0) & (start[b] - start[a] != d) & ((start + length)[b] - (start + length)[a] != d)
    return ~(inside | between)


def find_runs(words: np.ndarray, least: int = 24) -> list[Run]:
    """(start, length, period) of all runs, by start, then period.

    A run is a stretch with smallest period q, that is words q apart are equal, of length max(least, 3 * q) or
    more, which no neighbouring word extends.
    """
    n = len(words)
    block = 1 << max(1, (2 * least + 3) // 6).bit_length() - 1  # so that a run of `least` words holds a block twice at any distance up to a third of it
    runs: list[Run] = []
    low, names = 1, None
    while n >= max(least, 3 * low):
        names = named_blocks(words, block, names)
        if not np.any((names >= 0) & (names != np.arange(n))):
            return sorted(runs)
        x, seeds = np.flatnonzero(names >= 0), []
        for back in (0, block):
            s = (x - low) // block * block - back
            d = x - s
            ok = (s >= 0) & (d < 2 * block)
            ok[ok] = names[x[ok]] == names[s[ok]]
            seeds.append(np.stack([s[ok], d[ok]]))
        at, far = np.concatenate(seeds, axis=1)
        for group in [far == d for d in range(1, 2 * block)] if low == 1 else [slice(None)]:
            a, d = at[group], far[group]
            if low == 1 and len(a):  # runs of a part of d
                cover = _covered(n, runs, lambda p: int(d[0]) + block if d[0] % p == 0 else 0)
                a, d = a[cover[a] < 0], d[cover[a] < 0]
            else:
                fresh = _unexplained(a, d, block, n, runs)
                a, d = a[fresh], d[fresh]
            new: list[Run] = []
            grown_d, grown_to = 0, 0
            order = np.lexsort([a, d])
            for s, q in zip(a[order].tolist(), d[order].tolist()):
                if q == grown_d and s < grown_to:
                    continue
                end = _forward(words, s + q + block, q)
                start = _backward(words, s, q)
                grown_d, grown_to = q, end - q
                if end - start >= max(least, 3 * q):
                    new.append((start, end - start, q))
            runs += new
        low = 2 * block
        block = low
    return sorted(runs)


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def collapsed(words: np.ndarray, known: list[bytes], keep: np.ndarray) -> str:
    """The words that stay, joined by one space."""
    ids, out = words[keep], []
    for a in range(0, len(ids), 1 << 19):
        out.append(b" ".join([known[i] for i in ids[a : a + (1 << 19)].tolist()]))
    return b" ".join(out).decode("utf-8", "surrogatepass")


RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def collapse_runs(docs: DataFrame, text: str = "text", least: int = 24, edit: Callable[[object, np.ndarray], np.ndarray] | None = None, key: str = "doc_id") -> DataFrame:
    """docs with its text as the words that stay, joined by one space, and n_words, n_runs and runs.

    Words are what lies between ASCII white space.  runs: (start, length, period) by start, then period; all but the
    first period of each run goes.  A null text stays null and has no words or runs; a text without words becomes
    empty.  Rows are answered one by one, repeated ones too; other columns come through, those with a result's name are replaced.

    edit(value of key, word numbers) may give other numbers of the same text's words before the search.
    """
    new = ["n_words", "n_runs", "runs"]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c in (text, key) or c.lower() not in new])
    own = free_name(docs, "own_text")
    given = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != text], F.col(f"`{text}`").cast("string").alias(own))
    tail = [(text, T.StringType()), ("n_words", T.LongType()), ("n_runs", T.LongType()), ("runs", RUNS)]
    schema = T.StructType([*given.schema.fields[:-1], *[T.StructField(n, t) for n, t in tail]])
    at = given.columns.index(key) if edit else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        for batch in batches:
            for texts, part in slices(batch):
                there = part.column(part.num_columns - 1).is_valid().to_pylist()
                keys = part.column(at).to_pylist() if edit else there
                out: list[list] = [[] for _ in tail]
                for t, ok, k in zip(texts, there, keys):
                    words, known = numbered(t)
                    words = edit(k, words) if edit else words
                    runs = find_runs(words, least)
                    left = collapsed(words, known, kept_words(len(words), runs)) if ok else None
                    for col, v in zip(out, (left, len(words), len(runs), [dict(zip(("start", "length", "period"), r)) for r in runs])):
                        col.append(v)
                kinds = (pa.string(), pa.int64(), pa.int64(), arrow)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, out, kinds)], schema.names)

    order = [*docs.columns, *new]
    return given.mapInArrow(lean(run), schema).select(*[F.col(f"`{c}`") for c in order])


def digest(found: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document its key, n_runs, the run of greatest length / period (ties: least start, then period) and digests of all runs and of the text."""
    none = F.lit(None).cast(RUNS.elementType)
    best = F.reduce("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[n].cast("string") for n in ("start", "length", "period")]))
    every = F.concat(F.array_join(lines, "\n"), F.when(F.col("n_runs") > 0, F.lit("\n")).otherwise(""))
    got = found.select(F.col(f"`{key}`"), "n_runs", best.alias("best"), F.sha2(every, 256).alias("runs_sha256"), F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256).alias("collapsed_sha256"))
    return got.select(F.col(f"`{key}`"), "n_runs", "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
