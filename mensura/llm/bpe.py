"""BPE encoding and decoding by a prefix-sharing trie traversal.

Distinct pre-tokens of a batch are walked in sorted order, which is a depth-first walk of
their trie.  Each trie node keeps one number, the last token of the encoding of its prefix;
the token before it is found at the node where that last token begins.  A node's last token is
the one vocabulary suffix of the prefix that can stand beside the last token of what precedes
it, so shared prefixes are encoded once, and an encoding is read back from its leaf to the root.

Nothing is shuffled: each document is encoded where it is read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.llm.common import free_name, held, lean, slices

#: Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words that a worker remembers at most, and the length beyond which it remembers none.
CACHE_WORDS, CACHE_CHARS = 600_000, 40


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: themselves where printable, else the code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def check(spec: dict) -> None:
    """Raises ValueError for a vocabulary file that asks for what this encoder does not do."""
    model, before, after = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [k for k in ("normalizer",) if spec.get(k)]
    odd += ["model"] * (model.get("type", "BPE") != "BPE")
    odd += ["pre_tokenizer"] * (before.get("type") != "ByteLevel" or bool(before.get("add_prefix_space")) or not before.get("use_regex", True))
    odd += ["decoder"] * (after.get("type") != "ByteLevel")
    odd += [t["content"] for t in spec.get("added_tokens", []) if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
    if odd:
        raise ValueError(f"this encoder doesn't know the vocabulary's {', '.join(odd)}")


class TrieEncoder:
    """A byte-level BPE vocabulary and its trie traversal."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check(spec)
        letters = byte_alphabet()
        raw = lambda s: bytes(letters[c] for c in s)
        self.vocab = {raw(tok): i for tok, i in spec["model"]["vocab"].items() if all(c in letters for c in tok)}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            left, right, whole = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank[left, right] = k
            self.halves.setdefault(whole, (left, right))
            self.made.setdefault(whole, k)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.bytes = [b""] * size
        for b, i in self.vocab.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self._suffixes()
        self.words = regex.compile(PATTERN).findall
        parts = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, parts)) + ")").split if parts else None
        self.fits: dict[int, bool] = {}
        self.known = {s: pack("<I", i) for s, i in self.special.items()}

    def _suffixes(self) -> None:
        """An automaton whose state after a prefix knows all tokens that the prefix ends with, longest first."""
        step: list[dict[int, int]] = [{}]
        ends: list[tuple[tuple[int, int], ...]] = [()]
        for token, i in self.vocab.items():
            at = 0
            for x in token:
                nxt = step[at].get(x)
                if nxt is None:
                    nxt = step[at][x] = len(step)
                    step.append({})
                    ends.append(())
                at = nxt
            ends[at] = ((i, len(token)),)
        back = [0] * len(step)
        level = list(step[0].values())
        while level:
            below = []
            for at in level:
                ends[at] = ends[at] + ends[back[at]]
                for x, nxt in step[at].items():
                    b = back[at]
                    while b and x not in step[b]:
                        b = back[b]
                    back[nxt] = step[b].get(x, 0)
                    below.append(nxt)
            level = below
        self.step, self.back, self.ends = step, back, ends
        self.moves: dict[int, int] = {}

    def _move(self, at: int, x: int) -> int:
        step, b = self.step, at
        while b and x not in step[b]:
            b = self.back[b]
        to = self.moves[at << 8 | x] = step[b].get(x, 0)
        return to

    def beside(self, left: int, right: int) -> bool:
        """Do both tokens stay as they are when their bytes are encoded together?

        Merges are undone from the latest on, along the seam only.  A pair across the seam that
        would have merged before either neighbour was complete rules the two tokens out.
        """
        key = left << 32 | right
        made, halves, rank = self.made, self.halves, self.rank
        a, b, before, ok = left, right, 1 << 60, True
        # before: only a merge of a rank under it happens ahead of what was undone so far.
        # A merge on the right of equal rank happens after one on its left.
        while True:
            k = rank.get((a, b))
            if k is not None and k < before:
                ok = False
                break
            ka, kb = made.get(a, -1), made.get(b, -1)
            if ka < 0 and kb < 0:
                break
            if ka > kb:
                before, a = ka, halves[a][1]
            else:
                before, b = kb + 1, halves[b][0]
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of each distinct word, as little-endian unsigned 32-bit integers."""
        vocab, ends, moves, fits = self.vocab, self.ends, self.moves, self.fits
        out: dict[str, bytes] = {}
        deep = []
        for w in words:
            b = w.encode("utf-8", "surrogatepass")
            i = vocab.get(b)
            if i is None:
                deep.append((b, w))
            else:
                out[w] = i.to_bytes(4, "little")
        deep.sort()
        last, length, state = [-1], [0], [0]  # of each node on the path from the root
        path = b""
        for b, w in deep:
            shared, most = 0, min(len(path), len(b))
            if path[:most] == b[:most]:
                shared = most
            else:
                while path[shared] == b[shared]:
                    shared += 1
            del last[shared + 1 :], length[shared + 1 :], state[shared + 1 :]
            at = state[shared]
            for d in range(shared + 1, len(b) + 1):
                x = b[d - 1]
                to = moves.get(at << 8 | x)
                at = self._move(at, x) if to is None else to
                state.append(at)
                for t, n in ends[at]:
                    if n == d:
                        break
                    fit = fits.get(last[d - n] << 32 | t)
                    if fit or fit is None and self.beside(last[d - n], t):
                        break
                else:
                    raise ValueError(f"no encoding of {b[:d]!r}")
                last.append(t)
                length.append(n)
            path = b
            d, ids = len(b), []
            while d:
                ids.append(last[d])
                d -= length[d]
            out[w] = pack("<%dI" % len(ids), *reversed(ids))
        return out

    def split(self, text: str) -> list[str]:
        if self.cut is None:
            return self.words(text)
        parts = self.cut(text)
        if len(parts) == 1:
            return self.words(text)
        out: list[str] = []
        for part in parts:
            out.extend([part] if part in self.special else self.words(part))
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts; each distinct word is encoded once a batch, or less often."""
        if len(self.known) > CACHE_WORDS:  # of bounded size: begun anew when full
            self.known = {s: pack("<I", i) for s, i in self.special.items()}
        known = self.known
        split = [self.split(t) for t in texts]
        new = set().union(*split).difference(known)
        known.update(self.encode_words(new))
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > CACHE_CHARS:
                del known[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        table = self.bytes
        whole = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])
        try:
            whole.decode()
            return whole
        except UnicodeDecodeError:
            return whole.decode("utf-8", "replace").encode()


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """docs with the token ids of every whole text, and the text that these ids decode to.

    docs: any DataFrame; its other columns stay.  vocabulary: path of the vocabulary file, which
    every executor must have.  ids: array<int>.  decoded: string column, or None to leave it out.
    A null text counts as empty: no ids, decoded to the empty string.  An output column replaces
    a column of the same name.  Rows, repeated ones too, are answered one by one.
    """
    return _run(docs, vocabulary, text, {ids: T.ArrayType(T.IntegerType())} | ({decoded: T.StringType()} if decoded else {}), "values")


def digests(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 from the same encoder, without the ids leaving Python."""
    return _run(docs, vocabulary, text, {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}, "digests")


def _run(docs: DataFrame, vocabulary: str, text: str, new: dict[str, T.DataType], kind: str) -> DataFrame:
    names = list(new)
    keep = [c for c in docs.columns if c.lower() not in {n.lower() for n in names} and not (kind == "digests" and c == text)]
    own = free_name(docs, "own_text")
    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(own))
    schema = T.StructType([*given.schema.fields[:-1], *[T.StructField(n, t) for n, t in new.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = held(("bpe", vocabulary), lambda: TrieEncoder(vocabulary))
        for batch in batches:
            for texts, part in slices(batch):
                ids = enc.encode_batch(texts)
                back = map(enc.decode, ids)
                if kind == "digests":
                    done = [
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                    ]
                else:
                    done = [pa.array([np.frombuffer(x, "<u4").astype("int32") for x in ids], pa.list_(pa.int32()))]
                    if len(names) > 1:
                        done.append(pa.array([x.decode() for x in back]))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *done], [*batch.schema.names[:-1], *names])

    return given.mapInArrow(lean(run), schema)
