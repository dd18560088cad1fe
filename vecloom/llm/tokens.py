"""Token counts at every prefix of a text, by dynamic programming over a byte-pair vocabulary.

A text falls into *units* (white space and the run that follows it). Inside a unit
the tokens of each prefix follow from those of shorter prefixes: the last token t of
the prefix of length i is the one vocabulary entry that ends there and may stand
after the last token of the prefix of length i - len(t). So one pass gives the exact
count at every prefix, and truncation, budget and span questions are look-ups.

Edge cases: null and empty texts have 0 tokens; very long texts and long words take
time in proportion to their length; repeated rows each give a row; columns of the
input other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

UNITS = regex.compile(r"(?:\s*[^\S ])?'(?:s|t|re|ve|m|ll|d)|\s*(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+")
PARTS = regex.compile(r"(\s*)(.*)", regex.S)
#: The contractions that the vocabulary's splitting rule keeps whole (fixed values).
CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))
#: Entries of the cache of units and of prefixes before it starts afresh.
CACHE_ENTRIES = 800_000
#: Prefixes of up to so many bytes, and units of up to twice as many characters, are kept in the caches.
CACHED_BYTES = 24


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies: themselves where printable, else from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _unsettled() -> re.Pattern | None:
    """Code points that the regex library takes for letters or numbers and the tokenizers library, with older tables, doesn't."""
    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    odd = [c for c, x in ((c, "a" if k == "L" else "1") for k in "LN" for c in regex.findall(rf"\p{{{k}}}", every) if unicodedata.category(c) == "Cn") if len(split(x + c)) > 1]
    spans: list[list[int]] = []
    for c in sorted(map(ord, odd)):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in spans) + "]") if spans else None


class _Settled:
    """UNITS for a text with such code points: they stand as symbols while the text is split."""

    @staticmethod
    def findall(text: str) -> list[str]:
        flat, out, at = _unsettled().sub("\N{SNOWMAN}", text), [], 0
        for u in UNITS.findall(flat):
            out.append(text[at : at + len(u)])
            at += len(u)
        return out


UNITS_SETTLED = _Settled()


class _Units(dict):
    """Unit to the changes of its counts, worked out when first asked for."""

    def __init__(self, owner: PrefixCounter):
        super().__init__()
        self.owner = owner

    def __missing__(self, unit: str) -> bytes:
        steps = self.owner.unit(unit)
        if len(unit) <= 2 * CACHED_BYTES:
            self[unit] = steps
        return steps


class PrefixCounter:
    """Token counts of every prefix for one byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        alphabet = _byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # Tokens are numbered by the merge that makes them; the 256 bytes come first.
        self.ids: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.left, self.right = list(range(256)), list(range(256))
        self.merge: dict[tuple[int, int], int] = {}
        for pair in spec["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = raw(a), raw(b)
            t = self.ids.setdefault(a + b, len(self.left))
            if t == len(self.left):
                self.left.append(self.ids[a])
                self.right.append(self.ids[b])
            self.merge.setdefault((self.ids[a], self.ids[b]), t)
        self.fits: dict[tuple[int, int], bool] = {}
        reachable = bytearray(b"\1" * 256) + bytearray(len(self.left) - 256)
        for t in range(256, len(self.left)):
            a, b = self.left[t], self.right[t]
            reachable[t] = reachable[a] and reachable[b] and self._beside(a, b, t)
        self.words = {w: t for w, t in self.ids.items() if reachable[t]}
        self.longest = max(map(len, self.words))
        self.at: dict[bytes, int] = {}
        self.deltas = _Units(self)
        self.odd = _unsettled()

    def _beside(self, a: int, b: int, below: int) -> bool:
        """Whether tokens a and b stay apart when no merge from `below` on is applied across them.

        Undoing the later of the two last merges visits each pair of tokens that ever met at the
        border; they would have joined if their merge came before either was used up.
        """
        end_a = end_b = below
        while True:
            m = self.merge.get((a, b))
            if m is not None and m < end_a and m <= end_b and m < below:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:
                end_a, a = a, self.right[a]
            elif b >= 256:
                end_b, b = b, self.left[b]
            else:
                return True

    def _fit(self, a: int, b: int) -> bool:
        key = (a, b)
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) > CACHE_ENTRIES:
                self.fits.clear()
            ok = self.fits[key] = self._beside(a, b, len(self.left))
        return ok

    def _prefixes(self, raw: bytes) -> list[int]:
        """Counts at each byte prefix of one pre-token."""
        at, words, n = self.at, self.words, len(raw)
        last, counts, i = [-1], [0], 1
        while i <= n and i <= CACHED_BYTES and (got := at.get(raw[:i])):
            last.append(got >> 6)
            counts.append(got & 63)
            i += 1
        while i <= n:
            for j in range(max(0, i - self.longest), i):
                t = words.get(raw[j:i])
                if t is not None and (j == 0 or self._fit(last[j], t)):
                    last.append(t)
                    counts.append(counts[j] + 1)
                    break
            else:
                raise ValueError("the vocabulary does not cover these bytes")
            if i <= CACHED_BYTES:
                at[raw[:i]] = last[i] << 6 | counts[i]
            i += 1
        return counts[1:]

    def _run(self, text: str) -> list[int]:
        """Counts at each code point of one pre-token."""
        counts = self._prefixes(text.encode("utf-8", "surrogatepass"))
        if len(counts) == len(text):
            return counts
        raw = text.encode("utf-8", "surrogatepass")
        return [c for c, b in zip(counts, raw[1:] + b"a") if b & 0xC0 != 0x80]

    def unit(self, unit: str) -> bytes:
        """Changes of the count at each code point of a unit, as signed bytes."""
        if unit[0] != "'" and not unit[0].isspace() or unit[0] == " " and not unit[1:2].isspace():
            counts = self._run(unit)
            return bytes([(b - a) & 255 for a, b in zip([0, *counts], counts)])
        space, rest = PARTS.fullmatch(unit).groups()
        if rest in CONTRACTIONS and not space.endswith(" "):
            tail = self._run("'") + [1 + c for c in self._run(rest[1:-1])] + [self._run(rest)[-1]]
        elif rest and space.endswith(" "):
            tail = self._run(" " + rest)[1:]
        else:
            tail = self._run(rest) if rest else []
        head, counts = self._run(space) if space else [], []
        if rest and space:
            before = head[-2] if len(space) > 1 else 0
            before += 0 if space.endswith(" ") else self._run(space[-1])[-1]
            tail = [before + c for c in tail]
        counts = np.array([0, *head, *tail])
        steps = np.diff(counts)
        assert steps.size == 0 or (steps.min() >= -128 and steps.max() <= 127)
        return steps.astype(np.int8).tobytes()

    def _plain(self, text: str) -> tuple[bytes, int]:
        units = (UNITS if self.odd is None or text.isascii() or not self.odd.search(text) else UNITS_SETTLED).findall(text)
        if len(self.deltas) > CACHE_ENTRIES:
            self.deltas.clear()
        if len(self.at) > CACHE_ENTRIES:
            self.at.clear()
        out = b"".join(map(self.deltas.__getitem__, units))
        return out, int(np.frombuffer(out, np.int8).sum(dtype=np.int64))

    def prefix_deltas(self, text: str) -> tuple[bytes, int]:
        """Change of the count at each code point of the text, and the count of all of it."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self._plain(text)
        out, total = [], 0
        pieces = self.split_special.split(text)
        for k in range(0, len(pieces), 2):
            d, n = self._plain(pieces[k])
            out.append(d)
            total += n
            if k + 1 < len(pieces):
                mark = pieces[k + 1]
                tail = (UNITS.findall(pieces[k]) or [""])[-1]
                base = total - (self._plain(tail)[1] if tail else 0)
                counts = [total] + [base + self._plain(tail + mark[:q])[1] for q in range(1, len(mark))] + [total + 1]
                out.append(np.diff(counts).astype(np.int8).tobytes())
                total += 1
        return b"".join(out), total

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token count of text[:i] at position i, for i from 0 to len(text)."""
        steps = np.frombuffer(self.prefix_deltas(text)[0], np.int8)
        return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_prefixes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 512, tokenizer: str = "byte_bpe_50k.json", store: bool = True) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, cut_chars, and with `store` the prefix table.

    cut_chars is the longest prefix, in code points, of at most `budget` tokens. prefix_steps holds
    one signed byte per code point: running sums are the counts at every prefix (see count_at).
    One pass without a shuffle.
    """
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("cut_chars", pa.int64())]
    fields += [("prefix_steps", pa.binary())] if store else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(tokenizer_path(tokenizer))
        for batch in batches:
            texts = batch.column(1)
            n_tokens, cuts, steps = [], [], []
            for k in range(len(texts)):
                text = texts[k].as_py()
                deltas, total = counts.prefix_deltas(text)
                n_tokens.append(total)
                cut = len(text)
                if total > budget:
                    cut = int(np.flatnonzero(np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int32) <= budget)[-1]) + 1 if budget > 0 else 0
                cuts.append(cut)
                if store:
                    steps.append(deltas)
            size = pa.compute.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n_tokens, pa.int64()), pa.array(cuts, pa.int64())] + ([pa.array(steps, pa.binary())] if store else []), schema=pa.schema(fields))

    schema = "doc_id long, n_bytes long, n_tokens long, cut_chars long" + (", prefix_steps binary" if store else "")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)


def count_at(prefix_steps: bytes, chars: int) -> int:
    """Tokens of the prefix of so many code points, from a stored prefix table."""
    return int(np.frombuffer(prefix_steps, np.int8)[:chars].sum(dtype=np.int64))


def cut_at(prefix_steps: bytes, budget: int) -> int:
    """The longest prefix, in code points, of at most `budget` tokens, from a stored prefix table."""
    counts = np.concatenate([[0], np.cumsum(np.frombuffer(prefix_steps, np.int8), dtype=np.int64)])
    return int(np.flatnonzero(counts <= budget)[-1])
