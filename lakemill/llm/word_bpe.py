"""A word-level BPE tokenizer file, read and applied without its library: forced-boundary splitting.

Two byte symbols that stand beside each other inside no entry of the vocabulary can never end up in one token,
so the place between them is a certain cut. Fragments between such cuts are encoded on their own and their ids
are strung together. The merge order inside a fragment is the library's: lowest rank first, then leftmost.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import regex

#: Bounds of the caches of one Python worker, in entries. prepare() empties a full cache before the next piece of input, so memory stays bounded.
WORD_CACHE, FRAGMENT_CACHE = 200_000, 100_000
NO_RANK = 1 << 40


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 bytes are themselves, the others count up from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def part_finder(spec: dict):
    """Finds the pre-tokens of a normalised text. \\s of the file's expression is Unicode's White_Space; regex's own \\s has four controls more."""
    pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}")).findall


class WordBPE:
    """Encodes and decodes as the tokenizers library does with the same file and add_special_tokens=False."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks = {p: n for n, p in enumerate(map(self._pair, model["merges"]))}
        self.symbols = byte_symbols()
        self.parts = part_finder(spec)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.joined = self._joined_pairs()
        self.by_id = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self._rank_table()
        self.fragments: dict[tuple[str, bool], list[str]] = {}
        self.tokens: dict[str, tuple[str, str]] = {}
        self.words: dict[str, tuple[str, str]] = {}

    @staticmethod
    def _pair(merge) -> tuple[str, str]:
        return tuple(merge) if isinstance(merge, list) else tuple(merge.split(" "))

    def _joined_pairs(self) -> set[str]:
        """Adjacent symbols inside some vocabulary entry. The end mark belongs to the entry's last symbol."""
        found = set()
        for token in self.vocab:
            body, last = (token[: -len(self.end)], True) if self.end and token.endswith(self.end) and token != self.end else (token, False)
            found.update(a + b for a, b in zip(body, body[1:] if not last else body[1:-1], strict=False))
            if last and len(body) > 1:
                found.add(body[-2:] + self.end)
        return found

    def cut(self, text: str) -> list[str]:
        """Splits the symbols of one pre-token at every forced boundary."""
        joined, n = self.joined, len(text) - 1
        cuts = [i for i in range(1, n) if text[i - 1 : i + 1] not in joined]
        if n > 0 and text[n - 1 :] + self.end not in joined:
            cuts.append(n)
        return [text[i:j] for i, j in zip([0, *cuts], [*cuts, n + 1], strict=True)] if cuts else [text]

    def merge(self, fragment: str, last: bool) -> list[str]:
        """The tokens of one fragment; last: it ends its word."""
        if found := self.fragments.get((fragment, last)):
            return found
        s = list(fragment)
        if last:
            s[-1] += self.end
        s = self._merge_long(s) if len(s) > 48 else self._merge_short(s)
        self.fragments[fragment, last] = s
        return s

    def _rank_table(self) -> None:
        """Open-addressing table from a pair of ids to its rank, for many lookups at once."""
        vocab = self.vocab
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in self.ranks], dtype=np.int64)
        self.merged_id = np.array([vocab[a + b] for a, b in self.ranks], dtype=np.int64)
        self.slot_bits = max(4, int(4 * len(keys)).bit_length())
        self.slot_key = np.full(1 << self.slot_bits, -1, dtype=np.int64)
        self.slot_rank = np.full(1 << self.slot_bits, NO_RANK, dtype=np.int64)
        self.probes = 0
        todo = np.arange(len(keys))
        while len(todo):
            at = self._slots(keys[todo], self.probes)
            free = np.flatnonzero(self.slot_key[at] == -1)
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            self.slot_key[at[won]], self.slot_rank[at[won]] = keys[todo[won]], todo[won]
            todo = np.delete(todo, won)
            self.probes += 1

    def _slots(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(64 - self.slot_bits)).astype(np.int64) + probe) & ((1 << self.slot_bits) - 1)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        out = np.full(len(keys), NO_RANK, dtype=np.int64)
        todo = np.arange(len(keys))
        for probe in range(self.probes):
            at = self._slots(keys[todo], probe)
            there = self.slot_key[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.slot_rank[at[hit]]
            todo = todo[~hit & (there != -1)]
            if not len(todo):
                break
        return out

    def merge_many(self, fragments: list[tuple[str, bool]]) -> None:
        """Encodes fragments that are not in the cache yet, all of one length at a time."""
        by_length: dict[int, list[tuple[str, bool]]] = {}
        for x in fragments:
            by_length.setdefault(len(x[0]), []).append(x)
        vocab, by_id = self.vocab, self.by_id
        for length, group in by_length.items():
            if length > 48 or len(group) < 8:
                for x in group:
                    self.merge(*x)
                continue
            rows = np.arange(len(group))
            s = np.array([[vocab[c] for c in text[:-1]] + [vocab[text[-1] + self.end * last]] for text, last in group], dtype=np.int64)
            r = self.rank_of(s[:, :-1].ravel(), s[:, 1:].ravel()).reshape(len(group), length - 1)
            while True:
                at = r.argmin(axis=1) if r.shape[1] else np.zeros(len(rows), dtype=np.int64)
                best = r[np.arange(len(rows)), at] if r.shape[1] else np.full(len(rows), NO_RANK)
                done = best == NO_RANK
                for k, ids in zip(rows[done].tolist(), s[done].tolist(), strict=True):
                    self.fragments[group[k]] = [by_id[i] for i in ids]
                if done.all():
                    break
                rows, s, r, at, best = rows[~done], s[~done], r[~done], at[~done], best[~done]
                all_rows, wide = np.arange(len(rows)), np.arange(s.shape[1] - 1)[None, :]
                s = np.take_along_axis(s, wide + (wide > at[:, None]), axis=1)
                s[all_rows, at] = self.merged_id[best]
                wide = wide[:, :-1]
                r = np.take_along_axis(r, wide + (wide >= at[:, None]), axis=1)
                for shift in (0, -1):
                    there = np.flatnonzero((at + shift >= 0) & (at + shift < r.shape[1]))
                    c = at[there] + shift
                    r[there, c] = self.rank_of(s[there, c], s[there, c + 1])

    def prepare(self, texts: list[str]) -> None:
        """Fills the caches with what texts need and they lack; each cache is emptied first if it is full."""
        for cache, most in ((self.words, WORD_CACHE), (self.tokens, WORD_CACHE), (self.fragments, FRAGMENT_CACHE)):
            if len(cache) >= most:
                cache.clear()
        new: set[str] = set()
        for text in texts:
            new.update(self.split(text))
        parts, lower, tokens, known = self.parts, self.lower, self.tokens, self.fragments
        of_word = {w: parts(lower(w)) for w in new.difference(self.words)}
        of_part = {p: self.fragments_of(p) for p in {p for ps in of_word.values() for p in ps}.difference(tokens)}
        self.merge_many([x for x in {x for xs in of_part.values() for x in xs} if x not in known])
        vocab = self.vocab
        for part, xs in of_part.items():
            got = known[xs[0]] if len(xs) == 1 else [t for x in xs for t in known[x]]
            tokens[part] = " ".join([str(vocab[t]) for t in got]), " ".join(got)
        for w, ps in of_word.items():
            self.words[w] = tokens[ps[0]] if len(ps) == 1 else (" ".join([tokens[p][0] for p in ps]), " ".join([tokens[p][1] for p in ps]))

    def fragments_of(self, part: str) -> list[tuple[str, bool]]:
        symbols = self.symbols
        cuts = self.cut(part if part.isascii() and part.isprintable() else "".join([symbols[b] for b in part.encode()]))
        return [*((x, False) for x in cuts[:-1]), (cuts[-1], True)]

    def _merge_short(self, s: list[str]) -> list[str]:
        rank, none = self.ranks.get, 1 << 60
        found = [rank(p, none) for p in zip(s, s[1:], strict=False)]
        while found:
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            s[i] += s.pop(i + 1)
            del found[i]
            if i < len(found):
                found[i] = rank((s[i], s[i + 1]), none)
            if i:
                found[i - 1] = rank((s[i - 1], s[i]), none)
        return s

    def _merge_long(self, s: list[str]) -> list[str]:
        """The same order with a heap, for fragments where searching for the best pair anew would cost too much."""
        n = len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, s[i], s[i + 1]) for i in range(n - 1) if (r := self.ranks.get((s[i], s[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if s[i] == a else n
            if s[i] != a or j >= n or s[j] != b:
                continue
            s[i], s[j] = a + b, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := self.ranks.get((s[i], s[k]))) is not None:
                    heapq.heappush(heap, (r, i, s[i], s[k]))
            if (k := before[i]) >= 0 and (r := self.ranks.get((s[k], s[i]))) is not None:
                heapq.heappush(heap, (r, k, s[k], s[i]))
        return [x for x in s if x]

    def token(self, part: str) -> tuple[str, str]:
        """Ids and tokens of a pre-token, each joined by spaces."""
        if found := self.tokens.get(part):
            return found
        tokens = [t for x in self.fragments_of(part) for t in self.merge(*x)]
        vocab = self.vocab
        got = " ".join([str(vocab[t]) for t in tokens]), " ".join(tokens)
        self.tokens[part] = got
        return got

    @staticmethod
    def lower(text: str) -> str:
        """Character by character: a capital sigma has one small form, also at a word's end."""
        return text.lower() if text.isascii() else text.replace("Σ", "σ").lower()

    def word(self, word: str) -> tuple[str, str]:
        """As token(), for a normalised run without white space; capitals are allowed."""
        got = [self.token(p) for p in self.parts(self.lower(word))]
        out = got[0] if len(got) == 1 else (" ".join([g[0] for g in got]), " ".join([g[1] for g in got]))
        self.words[word] = out
        return out

    @staticmethod
    def split(text: str) -> list[str]:
        """The normalised text's runs without white space."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return [w for w in regex.split(r"\p{White_Space}+", text) if w] if _odd_space(text) else text.split()

    def plain(self, text: str) -> tuple[str, str]:
        """Ids and decoded text of a text without special tokens."""
        known = self.words.get
        got = [known(w) or self.word(w) for w in self.split(text)]
        return " ".join([g[0] for g in got if g[0]]), " ".join([g[1] for g in got if g[0]])

    def encode_decode(self, text: str | None) -> tuple[str, str]:
        """Decimal ids joined by one space, and what decoding them gives (the file has no decoder: tokens joined by spaces)."""
        if not text:
            return "", ""
        if self.specials is None or "<|" not in text:
            return self.plain(text)
        got = []
        for k, x in enumerate(self.specials.split(text)):
            if x:
                got.append((str(self.special[x]), x) if k % 2 else self.plain(x))
        return " ".join([g[0] for g in got if g[0]]), " ".join([g[1] for g in got if g[0]])

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.by_id[i] for i in ids])


def _odd_space(text: str) -> bool:
    """Has the text a control that str.split() takes for white space and Unicode does not?"""
    return any(c in text for c in "\x1c\x1d\x1e\x1f")


_LOADED: dict[str, WordBPE] = {}


def load(path: str) -> WordBPE:
    """One instance for each Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]
