"""Substring dedup: prefix-partitioned suffix trees over words.

A suffix is a word position of a text with the words from there on, and the word before it. Every suffix that can
repeat a window is indexed: a window can repeat only if its anchor, its 5-word run with the smallest hash, stands in two
different texts (equal windows have equal anchors). Neighbouring suffixes of that kind are kept together as a fragment of the text
until the suffixes are dealt.

Suffixes are dealt to groups, and groups by a hash to buckets, by prefixes of variable length. Suffixes are counted for each three-word prefix; the prefixes
of more suffixes than a group may hold are lengthened and counted again, until each group fits (LEVELS). Only
a prefix that is a whole window can stay too large: then all its suffixes are leaves of one node, and
that node's smallest document comes from partial minima (crowded), not from a tree.

In a group the suffix tree is built from the sorted suffixes and the words that neighbours share. Its suffixes are cut STEP - 1 words
beyond a window. Internal nodes as deep as a window or deeper are repeats; those whose leaves have different words before them
are the maximal repeats. A leaf below a node with a smaller document gives a removed range as long as the node is deep, where the
node is maximal, or at every STEP-th word of the document: the cut suffixes of a long repeat don't know where it begins.

Whole copies of a text don't enter: each of their windows starts in the first copy.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, materialise, pieces

GRAM = 5  # words of an anchor
STEP = 3  # suffixes are cut STEP - 1 words beyond a window
LEVELS = (3, 5, 8)  # words of the prefixes that are tried before the whole window
MOST_SENT = 1_000_000  # heavy prefixes of a length, of 8 bytes, that there may be: they are sent along with a task
SPREAD = 8  # parts of the copies of one text
ODD = np.uint64(0x9E3779B97F4A7C15)


GAP = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])  # what bytes.split() splits at
RUN = 1 << 16  # bytes whose words are hashed at once


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (h ^ (h >> np.uint64(27))) * ODD


BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * ODD)
POWERS = np.cumprod(np.full(RUN, ODD, dtype=np.uint64))
INVERSES = np.cumprod(np.full(RUN, pow(int(ODD), -1, 2**64), dtype=np.uint64))


class Words:
    """The words of some texts, as spans of raw: words first[k] to first[k + 1] are those of text k."""

    def __init__(self, texts: list[bytes]):
        self.raw = b" ".join([b"", *texts, b""])
        self.bytes = np.frombuffer(self.raw, dtype=np.uint8)
        gap = GAP[self.bytes]
        edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.first = np.searchsorted(self.starts, np.concatenate([[1], 1 + np.cumsum(lengths)]))

    def __len__(self) -> int:
        return len(self.starts)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words. Different words may rarely have one hash; it only chooses candidates and deals them."""
        out, a = np.empty(len(self), dtype=np.uint64), 0
        while a < len(self):
            i = self.starts[a]
            b = max(a + 1, int(np.searchsorted(self.ends, i + RUN, "right")))
            j = self.ends[b - 1]
            if j - i > RUN:
                out[a] = xxhash.xxh3_64_intdigest(self.raw[i:j])
            else:
                sums = np.zeros(j - i + 1, dtype=np.uint64)
                np.cumsum(BYTES[self.bytes[i:j]] * POWERS[: j - i], out=sums[1:])
                begins = self.starts[a:b] - i
                out[a:b] = (sums[self.ends[a:b] - i] - sums[begins]) * INVERSES[begins]
            a = b
        return mixed(out)


def texts_of(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one anchor (the smallest hash of their 5-word runs): where they begin, by the number of the first
    window's first word, how many windows they have, and the anchor. A window lies in one text."""
    gram, total = min(GRAM, window), len(words)
    if total < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = words.hashes()
    n = total - gram + 1
    g = np.zeros(n, dtype=np.uint64)
    for k in range(gram):
        g *= ODD
        g += h[k : k + n]
    g = mixed(g)
    wide, m = window - gram + 1, total - window + 1
    low, step = g, 1
    while step * 2 <= wide:  # minima of runs of 2, 4, 8 ...
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[:m], low[wide - step : wide - step + m])
    owner = words.owners()
    at = np.flatnonzero(owner[:m] == owner[window - 1 :])
    low, owner = low[at], owner[at]
    begin = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])])[: len(at)])
    return at[begin], np.diff(np.append(begin, len(at))), low[begin]


def prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, text and c, a hash of the text; an id together with c names a text."""
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} has to be an integer column")
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc"), text.alias("text"), F.xxhash64(text).alias("c"))


def copies(rows: DataFrame) -> DataFrame:
    """(doc, c) of the texts that stand whole under a smaller id, too."""
    slim = rows.select("doc", "c", F.length("text").alias("n"))
    firsts = slim.groupBy("c", "n").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("last > first").select("c", "n", "first")
    # a group of copies may be a third of all rows
    firsts = firsts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    slim = slim.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(SPREAD)).cast("int"))
    return materialise(slim.join(firsts, ["c", "n", "part"]).where("doc > first").select("doc", "c").distinct(), "copies")


def anchor_table(rows: DataFrame, window: int) -> DataFrame:
    """(a, doc, c): the distinct anchors of each document."""

    def run(batches):
        for batch in pieces(batches, 1_000_000):
            words = Words(texts_of(batch.column("text")))
            at, _, a = anchors(words, window)
            of = np.searchsorted(words.first, at, "right") - 1
            order = np.lexsort((a, of))
            a, of = a[order], of[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (of[1:] != of[:-1])])[: len(a)]
            a, of = a[new], of[new]
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), *(pa.array(batch.column(n).to_numpy()[of]) for n in ("doc", "c"))], names=["a", "doc", "c"])

    return materialise(rows.where("doc IS NOT NULL").mapInArrow(run, "a bigint, doc bigint, c bigint"), "anchors")


def shared_anchors(table: DataFrame) -> DataFrame:
    """(a): anchors of two different texts or more."""
    return materialise(table.groupBy("a").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("a"), "shared")


def notes(rows: DataFrame, table: DataFrame, whole: DataFrame) -> DataFrame:
    """(doc, c, tag, marks, copy): a document's shared anchors, and whether it is a copy of another. tag is c where an id
    has several texts, else 0."""
    shared = shared_anchors(table)
    marks = table.join(shared, "a").groupBy("doc", "c").agg(F.collect_list("a").alias("marks"))
    several = rows.groupBy("doc").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("doc", F.lit(True).alias("several"))
    whole = whole.withColumn("copy", F.lit(True))
    joined = marks.join(whole, ["doc", "c"], "full").join(several, "doc", "left")
    out = materialise(joined.select("doc", "c", F.when(F.col("several"), F.col("c")).otherwise(0).alias("tag"), "marks", F.coalesce("copy", F.lit(False)).alias("copy")), "notes")
    discard(shared)
    return out


def among(some: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of some are in known, which is in order."""
    if not len(known):
        return np.zeros(len(some), dtype=bool)
    return known[np.minimum(np.searchsorted(known, some), len(known) - 1)] == some


#: Where a suffix stands.
PLACE = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("place", "<i4")])
FRAGMENT = "doc bigint, tag bigint, at int, lead int, n int, anchor bigint, words binary"


def fragments(rows: DataFrame, noted: DataFrame, window: int) -> DataFrame:
    """A row for each run of neighbouring windows with shared anchors: the place of its first word, how many windows it has (n), and
    its words, with the one word before them where there is one (lead). Runs with the same smallest anchor come
    to lie together, which only helps to merge equal suffixes early; AQE splits a large group of them."""

    def run(batches):
        for batch in pieces(batches, 1_000_000):
            words = Words(texts_of(batch.column("text")))
            at, n, a = anchors(words, window)
            of = np.searchsorted(words.first, at, "right") - 1
            marks = batch.column("marks")
            # an anchor together with the number of its text; two pairs of one key would only add windows that can't repeat
            salt = mixed(np.arange(1, batch.num_rows + 1, dtype=np.uint64) * ODD)
            known = np.repeat(salt, pc.list_value_length(marks).to_numpy()) ^ marks.flatten().to_numpy().view(np.uint64)
            held = among(salt[of] ^ a, np.sort(known))
            at, n, a, of = at[held], n[held], a[held], of[held]
            if not len(at):
                continue
            begin = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + n[:-1]) | (of[1:] != of[:-1])]))
            least, n = np.minimum.reduceat(a, begin), np.add.reduceat(n, begin)
            at, of = at[begin], of[begin]
            lead = (at > words.first[of]).astype(np.int32)
            own = [words.raw[i:j] for i, j in zip(words.starts[at - lead].tolist(), words.ends[at + n + window - 2].tolist(), strict=True)]
            doc, tag = (batch.column(c).to_numpy()[of] for c in ("doc", "tag"))
            arrays = [pa.array(doc), pa.array(tag), pa.array(at - words.first[of], pa.int32()), pa.array(lead), pa.array(n, pa.int32()), pa.array(least.view(np.int64)), pa.array(own, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc", "tag", "at", "lead", "n", "anchor", "words"])

    marked = rows.join(noted.where("NOT copy AND marks IS NOT NULL").select("doc", "c", "tag", "marks"), ["doc", "c"])
    return materialise(marked.select("doc", "tag", "text", "marks").mapInArrow(run, FRAGMENT).hint("rebalance", "anchor"), "fragments", advisory="16m")


def prefix_hashes(batch: pa.RecordBatch, lengths: list[int]) -> tuple[Words, np.ndarray, list[np.ndarray]]:
    """The words of a batch of fragments, the places of their suffixes among all of these words, and for each length a hash of
    the suffixes' prefixes of so many words."""
    words = Words(texts_of(batch.column("words")))
    h = words.hashes()
    n = batch.column("n").to_numpy()
    begins = words.first[:-1] + batch.column("lead").to_numpy()
    spots = np.repeat(begins - np.cumsum(n) + n, n) + np.arange(n.sum())
    out, rolled, done = [], np.zeros(len(spots), dtype=np.uint64), 0
    for length in lengths:
        for k in range(done, length):
            rolled *= ODD
            rolled += h[spots + k]
        done = length
        out.append(mixed(rolled).view(np.int64))
    return words, spots, out


def heavy_prefixes(frags: DataFrame, window: int, most: int) -> list[tuple[int, np.ndarray]]:
    """For each length tried, the prefixes of more than most suffixes, as hashes in order: at most (suffixes / most) of them.

    Longer lengths are tried only while some prefix is too heavy, and count only what a heavy prefix of the first length begins. Two
    prefixes of one hash are merely dealt together.
    """
    first, *others = [*(n for n in LEVELS if n < window), window]

    def counted(lengths: list[int], known: np.ndarray | None = None) -> dict[int, np.ndarray]:
        def count(batches):
            for batch in pieces(batches, 1_000_000):
                hashes = prefix_hashes(batch, lengths if known is None else [first, *lengths])[2]
                if known is not None:
                    under = among(hashes[0], known)
                    hashes = [h[under] for h in hashes[1:]]
                for length, h in zip(lengths, hashes, strict=True):
                    prefix, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(prefix), length, dtype=np.int32)), pa.array(prefix), pa.array(n)], names=["length", "prefix", "n"])

        heavy = frags.mapInArrow(count, "length int, prefix bigint, n bigint").groupBy("length", "prefix").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("length", "prefix").collect()
        return {length: np.array(sorted(r["prefix"] for r in heavy if r["length"] == length), dtype=np.int64) for length in lengths}

    found = counted([first])
    if others and len(found[first]):
        found |= counted(others, found[first])
    out: list[tuple[int, np.ndarray]] = []
    for length, known in found.items():
        out.append((length, known))
        if not len(known):
            break
    return out


CROWDED = -1  # the bucket of suffixes whose whole window is a heavy prefix
BLOCK = struct.Struct("<IIII")


class Packer:
    """Makes blocks of suffixes that are rows of codes of words, from one list of words."""

    def __init__(self, words: list[bytes]):
        self.words, self.own, self.press = words, np.zeros(len(words), dtype=np.uint32), zstandard.ZstdCompressor(level=1)
        self.seen = np.zeros(len(words), dtype=bool)

    def __call__(self, rows: np.ndarray, counts: np.ndarray, places: np.ndarray) -> bytes:
        """Suffixes, how many places each has, and these places, as one compressed block with the words that it uses."""
        self.seen[rows] = True
        used = np.flatnonzero(self.seen)
        self.seen[used] = False
        self.own[used] = np.arange(len(used))
        codes = self.own[rows].astype("<u2" if len(used) <= 1 << 16 else "<u4")
        text = b"\n".join([self.words[k] for k in used.tolist()])  # a word has no line break
        return self.press.compress(b"".join([BLOCK.pack(len(text), len(used), *rows.shape), text, codes.tobytes(), counts.astype("<u4").tobytes(), *(places[c].tobytes() for c in PLACE.names)]))


class Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))


def unpack(blocks: list[bytes | pa.Buffer]) -> tuple[Numbers, np.ndarray, np.ndarray, np.ndarray]:
    """The words of blocks with their codes, their suffixes as rows of codes (0: no word), the number of each place's suffix, and the places."""
    press, number, keys, owner, places, done = zstandard.ZstdDecompressor(), Numbers({b"": 0}), [], [], [], 0
    for block in blocks:
        raw = press.decompress(block)
        size, used, n, width = BLOCK.unpack_from(raw)
        at = BLOCK.size + size
        codes = np.frombuffer(raw, dtype="<u2" if used <= 1 << 16 else "<u4", count=n * width, offset=at)
        at += codes.nbytes
        counts = np.frombuffer(raw, dtype="<u4", count=n, offset=at)
        at += counts.nbytes
        keys.append(number.of(raw[BLOCK.size : BLOCK.size + size].split(b"\n"))[codes].reshape(n, width))
        owner.append(np.repeat(np.arange(done, done + n), counts))
        done += n
        own = np.zeros(int(counts.sum()), dtype=PLACE)
        for c in PLACE.names:
            own[c] = np.frombuffer(raw, dtype=PLACE[c], count=len(own), offset=at)
            at += own[c].nbytes
        places.append(own)
    return number, np.concatenate(keys), np.concatenate(owner), np.concatenate(places)


def suffixes(frags: DataFrame, window: int, heavy: list[tuple[int, np.ndarray]], buckets: int) -> DataFrame:
    """(bucket, block): for each bucket, the distinct suffixes of a piece of input that belong there. A suffix's group is its shortest
    prefix tried that isn't heavy, and a hash deals groups to buckets. A row of a block has the suffix's words, then the word before it."""
    reach = window + STEP - 1
    lengths = [n for n, _ in heavy]

    def run(batches):
        for batch in pieces(batches, 3_000_000):
            if not batch.num_rows:
                continue
            words, spots, hashes = prefix_hashes(batch, [*lengths, window])
            group, still = hashes[0].view(np.uint64), np.ones(len(spots), dtype=bool)
            for (_, known), h in zip(heavy, hashes):
                group = np.where(still, h.view(np.uint64), group)
                still &= among(h, known)
            n, lead = batch.column("n").to_numpy(), batch.column("lead").to_numpy()
            number = Numbers({b"": 0})
            codes = np.concatenate([number.of(words.raw.split()), np.zeros(reach, dtype=np.int32)])
            del words
            begins = np.cumsum(n) - n
            size = np.full(len(spots), reach, dtype=np.int32)
            for k in range(1, STEP):  # the last suffixes of a fragment end with it
                size[(begins + n - k)[n >= k]] -= STEP - k
            before = codes[spots - 1]
            before[begins[lead == 0]] = 0  # a text's first suffix has no word before it
            # by bucket and group, then by window; equal suffixes lie together
            after = np.where(size > window, codes[spots + window], 0)
            alike = mixed(hashes[-1].view(np.uint64) + (after.astype(np.uint64) << np.uint64(32)) + before.astype(np.uint64))
            key = group >> np.uint64(24) << np.uint64(24) | mixed(hashes[-1].view(np.uint64)) >> np.uint64(52) << np.uint64(12) | alike >> np.uint64(52)
            del hashes, after, alike
            bucket = np.where(still, CROWDED, ((group >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64))
            order = np.argsort(key)
            del key, group
            if still.any():
                order = np.concatenate([order[still[order]], order[~still[order]]])
            bucket, spots, size = bucket[order], spots[order], size[order]
            rows = np.empty((len(order), reach + 1), dtype=np.int32)
            for k in range(reach):
                rows[:, k] = codes[spots + k] if k < window else np.where(k < size, codes[spots + k], 0)
            rows[:, reach] = before[order]
            del spots, size, before
            cut = np.concatenate([[True], bucket[1:] != bucket[:-1]])
            new = cut.copy()
            for column in rows.T:
                new[1:] |= column[1:] != column[:-1]
            at = np.flatnonzero(new)
            counts, ends = np.diff(np.append(at, len(order))), np.append(at, len(order))
            places = np.zeros(len(order), dtype=PLACE)
            for c in ("doc", "tag"):
                places[c] = np.repeat(batch.column(c).to_numpy(), n)[order]
            places["place"] = (np.repeat(batch.column("at").to_numpy() - begins, n) + np.arange(len(order)))[order]
            cuts = np.append(np.flatnonzero(cut[at]), len(at))
            pack = Packer([*number])
            blocks = [pack(rows[at[a:b]], counts[a:b], places[ends[a] : ends[b]]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at[cuts[:-1]]]), pa.array(blocks, pa.binary())], names=["bucket", "block"])

    return frags.mapInArrow(run, "bucket bigint, block binary")


class SuffixTree:
    """The suffix tree of suffixes given as rows of word codes (a row that has ended holds codes of its own).

    order sorts the suffixes; shared is how many words each has in common with the one before it. The leaves below a node of
    depth d are a run of suffixes that share d words or more; level(d) gives, for each suffix, the number of its node there.
    """

    def __init__(self, codes: np.ndarray):
        m, self.depth = codes.shape
        least = int(codes.min(initial=0))
        bits = max(1, (int(codes.max(initial=0)) - least).bit_length())
        packed = []  # as many columns in one number as it holds
        for k in range(0, self.depth, max(1, 63 // bits)):
            key = np.zeros(m, dtype=np.int64)
            for column in codes.T[k : k + max(1, 63 // bits)]:
                key = (key << bits) | (column.astype(np.int64) - least)
            packed.append(key)
        self.order = np.lexsort(packed[::-1])
        self.codes = codes[self.order]
        same = self.codes[1:] == self.codes[:-1]
        self.shared = np.concatenate([[-1], np.where(same.all(axis=1), self.depth, (~same).argmax(axis=1))]) if m else np.zeros(0, dtype=np.int64)

    def level(self, d: int) -> np.ndarray:
        node = np.empty(len(self.order), dtype=np.int64)
        node[self.order] = np.cumsum(self.shared < d) - 1
        return node


def coded(keys: list[str], reach: int) -> np.ndarray:
    """Rows of codes of suffixes that are written out, the word before a suffix last."""
    number, out = Numbers({"": 0}), np.zeros((len(keys), reach + 1), dtype=np.int32)
    for row, key in zip(out, keys, strict=True):
        *words, before = number.of(key.split(" "))
        row[: len(words)], row[reach] = words, before
    return out


def repeated(keys: np.ndarray | list[str], owner: np.ndarray, docs: np.ndarray, places: np.ndarray, window: int) -> np.ndarray:
    """For each occurrence (owner: its suffix, docs: its document) how many words from there on are to be removed (0: none)."""
    m, reach = len(keys), window + STEP - 1
    rows = keys if isinstance(keys, np.ndarray) else coded(keys, reach)
    own = -1 - np.arange(m, dtype=rows.dtype)
    left = np.where(rows[:, reach] == 0, own, rows[:, reach])  # the word before a text is like no other,
    sizes = np.count_nonzero(rows[:, :reach], axis=1)
    codes = np.where(rows[:, :reach] == 0, own[:, None], rows[:, :reach])  # and so is what follows where a suffix has ended
    tree = SuffixTree(codes)
    out = np.zeros(len(docs), dtype=np.int64)
    for d in range(window, reach + 1):
        node = tree.level(d)
        of = node[owner]
        size = int(node.max(initial=-1)) + 1
        least = np.full(size, np.iinfo(np.int64).max)
        np.minimum.at(least, of, docs)
        low, high = np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).min)
        np.minimum.at(low, node, left)
        np.maximum.at(high, node, left)
        maximal = (low != high) | (low < 0)
        hit = (docs > least[of]) & (sizes[owner] >= d)
        out[hit] = np.where(maximal[of[hit]] | (places[hit] % STEP == 0), d, 0)  # the deepest node counts
    return out


HITS = "doc bigint, tag bigint, place int, length int"


def hits(places: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    some = length > 0
    own = places[some]
    return pa.RecordBatch.from_arrays([pa.array(own["doc"]), pa.array(own["tag"]), pa.array(own["place"]), pa.array(length[some], pa.int32())], names=["doc", "tag", "place", "length"])


def crowded(found: DataFrame, window: int) -> DataFrame:
    """What trees find, for windows of more suffixes than a group may hold: the nodes from such a window downwards are reduced to
    their smallest documents by partial minima."""

    def cut(batches):
        for batch in batches:
            for block in batch.column("block").to_pylist():
                number, keys, owner, places = unpack([block])
                known, nodes, length, rows = [*number], [], [], []
                for r, key in enumerate(keys[:, :-1].tolist()):
                    words = [known[k] for k in key if k]
                    for d in range(window, len(words) + 1):
                        nodes.append(b" ".join(words[:d]))
                        length.append(d)
                        rows.append(r)
                counts = np.bincount(owner, minlength=len(keys))
                ends = np.concatenate([[0], np.cumsum(counts)])
                low, high = (f.reduceat(places["doc"], ends[:-1])[rows] for f in (np.minimum, np.maximum))
                packed = [places[ends[r] : ends[r + 1]].tobytes() for r in range(len(keys))]
                for k in range(0, len(nodes), 10_000):
                    part = slice(k, k + 10_000)
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[part], pa.binary()), pa.array(length[part], pa.int32()), pa.array(low[part]), pa.array(high[part]), pa.array([packed[r] for r in rows[part]], pa.binary())], names=["node", "length", "low", "high", "places"])

    def mark(batches):
        for batch in pieces(batches, 4_000_000):
            packed = batch.column("places").to_pylist()
            times = [len(x) // PLACE.itemsize for x in packed]
            places = np.frombuffer(b"".join(packed), dtype=PLACE)
            least, length = (np.repeat(batch.column(n).to_numpy(), times) for n in ("least", "length"))
            yield hits(places, np.where(places["doc"] > least, length, 0))

    each = found.select("block").mapInArrow(cut, "node binary, length int, low bigint, high bigint, places binary")
    least = materialise(each.groupBy("node").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most").select("node", "least"), "least")
    return each.join(least, "node").select("length", "least", "places").mapInArrow(mark, HITS)


def repeats(frags: DataFrame, window: int, group_rows: int) -> DataFrame:
    """(doc, tag, found): found has (place, length) of removed ranges of each text that has some."""
    total = frags.agg(F.sum("n")).first()[0] or 0
    most = max(group_rows, -(-total // MOST_SENT))
    heavy = heavy_prefixes(frags, window, most)
    n = max(int(frags.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // most))
    found = suffixes(frags, window, heavy, n)

    def solve(blocks: list[bytes]) -> pa.RecordBatch:
        _, keys, owner, places = unpack(blocks)
        return hits(places, repeated(keys, owner, places["doc"], places["place"], window))

    def run(batches):
        held, last = [], None
        for batch in batches:
            for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block"), strict=True):
                if held and bucket != last:
                    yield solve(held)
                    held = []
                held.append(block.as_buffer())
                last = bucket
        if held:
            yield solve(held)

    out = found.where(F.col("bucket") != CROWDED).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, HITS)
    if heavy[-1][0] == window and len(heavy[-1][1]):
        out = out.union(crowded(found.where(F.col("bucket") == CROWDED), window))
    return out.groupBy("doc", "tag").agg(F.collect_list(F.struct("place", "length")).alias("found"))


def ranges(words: Words, found: pa.ListArray, copy: pa.Array, window: int) -> tuple[list[int], list[int], np.ndarray]:
    """The removed ranges of all texts, in order and apart, as numbers of words, and where each text's ranges begin among them."""
    own = found.flatten()
    of = np.repeat(np.arange(len(found)), pc.fill_null(pc.list_value_length(found), 0).to_numpy())
    place, length = (own.field(n).to_numpy().astype(np.int64) for n in ("place", "length"))
    whole = np.flatnonzero(copy.to_numpy(zero_copy_only=False) & (np.diff(words.first) >= window))
    of = np.concatenate([of, whole])
    start = np.concatenate([words.first[of[: len(place)]] + place, words.first[whole]])
    stop = np.concatenate([start[: len(place)] + length, words.first[whole + 1]])
    order = np.lexsort((start, of))
    of, start, stop = of[order], start[order], np.maximum.accumulate(stop[order])  # no range leaves its text
    new = np.flatnonzero(np.concatenate([[True], (start[1:] > stop[:-1]) | (of[1:] != of[:-1])])[: len(of)])
    return start[new].tolist(), stop[np.append(new[1:], len(of))[: len(new)] - 1].tolist(), np.searchsorted(of[new], np.arange(len(found) + 1))


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", group_rows: int = 100_000, digests: bool = False) -> DataFrame:
    """Removes each word covered by a window of words that also starts in a document with a smaller id.

    Returns id_col, n_words, n_removed and kept (the kept words joined by one space), or with digests=True
    kept_sha256; without digests also spans, the removed word ranges (start, stop exclusive). group_rows is how many
    suffixes a group may hold (or a millionth of all, where that is more); a tree holds the groups of one bucket, about as many. Ids are integers (another type raises TypeError). A null text has no words. A row with a null id has
    no place in the order: it is neither compared nor changed. Rows with the same id are not compared with each
    other, whether they repeat a text or not. Texts shorter than a window stay; an empty table gives no row; other
    columns of docs are ignored.
    """
    rows = prepared(docs, id_col, text_col)
    whole = copies(rows)
    anchored = anchor_table(rows, window)
    noted = notes(rows, anchored, whole)
    discard(anchored)
    frags = fragments(rows, noted, window)
    found = materialise(repeats(frags, window, group_rows).join(noted.where("NOT copy").select("doc", "tag", "c"), ["doc", "tag"]).select("doc", "c", "found"), "repeats")
    discard(frags)
    discard(noted)
    # a copy has no places of its own; all of its windows go
    marks = found.withColumn("copy", F.lit(False)).unionByName(whole.select("doc", "c", F.lit(None).cast("array<struct<place: int, length: int>>").alias("found"), F.lit(True).alias("copy")))
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for batch in pieces(batches, 2_000_000):
            words = Words(texts_of(batch.column("text")))
            starts, stops, begins = ranges(words, batch.column("found"), batch.column("copy"), window)
            every, first, begins = words.raw.split(), words.first.tolist(), begins.tolist()
            gone, kept, spans = [], [], []
            for k, (last, end) in enumerate(zip(first, first[1:])):
                cuts = list(zip(starts[begins[k] : begins[k + 1]], stops[begins[k] : begins[k + 1]], strict=True))
                if not digests:
                    spans.append([{"start": a - last, "stop": b - last} for a, b in cuts])
                left = []
                for a, b in cuts:
                    left += every[last:a]
                    last = b
                left += every[last:end]
                gone.append(end - first[k] - len(left))
                joined = b" ".join(left)
                kept.append(hashlib.sha256(joined).hexdigest() if digests else joined.decode())
            arrays = [batch.column("doc"), pa.array(np.diff(words.first), pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]
            names = [id_col, "n_words", "n_removed", "kept_sha256" if digests else "kept"]
            if not digests:
                arrays.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    result = f"`{id_col}` {kind}, n_words bigint, n_removed bigint, " + ("kept_sha256 string" if digests else "kept string, spans array<struct<start: bigint, stop: bigint>>")
    joined = rows.join(marks, ["doc", "c"], "left")
    return joined.select(F.col("doc").cast(kind).alias("doc"), "text", "found", F.coalesce("copy", F.lit(False)).alias("copy")).mapInArrow(run, result)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), digests=True)


OP5_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
first AS (SELECT w, min(doc_id) AS doc FROM win GROUP BY w HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT win.doc_id, i + k AS p FROM win JOIN first USING (w), (SELECT unnest(range(0, 13)) AS k) WHERE win.doc_id > first.doc),
kept AS (SELECT doc_id, p, ws[p] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p))
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS t FROM kept GROUP BY doc_id) k USING (doc_id)
"""
