"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint's 64 bits are three segments (22, 21 and 21 bits). Three differing bits fall on them in one of these ways:

    two segments equal                    key: both segments, whole
    one segment equal, one off by one     key: the equal segment, and a codeword index of the other
    each segment off by one               key: codeword indices of all three

A segment is a word of the perfect binary [23,12] Golay code's space, so it decodes to one codeword of 12 bits. If two
segments differ in one bit, the codeword of the one is among those that the other's one-bit neighbours decode to: up
to six indices. One bit off also means opposite parity, so one side gives its own index and the other side the
several. Rows that share a key are joined, and the join's condition verifies the distance.

near_copies() looks for texts by the similarity of their shingles. A fingerprint of a whole text tells texts of 0.8 hardly from
others (ten of its bits differ), so each text has several more, each of a small sample of its shingles. Their segments decode to
codeword indices, too; texts that share the indices of a sample are verified by their whole shingle sets.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, documents, materialise, pieces, plain_names
from .graph import components

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
GENERATOR = 0b110001110101  # of the Golay code, as a polynomial over GF(2)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """A bit is set where it is set in over half of the XXH64 hashes of the text's word shingles (A-Z in lower case)."""
    words = _WORDS((text or "").encode("utf-8", "replace").lower())
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=False)], dtype="<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


class Golay:
    """Decodes 23-bit words to the 12-bit index of their one codeword within distance three."""

    def __init__(self):
        remainder = []
        for i in range(23):
            r = 1 << i
            for k in range(i, 10, -1):
                if r >> k & 1:
                    r ^= GENERATOR << (k - 11)
            remainder.append(r)
        table = lambda bits: np.array([np.bitwise_xor.reduce([bits[i] for i in range(len(bits)) if v >> i & 1] or [0]) for v in range(1 << len(bits))], dtype=np.int64)
        self.low, self.high = table(remainder[:12]), table(remainder[12:])
        self.error = np.zeros(2048, dtype=np.int64)
        for i in range(23):
            for j in range(i + 1):
                for k in range(j + 1):
                    e = (1 << i) | (1 << j) | (1 << k)
                    self.error[self.syndrome(np.array([e]))[0]] = e

    def syndrome(self, v: np.ndarray) -> np.ndarray:
        return self.low[v & 4095] ^ self.high[v >> 12]

    def index(self, v: np.ndarray) -> np.ndarray:
        return (v ^ self.error[self.syndrome(v)]) >> 11

    def near(self, v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, index): what the neighbours of each v decode to, each index once for a row."""
        got = np.sort(self.index(v[:, None] ^ (1 << np.arange(bits))[None, :]), axis=1)
        fresh = np.ones(got.shape, dtype=bool)
        fresh[:, 1:] = got[:, 1:] != got[:, :-1]
        rows, at = np.nonzero(fresh)
        return rows, got[rows, at]


def _product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins two (row, value) lists, sorted by row, on the row."""
    start = np.searchsorted(b[0], np.arange(n + 1))
    times = np.diff(start)[a[0]]
    rows = np.repeat(a[0], times)
    offset = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
    return rows, np.repeat(a[1], times), b[1][start[rows] + offset]


def keys(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, side, key) of unsigned 64-bit fingerprints. Two that differ in 1 to 3 bits share a key on opposite sides."""
    n = len(fps)
    seg = [((fps >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    odd = [np.bitwise_count(s).astype(np.int64) & 1 for s in seg]
    own = [golay.index(s) for s in seg]
    near = [golay.near(s, bits) for s, (_, bits) in zip(seg, SEGMENTS, strict=True)]
    every = np.arange(n)
    out = []

    def add(form, rows, side, value):
        out.append((rows, np.broadcast_to(side, rows.shape), value | (form << 58)))

    for form, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        for side in (0, 1):
            add(form, every, side, seg[i] << 22 | seg[j])
    form = 3
    for i in range(3):
        for j in range(3):
            if i == j:
                continue
            even = np.flatnonzero(odd[j] == 0)
            add(form, even, 0, seg[i][even] << 12 | own[j][even])
            rows, index = near[j]
            pick = odd[j][rows] == 1
            add(form, rows[pick], 1, seg[i][rows[pick]] << 12 | index[pick])
            form += 1
    pick = odd[0][near[1][0]] == 0
    rows, index = near[1][0][pick], near[1][1][pick]
    add(9, rows, 0, odd[1][rows] << 37 | odd[2][rows] << 36 | own[0][rows] << 24 | index << 12 | own[2][rows])
    rows, a, c = _product(near[0], near[2], n)
    pick = odd[0][rows] == 1
    rows, a, c = rows[pick], a[pick], c[pick]
    add(9, rows, 1, (1 - odd[1][rows]) << 37 | (1 - odd[2][rows]) << 36 | a << 24 | own[1][rows] << 12 | c)
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def fingerprints(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """The columns of docs and fp, the fingerprint as a signed 64-bit number; texts stay whole."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in pieces(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(at).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.int64())], names=[*names, "lakemill_fp"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lakemill_fp", T.LongType())]))


def links(fps: DataFrame) -> DataFrame:
    """(a, b): all pairs of the distinct fingerprints of column fp that differ in 1 to 3 bits, a < b, each once."""

    def run(batches):
        golay = Golay()
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                rows, side, key = keys(some.view(np.uint64), golay)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(side.astype(np.int8), pa.int8()), pa.array(some[rows], pa.int64())], names=["key", "side", "fp"])

    keyed = materialise(fps.select("fp").mapInArrow(run, "key bigint, side tinyint, fp bigint"), "keys")
    left = keyed.where("side = 0").select("key", F.col("fp").alias("a"))
    right = keyed.where("side = 1").select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    once = (F.col("key") >= 3 << 58) | (F.col("a") < F.col("b"))
    pairs = left.join(right, "key").where((near >= 1) & (near <= 3) & once)
    found = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    discard(keyed)
    return found


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, carry: list[str] | None = None) -> DataFrame:
    """The columns of docs named in carry (all by default), lakemill_fp, lakemill_first and lakemill_component.

    Documents whose fingerprints differ in at most three bits are linked, and so is what links reach; component is
    the smallest id of a group, and first marks its one row to keep. Equal fingerprints are one node, so a
    group of copies is never expanded. A null or wordless text has fingerprint 0 and is linked like any other;
    a null id sorts after all others; repeated rows fall into one group; an empty table gives no row.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if not c.startswith("lakemill_")]
    rows = fingerprints(docs.select(*dict.fromkeys([*carry, id_col, text_col])), text_col, shingle)
    rows = materialise(rows.select(*dict.fromkeys([*carry, id_col]), "lakemill_fp", F.monotonically_increasing_id().alias("lakemill_uid")), "fingerprints")
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("lakemill_uid").alias("uid"))
    nodes = materialise(rows.groupBy(F.col("lakemill_fp").alias("fp")).agg(F.min(place).alias("first")), "nodes")
    roots = components(links(nodes)).select(F.col("node").alias("fp"), "root")
    labelled = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = labelled.groupBy("root").agg(F.min("first").alias("first"))
    of_fp = labelled.select("fp", "root").join(firsts, "root").select(F.col("fp").alias("lakemill_fp"), F.col("first").alias("lakemill_least"))
    out = rows.join(of_fp, "lakemill_fp")
    return out.select(*carry, "lakemill_fp", (F.col("lakemill_least.uid") == F.col("lakemill_uid")).alias("lakemill_first"), F.col("lakemill_least.id").alias("lakemill_component"))


#: A text's further fingerprints: how many, and of how many shingles each.
SAMPLES, SAMPLE = 6, 3
#: Texts in an Arrow batch.
TEXTS = 1000
#: Parts that the texts of one key are dealt to, and pairs of one text that are verified together.
SALTS, MOST_PAIRS = 16, 1000
#: A set's parities: 2 to the power of PARITY_BITS bits, in so many words of 64.
PARITY_BITS = 10
PARITIES = (1 << PARITY_BITS) // 64
#: Shingles before one of a prefix that are looked at for an earlier one in common.
BEFORE = 8


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """The distinct XXH64 hashes of the text's word shingles (A-Z in lower case); of all words where they are fewer, of none where there is none."""
    words = _WORDS((text or "").encode("utf-8", "replace").lower())
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], seed) for a, b in zip((ends - lengths).tolist(), ends[shingle - 1 :].tolist(), strict=False)], dtype=np.uint64))


def sample_prints(hashes: np.ndarray) -> list[int]:
    """Fingerprints of samples: a sample holds the shingles whose hashes come first in one of SAMPLES orders, so texts that share most
    of their shingles have most of their samples in common."""
    out = []
    for k in range(SAMPLES):
        order = hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))  # a step of splitmix64
        order = (order ^ (order >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        order = (order ^ (order >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        order ^= order >> np.uint64(31)
        own = (hashes[np.argpartition(order, SAMPLE - 1)[:SAMPLE]] if len(hashes) > SAMPLE else hashes).tolist()
        if len(own) == 3:  # a bit that two of three have
            a, b, c = own
            out.append(a & b | a & c | b & c)
        else:  # a bit that all have: of two, that is over half
            out.append(reduce(and_, own) if own else 0)
    return out


def sample_keys(prints: np.ndarray, golay: Golay) -> np.ndarray:
    """A key for each of a text's sample fingerprints (one row for a text): the codeword indices of its three segments, and which sample it is."""
    key = np.broadcast_to(np.arange(prints.shape[1], dtype=np.int64) << 36, prints.shape).copy()
    for k, (at, bits) in enumerate(SEGMENTS):
        segment = ((prints >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        key |= golay.index(segment.ravel()).reshape(prints.shape) << (12 * k)
    return key


def keyed_groups(nodes: DataFrame) -> DataFrame:
    """(u, key, top): the texts that share a key with another one, and the key's smallest text. nodes: node, fp and keys. Texts of a key
    are dealt to SALTS parts, which keep a hot key from landing in one task."""
    keyed = nodes.select(F.col("node").alias("u"), F.explode(F.concat("keys", F.array(F.col("fp").bitwiseOR(F.lit(-(1 << 63)))))).alias("key"))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("tinyint"))
    parts = materialise(keyed.groupBy("key", "salt").agg(F.min("u").alias("lo"), F.count("*").alias("n")), "key-parts")
    tops = parts.groupBy("key").agg(F.min("lo").alias("top"), F.sum("n").alias("n")).where("n > 1").drop("n")
    members = materialise(keyed.join(parts.join(tops, "key").select("key", "salt", "top"), ["key", "salt"]).select("u", "key", "top"), "members")
    discard(parts)
    return members


def similar(nodes: DataFrame, members: DataFrame, near: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(u, v): verified links, enough of them that any two similar texts of one key, or of whole fingerprints within a few bits, are in one component.

    Each text is compared with the smallest text of each of its keys and of its shingle set, and the smallest of each fingerprint with those of near ones. Where
    a key's texts (or those of two near fingerprints) are then in several components, all of these texts go to rest_links()."""
    first = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    close = near.join(first.select(F.col("fp").alias("a"), F.col("node").alias("u")), "a").join(first.select(F.col("fp").alias("b"), F.col("node").alias("v")), "b").select("u", "v")
    digests = sets.select("node", F.xxhash64("hashes").alias("digest"))
    equal = digests.select(F.col("node").alias("u"), "digest").join(digests.groupBy("digest").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1"), "digest").select("u", "v")
    asked = materialise(members.select("u", F.col("top").alias("v")).union(close).union(equal).where("u <> v").distinct(), "asked")
    found = materialise(verified(asked, sets, least), "similar", advisory="16m")
    discard(asked)
    rooted = sets.select("node").join(components(found), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    rooted = materialise(rooted, "rooted")
    of_key = members.join(rooted, members["u"] == rooted["node"]).select("u", "key", "root")
    mixed = of_key.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    of_fp = nodes.select("node", "fp").join(rooted, "node").groupBy("fp").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    ends = near.join(of_fp.select(F.col("fp").alias("a"), F.col("lo").alias("la"), F.col("hi").alias("ha")), "a").join(of_fp.select(F.col("fp").alias("b"), F.col("lo").alias("lb"), F.col("hi").alias("hb")), "b")
    apart = ends.where("least(la, lb) <> greatest(ha, hb)").select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    rest = of_key.join(mixed, "key", "left_semi").select(F.col("u").alias("node")).union(nodes.join(apart, "fp", "left_semi").select("node")).distinct()
    rest = materialise(rest.join(rooted, "node"), "rest")
    return found.union(rest_links(rest, sets, least))


def parities(hashes: np.ndarray) -> np.ndarray:
    """PARITIES words of 64 bits: a bit tells whether the hashes that fall on it are odd in number. Two sets differ in as many elements as these bits or in more."""
    odd = np.bincount((hashes >> np.uint64(64 - PARITY_BITS)).astype(np.int64), minlength=1 << PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def rest_links(rest: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(u, v): all links between texts of different roots. rest: node, root; exact, by the filters of prefixes and of parities.

    Order all shingles by the number of roots that have them. Two sets that are similar enough share a shingle among the first
    n - ceil(least n) + 1 of each, and the first one that they share leaves enough behind it in both. A shingle of one root only gives no pair, so
    it is counted but not sent. Similar sets differ in few elements, and so in few parities: the join by shingles gives a pair only
    where its sizes, what is left and the parities allow the similarity, so texts of one frame that share less than least don't become rows.
    A pair whose last BEFORE shingles before this one have one in common was given there, where more was left.
    """
    roots = materialise(rest.select("root").distinct().withColumn("r", F.monotonically_increasing_id()), "roots")
    rest = materialise(rest.join(roots, "root").select("node", "r", F.monotonically_increasing_id().alias("k")), "rest")
    bits = [f"bits{i}" for i in range(PARITIES)]

    def run(batches):
        for batch in pieces(batches):
            if batch.num_rows:
                each = np.array([parities(np.asarray(h, dtype=np.int64).view(np.uint64)) for h in batch.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(each[:, i])) for i in range(PARITIES))], names=["k", "r", "hashes", *bits])

    held = materialise(sets.join(rest, "node").select("k", "r", "hashes").mapInArrow(run, "k bigint, r bigint, hashes array<bigint>, " + ", ".join(f"{c} bigint" for c in bits)), "parities", batch_rows=TEXTS)
    words = held.select("k", "r", F.size("hashes").alias("n"), F.explode("hashes").alias("h"))
    common = words.select("h", "r").distinct().groupBy("h").agg(F.count("*").alias("roots")).where("roots > 1")
    sorted_ = words.join(common, "h").groupBy("k", "n").agg(F.sort_array(F.collect_list(F.struct("roots", "h"))).alias("s")).withColumn("own", F.col("n") - F.size("s"))
    first = sorted_.withColumn("m", (F.col("n") - F.ceil(F.col("n") * least - 1e-6) + 1 - F.col("own")).cast("int")).where("m > 0")
    first = first.select("k", "n", "own", F.col("s.h").alias("hs"), F.posexplode(F.slice("s.h", F.lit(1), F.col("m"))).alias("at", "h"))
    before = F.slice("hs", F.greatest(F.lit(1), F.col("at") - (BEFORE - 1)), F.least("at", F.lit(BEFORE)))
    first = first.select("k", "n", "h", before.alias("before"), (F.col("n") - F.col("own") - F.col("at")).alias("left"))
    first = materialise(first.join(held.select("k", "r", *bits), "k"), "prefixes")
    x, y = (first.select("h", *(F.col(c).alias(f"{c}_{side}") for c in ["k", "r", "n", "left", "before", *bits])) for side in "xy")
    n = F.col("n_x") + F.col("n_y")
    enough = F.least("left_x", "left_y") >= n * (least / (1 + least)) - 1e-6
    sizes = (F.col("n_x") >= F.col("n_y") * least - 1e-6) & (F.col("n_y") >= F.col("n_x") * least - 1e-6)
    differ = reduce(add, (F.bit_count(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y"))) for c in bits))
    met = x.join(y, (x["h"] == y["h"]) & (F.col("r_x") < F.col("r_y")) & sizes & enough & (differ <= n * ((1 - least) / (1 + least)) + 1e-6) & ~F.arrays_overlap("before_x", "before_y"))
    pairs = met.select(F.col("k_x").alias("k1"), F.col("k_y").alias("k2")).distinct()
    named = pairs.join(rest.select(F.col("k").alias("k1"), F.col("node").alias("u")), "k1").join(rest.select(F.col("k").alias("k2"), F.col("node").alias("v")), "k2").select("u", "v")
    asked = materialise(named, "asked")
    discard(first, held)
    found = materialise(verified(asked, sets, least), "similar", advisory="16m")
    discard(asked)
    return found


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have a Jaccard similarity of least or more. A v with many pairs is repeated for parts of them."""
    crowd = materialise(pairs.groupBy("v").agg(F.ceil(F.count("*") / MOST_PAIRS).cast("int").alias("parts")).where("parts > 1"), "crowd")
    left = pairs.join(crowd, "v", "left").select("u", "v", F.pmod(F.xxhash64("u"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    left = left.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("x")), "u")
    right = sets.select(F.col("node").alias("v"), F.col("hashes").alias("y")).join(crowd, "v", "left").select("v", "y", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    both = F.size(F.array_intersect("x", "y"))
    return left.join(right, ["v", "part"]).where(both >= least * (F.size("x") + F.size("y") - both)).select("u", "v")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """id_col, node (the text's MD5) and first_id, first_node: the member of the row's group that stays.

    Texts are linked if their sets of word shingles have a Jaccard similarity of least or more; groups are what links reach.
    Fingerprints of whole texts within three bits and equal keys of sample fingerprints give the candidates, all of which are compared
    or in one group by way of others (see similar()). All links found are true ones. A pair at 0.8 shares no key with a probability of about 2 % (1 - 0.8^3 for each
    sample). Equal texts are one node; texts without a word are alike;
    a null text counts as empty. A null id sorts after all others; an empty table gives no row.
    """
    kind = docs.schema[id_col].dataType
    given = docs.select(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("node"), F.col(text_col).alias("text"))

    def run(batches):
        golay = Golay()
        for batch in pieces(batches):
            if not batch.num_rows:
                continue
            texts = batch.column(2).to_pylist()
            hashes = [shingle_hashes(t, shingle) for t in texts]
            prints = np.array([sample_prints(h) for h in hashes], dtype=np.uint64)
            whole = np.array([majority(h) if len(h) else 0 for h in hashes], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(whole), pa.array(list(sample_keys(prints, golay)), pa.list_(pa.int64()))], names=["id", "node", "fp", "keys"])

    fields = [("id", kind), ("node", T.StringType()), ("fp", T.LongType()), ("keys", T.ArrayType(T.LongType()))]
    rows = materialise(given.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields])), "prints", batch_rows=TEXTS)
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("node").alias("node"))
    nodes = materialise(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.min(place).alias("first")), "nodes")
    members = keyed_groups(nodes)
    near = links(nodes.select("fp").distinct())
    same = near.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    involved = members.select(F.col("u").alias("node")).union(nodes.join(same, "fp", "left_semi").select("node")).distinct()

    def hashed(batches):
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_hashes(t, shingle).view(np.int64) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["node", "hashes"])

    # the first row of a text stands for all of its copies; where that row is repeated, any of them does
    wanted = nodes.join(involved, "node").select("node", F.col("first.id").alias("id"))
    texts = given.join(wanted, (given["node"] == wanted["node"]) & given["id"].eqNullSafe(wanted["id"]), "left_semi").select("node", "text").dropDuplicates(["node"])
    sets = materialise(texts.mapInArrow(hashed, "node string, hashes array<bigint>"), "shingles", advisory="16m", batch_rows=TEXTS)
    roots = components(similar(nodes, members, near, sets, least)).withColumnRenamed("root", "r")
    grouped = nodes.select("node", "first").join(roots, "node", "left").withColumn("r", F.coalesce("r", "node"))
    firsts = materialise(grouped.groupBy("r").agg(F.min("first").alias("stays")), "firsts")
    discard(sets, members)
    of_node = grouped.join(firsts, "r").select("node", F.col("stays.id").alias("first_id"), F.col("stays.node").alias("first_node"))
    return rows.select(F.col("id").alias(id_col), "node").join(of_node, "node")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each group of near_copies(): that with the smallest id, of equal ids that with the smallest MD5 of its text, of equal
    texts any. The columns of docs, whatever their names."""
    rows, name, back = plain_names(docs)
    found = near_copies(rows, name[id_col], name[text_col], shingle, least)
    stay = materialise(found.select(F.col("first_id").alias("stay_id"), F.col("first_node").alias("stay_node")).distinct(), "stay")
    rows = rows.withColumn("node", F.md5(F.coalesce(F.col(name[text_col]), F.lit(""))))
    kept = rows.join(stay, (F.col("node") == F.col("stay_node")) & F.col(name[id_col]).eqNullSafe(F.col("stay_id")), "left_semi")
    return back(kept.dropDuplicates([name[id_col], "node"]))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = group(documents(spark, sf_dir), carry=["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("lakemill_fp"), 16, "0")).alias("fingerprint"), F.col("lakemill_component").alias("component_id"))
