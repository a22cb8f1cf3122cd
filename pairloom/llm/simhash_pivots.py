"""Near copies by SimHash fingerprints, found through tables of distances to reference fingerprints (pivots).

For a metric, |d(x, p) - d(y, p)| <= d(x, y) for every pivot p. The pivots here come in families: the members of a family differ
from a base pivot only inside one set of bits, so that d(x, p) - d(x, base) depends on those bits alone. Two fingerprints that
agree on the set have equal coordinates for the whole family (their difference is bounded by 0); the equal coordinates of
families are the key under which fingerprints meet. Among those that meet, pairs whose largest coordinate difference over all
pivots exceeds the radius are discarded, and the rest are verified by their Hamming distance.

* ``exact_families``: the 64 bits in 4 blocks; a pair within 2 bits leaves at least two blocks untouched, so the 6 pairs of blocks
  find every such pair.
* ``sampled_families``: seeded sets of bits for wider radii, where no small exact cover exists; each set finds a pair that differs
  in a share q of its bits with probability (1 - q) ** size.

A key shared by more than ``HOT`` different fingerprints: with exact families it is dealt out again on the bits that it leaves open,
by the same rule, until a bucket is small (after three levels it holds 256 fingerprints at most); with sampled ones its members are
dealt into blocks, and each pair of blocks is a key. No pair that shares a key is lost either way. A bucket returns spanning links
of its linked members, not its pairs. Where the shingles decide (``verified_components``), such links only say which documents have
to be compared: the sets of shingles go once to the group that holds them, and no pair of sets is ever a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import SPACES, parallelism
from pairloom.llm.components import components
from pairloom.session import pinned

#: Fingerprints of one bucket that a task compares; a larger bucket is dealt out again.
HOT = 20_000
#: Shingles that a task compares with each other; a larger group of candidates is dealt to pairs of blocks.
HOT_SHINGLES = 1 << 18
#: Buckets up to this size are compared all at once, a distance of rows at a time.
SMALL = 64
PIVOTS_A_BLOCK = 12
FREE_PIVOTS = 16
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SPACE = str.maketrans(SPACES, " " * len(SPACES))
_CHUNK = 1 << 15


def _mix(h: np.ndarray, lane: int) -> np.ndarray:
    """Another 64 bits from each hash for the lanes after the first."""
    if lane == 0:
        return h
    z = h + np.uint64((0x9E3779B97F4A7C15 * lane) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a text, in order and in chunks; nothing for a wordless one."""
    words = [w for w in (text or "").translate(_LOWER).translate(_SPACE).split(" ") if w]
    if not words:
        return
    flat = " ".join(words).encode("utf-8", "surrogatepass")
    spaces = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts, ends = np.append(0, spaces + 1), np.append(spaces, len(flat))
    k = min(shingle, len(words))
    begin, end = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(begin), _CHUNK):
        yield np.array([digest(flat[a:b], 42) for a, b in zip(begin[at : at + _CHUNK], end[at : at + _CHUNK])], np.uint64)


def _majority(hashes: Iterable[np.ndarray], lanes: int) -> list[int]:
    ones, n = np.zeros((lanes, 64), np.int64), 0
    for h in hashes:
        n += len(h)
        for lane in range(lanes):
            bits = np.unpackbits(_mix(h, lane).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones[lane] += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(ones * 2 > n, axis=1)
    return [int.from_bytes(row.tobytes(), "big") for row in packed]


def fingerprint(text: str | None, shingle: int = 3, lanes: int = 1) -> list[int]:
    """``lanes`` words of 64 bits; a bit is 1 where it is set in over half the hashes of the shingles."""
    return _majority(_hashes(text, shingle), lanes)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted different hashes of the shingles of a text."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *_hashes(text, shingle)]))


def fingerprints(docs: DataFrame, shingle: int = 3, lanes: int = 1) -> DataFrame:
    """(doc_id, text) -> (doc_id, words): the fingerprint as ``lanes`` signed longs. Null and wordless texts have zeros."""

    @F.pandas_udf("array<bigint>")
    def words_of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(fingerprint(t, shingle, lanes), np.uint64).view(np.int64) for t in texts])

    return docs.select("doc_id", words_of(F.col("text")).alias("words"))


def set_fingerprints(docs: DataFrame, shingle: int, lanes: int) -> DataFrame:
    """(doc_id, text) -> (doc_id, node, words): a hash of the set of shingles, and the fingerprint of that set, in which a repeated
    shingle counts once, as it does in the Jaccard similarity."""

    @F.pandas_udf("array<bigint>")
    def of_set(texts: pd.Series) -> pd.Series:
        sets = (shingle_set(t, shingle) for t in texts)
        return pd.Series([np.array([xxhash.xxh64_intdigest(s.tobytes(), 42), *_majority(_chunks(s), lanes)], np.uint64).view(np.int64) for s in sets])

    found = docs.select("doc_id", of_set(F.col("text")).alias("found"))
    return found.select("doc_id", F.col("found")[0].alias("node"), F.slice("found", 2, lanes).alias("words"))


def _chunks(hashes: np.ndarray) -> Iterator[np.ndarray]:
    return (hashes[at : at + _CHUNK] for at in range(0, len(hashes), _CHUNK))


class Families:
    """Sets of bits (one a family group of pivots), and the pivots that see them."""

    def __init__(self, lanes: int, sets: list[np.ndarray], radius: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.lanes, self.radius, self.sets = lanes, radius, sets
        self.base = rng.integers(0, 1 << 64, lanes, np.uint64)
        self.pivots = []
        for bits in sets:
            flips = rng.integers(0, 2, (max(PIVOTS_A_BLOCK, len(bits) - 4), len(bits))).astype(bool)
            self.pivots.append(np.stack([self.base ^ _mask(bits[f], lanes) for f in flips]))
        self.free = rng.integers(0, 1 << 64, (FREE_PIVOTS, lanes), np.uint64)

    def coordinates(self, fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        """Distances (fingerprints x pivots) to reference fingerprints."""
        return np.bitwise_count(fps[:, None, :] ^ pivots[None, :, :]).sum(axis=2, dtype=np.int16)

    def keys(self, fps: np.ndarray) -> np.ndarray:
        """One hash a family (fingerprints x families) of its coordinates relative to the base pivot."""
        base = self.coordinates(fps, self.base[None, :])
        out = np.empty((len(fps), len(self.pivots)), np.int64)
        for j, pivots in enumerate(self.pivots):
            rel = (self.coordinates(fps, pivots) - base).astype(np.uint64)
            h = np.full(len(fps), j + 1, np.uint64)
            for c in range(rel.shape[1]):
                h = (h ^ rel[:, c]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out[:, j] = h.view(np.int64)
        return out


def _mask(bits: np.ndarray, lanes: int) -> np.ndarray:
    out = np.zeros(lanes, np.uint64)
    for b in bits:
        out[b // 64] |= np.uint64(1 << int(b % 64))
    return out


def exact_families(level: int = 0) -> list[Families]:
    """Families for a radius of 2 on 64 bits. Level 0: pairs of four 16-bit blocks. Each further level splits what a pair leaves
    open into four and pairs those, so its sets also hold the bits already agreed."""
    done = [(np.array([], int), np.arange(64))]
    for _ in range(level + 1):
        split = []
        for fixed, open_bits in done:
            blocks = np.array_split(open_bits, 4)
            for pair in combinations(range(4), 2):
                split.append((np.concatenate([fixed, *[blocks[i] for i in pair]]), np.concatenate([blocks[i] for i in range(4) if i not in pair])))
        done = split
    return [Families(1, [fixed for fixed, _ in done], 2)]


def sampled_families(lanes: int, size: int, count: int, radius: int, seed: int = 11) -> list[Families]:
    rng = np.random.default_rng(seed)
    return [Families(lanes, [np.sort(rng.choice(64 * lanes, size, replace=False)) for _ in range(count)], radius)]


def _spanning(fps: np.ndarray, families: Families) -> list[tuple[int, int]]:
    """Links (member, member) that connect what is linked within the radius in one bucket.

    A leader takes every unassigned fingerprint within the radius; then clusters that no link joins yet are compared in full.
    """
    n, links = len(fps), []
    owner, leaders = np.full(n, -1), np.zeros(n, bool)
    for i in range(n):
        if owner[i] < 0:
            near = np.flatnonzero((owner < 0) & (np.bitwise_count(fps ^ fps[i]).sum(axis=1) <= families.radius))
            owner[near], leaders[i] = i, True
            links += [(i, int(j)) for j in near if j != i]
    if leaders.sum() > 1 and not leaders.all():
        # leaders have met whoever was free; what is left to compare are the others, with members of clusters not yet joined
        table = families.coordinates(fps, families.free)
        for i in np.flatnonzero(~leaders):
            rest = np.flatnonzero(owner != owner[i])
            if not len(rest):
                break
            rest = rest[np.abs(table[rest] - table[i]).max(axis=1) <= families.radius]
            for j in rest[np.bitwise_count(fps[rest] ^ fps[i]).sum(axis=1) <= families.radius]:
                if owner[j] != owner[i]:
                    links.append((int(i), int(j)))
                    owner[owner == owner[j]] = owner[i]
    return links


def _across(fps: np.ndarray, root: np.ndarray, families: Families) -> Iterator[tuple[int, np.ndarray]]:
    """(member, later members of other roots within the radius) of one bucket: every such pair, not only spanning ones."""
    for i in range(len(fps) - 1):
        near = np.flatnonzero((root[i + 1 :] != root[i]) & (np.bitwise_count(fps[i + 1 :] ^ fps[i]).sum(axis=1) <= families.radius))
        if len(near):
            yield i, near + i + 1


def _close(fps: np.ndarray, at: np.ndarray, left: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all pairs of rows within the radius; row ``at`` is compared with the ``left`` rows that follow it."""
    for d in range(1, SMALL):
        at, left = at[left >= d], left[left >= d]
        if not len(at):
            return
        near = at[np.bitwise_count(fps[at] ^ fps[at + d]).sum(axis=1) <= radius]
        if len(near):
            yield near, near + d


def _forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which of the links (u, v) join what the links before them do not."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    joins = np.zeros(len(u), bool)
    for k, (i, j) in enumerate(zip(u.tolist(), v.tolist())):
        i, j = top(i), top(j)
        if i != j:
            above[j] = i
            joins[k] = True
    return joins


def _links_of_buckets(families: Families) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows sorted by key -> spanning links, or all pairs of different roots if the rows have roots. Small buckets are compared all
    at once, larger ones one by one."""

    def linked(key: np.ndarray, node: np.ndarray, fps: np.ndarray, root: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(cut, len(key)))
        left = np.repeat(cut + size, size) - np.arange(len(key)) - 1
        found = list(_close(fps, *(x[np.repeat(size <= SMALL, size)] for x in (np.arange(len(key)), left)), families.radius))
        i, j = (np.concatenate([np.empty(0, int), *x]) for x in (zip(*found) if found else ((), ())))
        good = _forest(i, j) if root is None else root[i] != root[j]
        u, v, held = [node[i[good]]], [node[j[good]]], 0
        for at, n in zip(cut[size > SMALL], size[size > SMALL]):
            if root is None:
                pairs = _spanning(fps[at : at + n], families)
                if pairs:
                    a, b = np.array(pairs).T + at
                    u.append(node[a])
                    v.append(node[b])
                continue
            for i, others in _across(fps[at : at + n], root[at : at + n], families):
                u.append(np.full(len(others), node[at + i]))
                v.append(node[at + others])
                held += len(others)
                if held > _CHUNK:
                    yield pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)})
                    u, v, held = [node[:0]], [node[:0]], 0
        yield pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            fps = np.ascontiguousarray(pdf[[f"w{i}" for i in range(families.lanes)]].to_numpy(np.int64)).view(np.uint64)
            rows = [pdf["key"].to_numpy(), pdf["node"].to_numpy(), fps] + ([pdf["root"].to_numpy()] if "root" in pdf else [])
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows)]
            if not len(rows[0]):
                continue
            last = np.searchsorted(rows[0], rows[0][-1])
            if last:
                yield from linked(*[x[:last] for x in rows])
            rest = [x[last:] for x in rows]
        if rest is not None:
            yield from linked(*rest)

    return run


def _keyed(nodes: DataFrame, families: Families) -> DataFrame:
    @F.pandas_udf("array<bigint>")
    def keys(words: pd.Series) -> pd.Series:
        return pd.Series(list(families.keys(np.stack(words.to_numpy()).view(np.uint64)))) if len(words) else pd.Series([], dtype=object)

    return nodes.select(*nodes.columns, F.explode(keys("words")).alias("key"))


def _in_blocks(keyed: DataFrame, hot: int, weight: Column | None = None, rows: int | None = None) -> DataFrame:
    """Keys of more than ``hot`` rows (or weight) are replaced by one key for each pair of blocks of about half as much, so that every
    pair of rows of a key still meets under one. ``rows``: how many rows there are, none of which weighs more than another; then only
    keys are counted whose remainder has more than ``hot`` rows, as no other can."""
    counted = keyed
    if rows is not None:
        if rows <= hot:
            return keyed
        rest = F.pmod("key", F.lit(4 * rows // hot))
        heavy = pinned(keyed.groupBy(rest.alias("rest")).count().filter(F.col("count") > hot).select("rest"))
        if not heavy.limit(1).count():
            return keyed
        counted = keyed.withColumn("rest", rest).join(heavy, "rest", "left_semi")
    total = counted.groupBy("key").agg((F.count("*") if weight is None else F.sum(weight)).alias("total"))
    crowded = pinned(total.filter(F.col("total") > hot).select("key", F.ceil(F.col("total") * 2 / hot).cast("int").alias("blocks")))
    if not crowded.limit(1).count():
        return keyed
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("block"))
    pairs = F.transform(others, lambda j: F.xxhash64("key", F.least(j, "block"), F.greatest(j, "block")))
    dealt = keyed.join(crowded, "key", "left").withColumn("block", block).withColumn("pairs", F.when(F.col("blocks").isNull(), F.array("key")).otherwise(pairs))
    return dealt.select(*[c for c in keyed.columns if c != "key"], F.explode("pairs").alias("key"))


def links(nodes: DataFrame, levels: list[Families], hot: int = HOT) -> DataFrame:
    """(node long, words) with different nodes -> (u, v): spanning links within the radius; with a column root, all pairs of different
    roots within it. ``levels``: families by level; a bucket over ``hot`` goes to the next level, which has to find every pair that
    it holds, and on the last level to pairs of blocks."""
    found = None
    columns = nodes.columns
    n = parallelism(nodes.sparkSession)
    for level, families in enumerate(levels):
        # a table of nodes is a few files, and its keys many times as much
        keyed = _keyed(nodes.repartition(n, "node"), families)
        if level + 1 < len(levels):
            keyed = pinned(keyed)
            crowded = pinned(keyed.groupBy("key").count().filter(F.col("count") > hot).select("key"))
            again = crowded.limit(1).count() > 0
            small = keyed.join(crowded, "key", "left_anti") if again else keyed
        else:
            again, small = False, _in_blocks(keyed, hot, rows=nodes.count() * len(families.sets))
        narrow = small.select("key", *[c for c in columns if c != "words"], *[F.col("words")[i].alias(f"w{i}") for i in range(families.lanes)])
        out = narrow.repartition(n, "key").sortWithinPartitions("key", "node").mapInPandas(_links_of_buckets(families), "u long, v long")
        found = out if found is None else found.unionAll(out)
        if not again:
            break
        nodes = pinned(keyed.join(crowded, "key", "left_semi").select(*columns).distinct())
    return found


def exact_levels() -> list[Families]:
    return [exact_families(level)[0] for level in range(3)]


def near_components(prints: DataFrame, levels: list[Families], hot: int = HOT) -> DataFrame:
    """(doc_id, words) -> (doc_id, words, component_id): documents whose fingerprints are linked, directly or over others.

    Equal fingerprints meet once, as one node; component_id is the smallest doc_id of the component (null ids are passed over,
    so it is null only where a component has no other).
    """
    prints = pinned(prints)
    nodes = pinned(prints.groupBy("words").agg(F.min("doc_id").alias("least")).withColumn("node", _node(F.col("words"), levels[0].lanes)))
    roots = pinned(components(links(nodes.select("node", "words"), levels, hot)))
    grown = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grown.groupBy("root").agg(F.min("least").alias("component_id"))
    of_words = grown.join(least, "root").select("words", "component_id")
    return prints.join(of_words, "words").select("doc_id", "words", "component_id")


def _node(words: Column, lanes: int) -> Column:
    """A fingerprint of one word is its own node id; a longer one is hashed."""
    return words[0] if lanes == 1 else F.xxhash64(words)


def hex_of(words: Column) -> Column:
    return F.lower(F.lpad(F.hex(words[0]), 16, "0"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, fingerprint, component_id): 3-word shingles, links at 2 or fewer differing bits.

    Null, empty and wordless texts have fingerprint 0 and are linked like any other. Repeated rows come back as often as they
    came. Other columns are ignored; an empty table gives an empty one.
    """
    out = near_components(fingerprints(docs), exact_levels())
    return out.select("doc_id", hex_of(F.col("words")).alias("fingerprint"), "component_id")


#: Wide search: 256 bits of 5-word shingles. Texts with a similarity of 0.8 differ in about 39 of 256 bits; the radius and the sets
#: find them as candidates with a probability of 0.998, and the shingles themselves decide.
WIDE = {"shingle": 5, "lanes": 4, "size": 14, "count": 96, "radius": 60}


def widened(nodes: int, size: int, count: int) -> tuple[int, int]:
    """(bits of a set, sets) for so many different fingerprints: beyond 256 to a key on average every doubling adds a bit, and a
    quarter more sets, which make up for the pairs that a further bit parts (those that differ in a fifth of their bits)."""
    more = max(0, nodes.bit_length() - 8 - size)
    return size + more, -int(-count * 1.25**more // 1)


def _sets(docs: DataFrame, least: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text), (doc_id, node, key) -> (node, key, set of shingle hashes). A repeated id may have several texts; each goes by
    its node."""

    @F.pandas_udf("array<bigint>")
    def set_of(texts: pd.Series) -> pd.Series:
        sets = (shingle_set(t, shingle) for t in texts)
        return pd.Series([np.append(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 42)), s).view(np.int64) for s in sets])

    set_of = set_of.asNondeterministic()  # else the join's filter on the node pulls it in front of the semi join, to all texts
    found = docs.join(least.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", set_of(F.col("text")).alias("found"))
    sets = found.select(F.col("found")[0].alias("node"), F.slice("found", 2, F.size("found")).alias("set")).dropDuplicates(["node"])
    return sets.join(least, "node").select("node", "key", "set")  # by node as well, so the sets are not shuffled again


def _alike(group: pd.DataFrame) -> pd.DataFrame:
    """(node, set) of a group -> spanning links of a Jaccard similarity of 0.8 or more, in whole numbers. All pairs are compared: the
    members that hold a shingle are listed, and the lists of the shingles of a member count what it shares with every other."""
    node, sets = group["node"].to_numpy(), group["set"].to_numpy()
    n, size = len(node), np.fromiter((len(s) for s in sets), np.int64, len(sets))
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[code] > 1
    code, member = code[shared], np.repeat(np.arange(n), size)[shared]
    holders, first = member[np.argsort(code, kind="stable")], np.cumsum(np.where(often > 1, often, 0)) - often
    ends = np.searchsorted(member, np.arange(n + 1))
    owner, links = np.arange(n), []
    for i in range(n - 1):
        own = code[ends[i] : ends[i + 1]]
        many = often[own]
        at = np.repeat(first[own] - np.cumsum(many) + many, many) + np.arange(many.sum())
        both = np.bincount(holders[at], minlength=n)[i + 1 :]
        for j in np.flatnonzero(both * 9 >= (size[i] + size[i + 1 :]) * 4) + i + 1:
            if owner[j] != owner[i]:
                links.append((i, j))
                owner[owner == owner[j]] = owner[i]
    u, v = np.array(links, int).reshape(-1, 2).T
    return pd.DataFrame({"u": node[u], "v": node[v]})


def verified_components(docs: DataFrame, shingle: int, lanes: int, size: int, count: int, radius: int, hot: int = HOT, hot_shingles: int = HOT_SHINGLES) -> DataFrame:
    """(doc_id, text) -> (doc_id, node, root): documents linked, directly or over others, by a similarity of 0.8 or more.

    Documents of equal sets of shingles are one node. Fingerprints within the radius that share a key put nodes into a group of
    candidates; inside a group every pair is compared by its shingles, so no link that fails hides another. A group of more than
    ``hot_shingles`` shingles goes to pairs of blocks.
    """
    prints = pinned(set_fingerprints(docs.select("doc_id", "text"), shingle, lanes))
    nodes = pinned(prints.groupBy("node").agg(F.first("words").alias("words"), F.min("doc_id").alias("doc_id")))
    bits, sets_of_bits = widened(nodes.count(), size, count)
    families = sampled_families(lanes, bits, sets_of_bits, radius)
    groups = components(links(nodes.select("node", "words"), families, hot)).withColumnRenamed("root", "key")
    members = pinned(nodes.select("node", "doc_id").join(groups, "node"))
    sets = pinned(_sets(docs.select("doc_id", "text"), members, shingle))
    held = _in_blocks(sets, hot_shingles, F.size("set")).groupBy("key").applyInPandas(_alike, "u long, v long")
    roots = pinned(components(held))
    return prints.join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))


def keep_one(
    docs: DataFrame, shingle: int = WIDE["shingle"], lanes: int = WIDE["lanes"], size: int = WIDE["size"], count: int = WIDE["count"], radius: int = WIDE["radius"], hot: int = HOT, hot_shingles: int = HOT_SHINGLES
) -> DataFrame:
    """Rows of ``docs`` less all but the first document (by id) of each group of near copies (Jaccard similarity of the sets of 5-word
    shingles of 0.8 or more, directly or over others; wordless texts are alike). Rows that repeat an id stay or go together; rows
    without an id form no group and stay."""
    grouped = verified_components(docs.filter("doc_id is not null"), shingle, lanes, size, count, radius, hot, hot_shingles)
    grouped = pinned(grouped.select("doc_id", "root").distinct())
    least = grouped.groupBy("root").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(-1).alias("open"))
    # an id goes if it is not the least in each group it is in; counted by id, as a group may hold a third of all rows
    gone = pinned(grouped.select("doc_id", F.lit(1).alias("open")).unionAll(least).groupBy("doc_id").agg(F.sum("open").alias("open")).filter("open > 0").select("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
