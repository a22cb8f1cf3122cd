"""Phrase collocations by multikey three-way quicksort of suffix pointers.

A pointer is a word's place with the words that follow it in its piece, up to the longest phrase; equal pointers of a batch of texts
are one pointer with a weight. Pointers are routed by their leading words, so that all pointers with the same leading words meet in one
task, which sorts them by three-way partitioning: word by word, the pointers whose next word equals the pivot form a partition, whose
weight is the count of the phrase so far, and which goes on to the next word. A partition below the asked count can hold no phrase and is abandoned.

One leading word routes, as long as it begins no more than a task's share of the pointers. A heavier lead is routed by two leading words, and
so on; the counts of such leads are taken beforehand by a plain grouping, and there are ``LEADS`` of them at most, by arithmetic,
so tasks may know them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import parallelism
from pairloom.llm.words import coded, joined, spans
from pairloom.operators.ordering import top_k
from pairloom.session import pinned

#: Words whose pointers one route should hold, and most leads that are routed by more words than others at each length.
ROUTE_WORDS, LEADS = 4_000_000, 1_000_000
#: Characters of texts whose pointers are weighed together in a task.
BATCH_CHARS = 8_000_000
#: Counts with more than 1 / LARGE of all words (at most LARGE a length) are looked up by broadcast.
LARGE = 4096
#: Pointers that a partition is finished with by a plain sort.
SMALL = 4096
#: What a byte of a text becomes: A-Z lower case, marks that end a piece a line feed, a tab a space.
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[65:91] += 32
_BYTES[list(b".,;:!?\x0b\x0c\r")] = 10
_BYTES[9] = 32


def prepared(docs: DataFrame) -> DataFrame:
    """(lang, text, ...) -> (lang, text) without nulls: unnamed languages are ``und``."""
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _batches(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, list[bytes]]]:
    """For each language of a batch: codes of its words, number of the piece of each word, the words by code."""
    held: dict[str, list[str]] = {}
    chars = 0

    def done() -> Iterator[tuple[str, np.ndarray, np.ndarray, list[bytes]]]:
        for lang, texts in held.items():
            flat = _BYTES[joined(texts, b"\n")[0]]
            begins, ends = spans(flat, b" \n")
            if len(begins):
                codes, vocabulary = coded(flat, begins, ends)
                yield lang, codes, np.cumsum(flat == 10, dtype=np.int32)[begins], vocabulary.to_pylist()

    for frame in frames:
        for lang, text in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist()):
            held.setdefault(lang, []).append(text)
            chars += len(text)
            if chars >= BATCH_CHARS:
                yield from done()
                held, chars = {}, 0
    yield from done()


def _following(codes: np.ndarray, piece: np.ndarray, length: int) -> list[np.ndarray]:
    """Column k: the k-th word after each place as code + 1, 0 where the piece has ended."""
    out = [codes + 1]
    for k in range(1, length):
        column = np.zeros(len(codes), np.int64)
        if len(codes) > k:
            column[:-k] = np.where(piece[k:] == piece[:-k], codes[k:] + 1, 0)
        out.append(column)
    return out


def _weighed(columns: list[np.ndarray], base: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows of the columns in order, and how often each occurs."""
    key, seen = columns[0], base
    tables = []
    for column in columns[1:]:
        if seen > (1 << 62) // base:  # the key would pass 64 bits: number the different keys so far
            table, key = np.unique(key, return_inverse=True)
            tables.append((table, len(tables)))
            seen = len(table) + 1
        else:
            tables.append((None, len(tables)))
        key, seen = key * base + column, seen * base
    key, weight = np.unique(key, return_counts=True)
    out = []
    for table, _ in reversed(tables):
        out.append(key % base)
        key = key // base
        if table is not None:
            key = table[key]
    return [key, *reversed(out)], weight


def _hashes(vocabulary: list[bytes]) -> np.ndarray:
    """A hash of every word by code + 1, the same in every task."""
    return np.concatenate([np.zeros(1, np.uint64), pd.util.hash_array(np.array(vocabulary, dtype=object), categorize=False)])


def _mixed(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    h = (h ^ more) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def leading_counts(texts: DataFrame, length: int, heavy: dict[str, set[tuple[bytes, ...]]] | None) -> DataFrame:
    """(lang, phrase, f): counts of phrases of ``length`` words, with ``heavy`` only of those whose words but the last are in it."""
    known = texts.sparkSession.sparkContext.broadcast(heavy)

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, codes, piece, vocabulary in _batches(frames):
            columns = _following(codes, piece, length)
            if known.value is not None:
                take = (columns[-1] > 0) & _among(columns[:-1], known.value.get(lang, set()), vocabulary)
                columns = [c[take] for c in columns]
            columns, weight = _weighed(columns, len(vocabulary) + 1)
            phrase = [b" ".join([vocabulary[c - 1] for c in words]).decode("utf-8", "surrogatepass") for words in zip(*[c.tolist() for c in columns])]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(phrase), pa.string()), "phrase": pa.array(phrase, pa.string()), "f": pa.array(weight, pa.int64())})

    return texts.mapInArrow(count, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _among(columns: list[np.ndarray], leads: set[tuple[bytes, ...]], vocabulary: list[bytes]) -> np.ndarray:
    """Which rows' words are one of the leads (all of as many words as there are columns)."""
    out = np.zeros(len(columns[0]), bool)
    code = {w: i + 1 for i, w in enumerate(vocabulary)} if leads else {}
    wanted = np.array([w for lead in leads if 0 not in (w := [code.get(x, 0) for x in lead])], np.int64).reshape(-1, len(columns))
    if len(wanted):
        both = [np.concatenate([c, wanted[:, k]]) for k, c in enumerate(columns)]
        number = both[0]
        for column in both[1:]:
            number = np.unique(number, return_inverse=True)[1] * (len(code) + 1) + column
        out = np.isin(number[: len(out)], number[len(out) :])
    return out


def routed(texts: DataFrame, length: int, routes: int, heavy: list[dict[str, set[tuple[bytes, ...]]]]) -> DataFrame:
    """Blocks of weighted pointers: (route, lang, n, words joined by line feeds, ``length`` columns of places in them, weights).

    ``heavy[k]`` holds the leads of k + 1 words that need one word more. Pointers that end with such a lead are counted already
    and left out.
    """
    known = texts.sparkSession.sparkContext.broadcast(heavy)

    def deal(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, codes, piece, vocabulary in _batches(frames):
            columns, weight = _weighed(_following(codes, piece, length), len(vocabulary) + 1)
            hashed = _hashes(vocabulary)
            route = _mixed(hashed[columns[0]], pd.util.hash_array(np.array([lang], dtype=object)))
            depth = np.ones(len(weight), np.int64)
            for k, leads in enumerate(known.value, 1):
                more = (depth == k) & _among(columns[:k], leads.get(lang, set()), vocabulary)
                route = np.where(more, _mixed(route, hashed[columns[k]]), route)
                depth[more] = k + 1
            last = np.stack(columns)[depth - 1, np.arange(len(depth))]
            route = np.where(last > 0, (route % np.uint64(routes)).astype(np.int64), -1)
            order = np.argsort(route, kind="stable")
            borders = np.searchsorted(route[order], np.arange(routes + 1))
            here, place = np.zeros(len(vocabulary) + 1, bool), np.zeros(len(vocabulary) + 1, np.int32)
            for r in np.flatnonzero(np.diff(borders)):
                rows = order[borders[r] : borders[r + 1]]
                own = np.stack([c[rows] for c in columns])
                here[own] = True
                here[0] = False
                used = np.flatnonzero(here)
                here[used] = False
                place[used] = np.arange(1, len(used) + 1)
                text = b"\n".join([vocabulary[c] for c in (used - 1).tolist()])
                yield pa.RecordBatch.from_pydict({
                    "route": pa.array([r], pa.int32()), "lang": pa.array([lang], pa.string()), "n": pa.array([len(rows)], pa.int32()), "words": pa.array([text], pa.binary()),
                    "places": pa.array([place[own].tobytes()], pa.binary()), "weights": pa.array([weight[rows].astype(np.int64).tobytes()], pa.binary()),
                    "depths": pa.array([depth[rows].astype(np.int8).tobytes()], pa.binary()),
                })

    return texts.mapInArrow(deal, "route int, lang string, n int, words binary, places binary, weights binary, depths binary")


def phrase_partitions(columns: list[np.ndarray], weight: np.ndarray, depth: np.ndarray, least: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Multikey three-way quicksort: (words, count) of all phrases of ``least`` occurrences or more that are whole here.

    ``depth`` is the number of words by which a pointer was routed: shorter phrases are not whole. Word 0 is the end of a piece.
    """
    if not len(weight):
        return
    todo: list[tuple[np.ndarray, np.ndarray, tuple[int, ...]]] = [(np.arange(len(weight), dtype=np.int32), columns[0], ())]
    while todo:
        pointers, word, lead = todo.pop()
        if len(pointers) <= SMALL:
            yield from _small_partition(columns, weight, depth, least, pointers, lead)
            continue
        pivot = int(word[len(word) // 2])
        for side in (np.flatnonzero(word < pivot), np.flatnonzero(word > pivot)):
            if int(weight[pointers[side]].sum()) >= least:
                todo.append((pointers[side], word[side], lead))
        same = pointers[word == pivot]
        count = int(weight[same].sum())
        if pivot == 0 or count < least:
            continue
        phrase = (*lead, pivot)
        if depth[same[0]] <= len(phrase):
            yield phrase, count
        if len(phrase) < len(columns):
            todo.append((same, columns[len(phrase)][same], phrase))


def _small_partition(columns: list[np.ndarray], weight: np.ndarray, depth: np.ndarray, least: int, pointers: np.ndarray, lead: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], int]]:
    """The phrases of a partition, its pointers sorted word by word; pointers of infrequent parts go after each word."""
    part = np.zeros(len(pointers), np.int64)
    for k in range(len(lead), len(columns)):
        word = columns[k][pointers]
        key = part << 32 | word
        order = np.argsort(key, kind="stable")
        pointers, key, word = pointers[order], key[order], word[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        if not len(first):
            return
        count = np.add.reduceat(weight[pointers], first)
        goes_on = (count >= least) & (word[first] > 0)
        heads = pointers[first[goes_on]]
        whole = depth[heads] <= k + 1
        words = [columns[j][heads[whole]].tolist() for j in range(len(lead), k + 1)]
        yield from zip([(*lead, *w) for w in zip(*words)], count[goes_on][whole].tolist())
        sizes = np.diff(first, append=len(key))
        pointers = pointers[np.repeat(goes_on, sizes)]
        part = np.repeat(np.arange(int(goes_on.sum()), dtype=np.int64), sizes[goes_on])


def _sorted_route(length: int, least: int):
    def sort(key: tuple, table: pa.Table) -> pa.Table:
        blocks = {c: table.column(c).to_pylist() for c in ("n", "words", "places", "weights", "depths")}
        listed = [block.split(b"\n") for block in blocks["words"]]
        # The same word of several blocks gets one number.
        found = pa.array([w for words in listed for w in words], pa.large_binary()).dictionary_encode()
        numbers = found.indices.to_numpy().astype(np.int32) + 1
        columns: list[list[np.ndarray]] = [[] for _ in range(length)]
        start = 0
        for words, n, places in zip(listed, blocks["n"], blocks["places"]):
            own = np.concatenate([np.zeros(1, np.int32), numbers[start : start + len(words)]])
            start += len(words)
            for k, part in enumerate(np.frombuffer(places, np.int32).reshape(length, n)):
                columns[k].append(own[part])
        weight = np.frombuffer(b"".join(blocks["weights"]), np.int64)
        depth = np.frombuffer(b"".join(blocks["depths"]), np.int8)
        name = [b"", *found.dictionary.to_pylist()]
        rows = list(phrase_partitions([np.concatenate(c) for c in columns], weight, depth, least))
        text = [b" ".join([name[w] for w in phrase]).decode("utf-8", "surrogatepass") for phrase, _ in rows]
        return pa.table({
            "lang": pa.array([key[1].as_py()] * len(rows), pa.string()), "phrase": pa.array(text, pa.string()),
            "words": pa.array([len(p) for p, _ in rows], pa.int32()), "f": pa.array([c for _, c in rows], pa.int64()),
        })

    return sort


def phrase_counts(docs: DataFrame, length: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of all phrases up to ``length`` words that occur ``least`` times, (lang, n) of all words)."""
    spark = docs.sparkSession
    texts = prepared(docs)
    single = pinned(leading_counts(texts, 1, None))
    totals = pinned(single.groupBy("lang").agg(F.sum("f").alias("n")))
    words = totals.agg(F.sum("n")).first()[0] or 0
    share = max(ROUTE_WORDS // 4, words // LEADS)
    heavy: list[dict[str, set[tuple[bytes, ...]]]] = []
    counted = []
    level = single
    for k in range(1, length):
        leads: dict[str, set[tuple[bytes, ...]]] = {}
        # More than `share` of `words` occurrences each: at most LEADS rows.
        for row in level.filter(F.col("f") > share).collect():
            leads.setdefault(row["lang"], set()).add(tuple(row["phrase"].encode("utf-8", "surrogatepass").split(b" ")))
        if not leads:
            break
        heavy.append(leads)
        counted.append(level.filter(F.col("f") > share).select("lang", "phrase", F.lit(k).alias("words"), "f"))
        if k + 1 < length:
            level = pinned(leading_counts(texts, k + 1, leads))
    routes = max(parallelism(spark), -(-words // ROUTE_WORDS))
    blocks = routed(texts, length, routes, heavy).repartition(routes, "route", "lang")
    phrases = blocks.groupBy("route", "lang").applyInArrow(_sorted_route(length, least), "lang string, phrase string, words int, f long")
    for more in counted:
        phrases = phrases.unionByName(more.filter(F.col("f") >= least))
    return pinned(phrases), totals


def _with_count(rows: DataFrame, counts: DataFrame, key: str, name: str, total: int) -> DataFrame:
    """Add the count of the phrase in column ``key``. Counts above 1 / LARGE of all words are looked up by broadcast, so no key of the
    shuffled join stands in more than that share of the rows."""
    is_large = F.col(name) * LARGE > total
    counts = counts.select(F.col("lang"), F.col("phrase").alias(key), F.col("f").alias(name))
    tried = rows.join(F.broadcast(counts.filter(is_large)), ["lang", key], "left")
    rest = tried.filter(F.col(name).isNull()).select(*rows.columns).join(counts.filter(~is_large), ["lang", key])
    return tried.filter(F.col(name).isNotNull()).unionByName(rest)


def collocations(docs: DataFrame, length: int = 3, least: int = 10, first: int = 2000) -> DataFrame:
    """(lang, text, ...) -> (lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``length`` words.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends; phrases lie within pieces. A phrase needs ``least``
    occurrences (a). Cut in two, with l and r occurrences of the parts, it scores floor(1000000 * a * a / (l * r)); its lowest cut counts, the shortest first
    part among equals. Phrases inside a longer one with half their occurrences or more are dropped. Null languages are ``und``,
    null texts empty; repeated rows count each; languages without such phrases have no rows, nor has an empty table; other
    columns are not read.
    """
    counts, totals = phrase_counts(docs, length, least)
    total = totals.agg(F.sum("n")).first()[0] or 0
    words = F.split("phrase", " ")
    candidates = counts.filter("words >= 2").withColumn("w", words)

    def part(begin: Column | int, size: Column) -> Column:
        return F.array_join(F.slice("w", begin, size), " ")

    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("head"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    cuts = _with_count(_with_count(cuts, counts, "head", "l", total), counts, "tail", "r", total)
    wide = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "l", "r")}
    above = (wide["a"] * wide["a"]).cast("decimal(38,0)") * F.lit(1000000).cast("decimal(7,0)")
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", above.cast("decimal(38,0)").alias("above"), (wide["l"] * wide["r"]).cast("decimal(38,0)").alias("under"))
    scored = cuts.withColumn("score", F.expr("above div under"))
    scored = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = candidates.filter("words > 2").select("lang", "f", F.col("words").alias("size"), "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    longer = longer.select("lang", "f", "m", "w", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at"))
    inside = longer.select("lang", part(F.col("at"), F.col("m")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    left = scored.join(inside, ["lang", "phrase"], "left").filter("longest IS NULL OR longest * 2 < a")
    rows = left.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    best = top_k(rows, ["lang"], [-F.col("score"), -F.col("a"), "phrase"], first)
    # One row a language; their number is not bounded, so the join is left to Spark.
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = """
WITH pieces AS (
  SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists),
f AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM places, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
candidates AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 10),
cuts AS (SELECT *, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, h.f AS l, t.f AS r, CAST(1000000::HUGEINT * c.a * c.a // (h.f::HUGEINT * t.f) AS BIGINT) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longest
  FROM (SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM candidates WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM candidates WHERE k = 3) GROUP BY ALL),
ranked AS (
  SELECT o.*, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, o.phrase) AS rank
  FROM lowest o LEFT JOIN inside i ON i.lang = o.lang AND i.phrase = o.phrase WHERE longest IS NULL OR 100 * longest < 50 * a)
SELECT r.lang, rank, r.phrase, a, l, r.r, n, score
FROM ranked r JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang) USING (lang) WHERE rank <= 2000
"""
