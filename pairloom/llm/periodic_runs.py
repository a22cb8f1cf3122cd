"""Runs of repeating words, by Lyndon roots from the first phase of Baier's suffix sorter.

The sorter's first phase starts with groups of equal first words and takes the groups from the highest down. A suffix of the group
in hand points to the nearest suffix on its left that is in a lower group; every suffix so pointed to gets the context of the
group in hand appended, as often as it is pointed to, and moves to a new group right above its old one. When a group is taken,
its context is the longest Lyndon word that begins at each of its suffixes, so the Lyndon array needs no second phase. It is made
under the order of the words and under the reverse order; every run has a root among the Lyndon words of one of them. A root is
extended to both sides as far as words one period apart agree (longest common extensions, by doubling comparisons of stretches).

Only stretches that can hold a run are sorted: all three-word sequences of a run of ``exponent`` periods occur ``exponent`` - 1
times or more in the text, so a text is first cut to the stretches that consist of such sequences. Nothing else is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import SPACES, WORD
from pairloom.llm.words import coded, joined, spans

#: Rows whose words are coded together.
BATCH = 500


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word at every place, by phase one of the sorter. The end is less than any word."""
    n = len(ranks)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    number = {value: i for i, value in enumerate(sorted(set(ranks)))}
    of = [number[value] for value in ranks]
    members: list[list[int]] = [[] for _ in number]
    for i, group in enumerate(of):
        members[group].append(i)
    context = [1] * len(number)
    below, above = list(range(-1, len(number) - 1)), list(range(1, len(number) + 1))
    out = [0] * n
    group = len(number) - 1
    while group >= 0:
        length = context[group]
        pointed: dict[int, int] = {}
        for i in members[group]:
            if of[i] != group:
                continue
            out[i] = length
            # Taken suffixes leave the chain of places: the left neighbour is then the nearest suffix of a lower group.
            before, after = left[i], right[i]
            if after < n:
                left[after] = before
            if before >= 0:
                right[before] = after
                pointed[before] = pointed.get(before, 0) + 1
        alike: dict[tuple[int, int], list[int]] = {}
        for place, times in pointed.items():
            alike.setdefault((times, of[place]), []).append(place)
        # Each set goes right above its old group, the one pointed to most often first, so that it ends up highest.
        for times, old in sorted(alike, reverse=True) if len(alike) > 1 else alike:
            new, places = len(members), alike[times, old]
            members.append(places)
            context.append(context[old] + times * length)
            below.append(old)
            above.append(above[old])
            below[above[old]] = new
            above[old] = new
            for place in places:
                of[place] = new
        group = below[group]
    return out


def _ahead(words: bytes, i: int, j: int) -> int:
    """How many words agree from places i and j on (i < j). A word takes four bytes."""
    n, k, step = len(words) // 4, 0, 1
    while j + k + step <= n and words[4 * (i + k) : 4 * (i + k + step)] == words[4 * (j + k) : 4 * (j + k + step)]:
        k, step = k + step, step * 2
    while step := step // 2:
        if j + k + step <= n and words[4 * (i + k) : 4 * (i + k + step)] == words[4 * (j + k) : 4 * (j + k + step)]:
            k += step
    return k


def _behind(words: bytes, i: int, j: int) -> int:
    """How many words agree up to places i and j, these left out (i < j)."""
    k, step = 0, 1
    while step <= i - k and words[4 * (i - k - step) : 4 * (i - k)] == words[4 * (j - k - step) : 4 * (j - k)]:
        k, step = k + step, step * 2
    while step := step // 2:
        if step <= i - k and words[4 * (i - k - step) : 4 * (i - k)] == words[4 * (j - k - step) : 4 * (j - k)]:
            k += step
    return k


def runs_within(codes: np.ndarray, stretches: list[tuple[int, int]], exponent: int, least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text whose roots lie in its stretches, by start, then period."""
    words = codes.astype(np.int32).tobytes()
    found = set()
    for first, end in stretches:
        part = codes[first:end].tolist()
        for ranks in (part, [-c for c in part]):
            reached: dict[int, int] = {}
            for at, period in enumerate(lyndon_lengths(ranks), first):
                # Two stretches of one period that share a root are the same one.
                if at + period <= reached.get(period, 0):
                    continue
                ahead, behind = _ahead(words, at, at + period), _behind(words, at, at + period)
                reached[period] = at + period + ahead
                length = period + ahead + behind
                if length >= least and length >= exponent * period:
                    found.add((at - behind, period, length))
    return [(start, length, period) for start, period, length in sorted(found)]


def _stretches(codes: np.ndarray, doc: np.ndarray, exponent: int, least: int) -> Iterator[tuple[int, int]]:
    """Where runs can be: begin and end (among the words of all texts) of stretches of often repeated three-word sequences."""
    needed = min(exponent - 1, max(least, exponent) - 2)
    n = len(codes)
    if needed < 2 or least < 3:
        edges = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
        yield from zip(edges[:-1].tolist(), edges[1:].tolist())
        return
    if n < 3:
        return
    # Sequences that share a hash count as one: that can only keep more.
    mixed = codes.astype(np.uint64)
    key = doc[:-2].astype(np.uint64)
    for k in range(3):
        key = (key ^ mixed[k : n - 2 + k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    often = (times[back] >= needed) & (doc[:-2] == doc[2:])
    edges = np.flatnonzero(np.diff(often.astype(np.int8), prepend=0, append=0))
    for first, last in zip(edges[::2].tolist(), edges[1::2].tolist()):
        # Starts of sequences in two texts never touch: the last two places of a text start none.
        if last + 2 - first >= least:
            yield first, last + 2


def collapsed(docs: DataFrame, exponent: int = 4, least: int = 6) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, runs, collapsed): the runs of words of each text and the text without their repetitions.

    A run is a stretch of consecutive words, numbered from 0, of smallest period q and of ``exponent`` periods and ``least`` words at
    least, that no neighbouring word extends; runs is an array of (start, length, period) by start, then period. ``collapsed``
    holds the words, joined by one space, that no run contains after its first q words. One row a row, so repeated ids stay; null, empty and
    wordless texts have no runs and an empty text; other columns are not read; an empty table gives an empty one.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        flat, first_byte = joined(frame["text"].tolist(), b" ")
        begins, ends = spans(flat, SPACES.encode())
        codes, vocabulary = coded(flat, begins, ends)
        doc = np.searchsorted(first_byte, begins, "right") - 1
        borders = np.searchsorted(doc, np.arange(len(frame) + 1))
        parts: dict[int, list[tuple[int, int]]] = {}
        for first, end in _stretches(codes, doc, exponent, least):
            at = int(doc[first])
            parts.setdefault(at, []).append((first - int(borders[at]), end - int(borders[at])))
        names = [w.decode("utf-8", "surrogatepass") for w in vocabulary.to_pylist()]
        runs, texts = [], []
        for at in range(len(frame)):
            own = codes[borders[at] : borders[at + 1]]
            found = runs_within(own, parts[at], exponent, least) if at in parts else []
            kept = np.ones(len(own), bool)
            for start, length, period in found:
                kept[start + period : start + length] = False
            runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
            texts.append(" ".join([names[c] for c in own[kept].tolist()]))
        return pd.DataFrame({"doc_id": frame["doc_id"], "runs": runs, "collapsed": texts})

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), BATCH):
                yield of(frame.iloc[at : at + BATCH].reset_index(drop=True))

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInPandas(batches, "doc_id string, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts of ids with crc32(id) divisible by 10 repeat themselves from a word on, as the query asks."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % F.greatest(n, F.lit(1))
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    # The words are an element here, so that they are found once a text and not once a word.
    text = F.transform(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), repeated)
    return docs.select("doc_id", F.when(h % 10 == 0, F.get(text, F.lit(0))).otherwise(F.col("text")).alias("text"))


def query(docs: DataFrame) -> DataFrame:
    """Digest columns of the runs of :func:`planted` texts."""
    out = collapsed(planted(docs))
    # Quotients of numbers below 2 ** 25 compare as doubles just as they do exactly.
    best = F.array_min(F.transform("runs", lambda r: F.struct((-(r["length"] / r["period"])).alias("exponent"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    out = out.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Streaks of equal three-word sequences q words apart are the runs of period q, or of a divisor of q, which then comes first.
SQL = """
WITH RECURSIVE named AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words, CAST(doc_id AS VARCHAR) AS name FROM documents),
hashed AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(name) + 1), lambda i: CAST(ascii(name[i]) AS BIGINT))),
    lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) AS h
  FROM named),
sized AS (SELECT *, len(words) AS n, h // 10 AS g, h % 10 = 0 AND len(words) > 0 AS planted FROM hashed),
placed AS (SELECT *, CASE WHEN planted THEN g % n END AS a, CASE WHEN planted THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM sized),
w AS (
  SELECT d, n, i, words[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM placed)),
three AS (
  SELECT d, n, i, hash(word, lead(word, 1) OVER o, lead(word, 2) OVER o) AS t FROM w WINDOW o AS (PARTITION BY d ORDER BY i) QUALIFY lead(i, 2) OVER o IS NOT NULL),
alike AS (SELECT x.d, x.i, y.i - x.i AS q FROM three x JOIN three y ON x.d = y.d AND x.t = y.t AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
streaks AS (SELECT d, q, i, i - row_number() OVER (PARTITION BY d, q ORDER BY i) AS island FROM alike),
stretches AS (SELECT d, q, min(i) AS start, count(*) + 2 + q AS length FROM streaks GROUP BY d, q, island),
runs AS (SELECT d, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY d, start, length),
listed AS (
  SELECT d, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         arg_min({'start': start, 'length': length, 'period': period}, (-(CAST(length AS DOUBLE) / period), start, period)) AS best
  FROM runs GROUP BY d),
gone AS (SELECT DISTINCT d, unnest(range(start + period, start + length)) AS i FROM runs),
texts AS (SELECT w.d, string_agg(word, ' ' ORDER BY i) AS collapsed FROM w ANTI JOIN gone USING (d, i) GROUP BY w.d)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM placed LEFT JOIN listed USING (d) LEFT JOIN texts USING (d)
"""
