"""Personal data by bootstrapped contextual extraction. DataFrame and SQL functions only.

Seeds are e-mail addresses, IP addresses, card and phone numbers found by their form. The two words before a seed are a lexical
pattern. A pattern's confidence is the share of the documents where it stands in which it leads to a known identifier; patterns of high
confidence and support accept identifier-like tokens that follow them, these become seeds themselves, and so on until nothing new
is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import ascii_lower
from pairloom.session import pinned

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive quantifiers and look-behinds only keep the search linear (no match can begin or end elsewhere);
#: the card pattern takes chains of 14 to 19 digits, as longer and shorter ones are dropped anyhow.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Kinds of a span, in the order in which spans of one start are listed.
FOUND = "context"
#: A pattern needs so many different known identifiers and this share of its documents.
SUPPORT, CONFIDENCE = 5, 0.6
#: Characters before a span in which its two words are looked for; a longer pair of words is no lexical pattern.
REACH = 64
_BLOCK = 256


def _running(lengths: Column) -> Column:
    """Sum of the values before each place. Sums of blocks keep the work far below the square of a long array."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / _BLOCK).cast("int")), lambda j: F.aggregate(F.slice(lengths, j * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), lambda a, x: a + x))

    def upto(i: Column) -> Column:
        full = F.floor(i / _BLOCK).cast("int")
        whole = F.aggregate(F.slice(blocks, F.lit(1), full), F.lit(0), lambda a, x: a + x)
        return whole + F.aggregate(F.slice(lengths, full * _BLOCK + 1, (i % _BLOCK).cast("int")), F.lit(0), lambda a, x: a + x)

    return F.transform(lengths, lambda _, i: upto(i))


def _spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all matches, in code points, end exclusive."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    n = F.size(found)
    lengths = F.transform(F.slice(gaps, F.lit(1), n), lambda g: F.length(g))
    own = F.transform(found, lambda m: F.length(m))
    starts = F.zip_with(_running(lengths), F.zip_with(lengths, _running(own), lambda g, o: g + o), lambda a, b: a + b)
    return F.zip_with(starts, found, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("value")))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: F.length(F.regexp_replace(x, "^0+", "")) <= 3) & F.forall(F.split(value, r"\."), lambda x: F.coalesce(F.right(x, F.lit(9)).cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        return _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


_MAY = {"email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: t.rlike(r"[0-9]\."), "card": lambda t: t.rlike("[0-9][0-9 -]{13}"), "phone": lambda t: t.rlike(r"\+[0-9]")}
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def _kept(kind: str, rank: int) -> Column:
    """The spans of a kind that hold, with the kind and its rank."""
    held = F.filter(F.col(f"_s_{kind}"), lambda s: _holds(kind, s["value"]))
    full = F.transform(held, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))
    return F.coalesce(full.cast(_SPAN), F.array().cast(_SPAN))


def _number(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def with_base(docs: DataFrame) -> DataFrame:
    """``docs`` (text, ...) with _base: array of (start, rank, end, kind, value) by start, then kind as listed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    may = docs.withColumns({f"_m_{k}": F.when(_MAY[k](text), text).otherwise(F.lit("")) for k in KINDS})
    each = may.withColumns({f"_s_{k}": F.when(F.col(f"_m_{k}") != "", _spans(F.col(f"_m_{k}"), PATTERNS[k])) for k in KINDS})
    held = {f"_s_{k}": _kept(k, i) for i, k in enumerate(KINDS)}
    out = each.withColumns(held)
    return out.withColumn("_base", F.array_sort(F.concat(*[f"_s_{k}" for k in KINDS]))).drop(*[f"_s_{k}" for k in KINDS], *[f"_m_{k}" for k in KINDS])


def _left(text: Column, start: Column) -> Column:
    """The two words before ``start``, in lower case and separated by a space; empty if there are not two whole ones within reach."""
    reach = ascii_lower(F.substring(text, F.greatest(start - REACH, F.lit(0)) + 1, F.least(start, F.lit(REACH))))
    words = r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$"
    # Where the reach begins inside the text, a first word at its beginning may be cut: a separator has to stand before it.
    found = F.when(start > REACH, F.regexp_extract(reach, r"(?<=[\x20\x09-\x0D])" + words, 1)).otherwise(F.regexp_extract(reach, r"(?<![^\x20\x09-\x0D])" + words, 1))
    return F.regexp_replace(found, r"[\x20\x09-\x0D]+", " ")


def _norm(value: Column) -> Column:
    """An identifier without the punctuation around it."""
    return F.regexp_replace(value, r"^[^\p{L}\p{N}+@(]+|[^\p{L}\p{N})]+$", "")


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, _th, _base, _near): the base spans and the other tokens with a digit or @, each with its left
    words. _th is a hash of the text; with doc_id it stands for a row (equal rows have equal spans)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = with_base(docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_th")))
    rows = rows.withColumn("_tokens", F.when(F.col("text").rlike("[0-9@]"), _spans(F.col("text"), _TOKEN)))
    free = F.filter("_tokens", lambda t: ~F.exists("_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    shaped = F.filter(free, lambda t: (F.length(_norm(t["value"])) >= 6) & ((F.length(_digits(t["value"])) >= 4) | F.contains(t["value"], F.lit("@"))))
    near = F.transform(shaped, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), _norm(t["value"]).alias("value"), _left(F.col("text"), t["start"]).alias("left")))
    seeds = F.transform("_base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["value"].alias("value"), _left(F.col("text"), b["start"]).alias("left")))
    return rows.select("doc_id", "_th", "_base", seeds.alias("_seeds"), near.alias("_near"))


def _places(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern) -> (pattern, places): in how many documents each pair of words stands, over whole texts."""
    words = F.filter(F.split(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    pairs = F.zip_with(F.col("_w"), F.slice(F.col("_w"), F.lit(2), F.size("_w")), lambda a, b: F.concat_ws(" ", a, b))
    rows = docs.select(words.alias("_w")).filter(F.size("_w") > 1).select(F.explode(F.array_distinct(pairs)).alias("pattern"))
    return rows.join(patterns, "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("places"))


def discover(docs: DataFrame, spans: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame | None:
    """``spans`` of :func:`marked` (pinned) -> (doc_id, _th, start, end) of identifiers that patterns add, or None where no pattern
    has the support and the confidence. Rounds go on until one adds nothing."""
    seeds = spans.select("doc_id", "_th", F.explode("_seeds").alias("s")).select("doc_id", "_th", F.col("s.left").alias("pattern"), F.lower("s.value").alias("instance")).filter("pattern <> ''")
    near = spans.select("doc_id", "_th", F.explode("_near").alias("n")).select("doc_id", "_th", F.col("n.start").alias("start"), F.col("n.end").alias("end"), F.col("n.left").alias("pattern"), F.lower("n.value").alias("instance")).filter("pattern <> ''")
    near = pinned(near)
    bearing = docs.filter(F.coalesce(F.col("text"), F.lit("")).rlike("[0-9@]"))
    known, taken, before = seeds, None, -1

    def confident(patterns: DataFrame, rows: DataFrame) -> DataFrame:
        counted = patterns.join(_places(rows, patterns.select("pattern")), "pattern")
        return pinned(counted.filter(F.col("hits") >= F.lit(confidence) * F.col("places")).select("pattern", "hits"))

    while True:  # what is added only grows, so this ends
        supported = known.groupBy("pattern").agg(F.countDistinct("instance").alias("different"), F.countDistinct(F.struct("doc_id", "_th")).alias("hits"))
        # identifiers stand in texts with a digit or @, so these alone bound the confidence from above: who fails there fails everywhere
        sure = confident(pinned(supported.filter(F.col("different") >= support)), bearing)
        if sure.limit(1).count():
            sure = confident(sure, docs)
        added = pinned(near.join(sure, "pattern", "left_semi").select("instance").distinct())
        size = added.count()
        if size == before or not size:  # nothing new
            break
        before = size
        # an accepted identifier counts wherever it stands, and its other contexts become patterns to score
        hits = near.join(added, "instance", "left_semi")
        taken = pinned(hits.select("doc_id", "_th", "start", "end").distinct())
        known = seeds.unionByName(hits.select("doc_id", "_th", "pattern", "instance"))
    return taken


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _with_found(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """Adds _all: the base spans and what the patterns added, by start."""
    if found is None:
        return rows.withColumn("_all", F.col("_base"))
    span = F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.lit(FOUND).alias("kind"), F.lit("").alias("value"))
    lists = found.groupBy(F.col("doc_id").alias("_d"), F.col("_th").alias("_t")).agg(F.collect_set(span).cast(_SPAN).alias("_more"))
    joined = rows.join(lists, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")), "left").drop("_d", "_t")
    return joined.withColumn("_all", F.array_sort(F.concat("_base", F.coalesce("_more", F.array().cast(_SPAN))))).drop("_more")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null texts count as empty: no spans and the hash of an empty list. Repeated rows come back as often as they came. The spans
    that patterns add are of kind "context". An empty table gives an empty one.
    """
    spans = pinned(marked(docs))
    rows = _with_found(spans, discover(docs, spans))
    counts = [_number("_base", k).alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"), _listed(F.col("_all")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in brackets, overlapping spans by the first one's; n_chars (if
    there) is counted anew. Null texts stay null, texts without spans stay as they are."""
    spans = pinned(marked(docs))
    rows = with_base(docs.withColumn("_th", F.xxhash64(F.coalesce("text", F.lit("")))))
    rows = _with_found(rows, discover(docs, spans))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        more = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.when(inside, acc["out"]).otherwise(more).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    built = F.aggregate("_all", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    out = rows.withColumn("text", F.when(F.size("_all") > 0, built).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_all") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
