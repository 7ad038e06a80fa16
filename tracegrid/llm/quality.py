"""Quality rules with adaptive thresholds from mergeable quantile sketches (built-in functions only).

Every signal of every document goes into a DDSketch (Masson, Rim and Lee, VLDB 2019): a histogram over
logarithmic buckets whose quantiles have a fixed relative error. Such sketches merge by adding counts, so a
plain ``groupBy`` builds one for each language and source, map-side combine keeps hot sources cheap, and a
rollup merges them per language and overall for groups too small to speak for themselves. A document is
kept if no signal lies above its group's fence: the lesser of q90 + 3 * (q90 - q50) and q75 + 32 * (q75 - q50), plus an
allowance. The first follows wide but clean groups; the second stands where up to a quarter of a group is bad, as its
quantiles then still come from good documents. The allowance is a number of characters, lines or words over the median
size of the group's documents, from a sketch of sizes: what is little in a group of long documents may be much in one
of short ones. So no limit is fixed, also for signals that most documents do not show and whose quantiles are 0.

Defined results: a null text counts as empty (no words: it fails the base rules); null languages and sources
form their own groups; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import cut, words_of

#: Relative error of the sketches' quantiles.
ALPHA = 0.01
GAMMA = (1 + ALPHA) / (1 - ALPHA)
#: Ratio signals, each with what a document of its group's median size may have beyond the group's spread, and the size
#: that it is a share of: a line's or three lines' length of characters, three lines, a long paragraph of repeated words.
SIGNALS = {"symbol_ratio": (80, "word_chars"), "upper_ratio": (240, "word_chars"), "shout_ratio": (80, "word_chars"), "dup_line_ratio": (3, "n_lines"), "repeat_ratio": (150, "n_words")}
SIZES = ("word_chars", "n_words", "n_lines")
#: Spreads above q90 and above q75 at which the two arms of a fence lie.
OVER_Q90, OVER_Q75 = 3, 32
#: A group with fewer documents uses its language's sketch, and that with fewer the one of all documents.
MIN_GROUP = 200
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Words covered by 3-word windows that occur twice or more. Windows are sorted as longs of a hash and a position, and
#: those with an equal neighbour are held against it word by word. If all agree, equal hashes are equal windows; if two
#: windows share a hash, the text's windows are sorted by their words instead, so that no collision marks or loses one.
_REPEATS = """
transform(array(named_struct('w', {w}, 'b', length(bin(size({w}))))), z -> CASE WHEN size(z.w) < 4 THEN 0L ELSE
  aggregate(
    transform(array(sort_array(transform(sequence(0, size(z.w) - 3), i -> shiftleft({hash}, z.b) | i))), p ->
      transform(array(filter(sequence(0, size(p) - 1), k ->
          (k > 0 AND shiftright(p[k], z.b) = shiftright(p[greatest(k - 1, 0)], z.b))
          OR (k < size(p) - 1 AND shiftright(p[k], z.b) = shiftright(p[least(k + 1, size(p) - 1)], z.b)))), ks ->
        CASE WHEN forall(ks, k -> k = 0 OR shiftright(p[k], z.b) <> shiftright(p[greatest(k - 1, 0)], z.b) OR ({same}))
        THEN sort_array(transform(ks, k -> {at_k}))
        ELSE transform(array(sort_array(transform(sequence(0, size(z.w) - 3), i -> named_struct('g', concat_ws(' ', z.w[i], z.w[i + 1], z.w[i + 2]), 'i', i)))), s ->
          sort_array(transform(
            filter(sequence(0, size(s) - 1), k -> (k > 0 AND s[k].g = s[greatest(k - 1, 0)].g) OR (k < size(s) - 1 AND s[k].g = s[least(k + 1, size(s) - 1)].g)),
            k -> s[k].i)))[0] END)[0])[0],
    named_struct('e', -3, 'c', 0L),
    (a, q) -> named_struct('e', q + 2, 'c', a.c + least(3, q + 2 - a.e)),
    a -> a.c) END)[0]
"""


def repeat_sql(w: str, hash: str = "xxhash64(z.w[i], z.w[i + 1], z.w[i + 2])") -> str:
    """The number of words of the array ``w`` that lie in repeated windows; ``hash`` is a window's hash."""

    def at(x: str) -> str:
        return f"CAST(p[{x}] & (shiftleft(1L, z.b) - 1) AS INT)"

    same = " AND ".join(f"z.w[{at('k')} + {d}] = z.w[{at('greatest(k - 1, 0)')} + {d}]" for d in range(3))
    return _REPEATS.format(w=w, hash=hash, at_k=at("k"), same=same)


def _count(text: Column, chars: str) -> Column:
    """Characters of the class ``chars`` in a text."""
    return (F.length(text) - F.length(F.regexp_replace(text, chars, ""))).cast("long")


def quality_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts, ``base_failed`` and the ratio signals."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn("_w", words_of(F.col(text)))
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": _count(t, r"[#*$%&|<>]"),
        "n_dup_lines": F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long"),
        "n_repeat_words": F.expr(repeat_sql("_w")),
        "n_lines": F.size(lines).cast("long"),
        "n_upper": _count(t, r"\p{Lu}"),
        "n_shout": _count(t, r"[!?]"),
    }).drop("_w")
    chars, words = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    return df.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT),
        "symbol_ratio": F.col("n_symbols") / chars,
        "upper_ratio": F.col("n_upper") / chars,
        "shout_ratio": F.col("n_shout") / chars,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / words,
    }).drop("n_upper", "n_shout")


def sketches(signals: DataFrame) -> DataFrame:
    """(lang, source, signal, bucket, n): the sketch of each group, bucket -100000 for zero; sizes have sketches as well."""
    x = F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("x")) for s in (*SIGNALS, *SIZES)))).alias("s")
    bucket = F.when(F.col("s.x") <= 0, F.lit(-100000)).otherwise(F.ceil(F.log(F.col("s.x")) / math.log(GAMMA))).cast("long")
    return signals.select("lang", "source", x).groupBy("lang", "source", F.col("s.signal").alias("signal"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def thresholds(signals: DataFrame) -> DataFrame:
    """(lang, source, one fence a signal) for every language and source."""
    small = sketches(signals)
    merged = (
        small.withColumns({"l": F.col("lang"), "s": F.col("source")})
        .rollup("signal", "bucket", "l", "s")
        .agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
        .filter("g <= 3")
        .select("signal", "bucket", "l", "s", "n", (F.when(F.col("g") == 0, 0).when(F.col("g") == 1, 1).otherwise(2)).alias("level"))
    )
    by = W.Window.partitionBy("level", "l", "s", "signal")
    value = F.when(F.col("bucket") == -100000, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket")) * 2 / (GAMMA + 1))
    ranked = merged.withColumns({
        "total": F.sum("n").over(by),
        "upto": F.sum("n").over(by.orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, 0)),
        "value": value,
    })
    at = lambda q: F.min(F.when(F.col("upto") > q * (F.col("total") - 1), F.col("value")))
    cuts = ranked.groupBy("level", "l", "s", "signal").agg(at(0.5).alias("q50"), at(0.75).alias("q75"), at(0.9).alias("q90"), F.max("total").alias("total"))
    arm = lambda q, spreads: F.col(q) + spreads * (F.col(q) - F.col("q50"))
    of = lambda signal, c: F.max(F.when(F.col("signal") == signal, c))
    spread = F.least(arm("q90", OVER_Q90), arm("q75", OVER_Q75))
    fences = (of(s, spread) + allowed / F.greatest(of(size, F.col("q50")), F.lit(1.0)) for s, (allowed, size) in SIGNALS.items())
    wide = cut(cuts.groupBy("level", "l", "s").agg(F.max("total").alias("total"), *(f.alias(f"max_{s}") for s, f in zip(SIGNALS, fences))), "sketches")
    top = [f"max_{s}" for s in SIGNALS]
    level = lambda n: wide.filter(F.col("level") == n).select("l", "s", F.struct("total", *top).alias(f"f{n}"))
    own, lang = level(0), level(1).drop("s").withColumnRenamed("l", "l1")
    every = level(2).select("f2.*").first()  # one row: the sketch of all documents
    if every is None:
        return own.select(F.col("l").alias("t_lang"), F.col("s").alias("t_source"), *(F.col(f"f0.{x}").alias(x) for x in top))
    f2 = F.struct(F.lit(every.total).alias("total"), *(F.lit(every[x]).alias(x) for x in top))
    picked = own.join(lang, F.col("l").eqNullSafe(F.col("l1")), "left")
    use = F.when(F.col("f0.total") >= MIN_GROUP, F.col("f0")).when(F.col("f1.total") >= MIN_GROUP, F.col("f1")).otherwise(f2)
    return picked.select(F.col("l").alias("t_lang"), F.col("s").alias("t_source"), use.alias("f")).select("t_lang", "t_source", *(F.col(f"f.{x}").alias(x) for x in top))


def judge(signals: DataFrame, fences: DataFrame) -> DataFrame:
    """``signals`` joined with their group's fences, and ``kept``.

    The join's small side has a row for each language and source; Spark broadcasts it if its measured size allows.
    """
    df = signals.join(fences, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_lang", "t_source")
    fine = F.lit(True)
    for s in SIGNALS:
        fine = fine & (F.col(s) <= F.col(f"max_{s}"))
    return df.withColumn("kept", ~F.col("base_failed") & F.coalesce(fine, F.lit(False)))


OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def quality_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, kept) of every document."""
    thin = cut(quality_signals(docs.select("doc_id", "lang", "source", "text")).drop("text"), "quality")
    return judge(thin, cut(thresholds(thin), "fences")).select("doc_id", *OUT)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they are.

    Signals are computed once and written beside the rows, so that neither is done again nor are texts shuffled: the
    fences come from the thin columns, and the verdict is a filter over what was written.
    """
    names = docs.columns
    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), "lang", "source", "text")
    written = cut(quality_signals(plain).drop("text"), "quality")
    return judge(written, cut(thresholds(written), "fences")).filter("kept").select("row.*")


_ORACLE_SIGNALS = ", ".join([*(f"('{s}', {s}, {allowed}, '{size}')" for s, (allowed, size) in SIGNALS.items()), *(f"('{s}', {s}::DOUBLE, NULL, NULL)" for s in SIZES)])

ORACLE = rf"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln,
         row_number() OVER () AS u
  FROM documents
), win AS (
  SELECT u, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT u, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (
  SELECT u, i FROM (SELECT u, i, count(*) OVER (PARTITION BY u, g) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT u, count(DISTINCT i + k) AS c FROM rep, (VALUES (0), (1), (2)) o(k) GROUP BY u
), b AS (
  SELECT doc_id, lang, source, d.u, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, len(ln) AS n_lines, coalesce(c, 0)::BIGINT AS n_repeat_words,
         length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_shout
  FROM d LEFT JOIN cov USING (u)
), s AS (
  SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed,
         n_symbols::DOUBLE / greatest(word_chars, 1) AS symbol_ratio, n_upper::DOUBLE / greatest(word_chars, 1) AS upper_ratio,
         n_shout::DOUBLE / greatest(word_chars, 1) AS shout_ratio, n_dup_lines::DOUBLE / greatest(n_lines, 1) AS dup_line_ratio,
         n_repeat_words::DOUBLE / greatest(n_words, 1) AS repeat_ratio
  FROM b
), x AS (
  SELECT u, coalesce(lang, chr(1)) AS lang, coalesce(source, chr(1)) AS source, v.signal, v.x, v.allowed, v.size FROM s, LATERAL (VALUES {_ORACLE_SIGNALS}) v(signal, x, allowed, size)
), h AS (
  SELECT *, CASE WHEN x <= 0 THEN -100000 ELSE ceil(ln(x) / {math.log(GAMMA)!r}) END AS bucket FROM x
), lv AS (
  SELECT 0 AS level, lang AS l, source AS s, signal, allowed, size, bucket, count(*) AS n FROM h GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, signal, allowed, size, bucket, count(*) FROM h GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, signal, allowed, size, bucket, count(*) FROM h GROUP BY ALL
), r AS (
  SELECT *, sum(n) OVER (PARTITION BY level, l, s, signal) AS total, sum(n) OVER (PARTITION BY level, l, s, signal ORDER BY bucket) AS upto,
         CASE WHEN bucket = -100000 THEN 0.0 ELSE pow({GAMMA!r}::DOUBLE, bucket) * 2 / {GAMMA + 1!r} END AS value
  FROM lv
), q AS (
  SELECT level, l, s, signal, allowed, size, max(total) AS total, min(value) FILTER (upto > 0.5 * (total - 1)) AS q50, min(value) FILTER (upto > 0.75 * (total - 1)) AS q75,
         min(value) FILTER (upto > 0.9 * (total - 1)) AS q90
  FROM r GROUP BY ALL
), f AS (
  SELECT q.level, q.l, q.s, q.signal, q.total, least(q.q90 + {OVER_Q90} * (q.q90 - q.q50), q.q75 + {OVER_Q75} * (q.q75 - q.q50)) + q.allowed / greatest(z.q50, 1) AS fence
  FROM q JOIN q z ON z.level = q.level AND z.l IS NOT DISTINCT FROM q.l AND z.s IS NOT DISTINCT FROM q.s AND z.signal = q.size
), bad AS (
  SELECT DISTINCT x.u FROM x
  JOIN f a ON a.level = 0 AND a.l = x.lang AND a.s = x.source AND a.signal = x.signal
  JOIN f b ON b.level = 1 AND b.l = x.lang AND b.signal = x.signal
  JOIN f c ON c.level = 2 AND c.signal = x.signal
  WHERE x.x > CASE WHEN a.total >= {MIN_GROUP} THEN a.fence WHEN b.total >= {MIN_GROUP} THEN b.fence ELSE c.fence END
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.u IS NULL AS kept
FROM s LEFT JOIN bad USING (u)
"""
