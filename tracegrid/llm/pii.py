"""Personal data: fixed rules first, then identifiers that the rules miss, found by bootstrapping from their contexts.

The rules' spans are the seeds. A mention is a seed or a candidate, that is a string with the looks of an identifier that
no rule takes (numbers of 7 to 19 digits, ``name@host`` without a dot, ``name (at) host (dot) net``, long addresses with
colons). The patterns of a mention are its lexical contexts: the one or two words before it and after it, in lower case.
Mentions of the same normalised value are one instance, so patterns and instances make a graph, which Spark scores in
rounds: a pattern's precision is the scores of the mentions that it meets over *all* occurrences of its words in the
corpus, and it is trusted from ``LEAST`` different trusted instances and a precision of ``FAIR`` on; an instance has the
best precision before it and the best one behind it, joined as 1 - (1 - a)(1 - b). Instances of ``TRUST`` or more are
identifiers wherever their mentions stand, so a later round trusts patterns by what an earlier one found.

Words are counted only if a bitmap of fixed size (1 MB) may hold them as a pattern; false hits leave by the exact join.
Counts go up by partial sums and all edges of the graph are equal-value joins of small tables, none of which is collected.

Defined results: a null or empty text has no spans; every row has a result row, also rows without an id and repeated
ones; copies of a text add no instances; positions are code points, ends exclusive; base spans stay whatever is found,
and found spans never overlap them; words longer than ``LONGEST`` characters are in no pattern; scores are rounded to 9
digits before they are held against a bound, so that the order of sums does not matter. An empty table gives an empty
result. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ["email", "ip", "card", "phone"]
#: Trusted instances of a trusted pattern, its precision, an instance's score, rounds.
LEAST, FAIR, TRUST, ROUNDS = 5, 0.5, 0.8, 5
#: Digits of numbers that may be a card or a phone.
CARD_DIGITS, PHONE_DIGITS, PHONE_LIKE = (12, 19), (9, 15), (7, 15)
LONGEST, AROUND = 64, 256
#: Bits of the bitmap of patterns' words, in pieces of Spark's bitmap size.
BITS, PIECE = 1 << 23, 1 << 15

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# one start for a run of digits, as later ones in it fail alike
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20\-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9\-]+[0-9]")
_NUMBER = re.compile(r"[0-9(][0-9\x20().\-/]{5,40}[0-9]")
_HOST = re.compile(r"@[\w-]+(?:\.[\w-]+)*")
_SPELT = re.compile(r"[\[({<]\x20?(?:at|AT|At)\x20?[\])}>]\x20?[A-Za-z0-9-]+(?:(?:\.|\x20?[\[({<]\x20?(?:dot|DOT|Dot)\x20?[\])}>]\x20?)[A-Za-z0-9-]+)*")
_DOT = re.compile(r"\x20?[\[({<]\x20?(?:dot|DOT|Dot)\x20?[\])}>]\x20?")
_AT = re.compile(r"\x20?[\[({<]\x20?(?:at|AT|At)\x20?[\])}>]\x20?")
_COLONS = re.compile(r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}")
_SIGN = re.compile(r"[0-9@:\[({<]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def email_spans(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses. A local part holds no ``@``, so it is the run of its characters before one."""
    end = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        low = max(end, text.rfind("@", 0, at) + 1)
        start = low + len(text[low:at].rstrip(_LOCAL))
        if start < at:
            end = m.end()
            yield start, end


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the fixed rules, in order; kinds by their place in ``KINDS``."""
    if not _SIGN.search(text):
        return []
    found = [(a, 0, b) for a, b in email_spans(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if CARD_DIGITS[0] <= m.end() - m.start() <= 2 * CARD_DIGITS[1]:
            digits = digits_of(m.group())
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if PHONE_DIGITS[0] <= len(digits_of(m.group())) <= PHONE_DIGITS[1]]
    return sorted(found)


def value_of(kind: int, text: str) -> str:
    """What mentions of the same identifier share."""
    if kind == 0:
        return _AT.sub("@", _DOT.sub(".", text)).lower()
    return text.lower() if kind == 1 else digits_of(text)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, list[int]]]:
    """(start, end, kinds that it may be) of strings with the looks of an identifier that are no base span, none of them
    overlapping another or a base span."""
    taken = [(a, b) for a, _, b in base]
    found = []
    if "@" in text:
        for m in _HOST.finditer(text):
            low = text.rfind("@", 0, m.start()) + 1
            local = len(text[low : m.start()].rstrip(_LOCAL)) + low
            if local < m.start():
                found.append((local, m.end(), [0]))
    low = 0
    for m in _SPELT.finditer(text):
        at = m.start() - (text[m.start() - 1 : m.start()] == " " and m.start() > low)
        local = low + len(text[low:at].rstrip(_LOCAL))
        if local < at:
            found.append((local, m.end(), [0]))
        low = m.end()
    if text.count(":") >= 3:
        found += [(m.start(), m.end(), [1]) for m in _COLONS.finditer(text) if not (text[m.start() - 1 : m.start()] or " ").isalnum() and not (text[m.end() : m.end() + 1] or " ").isalnum()]
    for m in _NUMBER.finditer(text):
        n = len(digits_of(m.group()))
        before, behind = text[m.start() - 1 : m.start()] if m.start() else " ", text[m.end() : m.end() + 1] or " "
        kinds = [k for k, (lo, hi) in ((2, CARD_DIGITS), (3, PHONE_LIKE)) if lo <= n <= hi]
        if kinds and not (before.isalnum() or before in "_.+-@") and not (behind.isalnum() or behind == "_"):
            found.append((m.start(), m.end(), kinds))
    out, spans = [], sorted([(a, b, None) for a, b in taken] + found, key=lambda s: (s[0], s[2] is not None, -s[1]))
    ends = iter(sorted(taken))
    nxt, free = next(ends, None), 0
    for a, b, kinds in spans:
        while nxt is not None and nxt[1] <= a:
            nxt = next(ends, None)
        if kinds is None:
            free = max(free, b)
        elif a >= free and (nxt is None or nxt[0] >= b):
            out.append((a, b, kinds))
            free = b
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """Patterns of a mention: ``<`` or ``>`` for before and after, then one or two words."""
    before, after = text[max(0, start - AROUND) : start].lower().split()[-2:], text[end : end + AROUND].lower().split()[:2]
    fit = lambda words: all(len(w) <= LONGEST for w in words)
    grams = [("<", before[-1:]), ("<", before), (">", after[:1]), (">", after)]
    return sorted({side + " ".join(g) for side, g in grams if g and fit(g)})


_MENTION = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kinds", pa.list_(pa.int32())), ("values", pa.list_(pa.string())), ("seed", pa.bool_()), ("contexts", pa.list_(pa.string()))]))
_BASE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_FOUND = "doc_id long, base array<struct<start:bigint,kind:int,end:bigint>>, mentions array<struct<start:bigint,end:bigint,kinds:array<int>,values:array<string>,seed:boolean,contexts:array<string>>>"


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans and mentions of each document (doc_id, text)."""
    for batch in batches:
        base, mentions = [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            spans = base_spans(text)
            rest = candidates(text, spans) if _SIGN.search(text) else []
            base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
            every = [(a, b, [k], True) for a, k, b in spans] + [(a, b, kinds, False) for a, b, kinds in rest]
            mentions.append([{"start": a, "end": b, "kinds": kinds, "values": [value_of(k, text[a:b]) for k in kinds], "seed": seed, "contexts": contexts(text, a, b)} for a, b, kinds, seed in every])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _BASE), pa.array(mentions, _MENTION)], names=["doc_id", "base", "mentions"])


class _Hits(dict):
    """Whether a bitmap may hold a string; answers are kept for the next time."""

    def __init__(self, bits: bytes):
        self.bits = bits

    def __missing__(self, gram: str) -> bool:
        at = zlib.crc32(gram.encode("utf-8", "surrogatepass")) % BITS
        hit = bool(self.bits[at >> 3] >> (at & 7) & 1)
        if len(self) > 1 << 20:
            self.clear()
        self[gram] = hit
        return hit


def bitmap(grams: DataFrame) -> bytes:
    """A bitmap of ``BITS`` bits over the column ``gram``; 256 pieces of 4 KB come to the driver, whatever the input."""
    at = F.crc32(F.col("gram").cast("binary")) % BITS
    pieces = grams.select(at.alias("at")).groupBy(F.floor(F.col("at") / PIECE).cast("int").alias("piece")).agg(F.bitmap_construct_agg(F.col("at") % PIECE).alias("bits")).collect()
    out = bytearray(BITS // 8)
    for row in pieces:
        out[row["piece"] * PIECE // 8 : (row["piece"] + 1) * PIECE // 8] = bytes(row["bits"])
    return bytes(out)


def gram_counts(texts: DataFrame, grams: DataFrame) -> DataFrame:
    """(gram, n): how often the one or two words of ``gram`` stand in a row in all ``texts`` (text), in lower case."""
    whole, firsts = bitmap(grams), bitmap(grams.filter(F.instr("gram", " ") > 0).select(F.substring_index("gram", " ", 1).alias("gram")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, first, two = _Hits(whole), _Hits(firsts), _Hits(whole)
        for batch in batches:
            n: Counter = Counter()
            for text in batch.column(0):
                words = (text.as_py() or "").lower().split()
                for w, times in Counter(words).items():
                    if one[w]:
                        n[w] += times
                pairs = (f"{words[i]} {words[i + 1]}" for i in [i for i, w in enumerate(words[:-1]) if first[w]])
                n.update(p for p in pairs if two[p])
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["gram", "n"])

    counted = texts.select("text").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return counted.join(grams, "gram", "left_semi")


def graph(mentions: DataFrame) -> DataFrame:
    """(kind, context, value, n, seed): which instance stands in which context, and how often; contexts of fewer than
    ``LEAST`` instances of a kind are left out, as no round can trust them."""
    edges = mentions.select("kind", "value", "seed", F.explode("contexts").alias("context")).groupBy("kind", "context", "value").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))
    common = edges.groupBy("kind", "context").agg(F.count(F.lit(1)).alias("instances")).filter(F.col("instances") >= LEAST).drop("instances")
    return edges.join(common, ["kind", "context"])


def scored(edges: DataFrame, seeds: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, value, score) of instances after ``rounds``: of seeds 1, of others by the patterns that they stand in.

    ``counts`` is (gram, n), the occurrences of the patterns' words.
    """
    scores = seeds.select("kind", "value", F.lit(1.0).alias("score"))
    by_words = edges.withColumn("gram", F.substring("context", 2, 1 << 30))
    uses = by_words.groupBy("kind", "context", "gram").agg(F.sum("n").alias("met")).join(counts, "gram", "left")
    totals = cut(uses.select("kind", "context", F.greatest(F.coalesce("n", F.lit(0)), "met").alias("total")), "pattern-totals")
    for _ in range(rounds):
        met = edges.join(scores, ["kind", "value"])
        worth = met.groupBy("kind", "context").agg(F.sum(F.col("n") * F.col("score")).alias("mass"), F.count(F.when(F.col("score") >= TRUST, 1)).alias("trusted"))
        precision = F.round(F.col("mass") / F.col("total"), 9)
        patterns = worth.join(totals, ["kind", "context"]).withColumn("precision", precision).filter((F.col("trusted") >= LEAST) & (F.col("precision") >= FAIR)).select("kind", "context", "precision")
        best = lambda side: F.coalesce(F.max(F.when(F.startswith("context", F.lit(side)), F.col("precision"))), F.lit(0.0))
        drawn = edges.join(patterns, ["kind", "context"]).groupBy("kind", "value").agg(F.round(1 - (1 - best("<")) * (1 - best(">")), 9).alias("score"))
        fresh = drawn.join(seeds, ["kind", "value"], "left_anti")
        scores = cut(seeds.select("kind", "value", F.lit(1.0).alias("score")).unionByName(fresh), "instance-scores")
    return scores


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of structs (start, kind, end), comma-joined in their order."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def personal_data(documents: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of ``documents`` (doc_id, text)."""
    found = cut(documents.select("doc_id", "text").mapInArrow(read, _FOUND).withColumn("uid", F.monotonically_increasing_id()), "mentions")
    each = found.select("uid", F.explode("mentions").alias("m")).select("uid", "m.start", "m.end", "m.seed", "m.contexts", F.explode(F.arrays_zip("m.kinds", "m.values")).alias("k"))
    mentions = each.select("uid", "start", "end", "seed", "contexts", F.col("k.kinds").alias("kind"), F.col("k.values").alias("value"))
    seeds = cut(mentions.filter("seed").select("kind", "value").distinct(), "seeds")
    edges = cut(graph(mentions), "pattern-edges")
    grams = cut(edges.select(F.substring("context", 2, 1 << 30).alias("gram")).distinct(), "pattern-words")
    scores = scored(edges, seeds, gram_counts(documents, grams))
    known = scores.filter(F.col("score") >= TRUST)
    drawn = mentions.filter("NOT seed").join(known, ["kind", "value"])
    chosen = drawn.groupBy("uid", "start", "end").agg(F.min(F.struct(-F.col("score"), "kind"))["kind"].alias("kind"))
    more = chosen.groupBy("uid").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    both = F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
    return found.join(more, "uid", "left").select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(both).alias("spans"))
