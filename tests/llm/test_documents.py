import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracegrid.llm import mixing, nearcopies, packing, quality, registry, sharding, simhash, toxicity
from tracegrid.operators.graph import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def small_docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


# quality rules


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), base


def test_quality_counts(spark, small, odd_docs):
    docs = small_docs(spark, small).select("doc_id", "text", "lang", "source").unionByName(odd_docs.select("doc_id", "text", "lang", "source"))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality_signals(docs).collect())
    assert got == sorted((str(i), *counts(t)) for i, t in texts)


@pytest.mark.parametrize("hash", ["0L", "length(z.w[i])", "xxhash64(z.w[i])", "xxhash64(z.w[i], z.w[i + 1], z.w[i + 2]) % 3"])
def test_repeats_under_collisions(spark, hash):
    """Windows that share a hash, interleaved in every way, neither lose nor add a repeat."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, k, n)) for k in (2, 5, 12, 40) for n in (0, 1, 3, 4, 5, 30, 200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", quality.words_of(F.col("text")).alias("w"))
    got = {r.id: r.n for r in df.select("id", F.expr(quality.repeat_sql("w", hash)).alias("n")).collect()}
    assert got == {i: counts(t)[4] for i, t in enumerate(texts)}


def test_quality_against_sql(spark, small, duck, same):
    same(registry.op6_quality(spark, small), duck, registry.ORACLE_SQL["op6_quality"])


def test_quality_sketch_is_mergeable(spark, small):
    s = quality.quality_signals(small_docs(spark, small).select("doc_id", "lang", "source", "text"))
    whole = sorted(map(tuple, quality.sketches(s).filter("lang = 'en'").collect()))
    parts = quality.sketches(s.filter("doc_id % 2 = 0")).unionByName(quality.sketches(s.filter("doc_id % 2 = 1")))
    merged = parts.groupBy("lang", "source", "signal", "bucket").agg(F.sum("n").alias("n")).filter("lang = 'en'")
    assert sorted(map(tuple, merged.collect())) == whole


def sized(df):
    """Documents of 1,600 characters, 300 words and 6 lines: a median document's allowances are .05, .15, .05, .5 and .5."""
    return df.withColumns({"word_chars": F.lit(1600), "n_words": F.lit(300), "n_lines": F.lit(6)})


def test_quality_sketch_error(spark):
    values = [0.001 * 1.07**i for i in range(200)]
    df = spark.createDataFrame([("en", "a", v) for v in values], "lang string, source string, symbol_ratio double")
    for s in list(quality.SIGNALS)[1:]:
        df = df.withColumn(s, F.lit(0.0))
    df = sized(df)
    fence = quality.thresholds(df).first()["max_symbol_ratio"]
    q50, q90 = (sorted(values)[int(q * 199)] for q in (0.5, 0.9))
    assert abs(fence - (q90 + 3 * (q90 - q50) + 0.05)) <= 0.05 * fence


@pytest.mark.parametrize("share", [0.02, 0.12, 0.2, 0.24])
def test_quality_fence_holds_under_junk(spark, share):
    """Up to a quarter of a group may be bad by a signal: its fence lies below them and above the good ones."""
    n = 2000
    bad = int(n * share)
    rows = [("en", "a", 0.3 + 0.00001 * i if i < bad else 0.001 * (i % 7), 0.016 + 0.00001 * (i % 900)) for i in range(n)]
    df = spark.createDataFrame(rows, "lang string, source string, symbol_ratio double, upper_ratio double")
    for s in ("shout_ratio", "dup_line_ratio", "repeat_ratio"):
        df = df.withColumn(s, F.lit(0.0))
    df = sized(df)
    fences = quality.thresholds(df).first()
    assert 0.007 < fences["max_symbol_ratio"] < 0.3 and fences["max_upper_ratio"] > 0.026


def test_quality_verdict_depends_on_the_group(spark):
    """The same text is kept among short documents and rejected among long ones, and a text with symbols is kept where such
    texts are usual; the limits are the registered ones."""
    words = lambda n, i: " ".join(f"word{(i * 31 + k) % 997}{'abcdefghij'[k % 10]}" for k in range(n))
    odd = words(95, 5) + " " + "#" * 50  # symbols are some 6 % of its characters
    rows = [(i, words(70 + i % 20, i), "en", "short") for i in range(300)] + [(1000 + i, words(700 + i % 50, i), "en", "long") for i in range(300)]
    rows += [(2000 + i, words(700, i) + " #$%" * (40 + i % 60), "en", "code") for i in range(300)]
    rows += [(n, odd, "en", s) for n, s in ((5000, "short"), (5001, "long"), (5002, "code"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    verdict = {r.doc_id: (r.base_failed, r.kept) for r in quality.quality_rules(docs).collect()}
    assert [verdict[n] for n in (5000, 5001, 5002)] == [(False, True), (False, False), (False, True)]
    assert sum(kept for n, (_, kept) in verdict.items() if n < 5000) == 900
    fences = {r.t_source: r for r in quality.thresholds(quality.quality_signals(docs)).collect()}
    assert len({round(f[f"max_{s}"], 6) for f in fences.values() for s in ("symbol_ratio",)}) == 3


def test_quality_edges(odd_docs, no_docs):
    assert quality.quality_rules(odd_docs).count() == odd_docs.count()
    assert quality.quality_rules(no_docs).count() == 0
    assert quality.keep_good(odd_docs).columns == odd_docs.columns and quality.keep_good(no_docs).count() == 0


# mixing


def water(sizes, total):
    """Targets by the rule as told: share by weight, cap at twice the size, share the excess anew until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped = {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 2 * sizes[s] for s in over}


def test_mixing_targets(spark, small):
    docs = small_docs(spark, small).select("doc_id", "text", F.when(F.col("doc_id") % 10 != 0, F.col("source")).alias("source"))
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    told = water(sizes, 1.5 * sum(sizes.values()))
    got = {r.source: r.target for r in mixing.targets(mixing.thin_documents(docs, 0)).collect()}
    assert got.keys() == told.keys() and all(abs(got[s] - told[s]) < 1e-6 * max(1, told[s]) for s in told)


def test_mixing_takes_the_targets(spark, small):
    docs = small_docs(spark, small)
    source = {r.doc_id: r.source for r in docs.collect()}
    rows = mixing.taken_words(docs).collect()
    assert len(rows) == len(source) and all(0 <= r.taken <= 2 * r.size for r in rows)
    taken, target = Counter(), {}
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 50 for s in target)
    again = mixing.taken_words(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken, r.first_slot is None, r.first_slot or 0) for r in rows) == sorted((r.doc_id, r.taken, r.first_slot is None, r.first_slot or 0) for r in again)


def test_mix_is_even_everywhere(spark, small):
    """Any tenth of the mix holds each source near its share, and pieces do not overlap within a pass."""
    _, pieces = mixing.mix_sources(mixing.thin_documents(small_docs(spark, small), 0))
    rows = pieces.collect()
    slots = max(r.slot for r in rows) + 1
    source = {r.doc_id: r.source for r in small_docs(spark, small).collect()}
    whole, part = Counter(), [Counter() for _ in range(10)]
    for r in rows:
        whole[source[r.doc_id]] += r.length
        part[r.slot * 10 // slots][source[r.doc_id]] += r.length
    assert all(abs(p[s] - whole[s] / 10) <= 0.02 * whole[s] + 30 for p in part for s in whole)
    seen = defaultdict(list)
    for r in rows:
        seen[r.uid, r["pass"]].append((r.start, r.length))
    for spans in seen.values():
        spans.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:]))


def test_first_slots_follow_the_schedule(spark, small):
    """A document's first slot is the least of its pieces', and documents that the mix does not take have none."""
    every = mixing.taken_words(small_docs(spark, small)).collect()
    rows = [r for r in every if r.taken]
    assert all((r.first_slot is not None) == (r.taken > 0) for r in every)
    _, pieces = mixing.mix_sources(mixing.thin_documents(small_docs(spark, small), 0))
    first = {}
    for r in pieces.collect():
        first[r.doc_id] = min(first.get(r.doc_id, r.slot), r.slot)
    assert {r.doc_id: r.first_slot for r in rows} == first


def test_mixing_meets_small_targets(spark, small):
    """Sources of a few words beside large ones, and copies of one row as a third of all: every target is met to the word."""
    rows = [(i, "w " * (i % 90 + 1), "big") for i in range(600)] + [(7, "copy of one row", "big")] * 400 + [(1000 + i, "a b c", f"small{i}") for i in range(5)] + [(2000, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    for n_slots in (64, mixing.SLOTS):
        placed, pieces = mixing.mix_sources(mixing.thin_documents(docs, 0), n_slots)
        source = {r.uid: r for r in placed.collect()}
        assert len(source) == len(rows) and {r.source: r.source_size for r in source.values()}["small3"] == 3
        taken, lines, slots = Counter(), defaultdict(set), set()
        for r in pieces.collect():
            taken[source[r.uid].source] += r.length
            slots.add((r.slot, source[r.uid].source))
        for r in source.values():
            span = set(range(r.pos, r.pos + r.size))
            assert not span & lines[r.source]
            lines[r.source] |= span
        assert all(lines[s] == set(range(len(lines[s]))) for s in lines)
        assert all(taken[r.source] == round(r.target) for r in source.values()) and len({s for s, _ in slots}) == len(slots)


def test_mixing_edges(odd_docs, no_docs):
    rows = mixing.taken_words(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.taken_words(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0
    assert mixing.mixed_documents(odd_docs).columns == odd_docs.columns
    wordless = mixing.taken_words(odd_docs.filter("text IS NULL OR doc_id = 4")).collect()
    assert len(wordless) == 3 and {(r.size, r.target, r.taken) for r in wordless} == {(0, 0.0, 0)}


# packing


def check_packing(rows, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append(r)
    padding = 0
    for spans in sequences.values():
        spans.sort()
        end = 0
        for offset, length in spans:
            assert offset == end and length > 0
            end += length
        assert end <= 1024
        padding += 0 if end & (end - 1) == 0 else 1024 - end
    todo = Counter()
    for doc_id, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        todo[doc_id, len(ids)] += 1
        for r in pieces[doc_id, len(ids)]:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for (doc_id, n), times in todo.items():
        cover = Counter()
        for r in pieces[doc_id, n]:
            cover.update(range(r.start, r.start + r.length))
        assert cover == Counter({i: times for i in range(n)})
    return padding


def test_packing(spark, small, odd_docs, no_docs):
    docs = small_docs(spark, small)
    assert check_packing(packing.packed_digest(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()]) == 0
    assert check_packing(packing.packed_digest(odd_docs).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()]) == 0
    assert packing.packed_digest(no_docs).count() == 0


def test_packer_levels():
    """The chosen level gives the least sum of squares, by trying all."""
    rng = np.random.default_rng(3)
    p = packing.Packer(0, 16)
    for size in rng.integers(1, 16, 400):
        counts = [0, *(len(x) for x in p.open[1:16])]
        options = {0: 1 + 2 * counts[size]} | {h: 1 - 2 * counts[h] + (0 if h + size == 16 else 1 + 2 * counts[h + size]) for h in range(1, 17 - size) if counts[h]}
        assert options[p.level_for(int(size))] == min(options.values())
        p.add(0, np.zeros(size, "<u4"))
        assert [0, *(len(x) for x in p.open[1:16])] == [0, *map(int, p.counts[1:16])]


def test_encoder_agrees_on_any_text():
    """Random Unicode, long words and runs of white space: the faster form of the vocabulary gives the tokenizer's ids."""
    import random

    encode, whole = packing.token_encoder(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(9)
    kinds = [range(32, 127), range(9, 14), range(0xA0, 0x250), range(0x370, 0x530), range(0x5D0, 0x700), range(0x900, 0xA00), range(0x2000, 0x2070), range(0x300, 0x370), range(0x4E00, 0x5000), range(0xAC00, 0xAD00), range(0x1F300, 0x1F700), range(0xFE00, 0xFE10), range(0, 32), range(0xD7B0, 0xD800), range(0xE000, 0xE010), range(0x10000, 0x10100)]
    texts = ["".join(chr(rng.choice(rng.choice(rng.sample(kinds, 3)))) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += [" " * 3000, "\n" * 3000 + "x", "a" * 1_000_000, "".join(rng.choices("abcdefgh", k=1_000_000)), "漢" * 100_000, "1" * 50_000, "e\u0301" * 20_000]
    for text in texts:
        assert list(encode(text)) == [*whole.encode(text, add_special_tokens=False).ids, 0]


def test_encoder_agrees_with_tokenizer():
    encode, whole = packing.token_encoder(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("", "a b  c\n\n d", "Ünï 漢字 😀", "x" * 5000, "<|endoftext|> y", "\x00\x1f'll 1234567"):
        assert list(encode(text)) == [*whole.encode(text, add_special_tokens=False).ids, 0]


# sharding


def test_sharding(spark, small):
    docs = small_docs(spark, small)
    rows, path = sharding.shard_documents(docs)
    rows = rows.collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        assert r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(rows) == len(text) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    largest = max(r.size for r in rows)
    assert max(load.values()) - min(load.values()) <= largest
    first, last = (spark.read.parquet(f"{path}/version={v}").collect() for v in (0, 1))
    assert len(first) == len(last) == sharding.SLOTS
    before = {r.vslot: r.shard for r in first}
    moved = {r.vslot for r in last if before[r.vslot] != r.shard}
    assert len(moved) < sharding.SLOTS / 4


def test_rebalancing_moves_little():
    owner, moves = sharding.rebalanced([i % 4 for i in range(64)], [i * 37 % 101 for i in range(64)], 4)
    load = Counter()
    for i, s in enumerate(owner):
        load[s] += i * 37 % 101
    assert max(load.values()) - min(load.values()) <= 10 and len(moves) < 16
    assert sharding.rebalanced([0, 1], [0, 0], 2) == ([0, 1], [])


@pytest.mark.parametrize("part_rows", [sharding.PART_ROWS, 20])
def test_sharding_of_copies(spark, monkeypatch, part_rows):
    """A third of all rows are copies of one record, a third share an id or have none: shards stay even, slots gapless."""
    monkeypatch.setattr(sharding, "PART_ROWS", part_rows)
    rows = [(1, "the copy")] * 900 + [(2, f"text {i}") for i in range(450)] + [(None, None)] * 450 + [(i, f"text {i}") for i in range(3, 903)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard_documents(docs, 8, 1024)[0].collect()
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((i, zlib.crc32((t or "").encode())) for i, t in rows)
    load, places = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    assert max(load.values()) - min(load.values()) <= 0.05 * sum(load.values()) / 8
    again = sharding.shard_documents(docs.repartition(3), 8, 1024)[0].collect()
    assert Counter((r.doc_id, r.text_crc32, r.vslot, r.shard) for r in got) == Counter((r.doc_id, r.text_crc32, r.vslot, r.shard) for r in again)


def test_sharding_edges(odd_docs, no_docs):
    rows = sharding.shard_documents(odd_docs)[0].collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.shard < 40 for r in rows)
    assert sharding.shard_documents(no_docs)[0].count() == 0


# near-duplicates


def brute_print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def brute_components(prints):
    up = list(range(len(prints)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 3:
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return [(doc, f"{a:016x}", least.get(top(i))) for i, (doc, a) in enumerate(prints)]


def test_simhash_brute_force(spark, small, odd_docs):
    docs = small_docs(spark, small).select("doc_id", "text").unionByName(odd_docs.select(F.col("doc_id") + 100_000, "text").toDF("doc_id", "text"))
    edited = small_docs(spark, small).filter("n_chars > 3000").select((F.col("doc_id") + 200_000).alias("doc_id"), F.concat(F.lit("Extra "), F.col("text")).alias("text"))
    docs = docs.unionByName(edited)
    told = brute_components([(r.doc_id, brute_print(r.text)) for r in docs.collect()])
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, told))
    assert any(i is not None and c != i for i, _, c in told)


def test_simhash_uses_spark_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first().h == simhash.fingerprint("a b c")


@pytest.mark.parametrize("chunk", [4, 2048])
def test_links_of_a_large_group(spark, chunk):
    """A chain of fingerprints that share most bits, in one task's group or dealt out as chunks."""
    base = 0x123456789ABCDEF0
    chain = {base}
    for i in range(40):
        chain.add(base ^ (1 << i % 20) ^ (1 << (i * 7 + 3) % 20))
    chain |= {(base ^ 0xFFFF_0000_FFFF_0000), 0}
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in chain]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.fingerprint_links(nodes, chunk)
    root = {r.node: r.root for r in connected_components(links, [], "a", "b").collect()}
    groups = defaultdict(set)
    for x in signed:
        groups[root.get(x, x)].add(x)
    told = defaultdict(set)
    for i, _, c in brute_components([(x, x & (1 << 64) - 1) for x in signed]):
        told[c].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, told.values()))


def test_pivot_table(spark):
    """Distances are those to all pivots, and pairs within 3 bits share a cell of every pivot."""
    rng = np.random.default_rng(11)
    fps = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    near = fps ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(fps.view(np.int64), near.view(np.int64))], "a long, b long")
    for depth in (0, 1, 3, 6):
        cells = lambda c: simhash.cells_of(simhash.distances(F.col(c)), F.lit(27), F.lit(depth))
        rows = df.select("a", simhash.distances(F.col("a")).alias("d"), F.arrays_overlap(cells("a"), cells("b")).alias("meet"), F.size(cells("a")).alias("n")).collect()
        assert all(r.meet for r in rows) and max(r.n for r in rows) <= 2**depth
    pivots = simhash.pivots()
    assert all(list(r.d) == [int(np.uint64(r.a & (1 << 64) - 1) ^ p).bit_count() for p in pivots] for r in rows)


def test_only_pivots_decide():
    """Members of one group of blocks: pairs leave by the pivot table alone, and never a pair that links."""
    rng = np.random.default_rng(12)
    fps = np.unique(rng.integers(0, 1 << 38, 900, dtype=np.uint64))
    table = np.bitwise_count(fps[:, None] ^ simhash.pivots()[None, :]).astype(np.int8)
    i, j = simhash.near_pairs(np.ascontiguousarray(table.T), np.ascontiguousarray(table.T))
    told = {(x, y) for x in range(len(fps)) for y in range(len(fps)) if np.abs(table[x].astype(int) - table[y]).max() <= 3}
    assert set(zip(i.tolist(), j.tolist())) == told and len(told) < 0.05 * len(fps) ** 2
    assert all((x, y) in told for x in range(0, len(fps), 7) for y in range(len(fps)) if (int(fps[x]) ^ int(fps[y])).bit_count() <= 3)


def test_group_with_many_survivors():
    """Above 200,000 pairs of one group pass all pivots; the stars are those of a brute force."""
    base = 0x0F0F_3C3C_5A5A_9999
    fps = np.array([base ^ x for x in range(2048)], dtype=np.uint64)
    table = np.bitwise_count(fps[:, None] ^ simhash.pivots()[None, :]).astype(np.int8)
    columns = np.ascontiguousarray(table.T)
    assert len(simhash.near_pairs(columns, columns)[0]) > 200_000
    stars = dict(simhash.linked_stars(fps, table))
    told = brute_components([(int(x), int(x)) for x in fps])
    assert all(stars.get(i, i) == c for i, _, c in told)


@pytest.mark.parametrize("crowd", [2, 16])
def test_links_with_cells_of_pivots(spark, crowd):
    """A large group of random members and near pairs, met through the cells of up to 6 pivots."""
    rng = np.random.default_rng(14)
    fps = set(rng.integers(0, 1 << 38, 500).tolist())
    fps |= {x ^ (1 << int(rng.integers(38))) ^ (1 << int(rng.integers(38))) for x in list(fps)[:200]}
    nodes = spark.createDataFrame([(x,) for x in sorted(fps)], "fp long")
    root = {r.node: r.root for r in connected_components(simhash.fingerprint_links(nodes, 64, crowd), [], "a", "b").collect()}
    assert all(root.get(i, i) == c for i, _, c in brute_components([(x, x) for x in sorted(fps)]))


def test_keep_first(odd_docs, no_docs):
    kept = simhash.keep_first(odd_docs)
    groups = {r.component_id for r in simhash.near_duplicates(odd_docs).collect()}
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == groups
    assert kept.count() == len(groups) and simhash.keep_first(no_docs).count() == 0 and simhash.near_duplicates(no_docs).count() == 0


def test_pipeline_drops_near_copies(spark, odd_docs, no_docs):
    """Copies with edits: fingerprints of 3-word shingles differ by more than 3 bits, 5-word shingles agree to 0.8 or more."""
    rng = np.random.default_rng(5)
    sets = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
    rows, far = [], 0
    for f in range(40):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        near, other = list(base), list(base)
        near[40] = near[80] = "edited"
        for i in range(5, 120, 12):
            other[i] = "rewritten"
        a, b, c = sets(base), sets(near), sets(other)
        assert len(a & b) >= 0.8 * len(a | b) and len(a & c) < 0.8 * len(a | c)
        far += (brute_print(" ".join(base)) ^ brute_print(" ".join(near))).bit_count() > 3
        rows += [(3 * f, " ".join(base)), (3 * f + 1, " ".join(near)), (3 * f + 2, " ".join(other))]
    assert far > 10
    import corpus_pipeline as P

    kept = dict(P.STAGES)["near duplicates"](spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    assert sorted(r.doc_id for r in kept) == [i for i, _ in rows if i % 3 != 1]
    odd = nearcopies.keep_first(odd_docs)
    assert odd.columns == odd_docs.columns and nearcopies.keep_first(no_docs).count() == 0
    assert sorted(map(str, (r.doc_id for r in odd.collect()))) == sorted(map(str, [1, 2, 5, 7, 8, 9, None]))


@pytest.mark.parametrize("chunk", [4, 512])
def test_verified_links_of_a_large_family(spark, chunk):
    """A chain of edits, in one task's group or dealt out as chunks: the same components as all pairs give."""
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(30):
        base = list(base)
        base[i * 53 % 200] = f"e{i}"
        texts.append(" ".join(base))
    docs = spark.createDataFrame(list(enumerate(texts)), "uid long, text string")
    nodes = docs.select("uid", nearcopies.sketch_of("text").alias("s")).select("uid", "s.words", "s.keys")
    links = nearcopies.verified_links(nodes, docs, chunk)
    roots = {r.node: r.root for r in connected_components(links, [], "a", "b").collect()}
    assert roots == dict.fromkeys(range(30), 0)


# toxicity


def test_toxicity_held_out(spark, small):
    big = small.replace("sf0.001", "sf0.01")
    rows = registry.op1_toxicity(spark, big).collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    toxic, clean = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum(s > t for s in toxic for t in clean) + 0.5 * sum(s == t for s in toxic for t in clean) > 0.85 * len(toxic) * len(clean)


def test_toxicity_never_sees_held_out_labels(spark, small):
    docs, labels = small_docs(spark, small), spark.read.parquet(f"{small}/labels.parquet")
    wrong = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.toxicity_scores(docs, x).collect())) for x in (labels, wrong))
    assert a == b


def brute_features(text, lexicon):
    """The features by their definitions, one token after the other."""
    text = text or ""
    tokens = text.lower().split()
    seen = {}
    for token in set(tokens):
        plain = re.sub(r"^\W+|\W+$", "", token)
        plain = plain if plain.isalpha() else re.sub(r"[\W_]", "", "".join(dict(zip("013457@$!|", "oieastasil")).get(c, c) for c in plain))
        names = [[plain] * bool(plain), [f"{n}{plain[:n]}" for n in (4, 5) if len(plain) > n]]
        weigh = lambda t: toxicity.weight(*lexicon.counts[t], lexicon.toxic, lexicon.clean) if lexicon.counts.get(t, (0, 0))[0] else 0.0
        seen[token] = [max([0.0, *map(weigh, x)]) for x in names] + [bool(re.search(r"[^\W\d_].*[\d@$*|!_].*[^\W\d_]|[^\W\d_][.\-*_][^\W\d_][.\-*_][^\W\d_]", token))]
    rows = [seen[t] for t in tokens]
    hits = [i for i, r in enumerate(rows) if r[0] > 0 or r[1] > 0]
    near = sum(any(tokens[j] in toxicity.SECOND_PERSON for j in range(max(0, i - 5), i + 6) if j < len(tokens)) for i in hits) / len(hits) if hits else 0.0
    n, chars = max(1, len(tokens)), max(1, len(text))
    return [
        sum(r[0] for r in rows) / n, max([0.0, *(r[0] for r in rows)]), float(min(20, len({t for t, r in zip(tokens, rows) if r[0] > 0}))), sum(r[1] for r in rows) / n, max([0.0, *(r[1] for r in rows)]), near,
        sum(c.isupper() for c in text) / chars, sum(c in "!?" for c in text) / chars, sum(c in ".,;:" for c in text) / chars, sum(r[2] for r in rows) / n, float(np.log1p(len(tokens))),
    ]


def test_toxicity_features(spark, small, odd_docs):
    """Features of every small document and of odd texts against a brute force, with a lexicon of common and odd words."""
    texts = [r.text for r in small_docs(spark, small).collect()] + [r.text for r in odd_docs.collect()]
    texts += ["You 1d10t!! YOU are an i.d.i.o.t, Ünïcode É you", "a_b c.d.e f-g-h x@y $tupid", "IDIOT " * 500, "x" * 20_000 + " idiot du"]
    words = Counter(toxicity.plain(t) for text in texts for t in (text or "").lower().split())
    counts = {w: (3 + i % 5, i % 4) for i, (w, _) in enumerate(words.most_common(60)) if w} | {"idiot": (9, 0), "4idio": (5, 1), "5stupi": (4, 0), "tupid": (2, 0)}
    lexicon = toxicity.Lexicon(counts, 100, 400)
    for text in texts:
        assert lexicon.features(text) == pytest.approx(brute_features(text, lexicon), rel=1e-9)


def test_training_rows_are_bounded(spark):
    """Copies count once and many texts under one id do not pass the bound."""
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(7, "the copy")] * 500 + [(8, f"text {i}") for i in range(3000)] + [(i, f"row {i}") for i in range(40)], "doc_id long, text string").repartition(4)
    rows = toxicity.training_rows(docs, labels, 200).collect()
    assert 100 < len(rows) < 300 and len(set(map(tuple, rows))) == len(rows)
    few = toxicity.training_rows(docs.filter("doc_id <> 8"), labels, 200).collect()
    assert sorted(r.doc_id for r in few) == sorted([i for i in range(40) if i != 8 and zlib.crc32(str(i).encode()) % 3 != 1] + [7])


def test_toxicity_edges(spark, odd_docs, no_docs):
    schema = "doc_id long, quality int, toxic int, score double"
    none = spark.createDataFrame([], schema)
    one = spark.createDataFrame([(1, 1, 0, None), (None, 1, 1, None), (2, None, None, None)], schema)
    for labels in (none, one):
        assert {r.score for r in toxicity.toxicity_scores(odd_docs, labels).collect()} == {0.0}
    assert toxicity.toxicity_scores(no_docs, none).count() == 0
    mixed = spark.createDataFrame([(i, 1, i % 2, None) for i in range(80)], schema)
    docs = spark.createDataFrame([(i, f"you are an idiot, number {i} today" if i % 2 else f"a fine and sunny day {i}") for i in range(80)] + [(150, None), (151, ""), (None, "x")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, mixed).collect()}
    assert got[1] > 0.7 > got[2] and len(got) == 83
    assert toxicity.keep_clean(odd_docs, none).columns == odd_docs.columns


def test_obfuscated_words():
    assert [toxicity.plain(x) for x in ("1d10t!", "i.d.i.o.t", "\"fine\"", "$tupid", "—")] == ["idiot", "idiot", "fine", "tupid", ""]


# the pipeline


def test_pipeline_stages(spark, small):
    import corpus_pipeline as P

    docs = small_docs(spark, small)
    good = P.quality_stage(spark, docs, small)
    verdict = {r.doc_id: r.kept for r in quality.quality_rules(docs).collect()}
    assert good.columns == docs.columns and sorted(r.doc_id for r in good.collect()) == sorted(i for i, k in verdict.items() if k)
    clean = P.toxicity_stage(spark, good, small)
    score = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(good, spark.read.parquet(f"{small}/labels.parquet")).collect()}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, p in score.items() if not p)
    single = P.near_duplicate_stage(spark, clean, small)
    told = brute_components([(r.doc_id, brute_print(r.text)) for r in clean.collect()])
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, _, c in told})
    mixed = P.mixing_stage(spark, single, small)
    copies = Counter(r.doc_id for r in mixed.collect())
    sizes = {r.doc_id: r for r in mixing.taken_words(single).collect()}
    assert mixed.columns == docs.columns and all(copies[i] == -(-r.taken // r.size) for i, r in sizes.items())
    packed = P.packing_stage(spark, mixed, small).collect()
    assert check_packing(packed, [(r.doc_id, r.text) for r in mixed.collect()]) == 0


def test_pipeline_run(spark, small):
    import corpus_pipeline as P

    assert [name for name, _ in P.STAGES] == ["quality rules", "toxicity", "near duplicates", "mixing", "packing"]
    assert json.dumps(P.ORACLE_SQL) == "null" and P.run(spark, small).count() > 0
