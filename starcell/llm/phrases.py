"""Phrase collocations: all phrases of two to four words, counted, scored and ranked per language.

Phrases are counted length by length in tasks that read whole texts. A task keeps its counts
in a HAT-trie: a shallow trie over word ids whose leaves are hash containers, each for a range
of first words. A container that grows too large bursts into two, cut between first words, or
between second words where one first word fills it. When the trie as a whole is full, its
largest subtrees are spilled as sorted runs of (phrase, count). Runs are stored, dealt by
ranges of phrases (so a prefix that holds very many is spread over parts), and merged there.

A phrase is frequent only if its parts are. What a pass found frequent therefore goes to the
next one as a bitmap of fixed size; a phrase with a part that is not in it is not counted. Bits
that several phrases share only let some be counted in vain. Counts are exact: phrases are
compared by their words, and hashes serve the bitmaps and containers alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starcell.llm.shared import BLOCK_BYTES, LOWER, MIX_A, MIX_B, mixed, row_blocks, run_hashes, stored, text_bytes

MOST_WORDS = 4
MIN_COUNT = 30
SCALE = 2_000_000
COVERED_PCT = 80
TOP = 2000
UNKNOWN = "und"

# Entries of a container before it bursts, of a trie before it spills, and words with an id in a task.
BURST = 1 << 16
FULL = 1 << 21
MOST_IDS = 1 << 20
# Bits of a bitmap of frequent phrases: 16 MB, which is what a broadcast of it takes at any size.
BITMAP_BITS = 1 << 27
_BUCKET = 32768

# Bytes that end a piece, and those that part words.
IS_STOP = np.zeros(256, bool)
IS_STOP[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
IS_GAP = np.zeros(256, bool)
IS_GAP[list(b" \t")] = True
_PART = IS_STOP | IS_GAP

RUNS = "lang string, phrase string, n bigint"


class Container:
    """Counts by a key of two 64-bit numbers (four word ids), in an open hash table."""

    def __init__(self, slots: int = 1 << 10):
        self.size = 0
        self._clear(slots)

    def _clear(self, slots: int) -> None:
        self.high, self.low = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.counts = np.zeros(slots, np.int64)         # 0: free

    def add(self, high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> None:
        """Add to the counts of keys, which may repeat; the table stays at most half full."""
        at = 0
        while at < len(high):
            part = slice(at, at + len(self.counts) // 4)
            if 2 * self.size + 2 * len(high[part]) > len(self.counts):
                held = self.entries()
                self.size = 0
                self._clear(2 * len(self.counts))
                self._insert(*held)
            self._insert(high[part], low[part], counts[part])
            at = part.stop

    def _insert(self, high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> None:
        mask = np.int64(len(self.counts) - 1)
        slots = mixed(high * MIX_A + low * MIX_B).astype(np.int64) & mask
        todo = np.arange(len(high))
        while len(todo):
            at = slots[todo]
            free = np.flatnonzero(self.counts[at] == 0)
            if len(free):
                # Of the rows that want a free slot the last one gets it.
                claim = -1 - todo[free]
                self.counts[at[free]] = claim
                free = free[self.counts[at[free]] == claim]
                won = todo[free]
                self.high[at[free]], self.low[at[free]], self.counts[at[free]] = high[won], low[won], counts[won]
                self.size += len(won)
                left = np.ones(len(todo), bool)
                left[free] = False
                todo, at = todo[left], at[left]
            same = (self.high[at] == high[todo]) & (self.low[at] == low[todo])
            np.add.at(self.counts, at[same], counts[todo[same]])
            todo = todo[~same]
            slots[todo] = (slots[todo] + 1) & mask

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.counts)
        return self.high[at], self.low[at], self.counts[at]


class HatTrie:
    """Containers for ranges of (first word, second word), in order; see the module."""

    def __init__(self, burst: int = BURST):
        self.burst = burst
        self.bounds = np.zeros(1, np.uint64)            # the least first and second word of each container
        self.held = [Container()]

    def __len__(self) -> int:
        return sum(c.size for c in self.held)

    def add(self, high: np.ndarray, low: np.ndarray) -> None:
        ones = np.ones(len(high), np.int64)
        if len(self.held) == 1:
            self.held[0].add(high, low, ones)
        else:
            owner = np.searchsorted(self.bounds, high, "right") - 1
            order = np.argsort(owner, kind="stable")
            cuts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(self.held)))))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                rows = order[cuts[k]:cuts[k + 1]]
                self.held[k].add(high[rows], low[rows], ones[rows])
        for k in range(len(self.held) - 1, -1, -1):
            self._burst(k)

    def _burst(self, k: int) -> None:
        if self.held[k].size <= self.burst:
            return
        high, low, counts = self.held[k].entries()
        first = high >> np.uint64(32)
        # Between first words if there are several, else between the second words of the one.
        keys = first << np.uint64(32) if first.min() != first.max() else high
        ordered = np.sort(keys)
        cut = ordered[len(ordered) // 2]
        if cut == ordered[0]:
            later = ordered[ordered > cut]
            if not len(later):
                return                                  # one pair of words; longer phrases share it
            cut = later[0]
        halves = []
        for rows in (keys < cut, keys >= cut):
            half = Container(max(1 << 10, 1 << int(2 * rows.sum()).bit_length()))
            half.add(high[rows], low[rows], counts[rows])
            halves.append(half)
        self.held[k:k + 1] = halves
        self.bounds = np.insert(self.bounds, k + 1, cut)
        self._burst(k + 1)
        self._burst(k)

    def spill(self, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Entries of the largest subtrees, taken out one by one until at most `keep` entries are left."""
        while len(self) > keep:
            k = max(range(len(self.held)), key=lambda i: self.held[i].size)
            entries = self.held[k].entries()
            self.held[k] = Container()
            yield entries


def lang_seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def word_hashes(words: pa.Array, seeds: np.ndarray | np.uint64) -> np.ndarray:
    """Hashes of words (none empty) in the languages of the seeds."""
    data, starts = text_bytes(words)
    return mixed(run_hashes(data, starts[:-1], starts[1:]) ^ seeds)


def chain_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each place on, from hashes of words."""
    out = hashes[:max(0, len(hashes) - n + 1)].copy()
    for k in range(1, n):
        out *= MIX_A
        out ^= hashes[k:k + len(out)]
        out = mixed(out)
    return out


class Frequent:
    """A bitmap of phrases of one length; it never misses one that was put in."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.mask = np.uint64(len(bits) * 8 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes & self.mask).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def bitmap(frequent: DataFrame, n: int, size: int = BITMAP_BITS) -> np.ndarray:
    """The bits of all (lang, phrase) of n words, brought together in buckets of 4 KB by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = {lang: lang_seed(lang) for lang in pc.unique(batch.column("lang")).to_pylist()}
            seeds = np.repeat(np.array([seeds[x] for x in batch.column("lang").to_pylist()], np.uint64), n)
            words = pc.split_pattern(batch.column("phrase"), " ").flatten()
            hashes = chain_hashes(word_hashes(words, seeds), n)[::n]
            at = (hashes & np.uint64(size - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // _BUCKET), pa.array(at % _BUCKET)], ["bucket", "bit"])

    buckets = (frequent.select("lang", "phrase").mapInArrow(run, "bucket bigint, bit bigint")
               .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))
    out = np.zeros((size // _BUCKET, _BUCKET // 8), np.uint8)
    for row in buckets.collect():
        out[row.bucket] = np.frombuffer(row.bits, np.uint8)
    return out.ravel()


def text_blocks(data: np.ndarray, starts: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bounds, rows, new): ranges of `data` of about `limit` bytes, and the row of each.

    A text of more than `limit` bytes comes in several ranges. Each but its first starts with the
    words before it that a phrase may reach back to; phrases count where their last word starts
    at `new` or later.
    """
    for i, j in row_blocks(starts, limit):
        at, end = int(starts[i]), int(starts[j])
        if j - i > 1 or end - at <= limit:
            yield starts[i:j + 1], np.arange(i, j), at
            continue
        low = at
        while at < end:
            to = min(at + limit, end)
            while to < end:
                found = np.flatnonzero(_PART[data[to:min(to + 4096, end)]])
                if len(found):
                    to += int(found[0])
                    break
                to = min(to + 4096, end)
            yield np.array([low, to]), np.array([i]), at
            # Back over MOST_WORDS - 1 words, or to the start of the piece.
            low, words = to, 0
            while low > starts[i] and words < MOST_WORDS - 1 and not IS_STOP[data[low - 1]]:
                low -= 1
                words += not _PART[data[low]] and (low == starts[i] or _PART[data[low - 1]])
            at = to


def words_in(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words, lower-cased, of consecutive ranges: as an Arrow column, where each starts, its range and its piece."""
    base = int(bounds[0])
    part = LOWER[data[base:int(bounds[-1])]]
    solid = ~_PART[part]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = bounds[:-1][bounds[:-1] < bounds[1:]] - base
    begins[edges] = solid[edges]
    first = np.flatnonzero(begins)
    stops = IS_STOP[part].astype(np.int64)
    pieces = np.cumsum(stops)
    owner = np.searchsorted(bounds - base, first, "right") - 1
    piece = pieces[first] + owner                       # pieces never fall, so neighbours in one share both
    places = np.cumsum(solid)
    offsets = np.append(places[first] - 1, places[-1] if len(places) else 0).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(first),
                                  [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(part[solid]))])
    return words, first + base, owner, piece


class Counter:
    """A task's counts of the phrases of some lengths, whose parts are frequent."""

    def __init__(self, lengths: range, words: Frequent | None, parts: Frequent | None, full: int, burst: int, most_ids: int):
        self.lengths, self.frequent_words, self.frequent_parts = lengths, words, parts
        self.full, self.burst, self.most_ids = full, burst, most_ids
        self._renew()

    def _renew(self) -> None:
        self.trie = HatTrie(self.burst)
        # All words met of each language, with their ids and hashes; words with an id, in its order.
        self.known: dict[str, tuple[pa.Array, np.ndarray, np.ndarray]] = {}
        self.met, self.named = 0, 1
        self.words, self.langs = [pa.array([b""], pa.large_binary())], [("", 1)]

    def _ids(self, lang: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids, from 1 on, or 0 for words that are not frequent, and hashes of distinct words."""
        none = pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        known, ids, hashes = self.known.get(lang, none)
        at = pc.index_in(words, value_set=known)
        if at.null_count:
            new = words.filter(at.is_null())
            new_hashes = word_hashes(new, lang_seed(lang))
            good = np.ones(len(new), bool) if self.frequent_words is None else self.frequent_words.has(new_hashes)
            new_ids = np.where(good, self.named - 1 + np.cumsum(good), 0)
            self.words.append(new.filter(pa.array(good)))
            self.langs.append((lang, int(good.sum())))
            self.named += int(good.sum())
            self.met += len(new)
            at = at.to_numpy(zero_copy_only=False)
            at = np.where(np.isnan(at), len(ids) - 1 + np.cumsum(np.isnan(at)), at).astype(np.int64)
            known, ids, hashes = self.known[lang] = (
                pa.concat_arrays([known, new]), np.append(ids, new_ids), np.append(hashes, new_hashes))
        else:
            at = at.to_numpy()
        return ids[at], hashes[at]

    def add(self, langs: list[str], data: np.ndarray, bounds: np.ndarray, new: int) -> None:
        """Count a block; `langs` has the language of each range."""
        words, first, owner, piece = words_in(data, bounds)
        if not len(first):
            return
        names = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
        lang = np.array([names[x] for x in langs])[owner]
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.argsort(lang, kind="stable")
        cuts = np.concatenate(([0], np.cumsum(np.bincount(lang, minlength=len(names)))))
        ids, hashes = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.uint64)
        for name, i in names.items():
            rows = order[cuts[i]:cuts[i + 1]]
            used, inverse = np.unique(codes[rows], return_inverse=True)
            found, keys = self._ids(name, coded.dictionary.take(pa.array(used)))
            ids[rows], hashes[rows] = found[inverse], keys[inverse]
        for n in self.lengths:
            count = len(ids) - n + 1
            if count <= 0:
                continue
            good = (piece[:count] == piece[n - 1:]) & (owner[:count] == owner[n - 1:]) & (first[n - 1:] >= new)
            if self.frequent_parts is not None:
                # Pairs of neighbouring words.
                pair = self.frequent_parts.has(chain_hashes(hashes, 2))
                for k in range(n - 1):
                    good &= pair[k:k + count]
            for k in range(n):
                good &= ids[k:k + count] > 0
            at = np.flatnonzero(good)
            columns = [ids[at + k].astype(np.uint64) if k < n else np.zeros(len(at), np.uint64) for k in range(MOST_WORDS)]
            self.trie.add(columns[0] << np.uint64(32) | columns[1], columns[2] << np.uint64(32) | columns[3])

    def runs(self, rest: bool = False) -> Iterator[pa.RecordBatch]:
        """Sorted runs of what has to be spilled by now, or of all that is left."""
        renew = self.met > self.most_ids
        if not (rest or renew or len(self.trie) > self.full):
            return
        words = pa.concat_arrays(self.words).cast(pa.large_string()).cast(pa.string())
        ranks = np.empty(len(words), np.uint64)
        ranks[pc.sort_indices(words).to_numpy()] = np.arange(len(words), dtype=np.uint64)
        langs = pa.array([lang for lang, _ in self.langs], pa.string()).take(
            pa.array(np.repeat(np.arange(len(self.langs)), [n for _, n in self.langs])))
        mask = np.uint64(0xFFFFFFFF)
        for high, low, counts in self.trie.spill(0 if rest or renew else self.full // 2):
            ids = [(x >> s & mask).astype(np.int64) for x in (high, low) for s in (np.uint64(32), np.uint64(0))]
            order = np.lexsort([ranks[i] for i in reversed(ids)])
            ids, counts = [i[order] for i in ids], counts[order]
            size = sum((i > 0).astype(int) for i in ids)
            for n in self.lengths:
                rows = size == n
                if rows.any():
                    phrase = words.take(pa.array(ids[0][rows]))
                    for i in ids[1:n]:
                        phrase = pc.binary_join_element_wise(phrase, words.take(pa.array(i[rows])), " ")
                    yield pa.RecordBatch.from_arrays(
                        [langs.take(pa.array(ids[0][rows])), phrase, pa.array(counts[rows])], ["lang", "phrase", "n"])
        if renew:
            self._renew()


def counted(docs: DataFrame, lengths: range, frequent_words: np.ndarray | None = None, frequent_pairs: np.ndarray | None = None,
            full: int = FULL, burst: int = BURST, most_ids: int = MOST_IDS) -> tuple[DataFrame, DataFrame]:
    """(runs, merged): RUNS of all tasks as they were spilled, and (lang, phrase, n) with one row per phrase."""
    context = docs.sparkSession.sparkContext
    shared = [None if bits is None else context.broadcast(bits) for bits in (frequent_words, frequent_pairs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = [None if bits is None else Frequent(bits.value) for bits in shared]
        counter = Counter(lengths, *bitmaps, full, burst, most_ids)
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            data, starts = text_bytes(batch.column("text"))
            for bounds, rows, new in text_blocks(data, starts):
                counter.add([langs[r] for r in rows.tolist()], data, bounds, new)
                yield from counter.runs()
        yield from counter.runs(rest=True)

    runs = stored(docs.mapInArrow(run, RUNS), "phrase-runs")
    merged = (runs.repartitionByRange("lang", "phrase").sortWithinPartitions("lang", "phrase")
              .groupBy("lang", "phrase").agg(F.sum("n").alias("n")))
    return runs, merged


def _wide(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(20,0)")


def _part(words: str, first: str, count: str) -> str:
    return f"array_join(slice({words}, {first}, {count}), ' ')"


def mine(docs: DataFrame, min_count: int = MIN_COUNT, scale: int = SCALE, covered_pct: int = COVERED_PCT, top: int = TOP,
         bitmap_bits: int = BITMAP_BITS, full: int = FULL, burst: int = BURST, most_ids: int = MOST_IDS) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    `docs` has `text` and `lang`; a null text is empty, a null language `und`. Texts are
    lower-cased (A-Z), cut into pieces at stops and line ends, and those into words at spaces
    and tabs. `n` counts all words of the language, a, l and r the phrase and its two parts at the
    cut that scores least. A phrase inside a longer one that occurs nearly as often goes. Repeated
    rows count each time, texts of any length are read in ranges, other columns are not looked
    at, and an empty table gives an empty result. Ties go by count, then by the phrase's bytes.
    """
    texts = docs.select(F.coalesce(F.col("lang"), F.lit(UNKNOWN)).alias("lang"), "text")
    limits = {"full": full, "burst": burst, "most_ids": most_ids}
    enough = F.col("n") >= min_count
    runs, words = counted(texts, range(1, 2), **limits)
    totals = stored(runs.groupBy("lang").agg(F.sum("n").alias("total")), "phrase-totals")
    words = stored(words.where(enough), "phrase-words")
    word_bits = bitmap(words, 1, bitmap_bits)
    pairs = stored(counted(texts, range(2, 3), word_bits, **limits)[1].where(enough), "phrase-pairs")
    pair_bits = bitmap(pairs, 2, bitmap_bits)
    longer = stored(counted(texts, range(3, MOST_WORDS + 1), word_bits, pair_bits, **limits)[1].where(enough), "phrase-long")

    known = words.union(pairs).union(longer).select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    found = pairs.union(longer).select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))

    # Every cut of every phrase, and the frequency of both parts, which are frequent themselves.
    cuts = found.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr(_part("words", "1", "k")).alias("left"),
                       F.expr(_part("words", "k + 1", "size(words) - k")).alias("right"))
    cuts = cuts.join(known.withColumnsRenamed({"part": "left", "f": "l"}), ["lang", "left"])
    cuts = cuts.join(known.withColumnsRenamed({"part": "right", "f": "r"}), ["lang", "right"])
    score = F.expr(f"(cast({scale} as decimal(18,0)) * cast(a as decimal(20,0))) div "
                   "(cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    least = (cuts.withColumn("score", score).groupBy("lang", "phrase", "a")
             .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))

    # Phrases inside longer ones.
    inner = found.where("size(words) > 2").select("lang", "a", F.explode(F.expr(
        "flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), "
        "i -> array_join(slice(words, i, m), ' '))))")).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = F.lit(100) * _wide("longer") >= F.lit(covered_pct) * _wide("a")
    kept = stored(least.join(inner, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False)))
                  .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "phrase-kept")

    # The first ones of each part of a language, then of the language: no task sorts a whole one.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    held = held.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    held = held.where(F.col("rank") <= top).drop("part")
    held = held.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return (held.where(F.col("rank") <= top).join(totals, "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("bigint")))
