"""Phrase collocations: suffix pointers routed by their leading words and sorted by multikey three-way quicksort."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FILTER_BITS, SMALL_BATCH, bitmap_of, bounded_batches, passes, settle, text_slices
from .textops import mixed

LEAST = 100
LONGEST = 5
BEST = 2000
NO_LANG = "und"
# Suffixes that a task gathers before it sends them on, and those meant for one bucket.
FLUSH = 1 << 20
BUCKET_ROWS = 500_000
# Words that a task keeps codes for.
KNOWN = 200_000
# Pairs of words are counted in slots, one for every few words within these bounds (base-2 logarithms).
LEAST_SLOTS, MOST_SLOTS, WORDS_A_SLOT = 20, 27, 8
CHUNK_BITS = 16
# Sums of so many tasks are added up at once.
TASKS = 512
# Prefixes are counted in so many slots; a task reports slots with LOCAL_HOT suffixes, and one with HOT of them in all is
# dealt out by a longer prefix.
SLOT_BITS = 20
LOCAL_HOT = 64
HOT = 200_000

# A-Z as a-z; what ends a piece as a full stop, which is in no word; a tab as a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
KEYS = np.random.Generator(np.random.PCG64(13)).integers(0, 2**64, LONGEST, np.uint64, endpoint=False) | np.uint64(1)

COUNTED = "lang string, word string, h long, n long"
PAIRED = "depth int, slot int, n long, chunk int, task int, slots binary, counts binary"
CHUNKED = "chunk int, slots binary, counts binary"
ROUTED = "bucket int, words binary, codes binary, counts binary"
FOUND = "key binary, n long"


class Coder:
    """Small numbers for the words of a task, by language; 0 stands between pieces and for words that are not wanted."""

    def __init__(self, seed: int, wanted=None):
        self.seed, self.wanted = seed, wanted
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, dict[bytes, int]] = {}
        self.hashes, self.size = [np.zeros(1, np.uint64)], 1

    def all_hashes(self) -> np.ndarray:
        self.hashes = [np.concatenate(self.hashes)]
        return self.hashes[0]

    def codes(self, lang: str, texts: list[bytes]) -> np.ndarray:
        """The codes of the words of the texts in order, with 0 at each end of a piece and of a text."""
        import xxhash
        tokens = b".".join([*texts, b""]).translate(FOLD).replace(b".", b" . ").split()
        known = self.known.setdefault(lang, {b".": 0})
        new = [w for w in set(tokens) if w not in known]
        if new:
            salt = lang.encode() + b"\x00"
            hashes = np.array([xxhash.xxh3_64_intdigest(salt + w, self.seed) for w in new], np.uint64)
            keep = (np.ones(len(new), bool) if self.wanted is None
                    else passes(self.wanted, (hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)))
            codes = np.where(keep, self.size + np.cumsum(keep) - 1, 0)
            known.update(zip(new, codes.tolist()))
            self.hashes.append(hashes[keep])
            self.size += int(keep.sum())
        return np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens))


def suffixes(codes: np.ndarray, kept=None) -> list[np.ndarray]:
    """The first LONGEST codes of each suffix of two words or more, a column each; 0 from the end of its piece on.

    A suffix ends before a pair of words that is not `kept` (codes and codes after them to true or false) as well.
    """
    padded = np.concatenate([codes, np.zeros(LONGEST, np.int32)])
    pair = np.zeros(len(padded), bool)
    pair[:len(codes)] = (codes > 0) & (padded[1:len(codes) + 1] > 0)
    if kept is not None:
        at = np.flatnonzero(pair)
        pair[at] = kept(padded[at], padded[at + 1])
    at = np.flatnonzero(pair)
    out, going = [padded[at], padded[at + 1]], np.ones(len(at), bool)
    for k in range(2, LONGEST):
        going = going & pair[at + k - 1]
        out.append(np.where(going, padded[at + k], 0))
    return out


def prefix_hashes(columns: list[np.ndarray], hashes: np.ndarray) -> list[np.ndarray]:
    """Hashes of the first 1 to LONGEST words of each suffix."""
    out = [hashes[columns[0]] * KEYS[0]]
    for column, key in zip(columns[1:], KEYS[1:]):
        out.append(mixed(out[-1] + hashes[column] * key))
    return out


def by_lang(part: pa.RecordBatch) -> dict[str, list[bytes]]:
    out = defaultdict(list)
    for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).fill_null(b"").to_pylist()):
        out[lang].append(text)
    return out


def _counted(seed: int):
    def words(coder: Coder, counts: np.ndarray) -> pa.RecordBatch:
        hashes = coder.all_hashes().view(np.int64)
        pairs = [(lang, word, code) for lang, known in coder.known.items() for word, code in known.items() if code]
        codes = np.array([c for _, _, c in pairs], np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in pairs], pa.string()), pa.array([x[1] for x in pairs], pa.binary()).cast(pa.string()),
             pa.array(hashes[codes]), pa.array(counts[codes])], names=["lang", "word", "h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, counts = Coder(seed), np.zeros(1, np.int64)
        for part in text_slices(batches):
            for lang, texts in by_lang(part).items():
                codes = coder.codes(lang, texts)
                counts = np.append(counts, np.zeros(coder.size - len(counts), np.int64))
                counts += np.bincount(codes, minlength=coder.size)
            if coder.size > KNOWN:
                yield words(coder, counts)
                coder.clear()
                counts = np.zeros(1, np.int64)
        if coder.size > 1:
            yield words(coder, counts)
    return run


def word_counts(docs: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, h, f) of all words, and the seed of the hashes.

    No two words share a hash: if they did, the texts would be read again with another seed.
    """
    for seed in range(8):
        words = settle(docs.mapInArrow(_counted(seed), COUNTED).groupBy("lang", "word").agg(
            F.max("h").alias("h"), F.sum("n").alias("f")), "words")
        if not words.groupBy("h").count().where("count > 1").limit(1).count():
            return words, seed
    raise RuntimeError("word hashes collide")


def _paired(seed: int, wanted, slot_bits: int):
    """Suffixes of each task by the slots of their prefixes: the large ones for routing, all of those of pairs."""
    def table(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        types = {"depth": pa.int32(), "slot": pa.int32(), "n": pa.int64(), "chunk": pa.int32(), "task": pa.int32(),
                 "slots": pa.binary(), "counts": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types.items()],
                                          names=list(types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(seed, wanted.value)
        pairs, large = np.zeros(1 << slot_bits, np.uint8), np.zeros((LONGEST - 2, 1 << SLOT_BITS), np.uint32)
        for part in text_slices(batches):
            for lang, texts in by_lang(part).items():
                prefixes = prefix_hashes(suffixes(coder.codes(lang, texts)), coder.all_hashes())
                for at, prefix in enumerate(prefixes[1:-1]):
                    large[at] += np.bincount((prefix >> np.uint64(64 - SLOT_BITS)).view(np.int64), minlength=1 << SLOT_BITS).astype(np.uint32)
                slots, counts = np.unique(prefixes[1] >> np.uint64(64 - slot_bits), return_counts=True)
                slots = slots.astype(np.int64)
                pairs[slots] = np.minimum(pairs[slots] + counts, 255)
            if sum(map(len, coder.known.values())) > KNOWN:
                coder.clear()
        depth, slot = np.nonzero(large >= LOCAL_HOT)
        if len(slot):
            yield table(depth=(depth + 2).astype(np.int32), slot=slot.astype(np.int32), n=large[depth, slot].astype(np.int64))
        task = TaskContext.get().partitionId()
        for first in range(0, len(pairs), 1 << CHUNK_BITS):
            part = pairs[first:first + (1 << CHUNK_BITS)]
            used = np.flatnonzero(part)
            if len(used):
                yield table(chunk=[first >> CHUNK_BITS], task=[task], slots=[used.astype(np.uint16).tobytes()],
                            counts=[part[used].tobytes()])
    return run


def _sums(rows: pa.Table) -> np.ndarray:
    """The sums of one chunk of slots over several tasks."""
    total = np.zeros(1 << CHUNK_BITS, np.int64)
    for slots, counts in zip(rows.column("slots"), rows.column("counts")):
        total[np.frombuffer(slots.as_buffer(), np.uint16)] += np.frombuffer(counts.as_buffer(), np.uint8)
    return total


def _added(rows: pa.Table) -> pa.Table:
    """The sums as one row; beyond 255 they stay there."""
    total = _sums(rows)
    used = np.flatnonzero(total)
    return pa.table({"chunk": pa.array([rows.column("chunk")[0].as_py()], pa.int32()),
                     "slots": pa.array([used.astype(np.uint16).tobytes()], pa.binary()),
                     "counts": pa.array([np.minimum(total[used], 255).astype(np.uint8).tobytes()], pa.binary())})


def _reached(least: int):
    def bits(rows: pa.Table) -> pa.Table:
        packed = np.packbits(_sums(rows) >= min(least, 255), bitorder="little").tobytes()
        return pa.table({"chunk": pa.array([rows.column("chunk")[0].as_py()], pa.int32()), "bits": pa.array([packed], pa.binary())})
    return bits


def pair_filter(chunks: DataFrame, slot_bits: int, least: int) -> np.ndarray:
    """Bits of the slots of pairs with `least` suffixes (or 255), one a slot: no pair that occurs so often is missed."""
    sums = (chunks.withColumn("task", F.floor(F.col("task") / TASKS)).groupBy("chunk", "task").applyInArrow(_added, CHUNKED)
            .groupBy("chunk").applyInArrow(_reached(least), "chunk int, bits binary"))
    size = 1 << (CHUNK_BITS - 3)
    out = np.zeros(1 << (slot_bits - 3), np.uint8)
    for row in sums.toLocalIterator():
        out[row.chunk * size:(row.chunk + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return out


def kept_pairs(bits: np.ndarray, slot_bits: int, coder: Coder):
    def kept(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        slot = (prefix_hashes([first, second], coder.all_hashes())[1] >> np.uint64(64 - slot_bits)).astype(np.int64)
        return (bits[slot >> 3] >> (slot & 7)) & 1 == 1
    return kept


def hot_slots(slots: DataFrame, hot: int) -> np.ndarray:
    """Which slots of prefixes of 2 to LONGEST - 1 words hold too many suffixes for one bucket: fixed in size."""
    out = np.zeros((LONGEST - 2, 1 << SLOT_BITS), bool)
    found = slots.groupBy("depth", "slot").agg(F.sum("n").alias("n")).where(F.col("n") >= hot).toArrow()
    out[found.column("depth").to_numpy() - 2, found.column("slot").to_numpy()] = True
    return out


def routed_depth(prefixes: list[np.ndarray], hot: np.ndarray) -> np.ndarray:
    """By how many leading words each suffix is dealt out: two, or as many as it takes to leave a hot prefix."""
    depth, on = np.full(len(prefixes[0]), 2), np.ones(len(prefixes[0]), bool)
    for k in range(2, LONGEST):
        on &= hot[k - 2, (prefixes[k - 1] >> np.uint64(64 - SLOT_BITS)).view(np.int64)]
        depth[on] = k + 1
    return depth


def _routed(seed: int, wanted, pairs, slot_bits: int, hot, buckets: int):
    def send(coder: Coder, columns: list[np.ndarray]) -> pa.RecordBatch:
        hashes = coder.all_hashes()
        prefixes = prefix_hashes(columns, hashes)
        route = np.stack(prefixes)[routed_depth(prefixes, hot.value) - 1, np.arange(len(columns[0]))]
        order = np.lexsort((prefixes[-1], route))
        table, route = np.stack([c[order] for c in columns]), route[order]
        # Equal suffixes become one with a count.
        first = np.flatnonzero(np.append(True, (table[:, 1:] != table[:, :-1]).any(axis=0)))
        counts = np.diff(np.append(first, len(route)))
        table = table[:, first]
        bucket = ((route[first] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        bounds = np.searchsorted(bucket, np.arange(buckets + 1))
        flags, local, rows = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.uint32), []
        for b in np.unique(bucket).tolist():
            part = table[:, bounds[b]:bounds[b + 1]]
            flags[part] = True
            flags[0] = False
            used = np.flatnonzero(flags)
            local[used] = np.arange(1, len(used) + 1)
            flags[used] = False
            kind = np.uint16 if len(used) < 65_535 else np.uint32
            each = counts[bounds[b]:bounds[b + 1]]
            rows.append((b, hashes[used].tobytes(), local[part].astype(kind).tobytes(),
                         each.astype(np.uint32).tobytes() if each.max() > 1 else b""))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
            pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "words", "codes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held, size = Coder(seed, wanted.value), [], 0
        kept = kept_pairs(pairs.value, slot_bits, coder)
        for part in text_slices(batches):
            for lang, texts in by_lang(part).items():
                held.append(suffixes(coder.codes(lang, texts), kept))
                size += len(held[-1][0])
            full = sum(map(len, coder.known.values())) > KNOWN
            if size and (size >= FLUSH or full):
                yield send(coder, [np.concatenate(c) for c in zip(*held)])
                held, size = [], 0
            if full:
                coder.clear()
        if size:
            yield send(coder, [np.concatenate(c) for c in zip(*held)])
    return run


def frequent_prefixes(columns: list[np.ndarray], counts: np.ndarray, pointers: np.ndarray, least: int, shortest: int):
    """(length, pointer, count) of the prefixes of at least `shortest` words that `least` suffixes or more begin with.

    Multikey three-way quicksort: pointers are parted by the word at one depth into smaller, equal and larger ones. The
    equal part is the suffixes that share one more word, its size is that prefix's count, and it goes on one word
    deeper. A part of fewer than `least` suffixes holds no such prefix and is left unsorted.
    """
    found, parts = [], [(pointers, 0)]
    while parts:
        pointers, depth = parts.pop()
        words = columns[depth][pointers]
        n = len(words)
        pivot = sorted((words[0], words[n // 2], words[n - 1]))[1] if n > 2 else words[0]
        equal = pointers[words == pivot]
        if len(equal) < n:
            for side in (pointers[words < pivot], pointers[words > pivot]):
                if len(side) and counts[side].sum() >= least:
                    parts.append((side, depth))
        if pivot:  # 0: the suffix ends here
            count = int(counts[equal].sum())
            if count >= least:
                if depth + 1 >= shortest:
                    found.append((depth + 1, int(equal[0]), count))
                if depth + 1 < LONGEST:
                    parts.append((equal, depth + 1))
    return found


def _sorted_buckets(hot, least: int):
    def bucket(rows: pa.Table) -> pa.Table:
        packed = [(np.frombuffer(w, np.uint64), c, n) for w, c, n in zip(*(rows.column(x).to_pylist() for x in ("words", "codes", "counts")))]
        words = np.unique(np.concatenate([np.zeros(1, np.uint64), *(w for w, _, _ in packed)]))
        tables, counts = [], []
        for own, codes, each in packed:
            local = np.append(0, np.searchsorted(words, own)).astype(np.int32)
            table = np.frombuffer(codes, np.uint16 if len(own) < 65_535 else np.uint32).reshape(LONGEST, -1)
            tables.append(local[table])
            counts.append(np.frombuffer(each, np.uint32).astype(np.int64) if each else np.ones(table.shape[1], np.int64))
        columns, counts = list(np.concatenate(tables, axis=1)), np.concatenate(counts)
        prefixes = prefix_hashes(columns, words)
        depths = routed_depth(prefixes, hot.value)
        found = []
        for depth in np.unique(depths).tolist():
            pointers = np.flatnonzero(depths == depth)
            # Shorter prefixes are counted in several buckets: their parts are added up later.
            for k in range(2, depth):
                _, first, which = np.unique(prefixes[k - 1][pointers], return_index=True, return_inverse=True)
                parts = np.bincount(which, weights=counts[pointers]).astype(np.int64)
                found += [(k, int(p), n) for p, n in zip(pointers[first].tolist(), parts.tolist()) if columns[k - 1][p]]
            found += frequent_prefixes(columns, counts, pointers, least, depth)
        big = words.astype(">u8")
        table = np.stack(columns)
        return pa.table({"key": pa.array([big[table[:k, p]].tobytes() for k, p, _ in found], pa.binary()),
                         "n": pa.array([n for _, _, n in found], pa.int64())})
    return bucket


def phrase_counts(docs: DataFrame, words: DataFrame, frequent: DataFrame, seed: int, least: int,
                  bucket_rows: int = BUCKET_ROWS, hot: int = HOT) -> DataFrame:
    """(key, f) of all phrases of 2 to LONGEST words that occur `least` times; a key is the hashes of the words."""
    spark = docs.sparkSession
    total = words.agg(F.sum("f")).first()[0] or 0
    slot_bits = min(MOST_SLOTS, max(LEAST_SLOTS, (total // WORDS_A_SLOT).bit_length()))
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_rows))
    wanted = spark.sparkContext.broadcast(bitmap_of(frequent.select(
        F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("slot"))))
    paired = settle(docs.mapInArrow(_paired(seed, wanted, slot_bits), PAIRED), "paired")
    large = spark.sparkContext.broadcast(hot_slots(paired.where("slot is not null"), hot))
    pairs = spark.sparkContext.broadcast(pair_filter(paired.where("chunk is not null"), slot_bits, least))
    routed = docs.mapInArrow(_routed(seed, wanted, pairs, slot_bits, large, buckets), ROUTED)
    found = routed.groupBy("bucket").applyInArrow(_sorted_buckets(large, least), FOUND)
    return settle(found.groupBy("key").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "phrases")


def _part(key: str, start, n):
    """`n` words of a key, from word number `start` (0 first) on."""
    return F.substring(F.col(key), F.lit(8) * start + 1, F.lit(8) * n)


def score():
    """floor(1000 * a * n / (l * r)) of whole numbers, exact beyond 64 bits."""
    return F.expr("cast(cast(1000 * a as decimal(20,0)) * cast(n as decimal(18,0)) as decimal(38,0))"
                  " div cast(cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as decimal(38,0))")


def collocations(docs: DataFrame, least: int = LEAST, best: int | None = BEST, percent: int = 100,
                 bucket_rows: int = BUCKET_ROWS, hot: int = HOT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best collocations of each language of `docs` (text, lang).

    Pieces are parts of a text between `.,;:!?` and line ends, lower-cased in A-Z; words are runs of anything but spaces
    and tabs. A candidate is a phrase of 2 to 5 words of a piece with a = f(phrase) >= `least` occurrences. Its score is the
    least floor(1000 * a * n / (l * r)) over its cuts in two, with n all words of the language and l, r the counts of the two
    parts (ties: the shortest first part). A candidate inside a longer one that occurs at least `percent` percent as often
    is dropped. Languages list their `best` first ones (None: all) by score, a, and phrase; all numbers are exact.

    Null texts are empty, a null language is `und`; repeated rows count each time; other columns are ignored; texts
    without words, and empty tables, give no rows.

    Texts are read three times. Words that occur less often, and pairs of words that do, end a suffix, as no candidate holds
    them; both are told by filters that miss no frequent one. Suffixes of up to five words are dealt out by their first two
    words, those of frequent beginnings by more; equal ones of a task travel as one. Parts of counts that lie in
    several buckets are added up, so no cut or limit is on the way to a count.
    """
    spark = docs.sparkSession
    bounded_batches(spark, SMALL_BATCH)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), "text")
    words, seed = word_counts(docs)
    key = F.unhex(F.lpad(F.hex("h"), 16, "0"))
    frequent = settle(words.where(F.col("f") >= least).select("lang", "word", "h", "f", key.alias("key")), "frequent")
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    phrases = phrase_counts(docs, words, frequent, seed, least, bucket_rows, hot)

    m = (F.length("key") / 8).cast("int").alias("m")
    counted = phrases.select("key", m, F.col("f").alias("a"))
    shorter = F.array(*[F.struct(_part("key", F.lit(at), F.col("m") - 1).alias("key")) for at in (0, 1)])
    longest = (counted.where("m > 2").select(F.explode(shorter).alias("s"), "a").groupBy("s.key").agg(F.max("a").alias("longer")))
    kept = settle(counted.join(longest, "key", "left").where(
        F.coalesce(F.lit(100) * F.col("longer") < F.lit(percent) * F.col("a"), F.lit(True))).select("key", "m", "a"), "kept")

    held = frequent.select("key", "f").unionByName(phrases)
    cuts = kept.select("key", "m", "a", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("key", "m", "a", "k", _part("key", F.lit(0), F.col("k")).alias("left"),
                       _part("key", F.col("k"), F.col("m") - F.col("k")).alias("right"))
    cuts = (cuts.join(held.select(F.col("key").alias("left"), F.col("f").alias("l")), "left")
            .join(held.select(F.col("key").alias("right"), F.col("f").alias("r")), "right").select("key", "a", "k", "l", "r"))
    spots = (kept.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: _part("key", i, F.lit(1))))
                         .alias("at", "one"))
             .join(frequent.select(F.col("key").alias("one"), "lang", "word"), "one")
             .groupBy("key").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("ws")))
    named = spots.select("key", "lang", F.array_join(F.transform("ws", lambda w: w["word"]), " ").alias("phrase"))
    scored = (cuts.join(named, "key").join(sizes, "lang").select("lang", "phrase", "a", "n", "k", "l", "r", score().alias("score"))
              .groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
              .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(first))
    ranked = ranked if best is None else ranked.where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
