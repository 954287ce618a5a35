"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Test items are a stated query set.  They are read in blocks of bounded size
(``BLOCK_ITEMS`` items, ``BLOCK_BYTES`` of text); each block is broadcast and the
documents are scanned once per block, without a shuffle.

1. All 3-grams of an item are seeds, however frequent its words are.  The scan
   joins document n-grams to seeds by hash; a document that shares a seed with an
   item is a candidate.
2. Document and item are aligned by tokens (match 2, mismatch -1, gap -1).  The
   item is found if the best local alignment scores at least ``threshold`` of what
   a whole exact copy would, or as much as ``PASSAGE`` tokens copied in a row.
   Edited and paraphrased copies lose a little score for each edit.
3. An alignment that good holds at least half its score in matched tokens and
   isn't longer than these and the edits that the score allows.  So only
   stretches of the document that hold so many tokens of the item within that
   length are aligned, which loses nothing.

Items of fewer than three tokens have no seed: they are found where they stand
as a whole.

Tokens are lower-cased runs of letters and digits, and single characters of
scripts that are written without spaces, so changes of case, punctuation and
white space don't count, and numbers do.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import _chunks as C
from palimpsest.llm import _text as T
from palimpsest.session import share_seed

SEED_WORDS = 3
#: A copied passage of so many tokens counts however long its item is.
PASSAGE = 30
#: Scores are rounded to six digits before they meet the threshold.
ROUNDING = 1e-6
BLOCK_ITEMS = 50_000
BLOCK_BYTES = 8 << 20
#: Seed hits that are looked at together.
HITS = 1 << 21
RESULT = "doc_id long, item_id long, score double, first_word long, last_word long, matched_words long, item_words long"

#: Bytes below 0x80 inside a token; those from 0x80 on go by their code point.
_ASCII = np.zeros(256, bool)
_ASCII[48:58] = _ASCII[65:91] = _ASCII[97:123] = True
#: Code points, first and last, that separate: Latin-1 signs, general and CJK punctuation, symbols, wide and small forms of ASCII signs.
_SIGNS = ((0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x2BFF), (0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0x30FB, 0x30FB), (0xFE10, 0xFE6F), (0xFEFF, 0xFEFF), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
#: Scripts without spaces: Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han.
_UNSPACED = ((0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3021, 0x302F), (0x3031, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))


def _among(points: np.ndarray, ranges) -> np.ndarray:
    first, last = (np.array([r[k] for r in ranges]) for k in (0, 1))
    at = np.searchsorted(first, points, side="right") - 1
    return (at >= 0) & (points <= last[at])


def words_of(buf: np.ndarray, offs: np.ndarray) -> T.Words:
    """Tokens of lower-cased UTF-8 texts."""
    word = _ASCII[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if not len(lead):
        return T.Words(buf, offs, lower=True, word=word)
    wide = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.int64)
    b = wide[lead]
    size = np.where(b >= 0xF0, 4, np.where(b >= 0xE0, 3, 2))
    tail = [wide[lead + k] & 63 for k in (1, 2, 3)]
    point = np.where(size == 2, (b & 31) << 6 | tail[0], np.where(size == 3, (b & 15) << 12 | tail[0] << 6 | tail[1], (b & 7) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]))
    inside = ~_among(point, _SIGNS)
    alone = inside & _among(point, _UNSPACED)
    cut = np.zeros(len(buf) + 4, bool)
    cut[lead[alone]] = True
    cut[(lead + size)[alone]] = True
    for k in range(4):
        own = lead[inside & (size > k)] + k
        word[own[own < len(buf)]] = True
    return T.Words(buf, offs, lower=True, word=word, cut=cut[: len(buf)])


def smith_waterman(item: np.ndarray, text: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int, int]:
    """(best local score, first and last text position of the alignment); -1 for no match.

    One numpy row per item word; gaps along the row by a running maximum.
    """
    m = len(text)
    ramp = np.arange(m + 1) * -gap
    prev, prev_from = np.zeros(m + 1, np.int64), np.arange(m + 1)
    best = (0, -1, -1)
    for w in item:
        step = np.where(text == w, match, mismatch)
        row, origin = np.zeros(m + 1, np.int64), np.arange(m + 1)
        diag, up = prev[:-1] + step, prev[1:] + gap
        row[1:] = np.maximum(np.maximum(diag, up), 0)
        origin[1:] = np.where(row[1:] == 0, np.arange(1, m + 1), np.where(row[1:] == diag, prev_from[:-1], prev_from[1:]))
        lifted = row + ramp
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(m + 1), 0))
        via = top - ramp
        closer = via > row
        row = np.where(closer, via, row)
        origin = np.where(closer, origin[source], origin)
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), int(origin[j]), j - 1)
        prev, prev_from = row, origin
    return best


@dataclass
class Items:
    """One block of test items: token hashes, the seeds (hash, item), sorted by hash, and items too short for one."""

    ids: list
    words: list[np.ndarray]
    seed: np.ndarray
    item: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # tokens of an item -> hashes of whole items, sorted, and their numbers
    vocabulary: np.ndarray  # sorted distinct tokens
    code: np.ndarray  # vocabulary number of every token of every item
    offs: np.ndarray  # item i's tokens are code[offs[i] : offs[i + 1]]


def _item_blocks(benchmark: DataFrame, id_col: str, text: str):
    """Distinct items by id; texts of one id are in one block."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).distinct().orderBy("i", "t")
    ids, texts, size = [], [], 0
    for r in rows.toLocalIterator():
        if ids and r["i"] != ids[-1] and (len(ids) >= BLOCK_ITEMS or size >= BLOCK_BYTES):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r["i"])
        texts.append(r["t"])
        size += len(r["t"].encode("utf-8", "replace"))
    if ids:
        yield ids, texts


def _prepare(ids, texts, n: int) -> Items | None:
    buf_offs = list(T.blocks(None, pc.utf8_lower(pa.array(texts, pa.string())), 1 << 40))
    if not buf_offs:
        return None
    _, _, buf, offs = buf_offs[0]
    w = words_of(buf, offs)
    size = np.diff(w.offs)
    if not size.sum():
        return None
    words = [w.hash[a:b] for a, b in zip(w.offs[:-1], w.offs[1:], strict=True)]
    grams = T.run_hash(w.hash, n)
    chosen = np.flatnonzero(w.room()[: len(grams)] >= n)
    item = np.repeat(np.arange(len(words)), size)[chosen]
    order = np.lexsort((item, grams[chosen]))
    seed, item = grams[chosen][order], item[order]
    if len(seed):
        own = np.concatenate([[True], (seed[1:] != seed[:-1]) | (item[1:] != item[:-1])])
        seed, item = seed[own], item[own]
    short = {}
    for m in range(1, n):
        at = np.flatnonzero(size == m)
        h = T.run_hash(w.hash, m)[w.offs[at]] if len(at) else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        short[m] = (h[order], at[order])
    vocabulary, code = np.unique(w.hash, return_inverse=True)
    return Items(ids, words, seed, item, short, vocabulary, code.astype(np.int64), w.offs)


def least_score(size, threshold: float):
    """The least alignment score that counts, for items of ``size`` tokens."""
    return np.minimum((threshold - ROUNDING) * 2 * size, 2 * PASSAGE)


def _possible(items: Items, w: T.Words, doc: np.ndarray, item: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which pairs (document, item) share tokens for at least ``need`` matches of the item."""
    size = len(items.vocabulary)
    code = np.searchsorted(items.vocabulary, w.hash)
    code[code == size] = 0
    known = items.vocabulary[code] == w.hash
    # only tokens of documents with a pair
    wanted = np.zeros(len(w.offs) - 1, bool)
    wanted[doc] = True
    owner = np.repeat(np.arange(len(w.offs) - 1), np.diff(w.offs))
    known &= wanted[owner]
    have = np.unique(owner[known] * size + code[known])
    ok = np.zeros(len(doc), bool)
    for lo in range(0, len(doc), 1 << 14):
        d, i = doc[lo : lo + (1 << 14)], item[lo : lo + (1 << 14)]
        begin, n = items.offs[i], items.offs[i + 1] - items.offs[i]
        rep = np.repeat(np.arange(len(d)), n)
        place = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n) + begin[rep]
        hit = T.in_sorted(d[rep] * size + items.code[place], have)
        ok[lo : lo + (1 << 14)] = np.bincount(rep[hit], minlength=len(d)) >= need[lo : lo + (1 << 14)]
    return ok


def _joined(hit: np.ndarray, doc: np.ndarray, h: np.ndarray, seed: np.ndarray, item: np.ndarray, n_items: int) -> np.ndarray:
    """Distinct doc * n_items + item of all hits, a bounded number at a time."""
    a, b = np.searchsorted(seed, h[hit], side="left"), np.searchsorted(seed, h[hit], side="right")
    ends = np.cumsum(b - a)
    out, lo = [np.zeros(0, np.int64)], 0
    while lo < len(hit):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + HITS, side="right")))
        n = (b - a)[lo:hi]
        rep = np.repeat(np.arange(lo, hi), n)
        s = a[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
        out.append(np.unique(doc[rep] * n_items + item[s]))
        lo = hi
    return np.unique(np.concatenate(out))


def stretches(own: np.ndarray, often: np.ndarray, text: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Parts of a text that hold all its alignments of at least the score ``least``.

    own: the item's sorted distinct tokens, ``often`` how often it has each.  With m
    matches and p edits, 2m - p >= least, so m >= least / 2, and the text side is
    at most m + p <= 3m - least tokens long.  Of each token as many places count
    in a window as the item has.
    """
    span = min(len(text), max(1, int(3 * int(often.sum()) - least) + 1))
    code = np.searchsorted(own, text)
    code[code == len(own)] = 0
    place = np.flatnonzero(own[code] == text)
    code = code[place]
    if len(place) < least / 2:
        return []
    order = np.argsort(code, kind="stable")
    code, place = code[order], place[order]
    # a place counts in the windows that begin after the place of the token that would be one too many
    full = np.arange(len(place)) - often[code]
    after = np.where((full >= 0) & (code[full] == code), place[full] + 1, 0)
    windows = len(text) - span + 1
    change = np.zeros(windows + 1, np.int64)
    np.add.at(change, np.clip(np.maximum(after, place - span + 1), 0, windows), 1)
    np.add.at(change, np.minimum(place + 1, windows), -1)
    good = np.flatnonzero(np.cumsum(change)[:-1] >= least / 2)
    if not len(good):
        return []
    new = np.flatnonzero(np.diff(good, prepend=-span - 1) > span)
    return [(int(good[a]), int(good[b - 1]) + span) for a, b in zip(new, [*new[1:], len(good)], strict=True)]


def matches(items: Items, buf, offs, lo: int, n: int, threshold: float):
    """(document, item, raw score, first token, last token, item tokens) of each pair whose best alignment counts."""
    w = words_of(buf, offs)
    if not len(w.hash):
        return
    room = w.room()
    for m, (hashes, numbers) in items.short.items():
        h = T.run_hash(w.hash, m)
        hit = np.flatnonzero(T.in_sorted(h, hashes) & (room[: len(h)] >= m)) if len(hashes) else []
        seen = set()
        for at in np.asarray(hit).tolist():
            d = int(np.searchsorted(w.offs, at, side="right")) - 1
            for i in numbers[np.searchsorted(hashes, h[at], side="left") : np.searchsorted(hashes, h[at], side="right")].tolist():
                if (d, i) not in seen:
                    seen.add((d, i))
                    yield lo + d, i, 2 * m, at - int(w.offs[d]), at - int(w.offs[d]) + m - 1, m
    h = T.run_hash(w.hash, n)
    hit = np.flatnonzero(T.in_sorted(h, items.seed) & (room[: len(h)] >= n))
    if not len(hit):
        return
    n_items = len(items.words)
    doc, item = np.divmod(_joined(hit, np.searchsorted(w.offs, hit, side="right") - 1, h, items.seed, items.item, n_items), n_items)
    sizes = np.diff(items.offs)
    ok = _possible(items, w, doc, item, least_score(sizes[item], threshold) / 2)
    for d, i in zip(doc[ok].tolist(), item[ok].tolist(), strict=True):
        own, least = items.words[i], float(least_score(sizes[i], threshold))
        text = w.hash[w.offs[d] : w.offs[d + 1]]
        best = (0, -1, -1)
        for a, b in stretches(*np.unique(own, return_counts=True), text, least):
            got = smith_waterman(own, text[a:b])
            if got[0] > best[0]:
                best = (got[0], got[1] + a, got[2] + a)
        if best[0] >= least:
            yield lo + d, i, best[0], best[1], best[2], len(own)


def _blocks_of(docs: DataFrame, benchmark: DataFrame, n: int):
    share_seed(docs.sparkSession)
    for ids, texts in _item_blocks(benchmark, "item_id", "text"):
        if items := _prepare(ids, texts, n):
            yield docs.sparkSession.sparkContext.broadcast(items)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, n: int = SEED_WORDS) -> DataFrame:
    """One row per contaminated pair: doc_id, item_id, score, first_word, last_word, matched_words, item_words.

    score is that of the best local alignment, 1 for a whole exact copy; pairs
    below the threshold are left out, unless their score is that of ``PASSAGE``
    copied tokens.  Of equally good alignments the one counts that ends at the
    first token of the item, then of the text.  Null and empty texts, and items without a
    letter or digit, match nothing; an item of fewer than n tokens matches as a
    whole only.  Texts of any length are searched whole.  Repeated document rows
    give a row each; rows of the same item_id count as one item, with the best of
    their scores; a null item_id is an item of its own.  Other columns are
    ignored; an empty table on either side gives an empty result.
    """
    spark = docs.sparkSession

    def scan(held):
        def run(batches):
            for batch in batches:
                rows = []
                for lo, _, buf, offs in T.blocks(None, pc.utf8_lower(batch.column(1))):
                    for d, i, raw, a, b, size in matches(held.value, buf, offs, lo, n, threshold):
                        rows.append((d, held.value.ids[i], round(raw / (2 * size), 6), a, b, b - a + 1, size))
                best: dict = {}
                for r in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, -r[2], r[3:])):
                    best.setdefault(r[:2], r)
                rows = list(best.values())
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
                ids = batch.column(0).take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), *(pa.array(c, pa.int64()) for c in cols[3:])], names=[x.split()[0] for x in RESULT.split(", ")])

        return run

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    out = spark.createDataFrame([], RESULT)
    for held in _blocks_of(docs, benchmark, n):
        out = out.unionByName(src.mapInArrow(C.settled(scan(held)), RESULT))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, n: int = SEED_WORDS) -> DataFrame:
    """The rows of ``docs`` without a contaminated pair, all columns unchanged; no shuffle.

    Decided row by row, as in ``contaminated``: null and empty texts stay, copies
    of a row go or stay alike, an empty benchmark leaves all rows.
    """
    at = docs.columns.index("text")

    def keep(held):
        def run(batches):
            for batch in batches:
                ok = np.ones(batch.num_rows, bool)
                for lo, _, buf, offs in T.blocks(None, pc.utf8_lower(batch.column(at))):
                    for d, *_ in matches(held.value, buf, offs, lo, n, threshold):
                        ok[d] = False
                yield batch.filter(pa.array(ok))

        return run

    out = docs
    for held in _blocks_of(docs, benchmark, n):
        out = out.mapInArrow(C.settled(keep(held)), docs.schema)
    return out


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Pairs of `documents` and `benchmark` items they hold, whole or edited."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
