"""Spelling variants: words one edit apart, found by a trie over letter-group counts.

* A word's vector holds its length and how many of its letters fall into each of ``GROUPS`` groups.  One inserted, deleted or replaced
  letter raises the counts by one at most and lowers them by one at most: a budget of one surplus and one deficit.
* The vectors form a trie, one level per entry.  The levels up to ``SHARD_LEVELS`` are laid out as shards: a word
  stands in one shard and visits the shards that its budget reaches (only those of greater key, so a pair meets once).
* Small shards are packed together to about ``BLOCK`` words a task.  Shards of more than ``BLOCK`` words are dealt in blocks, and
  their visitors too; every block of words meets every block of visitors.  No word, pair or partner is left out.
* In a task the search goes depth first with the visitors that have budget left, and each leaf's words are compared
  letter by letter with the visitors that reach it.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climo.llm.tables import written
from climo.session import ship_package

#: A run of letters, and A-Z in lower case.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: Letter groups: code point mod GROUPS.  The trie's levels: length, then the groups in this order (frequent letters first).
GROUPS = 16
ORDER = (5, 1, 9, 15, 14, 4, 3, 2, 12, 0, 13, 8, 6, 7, 11, 10)
SHARD_LEVELS, BLOCK, LEAF = 3, 50_000, 16
#: Distinct words that a task gathers before it hands their counts on.
FLUSH = 200_000
#: Letters beyond this number are compared one word at a time.
WIDE = 48


def counted_runs(doc_id: int | None, text: str, one_in: int) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of one text; where ``one_in`` divides a run's CRC-32 with its document, the run loses a letter."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    runs: Counter[str] = Counter()
    for run, n in Counter(RUN.findall(text)).items():
        runs[run.translate(_LOWER)] += n
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % one_in == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        yield run, n


def word_counts(docs: DataFrame, id_col: str, text_col: str, min_letters: int, one_in: int) -> DataFrame:
    """(word, n): all words of ``min_letters`` or more, summed in each task before they are shuffled."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words, n = list(found), list(found.values())
            for a in range(0, len(words), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[a:a + 20_000], pa.string()), pa.array(n[a:a + 20_000], pa.int64())], schema=schema)
            found.clear()

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in counted_runs(i, text.as_py() or "", one_in):
                    if len(word) >= min_letters:
                        found[word] += n
                if len(found) >= FLUSH:
                    yield from out()
        yield from out()

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters padded with 0, lengths)."""
    lengths = np.fromiter(map(len, words), np.int32, len(words))
    wide = max(1, min(WIDE, int(lengths.max(initial=1))))
    flat = np.frombuffer("".join(w[:wide].ljust(wide, "\0") for w in words).encode("utf-32-le"), np.uint32)
    return flat.reshape(len(words), wide).astype(np.uint16), lengths


def _vectors(words: list[str]) -> np.ndarray:
    """One row per word: its length, then its letters per group in ``ORDER``.  Counts are cut at 30,000, which brings no two vectors apart."""
    lengths = np.fromiter(map(len, words), np.int32, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32) % GROUPS
    flat = np.repeat(np.arange(len(words)), lengths) * GROUPS + letters
    counts = np.bincount(flat, minlength=len(words) * GROUPS).reshape(len(words), GROUPS)
    return np.concatenate([lengths[:, None], counts[:, list(ORDER)]], axis=1).clip(max=30_000).astype(np.int16)


def one_edit(a: str, b: str) -> bool:
    """Whether ``a`` and ``b`` differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def _verified(words: list[str], codes: np.ndarray, lengths: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which of the pairs (p, q) of words are one edit apart."""
    swap = lengths[p] > lengths[q]
    a, b = np.where(swap, q, p), np.where(swap, p, q)
    out = np.zeros(len(p), bool)
    even = lengths[a] == lengths[b]
    out[even] = (codes[a[even]] != codes[b[even]]).sum(axis=1) == 1
    odd = np.flatnonzero(~even)
    if len(odd):
        x, y = codes[a[odd]], codes[b[odd]]
        # Letters before the first difference agree in place, those behind the extra one are shifted by one.
        shifted = np.concatenate([y[:, 1:], np.zeros((len(odd), 1), y.dtype)], axis=1)
        differs = x != y
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), x.shape[1])
        behind = np.arange(x.shape[1])[None, :] >= first[:, None]
        out[odd] = ~((x != shifted) & behind).any(axis=1)
    for i in np.flatnonzero(np.maximum(lengths[a], lengths[b]) > codes.shape[1]):
        out[i] = one_edit(words[a[i]], words[b[i]])
    return out


def near_pairs(words: list[str], vectors: np.ndarray, entries: np.ndarray, visitors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (visitor, entry) one edit apart, by a depth-first search of the trie of the entries (places in ``words``)."""
    codes, lengths = _codes(words)
    depth = vectors.shape[1]

    def leaf(node: np.ndarray, at: int, found: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        entry = vectors[node, at:]
        step = max(1, 4_000_000 // (entry.size + len(node)))
        for s in range(0, len(found), step):
            part = found[s:s + step]
            gap = vectors[part, at:][:, None, :] - entry[None, :, :]
            # With g+ and g- the sums of positive and negative gaps: g+ = (|g| + g) / 2 and g- = (|g| - g) / 2.
            size, net = np.abs(gap).sum(axis=2, dtype=np.int32), gap.sum(axis=2, dtype=np.int32)
            i, j = np.nonzero(((size + net) // 2 + surplus[s:s + step, None] <= 1) & ((size - net) // 2 + deficit[s:s + step, None] <= 1))
            good = _verified(words, codes, lengths, part[i], node[j])
            yield part[i][good], node[j][good]

    def search(node: np.ndarray, at: int, found: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(found) or not len(node):
            return
        if at and (len(node) <= LEAF or at == depth):
            yield from leaf(node, at, found, surplus, deficit)
            return
        values = vectors[node, at]
        own = vectors[found, at]
        bounds = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(node)]
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            gap = own - values[s]
            if at == 0:
                # The length is the sum of the groups: it may differ by one, and the groups spend the budget.
                ok = np.abs(gap) <= 1
                yield from search(node[s:e], 1, found[ok], surplus[ok], deficit[ok])
            else:
                more, less = surplus + np.maximum(gap, 0), deficit + np.maximum(-gap, 0)
                ok = (more <= 1) & (less <= 1)
                yield from search(node[s:e], at + 1, found[ok], more[ok], less[ok])

    order = entries[np.lexsort(vectors[entries].T[::-1])]
    free = np.zeros(len(visitors), np.int16)
    yield from search(order, 0, visitors, free, free)


def _reachable() -> list[list[int]]:
    """All steps of the shard levels that a surplus and a deficit of one allow: (length, counts of the first groups)."""
    n = SHARD_LEVELS - 1
    units = [[0] * n] + [[int(i == j) for j in range(n)] for i in range(n)]
    steps = set()
    for up in units:
        for down in units:
            gap = [u - d for u, d in zip(up, down, strict=True)]
            more, less = sum(g for g in gap if g > 0), sum(-g for g in gap if g < 0)
            if not (more == 0 and less == 0 and any(up)):
                # What the first groups leave of the budget may be spent below, so the length may change accordingly.
                for a in range(more, 2):
                    for b in range(less, 2):
                        steps.add((a - b, *gap))
    return [list(s) for s in sorted(steps)]


def _shard(levels: np.ndarray) -> np.ndarray:
    """The key of the first trie levels: the counts stand side by side as digits."""
    code = np.zeros(levels.shape[:-1], np.int64)
    for j in range(SHARD_LEVELS):
        code = code * 32_768 + levels[..., j]
    return code


def _laid_out(words: DataFrame) -> DataFrame:
    """(key, word, n, home): each word in its shard and in the shards of greater key that it visits."""
    steps = np.array(_reachable(), np.int32)

    schema = pa.schema([("key", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("home", pa.bool_())])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _vectors(batch.column(0).to_pylist())[:, :SHARD_LEVELS]
            keys = own[:, None, :] + steps[None, :, :]
            code, home = _shard(keys), _shard(own)
            i, j = np.nonzero((code >= home[:, None]) & (keys >= 0).all(axis=2))
            rows = batch.take(pa.array(i))
            yield pa.RecordBatch.from_arrays([pa.array(code[i, j]), rows.column(0), rows.column(1), pa.array(code[i, j] == home[i])], schema=schema)

    return words.select("word", "n").mapInArrow(lay, "key long, word string, n long, home boolean")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): per word with a near word their number and the most frequent (ties: smallest) one."""
    ship_package(words.sparkSession)
    laid = written(_laid_out(words))
    sizes = laid.groupBy("key").agg(F.sum(F.col("home").cast("long")).alias("_e"), F.count("*").alias("_v")).where("_e > 0 and _v > 1")
    layout = written(sizes.select("key", F.ceil(F.col("_e") / BLOCK).cast("int").alias("_eb"), F.ceil(F.col("_v") / BLOCK).cast("int").alias("_vb"), "_v"))
    small = F.col("_vb") == 1
    packs = (layout.where(small).agg(F.sum("_v")).collect()[0][0] or 0) // BLOCK + 1
    placed, spot = laid.join(layout, "key"), F.xxhash64("word")
    whole = placed.where(small).select(F.pmod(F.xxhash64("key"), F.lit(packs)).alias("pack"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), "word", "n",
                                       F.col("home").alias("entry"), F.lit(True).alias("visitor"))
    entries = placed.where(~small & F.col("home")).select(
        F.col("key").alias("pack"), F.pmod(spot, "_eb").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("_vb") - 1)).alias("j"),
        "word", "n", F.lit(True).alias("entry"), F.lit(False).alias("visitor"))
    visitors = placed.where(~small).select(
        F.col("key").alias("pack"), F.explode(F.sequence(F.lit(0), F.col("_eb") - 1)).alias("i"), F.pmod(spot, "_vb").cast("int").alias("j"),
        "word", "n", F.lit(False).alias("entry"), F.lit(True).alias("visitor"))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        sorted_words, at = np.unique(np.array(rows.word.to_list(), dtype=object), return_inverse=True)
        words = sorted_words.tolist()
        n, entry, visitor = np.zeros(len(words), np.int64), np.zeros(len(words), bool), np.zeros(len(words), bool)
        n[at] = rows.n.to_numpy()
        entry[at[rows.entry.to_numpy(bool)]] = True
        visitor[at[rows.visitor.to_numpy(bool)]] = True
        vectors = _vectors(words)
        shard = _shard(vectors)
        near: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for p, q in near_pairs(words, vectors, np.flatnonzero(entry), np.flatnonzero(visitor)):
            # A pair meets where the word of the greater shard (in one shard: the greater word) is the entry.
            ok = (shard[p] < shard[q]) | ((shard[p] == shard[q]) & (p < q))
            near += [(p[ok], q[ok]), (q[ok], p[ok])]
        a, b = (np.concatenate(x) for x in zip(*near, strict=True))
        by = np.lexsort((b, -n[b], a))
        a, b = a[by], b[by]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
        return pd.DataFrame({"word": pd.Series([words[i] for i in a[first]], dtype=object), "n_near": np.diff(np.append(first, len(a))),
                             "best_n": n[b[first]], "best": pd.Series([words[i] for i in b[first]], dtype=object)})

    groups = whole.union(entries).union(visitors).groupBy("pack", "i", "j")
    found = groups.applyInPandas(search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("b")
    out = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return out.select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last one, by pointer jumping."""
    ends = written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = written(ends.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        ends = step.select("word", "root")
        if step.where("_moved").limit(1).count() == 0:
            return ends


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = 6, min_count: int = 5,
                      ratio: int = 5, one_in: int = 199) -> DataFrame:
    """(word, form, root, n, n_near, form_n): all words of ``min_letters`` letters and ``min_count`` occurrences or more.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case; a run loses a letter where ``one_in`` divides its
    CRC-32 with the document's id.  ``form`` is the near word (one edit) of largest n, ties to the smallest in
    code-point order, if its n is ``ratio`` times the word's or more; ``root`` follows forms to the last.

    Null and empty texts have no words; a null id counts as the empty string before the colon.  Every row of
    a repeated id counts.  Texts and words may be of any length.  An empty table gives no rows.  Other columns may have
    any name.
    """
    ship_package(docs.sparkSession)
    counts = word_counts(docs, id_col, text_col, min_letters, one_in)
    words = written(counts.where(F.col("n") >= min_count))
    near = words.join(near_words(words), "word", "left")
    clear = F.col("best_n") >= ratio * F.col("n")
    rows = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                               F.when(clear, F.col("best")).alias("form"), F.when(clear, F.col("best_n")).alias("form_n")))
    roots = _roots(rows.where("form is not null").select("word", "form"))
    out = rows.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
