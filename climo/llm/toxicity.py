"""Toxicity by weak supervision.

1. A lexicon is mined from the labelled training rows: words and word beginnings that stand in toxic texts far
   more often than chance allows.  Confirmed near copies count once, or one copied text would make its rare words significant.
2. Voters - lexicon groups and patterns - vote on every document.  A generative label model with a latent class learns each
   voter's firing rates per class by expectation maximisation over the counts of all vote patterns, labelled rows
   with their class fixed.  Voters that fire together within a class are correlated: each one's evidence is divided by one
   plus its correlations with the others.
3. A linear classifier (logistic regression) is trained on the posterior labels of a bounded sample, and scores all texts.

Only the text makes a score: id, label, language and source never do.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from climo.llm.exact import _bitmap, _flagged
from climo.llm.minhash import _confirmed, _shingle_sets, shingle_set
from climo.llm.tables import written
from climo.session import ship_package

#: Insults that every run knows.
INSULTS = ("idiot moron stupid loser trash scum pathetic worthless disgusting clown imbecile dumbass "
           "bastard bitch asshole bullshit retard freak vermin filth").split()
_WORD = re.compile(r"[^\W\d_]+")
_SPELLED = re.compile(r"\S*[013457@$]\S*")
_SPELLING = str.maketrans("013457@$", "oieastas")
_SHOUTED = re.compile(r"\b[A-Z]{4,}\b")
PREFIXES = (4, 5, 6)
GROUPS = 8
VOTERS = ("insults", "spelled_insult", "you_insult", "shouting", *(f"lexicon_{i}" for i in range(GROUPS)))
_YOU = re.compile(r"\byou(?:'re| are)?(?: \w+){0,3}? (?:" + "|".join(INSULTS) + r")\b")
SKETCHES = 4


def word_terms(words) -> Iterator[str]:
    """The terms of distinct words: the words, and their beginnings of a few lengths (marked ``*``)."""
    for w in words:
        yield w
        for k in PREFIXES:
            if len(w) > k:
                yield w[:k] + "*"


def held_out(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    """Rows kept out of training: CRC-32 of the id as text, modulo ``parts``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def _sketches(text: str) -> tuple[int | None, list[int]]:
    """Hash of the set of 3-word shingles, and minima of the shingle hashes under a few orders; (None, []) without words."""
    hashes = shingle_set(text, 3)
    if not len(hashes):
        return None, []
    least = [int((hashes * np.uint64(2 * k + 0x9E3779B97F4A7C15)).min()) - (1 << 63) for k in range(SKETCHES)]
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63), least


def _text_words(low: str) -> set[str]:
    """The distinct words (letters only) of a text in lower case."""
    return set(_WORD.findall(" ".join(set(low.split()))))


def training_labels(labels: DataFrame) -> DataFrame:
    """(id, toxic) of the labelled rows that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    return known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def _sketched(texts: DataFrame) -> DataFrame:
    """(id, text_hash, set_hash, sketches) of (id, text_hash, text); ``set_hash`` stands for the whole set of shingles."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("set_hash", pa.int64()), ("sketches", longs)])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_sketches(t.as_py() or "") for t in batch.column(2)]
            arrays = [pa.array([h for h, _ in found], pa.int64()), pa.array([k for _, k in found], longs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], schema=schema)

    return texts.select("id", "text_hash", "text").mapInArrow(sketch, "id long, text_hash long, set_hash long, sketches array<long>")


def _picked(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (id, text_hash, ...) with ``text``, one row each.

    Only texts whose code stands in a bitmap of the wanted ones (bounded in size at every scale) are shuffled; a code that falls on
    another's bit goes in the join.
    """
    code = F.xxhash64("id", "text_hash")
    some = _flagged(texts, code, _bitmap(wanted.select(code.alias("code"))), "_wanted").where("_wanted")
    return wanted.join(some.groupBy("id", "text_hash").agg(F.first("text").alias("text")), ["id", "text_hash"])


def _counted_documents(texts: DataFrame, known: DataFrame, percent: int = 80) -> DataFrame:
    """(id, text_hash, toxic): the labelled documents without near copies of their label.

    Texts with the same set of shingles are one class, its smallest id stays.  Of classes that agree on all sketches, those that agree
    with the smallest id on ``percent`` of the shingles go.  Of several texts of one id the one with the smallest hash counts.
    """
    labelled = _flagged(texts, F.xxhash64("id"), _bitmap(known.select(F.xxhash64("id").alias("code"))), "_known").where("_known")
    one = _sketched(labelled).groupBy("id").agg(F.min(F.struct("text_hash", "set_hash", "sketches")).alias("_t"))
    training = written(one.select("id", "_t.*").join(known, "id"))
    classes = written(training.where(F.size("sketches") > 0).groupBy("toxic", "set_hash", "sketches").agg(
        F.min(F.struct("id", "text_hash")).alias("_t")).select("_t.*", "toxic", "sketches"))
    first = classes.groupBy("toxic", "sketches").agg(F.min("id").alias("u"), F.count("*").alias("_n")).where("_n > 1")
    pairs = written(classes.join(first, ["toxic", "sketches"]).where("id <> u").select("u", F.col("id").alias("v")))
    ids = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    sets = written(_shingle_sets(_picked(texts, classes.select("id", "text_hash").join(ids, "id")).select("id", "text"), 3))
    copies = written(_confirmed(pairs, sets, percent).where("linked").select(F.col("v").alias("id")))
    kept = classes.select("id", "text_hash", "toxic").union(training.where(F.size("sketches") == 0).select("id", "text_hash", "toxic"))
    return written(kept.join(copies, "id", "left_anti"))


def _term_counts(rows: DataFrame) -> DataFrame:
    """(term, toxic, n): toxic documents and documents per term of (toxic, text); summed up in each task first."""
    schema = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("n", pa.int64())])

    def batch_of(seen: Counter, marked: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array([marked[t] for t in seen], pa.int64()),
                                           pa.array(list(seen.values()), pa.int64())], schema=schema)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, marked = Counter(), Counter()
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                terms = set(word_terms(_text_words((text.as_py() or "").lower())))
                seen.update(terms)
                if toxic:
                    marked.update(terms)
                if len(seen) > 300_000:
                    yield batch_of(seen, marked)
                    seen, marked = Counter(), Counter()
        yield batch_of(seen, marked)

    found = rows.select("toxic", "text").mapInArrow(counts, "term string, toxic long, n long")
    return found.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))


def mined_terms(texts: DataFrame, known: DataFrame, min_documents: int = 4, min_precision: float = 0.7) -> list[str]:
    """All terms that mark toxic training texts, strongest first.

    A term needs ``min_documents`` toxic documents, a share of toxic documents of ``min_precision`` and evidence against chance
    beyond the number of terms tried (those of toxic texts): (documents) * KL(share, base rate) >= ln(5 * terms).  Terms
    and base rates are counted over the same rows, all labelled training texts, near copies once; only
    the terms that pass reach the driver.
    """
    texts = texts.where(F.col("id").isNotNull()).select("id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    documents = _counted_documents(texts, known)
    totals = {r.toxic: r.n for r in documents.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return []
    counted = written(_term_counts(_picked(texts, documents)).where("toxic > 0"))
    base, tried, share = toxic / (toxic + clean), counted.count(), F.col("toxic") / F.col("n")
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    strong = counted.where((F.col("toxic") >= min_documents) & (share >= min_precision) & (share > base)).withColumn(
        "evidence", F.col("n") * (share * F.log(share / base) + rest)).where(F.col("evidence") >= math.log(5 * max(tried, 1)))
    return [r.term for r in strong.orderBy(F.desc("evidence"), "term").collect()]


def pattern_votes(text: str, low: str, words: set[str]) -> int:
    """Votes of the fixed voters as bits, in the order of VOTERS."""
    insulted = not words.isdisjoint(INSULTS)
    spelled = any(not set(_WORD.findall(w.lower().translate(_SPELLING))).isdisjoint(INSULTS) for w in _SPELLED.findall(text))
    shouted = len(_SHOUTED.findall(text)) * 10 > text.count(" ") + 10
    fired = (insulted, spelled, insulted and bool(_YOU.search(low)), shouted)
    return sum(1 << i for i, f in enumerate(fired) if f)


def _votes(texts: DataFrame, lexicon: list[str]) -> DataFrame:
    """(id, votes, terms): all votes as bits; terms by their place in the lexicon, term i in lexicon group i mod GROUPS."""
    index = {t: i for i, t in enumerate(lexicon)}
    starts = {t.rstrip("*")[:PREFIXES[0]] for t in lexicon}
    first = len(VOTERS) - GROUPS
    schema = pa.schema([("id", pa.int64()), ("votes", pa.int32()), ("terms", pa.list_(pa.int32()))])

    def look(text: str) -> tuple[int, list[int]]:
        low = text.lower()
        words = _text_words(low)
        likely = [w for w in words if w[:PREFIXES[0]] in starts]
        terms = sorted({index[t] for t in word_terms(likely) if t in index})
        return pattern_votes(text, low, words) | sum({1 << (first + t % GROUPS) for t in terms}), terms

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(zip(*(look(t.as_py() or "") for t in batch.column(1)), strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(got, list(schema)[1:], strict=True))], schema=schema)

    return texts.select("id", "text").mapInArrow(votes, "id long, votes int, terms array<int>")


class LabelModel:
    """Latent-class model of the voters: firing rates per class, and discounts for correlated voters."""

    def __init__(self, patterns: np.ndarray, known: np.ndarray, counts: np.ndarray, rounds: int = 60):
        """``patterns`` (rows of votes), ``known`` class (-1: unknown) and ``counts`` of documents."""
        v, n = patterns.astype(float), counts.astype(float)
        voters = v.shape[1]
        #: Pseudo-counts: voters are meant to fire on toxic texts and seldom on others.
        fire = np.array([[0.5, 50.0], [2.0, 2.0]])
        fires = (n @ v > 0).astype(float)                # a voter that fires nowhere says nothing
        self.prior, self.rates, self.weights = 0.1, np.tile([[0.01], [0.5]], voters), fires
        for _ in range(rounds):
            p = np.where(known < 0, self.posterior(v), known)
            self.prior = float((n @ p + 1) / (n.sum() + 10))
            for c, w in ((0, n * (1 - p)), (1, n * p)):
                self.rates[c] = (w @ v + fire[c, 0]) / (w.sum() + fire[c].sum())
            self.weights = fires / (1 + self._correlations(v, n, p))

    def _correlations(self, v: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Per voter the sum of its positive correlations with the others inside the classes."""
        total = np.zeros((v.shape[1], v.shape[1]))
        for w in (n * (1 - p), n * p):
            size = w.sum()
            if size > 1:
                d = v - (w @ v) / size
                cov = (d * w[:, None]).T @ d / size
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                total += size / n.sum() * np.clip(cov / np.outer(sd, sd), 0, 1)
        np.fill_diagonal(total, 0)
        return total.sum(axis=1)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of the toxic class per row of votes."""
        on = np.log(self.rates[1] / self.rates[0])
        off = np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        odds = math.log(self.prior / (1 - self.prior)) + (v * on + (1 - v) * off) @ self.weights
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _bits(votes: np.ndarray) -> np.ndarray:
    return (votes[:, None] >> np.arange(len(VOTERS))) & 1


def _conjugate(product, right: np.ndarray, diagonal: np.ndarray, tolerance: float = 1e-9, rounds: int = 500) -> np.ndarray:
    """Solves product(x) = right for a symmetric positive definite product by conjugate gradients, scaled by its diagonal."""
    x, r = np.zeros_like(right), right.copy()
    z = r / diagonal
    d, rz, goal = z.copy(), r @ z, tolerance * math.sqrt(right @ right)
    for _ in range(rounds):
        if math.sqrt(r @ r) <= goal:
            break
        along = product(d)
        a = rz / (d @ along)
        x, r = x + a * d, r - a * along
        z = r / diagonal
        rz, before = r @ z, rz
        d = z + rz / before * d
    return x


def fit_linear(columns: np.ndarray, begun: np.ndarray, width: int, y: np.ndarray, ridge: float = 0.05, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last weight is the intercept (not shrunk).

    Row i has ones in ``columns[begun[i]:begun[i + 1]]`` of ``width`` columns.  Memory grows with the ones only: a step is found by
    conjugate gradients, without a dense matrix.
    """
    row = np.repeat(np.arange(len(y)), np.diff(begun))
    shrink = np.full(width + 1, ridge)
    shrink[-1] = 1e-6

    def forward(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, w[columns], len(y)) + w[-1]

    def back(r: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(columns, r[row], width), r.sum())

    w = np.zeros(width + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -30, 30)))
        bend = np.maximum(p * (1 - p), 1e-6)
        step = _conjugate(lambda v, bend=bend: back(bend * forward(v)) + shrink * v, back(p - y) + shrink * w, back(bend) + shrink)
        w = w - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = 0.7, max_sample: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted, votes: one row per input row.

    ``labels`` (doc_id, toxic) is read for rows that are not held out only; an id labelled twice is toxic if one label
    says so.  The classifier is fitted on the posterior labels of at most ``max_sample`` rows that are not
    held out, smallest id hashes first; lexicon and label model cover all rows.  Of several texts of one id, the one with the
    smallest hash counts for the lexicon; all are scored.

    Null and empty texts have no votes and get the score of no evidence.  Rows without id are scored and not
    held out.  Repeated rows get equal scores.  Without usable labels only the fixed voters are left.  An empty table
    gives no rows.  Other columns are not read.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    known = written(training_labels(labels))
    lexicon = mined_terms(rows, known)
    voted = written(_votes(rows, lexicon))
    patterns = voted.join(known, "id", "left").groupBy("votes", F.coalesce("toxic", F.lit(-1)).alias("known")).agg(
        F.count("*").alias("n")).collect()                       # at most 3 * 2^voters rows
    sample = voted.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id", "votes", "terms").limit(max_sample).select("votes", "terms").toArrow()
    weights = np.zeros(len(VOTERS) + len(lexicon) + 1)
    if patterns and sample.num_rows:
        model = LabelModel(_bits(np.array([r.votes for r in patterns])), np.array([r.known for r in patterns]), np.array([r.n for r in patterns]))
        bits, terms = _bits(sample["votes"].to_numpy().astype(np.int64)), sample["terms"].combine_chunks()
        fired_row, fired = np.nonzero(bits)
        sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
        row = np.concatenate([fired_row, np.repeat(np.arange(len(sizes)), sizes)])
        column = np.concatenate([fired, len(VOTERS) + terms.flatten().to_numpy().astype(np.int64)])
        begun = np.cumsum([0, *np.bincount(row, minlength=len(sizes))])
        weights = fit_linear(column[np.argsort(row, kind="stable")], begun, len(weights) - 1, model.posterior(bits.astype(float)))
    schema = pa.schema([("doc_id", pa.int64()), ("votes", pa.int32()), ("score", pa.float64())])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = _bits(batch.column(1).to_numpy().astype(np.int64)) @ weights[:len(VOTERS)] + weights[-1]
            odds += [weights[len(VOTERS) + np.asarray(t, dtype=int)].sum() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(1 / (1 + np.exp(-np.clip(odds, -30, 30))))], schema=schema)

    out = voted.mapInArrow(scores, "doc_id long, votes int, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"), "votes")
