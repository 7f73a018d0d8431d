"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared with those of its
language by the Jensen-Shannon distance (square root of the divergence in bits).  The language references are
means over all documents of that language that pass the base rules, every document counting once, so a few
long texts cannot shift them.  Texts below a minimum length, and languages with too little text, are not
compared.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from climo.llm.tables import written
from climo.session import ship_package

#: Common words of the languages compared.
COMMON_WORDS = {
    "en": "the of and a to in is that for on with as was at by it from or are be this an which not but".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er".split(),
    "fr": "le la les de des du et un une en que qui dans pour par sur avec est pas au ce il ne se plus".split(),
    "es": "el la los las de del y en que un una por con para se su al es lo como más no o ha sus".split(),
}
#: Characters of the base rules and of the classes.
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"
SPACES = " \t\n\x0b\x0c\r"
STRIPPED = ".,;:!?()\"'"
CLASSES = ("lower", "upper", "digit", "space", "punctuation", "symbol", "other", "non_ascii")

VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words})
FEATURES_SCHEMA = ("doc_id long, lang string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                   "n_repeat_words long, class_shares array<double>, common_shares array<double>")
_ARROW = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("text_hash", pa.int64()), *((c, pa.int64()) for c in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    ("class_shares", pa.list_(pa.float64())), ("common_shares", pa.list_(pa.float64()))])

_CLASS_OF = np.full(256, CLASSES.index("other"))
_CLASS_OF[0x80:] = CLASSES.index("non_ascii")
for _name, _chars in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"),
                      ("space", SPACES), ("punctuation", PUNCTUATION), ("symbol", SYMBOLS)):
    _CLASS_OF[[ord(c) for c in _chars]] = CLASSES.index(_name)
#: A word counts as common in lower case or with a capital, not in capitals throughout.
_FORMS = [(w.encode(), w.capitalize().encode()) for w in VOCABULARY]
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of ``width`` words that occur twice or more, all occurrences included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            rolled = rolled * _MULTIPLIER + codes[j:n + j]
    order = np.argsort(rolled)
    equal = rolled[order[1:]] == rolled[order[:-1]]
    if not equal.any():
        return 0
    suspects = np.unique(np.concatenate([order[1:][equal], order[:-1][equal]]))
    windows = [tuple(words[i:i + width]) for i in suspects]      # equal codes are confirmed on the words themselves
    seen = Counter(windows)
    step = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(suspects, windows, strict=True):
        if seen[w] > 1:
            step[i] += 1
            step[i + width] -= 1
    return int((np.cumsum(step) > 0).sum())


def text_features(text: str) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_shares, common_shares) of a whole text."""
    raw = text.encode()
    words = raw.split()                     # bytes split at the six ASCII white-space characters
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    counts[0x80:0xC0] = 0                   # continuation bytes: one count per code point
    classes = np.bincount(_CLASS_OF, weights=counts, minlength=len(CLASSES)).astype(np.int64)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    stripped = Counter([w.strip(STRIPPED.encode()) for w in words])
    common = [stripped.get(a, 0) + (stripped.get(b, 0) if a != b else 0) for a, b in _FORMS]
    common.append(len(words) - sum(common))
    return (len(words), int(counts.sum() - classes[CLASSES.index("space")]), int(classes[CLASSES.index("symbol")]),
            len(lines) - len(set(lines)), repeated_words(words), (classes / max(1, counts.sum())).tolist(),
            [n / max(1, len(words)) for n in common])


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """FEATURES_SCHEMA, one row per document, whole texts (null: empty); text_hash tells rows of one id apart."""
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_features(t.as_py() or "") for t in batch.column(1)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *(
                pa.array(c, f.type) for c, f in zip(cols, list(_ARROW)[3:], strict=True))], schema=_ARROW)

    picked = docs.select(docs[id_col].cast("long"), docs[text_col].cast("string"), docs[lang_col].cast("string"),
                         F.xxhash64(docs[text_col].cast("string")))
    return picked.mapInArrow(features, FEATURES_SCHEMA)


def base_failed(min_words: int = 20, repeat_percent: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(repeat_percent) * F.col("n_words"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares (base 2, 0 to 1)."""
    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def language_references(features: DataFrame) -> DataFrame:
    """One row per language: mean shares over the given documents, and their words."""
    n, m = len(CLASSES), len(VOCABULARY) + 1
    sums = features.groupBy("lang").agg(F.sum("n_words").alias("ref_words"),
                                        *[F.avg(F.col("class_shares")[i]).alias(f"c{i}") for i in range(n)],
                                        *[F.avg(F.col("common_shares")[i]).alias(f"w{i}") for i in range(m)])
    return sums.select(F.col("lang").alias("ref_lang"), "ref_words", F.array(*[f"c{i}" for i in range(n)]).alias("ref_classes"),
                       F.array(*[f"w{i}" for i in range(m)]).alias("ref_common"))


def with_distances(features: DataFrame, references: DataFrame, min_chars: int, min_words: int,
                   min_reference_words: int) -> DataFrame:
    """Adds class_distance and common_distance, null where a text or its language's reference is too short."""
    joined = features.join(references, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    enough = F.col("ref_words") >= min_reference_words
    return joined.select(
        *features.columns,
        F.when(enough & (F.col("word_chars") >= min_chars),
               js_distance(F.col("class_shares"), F.col("ref_classes"))).alias("class_distance"),
        F.when(enough & (F.col("n_words") >= min_words),
               js_distance(F.col("common_shares"), F.col("ref_common"))).alias("common_distance"))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    min_chars: int = 100, min_words: int = 50, min_reference_words: int = 2000,
                    class_limit: tuple[float, float] = (0.14, 0.5), common_limit: tuple[float, float] = (0.30, 1.5)) -> DataFrame:
    """One row per document: the base features, both distances (null where not compared), base_failed, kept.

    ``kept`` is false for documents that fail the base rules or lie further from their language's reference
    than a limit ``a + b / sqrt(n_words)``: short texts scatter more.  Distances are compared from ``min_chars``
    characters outside white space and ``min_words`` words on, and for languages with ``min_reference_words`` words in
    the reference.  References are taken twice: over all documents that pass the base rules, then over those of them
    that were compared and lie within ``a`` of the first reference, so that junk doesn't shape what it is
    compared with.  A language with no second reference is not compared.

    A null or empty text has no words and fails.  Documents without a language form a group of their
    own.  Repeated rows are scored alike, each in its own row.  An empty table gives no rows.  Other
    columns are not read.
    """
    ship_package(docs.sparkSession)
    features = written(document_features(docs, id_col, text_col, lang_col))
    guards = (min_chars, min_words, min_reference_words)
    passing = features.where(~base_failed())
    first = with_distances(passing, language_references(passing), *guards)
    near = (F.col("class_distance") <= class_limit[0]) & (F.col("common_distance") <= common_limit[0])
    scored = with_distances(features, language_references(first.where(near)), *guards)

    def beyond(distance: str, limit: tuple[float, float]) -> Column:
        return F.coalesce(F.col(distance) > F.lit(limit[0]) + F.lit(limit[1]) / F.sqrt("n_words"), F.lit(False))

    far = beyond("class_distance", class_limit) | beyond("common_distance", common_limit)
    scored = scored.withColumn("base_failed", base_failed())
    return scored.select("doc_id", "text_hash", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "class_distance", "common_distance", "base_failed", (~F.col("base_failed") & ~far).alias("kept"))


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **limits) -> DataFrame:
    """The rows of ``docs`` that ``score_documents`` keeps, with the columns of ``docs``; edge cases as there."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = {c: F.col(n) for c, n in zip(reversed(docs.columns), reversed(names), strict=True)}
    rejected = score_documents(docs, id_col, text_col, lang_col, **limits).where(~F.col("kept")).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("lang").alias("_lang")).distinct()
    same = (at[id_col].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(at[text_col].cast("string")) == F.col("_hash"))
            & at[lang_col].cast("string").eqNullSafe(F.col("_lang")))
    return docs.toDF(*names).join(rejected, same, "left_anti").toDF(*docs.columns)
