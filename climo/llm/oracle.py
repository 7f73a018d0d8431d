"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from climo.llm import personal, quality

#: Words, as the contracts define them.
WORD = r"[^\x20\x09-\x0D]+"


def quality_sql() -> str:
    vocabulary = ", ".join("'" + w + "'" for w in quality.VOCABULARY)
    classes = ", ".join(f"length(regexp_replace(text, '{c}', '', 'g'))" for c in (
        "[^a-z]", "[^A-Z]", "[^0-9]", r"[^\x20\x09-\x0D]", r"[^.,;:!?''\"()\-]", "[^#*$%&|<>]",
        r"[^/=@\[\]\\\^_`{}~+\x00-\x08\x0E-\x1F\x7F]", r"[\x00-\x7F]"))

    def means(name: str, n: int) -> str:
        return "[" + ", ".join(f"avg({name}[{i + 1}])" for i in range(n)) + "]"

    def reference(source: str) -> str:
        return (f"SELECT lang, sum(n_words) AS rw, {means('p', len(quality.CLASSES))} AS rc, "
                f"{means('q', len(quality.VOCABULARY) + 1)} AS rm FROM {source} GROUP BY lang")

    def js(p: str, q: str) -> str:
        mid = f"(({p}[i] + {q}[i]) / 2)"
        return (f"sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: "
                f"CASE WHEN {p}[i] > 0 THEN {p}[i] * log2({p}[i] / {mid}) ELSE 0 END + "
                f"CASE WHEN {q}[i] > 0 THEN {q}[i] * log2({q}[i] / {mid}) ELSE 0 END)) / 2, 0))")

    def distances(source: str, ref: str) -> str:
        return (f"SELECT f.*, CASE WHEN rw >= 2000 AND word_chars >= 100 THEN {js('p', 'rc')} END AS class_distance, "
                f"CASE WHEN rw >= 2000 AND n_words >= 50 THEN {js('q', 'rm')} END AS common_distance "
                f"FROM {source} f LEFT JOIN {ref} r ON f.lang IS NOT DISTINCT FROM r.lang")

    return f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS ws FROM t)),
win AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g FROM w),
rep AS (SELECT doc_id, i, CASE WHEN len(g) = 8 AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS r FROM win),
cov AS (SELECT doc_id, max(r) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM rep),
nrep AS (SELECT doc_id, sum(c)::BIGINT AS n_repeat_words FROM cov GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
ndup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
         WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
common AS (SELECT doc_id, lower(s) AS s, count(*) AS n FROM (SELECT doc_id, trim(word, '.,;:!?()"''') AS s FROM w)
           WHERE lower(s) IN ({vocabulary}) AND (s = lower(s) OR s = upper(s[1]) || lower(s)[2:]) GROUP BY ALL),
counted AS (SELECT doc_id, map(list(s), list(n)) AS n, sum(n)::BIGINT AS total FROM common GROUP BY doc_id),
base AS (
  SELECT t.doc_id, t.lang, len(regexp_extract_all(text, '{WORD}')) AS n_words, length(text) AS len,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, [{classes}] AS cc,
    list_transform([{vocabulary}], lambda x: coalesce(counted.n[x], 0)) AS mc, coalesce(counted.total, 0) AS mt
  FROM t LEFT JOIN nrep USING (doc_id) LEFT JOIN ndup USING (doc_id) LEFT JOIN counted USING (doc_id)),
f AS (SELECT doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        list_transform(cc, lambda x: CASE WHEN len > 0 THEN x / len ELSE 0.0::DOUBLE END) AS p,
        list_transform(list_append(mc, n_words - mt), lambda x: CASE WHEN n_words > 0 THEN x / n_words ELSE 0.0::DOUBLE END) AS q
      FROM base),
passing AS (SELECT * FROM f WHERE NOT base_failed),
r1 AS ({reference("passing")}),
d1 AS ({distances("passing", "r1")}),
near AS (SELECT * FROM d1 WHERE class_distance <= 0.14 AND common_distance <= 0.30),
r2 AS ({reference("near")}),
d2 AS ({distances("f", "r2")})
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, class_distance, common_distance, base_failed,
  NOT base_failed AND NOT coalesce(class_distance > 0.14 + 0.5 / sqrt(n_words), false)
    AND NOT coalesce(common_distance > 0.30 + 1.5 / sqrt(n_words), false) AS kept
FROM d2
"""


#: The base patterns as the contract states them (RE2 neither recurses nor backtracks).
BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal_sql() -> str:
    luhn = ("list_sum(list_transform(range(1, len(digits) + 1), lambda j: CASE WHEN j % 2 = 1 THEN reverse(digits)[j]::INT "
            "ELSE reverse(digits)[j]::INT * 2 - CASE WHEN reverse(digits)[j]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0")
    mod97 = ("list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(compact, 5) || substr(compact, 1, 4), ''), "
             "lambda c: (strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1)::BIGINT)), "
             "lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1 AND len(compact) BETWEEN 15 AND 34")
    checks = {
        "none": "true", "luhn": f"len(digits) BETWEEN 16 AND 19 AND {luhn}", "luhn15": luhn,
        "octets": "list_min(list_transform(string_split(m, '.'), lambda p: regexp_matches(p, "
                  "'^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$')::INT)) = 1",
        "phone": "len(digits) BETWEEN 8 AND 15", "mod97": mod97,
        "ssn": "NOT regexp_matches(digits, '^(?:000|666|9)|^[0-9]{3}00|0000$')",
    }
    found, spans = [], []
    for i, k in enumerate(personal.KINDS):
        pattern = BASE_PATTERNS[k.name] if k.base else k.pattern
        found.append(f"SELECT doc_id, {i} AS rank, regexp_extract_all(text, '{pattern}') AS ms, "
                     f"string_split_regex(text, '{pattern}') AS gaps FROM t")
        if k.base:
            spans.append(f"SELECT doc_id, rank, s, e FROM p WHERE rank = {i} AND {checks[k.confirm]}")
        else:
            near = f"regexp_matches(lower(substr(text, greatest(s - 40, 0) + 1, s - greatest(s - 40, 0))), '(?:^|[^a-z])(?:{k.context})')"
            spans.append(f"SELECT doc_id, rank, s, e FROM p JOIN t USING (doc_id) WHERE rank = {i} AND ({checks[k.confirm]}) "
                         f"AND NOT (s > 0 AND regexp_matches(substr(text, s, 1), '[A-Za-z0-9-]')) "
                         f"AND NOT regexp_matches(substr(text, e + 1, 1), '[A-Za-z0-9-]') "
                         f"AND {k.score} + CASE WHEN {near} THEN {k.boost} ELSE 0 END >= {personal.THRESHOLD}")
    n = sum(k.base for k in personal.KINDS)
    names = "[" + ", ".join(f"'{k.name}'" for k in personal.KINDS) + "]"
    counts = ", ".join(f"count(*) FILTER (rank = {i})::BIGINT AS n_{k.name}" for i, k in enumerate(personal.KINDS) if k.base)
    text = f"{names}[rank + 1] || ':' || s || ':' || e"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(found)}),
u AS (SELECT doc_id, rank, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM f WHERE len(ms) > 0),
q AS (SELECT doc_id, rank, ms[i] AS m, (coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)
        + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::INT AS s FROM u),
p AS (SELECT *, (s + length(m))::INT AS e, regexp_replace(m, '[^0-9]', '', 'g') AS digits, replace(m, ' ', '') AS compact FROM q),
a AS ({" UNION ALL ".join(spans)}),
k AS (SELECT * FROM a x WHERE rank < {n} OR NOT EXISTS (SELECT 1 FROM a b WHERE b.doc_id = x.doc_id AND b.rank < {n} AND b.s < x.e AND x.s < b.e)),
g AS (SELECT doc_id, {counts}, coalesce(string_agg({text}, ',' ORDER BY rank, s) FILTER (rank < {n}), '') AS base,
        string_agg({text}, ',' ORDER BY rank, s) AS spans FROM k GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in personal.KINDS if k.base)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (doc_id)
"""


def chat_sql() -> str:
    """All but n_tokens follows from the turns."""
    return r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, regexp_replace(text, '(\\|</?turn)', '\\\1', 'g') AS escaped FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<turn >') + length(role) + 1 + length(escaped) + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""


def mixing_sql() -> str:
    return rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size,
    coalesce(greatest(0.25, 1.0::DOUBLE - 6.0::DOUBLE * ((length(text) - length(translate(text, '#*$%&|<>!', '')))::DOUBLE
      / greatest(length(text), 1))), 1.0::DOUBLE) AS q,
    (('0x' || substr(md5(doc_id::VARCHAR || ':7'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
k AS (SELECT doc_id, source, size, -ln(u) / q AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, 3.0::DOUBLE * source_size AS cap,
        [1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
        row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
l AS (SELECT *, ((SELECT sum(source_size)::DOUBLE FROM s)
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / ((SELECT sum(weight) FROM w)
          - coalesce(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lv
      FROM w),
t AS (SELECT source, source_size, CASE WHEN lv * weight >= cap THEN cap
        ELSE least((SELECT max(lv) FROM l WHERE lv * weight < cap) * weight, cap) END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
o AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
        sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.size, k.doc_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
c AS (SELECT *, epochs + (rest > 0 AND upto - size / 2.0::DOUBLE <= rest)::BIGINT AS copies FROM o)
SELECT doc_id, size::BIGINT AS size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM c
"""


def lines_sql() -> str:
    return r"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
c AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS code FROM l),
m AS (SELECT *, (coalesce(lag(code) OVER w, 0) * 31 + code) % 4 = 0 AS marked FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT *, marked AND NOT coalesce(lag(marked) OVER w, false) AS ends FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e),
k AS (SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS lines, min(i) AS pos FROM n GROUP BY ALL),
g AS (SELECT *, lines > 1 AND regexp_matches(body, '[^\x20\x09-\x0D]')
        AND row_number() OVER (PARTITION BY body, lines > 1 ORDER BY doc_id, chunk) > 1 AS gone FROM k),
t AS (SELECT doc_id, count(*) FILTER (gone) AS removed_chunks, coalesce(sum(lines) FILTER (NOT gone), 0) AS kept,
        coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM g GROUP BY doc_id)
SELECT doc_id, removed_chunks::BIGINT AS removed_chunks, (CASE WHEN text = '' THEN 0 ELSE kept END)::BIGINT AS lines_left,
  length(text)::BIGINT AS chars_left, sha256(text) AS text_sha256
FROM t
"""


def near_duplicates_sql(width: int = 3, percent: int = 85) -> str:
    """Brute force: every pair of documents that shares a shingle."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - {width - 1}, 1) + 1),
        lambda i: array_to_string(ws[i:i + {width - 1}], ' '))) AS shingle FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n a ON u = a.doc_id JOIN n b ON v = b.doc_id WHERE 100 * i >= {percent} * (a.n + b.n - i)),
e AS (SELECT u AS a, v AS b FROM l UNION ALL SELECT v, u FROM l),
r(id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT id AS doc_id, min(reach) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def vectors_sql(threshold: float = 0.93) -> str:
    """Brute force: every pair of vectors with equal labels."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= {threshold}),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r(id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN c ON e.vec_id = c.id
"""


#: CRC-32 (reflected polynomial 0xEDB88320): what a byte does to the state.
CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS steps FROM (
  SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
  FROM (SELECT unnest(range(256)) AS i)))"""


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of ``text``'s UTF-8 bytes, with ``CRC_TABLE``'s table in scope as ``ct``."""
    octets = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda b: ('0x' || substr(hex(encode({text})), 2 * b - 1, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, ct.steps[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


def merkle_sql() -> str:
    """Both trees level by level, every leaf's siblings, and every (tampered) leaf folded through them."""
    def leaf(n_chars: str) -> str:
        fields = ("doc_id", "source", "lang", n_chars, "text")
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode(({f})::VARCHAR)) || ':' || ({f})::VARCHAR, '-')" for f in fields) + ")"

    return rf"""
WITH RECURSIVE {CRC_TABLE},
l AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {leaf("n_chars")} AS leaf, {leaf("n_chars + 1")} AS changed,
        {crc32_sql("doc_id::VARCHAR")} % 7 = 0 AS tampered FROM documents, crc_table ct),
n AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size FROM l),
t(tree, level, pos, digest, size) AS (
  SELECT tree, 0, pos, leaf, size FROM n
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (size + 1) // 2 FROM t WHERE size > 1
  GROUP BY tree, level, pos // 2, size),
s AS (SELECT tree, level AS height, digest FROM t WHERE size = 1),
u(level, pos, digest, size) AS (
  SELECT 0, row_number() OVER (ORDER BY encode(tree)) - 1, digest, count(*) OVER () FROM s
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (size + 1) // 2 FROM u WHERE size > 1
  GROUP BY level, pos // 2, size),
k AS (SELECT tree, height, digest AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS rank FROM s),
p AS (SELECT n.tree, n.pos, t.level, (n.pos >> t.level) & 1 AS odd, m.digest AS mate
      FROM n JOIN t ON t.tree = n.tree AND t.pos = n.pos >> t.level AND t.size > 1
      LEFT JOIN t m ON m.tree = t.tree AND m.level = t.level AND m.pos = xor(t.pos, 1)
      UNION ALL
      SELECT n.tree, n.pos, k.height + u.level, (k.rank >> u.level) & 1, m.digest
      FROM n JOIN k ON k.tree = n.tree JOIN u ON u.pos = k.rank >> u.level AND u.size > 1
      LEFT JOIN u m ON m.level = u.level AND m.pos = xor(u.pos, 1)),
a AS (SELECT n.tree, n.pos, coalesce(list(coalesce(mate, '') ORDER BY level) FILTER (level IS NOT NULL), []) AS mates,
        list(odd ORDER BY level) AS odds FROM n LEFT JOIN p ON p.tree = n.tree AND p.pos = n.pos GROUP BY ALL),
f(tree, pos, step, digest) AS (
  SELECT tree, pos, 1, CASE WHEN tampered THEN changed ELSE leaf END FROM n
  UNION ALL
  SELECT f.tree, f.pos, step + 1, sha256(CASE WHEN odds[step] = 1 THEN mates[step] || digest ELSE digest || mates[step] END)
  FROM f JOIN a ON a.tree = f.tree AND a.pos = f.pos WHERE step <= len(mates)),
g AS (SELECT f.tree, f.pos, digest AS folded_root FROM f JOIN a ON a.tree = f.tree AND a.pos = f.pos WHERE step = len(mates) + 1),
r AS (SELECT digest AS root FROM u WHERE size = 1)
SELECT n.doc_id, n.leaf, k.subroot, r.root, sha256(array_to_string(a.mates, '')) AS proof_sha256,
  g.folded_root, g.folded_root = r.root AS verified
FROM n JOIN k ON k.tree = n.tree JOIN a ON a.tree = n.tree AND a.pos = n.pos JOIN g ON g.tree = n.tree AND g.pos = n.pos, r
"""


def exact_sql() -> str:
    return """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)
"""


def spelling_sql() -> str:
    """Brute force: all words of nearly equal length against each other, letters as one byte each for ``levenshtein``."""
    accents = "".join(map(chr, range(0xC0, 0x100)))
    plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,-./:;<=>?@[]^_{|}~"
    return rf"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents) GROUP BY ALL),
h AS (SELECT run, n, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM r, crc_table ct),
c AS (SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n, translate(word, '{accents}', '{plain}') AS code
      FROM c WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
x AS (SELECT a.word, b.word AS near, b.n FROM v a JOIN v b ON length(b.code) BETWEEN length(a.code) - 1 AND length(a.code) + 1
      WHERE levenshtein(a.code, b.code) = 1),
b AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, encode(near)) AS best, max(n) AS best_n FROM x GROUP BY word),
w AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * v.n THEN best END AS form,
        CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n FROM v LEFT JOIN b USING (word)),
e(word, root) AS (SELECT word, word FROM w UNION ALL SELECT e.word, w.form FROM e JOIN w ON e.root = w.word WHERE w.form IS NOT NULL)
SELECT w.word, w.form, e.root, w.n, w.n_near, w.form_n FROM w JOIN e ON e.word = w.word JOIN w l ON l.word = e.root WHERE l.form IS NULL
"""


ORACLE = {
    "op11_merkle_manifest": merkle_sql(),
    "op12_exact_dedup": exact_sql(),
    "op13_spelling_variants": spelling_sql(),
    "op1_quality_rules": quality_sql(),
    "op2_personal_data": personal_sql(),
    "op3_chat_format": chat_sql(),
    "op4_mix_sources": mixing_sql(),
    "op8_line_dedup": lines_sql(),
    "op9_minhash_near_dedup": near_duplicates_sql(),
    "op10_vector_near_dedup": vectors_sql(),
}
