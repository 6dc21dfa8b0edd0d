"""SQL that gives the same rows as the registered queries."""

from shopgrain.llm import quality_rules as q

ORACLE: dict[str, str] = {}

ORACLE["op10_exact_dedup"] = r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS n,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
    FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER best = 1 AS kept, h AS text_sha256
FROM d WINDOW best AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""

ORACLE["op4_mixing"] = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE * 2.0 AS cut,
           ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS weight
    FROM d GROUP BY source
), l AS (
    SELECT *, cut / weight AS ratio,
           (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cut) OVER (
               ORDER BY cut / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
           / sum(weight) OVER (
               ORDER BY cut / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM s
), t AS (
    SELECT source, source_size, least(cut, weight * (SELECT max(level) FROM l WHERE level <= ratio)) AS target FROM l
), r AS (
    SELECT d.*, t.source_size, t.target,
           CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
           ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""


def _weak_supervision() -> str:
    """The signals, the votes, and the steps of the estimation one after the other."""
    rules = list(q.RULES)
    first = q.RuleModel()
    share = {
        "symbols": "n_symbols / nullif(n_words, 0)", "word_length": "word_chars / nullif(n_words, 0)",
        "line_copies": "n_dup_lines / nullif(n_lines, 0)", "window_copies": "n_repeat_words / nullif(n_words, 0)",
        "capitals": "n_capitals / nullif(word_chars, 0)",
        "line_ends": "CASE WHEN n_lines > 1 THEN n_ended / n_lines END",
        "stop_words": "n_stops / nullif(n_words, 0)", "variety": "n_distinct / nullif(sqrt(n_words), 0)",
    }
    bounds = {
        "symbols": ("< 0.02", "> 0.1"), "word_length": ("BETWEEN 4 AND 7", "NOT BETWEEN 3 AND 9"),
        "line_copies": ("< 0.1", "> 0.4"), "window_copies": ("< 0.05", "> 0.3"), "capitals": ("< 0.15", "> 0.3"),
        "line_ends": (">= 0.8", "< 0.3"), "stop_words": (">= 0.06", "< 0.02"), "variety": (">= 3", "< 2"),
    }
    votes = ", ".join(
        f"CASE WHEN x_{k} {bounds[k][1]} THEN -1 WHEN x_{k} {bounds[k][0]} THEN 1 ELSE 0 END AS {k}" for k in rules
    )
    odds = "ln(good) - ln(1 - good)" + "".join(
        f" + CASE {k} WHEN 1 THEN ln(g_{k} / (1 - b_{k})) WHEN -1 THEN ln((1 - g_{k}) / b_{k}) ELSE 0 END" for k in rules
    )
    post = f"1 / (1 + exp(-({odds})))"

    def belief(right: str, of: str, guess: float, least: float, name: str) -> str:
        return (f"least({q.MOST}::DOUBLE, greatest({least}::DOUBLE, (coalesce({right}, 0) + {q.FIRST_GUESS * guess}::DOUBLE)"
                f" / (coalesce({of}, 0) + {q.FIRST_GUESS}::DOUBLE))) AS {name}")

    def total(of: str, when: str) -> str:
        return f"sum(CASE WHEN {when} THEN {of} ELSE 0 END)"

    step = ", ".join(
        [belief("sum(p)", "sum(n)", first.good, q.LEAST, "good")]
        + [belief(total("p", f"{k} = 1"), total("p", f"{k} <> 0"), first.right_good[k], 0.5, f"g_{k}") for k in rules]
        + [belief(total("n - p", f"{k} = -1"), total("n - p", f"{k} <> 0"), first.right_bad[k], q.LEAST, f"b_{k}")
           for k in rules]
    )
    start = ", ".join(
        [f"{first.good}::DOUBLE AS good"] + [f"{first.right_good[k]}::DOUBLE AS g_{k}" for k in rules]
        + [f"{first.right_bad[k]}::DOUBLE AS b_{k}" for k in rules]
    )
    steps = f"m0 AS (SELECT {start})" + "".join(
        f", m{i} AS MATERIALIZED (SELECT {step} FROM (SELECT t.*, n * ({post}) AS p FROM patterns t, m{i - 1}))"
        for i in range(1, q.STEPS + 1)
    )
    stops = ", ".join(f"'{w}'" for w in q.STOP_WORDS)
    return rf"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
    FROM documents
), grams AS (
    SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g
    FROM (SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)
), again AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM grams) WHERE k > 1
), covered AS (
    SELECT r, sum(least(8, coalesce(next - i, 8))) AS n
    FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM again) GROUP BY r
), s AS MATERIALIZED (
    SELECT d.doc_id, d.r, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
           len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
           (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
           len(l)::DOUBLE AS n_lines,
           len([x FOR x IN l IF regexp_matches(x, '[.!?:;"”»…][\x20\x09-\x0D]*$')])::DOUBLE AS n_ended,
           len(regexp_extract_all(t, '\p{{Lu}}'))::DOUBLE AS n_capitals,
           len([x FOR x IN w IF x IN ({stops})])::DOUBLE AS n_stops, len(list_distinct(w))::DOUBLE AS n_distinct
    FROM d LEFT JOIN covered c ON d.r = c.r
), x AS (
    SELECT *, {", ".join(f"({v}) AS x_{k}" for k, v in share.items())} FROM s
), v AS MATERIALIZED (
    SELECT *, {votes} FROM x
), patterns AS MATERIALIZED (
    SELECT {", ".join(rules)}, count(*)::DOUBLE AS n FROM v GROUP BY ALL
), {steps}, judged AS (
    SELECT v.*, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEATED_PERCENT} * n_words AS base_failed,
           {post} AS posterior
    FROM v, m{q.STEPS}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND posterior >= 0.5 AS kept
FROM judged
"""


ORACLE["op5_quality_rules"] = _weak_supervision()


def _crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of an expression; the query has the table ``crc`` with its column ``steps``."""
    size, byte = f"octet_length(encode({text}))", f"('0x' || substr(hex(encode({text})), (2 * i + 1)::INT, 2))::BIGINT"
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, {size}), lambda i: {byte})), "
            "lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])), 4294967295)")


_CRC_TABLE = """crc AS (
    SELECT list_transform(range(0, 256), lambda i: list_reduce(
        [i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))) AS steps
)"""


def _spelling() -> str:
    """Near words share the word without one letter, at the same place or as a word; a way to the root has few steps."""
    steps = 8
    ways = "".join(
        f", w{i} AS (SELECT w.word, coalesce(f.form, w.root) AS root FROM w{i - 1} w LEFT JOIN f ON f.word = w.root)"
        for i in range(1, steps + 1)
    )
    return rf"""
WITH {_CRC_TABLE}, found AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents
), hashed AS (
    SELECT run, k, {_crc32("doc || ':' || run")} AS h
    FROM (SELECT doc, run, count(*) AS k FROM found WHERE length(run) >= 7 GROUP BY ALL), crc
), words AS MATERIALIZED (
    SELECT word, sum(k)::BIGINT AS n
    FROM (SELECT k, CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
                    ELSE run END AS word FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), cut AS MATERIALIZED (
    SELECT word, n, length(word) AS l, i, left(word, (i - 1)::INT) || substr(word, (i + 1)::INT) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
    SELECT DISTINCT * FROM (
        SELECT a.word, a.n, b.word AS other, b.n AS other_n
        FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.l = b.l AND a.word <> b.word
        UNION ALL SELECT c.word, c.n, w.word, w.n FROM cut c JOIN words w ON w.word = c.rest
        UNION ALL SELECT w.word, w.n, c.word, c.n FROM cut c JOIN words w ON w.word = c.rest)
), best AS (
    SELECT word, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS other, max(other_n) AS other_n
    FROM pairs GROUP BY word
), forms AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form,
           CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
    FROM words w LEFT JOIN best USING (word)
), f AS (
    SELECT word, form FROM forms WHERE form IS NOT NULL
), w0 AS (
    SELECT word, word AS root FROM words
){ways}
SELECT word, form, root, n, n_near, form_n FROM forms JOIN w{steps} USING (word)
"""


ORACLE["op12_spelling_variants"] = _spelling()

ORACLE["op13_conversation_trie"] = rf"""
WITH {_CRC_TABLE}, t AS (
    SELECT conv_id, turn, length(coalesce(text, '')) AS n,
           sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS g
    FROM conversations WHERE conv_id IS NOT NULL
), c AS MATERIALIZED (
    SELECT conv_id, list({{'g': g, 'n': n}} ORDER BY turn NULLS FIRST, g) AS l FROM t GROUP BY conv_id
), h AS MATERIALIZED (
    SELECT conv_id, l, ({_crc32("conv_id::VARCHAR")} % 6)::INT AS h FROM c, crc
), f AS MATERIALIZED (
    SELECT h.conv_id, list_concat(coalesce(list_slice(b.l, 1, h.h), []), list_slice(h.l, h.h + 1, len(h.l))) AS l
    FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 100
), p AS MATERIALIZED (
    SELECT conv_id, d, d = len(l) AS last, CASE WHEN d > 0 THEN l[d].n ELSE 0 END AS chars,
           sha256(array_to_string(list_transform(list_slice(l, 1, d), lambda x: x.g), ',')) AS k,
           CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(list_slice(l, 1, d - 1), lambda x: x.g), ',')) END AS up
    FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1))::INT AS d FROM f)
), n AS MATERIALIZED (
    SELECT d, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
    FROM p GROUP BY d, k
), kids AS (
    SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL
), m AS MATERIALIZED (
    SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (d, k)
), sums AS (
    SELECT p.d, p.k, count(*) FILTER (m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.chars)::BIGINT AS saved_tokens
    FROM m JOIN p ON p.conv_id = m.conv_id AND p.d <= m.d GROUP BY p.d, p.k
)
SELECT m.conv_id, m.d::BIGINT AS depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN sums USING (d, k) LEFT JOIN m o ON o.d = m.d - 1 AND o.k = m.up
"""
