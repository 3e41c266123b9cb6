"""What the queries return, in SQL, where SQL can express it on whole tables."""

from __future__ import annotations

from quern.llm.weak_rules import FUNCTION_WORDS

BLANK = r"[\x20\x09-\x0D]"
WORDS = f"list_filter(regexp_split_to_array(coalesce({{text}}, ''), '{BLANK}+'), lambda w: w <> '')"

ORACLE: dict[str, str] = {}

#: The formatted length counts each backslash, ### and </turn> of a text with the backslash before it, and the marks around.
ORACLE["op1_chat_prefix_tree"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + length(role) + length('### : </turn>') + 1 AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def _rules_sql(rounds: int = 20) -> str:
    """Counts, votes (0 bad, 1 good, 2 abstains) and the rounds of expectation-maximisation, one CTE each."""
    n = "CAST(greatest(n_words, 1) AS DOUBLE)"
    rules = {
        "symbols": (f"n_symbols / {n} > 0.1", f"n_symbols / {n} < 0.02"),
        "capitals": (f"n_capital_pairs / {n} > 0.5", f"n_capital_pairs / {n} < 0.1"),
        "function_words": (f"n_function / {n} < 0.05", f"n_function / {n} > 0.12"),
        "repeats": (f"n_repeat_words / {n} > 0.3", f"n_repeat_words / {n} < 0.1"),
        "lines": ("n_dup_lines / greatest(n_lines, 1) > 0.3", "n_dup_lines / greatest(n_lines, 1) < 0.1"),
        "word_length": (f"word_chars / {n} > 6.5 OR word_chars / {n} < 2.5", f"word_chars / {n} BETWEEN 3 AND 6"),
        "variety": (f"n_distinct / {n} < 0.2 AND n_words < 2000", f"n_distinct / {n} > 0.35 AND n_words >= 50"),
    }
    votes = ", ".join(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 ELSE 2 END AS v{i}" for i, (bad, good) in enumerate(rules.values()))
    names = [f"v{i}" for i in range(len(rules))]
    first = lambda *chances: f"CAST([{', '.join(map(str, chances * len(rules)))}] AS DOUBLE[])"  # noqa: E731  of voting bad, good, not at all
    odds = "ln(prior / (1 - prior)) + " + " + ".join(f"ln(g[{3 * i} + {v} + 1] / b[{3 * i} + {v} + 1])" for i, v in enumerate(names))
    chance = f"1 / (1 + exp(-({odds})))"
    sums = lambda of: ", ".join(f"sum(CASE WHEN {v} = {k} THEN {of} ELSE 0 END)" for v in names for k in range(3))
    words = ", ".join(f"'{w}'" for w in FUNCTION_WORDS)
    steps = [f"m0 AS MATERIALIZED (SELECT CAST(0.8 AS DOUBLE) AS prior, {first(0.1, 0.7, 0.2)} AS g, {first(0.5, 0.3, 0.2)} AS b)"]
    for r in range(1, rounds + 1):
        steps.append(
            f"s{r} AS MATERIALIZED (SELECT sum(n) AS total, sum(good) AS good, [{sums('good')}] AS gs, [{sums('n - good')}] AS bs FROM (SELECT p.*, n * {chance} AS good FROM patterns p, m{r - 1}))"
            f", m{r} AS MATERIALIZED (SELECT (good + 1) / (total + 2) AS prior, list_transform(gs, lambda x: (x + 1) / (good + 3)) AS g, list_transform(bs, lambda x: (greatest(x, 0) + 1) / (total - good + 3)) AS b FROM s{r})"
        )
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT r, doc_id, text, {WORDS.format(text="text")} AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
windows AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
often AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM often, (SELECT unnest(range(3)) AS k) GROUP BY r),
counts AS (
  SELECT w.r, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{BLANK}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(list_distinct(words)) AS BIGINT) AS n_distinct,
    CAST(len(list_filter(words, lambda x: x IN ({words}))) AS BIGINT) AS n_function, CAST(len(regexp_extract_all(text, '\\p{{Lu}}\\p{{Lu}}')) AS BIGINT) AS n_capital_pairs,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered USING (r)
),
votes AS MATERIALIZED (SELECT *, {votes} FROM counts),
patterns AS MATERIALIZED (SELECT {", ".join(names)}, count(*) AS n FROM votes GROUP BY ALL),
{", ".join(steps)},
done AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {chance} AS posterior FROM votes, m{rounds})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND posterior >= 0.5 AS kept, round(posterior, 6) AS posterior FROM done
"""


ORACLE["op2_quality_rules"] = _rules_sql()

#: Shingles are compared as such; only pairs that share one can be linked.
ORACLE["op6_near_duplicates"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE len(words) WHEN 0 THEN [] WHEN 1 THEN words ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS s FROM w
),
one AS MATERIALIZED (SELECT min(doc_id) AS id, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
elements AS MATERIALIZED (SELECT id, len(s) AS n, unnest(s) AS e FROM one),
links AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b FROM elements a JOIN elements b ON a.e = b.e AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
least_of AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY a),
named AS (SELECT s, least(id, coalesce(c, id)) AS c FROM one LEFT JOIN least_of USING (id))
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept
FROM sets LEFT JOIN named ON list_sort(sets.s) = named.s
"""


def _crc_table() -> list[int]:
    """What CRC-32 does to each number of four bits."""
    out = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


_HALF = "xor({c} >> 4, t[CAST((xor({c}, {b}) & 15) + 1 AS INTEGER)])"
_CRC = "xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda c, b: {step}, 4294967295::BIGINT), 4294967295)"


def _shards_sql(shards: int = 24, cells: int = 1 << 14) -> str:
    low = _HALF.format(c="c", b="b").replace("t[", f"[{', '.join(map(str, _crc_table()))}][")
    step = f"list_transform([{low}], lambda d: {_HALF.format(c='d', b='(b >> 4)')})[1]".replace("t[CAST", f"[{', '.join(map(str, _crc_table()))}][CAST")
    # a walk's state is one number: shards opened, times 2 ** 50, and the load of the last one
    walk = f"list_reduce(g, lambda s, x: CASE WHEN s % {1 << 50} + x > {{cap}} THEN (s // {1 << 50} + 1) * {1 << 50} + x ELSE s + x END, CAST({1 << 50} AS HUGEINT))"
    needed = walk.format(cap="((lo + hi) // 2)") + f" // {1 << 50}"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
sized AS MATERIALIZED (SELECT doc_id, CAST(octet_length(encode(text)) + 8 AS BIGINT) AS size, CAST(CASE WHEN text = '' THEN 0 ELSE {_CRC.format(step=step)} END AS BIGINT) AS text_crc32 FROM d),
cells AS MATERIALIZED (SELECT text_crc32 % {cells} AS cell, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n, row_number() OVER (ORDER BY text_crc32 % {cells}) AS i FROM sized GROUP BY text_crc32 % {cells}),
listed AS MATERIALIZED (SELECT list(CAST(bytes AS HUGEINT) ORDER BY cell) AS g, max(bytes) AS most, sum(bytes) AS total, CAST(greatest(1, 4 * ceil(sum(n) / {cells})) AS BIGINT) AS at_once FROM cells),
search AS (
  SELECT CAST(most AS BIGINT) AS lo, CAST(total AS BIGINT) AS hi FROM listed
  UNION ALL SELECT CAST(CASE WHEN {needed} <= {shards} THEN lo ELSE (lo + hi) // 2 + 1 END AS BIGINT), CAST(CASE WHEN {needed} <= {shards} THEN (lo + hi) // 2 ELSE hi END AS BIGINT) FROM search, listed WHERE lo < hi
),
cap AS MATERIALIZED (SELECT min(hi) AS cap FROM search),
walk AS (
  SELECT cell, n, i, bytes AS load, 0 AS shard FROM cells WHERE i = 1
  UNION ALL SELECT c.cell, c.n, c.i, CASE WHEN load + c.bytes > cap THEN c.bytes ELSE load + c.bytes END, shard + CAST(load + c.bytes > cap AS INTEGER) FROM walk w JOIN cells c ON c.i = w.i + 1, cap
),
placed AS (
  SELECT s.*, w.cell, w.shard, ((coalesce(doc_id, 0) % {1 << 31} + {1 << 31}) % {1 << 31}) * 48271 % 2147483647 % CAST(ceil(w.n / at_once) AS BIGINT) AS part
  FROM sized s JOIN walk w ON s.text_crc32 % {cells} = w.cell, listed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY cell, part, text_crc32, size, doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed
"""


ORACLE["op10_sharding"] = _shards_sql()
