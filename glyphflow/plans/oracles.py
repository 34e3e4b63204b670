"""DuckDB SQL for the registered queries, over the same whole tables."""

from __future__ import annotations

from glyphflow.functions.text import SOUND_DIGITS, SOUND_LETTERS
from glyphflow.operators.evaluate import ATTEMPTS, LETTERS
from glyphflow.plans.queries import CORES, GIVEN, PATTERNS, PREFIXES

WS = r"[ \t\n\x0B\f\r]+"


def trimmed(c: str) -> str:
    return rf"regexp_replace({c}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def placed(name: str, source: str, id_col: str = "doc_id") -> str:
    """Common table expressions ``name_l`` (lines) and ``name`` (words with their places)."""
    return rf"""
{name}_l AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS line FROM (SELECT {id_col} AS doc_id, regexp_split_to_array(text, '\r\n|[\n\x0B\f\r]') AS l FROM {source})),
{name} AS (SELECT doc_id, line, word_number, raw, lower(raw) AS word FROM (SELECT doc_id, line, unnest(w) AS raw, generate_subscripts(w, 1) AS word_number FROM (SELECT doc_id, line, regexp_extract_all(t, '\p{{L}}+') AS w FROM {name}_l)))"""


TOK = placed("tok", "documents")
DICT = """
dict AS (SELECT word FROM (SELECT DISTINCT doc_id, word FROM tok) GROUP BY word HAVING count(*) >= 5)"""
COMMON = """
common AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS rank FROM (SELECT word, count(*) AS n FROM tok GROUP BY word ORDER BY n DESC, word LIMIT 1000))"""
RAW_WORDS = rf"""
split AS (SELECT doc_id, regexp_split_to_array(regexp_replace(lower(text), '[^a-zA-Z \t\n\x0B\f\r]', '', 'g'), '{WS}') AS l FROM documents),
raw AS (SELECT doc_id, unnest(CASE WHEN len(l) > 1 AND l[-1] = '' THEN l[:-2] ELSE l END) AS word FROM split)"""
SHORT = """
rare AS (SELECT word FROM {words} WHERE length(word) <= 4 AND word IN (SELECT word FROM dict) AND word NOT IN (SELECT word FROM common))"""


#: Letters of the tables beyond ASCII, and capitals and digits that stand for them, since
#: DuckDB's distance counts bytes.
BEYOND, STAND = "áàâäãåçéèêëíìîïñóòôöõúùûüßœæøÿ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123"


def swaps(a: str, b: str) -> str:
    """Unrestricted distance with swaps, which is never above ``osa`` and equal to it up to 1."""
    return f"damerau_levenshtein(translate({a}, '{BEYOND}', '{STAND}'), translate({b}, '{BEYOND}', '{STAND}'))"


NEAR = f"""
near AS (SELECT DISTINCT s.word FROM {{source}} s JOIN common c ON abs(length(s.word) - length(c.word)) <= 1
  WHERE NOT starts_with(s.word, c.word) AND NOT starts_with(c.word, s.word) AND {swaps('s.word', 'c.word')} = 1)"""


def osa(a: str, b: str) -> str:
    """Edit distance with adjacent swaps, as a fold over rows and cells.  The list folded begins with the rows
    before the first, and holds the number of each further row."""
    cell = f"least(r[y[1]] + 1, s[2][y[1] + 1] + 1, s[2][y[1]] + CAST({a}[x[1][1]] <> {b}[y[1]] AS INTEGER), CASE WHEN x[1][1] > 1 AND y[1] > 1 AND {a}[x[1][1]] = {b}[y[1] - 1] AND {a}[x[1][1] - 1] = {b}[y[1]] THEN s[1][y[1] - 1] + 1 ELSE 99 END)"
    row = f"list_reduce(list_prepend([s[2][1] + 1], list_transform(range(1, length({b}) + 1), lambda j: [CAST(j AS INTEGER)])), lambda r, y: list_append(r, {cell}))"
    first = f"[CAST([] AS INTEGER[]), list_transform(range(0, length({b}) + 1), lambda k: CAST(k AS INTEGER))]"
    return f"list_reduce(list_prepend({first}, list_transform(range(1, length({a}) + 1), lambda i: [[CAST(i AS INTEGER)]])), lambda s, x: [s[2], {row}])[2][length({b}) + 1]"


def sound(c: str) -> str:
    own = rf"regexp_replace(lower({c}), '\P{{L}}', '', 'g')"
    x = f"regexp_replace(translate({own}, '{SOUND_LETTERS}', '{SOUND_DIGITS}'), '[^0-9]', '0', 'g')"
    for d in range(7):
        x = f"regexp_replace({x}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN {own} = '' THEN '0000' ELSE replace(upper({own}[1]), 'ẞ', 'ß') || rpad(replace(substr({x}, 2), '0', ''), 3, '0')[1:3] END"


def in_order(big: str, small: str) -> str:
    return f"({big} LIKE '%' || array_to_string(string_split({small}, ''), '%') || '%')"


ITEMS = placed("btok", "benchmark", "item_id")
ERRORS = (
    "WITH " + ", ".join([TOK, DICT, COMMON, ITEMS, "\nbw AS (SELECT DISTINCT word FROM btok)", SHORT.format(words="bw"), NEAR.format(source="rare")])
    + ",\nerr AS (SELECT word FROM bw WHERE word NOT IN (SELECT word FROM dict) UNION SELECT word FROM near)"
)


def ranked(name: str, words: str, entries: str, most: int, top: int) -> str:
    """Common table expression: candidates within ``most`` edits in the seven-key order."""
    return f"""
{name}_p AS MATERIALIZED (SELECT w.word, d.word AS candidate FROM {words} w JOIN {entries} d ON abs(length(w.word) - length(d.word)) <= {most} AND w.word <> d.word WHERE {swaps('w.word', 'd.word')} <= {most}),
{name}_d AS (SELECT word, candidate, {osa("word", "candidate")} AS distance FROM {name}_p),
{name}_k AS (SELECT p.*, c.rank IS NOT NULL AS common, {in_order("candidate", "p.word")} AS in_order, ({sound("p.word")}) = ({sound("candidate")}) AS sounds_alike, coalesce(c.rank, 2147483647) AS cr FROM {name}_d p LEFT JOIN common c ON c.word = p.candidate WHERE distance <= {most}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, common DESC, in_order DESC, sounds_alike DESC, cr, abs(length(word) - length(candidate)), candidate) AS rank FROM {name}_k) WHERE rank <= {top})"""


def cut(c: str) -> str:
    """What is left of a word when any one letter goes."""
    return f"list_transform(range(1, length({c}) + 1), lambda i: substr({c}, 1, i - 1) || substr({c}, i + 1))"


REST = f"list_distinct(flatten([[word], {cut('word')}, flatten(list_transform({cut('word')}, lambda x: {cut('x')}))]))"


def ranked_by_rest(name: str, words: str, entries: str, top: int) -> str:
    """``ranked`` within two edits for many words: only those with a common remainder are compared."""
    whole = ranked(name, words, entries, 2, top)
    pairs = f"""
{name}_a AS (SELECT word, unnest({REST}) AS rest FROM {words}),
{name}_b AS (SELECT word, unnest({REST}) AS rest FROM {entries}),
{name}_m AS MATERIALIZED (SELECT DISTINCT a.word, b.word AS candidate FROM {name}_a a JOIN {name}_b b USING (rest) WHERE a.word <> b.word),
{name}_p AS MATERIALIZED (SELECT word, candidate FROM {name}_m WHERE {swaps('word', 'candidate')} <= 2),"""
    return pairs + whole[whole.index(f"\n{name}_d AS") :]


LONG = "len(list_filter(range(3, length(word) + 1), lambda i: word[i] = word[i - 1] AND word[i] = word[i - 2])) > 0"


def squeezed(most: int) -> str:
    same = " AND ".join(f"word[i] = word[i - {k}]" for k in range(1, most + 1))
    return f"array_to_string(list_transform(list_filter(range(1, length(word) + 1), lambda i: i <= {most} OR NOT ({same})), lambda i: word[i]), '')"


def staged(words: str) -> str:
    """Common table expressions up to ``staged``."""
    return (
        f"""
stretched AS (SELECT word, unnest([{squeezed(2)}, {squeezed(1)}]) AS form FROM {words} WHERE {LONG}),
forms AS (SELECT DISTINCT form AS word FROM stretched),"""
        + ranked("best", "forms", "dict", 2, 10)
        + f""",
merged AS (SELECT s.word, candidate, min(distance) AS distance, bool_or(common) AS common FROM stretched s JOIN best b ON b.word = s.form GROUP BY s.word, candidate),
one AS (SELECT * FROM (SELECT word, candidate, distance, row_number() OVER (PARTITION BY word ORDER BY common DESC, distance, candidate) AS rank FROM merged) WHERE rank <= 3),
left2 AS (SELECT word FROM {words} WHERE word NOT IN (SELECT word FROM one)),"""
        + ranked("two", "left2", "dict", 2, 3)
        + """,
left3 AS (SELECT word FROM left2 WHERE word NOT IN (SELECT word FROM two)),
frequent AS (SELECT word FROM dict WHERE word IN (SELECT word FROM common)),"""
        + ranked("three", "left3", "frequent", 3, 3)
        + """,
staged AS (SELECT word, 1 AS stage, rank, candidate, distance FROM one UNION ALL SELECT word, 2, rank, candidate, distance FROM two UNION ALL SELECT word, 3, rank, candidate, distance FROM three)"""
    )


GEN1 = f"""
w AS (SELECT DISTINCT word FROM btok WHERE word NOT IN (SELECT word FROM dict)),
b AS MATERIALIZED (SELECT w.word, d.word AS candidate, {swaps('w.word', 'd.word')} AS low FROM w JOIN dict d ON abs(length(w.word) - length(d.word)) <= 2),
-- The three best score at most the third smallest low bound, or what that is by the full distance: one more covers it.
t AS MATERIALIZED (SELECT * FROM (SELECT *, nth_value(low, 3) OVER (PARTITION BY word ORDER BY low ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third FROM b) WHERE third IS NULL OR low <= third + 2),
k AS (SELECT word, candidate, {osa('word', 'candidate')} AS distance, ({sound('word')}) = ({sound('candidate')}) AS sounds_alike FROM t),
gen1 AS (SELECT word, rank, candidate, CAST(distance AS BIGINT) AS distance, sounds_alike FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance - CASE WHEN sounds_alike THEN 0.5 ELSE 0 END, candidate) AS rank FROM k) WHERE rank <= 3)"""
GRAPHS = "g AS (SELECT DISTINCT l_suppkey AS graph_id, CAST(least(l_partkey % 9, l_orderkey % 9) AS INTEGER) AS u, CAST(greatest(l_partkey % 9, l_orderkey % 9) AS INTEGER) AS v FROM lineitem WHERE l_partkey % 9 <> l_orderkey % 9)"
NETS = "n AS (SELECT l_suppkey AS graph_id, CAST(l_partkey % 9 AS INTEGER) AS u, CAST(l_orderkey % 9 AS INTEGER) AS v, count(*) AS cap FROM lineitem WHERE l_partkey % 9 <> l_orderkey % 9 GROUP BY ALL)"
#: The largest flow is the smallest cut: all sets with vertex 0 and without vertex 8.
CUTS = f"""WITH {NETS},
m AS (SELECT unnest(range(0, 128)) * 2 + 1 AS mask),
c AS (SELECT graph_id, mask, sum(CASE WHEN (mask >> u) & 1 = 1 AND (mask >> v) & 1 = 0 THEN cap ELSE 0 END) AS capacity FROM n, m GROUP BY ALL)"""
LINES = rf"""
all_lines AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\x0B\f\r]') AS l, text FROM documents),
cut AS (SELECT doc_id, l[1:greatest(coalesce(list_max(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN l[i] <> '' THEN i ELSE 0 END)), 0), CASE WHEN text = '' THEN 1 ELSE 0 END)] AS l FROM all_lines)"""
LINE_WORDS = rf"""{LINES},
lw AS (SELECT doc_id, line, CAST(len(regexp_extract_all(t, '\p{{L}}+')) AS BIGINT) AS n FROM (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS line FROM cut))"""
PRIME = "({n} >= 2 AND len(list_filter(range(2, CAST(floor(sqrt({n})) AS BIGINT) + 1), lambda d: {n} % d = 0)) = 0)"
CORRUPT = """CASE WHEN length(word) % 4 = 0 AND length(word) > 1 THEN substr(word, 1, a) || substr(word, a + 2)
  WHEN length(word) % 4 = 1 THEN substr(word, 1, a) || z || substr(word, a + 1)
  WHEN length(word) % 4 = 2 THEN substr(word, 1, a) || z || substr(word, a + 2)
  WHEN length(word) % 4 = 3 AND substr(word, a + 2, 1) <> '' THEN substr(word, 1, a) || substr(word, a + 2, 1) || substr(word, a + 1, 1) || substr(word, a + 3)
  ELSE word || z END"""
PAIRS = f"""
pairs AS (SELECT word AS correct, CASE WHEN rank % 10 = 0 THEN word ELSE {CORRUPT} END AS corrupted FROM (SELECT *, length(word) // 2 AS a, CASE WHEN substr(word, length(word) // 2 + 1, 1) = 'q' THEN 'z' ELSE 'q' END AS z FROM common))"""
CONFUSION = f"""WITH {TOK},{DICT},{COMMON},{PAIRS},
f AS (SELECT corrupted NOT IN (SELECT word FROM dict) AS flagged, correct <> corrupted AS is_error FROM pairs),
c AS (SELECT count(*) FILTER (flagged AND is_error) AS tp, count(*) FILTER (flagged AND NOT is_error) AS fp, count(*) FILTER (NOT flagged AND is_error) AS fn, count(*) FILTER (NOT flagged AND NOT is_error) AS tn FROM f)"""
CLEAN_PATTERNS = list(dict.fromkeys(p.strip() for p in PATTERNS.split(",") if p.strip()))
PATTERN_ROWS = "pat AS (SELECT unnest([" + ", ".join(f"'{p}'" for p in CLEAN_PATTERNS) + "]) AS pattern)"
MATCHES = f"""{PATTERN_ROWS},
hits AS (SELECT doc_id, pattern, unnest(list_filter(range(0, greatest(length(text) - length(pattern) + 1, 0)), lambda i: substr(text, i + 1, length(pattern)) = pattern)) AS start FROM documents, pat WHERE contains(text, pattern))"""
ACC = "CASE WHEN total_words = 0 THEN 0.0 ELSE floor((total_words - errors_found) / total_words * 1000 + 0.5) / 10.0 END"
DOC_ACC = f"""WITH {TOK},{DICT},
s AS (SELECT doc_id, count(*) AS total_words, count(*) FILTER (word NOT IN (SELECT word FROM dict)) AS errors_found FROM tok GROUP BY doc_id),
r AS (SELECT d.doc_id, coalesce(total_words, 0) AS total_words, coalesce(errors_found, 0) AS errors_found FROM documents d LEFT JOIN s USING (doc_id))"""

ORACLES: dict[str, str] = {
    "word_count_ws": f"SELECT doc_id, CAST(len(regexp_split_to_array({trimmed('text')}, '{WS}')) AS BIGINT) AS words FROM documents",
    "word_count_article": f"SELECT doc_id, CAST(CASE WHEN {trimmed('text')} = '' THEN 0 ELSE len(regexp_split_to_array({trimmed('text')}, '{WS}')) END AS BIGINT) AS words FROM documents",
    "word_count_letters": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\p{L}+')) AS BIGINT) AS words FROM documents",
    "sentence_count": f"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: {trimmed('x')} <> '')) AS BIGINT) AS sentences FROM documents",
    "uppercase_count": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\p{Lu}')) AS BIGINT) AS uppercase FROM documents",
    "vowel_count": "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[aeiou]')) AS BIGINT) AS vowels FROM documents",
    "palindrome": "SELECT doc_id, c = reverse(c) AS is_palindrome FROM (SELECT doc_id, lower(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS c FROM documents)",
    "palindrome_words": f"WITH {TOK} SELECT DISTINCT word FROM tok WHERE regexp_replace(word, '[^a-zA-Z]', '', 'g') = reverse(regexp_replace(word, '[^a-zA-Z]', '', 'g'))",
    "line_count": f"WITH {LINES} SELECT doc_id, CAST(len(l) AS BIGINT) AS lines FROM cut",
    "soundex_codes": f"WITH {TOK} SELECT word, {sound('word')} AS code FROM (SELECT DISTINCT word FROM tok)",
    "copied_case": rf"WITH {TOK} SELECT raw, CASE WHEN regexp_matches(raw, '^\p{{Lu}}') THEN replace(upper(lower(reverse(raw))[1]), 'ẞ', 'ß') || substr(lower(reverse(raw)), 2) ELSE lower(reverse(raw)) END AS cased FROM (SELECT DISTINCT raw FROM tok)",
    "lps_table": f"WITH {TOK},{COMMON} SELECT word, array_to_string(list_transform(range(1, length(word) + 1), lambda i: list_max(list_filter(range(0, i), lambda k: substr(word, 1, k) = substr(word, i - k + 1, k)))), ' ') AS prefix_table FROM common",
    "word_freq": f"WITH {RAW_WORDS} SELECT word, count(*) AS n FROM raw GROUP BY word",
    "most_frequent_word_per_doc": f"WITH {RAW_WORDS}, c AS (SELECT doc_id, word, count(*) AS n FROM raw GROUP BY ALL) SELECT doc_id, word, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS r FROM c) WHERE r = 1",
    "tokens_gen1": f"WITH {TOK} SELECT doc_id, line, word_number, raw, nfc_normalize(word) AS word FROM tok",
    "tokens_gen2": f"WITH {TOK} SELECT doc_id, line, word_number, word FROM tok",
    "dictionary_words": f"WITH {TOK},{DICT} SELECT word, CAST(length(word) AS BIGINT) AS len FROM dict",
    "common_words": f"WITH {TOK},{COMMON} SELECT word, rank FROM common",
    "dictionary_size": f"WITH {TOK},{DICT} SELECT count(*) AS words FROM dict",
    "known_tokens": f"WITH {TOK},{DICT} SELECT doc_id, count(*) AS known FROM tok WHERE word IN (SELECT word FROM dict) GROUP BY doc_id",
    "misspelled_tokens": f"WITH {TOK},{DICT} SELECT doc_id, line, word_number, word FROM tok WHERE word NOT IN (SELECT word FROM dict)",
    "linear_lookup": f"WITH {TOK},{DICT} SELECT word FROM dict",
    "prefix_lookup": f"WITH {TOK},{DICT}, p AS (SELECT unnest({PREFIXES!r}) AS prefix) SELECT prefix, prefix = '' OR EXISTS (SELECT 1 FROM dict WHERE starts_with(word, prefix)) AS found FROM p",
    "doc_accuracy": f"{DOC_ACC} SELECT *, {ACC} AS accuracy_percent FROM r",
    "overall_accuracy": f"{DOC_ACC} SELECT *, {ACC} AS accuracy_percent FROM (SELECT count(*) AS documents, CAST(sum(total_words) AS BIGINT) AS total_words, CAST(sum(errors_found) AS BIGINT) AS errors_found FROM r)",
    "strategy": r"SELECT doc_id, words, characters, CASE WHEN words <= 1 THEN 'Single Word' WHEN words <= 20 THEN 'Short Sentence' WHEN words <= 300 THEN 'Paragraph' ELSE 'Large Text' END AS input_type, words > 20 AS use_filtering FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '\p{L}+')) AS BIGINT) AS words, CAST(length(text) AS BIGINT) AS characters FROM documents)",
    "distinct_errors": f"WITH {TOK},{DICT} SELECT doc_id, word, line, word_number FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, word ORDER BY line, word_number) AS r FROM tok WHERE word NOT IN (SELECT word FROM dict)) WHERE r = 1",
    "short_uncommon_errors": f"WITH {TOK},{DICT},{COMMON}, w AS (SELECT DISTINCT word FROM tok),{SHORT.format(words='w')},{NEAR.format(source='rare')} SELECT word FROM near",
    "potential_error_counts": f"WITH {TOK},{DICT},{COMMON}, w AS (SELECT DISTINCT word FROM tok),{SHORT.format(words='w')},{NEAR.format(source='rare')} SELECT doc_id, count(*) AS errors FROM tok WHERE word NOT IN (SELECT word FROM dict) OR word IN (SELECT word FROM near) GROUP BY doc_id",
    "osa_pairs": f"WITH {TOK},{COMMON}, p AS MATERIALIZED (SELECT a.word, b.word AS candidate FROM common a JOIN common b ON a.word < b.word WHERE {swaps('a.word', 'b.word')} <= 2) SELECT * FROM (SELECT word, candidate, CAST({osa('word', 'candidate')} AS BIGINT) AS distance FROM p) WHERE distance <= 2",
    "suggest_gen1": f"WITH {TOK},{DICT},{ITEMS},{GEN1} SELECT word, rank, candidate, distance, sounds_alike FROM gen1",
    "suggest_gen2": f"{ERRORS},{ranked('two', 'err', 'dict', 2, 3)} SELECT word, rank, candidate, CAST(distance AS BIGINT) AS distance, sounds_alike FROM two",
    "comparison_count": f"WITH {TOK},{DICT}, w AS (SELECT DISTINCT word FROM tok WHERE word NOT IN (SELECT word FROM dict)), h AS (SELECT length(word) AS len, count(*) AS n FROM dict GROUP BY len) SELECT word, CAST(coalesce(sum(n), 0) AS BIGINT) AS comparisons, (SELECT count(*) FROM dict) AS unfiltered FROM w LEFT JOIN h ON h.len BETWEEN greatest(1, length(word) - 2) AND length(word) + 2 GROUP BY word",
    "keyword_occurrences": "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), 'the')) AS BIGINT) AS occurrences FROM documents",
    "pattern_positions": "SELECT page_id, unnest(list_filter(range(0, length(html)), lambda i: substr(html, i + 1, 4) = '</p>')) AS start FROM pages",
    "multi_pattern": f"WITH {MATCHES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start + length(pattern), length(pattern) DESC) AS ord, pattern, start, start + length(pattern) - 1 AS end_index FROM hits",
    "pattern_summary": f"WITH {MATCHES} SELECT d.doc_id, p.pattern, count(start) AS matches, coalesce(array_to_string(list(start ORDER BY start) FILTER (start IS NOT NULL)[1:10], ' '), '') AS first_positions FROM documents d CROSS JOIN pat p LEFT JOIN hits h ON h.doc_id = d.doc_id AND h.pattern = p.pattern GROUP BY d.doc_id, p.pattern",
    "trie_nodes": f"WITH {TOK},{DICT} SELECT count(DISTINCT prefix) + 1 AS nodes FROM (SELECT unnest(list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i))) AS prefix FROM dict)",
    "corrupted_words": f"WITH {TOK},{COMMON},{PAIRS} SELECT correct, corrupted FROM pairs",
    "confusion": f"{CONFUSION} SELECT tp, fp, fn, tn FROM c",
    "prf": f"{CONFUSION} SELECT tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) AS f1 FROM c",
    "reservoir_size": f"WITH {TOK},{COMMON} SELECT least(100, count(*)) AS n, least(100, count(*)) AS different, least(100, count(*)) AS of_the_pool FROM common",
    "prefix_scan": f"WITH {LINE_WORDS} SELECT doc_id, line, n, CAST(coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scan FROM lw",
    "turn_scan": f"WITH t AS (SELECT conv_id, turn, CAST(len(regexp_split_to_array({trimmed('text')}, '{WS}')) AS BIGINT) AS n FROM conversations) SELECT conv_id, turn, n, CAST(coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scan FROM t",
    "work_span": f"WITH {LINE_WORDS}, s AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS work, max(n) + CAST(ceil(log2(greatest(2, count(*)))) AS BIGINT) AS span FROM lw GROUP BY doc_id) SELECT doc_id, work, span, work / greatest(1, span) AS speed_up, work // {CORES} + span AS bound FROM s",
    "error_reduce": f"WITH {TOK},{DICT} SELECT count(*) AS errors FROM tok WHERE word NOT IN (SELECT word FROM dict)",
    "prime_trial": f"SELECT p_partkey, {PRIME.format(n='p_partkey')} AS is_prime FROM part",
    "prime_mr": f"SELECT o_orderkey, {PRIME.format(n='o_orderkey')} AS is_prime FROM orders",
    "prime_report": f"SELECT count(*) AS numbers, count(*) FILTER ({PRIME.format(n='o_orderkey')}) AS primes, CAST(0 AS BIGINT) AS different FROM orders",
    "exact_cover": f"""WITH {GRAPHS}, m AS (SELECT unnest(range(0, 512)) AS mask), n AS (SELECT graph_id, max(v) + 1 AS vertices FROM g GROUP BY graph_id),
c AS (SELECT graph_id, mask FROM g, m GROUP BY ALL HAVING bool_and((mask >> u) & 1 = 1 OR (mask >> v) & 1 = 1))
SELECT graph_id, CAST(any_value(vertices) AS BIGINT) AS vertices, CAST(min(bit_count(mask)) AS BIGINT) AS minimum FROM c JOIN n USING (graph_id) GROUP BY graph_id""",
    "max_flow": f"{CUTS} SELECT graph_id, CAST(min(capacity) AS BIGINT) AS flow, CAST(min(capacity) AS BIGINT) AS cut_capacity FROM c GROUP BY graph_id",
    "min_cut": f"{CUTS} SELECT graph_id, CAST(min(capacity) AS BIGINT) AS capacity FROM c GROUP BY graph_id HAVING min(capacity) > 0",
}
STAGED = "SELECT word, CAST(stage AS BIGINT) AS stage, rank, candidate, CAST(distance AS BIGINT) AS distance FROM staged"
ALL_ERRORS = (
    "WITH " + ", ".join([TOK, DICT, COMMON, "\nbw AS (SELECT DISTINCT word FROM tok)", SHORT.format(words="bw"), NEAR.format(source="rare")])
    + ",\nerr AS MATERIALIZED (SELECT word FROM bw WHERE word NOT IN (SELECT word FROM dict) UNION SELECT word FROM near)"
)
ORACLES["near_common_words"] = f"WITH {TOK},{COMMON}, s AS (SELECT DISTINCT word FROM tok),{NEAR.format(source='s')} SELECT word FROM near"
ORACLES["suggest_gen2_documents"] = f"{ALL_ERRORS},{ranked_by_rest('two', 'err', 'dict', 3)} SELECT word, rank, candidate, CAST(distance AS BIGINT) AS distance, sounds_alike FROM two"
ORACLES["suggest_staged"] = f"{ERRORS},{staged('err')} {STAGED}"
ORACLES["suggest_stretched"] = f"WITH {TOK},{DICT},{COMMON}, drawn AS (SELECT DISTINCT word || repeat(word[-1], 3) AS word FROM common),{staged('drawn')} {STAGED}"
ORACLES["long_run_words"] = f"WITH {TOK} SELECT word, {squeezed(2)} AS squeezed_2, {squeezed(1)} AS squeezed_1 FROM (SELECT DISTINCT word FROM tok) WHERE {LONG}"
FLAGS = f"""WITH {TOK},{DICT},{COMMON},{PAIRS},
e AS (SELECT DISTINCT corrupted AS word FROM pairs WHERE correct <> corrupted),{staged('e')},
f AS (SELECT correct, corrupted, corrupted NOT IN (SELECT word FROM dict) AS flagged, candidate AS top1, (corrupted, correct) IN (SELECT (word, candidate) FROM staged) AS in_top3
  FROM pairs LEFT JOIN (SELECT word, candidate FROM staged WHERE rank = 1) b ON b.word = corrupted WHERE correct <> corrupted)"""
ORACLES["topk_accuracy"] = f"{FLAGS} SELECT count(*) FILTER (flagged AND top1 = correct) / count(*) AS top1_accuracy, count(*) FILTER (flagged AND in_top3) / count(*) AS top3_recall FROM f"
ORACLES["failure_list"] = f"{FLAGS} SELECT correct, corrupted, coalesce(top1, '(none)') AS suggested, NOT flagged AS not_detected FROM f WHERE NOT flagged OR coalesce(top1, '') <> correct"
CHECKED = f"{ERRORS},{staged('err')}"
ORACLES["check_summary"] = rf"""{CHECKED},
c AS (SELECT doc_id, count(*) AS errors, CAST(sum(coalesce(k, 0)) AS BIGINT) AS made FROM btok JOIN err USING (word) LEFT JOIN (SELECT word, count(*) AS k FROM staged GROUP BY word) USING (word) GROUP BY doc_id),
r AS (SELECT item_id AS doc_id, CAST(len(regexp_extract_all(text, '\p{{L}}+')) AS BIGINT) AS total_tokens, CAST(length(text) AS BIGINT) AS characters, coalesce(errors, 0) AS errors_found, coalesce(made, 0) AS suggestions_generated FROM benchmark LEFT JOIN c ON c.doc_id = item_id)
SELECT *, CASE WHEN total_tokens = 0 THEN 0.0 ELSE (total_tokens - errors_found) * 100.0 / total_tokens END::DOUBLE AS accuracy,
  CASE WHEN total_tokens <= 1 THEN 'Single Word' WHEN total_tokens <= 20 THEN 'Short Sentence' WHEN total_tokens <= 300 THEN 'Paragraph' ELSE 'Large Text' END AS input_type, total_tokens > 20 AS use_filtering FROM r"""
ORACLES["corrected_text"] = rf"""{CHECKED},
p AS (SELECT doc_id, line, unnest(w) AS piece, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, line, CASE WHEN t = '' THEN [''] ELSE regexp_extract_all(t, '\p{{L}}+|\P{{L}}+') END AS w FROM btok_l)),
x AS (SELECT doc_id, line, pos, CASE WHEN candidate IS NULL THEN piece WHEN regexp_matches(piece, '^\p{{Lu}}') THEN replace(upper(candidate[1]), 'ẞ', 'ß') || substr(candidate, 2) ELSE candidate END AS piece
  FROM p LEFT JOIN (SELECT word, candidate FROM staged WHERE rank = 1) b ON b.word = lower(piece)),
l AS (SELECT doc_id, line, string_agg(piece, '' ORDER BY pos) AS t FROM x GROUP BY ALL)
SELECT doc_id, string_agg(t, chr(10) ORDER BY line) AS corrected FROM l GROUP BY doc_id"""


# Random errors and samples, drawn by hashes

DRAW = "CAST(('0x' || substr(md5('{seed}:{what}:' || {key}), 1, 8))::BIGINT % ({n}) AS INTEGER)"


def corrupted(word: str, seed: int) -> str:
    """The first of the attempts that changes the word."""
    tried = []
    for k in range(ATTEMPTS):
        own = lambda what, n: DRAW.format(seed=seed, what=f"{k}{what}", key=word, n=n)  # noqa: B023, E731
        kind, letter = own("kind", 4), f"substr('{LETTERS}', {own('letter', 26)} + 1, 1)"
        at = own("at", f"greatest(1, CASE {kind} WHEN 1 THEN length({word}) + 1 WHEN 3 THEN length({word}) - 1 ELSE length({word}) END)")
        begin = f"substr({word}, 1, {at})"
        made = f"""CASE WHEN length({word}) < 2 AND {kind} IN (0, 3) THEN NULL WHEN {kind} = 0 THEN {begin} || substr({word}, {at} + 2)
  WHEN {kind} = 1 THEN {begin} || {letter} || substr({word}, {at} + 1) WHEN {kind} = 2 THEN {begin} || {letter} || substr({word}, {at} + 2)
  ELSE {begin} || substr({word}, {at} + 2, 1) || substr({word}, {at} + 1, 1) || substr({word}, {at} + 3) END"""
        tried.append(f"nullif({made}, {word})")
    return f"coalesce({', '.join(tried)}, {word} || 'x')"


ORACLES["random_errors"] = f"WITH {TOK},{DICT} SELECT word, {corrupted('word', 11)} AS corrupted FROM dict"
ORACLES["reservoir_words"] = f"WITH {TOK},{COMMON} SELECT word FROM common ORDER BY md5('7:' || word) LIMIT 100"
SHARE = "count(*) FILTER ({}) / count(*)"
ORACLES["monte_carlo"] = f"""WITH {TOK},{DICT},{COMMON},
drawn AS (SELECT word, {corrupted('word', 8)} AS corrupted FROM (SELECT word FROM common WHERE length(word) >= 5 ORDER BY md5('7:' || word) LIMIT 40)),
cw AS (SELECT DISTINCT corrupted AS word FROM drawn),{SHORT.format(words='cw')},{NEAR.format(source='rare')},
err AS (SELECT word FROM cw WHERE word NOT IN (SELECT word FROM dict) UNION SELECT word FROM near),{staged('err')},
f AS (SELECT d.corrupted IN (SELECT word FROM err) AS found, (d.corrupted, d.word) IN (SELECT (word, candidate) FROM staged WHERE rank = 1) AS first, (d.corrupted, d.word) IN (SELECT (word, candidate) FROM staged) AS among FROM drawn d),
s AS (SELECT count(*) AS trials, {SHARE.format('found')} AS detection, {SHARE.format('first')} AS top1, {SHARE.format('among')} AS top3 FROM f)
SELECT trials, detection, top1, top3, """ + ", ".join(f"{c} {sign} 1.96 * sqrt({c} * (1 - {c}) / trials) AS {c}_{side}" for c in ("detection", "top1", "top3") for sign, side in (("-", "low"), ("+", "high"))) + " FROM s"

# Word lists, pairs, edges, articles

FILE_LINES = r"""
fl AS (SELECT doc_id, unnest(l) AS value, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS l FROM documents))"""
ORACLES["word_list_lines"] = f"WITH {FILE_LINES}, w AS (SELECT nfc_normalize(lower({trimmed('value')})) AS word FROM fl) SELECT word, CAST(length(word) AS BIGINT) AS len, count(*) AS n FROM w WHERE word <> '' GROUP BY word"
ORACLES["word_list_distinct"] = f"WITH {FILE_LINES}, w AS (SELECT lower({trimmed('value')}) AS word, doc_id * 10000000 + pos AS pos FROM fl) SELECT min(pos) AS pos, word, CAST(length(word) AS BIGINT) AS len FROM w WHERE word <> '' GROUP BY word"
ORACLES["labelled_pairs"] = f"""WITH {TOK},{COMMON},{PAIRS},{FILE_LINES},
v AS (SELECT {trimmed('value')} AS line FROM fl UNION ALL SELECT {trimmed("(' ' || correct || ' , ' || corrupted)")} FROM pairs),
p AS (SELECT string_split(regexp_replace(line, ',+$', ''), ',') AS p FROM v WHERE line <> '' AND NOT starts_with(line, '#') AND NOT starts_with(line, 'correct,'))
SELECT lower({trimmed('p[1]')}) AS correct, lower({trimmed('p[2]')}) AS corrupted, count(*) AS n FROM p WHERE len(p) = 2 GROUP BY ALL"""
ORACLES["parsed_edges"] = "SELECT DISTINCT l_suppkey AS graph_id, l_partkey AS u, l_orderkey AS v FROM lineitem"
CONTENT = "array_to_string(list_transform(l[4:], lambda x: x || ' '), '')"
ORACLES["article_listing"] = rf"""WITH a AS (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE regexp_split_to_array(regexp_replace(text, '(\r\n|\n|\r)\z', ''), '\r\n|\n|\r') END AS l FROM documents)
SELECT doc_id AS article_no, coalesce(l[1], 'Untitled') AS title, coalesce(l[2], 'Unknown Author') AS author, coalesce(l[3], 'Unknown Date') AS date,
  CAST(CASE WHEN {trimmed(CONTENT)} = '' THEN 0 ELSE len(regexp_split_to_array({trimmed(CONTENT)}, '{WS}')) END AS BIGINT) AS words FROM a"""
#: Covers by folding over the edges of a small graph.
FOLDED_COVER = f"""WITH {GRAPHS}, e AS (SELECT graph_id, list([u, v] ORDER BY u * 9 + v) AS edges FROM g GROUP BY graph_id),
a AS (SELECT graph_id, edges, list_reduce(list_prepend(CAST([] AS INTEGER[]), edges), lambda acc, x: CASE WHEN NOT list_contains(acc, x[1]) AND NOT list_contains(acc, x[2]) THEN list_concat(acc, x) ELSE acc END) AS cover FROM e)
SELECT graph_id, CAST(len(cover) AS BIGINT) AS size, CAST(len(cover) // 2 AS BIGINT) AS matched, len(list_filter(edges, lambda x: NOT list_contains(cover, x[1]) AND NOT list_contains(cover, x[2]))) = 0 AS covers FROM a"""
ORACLES["cover_report"] = f"""WITH a AS ({FOLDED_COVER}), x AS ({ORACLES['exact_cover']})
SELECT graph_id, vertices, size AS approximate, matched, minimum, covers, size / minimum AS ratio, size <= 2 * minimum AS within_twice FROM a JOIN x USING (graph_id)"""

# Lookups, scans, comparisons

ORACLES["lookup_benchmark"] = f"WITH {TOK},{DICT}, c AS (SELECT count(*) AS tokens, count(*) FILTER (word IN (SELECT word FROM dict)) AS known FROM tok) SELECT tokens, known, known AS known_linear, true AS agree FROM c"
ORACLES["scan_check"] = f"WITH {LINES} SELECT doc_id, true AS agrees FROM cut WHERE len(l) > 0"
ORACLES["demo_scan"] = f"""WITH {TOK},{COMMON},
parts AS (SELECT doc_id, word, unnest(p) AS part, generate_subscripts(p, 1) AS i, len(p) AS k FROM (SELECT doc_id, word, string_split(lower(text), word) AS p FROM documents, common WHERE rank < 20)),
ends AS (SELECT doc_id, word, i, k, CAST(sum(length(part)) OVER (PARTITION BY doc_id, word ORDER BY i) AS BIGINT) + (i - 1) * length(word) AS start FROM parts),
apart AS (SELECT doc_id, word, start FROM ends WHERE i < k),
-- What overlaps an occurrence begins where the word's end is its beginning.
shifts AS (SELECT word, s FROM (SELECT word, unnest(range(1, length(word))) AS s FROM common WHERE rank < 20) WHERE word[s + 1:] = word[1:length(word) - s]),
every AS (SELECT * FROM apart UNION SELECT a.doc_id, a.word, a.start + s FROM apart a JOIN shifts USING (word) JOIN documents d ON d.doc_id = a.doc_id WHERE substr(lower(d.text), a.start + s + 1, length(a.word)) = a.word)
SELECT doc_id, word AS pattern, start, start + length(word) - 1 AS end_index FROM every"""
ORACLES["staged_comparisons"] = f"""{CHECKED},
h AS (SELECT length(word) AS len, count(*) AS n FROM dict GROUP BY len),
g AS (SELECT e.word, min(stage) AS stage FROM err e LEFT JOIN staged s ON s.word = e.word GROUP BY e.word),
passes AS (SELECT word, length(form) AS n, 2 AS most FROM stretched UNION ALL SELECT word, length(word), 2 FROM g WHERE coalesce(stage, 4) > 1 UNION ALL SELECT word, length(word), 3 FROM g WHERE coalesce(stage, 4) > 2)
SELECT word, CAST(coalesce(sum(h.n), 0) AS BIGINT) AS comparisons FROM passes p LEFT JOIN h ON h.len BETWEEN greatest(1, p.n - most) AND p.n + most GROUP BY word"""

# Reports


def percent(x: str) -> str:
    return f"coalesce(printf('%.1f%%', floor(({x}) * 1000 + 0.5) / 10.0), 'N/A (division by zero)')"


KNOWN_SHARE = "(CASE WHEN total_words = 0 THEN NULL ELSE (total_words - errors_found) / total_words END)"
ORACLES["accuracy_estimates"] = f"""{DOC_ACC}, e AS (SELECT *, {KNOWN_SHARE} AS p FROM r)
SELECT doc_id, {percent('p')} || ' (' || (total_words - errors_found) || '/' || total_words || '), 95 % interval +-' || {percent('1.96 * sqrt(p * (1 - p) / total_words)')} AS estimate FROM e"""
ITEM_TOTALS = f"""
bs AS (SELECT doc_id, count(*) AS total_words, count(*) FILTER (word NOT IN (SELECT word FROM dict)) AS errors_found FROM btok GROUP BY doc_id),
br AS (SELECT item_id AS doc_id, coalesce(total_words, 0) AS total_words, coalesce(errors_found, 0) AS errors_found FROM benchmark LEFT JOIN bs ON bs.doc_id = item_id),
bt AS (SELECT *, {ACC} AS accuracy_percent FROM br),
be AS (SELECT * FROM btok WHERE word NOT IN (SELECT word FROM dict))"""
BATCH = f"WITH {TOK},{DICT},{ITEMS},{GEN1},{ITEM_TOTALS}"
ORACLES["json_batch_report"] = f"""{BATCH},
s AS (SELECT word, list(candidate ORDER BY rank) AS found FROM gen1 GROUP BY word),
e AS (SELECT doc_id, list({{'line': line, 'word_number': word_number, 'word': raw, 'suggestions': coalesce(found, [])}} ORDER BY line, word_number) AS errors FROM be LEFT JOIN s USING (word) GROUP BY doc_id)
SELECT CAST(doc_id AS VARCHAR) AS source, CAST(to_json({{'source': CAST(doc_id AS VARCHAR), 'total_words': total_words, 'errors_found': errors_found, 'accuracy_percent': CAST(accuracy_percent AS DOUBLE), 'errors': coalesce(errors, [])}}) AS VARCHAR) AS report FROM bt LEFT JOIN e USING (doc_id)"""
ORACLES["json_text_report"] = f"""{BATCH},
s AS (SELECT word, list({{'word': candidate, 'edit_distance': distance, 'phonetic_match': sounds_alike}} ORDER BY rank) AS found FROM gen1 GROUP BY word),
e AS (SELECT doc_id, list({{'word': word, 'suggestions': coalesce(found, [])}} ORDER BY line, word_number) AS errors FROM be LEFT JOIN s USING (word) GROUP BY doc_id)
SELECT doc_id, CAST(to_json({{'doc_id': doc_id, 'total_words_scanned': total_words, 'errors_found': errors_found, 'accuracy_percent': CAST(accuracy_percent AS DOUBLE), 'dictionary_size': (SELECT count(*) FROM dict), 'errors': coalesce(errors, [])}}) AS VARCHAR) AS report FROM bt LEFT JOIN e USING (doc_id)"""
ORACLES["printed_report"] = f"""{BATCH},
s AS (SELECT word, string_agg(candidate, ', ' ORDER BY rank) AS found FROM gen1 GROUP BY word),
e AS (SELECT doc_id, string_agg('Line ' || line || ', Word ' || word_number || ': "' || raw || '"' || chr(10) || '   Suggestions: ' || coalesce(found, '(none found)'), chr(10) ORDER BY line, word_number) AS errors FROM be LEFT JOIN s USING (word) GROUP BY doc_id)
SELECT doc_id, 'Total words: ' || total_words || '   Correct: ' || (total_words - errors_found) || '   Errors: ' || errors_found || '   Accuracy: ' || CAST(accuracy_percent AS DOUBLE) || '%' || chr(10) || coalesce(errors, 'No spelling errors found.') AS report FROM bt LEFT JOIN e USING (doc_id)"""
ORACLES["printed_summary"] = f"""WITH o AS ({ORACLES['overall_accuracy']})
SELECT 'Documents processed: ' || documents || chr(10) || 'Total words scanned: ' || total_words || chr(10) || 'Total errors found: ' || errors_found || chr(10) || 'Overall accuracy: ' || CAST(accuracy_percent AS DOUBLE) || '%' AS report FROM o"""


def preview(c: str) -> str:
    own = trimmed(c)
    return f"CASE WHEN length({own}) > 300 THEN substr({own}, 1, 300) || ' [' || (length({own}) - 300) || ' more characters]' ELSE {own} END"


def report(start: str, summary: str, corrected_sql: str, texts: str) -> str:
    """The composed report after common table expressions with ``btok``, ``err`` and ``staged``."""
    return f"""{start},
sm AS ({summary}), ct AS ({corrected_sql}),
er AS (SELECT doc_id, line, word_number, raw, row_number() OVER (PARTITION BY doc_id ORDER BY line, word_number) AS n FROM btok WHERE word IN (SELECT word FROM err)),
fe AS (SELECT doc_id, string_agg('Line ' || line || ', Word ' || word_number || ': ' || raw, chr(10) ORDER BY n) FILTER (n <= 20) AS t, count(*) AS c FROM er GROUP BY doc_id),
sg AS (SELECT word, string_agg(candidate || ' (' || distance || ')', ', ' ORDER BY rank) AS t FROM staged GROUP BY word),
oe AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, word_number) AS n FROM (SELECT doc_id, word, line, word_number FROM btok WHERE word IN (SELECT word FROM err) QUALIFY row_number() OVER (PARTITION BY doc_id, word ORDER BY line, word_number) = 1)),
fs AS (SELECT doc_id, string_agg(oe.word || ' -> ' || coalesce(sg.t, 'none within 3 edits'), chr(10) ORDER BY n) FILTER (n <= 20) AS t, count(*) AS c FROM oe LEFT JOIN sg USING (word) GROUP BY doc_id)
SELECT sm.doc_id, input_type, use_filtering, total_tokens, characters, errors_found, suggestions_generated, {preview('text')} AS input, {preview("coalesce(corrected, '')")} AS output,
  coalesce(fe.t, '') AS first_errors, greatest(0, coalesce(fe.c, 0) - 20) AS more_errors, coalesce(fs.t, '') AS first_suggestions, greatest(0, coalesce(fs.c, 0) - 20) AS more_suggestions,
  {percent('CASE WHEN total_tokens = 0 THEN 0.0 ELSE (total_tokens - errors_found) / total_tokens END')} AS text_accuracy
FROM sm JOIN {texts} x ON x.item_id = sm.doc_id LEFT JOIN ct USING (doc_id) LEFT JOIN fe USING (doc_id) LEFT JOIN fs USING (doc_id)"""


SUMMARY, CORRECTED = (ORACLES[k].removeprefix(CHECKED).lstrip(",") for k in ("check_summary", "corrected_text"))
ORACLES["spell_report"] = report(CHECKED, "WITH " + SUMMARY.lstrip(), "WITH " + CORRECTED.lstrip(), "benchmark")
GIVEN_TEXT = f"given AS (SELECT 'given' AS item_id, '{' '.join(GIVEN)}' AS text)"
_one = lambda sql: sql.replace("FROM benchmark", "FROM given")
ORACLES["quick_check"] = report(_one(CHECKED).replace("WITH ", f"WITH {GIVEN_TEXT}, ", 1), _one("WITH " + SUMMARY.lstrip()), "WITH " + CORRECTED.lstrip(), "given")


def matched(by: str) -> str:
    """Common table expressions up to ``m``: rounds that take the edges which come first at both ends."""
    side = lambda what, end: f"{what} OVER (PARTITION BY graph_id, {end})"
    return f"""RECURSIVE e AS (SELECT DISTINCT CAST({by} AS BIGINT) AS graph_id, l_orderkey * 8 + l_linenumber AS ord, l_partkey * 2 AS u, l_orderkey * 2 + 1 AS v FROM lineitem),
r AS (
  SELECT graph_id, ord, u, v, false AS taken FROM e
  UNION ALL
  SELECT graph_id, ord, u, v, first FROM (
    SELECT *, {side('bool_or(first)', 'u')} OR {side('bool_or(first)', 'v')} AS touched FROM (
      SELECT graph_id, ord, u, v, (ord, u, v) = {side('min((ord, u, v))', 'u')} AND (ord, u, v) = {side('min((ord, u, v))', 'v')} AS first FROM r WHERE NOT taken))
  WHERE first OR NOT touched
),
m AS (SELECT graph_id, ord, u, v FROM r WHERE taken)"""


COVERED = """
c AS (SELECT graph_id, u AS x FROM m UNION SELECT graph_id, v FROM m),
o AS (SELECT graph_id, bool_and(EXISTS (SELECT 1 FROM c WHERE c.graph_id = e.graph_id AND c.x IN (e.u, e.v))) AS covers FROM e GROUP BY graph_id)
SELECT {key}(SELECT count(*) FROM c WHERE c.graph_id = o.graph_id) AS size, (SELECT count(*) FROM m WHERE m.graph_id = o.graph_id) AS matched, covers FROM o"""
ORACLES["approx_cover"] = f"WITH {matched('l_suppkey')},{COVERED.format(key='graph_id, ')}"
ORACLES["one_graph_cover"] = f"WITH {matched('0')},{COVERED.format(key='')}"
ORACLES["ordered_matching"] = f"WITH {matched('0')} SELECT ord, u, v FROM m"
BEFORE = "CAST(coalesce(sum(n) OVER (ORDER BY doc_id, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)"
ORACLES["corpus_scan"] = f"WITH {LINE_WORDS} SELECT doc_id, line, n, {BEFORE} AS scan FROM lw"
ORACLES["corpus_scan_check"] = f"WITH {LINE_WORDS} SELECT count(*) AS rows, CAST(sum(n) AS BIGINT) AS total, true AS agrees FROM lw"
ORACLES["stratified_sample"] = "SELECT * FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('7:' || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 20"
ORACLES["pattern_positions_utf16"] = r"""WITH p AS (SELECT doc_id, text, unnest(list_filter(range(0, length(text)), lambda i: substr(text, i + 1, 2) = '. ')) AS start FROM documents)
SELECT doc_id, start, start + length(regexp_replace(substr(text, 1, start), '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS start_utf16 FROM p"""
ORACLES["monte_carlo_failures"] = ORACLES["monte_carlo"].split("\nf AS (")[0].rstrip(",") + """
SELECT d.word, d.corrupted, coalesce(t.candidate, '(none)') AS suggested, e.word IS NULL AS not_detected
FROM drawn d LEFT JOIN (SELECT word, candidate FROM staged WHERE rank = 1) t ON t.word = d.corrupted LEFT JOIN err e ON e.word = d.corrupted
WHERE e.word IS NULL OR coalesce(t.candidate, '') <> d.word ORDER BY d.word, d.corrupted LIMIT 8"""
ORACLES["folder_accuracy"] = f"SELECT doc_id || '.txt' AS doc_id, * EXCLUDE (doc_id) FROM ({ORACLES['doc_accuracy']})"
ORACLES["folder_json_report"] = ORACLES["json_batch_report"].replace("CAST(doc_id AS VARCHAR)", "(doc_id || '.txt')")
