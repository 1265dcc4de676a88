"""Queries over the driver's tables, each with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex import schema
from strandex.functions import scalars, udfs
from strandex.operators import codec, cover, lookup, matching, mining, selection
from strandex.plans import commands
from strandex.plans import dictionary as plans
from strandex.sources import lines as sources
from strandex.sources import store

Query = Callable[[SparkSession, str], DataFrame]

#: Patterns of the queries with a given dictionary: (symbol, string, cost in bits).
PATTERNS = [
    (128, "http", 4), (129, "https://", 3), (130, "http://", 3), (131, "www.", 5), (132, ".example.", 4), (133, ".example.com/", 3), (134, ".net/", 5),
    (135, ".org/", 5), (136, "/en/", 5), (137, "th", 6), (138, "the", 6), (139, "er", 7), (140, "html", 5), (141, "example", 5),
]
LITERAL_COST = 9
ENTRIES = [(s, chr(s), LITERAL_COST) for s in range(1, schema.LITERALS + 1)] + PATTERNS
CODES = selection.huffman({s: 1 for s in range(1, schema.LITERALS + 1)} | {s: 4 * (12 - c) for s, _, c in PATTERNS})
CODED = [(s, t, CODES[s]) for s, t, _ in ENTRIES]
K, RATIO = 3, 0.5
WHITE_LIST = ["https://www.", ".example.com/en/", "example.net"]
MINED = plans.Params(n1=2000, n2=100, r=0.5, k=3)

VALID = "regexp_full_match({c}, '[ -~]+') AND trim({c}) <> ''"


# Corpora


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.valid_lines(sources.from_table(_table(spark, sf_dir, "pages"), "page_id", "url"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.valid_lines(sources.from_table(_table(spark, sf_dir, "part"), "p_partkey", "p_name"))


def _patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, t) for s, t, _ in PATTERNS], "symbol int, str string")


PAGES_SQL = f"u AS (SELECT page_id AS line_no, url AS line FROM pages WHERE {VALID.format(c='url')})"
PARTS_SQL = f"u AS (SELECT p_partkey::BIGINT AS line_no, p_name AS line FROM part WHERE {VALID.format(c='p_name')})"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'" if text.isprintable() else f"chr({ord(text)})"


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(_quote(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + ")"


# Mining in SQL, step upon step


def _mining_sql(corpus: str, k: int, ratio: float) -> str:
    return f"""{corpus},
g AS (SELECT line_no, i AS pos, substr(line, (i + 1)::BIGINT, {k}) AS kgram, (length(line) - {k} + 1)::BIGINT AS n_pos FROM (SELECT line_no, line, unnest(range(0, length(line) - {k} + 1)) AS i FROM u WHERE length(line) >= {k})),
c AS (SELECT *, CASE WHEN rn > 1 THEN rn ELSE 0 END AS hh FROM (SELECT *, row_number() OVER (PARTITION BY kgram ORDER BY line_no, pos) AS rn FROM g)),
p AS (SELECT *, coalesce(lag(hh) OVER (PARTITION BY line_no ORDER BY pos), 0) AS prev FROM c),
b AS (SELECT *, hh > 0 AND prev > 0 AND NOT (hh * {ratio}::DOUBLE < prev AND hh > prev * {ratio}::DOUBLE) AS broken FROM p),
n AS (SELECT *, sum(CASE WHEN hh > 0 AND (prev = 0 OR broken) THEN 1 ELSE 0 END) OVER (PARTITION BY line_no ORDER BY pos ROWS UNBOUNDED PRECEDING) AS sid FROM b),
r AS (SELECT line_no, sid, min(pos) AS s, max(pos) AS e, max(n_pos - 1) AS last, arg_min(broken, pos) AS broken FROM n WHERE hh > 0 GROUP BY line_no, sid),
series AS (SELECT line_no, s, e, substr(line, (s + 1)::BIGINT, (e - s + {k} - CASE WHEN e = last AND e > s THEN 1 ELSE 0 END)::BIGINT) AS text FROM r JOIN u USING (line_no) WHERE NOT (s = e AND e = last AND broken)),
counts AS (SELECT text AS pat, count(*)::BIGINT AS real_count FROM (SELECT DISTINCT line_no, text FROM series) GROUP BY text)"""


def _scores_sql(corpus: str, k: int, ratio: float, n: int) -> str:
    pool = mining.pool_size(n)
    return f"""{_mining_sql(corpus, k, ratio)},
heavy AS (SELECT * FROM counts ORDER BY real_count DESC, pat LIMIT {pool}),
scores AS (SELECT a.pat, a.real_count, (1 + sum(b.real_count))::BIGINT AS score FROM heavy a JOIN heavy b ON contains(b.pat, a.pat) GROUP BY a.pat, a.real_count)"""


def _counted(lines: DataFrame, k: int = K, run: int = 64) -> DataFrame:
    return mining.running_counts(mining.kgrams(lines, k), run)


def _series(lines: DataFrame, k: int = K, ratio: float = RATIO, run: int = 64) -> DataFrame:
    return mining.series(_counted(lines, k, run), lines, k, ratio)


def _scores(lines: DataFrame, n: int) -> DataFrame:
    return mining.containment_scores(mining.heavy(mining.series_counts(_series(lines)), mining.pool_size(n)), K)


# Covers in SQL: the best state for each end position, of cost, rank (literals first, then the longer), path, bits

_RANK = "CASE WHEN length(str) = 1 THEN 0 ELSE 1000 - length(str) END"


def _cover_sql(corpus: str, rows: list[tuple]) -> str:
    """rows: (symbol, string, cost, code)."""
    return f"WITH RECURSIVE {corpus},\n{_values('dict', 'symbol, str, cost, code', rows)},\n{_cover_steps('dict')}"


def _cover_steps(entries: str, no: str = "") -> str:
    """edges, dp and best, each with `no` in its name, over a table of entries (symbol, str, cost, code)."""
    return f"""edges{no} AS (SELECT line_no, i + length(str) - 1 AS e, length(str) AS len, symbol, cost, code, {_RANK} AS rank FROM (SELECT line_no, line, unnest(range(1, length(line) + 1)) AS i FROM u) JOIN {entries} ON substr(line, i::BIGINT, length(str)) = str),
dp{no} AS (SELECT line_no, 0::BIGINT AS n, [{{'c': 0::BIGINT, 'r': 0::BIGINT, 'p': '', 'b': ''}}] AS d FROM u
UNION ALL
SELECT dp.line_no, dp.n + 1, list_append(dp.d, m.v) FROM dp{no} dp JOIN u USING (line_no) JOIN LATERAL (SELECT min({{'c': (dp.d[e.e - e.len + 1].c + e.cost)::BIGINT, 'r': e.rank::BIGINT, 'p': dp.d[e.e - e.len + 1].p || ' ' || e.symbol, 'b': dp.d[e.e - e.len + 1].b || e.code}}) AS v FROM edges{no} e WHERE e.line_no = dp.line_no AND e.e = dp.n + 1) m ON true WHERE dp.n < length(u.line)),
best{no} AS (SELECT dp.line_no, u.line, dp.d[dp.n + 1] AS v FROM dp{no} dp JOIN u USING (line_no) WHERE dp.n = length(u.line)),
used{no} AS (SELECT x::INTEGER AS symbol, count(*)::BIGINT AS uses FROM (SELECT unnest(string_split(ltrim(v.p), ' ')) AS x FROM best{no}) GROUP BY x)"""


# The walk over ranked patterns f (str, freq, h, gain, i), whose accepted rows are the choice

_STATES = "(length(f.str) - coalesce(list_max(list_transform(w.taken, lambda t: list_max(list_transform(range(0, length(f.str) + 1), lambda k: CASE WHEN k <= length(t) AND left(t, k) = left(f.str, k) THEN k ELSE 0 END)))), 0))"


def _walk_sql(most: int) -> str:
    return f"""walk AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS taken, 0 AS n, NULL::VARCHAR AS str, NULL::BIGINT AS freq, NULL::DOUBLE AS h, false AS ok
UNION ALL
SELECT i, CASE WHEN ok THEN list_append(taken, str) ELSE taken END, n + ok::INT, str, freq, h, ok FROM (
SELECT f.i, w.taken, w.n, f.str, f.freq, f.h, w.n < {most} AND f.gain >= {_STATES} * 32 + f.h AS ok
FROM walk w JOIN f ON f.i = w.i + 1))"""


# A dictionary of the pages in SQL, for given candidates: counts, covers of pieces, choice, covers of bits, codes


def _dictionary_sql(most: int) -> str:
    return f"""WITH RECURSIVE {PAGES_SQL},
hist AS (SELECT i::INTEGER AS symbol, (coalesce(n, 0) + 1)::BIGINT AS freq FROM range(1, 128) r(i) LEFT JOIN (SELECT ascii(ch) AS symbol, count(*) AS n FROM (SELECT unnest(string_split(line, '')) AS ch FROM u) GROUP BY 1) c ON c.symbol = i),
{_values("given", "str", [(t,) for _, t, _ in PATTERNS])},
pool AS (SELECT str, count(*)::BIGINT AS n FROM (SELECT line, unnest(range(1, length(line) + 1)) AS i FROM u) JOIN given ON substr(line, i::BIGINT, length(str)) = str GROUP BY str),
total AS (SELECT (1 + (SELECT sum(freq) FROM hist) + (SELECT sum(n) FROM pool))::DOUBLE AS total),
unit AS (SELECT symbol, chr(symbol) AS str, 1 AS cost, '' AS code FROM hist UNION ALL SELECT (127 + row_number() OVER (ORDER BY str))::INTEGER, str, 1, '' FROM pool),
{_cover_steps("unit", "1")},
priced AS (SELECT symbol, str, 1 + coalesce(uses, 0) AS freq, log2(total / (1 + coalesce(uses, 0))) AS h FROM unit LEFT JOIN used1 USING (symbol), total),
f AS (SELECT str, freq, h, freq * (8 * length(str) - h) AS gain, row_number() OVER (ORDER BY freq * (8 * length(str) - h) DESC, str) AS i FROM priced WHERE symbol > 127),
{_walk_sql(most)},
entries AS (SELECT symbol, str, greatest(1, floor(h))::BIGINT AS cost, '' AS code FROM priced WHERE symbol < 128 UNION ALL SELECT (127 + row_number() OVER (ORDER BY i))::INTEGER, str, greatest(1, floor(h))::BIGINT, '' FROM walk WHERE ok),
{_cover_steps("entries", "2")},
freqs AS (SELECT symbol, str, (1 + coalesce(uses, 0))::BIGINT AS freq FROM entries LEFT JOIN used2 USING (symbol)),
merged AS (SELECT 0 AS step, (SELECT list_sort(list({{'f': freq, 's': symbol, 'm': [symbol]}})) FROM freqs) AS l, []::INTEGER[] AS a, []::INTEGER[] AS b, 0::BIGINT AS cost
UNION ALL
SELECT step + 1, list_sort(list_append(l[3:], {{'f': l[1].f + l[2].f, 's': least(l[1].s, l[2].s), 'm': list_concat(l[1].m, l[2].m)}})), l[1].m, l[2].m, (l[1].f + l[2].f)::BIGINT FROM merged WHERE len(l) > 1),
codes AS (SELECT symbol, string_agg(bit, '' ORDER BY step DESC) AS code FROM (SELECT unnest(a) AS symbol, '0' AS bit, step FROM merged UNION ALL SELECT unnest(b), '1', step FROM merged) GROUP BY symbol),
dict AS (SELECT symbol, str, freq, symbol < 128 AS is_literal, length(code)::INTEGER AS code_len, code FROM freqs JOIN codes USING (symbol))"""


_COSTED = [(s, t, c, "") for s, t, c in ENTRIES]
_UNIT = [(s, t, 1, "") for s, t, _ in ENTRIES]
_CODED = [(s, t, len(c), c) for s, t, c in CODED]


def _path(df: DataFrame) -> DataFrame:
    return df.select("line_no", "cost", F.array_join(F.col("path").cast("array<string>"), " ").alias("path"))


# Queries: name, Spark, DuckDB


def _queries() -> dict[str, tuple[Query, str | None]]:
    q: dict[str, tuple[Query, str | None]] = {}
    doc_lines = f"l AS (SELECT doc_id AS doc, (i - 1)::BIGINT AS pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"
    valid = VALID.format(c="line")
    q["ingest_valid_lines"] = lambda s, d: sources.valid_lines(sources.split_documents(_table(s, d, "documents"), "doc_id", "text")), f"WITH {doc_lines} SELECT * FROM l WHERE {valid}"
    q["skipped_lines"] = (
        lambda s, d: sources.skipped_lines(sources.split_documents(_table(s, d, "documents"), "doc_id", "text")),
        f"WITH {doc_lines}, k AS (SELECT *, {valid} AS ok FROM l) SELECT doc, pos, line, reported FROM (SELECT *, (1 + sum(ok::INT) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING))::BIGINT AS reported FROM k) WHERE NOT ok",
    )
    for name, chars in (("dot", "."), ("slash", "/"), ("dot_slash", "./")):
        q[f"component_split_{name}"] = (
            lambda s, d, chars=chars: sources.components(_pages(s, d), chars),
            f"WITH {PAGES_SQL}, t AS (SELECT line_no, list_filter(regexp_split_to_array(line, '[{chars}]'), lambda x: x <> '') AS t FROM u) SELECT line_no, (generate_subscripts(t, 1) - 1)::BIGINT AS pos, unnest(t) AS token FROM t",
        )
    q["component_split_letters"] = (
        lambda s, d: sources.components(_pages(s, d), "dnw-^]"),
        f"WITH {PAGES_SQL}, t AS (SELECT line_no, list_filter(string_split(translate(line, 'dnw-^]', '......'), '.'), lambda x: x <> '') AS t FROM (SELECT line_no, replace(line, '.', chr(1)) AS line FROM u)) SELECT line_no, (generate_subscripts(t, 1) - 1)::BIGINT AS pos, replace(unnest(t), chr(1), '.') AS token FROM t",
    )
    q["char_histogram"] = (
        lambda s, d: mining.histogram(_pages(s, d)).select("symbol", "freq"),
        f"WITH {PAGES_SQL}, c AS (SELECT ascii(ch) AS symbol, count(*) AS n FROM (SELECT unnest(string_split(line, '')) AS ch FROM u) GROUP BY 1) SELECT i::INTEGER AS symbol, (coalesce(n, 0) + 1)::BIGINT AS freq FROM range(1, 128) r(i) LEFT JOIN c ON c.symbol = i",
    )
    q["corpus_bytes"] = lambda s, d: _pages(s, d).agg(F.sum(F.octet_length("line")).cast("long").alias("total_input_bytes"), F.count("*").alias("records")), f"WITH {PAGES_SQL} SELECT sum(strlen(line))::BIGINT AS total_input_bytes, count(*)::BIGINT AS records FROM u"
    for corpus, frame, sql in (("pages", _pages, PAGES_SQL), ("parts", _parts, PARTS_SQL)):
        mined = _mining_sql(sql, K, RATIO)
        q[f"kgrams_{corpus}"] = lambda s, d, f=frame: mining.kgrams(f(s, d), K), f"WITH {mined} SELECT * FROM g"
        q[f"kgram_running_count_{corpus}"] = lambda s, d, f=frame: _counted(f(s, d)).select("line_no", "pos", "kgram", "hh"), f"WITH {mined} SELECT line_no, pos, kgram, hh FROM c"
        q[f"kgram_series_{corpus}"] = lambda s, d, f=frame: _series(f(s, d)), f"WITH {mined} SELECT line_no, s, e, text FROM series"
        q[f"series_line_counts_{corpus}"] = lambda s, d, f=frame: mining.series_counts(_series(f(s, d))), f"WITH {mined} SELECT * FROM counts"
        q[f"candidate_topn_{corpus}"] = lambda s, d, f=frame: mining.top_candidates(_scores(f(s, d), 100), 100), f"WITH {_scores_sql(sql, K, RATIO, 100)} SELECT * FROM scores ORDER BY score DESC, pat LIMIT {mining.pool_size(100)}"
    mined = _mining_sql(PAGES_SQL, K, RATIO)
    q["kgram_series_r09_k2"] = lambda s, d: _series(_pages(s, d), 2, 0.9), f"WITH {_mining_sql(PAGES_SQL, 2, 0.9)} SELECT line_no, s, e, text FROM series"
    components_sql = f"u AS (SELECT line_no * {1 << sources.COMPONENT_BITS} + generate_subscripts(t, 1) - 1 AS line_no, unnest(t) AS line FROM (SELECT page_id AS line_no, list_filter(regexp_split_to_array(url, '[.]'), lambda x: x <> '') AS t FROM pages))"
    q["component_series_k2"] = (
        lambda s, d: _series(sources.numbered_components(_pages(s, d), "."), 2, run=64 << sources.COMPONENT_BITS),
        f"WITH {_mining_sql(components_sql, 2, RATIO)} SELECT line_no, s, e, text FROM series",
    )
    q["kgram_topn"] = lambda s, d: mining.kgrams(_pages(s, d), K).groupBy("kgram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kgram").limit(50), f"WITH {mined} SELECT kgram, count(*)::BIGINT AS n FROM g GROUP BY kgram ORDER BY n DESC, kgram LIMIT 50"
    q["kgram_two_pass_counts"] = (
        lambda s, d: mining.final_counts(mining.kgrams(_pages(s, d), K), 200).select("line_no", "pos", "kgram", "hh"),
        f"WITH {mined}, t AS (SELECT kgram, count(*) AS n FROM g GROUP BY kgram ORDER BY n DESC, kgram LIMIT 200) SELECT line_no, pos, kgram, coalesce(n, 0)::BIGINT AS hh FROM g LEFT JOIN t USING (kgram)",
    )
    q["kgram_space_saving"] = (
        lambda s, d: mining.space_saving(mining.kgrams(_pages(s, d), K), "kgram", ["line_no", "pos"], 1 << 20).select("item", "count"),
        f"WITH {mined} SELECT kgram AS item, count(*)::BIGINT AS count FROM g GROUP BY kgram",
    )
    q["kgram_approximate_top"] = lambda s, d: mining.approximate_top(mining.kgrams(_pages(s, d), K), "kgram", 20), None
    q["series_at_least"] = lambda s, d: mining.at_least(mining.series_counts(_series(_pages(s, d))), 5), f"WITH {mined} SELECT * FROM counts WHERE real_count >= 5"
    q["heavy_series_topn"] = lambda s, d: mining.heavy(mining.series_counts(_series(_pages(s, d))), 100), f"WITH {mined} SELECT * FROM counts ORDER BY real_count DESC, pat LIMIT 100"
    q["containment_score"] = lambda s, d: _scores(_pages(s, d), 100), f"WITH {_scores_sql(PAGES_SQL, K, RATIO, 100)} SELECT * FROM scores"
    q["whitelist_filter"] = (
        lambda s, d: mining.without_listed(_series(_pages(s, d)), s.createDataFrame([(w,) for w in WHITE_LIST], "pat string"), K).select("line_no", "s", "e", "text"),
        f"WITH {mined}, {_values('w', 'pat', [(w,) for w in WHITE_LIST])} SELECT line_no, s, e, text FROM series WHERE NOT EXISTS (SELECT 1 FROM w WHERE contains(w.pat, series.text) AND length(series.text) >= {K})",
    )
    q["signature_sets"] = (
        lambda s, d: mining.signature_sets(_series(_pages(s, d)), RATIO, run=64),
        f"""WITH RECURSIVE {mined},
once AS (SELECT line_no, text, min(s) AS s FROM series GROUP BY line_no, text),
told AS (SELECT *, row_number() OVER (PARTITION BY line_no ORDER BY s) AS i, CASE WHEN nth > 1 THEN nth ELSE 0 END AS seen FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY line_no) AS nth FROM once)),
gate AS (SELECT line_no, 0::BIGINT AS i, 0::BIGINT AS last, []::VARCHAR[] AS kept FROM (SELECT DISTINCT line_no FROM told)
UNION ALL
SELECT t.line_no, t.i, CASE WHEN t.seen > g.last * {RATIO}::DOUBLE THEN t.seen ELSE g.last END, CASE WHEN t.seen > g.last * {RATIO}::DOUBLE THEN list_append(g.kept, t.text) ELSE g.kept END FROM gate g JOIN told t ON t.line_no = g.line_no AND t.i = g.i + 1)
SELECT '¡Ã' || array_to_string(list_sort(kept), '¡Ã') || '¡Ã' AS signature, count(*)::BIGINT AS n FROM (SELECT line_no, arg_max(kept, i) AS kept FROM gate GROUP BY line_no) WHERE len(kept) > 0 GROUP BY 1""",
    )
    q["evicting_summary"] = (
        lambda s, d: mining.space_saving(mining.kgrams(sources.from_table(_table(s, d, "nation"), "n_nationkey", "n_name"), 2), "kgram", ["line_no", "pos"], 20),
        """WITH RECURSIVE u AS (SELECT n_nationkey::BIGINT AS line_no, n_name AS line FROM nation),
g AS (SELECT substr(line, i::BIGINT, 2) AS item, row_number() OVER (ORDER BY line_no, i) AS i FROM (SELECT line_no, line, unnest(range(1, length(line))) AS i FROM u)),
w AS (SELECT 0::BIGINT AS i, []::STRUCT(c BIGINT, t BIGINT, item VARCHAR, d BIGINT)[] AS l
UNION ALL
SELECT g.i, list_sort(CASE
WHEN list_contains(list_transform(l, lambda x: x.item), g.item) THEN list_transform(l, lambda x: CASE WHEN x.item = g.item THEN {'c': x.c + 1, 't': g.i, 'item': x.item, 'd': x.d} ELSE x END)
WHEN len(l) < 20 THEN list_append(l, {'c': 1, 't': g.i, 'item': g.item, 'd': 0})
ELSE list_append(l[2:], {'c': l[1].c + 1, 't': g.i, 'item': g.item, 'd': l[1].c}) END) FROM w JOIN g ON g.i = w.i + 1)
SELECT x.item AS item, x.c AS count, x.d AS delta FROM (SELECT unnest(l) AS x FROM w WHERE i = (SELECT max(i) FROM w))""",
    )
    # Matching
    occ = f"WITH {PAGES_SQL}, {_values('dict', 'symbol, str', [(s, t) for s, t, _ in PATTERNS])}, o AS (SELECT line_no, (i + length(str) - 1)::BIGINT AS end_pos, length(str)::INTEGER AS len, symbol::INTEGER AS symbol FROM (SELECT line_no, line, unnest(range(1, length(line) + 1)) AS i FROM u) JOIN dict ON substr(line, i::BIGINT, length(str)) = str)"
    found = lambda s, d: matching.occurrences(_pages(s, d), _patterns(s))
    q["pattern_occurrences"] = found, f"{occ} SELECT * FROM o"
    q["pattern_occurrence_counts"] = lambda s, d: matching.occurrence_counts(found(s, d)), f"{occ} SELECT symbol, count(*)::BIGINT AS n FROM o GROUP BY symbol"
    q["pattern_counts_by_find"] = lambda s, d: matching.counts_by_find(_pages(s, d), [(s_, t) for s_, t, _ in PATTERNS]), f"{occ} SELECT symbol, count(*)::BIGINT AS n FROM o GROUP BY symbol"
    q["match_hit_positions"] = lambda s, d: matching.hit_positions(found(s, d)), f"{occ} SELECT line_no, count(DISTINCT end_pos)::BIGINT AS hits FROM o GROUP BY line_no"
    tops = [(s, t) for s, t, _ in PATTERNS if t in (".net/", ".org/")]
    q["any_match"] = lambda s, d: matching.any_match(_pages(s, d), matching.occurrences(_pages(s, d), s.createDataFrame(tops, "symbol int, str string"))), f"WITH {PAGES_SQL} SELECT line_no, line FROM u WHERE " + " OR ".join(f"contains(line, '{t}')" for _, t in tops)
    # Covers and codes
    q["literal_cover"] = lambda s, d: _path(cover.covers(_pages(s, d), ENTRIES[: schema.LITERALS])), f"WITH {PAGES_SQL} SELECT line_no, (length(line) * {LITERAL_COST})::BIGINT AS cost, array_to_string(list_transform(string_split(line, ''), lambda x: ascii(x)), ' ') AS path FROM u"
    q["min_piece_cover"] = lambda s, d: _path(cover.covers(_pages(s, d), [(x, t, 1) for x, t, _ in ENTRIES])), f"{_cover_sql(PAGES_SQL, _UNIT)} SELECT line_no, v.c AS cost, ltrim(v.p) AS path FROM best"
    q["cover_path"] = lambda s, d: _path(cover.covers(_pages(s, d), ENTRIES)), f"{_cover_sql(PAGES_SQL, _COSTED)} SELECT line_no, v.c AS cost, ltrim(v.p) AS path FROM best"
    q["min_bit_cover_cost"] = lambda s, d: cover.covers(_parts(s, d), ENTRIES).select("line_no", "cost"), f"{_cover_sql(PARTS_SQL, _COSTED)} SELECT line_no, v.c AS cost FROM best"
    q["cover_usage_counts"] = (
        lambda s, d: cover.usage(_pages(s, d), ENTRIES).select("symbol", (F.col("uses") + 1).alias("freq")),
        f"{_cover_sql(PAGES_SQL, _COSTED)} SELECT x::INTEGER AS symbol, (count(*) + 1)::BIGINT AS freq FROM (SELECT unnest(string_split(ltrim(v.p), ' ')) AS x FROM best) GROUP BY x",
    )
    scored = lambda s, d: mining.histogram(_pages(s, d)).select("symbol", "freq").withColumn("h", F.round(scalars.ideal_length(F.lit(20000), F.col("freq")), 6))
    hist = q["char_histogram"][1]
    q["ideal_code_length"] = scored, f"SELECT symbol, freq, round(log2(20000::DOUBLE / freq), 6) AS h FROM ({hist})"
    q["pattern_gain"] = (
        lambda s, d: matching.occurrence_counts(found(s, d)).join(F.broadcast(_patterns(s)), "symbol").select("symbol", "n", F.round(scalars.gain(F.col("n"), F.length("str"), scalars.ideal_length(F.lit(20000), F.col("n"))), 4).alias("gain")),
        f"{occ} SELECT symbol, n, round(n * (8 * length(str) - log2(20000::DOUBLE / n)), 4) AS gain FROM (SELECT symbol, count(*)::BIGINT AS n FROM o GROUP BY symbol) JOIN dict USING (symbol)",
    )

    def anchors(s: SparkSession, d: str) -> DataFrame:
        text = {x: t for x, t, _ in PATTERNS}
        freqs = [(text[r["symbol"]], r["n"]) for r in matching.occurrence_counts(found(s, d)).collect()]
        return s.createDataFrame(selection.anchor_select(freqs, 1_000_000, 6), "str string, freq long, code_len long")

    q["anchor_select"] = (
        anchors,
        occ.replace("WITH ", "WITH RECURSIVE ", 1)
        + """, f AS (SELECT str, n AS freq, log2(1000000::DOUBLE / n) AS h, row_number() OVER (ORDER BY n * (8 * length(str) - log2(1000000::DOUBLE / n)) DESC, str) AS i, n * (8 * length(str) - log2(1000000::DOUBLE / n)) AS gain FROM (SELECT symbol, count(*)::BIGINT AS n FROM o GROUP BY symbol) JOIN dict USING (symbol)),
"""
        + _walk_sql(6)
        + """
SELECT str, freq, greatest(1, floor(h))::BIGINT AS code_len FROM walk WHERE ok""",
    )
    q["encode_bits"] = lambda s, d: codec.encode_bits(_pages(s, d), CODED), f"{_cover_sql(PAGES_SQL, _CODED)} SELECT line_no, v.c AS nbits, v.b AS bits FROM best"
    q["encode_payload"] = (
        lambda s, d: codec.encode(_parts(s, d), CODED).select("line_no", F.col("nbits").cast("long").alias("nbits"), F.hex("payload").alias("payload")),
        f"{_cover_sql(PARTS_SQL, _CODED)}, x AS (SELECT line_no, v.c AS nbits, rpad(v.b, (ceil(v.c / 8.0) * 8)::INTEGER, '0') AS b FROM best) SELECT line_no, nbits, array_to_string(list_transform(range(0, length(b) // 4), lambda i: format('{{:X}}', (substr(b, i * 4 + 1, 1)::INT * 8 + substr(b, i * 4 + 2, 1)::INT * 4 + substr(b, i * 4 + 3, 1)::INT * 2 + substr(b, i * 4 + 4, 1)::INT))), '') AS payload FROM x",
    )
    q["packed_bits"] = (
        lambda s, d: codec.encode_bits(_parts(s, d), CODED).select("line_no", F.hex(scalars.pack_bits(F.col("bits"))).alias("payload")),
        f"SELECT line_no, payload FROM ({q['encode_payload'][1]})",
    )
    q["encoded_size_totals"] = (
        lambda s, d: codec.totals(_pages(s, d), codec.encode(_pages(s, d), CODED)).withColumn("ratio", F.round(F.col("encoded_bytes") / F.col("decoded_bytes"), 6)),
        f"{_cover_sql(PAGES_SQL, _CODED)}, t AS (SELECT sum(strlen(line) + 1)::BIGINT AS decoded_bytes, ceil(sum(v.c) / 8.0)::BIGINT AS encoded_bytes, count(*)::BIGINT AS n FROM best) SELECT *, round(encoded_bytes / decoded_bytes, 6) AS ratio FROM t",
    )
    q["decode_roundtrip"] = lambda s, d: codec.decode(codec.encode(_pages(s, d), CODED), CODED), f"WITH {PAGES_SQL} SELECT * FROM u"

    def mined_roundtrip(s: SparkSession, d: str) -> DataFrame:
        built = plans.build(_pages(s, d), MINED).coded()
        return codec.decode(codec.encode(_pages(s, d), built), built)

    q["mined_roundtrip"] = mined_roundtrip, q["decode_roundtrip"][1]
    q["mined_components_roundtrip"] = (lambda s, d: (lambda b: codec.decode(codec.encode(_pages(s, d), b), b))(plans.build(_pages(s, d), plans.Params(1100, 100, 0.5, 2), ".").coded())), q["decode_roundtrip"][1]
    q["mined_candidates"] = lambda s, d: plans.candidates(_pages(s, d), MINED), q["candidate_topn_pages"][1]
    # Dictionaries

    def chosen(s: SparkSession, d: str, most: int = 6) -> plans.Dictionary:
        """The dictionary of the pages with PATTERNS as candidates."""
        pages, text = _pages(s, d), {x: t for x, t, _ in PATTERNS}
        literals = {r["symbol"]: r["freq"] for r in mining.histogram(pages).collect()}
        pool = [(text[r["symbol"]], r["n"]) for r in matching.occurrence_counts(found(s, d)).collect()]
        return plans.finish(pages, literals, pool, 1 + sum(literals.values()) + sum(n for _, n in pool), plans.Params(n2=most))

    made = _dictionary_sql(6)
    code_hex = "(SELECT '0x' || array_to_string(list_transform(range(0, ceil(length(code) / 8.0)::BIGINT * 2), lambda i: format('{:x}', list_sum(list_transform(range(1, 5), lambda j: (1 << (4 - j)) * (substr(code, i * 4 + j, 1) = '1')::INT))::BIGINT)), ''))"
    q["dict_rows"] = lambda s, d: chosen(s, d).frame(s), f"{made} SELECT * FROM dict"
    q["dict_size"] = lambda s, d: plans.size_bytes(chosen(s, d).frame(s)), f"{made} SELECT sum(12 + strlen(str) + ceil(code_len / 32.0))::BIGINT AS dict_size, sum(12 + strlen(str) + 4 * ceil(code_len / 32.0))::BIGINT AS dict_bytes FROM dict"
    q["stats_row"] = lambda s, d: (lambda x: plans.stats(x.frame(s), x.records))(chosen(s, d)), f"{made} SELECT count(*)::BIGINT AS symbols, sum((symbol >= 128)::INT)::BIGINT AS patterns, max(code_len)::BIGINT AS max_code_len, max(length(str))::BIGINT AS max_pattern_len, sum(length(str))::BIGINT AS pattern_chars, (SELECT count(*) FROM u)::BIGINT AS records FROM dict"
    q["dump_patterns"] = lambda s, d: store.dump(store.patterns_only(chosen(s, d).frame(s))), f"{made} SELECT symbol, freq, code_len, {code_hex} AS code_hex, length(str)::INTEGER AS str_len, str FROM dict WHERE NOT is_literal"
    q["dump_from_symbol"] = lambda s, d: store.from_symbol(chosen(s, d).frame(s), 41).select("symbol", "str", "freq"), f"{made} SELECT symbol, str, freq FROM dict WHERE symbol >= 41"
    q["huffman_weighted_length"] = lambda s, d: chosen(s, d).frame(s).agg(F.sum(F.col("freq") * F.col("code_len")).alias("total")), f"{made} SELECT sum(cost)::BIGINT AS total FROM merged"

    def stored(s: SparkSession, d: str) -> DataFrame:
        path = store.scratch(s)
        store.store(chosen(s, d), s, path)
        back = store.load(s, path)
        return back.frame(s).withColumns({"n2": F.lit(back.params.n2).cast("long"), "records": F.lit(back.records).cast("long")})

    q["stored_dictionary"] = stored, f"{made} SELECT *, 6::BIGINT AS n2, (SELECT count(*) FROM u)::BIGINT AS records FROM dict"
    # Files: the pages' URLs, and other columns, written and read again

    def archived(s: SparkSession, d: str) -> DataFrame:
        path = store.scratch(s)
        sources.write_lines(_pages(s, d), f"{path}/in")
        store.compress(s, f"{path}/in", f"{path}/archive", MINED, None)
        store.extract(s, f"{path}/archive", f"{path}/out")
        return sources.read_lines(s, f"{path}/out").select("line")

    def delimited(s: SparkSession, d: str) -> DataFrame:
        path = store.scratch(s)
        sources.write_lines(_pages(s, d), path, b"\xff")
        return sources.read_lines(s, path, b"\xff").select("line", F.octet_length("line").alias("n"))

    def pattern_file(s: SparkSession, d: str) -> DataFrame:
        path = store.scratch(s)
        _table(s, d, "part").select("p_name").unionByName(s.createDataFrame([("",)], "p_name string")).write.text(path)
        return sources.read_patterns(s, path)

    def reported(s: SparkSession, d: str) -> DataFrame:
        path = store.scratch(s)
        store.append_report(commands.encode_report(s, _pages(s, d), chosen(s, d)), path)
        return s.read.option("header", True).option("inferSchema", True).csv(path).select(*(F.col(c).cast("long").alias(c) for c in ("n", "decoded_bytes", "encoded_bytes", "dict_size", "symbols", "patterns", "max_code_len", "max_pattern_len", "pattern_chars", "n2")))

    q["archive_roundtrip"] = archived, f"WITH {PAGES_SQL} SELECT line FROM u"
    q["byte_delimited_lines"] = delimited, f"WITH {PAGES_SQL} SELECT line, strlen(line)::INTEGER AS n FROM u"
    q["pattern_file"] = pattern_file, "SELECT DISTINCT p_name AS pat FROM part WHERE p_name <> ''"
    q["report_csv"] = (
        reported,
        f"{made}, coded AS (SELECT symbol, str, code_len::BIGINT AS cost, '' AS code FROM dict), {_cover_steps('coded', '3')} SELECT (SELECT count(*) FROM best3)::BIGINT AS n, (SELECT sum(strlen(line) + 1) FROM u)::BIGINT AS decoded_bytes, (SELECT ceil(sum(v.c) / 8.0) FROM best3)::BIGINT AS encoded_bytes, sum(12 + strlen(str) + ceil(code_len / 32.0))::BIGINT AS dict_size, count(*)::BIGINT AS symbols, sum((symbol >= 128)::INT)::BIGINT AS patterns, max(code_len)::BIGINT AS max_code_len, max(length(str))::BIGINT AS max_pattern_len, sum(length(str))::BIGINT AS pattern_chars, 6::BIGINT AS n2 FROM dict",
    )
    q["symbol_of_char"] = lambda s, d: _pages(s, d).select("line_no", F.posexplode(F.transform(F.filter(F.split("line", ""), lambda c: c != ""), lambda c: F.ascii(c))).alias("pos", "symbol")), f"WITH {PAGES_SQL} SELECT line_no, (generate_subscripts(c, 1) - 1)::INTEGER AS pos, ascii(unnest(c)) AS symbol FROM (SELECT line_no, string_split(line, '') AS c FROM u)"
    # Lookups
    built = lambda s, d: _pages(s, d).where(F.col("line").contains("/en/"))  # noqa: E731  one category of the pages; the others are misses
    missed = lambda df: df.withColumn("value", F.coalesce("value", F.lit(-1)))  # noqa: E731  a miss is -1 here: no nullable numbers to compare
    table_sql = f"WITH {PAGES_SQL}, t AS (SELECT line, max(line_no) AS value FROM u WHERE contains(line, '/en/') GROUP BY line)"
    q["lookup_plain"] = lambda s, d: missed(lookup.plain(_pages(s, d), lookup.table(built(s, d)))), f"{table_sql} SELECT line_no, line, coalesce(value, -1) AS value FROM u LEFT JOIN t USING (line)"
    q["lookup_encoded"] = lambda s, d: missed(lookup.encoded(_pages(s, d), lookup.encoded_table(built(s, d), CODED), CODED)), f"{table_sql} SELECT line_no, coalesce(value, -1) AS value FROM u LEFT JOIN t USING (line)"
    q["lookup_duplicates"] = lambda s, d: lookup.encoded(_parts(s, d), lookup.encoded_table(_parts(s, d), CODED), CODED), f"WITH {PARTS_SQL}, t AS (SELECT line, max(line_no) AS value FROM u GROUP BY line) SELECT line_no, value FROM u JOIN t USING (line)"
    q["lookup_misses"] = lambda s, d: lookup.misses(_pages(s, d), lookup.table(built(s, d))).select("line_no", "line"), f"{table_sql} SELECT line_no, line FROM u WHERE line NOT IN (SELECT line FROM t)"
    q["lookup_last_of"] = lambda s, d: lookup.last_of(_parts(s, d)).select("line_no", "line"), f"WITH {PARTS_SQL} SELECT max(line_no) AS line_no, line FROM u GROUP BY line"
    q["lookup_key_sizes"] = lambda s, d: lookup.key_sizes(lookup.table(_parts(s, d)), lookup.encoded_table(_parts(s, d), CODED)), f"{_cover_sql(PARTS_SQL, _CODED)}, k AS (SELECT DISTINCT line, v.c AS c FROM best) SELECT sum(strlen(line))::BIGINT AS plain_key_bytes, sum(ceil(c / 8.0) + 2)::BIGINT AS encoded_key_bytes, count(*)::BIGINT AS n_plain, count(*)::BIGINT AS n_encoded FROM k"
    q["longest_prefix"] = (
        lambda s, d: lookup.longest_prefix(_pages(s, d), s.createDataFrame([(p,) for p in PREFIXES], "prefix string")),
        f"WITH {PAGES_SQL}, {_values('p', 'prefix', [(p,) for p in PREFIXES])} SELECT line_no, arg_max(prefix, length(prefix)) AS prefix FROM u JOIN p ON starts_with(line, prefix) AND (line = prefix OR ends_with(prefix, '/')) GROUP BY line_no",
    )
    # Scalars
    q["hex_escape"] = (
        lambda s, d: _table(s, d, "conversations").select("conv_id", "turn", scalars.hex_escape(F.concat(F.col("text"), F.lit("\t\n"))).alias("escaped")),
        "SELECT conv_id, turn, array_to_string(list_transform(string_split(text || chr(9) || chr(10), ''), lambda c: CASE WHEN regexp_full_match(c, '[ -~]') THEN c ELSE '|' || hex(c) || '|' END), '') AS escaped FROM conversations",
    )
    q["size_conversions"] = (
        lambda s, d: _table(s, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("x")).distinct().select("x", scalars.bits_to_words(F.col("x")).alias("w"), scalars.bits_to_bytes(F.col("x")).alias("b"), scalars.bytes_to_words(F.col("x")).alias("bw")),
        "SELECT x, ceil(x / 32.0)::BIGINT AS w, ceil(x / 8.0)::BIGINT AS b, ceil(x / 4.0)::BIGINT AS bw FROM (SELECT DISTINCT l_orderkey::BIGINT AS x FROM lineitem)",
    )
    q["bit_fields"] = (
        lambda s, d: _table(s, d, "orders").select(F.col("o_orderkey").cast("long").alias("x")).select("x", scalars.popcount(F.col("x")).cast("long").alias("ones"), *(scalars.get_bits(F.col("x"), F.lit(i), 3).alias(f"f{i}") for i in range(3))),
        "SELECT x, bit_count(x)::BIGINT AS ones, (x >> 0) & 7 AS f0, (x >> 3) & 7 AS f1, (x >> 6) & 7 AS f2 FROM (SELECT o_orderkey::BIGINT AS x FROM orders)",
    )
    for width in (1, 2):
        q[f"bit_fields_set_{width}"] = (
            lambda s, d, width=width: _table(s, d, "orders").select(F.col("o_orderkey").cast("long").alias("x")).select("x", *(scalars.set_bits(F.col("x"), F.lit(i), width, F.lit(v)).alias(f"s{i}") for i, v in ((0, 1), (3, 2), (5, 3))), scalars.get_bits(F.col("x"), F.lit(3), width).alias("g3")),
            f"SELECT x, {', '.join(f'(x & ~({(1 << width) - 1}::BIGINT << {i * width})) | ({v & ((1 << width) - 1)}::BIGINT << {i * width}) AS s{i}' for i, v in ((0, 1), (3, 2), (5, 3)))}, (x >> {3 * width}) & {(1 << width) - 1} AS g3 FROM (SELECT o_orderkey::BIGINT AS x FROM orders)",
        )
    q["crc32c_of_urls"] = (
        lambda s, d: _pages(s, d).select("line_no", udfs.crc32c()("line").alias("crc")),
        f"WITH {PAGES_SQL} SELECT line_no, xor(4294967295, list_reduce(list_transform(string_split(line, ''), lambda c: ascii(c)::BIGINT), lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda r, step: CASE WHEN r & 1 = 1 THEN xor(r >> 1, {udfs.CASTAGNOLI}) ELSE r >> 1 END), 4294967295::BIGINT)) AS crc FROM u",
    )
    q["udf_roundtrip"] = (
        lambda s, d: _pages(s, d).select("line_no", udfs.encoder(CODED)("line").alias("e")).select("line_no", udfs.decoder(CODED)("e.nbits", "e.payload").alias("line")),
        q["decode_roundtrip"][1],
    )
    q["series_sorted_by_score"] = lambda s, d: _scores(_pages(s, d), 100).orderBy("score", "pat"), q["containment_score"][1]
    q["sanity_roundtrip"] = lambda s, d: codec.decode(codec.encode(s.createDataFrame([(1, SANITY)], schema.LINES), CODED), CODED), f"SELECT 1::BIGINT AS line_no, '{SANITY}' AS line"
    q["log_lines_topn"] = lambda s, d: _table(s, d, "events").groupBy("props").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "props").limit(20), "SELECT props, count(*)::BIGINT AS n FROM events GROUP BY props ORDER BY n DESC, props LIMIT 20"
    return q


PREFIXES = ["https://", "http://", "https://blog.ththan.example.net/", "http://blog.ththan.example.net/en/", "https://www.therti.example.org/en/", "https://"]
SANITY = "http://www.example.com/home/index.html"


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in _queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _queries().items() if sql}
