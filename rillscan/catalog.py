"""Every registered query of the engine and its DuckDB twin.

Each query has a DataFrame form over the library's operators and its own SQL for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import hashing, probability
from .operators import hierarchy, keys, match, model, reports, sketches, suffix_array
from .plans import costs, levels, presets
from .sources import generators, streams
from .session import cut, table
from .streaming import loads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

N = 2
BLOCK = 16
WINDOW = 24
#: Patterns of characters: every whole benchmark text, and a prefix of 1 to 60 characters of each.
PREFIX = 60

#: Streams and patterns as DuckDB sees them.
EVENT_STREAM = "SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS token FROM events WHERE event_type IS NOT NULL"
EVENT_PATTERNS = f"SELECT token || ',' || t1 || ',' || t2 AS name, token AS t0, t1, t2, row_number() OVER (ORDER BY token || ',' || t1 || ',' || t2) AS pid FROM (SELECT DISTINCT token, t1, t2 FROM (SELECT pos, token, lead(token, 1) OVER w AS t1, lead(token, 2) OVER w AS t2 FROM ({EVENT_STREAM}) WINDOW w AS (PARTITION BY stream_id ORDER BY pos)) WHERE pos = 0 AND t2 IS NOT NULL)"
EVENT_MATCHES = f"SELECT p.pid, s.stream_id, s.pos FROM (SELECT stream_id, pos, token, lead(token, 1) OVER w AS t1, lead(token, 2) OVER w AS t2 FROM ({EVENT_STREAM}) WINDOW w AS (PARTITION BY stream_id ORDER BY pos)) s JOIN ({EVENT_PATTERNS}) p ON s.token = p.t0 AND s.t1 = p.t1 AND s.t2 = p.t2"
TEXTS = "SELECT doc_id AS stream_id, regexp_replace(text, '[\\r\\n]', '', 'g') AS text FROM documents WHERE text IS NOT NULL"
TEXT_PATTERNS = f"SELECT 2 * item_id AS pid, text AS pattern FROM benchmark UNION ALL SELECT 2 * item_id + 1, substr(text, 1, (1 + item_id * 7 % {PREFIX})::BIGINT) FROM benchmark"
TEXT_MATCHES = f"SELECT pid, stream_id, unnest(list_filter(range(1, length(text) - length(pattern) + 2), lambda i: substr(text, i, length(pattern)) = pattern)) - 1 AS pos FROM ({TEXTS}) JOIN ({TEXT_PATTERNS}) ON pattern <> '' AND contains(text, pattern)"
GRAMS = f"SELECT stream_id, pos, token || chr(1) || t1 AS gram FROM (SELECT stream_id, pos, token, lead(token, 1) OVER (PARTITION BY stream_id ORDER BY pos) AS t1 FROM ({EVENT_STREAM})) WHERE t1 IS NOT NULL"
PATTERN_GRAMS = f"SELECT pid, 0 AS k, t0 || chr(1) || t1 AS gram FROM ({EVENT_PATTERNS}) UNION ALL SELECT pid, 1, t1 || chr(1) || t2 FROM ({EVENT_PATTERNS})"
MIXED_PATTERNS = f"SELECT array_to_string(tokens, ',') AS name, tokens, row_number() OVER (ORDER BY array_to_string(tokens, ',')) AS pid FROM (SELECT DISTINCT tokens FROM (SELECT list(token ORDER BY pos) AS tokens FROM ({EVENT_STREAM}) WHERE pos >= stream_id % 5 AND pos <= stream_id % 5 + stream_id % 7 GROUP BY stream_id))"
MIXED_MATCHES = f"SELECT pid, stream_id, i - 1 AS pos FROM (SELECT stream_id, all_tokens, unnest(range(1, len(all_tokens) + 1)) AS i FROM (SELECT stream_id, list(token ORDER BY pos) AS all_tokens FROM ({EVENT_STREAM}) GROUP BY stream_id)) JOIN ({MIXED_PATTERNS}) ON all_tokens[i:i + len(tokens) - 1] = tokens"
MEMBERS = f"SELECT DISTINCT stream_id, pos // {BLOCK} AS block, level::BIGINT AS level, (pos % {BLOCK}) // ({BLOCK} // (1 << level)) AS interval, gram FROM ({GRAMS}), (SELECT unnest(range(0, 4))::INTEGER AS level)"
HASH = "('0x' || substr(md5({0}), 1, 15))::BIGINT"


def query(sql: str | None = None):
    """Registers a function as a query, with its SQL for DuckDB."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def _events(spark, sf_dir):
    return streams.event_tokens(table(spark, sf_dir, "events"))


def _event_patterns(spark, sf_dir):
    """Distinct first three tokens of the streams: at most (event types) ** 3 patterns, numbered by text."""
    order = Window.partitionBy("stream_id").orderBy("pos")
    firsts = _events(spark, sf_dir).select("pos", F.array("token", F.lead("token", 1).over(order), F.lead("token", 2).over(order)).alias("tokens")).where("pos = 0").where(F.expr("tokens[2] is not null"))
    return firsts.select("tokens").distinct().select(F.row_number().over(Window.orderBy(F.array_join("tokens", ","))).cast("long").alias("pid"), "tokens")


def _texts(spark, sf_dir):
    return streams.stripped_texts(table(spark, sf_dir, "documents"))


def _mixed_patterns(spark, sf_dir):
    """A pattern of 1 to 7 tokens from each stream, from one of its first five places on, without repeats. Computed once: searches read it several times."""
    place = F.col("stream_id") % 5
    cut_out = _events(spark, sf_dir).where((F.col("pos") >= place) & (F.col("pos") <= place + F.col("stream_id") % 7)).groupBy("stream_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]).alias("tokens"))
    return cut(cut_out.select("tokens").distinct().select(F.row_number().over(Window.orderBy(F.array_join("tokens", ","))).cast("long").alias("pid"), "tokens"))


def _text_patterns(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    prefixes = items.select((2 * F.col("item_id") + 1).alias("pid"), F.expr(f"substring(text, 1, int(1 + item_id * 7 % {PREFIX}))").alias("pattern"))
    return items.select((2 * F.col("item_id")).alias("pid"), F.col("text").alias("pattern")).unionByName(prefixes)


def _grams(spark, sf_dir):
    return match.ngrams(_events(spark, sf_dir), N)


def _asked(spark, sf_dir):
    return match.pattern_grams(_event_patterns(spark, sf_dir), N)


def _matches(spark, sf_dir):
    return match.find_tokens(_events(spark, sf_dir), _event_patterns(spark, sf_dir), N)


# ---------------------------------------------------------------- sources


@query(f"SELECT stream_id, length(text) AS n, length(text) - 1 AS last FROM ({TEXTS}) WHERE length(text) > 0")
def scan_chars(spark, sf_dir):
    return streams.characters(table(spark, sf_dir, "documents")).groupBy("stream_id").agg(F.count("*").alias("n"), F.max("pos").alias("last"))


@query("SELECT doc_id AS stream_id, count(*) AS n, sum(length(s))::BIGINT AS size FROM (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '\\r$', '') AS s FROM documents) WHERE length(s) > 0 GROUP BY doc_id")
def scan_segments(spark, sf_dir):
    return streams.segments(table(spark, sf_dir, "documents")).groupBy("stream_id").agg(F.count("*").alias("n"), F.sum(F.length("token")).cast("long").alias("size"))


@query("SELECT doc_id AS stream_id, count(*) AS n, sum(length(w))::BIGINT AS size FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS w FROM documents) GROUP BY doc_id")
def scan_words(spark, sf_dir):
    return streams.words(table(spark, sf_dir, "documents")).groupBy("stream_id").agg(F.count("*").alias("n"), F.sum(F.length("token")).cast("long").alias("size"))


@query(f"SELECT * FROM ({EVENT_STREAM}) WHERE pos < 5")
def stream_limit(spark, sf_dir):
    return streams.first(_events(spark, sf_dir), 5)


@query("""SELECT event_id, '"' || event_id || '","' || replace(coalesce(event_type, ''), '"', '""') || '","' || replace(coalesce(props, ''), '"', '""') || '"' AS line FROM events""")
def csv_line(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", streams.csv_line(["event_id", "event_type", "props"]).alias("line"))


@query("SELECT item_id AS pid, text AS pattern, length(text)::BIGINT AS m FROM benchmark")
def patterns_raw(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pid"), F.col("text").alias("pattern"), F.length("text").cast("long").alias("m"))


@query("SELECT item_id AS pid, trim(text) AS pattern FROM benchmark WHERE trim(text) <> ''")
def patterns_stripped(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pid"), F.trim("text").alias("pattern")).where("pattern <> ''")


@query("SELECT item_id AS pid, unnest(string_split_regex(text, ' +')) AS token, generate_subscripts(string_split_regex(text, ' +'), 1) - 1 AS k FROM benchmark")
def patterns_tokens(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pid"), F.posexplode(F.split("text", " +")).alias("k", "token")).select("pid", "token", F.col("k").cast("long").alias("k"))


@query("SELECT item_id AS pid, length(text)::BIGINT AS m FROM benchmark WHERE length(text) >= 4 AND length(text) BETWEEN 100 AND 600")
def workload_filter(spark, sf_dir):
    return streams.workload(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pid"), F.col("text").alias("pattern")), 4, (100, 600))


def _files(spark, sf_dir):
    """Names of pattern files in numbered folders, as a workload's folder holds them."""
    return table(spark, sf_dir, "documents").select(F.expr("concat('in/', doc_id % 12, '/', 5 + doc_id % 17, if(doc_id % 2 = 0, '.rare.txt', '.frequent.txt'))").alias("path")).distinct()


@query("SELECT path, length::INTEGER AS length, kind, row_number() OVER (ORDER BY length, split_part(path, '/', 3), path) AS at FROM (SELECT DISTINCT 'in/' || (doc_id % 12) || '/' || (5 + doc_id % 17) || '.rare.txt' AS path, 5 + doc_id % 17 AS length, 'rare' AS kind FROM documents WHERE doc_id % 2 = 0 AND doc_id % 12 = 10)")
def workload_files(spark, sf_dir):
    return streams.workload_files(_files(spark, sf_dir).where("path like 'in/10/%'"), "rare")


@query("SELECT (doc_id % 12)::VARCHAR AS dataset, min('in/' || (doc_id % 12) || '/' || (5 + doc_id % 17) || CASE WHEN doc_id % 2 = 0 THEN '.rare.txt' ELSE '.frequent.txt' END) AS path, row_number() OVER (ORDER BY doc_id % 12) AS at FROM documents GROUP BY doc_id % 12")
def dataset_discovery(spark, sf_dir):
    return streams.datasets(_files(spark, sf_dir))


@query(f"SELECT i AS pos, chr((97 + floor(('0x' || substr(md5('7:' || i), 1, 12))::BIGINT / 281474976710656.0 * 26))::INTEGER) AS token FROM (SELECT unnest(range(0, 5000)) AS i)")
def gen_uniform(spark, sf_dir):
    return generators.uniform(spark, 5000, 97, 122, seed=7)


@query("WITH w AS (SELECT unnest(range(1, 11)) AS k), c AS (SELECT k, sum(1.0::DOUBLE / k) OVER (ORDER BY k) / (SELECT sum(1.0::DOUBLE / k) FROM w) AS reach FROM w), u AS (SELECT i, ('0x' || substr(md5('3:' || i), 1, 12))::BIGINT / 281474976710656.0 AS u FROM (SELECT unnest(range(0, 5000)) AS i)) SELECT i AS pos, chr((40 + (SELECT count(*) FROM c WHERE k < 10 AND u.u >= reach))::INTEGER) AS token FROM u")
def gen_zipf(spark, sf_dir):
    return generators.zipf(spark, 5000, 10, 1.0, seed=3)


@query("SELECT i AS pos, substr('ABCDEFGHIKLMNOP', (((i // 64) % 15) + 1)::BIGINT, 1) AS token FROM (SELECT unnest(range(0, 5000)) AS i)")
def gen_blocks(spark, sf_dir):
    return generators.blocks(spark, 5000, 64, "ABCDEFGHIKLMNOP")


@query(f"SELECT i AS pos, substr('{generators.de_bruijn_cycle('0123', 6)}', (i % 4096 + 1)::BIGINT, 1) AS token FROM (SELECT unnest(range(0, 8192)) AS i)")
def gen_debruijn(spark, sf_dir):
    return generators.de_bruijn(spark, 8192, "0123", 6)


@query()
def gen_markov(spark, sf_dir):
    return generators.markov(spark, 64, 2000, generators.transition_matrix(12, 2, seed=5), seed=5)


# ---------------------------------------------------------------- grams and keys


@query("SELECT substr(x, i, 3) AS gram, count(*) AS n FROM (SELECT text AS x, unnest(range(1, length(text) - 1)) AS i FROM (" + TEXTS + ") WHERE length(text) >= 3) GROUP BY 1")
def ngrams_chars(spark, sf_dir):
    return _texts(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("(?s)(?=(.{3}))"), 1)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query(GRAMS)
def ngrams_tokens(spark, sf_dir):
    return _grams(spark, sf_dir)


@query(f"SELECT pid, k::BIGINT AS k, gram, 3::BIGINT AS m FROM ({PATTERN_GRAMS})")
def pattern_grams(spark, sf_dir):
    return _asked(spark, sf_dir)


@query(f"SELECT pid, k::BIGINT AS k, gram, 3::BIGINT AS m FROM ({PATTERN_GRAMS}) WHERE k % 2 = 0 OR k = 1")
def pattern_stride_grams(spark, sf_dir):
    return match.stride(_asked(spark, sf_dir), N)


@query(f"SELECT pid, i - 1 AS k, substr(pattern, i, 3) AS gram, length(pattern)::BIGINT AS m FROM (SELECT pid, pattern, unnest(range(1, length(pattern) - 1)) AS i FROM ({TEXT_PATTERNS}) WHERE length(pattern) >= 3)")
def pattern_char_grams(spark, sf_dir):
    return match.character_grams(_text_patterns(spark, sf_dir), 3)


@query(f"WITH g AS (SELECT DISTINCT gram FROM ({GRAMS})), b AS (SELECT least(greatest(1, ceil(log2(n * (n - 1.0) / (-2 * ln(1 - 0.0001)))))::BIGINT, 60) AS bits FROM (SELECT count(*) AS n FROM g)) SELECT gram, {HASH.format('gram')} >> (60 - bits) AS key, bits FROM g, b")
def gram_keys(spark, sf_dir):
    return keys.sized(_grams(spark, sf_dir), 0.0001)


@query("SELECT event_id, " + HASH.format("event_type || ':' || user_id") + " AS h FROM events")
def hash_ids(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", hashing.md5_long(F.concat_ws(":", "event_type", "user_id")).alias("h"))


@query("SELECT n, greatest(1, ceil(log2(n * (n - 1.0) / (-2 * ln(1 - 0.0001)))))::BIGINT AS bits, round(1 - exp(-(n * (n - 1.0)) / pow(2.0, 41)), 9) AS chance FROM (SELECT unnest([10, 1000, 100000, 1000000]) AS n)")
def hash_width(spark, sf_dir):
    n = F.col("n").cast("double")
    return spark.createDataFrame([(10,), (1000,), (100000,), (1000000,)], "n int").select("n", hashing.bits_for(n, F.lit(0.0001)).alias("bits"), F.round(hashing.collision_chance(n, F.lit(40)), 9).alias("chance"))


@query("SELECT token, row_number() OVER (ORDER BY first_at, token) AS id FROM (SELECT event_type AS token, min(event_id) AS first_at FROM events GROUP BY event_type)")
def dictionary_encode(spark, sf_dir):
    return keys.first_seen(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("SELECT user_id, event_type, dense_rank() OVER (PARTITION BY event_type ORDER BY n) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type)")
def rank_transform(spark, sf_dir):
    counted = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return keys.dense_ranks(counted, "event_type", "n").select("user_id", "event_type", "r")


@query("SELECT a.t AS t0, b.t AS t1, row_number() OVER (ORDER BY a.t, b.t) - 1 AS id FROM (SELECT DISTINCT event_type AS t FROM events) a, (SELECT DISTINCT event_type AS t FROM events) b")
def alphabet_product(spark, sf_dir):
    return keys.product(table(spark, sf_dir, "events").select(F.col("event_type").alias("token")))


@query("SELECT event_id, (user_id << 40 | event_id)::BIGINT AS packed, user_id AS first, event_id AS second FROM events")
def key_pack(spark, sf_dir):
    packed = table(spark, sf_dir, "events").select("event_id", keys.pack([F.col("user_id"), F.col("event_id")], [23, 40]).alias("packed"))
    first, second = keys.unpack(F.col("packed"), [23, 40])
    return packed.select("event_id", "packed", first.alias("first"), second.alias("second"))


@query(f"SELECT token, row, (((('0x' || substr(md5('a:7:' || row), 1, 15))::BIGINT % 2147483646 + 1)::HUGEINT * (('0x' || substr(md5(token), 1, 15))::BIGINT % 2147483647) + ('0x' || substr(md5('b:7:' || row), 1, 15))::BIGINT % 2147483646 + 1) % 2147483647 % 1000)::BIGINT AS bucket, (('0x' || substr(md5(token), 1, 15))::BIGINT >> 28)::BIGINT AS short FROM (SELECT DISTINCT event_type AS token FROM events), (SELECT unnest(range(0, 4)) AS row)")
def universal_hash(spark, sf_dir):
    tokens = table(spark, sf_dir, "events").select(F.col("event_type").alias("token")).distinct()
    each = F.array(*[F.struct(F.lit(r).cast("long").alias("row"), keys.universal(F.col("token"), r, 1000, seed=7).alias("bucket")) for r in range(4)])
    return tokens.select("token", keys.hashed(F.col("token"), 32).alias("short"), F.explode(each).alias("h")).select("token", "h.row", "h.bucket", "short")


@query("SELECT user_id, level, user_id >> (20 - level) AS interval FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest([4, 8, 12, 16]) AS level)")
def dyadic_interval(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", F.explode(F.array(*map(F.lit, (4, 8, 12, 16)))).alias("level")).select("user_id", "level", F.expr("shiftrightunsigned(user_id, 20 - level)").alias("interval"))


# ---------------------------------------------------------------- search


@query(TEXT_MATCHES)
def find_all_chars(spark, sf_dir):
    return match.find_all(_texts(spark, sf_dir), _text_patterns(spark, sf_dir))


@query(TEXT_MATCHES)
def find_all_scan(spark, sf_dir):
    return match.find_by_scan(_texts(spark, sf_dir), _text_patterns(spark, sf_dir))


@query(f"SELECT pid, count(*) AS n, count(DISTINCT stream_id) AS n_streams FROM ({TEXT_MATCHES}) GROUP BY pid")
def workload_counts(spark, sf_dir):
    return find_all_chars(spark, sf_dir).groupBy("pid").agg(F.count("*").alias("n"), F.countDistinct("stream_id").alias("n_streams"))


@query(f"SELECT pid, stream_id, ((length(text) - length(replace(text, pattern, ''))) // length(pattern))::BIGINT AS n FROM ({TEXTS}) JOIN ({TEXT_PATTERNS}) ON pattern <> '' AND contains(text, pattern)")
def find_nonoverlapping(spark, sf_dir):
    return match.count_apart(_texts(spark, sf_dir), _text_patterns(spark, sf_dir))


@query(f"SELECT DISTINCT pid FROM ({TEXT_MATCHES})")
def pattern_exists(spark, sf_dir):
    return _text_patterns(spark, sf_dir).join(find_all_chars(spark, sf_dir), "pid", "left_semi").select("pid")


@query(f"SELECT pid FROM (SELECT pid, pattern || '■' AS pattern FROM ({TEXT_PATTERNS})) p WHERE NOT EXISTS (SELECT 1 FROM ({TEXTS}) WHERE contains(text, pattern))")
def pattern_missing(spark, sf_dir):
    spoilt = _text_patterns(spark, sf_dir).select("pid", F.concat("pattern", F.lit("■")).alias("pattern"))
    return spoilt.join(match.find_all(_texts(spark, sf_dir), spoilt), "pid", "left_anti").select("pid")


@query(EVENT_MATCHES)
def find_all_tokens(spark, sf_dir):
    return _matches(spark, sf_dir)


@query(MIXED_MATCHES)
def find_mixed_tokens(spark, sf_dir):
    return match.find_tokens(_events(spark, sf_dir), _mixed_patterns(spark, sf_dir), N)


def _preset(name):
    def run(spark, sf_dir):
        return presets.preset(name, BLOCK, N).report(_events(spark, sf_dir), _mixed_patterns(spark, sf_dir))

    QUERIES[f"search_{name}"], ORACLE_SQL[f"search_{name}"] = run, MIXED_MATCHES


for _name in ("bs", "cp", "cgbs", "cf"):
    _preset(_name)


@query(MIXED_MATCHES)
def find_unbounded(spark, sf_dir):
    return suffix_array.find(_events(spark, sf_dir), _suffixes(spark, sf_dir), _mixed_patterns(spark, sf_dir))


@query(f"SELECT m.pid, m.stream_id, m.pos FROM ({EVENT_MATCHES}) m JOIN (SELECT stream_id, count(*) AS n FROM ({EVENT_STREAM}) GROUP BY 1) l USING (stream_id) WHERE pos >= greatest(n - {WINDOW}, 0) AND pos + 3 <= n")
def find_window_exact(spark, sf_dir):
    return match.find_tokens(match.last_tokens(_events(spark, sf_dir), match.first_kept_exact(F.col("n"), WINDOW)), _event_patterns(spark, sf_dir), N)


RETAINED = f"SELECT stream_id, n, greatest(CASE WHEN n - ((n - 1) // {BLOCK}) * {BLOCK} >= {WINDOW % BLOCK} + 2 THEN (n - 1) // {BLOCK} - {WINDOW // BLOCK} + 1 ELSE (n - 1) // {BLOCK} - {WINDOW // BLOCK} END, 0) * {BLOCK} AS kept FROM (SELECT stream_id, count(*) AS n FROM ({EVENT_STREAM}) GROUP BY 1)"


@query(f"SELECT m.pid, m.stream_id, m.pos FROM ({EVENT_MATCHES}) m JOIN ({RETAINED}) l USING (stream_id) WHERE pos >= kept AND pos + 3 <= n")
def retained_block_window(spark, sf_dir):
    return match.find_tokens(match.last_tokens(_events(spark, sf_dir), match.first_kept_block(F.col("n"), WINDOW, BLOCK)), _event_patterns(spark, sf_dir), N)


@query(f"SELECT pid, stream_id, pos FROM ({EVENT_MATCHES}) WHERE pos // {BLOCK} < (pos + 2) // {BLOCK}")
def find_boundary_crossing(spark, sf_dir):
    return match.crossing(_matches(spark, sf_dir), _event_patterns(spark, sf_dir), BLOCK)


@query(f"SELECT pid, stream_id, pos, row_number() OVER (PARTITION BY pid, stream_id ORDER BY pos) - 1 AS nth FROM (SELECT m.pid, m.stream_id, m.pos FROM ({EVENT_MATCHES}) m JOIN (SELECT stream_id, count(*) AS n FROM ({EVENT_STREAM}) GROUP BY 1) l USING (stream_id) WHERE pos >= greatest(n - {WINDOW}, 0) UNION SELECT pid, stream_id, pos FROM ({EVENT_MATCHES}) WHERE pos // {BLOCK} < (pos + 2) // {BLOCK})")
def merged_matches(spark, sf_dir):
    return match.merged(find_window_exact(spark, sf_dir), find_boundary_crossing(spark, sf_dir))


@query(f"SELECT count(*) AS in_first, 0::BIGINT AS only_first, 0::BIGINT AS only_second FROM ({TEXT_MATCHES})")
def result_diff(spark, sf_dir):
    a, b = find_all_chars(spark, sf_dir).withColumn("a", F.lit(1)), find_all_scan(spark, sf_dir).withColumn("b", F.lit(1))
    return a.join(b, ["pid", "stream_id", "pos"], "full").agg(F.count("a").alias("in_first"), F.count(F.when(F.col("b").isNull(), 1)).alias("only_first"), F.count(F.when(F.col("a").isNull(), 1)).alias("only_second"))


@query(f"SELECT stream_id, pos, count(*) OVER (PARTITION BY stream_id, token ORDER BY pos RANGE BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS n FROM ({EVENT_STREAM})")
def sliding_token_count(spark, sf_dir):
    return _events(spark, sf_dir).select("stream_id", "pos", F.count("*").over(Window.partitionBy("stream_id", "token").orderBy("pos").rangeBetween(1 - WINDOW, 0)).alias("n"))


LOADS = f"SELECT stream_id, unnest(range(1, n // {WINDOW} + 1)) AS load FROM (SELECT stream_id, count(*) AS n FROM ({EVENT_STREAM}) GROUP BY 1)"


@query(f"SELECT l.stream_id, l.load, count(*) AS n FROM ({LOADS}) l JOIN ({EVENT_MATCHES}) m ON m.stream_id = l.stream_id AND m.pos + 3 <= l.load * {WINDOW} AND m.pos >= (l.load - 1) * {WINDOW} GROUP BY 1, 2")
def tumbling_query_loads(spark, sf_dir):
    loads = match.lengths(_events(spark, sf_dir)).where(F.col("n") >= WINDOW).select("stream_id", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("n") / WINDOW))).alias("load"))
    found = _matches(spark, sf_dir).withColumn("load", F.floor(F.col("pos") / WINDOW) + 1).where(F.col("pos") + 3 <= F.col("load") * WINDOW)
    return found.join(loads, ["stream_id", "load"]).groupBy("stream_id", "load").agg(F.count("*").alias("n"))


@query(f"SELECT m.pid, m.stream_id, m.pos, CASE WHEN len(p.tokens) <= {BLOCK // 4} THEN m.pos + len(p.tokens) ELSE ceil((m.pos + len(p.tokens)) / {BLOCK / 2})::BIGINT * {BLOCK // 2} END::BIGINT AS known_at FROM ({MIXED_MATCHES}) m JOIN ({MIXED_PATTERNS}) p USING (pid)")
def find_delayed_batches(spark, sf_dir):
    patterns = _mixed_patterns(spark, sf_dir)
    return loads.delayed(match.find_tokens(_events(spark, sf_dir), patterns, N), patterns, BLOCK)


@query(f"SELECT stream_id, b AS level, 1::BIGINT << b AS size FROM (SELECT stream_id, count(*) AS n FROM ({EVENT_STREAM}) GROUP BY 1), (SELECT unnest(range(0, 62))::INTEGER AS b) WHERE (n >> b) & 1 = 1")
def lsm_segments(spark, sf_dir):
    sized = match.lengths(_events(spark, sf_dir)).select("stream_id", "n", F.explode(F.sequence(F.lit(0), F.lit(61))).alias("level"))
    return sized.where(F.expr("shiftright(n, level) & 1 = 1")).select("stream_id", "level", F.expr("shiftleft(1L, level)").alias("size"))


# ---------------------------------------------------------------- hierarchy


@query(f"SELECT level::BIGINT AS level, ({BLOCK} >> level)::BIGINT AS span, (1 << level)::BIGINT AS intervals FROM (SELECT unnest(range(0, 4))::INTEGER AS level)")
def dyadic_levels(spark, sf_dir):
    return spark.createDataFrame([(l, s, 1 << l) for l, s in hierarchy.levels(BLOCK, N)], "level long, span long, intervals long")


def _members(spark, sf_dir):
    return hierarchy.members(_grams(spark, sf_dir), BLOCK, N)


@query(MEMBERS)
def interval_members(spark, sf_dir):
    return _members(spark, sf_dir)


AT = f"SELECT p.pid, p.k, m.stream_id, m.block, m.level, m.interval FROM ({MEMBERS}) m JOIN ({PATTERN_GRAMS}) p USING (gram)"
RANGES = f"SELECT a.pid, a.stream_id, CASE WHEN b.pid IS NULL THEN a.block * {BLOCK} + a.interval * 4 + 3 ELSE a.block * {BLOCK} + a.interval * 4 END AS lo, a.block * {BLOCK} + a.interval * 4 + 3 AS hi FROM (SELECT * FROM ({AT}) WHERE level = 2 AND k = 0) a LEFT JOIN (SELECT * FROM ({AT}) WHERE level = 2 AND k = 1) b ON a.pid = b.pid AND a.stream_id = b.stream_id AND a.block = b.block AND a.interval = b.interval"


def _ranges(spark, sf_dir, plan):
    asked = cut(hierarchy.with_levels(_asked(spark, sf_dir), plan))
    return hierarchy.candidates(cut(_members(spark, sf_dir)), asked, BLOCK, N)


@query(RANGES)
def block_candidates(spark, sf_dir):
    return _ranges(spark, sf_dir, levels.Fixed(2).levels(_asked(spark, sf_dir)))[0]


@query(RANGES)
def block_candidates_cgbs(spark, sf_dir):
    # the second gram is probed from level 2 on only, where the first level's intervals have been halved
    return _ranges(spark, sf_dir, _asked(spark, sf_dir).select("pid", "k", (F.col("k") + 1).alias("level")))[0]


@query(EVENT_MATCHES)
def verify_candidates(spark, sf_dir):
    return hierarchy.verify(_events(spark, sf_dir), _event_patterns(spark, sf_dir), block_candidates(spark, sf_dir))


@query(f"""WITH placed AS MATERIALIZED ({AT}), a0 AS (SELECT * FROM placed WHERE k = 0), whole AS (SELECT a.pid, a.stream_id, a.block, a.level, a.interval FROM a0 a JOIN placed b USING (pid, stream_id, block, level, interval) WHERE b.k = 1),
nodes AS (SELECT 0 AS level, (SELECT count(*) FROM ({EVENT_PATTERNS})) * (SELECT count(*) FROM (SELECT DISTINCT stream_id, block FROM ({MEMBERS}))) AS n UNION ALL SELECT level + 1, 2 * count(*) FROM whole WHERE level < 2 GROUP BY level UNION ALL SELECT 3, 0),
hits AS (SELECT level, count(*) AS n FROM a0 WHERE level = 0 GROUP BY level UNION ALL SELECT a.level, count(*) FROM a0 a JOIN whole w ON w.pid = a.pid AND w.stream_id = a.stream_id AND w.block = a.block AND w.level = a.level - 1 AND w.interval = a.interval // 2 WHERE a.level IN (1, 2) GROUP BY a.level)
SELECT level::BIGINT AS level, nodes.n::BIGINT AS nodes, (nodes.n + coalesce(hits.n, 0))::BIGINT AS probes FROM nodes LEFT JOIN hits USING (level)""")
def probe_histogram(spark, sf_dir):
    return _ranges(spark, sf_dir, levels.Root().levels(_asked(spark, sf_dir)))[1]


@query("SELECT n, p, ceil(-n * ln(p) / (ln(2) * ln(2)))::BIGINT AS m, greatest(1, round(ceil(-n * ln(p) / (ln(2) * ln(2))) / n * ln(2)))::BIGINT AS k FROM (SELECT unnest([100, 1000, 100000]) AS n), (SELECT unnest([0.01::DOUBLE, 0.15::DOUBLE]) AS p)")
def bloom_sizing(spark, sf_dir):
    grid = spark.createDataFrame([(n, p) for n in (100, 1000, 100000) for p in (0.01, 0.15)], "n int, p double")
    m = F.ceil(-F.col("n") * F.ln("p") / (F.ln(F.lit(2.0)) ** 2))
    return grid.select("n", "p", m.cast("long").alias("m"), F.greatest(F.lit(1), F.round(m / F.col("n") * F.ln(F.lit(2.0)))).cast("long").alias("k"))


@query(f"SELECT level::BIGINT AS level, ((1 << level) * least(25, {BLOCK} >> level))::BIGINT AS keys FROM (SELECT unnest(range(0, 4))::INTEGER AS level)")
def bloom_memory(spark, sf_dir):
    return dyadic_levels(spark, sf_dir).select("level", (F.col("intervals") * F.least(F.lit(25).cast("long"), F.col("span"))).alias("keys"))


BITS = f"SELECT DISTINCT stream_id, (h % 512 + ((h // 512) % 511 + 1) * k) % 512 AS place FROM (SELECT stream_id, {HASH.format('gram')} AS h FROM ({GRAMS})), (SELECT unnest(range(0, 4)) AS k)"


def _filters(spark, sf_dir):
    return hierarchy.bloom_build(_grams(spark, sf_dir), "stream_id", 512, 4)


@query(f"SELECT stream_id, 1::BIGINT AS bucket, count(*) AS ones FROM ({BITS}) GROUP BY stream_id")
def bloom_build(spark, sf_dir):
    return _filters(spark, sf_dir).select("stream_id", "bucket", F.bitmap_count("bitmap").alias("ones"))


@query(f"WITH bits AS MATERIALIZED ({BITS}), asked AS (SELECT DISTINCT gram, (h % 512 + ((h // 512) % 511 + 1) * k) % 512 AS place FROM (SELECT gram, {HASH.format('gram')} AS h FROM (SELECT DISTINCT gram FROM ({PATTERN_GRAMS}))), (SELECT unnest(range(0, 4)) AS k)) SELECT stream_id, gram FROM asked a JOIN bits b USING (place) GROUP BY stream_id, gram HAVING count(*) = (SELECT count(*) FROM asked x WHERE x.gram = a.gram)")
def bloom_probe(spark, sf_dir):
    return hierarchy.bloom_probe(_filters(spark, sf_dir), "stream_id", _asked(spark, sf_dir).select("gram").distinct(), 512, 4)


@query(f"SELECT stream_id, round(pow(ones / 512.0::DOUBLE, 4), 9) AS false_positives, round(-512 / 4 * ln(1 - least(ones / 512.0::DOUBLE, 0.999)), 6) AS distinct_keys FROM (SELECT stream_id, count(*) AS ones FROM ({BITS}) GROUP BY stream_id)")
def bloom_occupancy(spark, sf_dir):
    share = F.col("ones") / 512
    return bloom_build(spark, sf_dir).select("stream_id", F.round(F.pow(share, F.lit(4)), 9).alias("false_positives"), F.round(-512 / 4 * F.ln(1 - F.least(share, F.lit(0.999))), 6).alias("distinct_keys"))


@query("SELECT level::BIGINT AS level, least(5::BIGINT * 5, 1024 >> level) AS alphabet, ((1 << level) * least(5 * 5, 1024 >> level))::BIGINT AS keys FROM (SELECT unnest(range(0, 9))::INTEGER AS level)")
def filter_keys(spark, sf_dir):
    return spark.createDataFrame([(l, probability.alphabet_size(5, 2, s), (1 << l) * probability.alphabet_size(5, 2, s)) for l, s in hierarchy.levels(1024, 4)], "level long, alphabet long, keys long")


# ---------------------------------------------------------------- frequencies and sketches

WORDS = "SELECT unnest(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS token FROM documents"
WORD_COUNTS = f"SELECT token, count(*) AS n FROM ({WORDS}) GROUP BY token"


def _words(spark, sf_dir):
    return streams.words(table(spark, sf_dir, "documents"))


@query(f"SELECT token, n, round(n / (SELECT sum(n) FROM ({WORD_COUNTS})), 9) AS share FROM ({WORD_COUNTS})")
def token_freq(spark, sf_dir):
    return sketches.frequencies(_words(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query(f"SELECT 0.05::DOUBLE AS q, quantile_disc(n, 0.05) AS n FROM ({WORD_COUNTS}) UNION ALL SELECT 0.5::DOUBLE, quantile_disc(n, 0.5) FROM ({WORD_COUNTS}) UNION ALL SELECT 0.95::DOUBLE, quantile_disc(n, 0.95) FROM ({WORD_COUNTS})")
def freq_quantile(spark, sf_dir):
    counts = _words(spark, sf_dir).groupBy("token").agg(F.count("*").alias("n"))
    row = counts.agg(*[F.expr(f"percentile_disc({q}) within group (order by n)").cast("long").alias(f"q{k}") for k, q in enumerate((0.05, 0.5, 0.95))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"q{k}").alias("n")) for k, q in enumerate((0.05, 0.5, 0.95))])).alias("s")).select("s.*")


@query(f"SELECT n, count(*) AS tokens, round(sum(count(*)) OVER (ORDER BY n) / sum(count(*)) OVER (), 9) AS cdf FROM ({WORD_COUNTS}) GROUP BY n")
def freq_cdf(spark, sf_dir):
    # the window runs over distinct frequencies, which are few however many words there are
    counts = _words(spark, sf_dir).groupBy("token").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("tokens"))
    return counts.select("n", "tokens", F.round(F.sum("tokens").over(Window.orderBy("n")) / F.sum("tokens").over(Window.partitionBy()), 9).alias("cdf"))


SAMPLE = f"SELECT bucket, arg_min(token, (priority, token)) AS token FROM (SELECT DISTINCT token, {HASH.format(chr(39) + 'b:' + chr(39) + ' || token')} % 256 AS bucket, {HASH.format(chr(39) + 'p:' + chr(39) + ' || token')} AS priority FROM ({WORDS})) GROUP BY bucket"


@query(SAMPLE)
def hops_sample(spark, sf_dir):
    return sketches.bucket_sample(_words(spark, sf_dir), 256)


@query(f"SELECT token, n FROM (SELECT token, n, row_number() OVER (ORDER BY n, token) AS r, count(*) OVER () AS size FROM ({SAMPLE}) JOIN ({WORD_COUNTS}) USING (token)) WHERE r = greatest(1, ceil(0.95 * size))")
def hops_quantile(spark, sf_dir):
    counts = cut(_words(spark, sf_dir).groupBy("token").agg(F.count("*").alias("n")))
    return sketches.sample_quantile(sketches.bucket_sample(counts, 256).select("token"), counts, 0.95)


@query(f"SELECT DISTINCT token, {HASH.format(chr(39) + 'p:' + chr(39) + ' || token')} AS priority FROM ({WORDS}) ORDER BY priority, token LIMIT 100")
def bottom_k(spark, sf_dir):
    return sketches.bottom_k(_words(spark, sf_dir), 100)


COUNTS5 = f"SELECT token, n, r FROM (SELECT token, count(*) AS n FROM ({EVENT_STREAM}) GROUP BY token), (SELECT unnest(range(0, 5)) AS r)"
SKETCH = f"SELECT token, n, r, {HASH.format(chr(39) + 'b:' + chr(39) + ' || r || ' + chr(39) + ':' + chr(39) + ' || token')} % 64 AS bucket, CASE WHEN {HASH.format(chr(39) + 's:' + chr(39) + ' || r || ' + chr(39) + ':' + chr(39) + ' || token')} % 2 = 0 THEN 1 ELSE -1 END AS sign FROM ({COUNTS5})"


@query(f"WITH s AS ({SKETCH}), v AS (SELECT r, bucket, sum(n * sign) AS value FROM s GROUP BY r, bucket) SELECT token, list_sort(list((value * sign)::BIGINT))[3] AS estimate FROM s JOIN v USING (r, bucket) GROUP BY token")
def count_sketch_estimate(spark, sf_dir):
    stream = _events(spark, sf_dir)
    return sketches.sketch_estimates(sketches.count_sketch(stream, 64, 5), stream.select("token").distinct(), 64, 5)


TRIALS = f"""WITH c AS MATERIALIZED ({WORD_COUNTS}), t AS (SELECT unnest(range(0, 4)) AS trial),
s AS (SELECT trial, arg_min(n, (priority, token)) AS n FROM (SELECT trial, token, n, {HASH.format("'b' || trial || ':' || token")} % 512 AS bucket, {HASH.format("'p' || trial || ':' || token")} AS priority FROM c, t) GROUP BY trial, bucket),
f AS (SELECT trial, count(*) AS sampled, quantile_disc(n, 0.9) AS n FROM s GROUP BY trial)
SELECT trial, sampled, n, truth, round(abs(n - truth) / greatest(truth, 1), 9) AS value_error, round(greatest(low - 0.9, 0.9 - high, 0), 9) AS rank_error, round(sqrt(ln(2 / 0.05) / (2 * sampled)), 9) AS band, greatest(low - 0.9, 0.9 - high, 0) <= sqrt(ln(2 / 0.05) / (2 * sampled)) AS success
FROM (SELECT *, (SELECT quantile_disc(n, 0.9) FROM c) AS truth, (SELECT count(*) FROM c WHERE c.n < f.n) / (SELECT count(*) FROM c)::DOUBLE AS low, (SELECT count(*) FROM c WHERE c.n <= f.n) / (SELECT count(*) FROM c)::DOUBLE AS high FROM f)"""


@query(TRIALS)
def sampling_report(spark, sf_dir):
    counts = cut(_words(spark, sf_dir).groupBy("token").agg(F.count("*").alias("n")))
    samples = [sketches.seeded_sample(counts, [], 512, str(t)).select(F.lit(t).cast("long").alias("trial"), "token") for t in range(4)]
    sampled = reduce(DataFrame.unionByName, samples).join(counts, "token")
    found = sketches.nearest_rank(sampled, ["trial"], "n", 0.9).join(sampled.groupBy("trial").agg(F.count("*").alias("sampled")), "trial")
    band = probability.dkw_band(F.col("sampled").cast("double"), F.lit(0.05))
    judged = sketches.rank_errors(found, counts, 0.9)
    return judged.select("trial", "sampled", "n", "truth", F.round("value_error", 9).alias("value_error"), F.round("rank_error", 9).alias("rank_error"), F.round(band, 9).alias("band"), (F.col("rank_error") <= band).alias("success"))


@query(f"SELECT (sampled > 0) AS sampled, count(*) AS trials, round(avg(value_error), 6) AS mean_value_error, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM ({TRIALS}) GROUP BY 1")
def sampling_summary(spark, sf_dir):
    return reports.trials(sampling_report(spark, sf_dir).withColumn("sampled", F.col("sampled") > 0), ["sampled"], "value_error", ["success"])


OCCUPIED = "b * (1 - pow(1 - 1.0::DOUBLE / b, {d}))"
SPREAD = "greatest(b * (1 - pow(1 - 1.0::DOUBLE / b, {d})) * pow(1 - 1.0::DOUBLE / b, {d}) + b * (b - 1.0) * (1 - 2 * pow(1 - 1.0::DOUBLE / b, {d}) + pow(1 - 2.0::DOUBLE / b, {d}) - pow(1 - pow(1 - 1.0::DOUBLE / b, {d}), 2)), 0)"


@query(f"WITH g AS (SELECT eps, delta, ceil(ln(2 / delta) / (2 * eps * eps))::BIGINT AS needed FROM (SELECT unnest([0.025::DOUBLE, 0.05::DOUBLE]) AS eps), (SELECT unnest([0.05::DOUBLE, 0.01::DOUBLE]) AS delta)), "
       f"b AS (SELECT delta, b, floor(greatest({OCCUPIED.format(d=20000)} - sqrt({SPREAD.format(d=20000)} / delta), 0))::BIGINT AS at_least, {OCCUPIED.format(d=20000)} AS mean, {SPREAD.format(d=20000)} AS var FROM (SELECT unnest(range(1, 20000))::DOUBLE AS b), (SELECT unnest([0.05::DOUBLE, 0.01::DOUBLE]) AS delta)) "
       "SELECT eps, delta, needed, min(b)::BIGINT AS buckets, round(arg_min(mean, b), 4) AS mean, round(arg_min(var, b), 3) AS variance, arg_min(at_least, b) AS at_least FROM g JOIN b USING (delta) WHERE at_least >= needed GROUP BY ALL")
def hops_design(spark, sf_dir):
    grid = spark.createDataFrame([(e, d) for e in (0.025, 0.05) for d in (0.05, 0.01)], "eps double, delta double").withColumn("needed", probability.draws_needed(F.col("eps"), F.col("delta")))
    keys_ = F.lit(20000.0)
    sized = grid.withColumn("buckets", probability.buckets_needed(keys_, F.col("needed"), F.col("delta")))
    b = F.col("buckets").cast("double")
    return sized.select("eps", "delta", "needed", "buckets", F.round(probability.occupied(b, keys_), 4).alias("mean"), F.round(probability.occupied_variance(b, keys_), 3).alias("variance"), probability.occupied_at_least(b, keys_, F.col("delta")).alias("at_least"))


@query("SELECT token, n, round(estimate / total, 9) AS p FROM (SELECT token, n, sum(n) OVER () AS total, n AS estimate FROM (SELECT event_type AS token, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1))")
def sketched_shares(spark, sf_dir):
    # five tokens in 2048 buckets of 9 rows: the sketch has their counts
    tokens = _events(spark, sf_dir).select(F.col("token").alias("key"))
    counted = tokens.groupBy("key").agg(F.count("*").alias("n"))
    return presets.Sketched(2048, 9).estimate(tokens, counted.select("key")).join(counted, "key").select(F.col("key").alias("token"), "n", F.round("p", 9).alias("p"))


# ---------------------------------------------------------------- Markov models

BACK = f"SELECT stream_id, pos, token, lag(token, 1) OVER w AS b1, lag(token, 2) OVER w AS b2 FROM ({EVENT_STREAM}) WINDOW w AS (PARTITION BY stream_id ORDER BY pos)"


def _model(spark, sf_dir, order):
    return model.build(_events(spark, sf_dir), order)


@query(f"SELECT token, count(*) AS n, round(count(*) / (SELECT count(*) FROM ({EVENT_STREAM})), 9) AS p FROM ({EVENT_STREAM}) GROUP BY token")
def markov_unigram(spark, sf_dir):
    return _model(spark, sf_dir, 1).select("token", "n", F.round("p", 9).alias("p"))


@query(f"SELECT b1 AS before_token, token, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY b1), 9) AS p FROM ({BACK}) WHERE b1 IS NOT NULL GROUP BY 1, 2")
def markov_transitions(spark, sf_dir):
    return model.first_order(_model(spark, sf_dir, 2)).withColumn("p", F.round("p", 9))


@query(f"SELECT length, context, token, n, round(n / sum(n) OVER (PARTITION BY length, context), 9) AS p FROM (SELECT 0::BIGINT AS length, '' AS context, token, count(*) AS n FROM ({BACK}) GROUP BY token UNION ALL SELECT 1, b1, token, count(*) FROM ({BACK}) WHERE b1 IS NOT NULL GROUP BY ALL UNION ALL SELECT 2, b2 || chr(1) || b1, token, count(*) FROM ({BACK}) WHERE b2 IS NOT NULL GROUP BY ALL)")
def markov_model(spark, sf_dir):
    return _model(spark, sf_dir, 3).withColumn("p", F.round("p", 9))


#: A model of the streams of even numbers meets the others, so that contexts are missing and back-off is used.
LEARNT = f"SELECT * FROM ({BACK}) WHERE stream_id % 2 = 0 AND stream_id < 8"


@query(f"""WITH l AS MATERIALIZED ({LEARNT}), c2 AS (SELECT b2, b1, count(*) AS n FROM l WHERE b2 IS NOT NULL GROUP BY ALL), n2 AS (SELECT b2, b1, token, count(*) AS n FROM l WHERE b2 IS NOT NULL GROUP BY ALL),
c1 AS (SELECT b1, count(*) AS n FROM l WHERE b1 IS NOT NULL GROUP BY ALL), n1 AS (SELECT b1, token, count(*) AS n FROM l WHERE b1 IS NOT NULL GROUP BY ALL), n0 AS (SELECT token, count(*) / (SELECT count(*) FROM l) AS p FROM l GROUP BY token)
SELECT s.stream_id AS seq_id, s.pos, s.token, round(CASE WHEN n0.p IS NULL THEN 0 WHEN c2.n IS NOT NULL THEN coalesce(n2.n, 0) / c2.n WHEN c1.n IS NOT NULL THEN coalesce(n1.n, 0) / c1.n ELSE n0.p END, 9) AS p
FROM ({BACK}) s LEFT JOIN c2 ON c2.b2 = s.b2 AND c2.b1 = s.b1 LEFT JOIN n2 ON n2.b2 = s.b2 AND n2.b1 = s.b1 AND n2.token = s.token LEFT JOIN c1 ON c1.b1 = s.b1 LEFT JOIN n1 ON n1.b1 = s.b1 AND n1.token = s.token LEFT JOIN n0 ON n0.token = s.token""")
def markov_sequence_prob(spark, sf_dir):
    stream = _events(spark, sf_dir)
    learnt = model.build(stream.where("stream_id % 2 = 0 and stream_id < 8"), 3)
    return model.conditional(stream.withColumnRenamed("stream_id", "seq_id"), learnt, 3).withColumn("p", F.round("p", 9))


# ---------------------------------------------------------------- pruning model

FREQ = f"SELECT token, count(*) / (SELECT count(*) FROM events)::DOUBLE AS p FROM ({EVENT_STREAM}) GROUP BY token"


def _freq(spark, sf_dir):
    return sketches.frequencies(_events(spark, sf_dir)).select("token", F.col("share").alias("p"))


@query(f"SELECT token, level::BIGINT AS level, round(h, 6) AS h, round(h + 0.15 * (1 - h), 6) AS q, round(1 - pow(1 - p, (1024 >> level) - 1), 6) AS besides, CASE WHEN level > 0 THEN round(0.15 + 0.85 * h / (0.15 + 0.85 * up), 6) END AS below, CASE WHEN level > 0 THEN round((h + 0.15 * (up - h) + 0.15 * 0.15 * (1 - up)) / (0.15 + 0.85 * up), 6) END AS child FROM (SELECT *, 1 - pow(1 - p, 1024 >> level) AS h, 1 - pow(1 - p, 1024 >> greatest(level - 1, 0)) AS up FROM ({FREQ}), (SELECT unnest(range(0, 8))::INTEGER AS level))")
def level_probs(spark, sf_dir):
    level, p = F.col("level"), F.col("p")
    each = _freq(spark, sf_dir).select("token", "p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("level"))
    h, up = probability.hit(1024, level, p), probability.hit(1024, level - 1, p)
    child = F.get(probability.said_at_child(F.array(p), 1024, level, 0.15, 0.15), F.lit(0))
    return each.select("token", "level", F.round(h, 6).alias("h"), F.round(probability.said(h, 0.15), 6).alias("q"), F.round(probability.hit(1024, level, p, 1), 6).alias("besides"), F.when(level > 0, F.round(probability.said_below(h, probability.said(up, 0.15), 0.15), 6)).alias("below"), F.when(level > 0, F.round(child, 6)).alias("child"))


def _token_arrays(spark, sf_dir):
    """(pid, keys, p): the patterns' tokens and their frequencies."""
    tokens = _event_patterns(spark, sf_dir).select("pid", F.posexplode("tokens").alias("k", "gram")).join(_freq(spark, sf_dir).withColumnRenamed("token", "gram"), "gram")
    return tokens.withColumns({"m": F.lit(3).cast("long"), "k": F.col("k").cast("long")}).select("pid", "k", "gram", "m", "p")


PRICED = f"SELECT x.pid, t0, t1, t2, a.p AS p0, b.p AS p1, c.p AS p2 FROM ({EVENT_PATTERNS}) x JOIN ({FREQ}) a ON a.token = t0 JOIN ({FREQ}) b ON b.token = t1 JOIN ({FREQ}) c ON c.token = t2"


@query(f"SELECT pid, round(1 + q0 + q0 * q1, 6) AS probes, round(q0 * q1 * q2, 6) AS yes FROM (SELECT pid, 1 - pow(1 - p0, 16) AS q0, CASE WHEN t1 = t0 THEN 1 ELSE 1 - pow(1 - p1, 16) END AS q1, CASE WHEN t2 IN (t0, t1) THEN 1 ELSE 1 - pow(1 - p2, 16) END AS q2 FROM ({PRICED}))")
def expected_probes(spark, sf_dir):
    order = F.array_sort(F.collect_list(F.struct("k", "gram", "p")))
    q = _token_arrays(spark, sf_dir).groupBy("pid").agg(order.alias("s")).select("pid", F.transform("s", lambda s: s["gram"]).alias("keys"), F.transform("s", lambda s: 1 - F.pow(1 - s["p"], F.lit(16.0))).alias("q"))
    return q.select("pid", F.round(probability.expected_probes(F.col("q"), F.col("keys")), 6).alias("probes"), F.round(probability.all_yes(F.col("q"), F.col("keys")), 6).alias("yes"))


def _independent_sql(first: int) -> str:
    """Expected probes of three tokens from a level on, in blocks of BLOCK tokens, filters that err at 0.15."""
    def yes(level, i, child):
        h, up = f"(1 - pow(1 - p{i}, {BLOCK >> level}))", f"(1 - pow(1 - p{i}, {BLOCK >> max(level - 1, 0)}))"
        return f"(({h} + 0.15 * ({up} - {h}) + 0.0225 * (1 - {up})) / (0.15 + 0.85 * {up}))" if child else f"(0.15 + 0.85 * {h})"

    def node(level, child):
        q0 = yes(level, 0, child)
        q1, q2 = f"(CASE WHEN t1 = t0 THEN 1 ELSE {yes(level, 1, child)} END)", f"(CASE WHEN t2 IN (t0, t1) THEN 1 ELSE {yes(level, 2, child)} END)"
        return (f"(1 + {q0} + {q0} * {q1})", f"({q0} * {q1} * {q2})") if BLOCK >> level >= 3 else (f"(1 + {q0})", f"({q0} * {q1})")

    probes, present = node(first, False)
    nodes, total = f"{1 << first}.0", f"{1 << first} * {probes}"
    for level in range(first, 2):  # three tokens fit intervals of four
        nodes = f"({nodes} * 2 * {present})"
        probes, present = node(level + 1, True)
        total += f" + {nodes} * {probes}"
    return total


@query(" UNION ALL ".join(f"SELECT pid, {level}::BIGINT AS level, round({_independent_sql(level)}, 5) AS cost FROM ({PRICED})" for level in range(3)))
def level_costs(spark, sf_dir):
    order = F.array_sort(F.collect_list(F.struct("k", "gram", "p")))
    arrays = _token_arrays(spark, sf_dir).groupBy("pid").agg(order.alias("s")).select("pid", F.transform("s", lambda s: s["gram"]).alias("keys"), F.transform("s", lambda s: s["p"]).alias("p"))
    price = costs.Independent(0.15)
    each = F.array(*[F.struct(F.lit(l).cast("long").alias("level"), price.cost(F.col("p"), F.col("keys"), BLOCK, l).alias("cost")) for l in range(3)])
    return arrays.select("pid", F.explode(each).alias("s")).select("pid", "s.level", F.round("s.cost", 5).alias("cost"))


PLAIN_LEVEL = "least(ceil(ln(1024 / (ln(1 - 0.99) / ln(1 - p)))), 9)"


@query(f"SELECT token, greatest(CASE WHEN {PLAIN_LEVEL} > 0 THEN {PLAIN_LEVEL} + 1 ELSE {PLAIN_LEVEL} END, 0)::BIGINT AS plain, least(greatest(ceil(ln(1024 / ((ln(1 - 0.99) - ln(1 - 0.15)) / ln(1 - p)))) + 1, 0), 10)::BIGINT AS filtered FROM ({FREQ})")
def pruning_level(spark, sf_dir):
    return _freq(spark, sf_dir).select("token", probability.pruning_level(1024, 0.99, F.col("p")).alias("plain"), probability.pruning_level_filtered(1024, 0.99, F.col("p"), 0.15).alias("filtered"))


COSTS = f"SELECT token, level, (1 << level) * 97.0 + (1 << level) * (1 - pow(1 - p, 1024 >> level)) * (1024 >> level) * 26.0 AS cost FROM ({FREQ}), (SELECT unnest(range(0, 10))::INTEGER AS level)"


@query(f"SELECT token, arg_min(level, (cost, level))::BIGINT AS level, round(min(cost), 4) AS cost FROM ({COSTS}) GROUP BY token")
def choose_level(spark, sf_dir):
    levels = _freq(spark, sf_dir).select("token", "p", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("level"))
    nodes, span = F.expr("cast(shiftleft(1, level) as double)"), F.expr("cast(shiftright(1024, level) as double)")
    cost = nodes * 97.0 + nodes * (1 - F.pow(1 - F.col("p"), span)) * span * 26.0
    return levels.select("token", "level", cost.alias("cost")).groupBy("token").agg(F.min(F.struct("cost", "level")).alias("best")).select("token", F.col("best.level").cast("long").alias("level"), F.round("best.cost", 4).alias("cost"))


POLICY = f"""WITH t AS MATERIALIZED (SELECT stream_id, pos // {BLOCK} AS block, token, count(*) AS n FROM ({EVENT_STREAM}) GROUP BY ALL),
s AS (SELECT stream_id, block, arg_min(n, (priority, token)) AS n FROM (SELECT *, {HASH.format("'b:' || token")} % 4 AS bucket, {HASH.format("'p:' || token")} AS priority FROM t) GROUP BY stream_id, block, bucket),
q AS (SELECT stream_id, block, quantile_disc(n, 0.05) AS n FROM s GROUP BY stream_id, block),
o AS (SELECT stream_id, block, CASE WHEN p >= 1 THEN 0 ELSE least(greatest(ceil(ln({BLOCK} / ((ln(1 - 0.99) - ln(1 - 0.15)) / ln(1 - p)))) + 1, 0), 4) END::BIGINT AS dropped FROM (SELECT stream_id, block, q.n / sum(t.n)::DOUBLE AS p FROM q JOIN t USING (stream_id, block) GROUP BY stream_id, block, q.n))"""


def _policy(spark, sf_dir, predictive):
    return hierarchy.policy_levels(match.ngrams(_events(spark, sf_dir), 1), BLOCK, 0.99, 0.15, 4, predictive=predictive)


@query(f"{POLICY} SELECT * FROM o")
def memory_policy_levels(spark, sf_dir):
    return _policy(spark, sf_dir, False)


@query(f"{POLICY} SELECT stream_id, block, greatest(dropped, least(coalesce(lag(dropped) OVER (PARTITION BY stream_id ORDER BY block), 0), 4))::BIGINT AS dropped FROM o")
def memory_policy_predictive(spark, sf_dir):
    return _policy(spark, sf_dir, True)


@query(f"{POLICY}, m AS (SELECT DISTINCT stream_id, pos // {BLOCK} AS block, level::BIGINT AS level, (pos % {BLOCK}) // ({BLOCK} >> level) AS interval, token FROM ({EVENT_STREAM}), (SELECT unnest(range(0, 5))::INTEGER AS level)) SELECT m.level, count(*) AS keys FROM m JOIN o USING (stream_id, block) WHERE m.level >= o.dropped GROUP BY m.level")
def levels_left(spark, sf_dir):
    grams = match.ngrams(_events(spark, sf_dir), 1)
    held = hierarchy.drop_levels(hierarchy.members(grams, BLOCK, 1), memory_policy_levels(spark, sf_dir))
    return held.groupBy("level").agg(F.count("*").alias("keys"))


@query("""WITH RECURSIVE x AS (SELECT i AS id, list_transform(range(1, 6), lambda k: 0.1 + 0.15 * (('0x' || substr(md5(i || ':' || k), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)) AS p FROM (SELECT unnest(range(0, 100)) AS i)),
r AS (SELECT id, p, 0 AS i, 0.0::DOUBLE AS low, 1e6::DOUBLE AS high FROM x UNION ALL SELECT id, p, i + 1, CASE WHEN v < 0.99 THEN mid ELSE low END, CASE WHEN v < 0.99 THEN high ELSE mid END FROM (SELECT *, (low + high) / 2 AS mid, list_product(list_transform(p, lambda y: 1 - pow(1 - y, (low + high) / 2))) AS v FROM r WHERE i < 80))
SELECT id, round((low + high) / 2, 6) AS b, round(list_product(list_transform(p, lambda y: 1 - pow(1 - y, (low + high) / 2))), 6) AS product FROM r WHERE i = 80""")
def solve_b(spark, sf_dir):
    p = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: 0.1 + 0.15 * hashing.unit(F.concat_ws(":", "id", k.cast("string"))))
    solved = spark.range(100).withColumn("p", p).withColumn("b", costs.Bisection().solve(F.col("p"), 0.99))
    return solved.select("id", F.round("b", 6).alias("b"), F.round(F.aggregate("p", F.lit(1.0), lambda a, x: a * (1 - F.pow(1 - x, F.col("b")))), 6).alias("product"))


def _subsets_sql(places: int) -> str:
    """Chances that the first one, two, three distinct of d0, d1, d2 (null where there is none) are all in so many places."""
    power = lambda x: f"pow(greatest(1 - ({x}), 0), {places})"
    one, two = f"1 - {power('d0')}", f"1 - {power('d0')} - {power('d1')} + {power('d0 + d1')}"
    three = f"{two} - {power('d2')} + {power('d0 + d2')} + {power('d1 + d2')} - {power('d0 + d1 + d2')}"
    return f"{one} AS f1, greatest({two}, 0) AS f2, greatest({three}, 0) AS f3"


@query(f"""WITH d AS (SELECT pid, p0 AS d0, CASE WHEN t1 <> t0 THEN p1 WHEN t2 <> t0 THEN p2 END AS d1, CASE WHEN t1 <> t0 AND t2 <> t0 AND t2 <> t1 THEN p2 END AS d2, t1 = t0 AS same, t2 = t0 OR t2 = t1 AS again FROM ({PRICED})), f AS (SELECT *, {_subsets_sql(BLOCK)} FROM d)
SELECT pid, round(CASE WHEN d1 IS NULL THEN 1 + 2 * f1 WHEN d2 IS NULL AND same THEN 1 + 2 * f1 WHEN d2 IS NULL THEN 1 + f1 + f2 ELSE 1 + f1 + f2 END, 6) AS probes, round(CASE WHEN d1 IS NULL THEN f1 WHEN d2 IS NULL THEN f2 ELSE f3 END, 6) AS present FROM f""")
def cost_ie(spark, sf_dir):
    order = F.array_sort(F.collect_list(F.struct("k", "gram", "p")))
    arrays = _token_arrays(spark, sf_dir).groupBy("pid").agg(order.alias("s")).select("pid", F.transform("s", lambda s: s["gram"]).alias("keys"), F.transform("s", lambda s: s["p"]).alias("p"))
    return arrays.select("pid", probability.probes_by_subsets(F.col("p"), F.col("keys"), F.lit(BLOCK).cast("long")).alias("s")).select("pid", F.round("s.probes", 6).alias("probes"), F.round("s.present", 6).alias("present"))


# ---------------------------------------------------------------- statistics of runs


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(sum(l_discount) / sum(l_quantity), 9) AS ratio FROM lineitem GROUP BY ALL")
def stats_rollup(spark, sf_dir):
    return reports.averages(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], {"avg_qty": "l_quantity", "avg_price": "l_extendedprice"}, {"ratio": ("l_discount", "l_quantity")}).withColumn("avg_price", F.round("avg_price", 4))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS avg_price FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def bench_rollup(spark, sf_dir):
    return reports.rolled_up(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], {"avg_price": "o_totalprice"}, 4)


PIVOT = ", ".join(f"round(avg(CASE WHEN l_returnflag = '{k}' THEN {c} END), 6) AS {k.lower()}_{name}" for k in "ANR" for name, c in (("qty", "l_quantity"), ("price", "l_extendedprice"), ("discount", "l_discount"), ("tax", "l_tax")))


@query(f"SELECT l_linenumber, l_linestatus, {PIVOT}, count(*) AS n FROM lineitem GROUP BY ALL")
def bench_pivot(spark, sf_dir):
    metrics = {"qty": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
    return reports.wide(table(spark, sf_dir, "lineitem"), ["l_linenumber", "l_linestatus"], "l_returnflag", list("ANR"), metrics)


@query("SELECT l_linenumber, count(*) AS runs, round(avg(q), 6) AS l_quantity, round(avg(d), 6) AS l_discount FROM (SELECT l_suppkey, l_linenumber, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY ALL) GROUP BY l_linenumber")
def run_averages(spark, sf_dir):
    return reports.over_runs(table(spark, sf_dir, "lineitem"), "l_suppkey", ["l_linenumber"], ["l_quantity", "l_discount"])


@query("SELECT user_id, sum(CASE WHEN event_type = 'click' THEN value END) AS clicks, sum(CASE WHEN event_type LIKE 'purch%' THEN value END) AS purchases FROM events GROUP BY user_id")
def perf_pivot(spark, sf_dir):
    found = reports.counters(table(spark, sf_dir, "events"), ["user_id"], "event_type", "value", {"clicks": "^click$", "purchases": "^purch"})
    return found


TRIM = "SELECT *, row_number() OVER (PARTITION BY f, g ORDER BY x, o, l) AS r, count(*) OVER (PARTITION BY f, g) AS c FROM (SELECT l_returnflag AS f, l_linenumber AS g, l_extendedprice / l_quantity AS x, l_extendedprice AS a, l_quantity AS b, l_orderkey AS o, l_partkey AS l, row_number() OVER (PARTITION BY l_returnflag, l_linenumber ORDER BY l_orderkey, l_partkey) AS nth FROM lineitem) WHERE nth > 8"
STATS = f"SELECT f AS l_returnflag, g AS l_linenumber, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, round(min(x), 6) AS least, round(quantile_disc(x, 0.5), 6) AS median, round(quantile_disc(x, 0.9), 6) AS p90, round(quantile_disc(x, 0.99), 6) AS p99, round(sum(a) / sum(b), 9) AS ratio FROM ({TRIM}) WHERE c <= 4 OR (r > 2 AND r <= c - 2) GROUP BY f, g"


@query(STATS)
def trimmed_stats(spark, sf_dir):
    return reports.intervals(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber"], ["l_orderkey", "l_partkey"], F.col("l_extendedprice") / F.col("l_quantity"), ("l_extendedprice", "l_quantity"), skip=8, trim=2)


@query(f"SELECT l_returnflag, count(*) AS reps, round(avg(mean), 6) AS mean_mean, round(stddev_pop(mean), 6) AS mean_sd, round(avg(p90), 6) AS p90_mean, round(stddev_pop(p90), 6) AS p90_sd FROM ({STATS}) GROUP BY l_returnflag")
def stats_across(spark, sf_dir):
    return reports.across(trimmed_stats(spark, sf_dir), ["l_returnflag"], ["mean", "p90"])


@query("SELECT l_returnflag, count(*) AS n, round(sqrt(avg((pred - act) * (pred - act))), 6) AS rmse, round(avg(abs(pred - act) / act), 9) AS mape, round(abs(sum(pred) - sum(act)) / sum(act), 9) AS overall, round(avg(CASE WHEN pred > act THEN 1.0 ELSE 0.0 END), 6) AS over_share, round(avg(CASE WHEN pred < act THEN 1.0 ELSE 0.0 END), 6) AS under_share FROM (SELECT l_returnflag, l_extendedprice * (1 - l_discount) AS pred, l_extendedprice * (1 - l_tax) AS act FROM lineitem) GROUP BY l_returnflag")
def cost_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.expr("l_extendedprice * (1 - l_discount)").alias("pred"), F.expr("l_extendedprice * (1 - l_tax)").alias("act"))
    return reports.accuracy(rows, ["l_returnflag"], "pred", "act")


LEVELLED = "SELECT l_returnflag, l_orderkey, l_linenumber - 1 AS level, l_extendedprice * (1 - l_discount) AS pred, l_extendedprice * (1 - l_tax) AS act FROM lineitem"


@query(f"SELECT l_returnflag, count(*) AS patterns, sum((said = best)::INTEGER)::BIGINT AS exact, sum((abs(said - best) = 1)::INTEGER)::BIGINT AS beside, sum((abs(said - best) <= 1)::INTEGER)::BIGINT AS within, round(avg(real - least), 6) AS excess, round(avg(root - real), 6) AS gain FROM (SELECT l_returnflag, l_orderkey, arg_min(level, (pred, level)) AS said, arg_min(level, (act, level)) AS best, arg_min(act, (pred, level, act)) AS real, min(act) AS least, min(CASE WHEN level = 0 THEN act END) AS root FROM ({LEVELLED}) GROUP BY ALL) GROUP BY l_returnflag")
def level_choice_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", (F.col("l_linenumber") - 1).alias("level"), F.expr("l_extendedprice * (1 - l_discount)").alias("pred"), F.expr("l_extendedprice * (1 - l_tax)").alias("act"))
    return reports.level_accuracy(rows, ["l_returnflag"], "l_orderkey", "level", "pred", "act")


# ---------------------------------------------------------------- suffix arrays

SUFFIXES = f"SELECT stream_id, pos, list(token) OVER (PARTITION BY stream_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS suffix FROM ({EVENT_STREAM})"


def _suffixes(spark, sf_dir):
    stream = _events(spark, sf_dir)
    longest = match.lengths(stream).agg(F.max("n")).first()[0]
    return suffix_array.suffix_array(stream, longest or 1)


@query(f"SELECT stream_id, pos, row_number() OVER (PARTITION BY stream_id ORDER BY suffix) - 1 AS rank FROM ({SUFFIXES})")
def find_suffix_array(spark, sf_dir):
    return _suffixes(spark, sf_dir)


QUERIES["suffix_array"], ORACLE_SQL["suffix_array"] = QUERIES.pop("find_suffix_array"), ORACLE_SQL.pop("find_suffix_array")
LCP = f"SELECT stream_id, rank, len(list_filter(range(1, least(len(suffix), len(coalesce(n, []))) + 1), lambda i: suffix[1:i] = n[1:i])) AS lcp FROM (SELECT stream_id, suffix, row_number() OVER (PARTITION BY stream_id ORDER BY suffix) - 1 AS rank, lead(suffix) OVER (PARTITION BY stream_id ORDER BY suffix) AS n FROM ({SUFFIXES}))"


def _lcp(spark, sf_dir):
    stream = _events(spark, sf_dir)
    longest = stream.agg(F.max("pos")).first()[0]
    return suffix_array.lcp(_suffixes(spark, sf_dir), suffix_array.doubled(stream, (longest or 0) + 1))


@query(LCP)
def lcp_array(spark, sf_dir):
    return _lcp(spark, sf_dir)


@query(f"SELECT stream_id, max(lcp) AS longest FROM ({LCP}) GROUP BY stream_id")
def longest_repeat(spark, sf_dir):
    return _lcp(spark, sf_dir).groupBy("stream_id").agg(F.max("lcp").alias("longest"))


@query(f"SELECT pid, i AS prefix, coalesce(list_max(list_filter(range(0, i), lambda k: substr(pattern, 1, k) = substr(pattern, i - k + 1, k))), 0) AS border FROM (SELECT pid, pattern, unnest(range(1, length(pattern) + 1)) AS i FROM ({TEXT_PATTERNS}))")
def prefix_function(spark, sf_dir):
    return suffix_array.borders(_text_patterns(spark, sf_dir))
