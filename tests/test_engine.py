import decimal
import itertools
import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillscan import catalog
from rillscan.functions import probability
from rillscan.operators import hierarchy, keys, match, suffix_array
from rillscan.plans import presets
from rillscan.session import cut
from rillscan.sources import generators, streams
from rillscan.streaming import loads

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    return f"{float(value):.6g}" if isinstance(value, (float, decimal.Decimal)) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_duckdb(spark, duck, name):
    found, wanted = catalog.QUERIES[name](spark, DATA), duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    rows = [dict(zip(wanted.columns, r)) for r in wanted.fetchall()]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in found.collect()) == sorted(tuple(plain(r[c]) for c in columns) for r in rows)


def test_every_search_agrees_on_edge_cases(spark):
    random.seed(1)
    texts = ["", "a", "aaaaaaa", "ab" * 600, "■x\u0085y", " edge ", *("".join(random.choice("ab") for _ in range(random.randint(500, 1100))) for _ in range(8))]
    patterns = ["a", "aa", "abab", "■x", "\u0085y", " edge ", "", "zz", "ab", "ab", "b" * 9, "a" * 2000]
    t = spark.createDataFrame(list(enumerate(texts)), "stream_id long, text string")
    p = spark.createDataFrame(list(enumerate(patterns)), "pid long, pattern string")
    brute = {(i, s, k) for i, x in enumerate(patterns) if x for s, y in enumerate(texts) for k in range(len(y)) if y.startswith(x, k)}
    assert {tuple(r) for r in match.find_in_blocks(t, p, 2000, 64).collect()} == brute
    assert {tuple(r) for r in match.find_by_scan(t, p).collect()} == brute
    assert sorted(tuple(r) for r in match.find_all(t, p).collect()) == sorted(brute)


def test_block_window_is_what_evicting_blocks_leaves(spark):
    def simulate(n, window, block):
        trees = []
        for i in range(n):
            if not trees or trees[-1][1] == block:
                trees.append([i, 0])
            trees[-1][1] += 1
            if trees[-1][1] - 1 + (len(trees) - 1) * block > window:
                trees.pop(0)
        return trees[0][0] if trees else 0

    grid = [(n, w, b) for b in (2, 4, 8) for w in range(b, 5 * b + 3) for n in range(1, 12 * b)]
    for b in (2, 4, 8):
        for w in range(b, 5 * b + 3):
            sizes = [n for n, ww, bb in grid if (ww, bb) == (w, b)]
            if w % 3 == 0:
                got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", match.first_kept_block(F.col("n"), w, b).alias("k")).collect()
                assert all(r.k == simulate(r.n, w, b) for r in got)


def test_de_bruijn_cycle_holds_every_word_once():
    for order in (1, 2, 3, 5):
        cycle = generators.de_bruijn_cycle("0123", order)
        words = [(cycle + cycle)[i : i + order] for i in range(len(cycle))]
        assert len(cycle) == 4**order == len(set(words))


def test_bloom_filters_never_say_no_to_a_member(spark):
    yes = {(r.stream_id, r.gram) for r in catalog.bloom_probe(spark, DATA).collect()}
    asked = {r.gram for r in catalog._asked(spark, DATA).collect()}
    assert {(r.stream_id, r.gram) for r in catalog._grams(spark, DATA).collect() if r.gram in asked} <= yes


def test_solved_widths_reach_the_target(spark):
    assert all(abs(r["product"] - 0.99) < 1e-5 for r in catalog.solve_b(spark, DATA).collect())


def test_streaming_loads_fire_every_window(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "event_id")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    loads.loads_every(stream, "user_id", "event_id", 20).writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    wanted = {(r.user_id, k, 20 * k) for r in events.groupBy("user_id").count().collect() for k in range(1, r["count"] // 20 + 1)}
    assert {tuple(r) for r in spark.table("fired").collect()} == wanted


def brute_tokens(streams, patterns):
    return sorted((i, s, k) for i, p in enumerate(patterns) for s, x in enumerate(streams) for k in range(len(x) - len(p) + 1) if p and x[k : k + len(p)] == p)


def tokens_of(spark, streams):
    return spark.createDataFrame([(s, k, t) for s, x in enumerate(streams) for k, t in enumerate(x)], "stream_id long, pos long, token string")


@pytest.mark.parametrize("name", ["bs", "cp", "cgbs", "cf"])
def test_presets_find_what_brute_force_finds(spark, name):
    random.seed(3)
    streams = [[random.choice("abc") for _ in range(random.choice([1, 5, 16, 33, 70]))] for _ in range(12)] + [["a"] * 40]
    patterns = [list(p) for p in ("a", "ab", "aa", "abc", "aaaa", "abab", "cab" * 2, "a" * 20, "bca" * 7, "zz")]
    asked = spark.createDataFrame(list(enumerate(patterns)), "pid long, tokens array<string>")
    found = presets.preset(name, 16, 2).report(tokens_of(spark, streams), asked)
    assert sorted(tuple(r) for r in found.collect()) == brute_tokens(streams, patterns)


def test_division_makes_rows_of_matches_alone(spark):
    random.seed(5)
    streams = [[random.choice("ab") for _ in range(random.randint(0, 40))] for _ in range(12)] + [["a"] * 30, ["a\x01b", "c", "a", "b\x01c"]]
    patterns = [[random.choice("ab") for _ in range(m)] for m in range(13) for _ in range(4)] + [["a"] * 20, ["a", "b\x01c"], ["b", "c"]]
    stream, asked = tokens_of(spark, streams), spark.createDataFrame(list(enumerate(patterns)), "pid long, tokens array<string>")
    for n in (1, 2, 10):
        assert sorted(tuple(r) for r in match.find_tokens(stream, asked, n).collect()) == brute_tokens(streams, patterns)
    # starts that share a gram with a short pattern are not collected to be counted
    plan = match.find_tokens(stream, asked.where(F.size("tokens") <= match.WHOLE), 2)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "BroadcastHashJoin" in plan


def test_delays_leave_matches_where_they_are(spark):
    patterns = spark.createDataFrame([(0, list("ab")), (1, list("abcdefg"))], "pid long, tokens array<string>")
    matches = spark.createDataFrame([(0, 5, 3), (1, 5, 0), (1, 6, 3), (2, 6, 3)], "pid long, stream_id long, pos long")
    # as tables of unknown size, which are not sent to every task unless asked to
    found = loads.delayed(cut(matches), cut(patterns), 16)
    assert sorted(tuple(r) for r in found.collect()) == [(0, 5, 3, 5), (1, 5, 0, 8), (1, 6, 3, 16)]
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_no_match_lies_outside_the_ranges_of_any_plan(spark):
    random.seed(4)
    streams = [[random.choice("abcd") for _ in range(60)] for _ in range(8)]
    patterns = [streams[i][5 * i : 5 * i + 2 + i] for i in range(7)] + [list("aa"), list("abca")]
    stream, asked = tokens_of(spark, streams), spark.createDataFrame(list(enumerate(patterns)), "pid long, tokens array<string>")
    grams = match.pattern_grams(asked, 2)
    held = hierarchy.members(match.ngrams(stream, 2), 16, 2)
    for seed in range(4):
        plan = spark.createDataFrame([(i, k, random.randrange(6)) for i, p in enumerate(patterns) for k in range(len(p) - 1)], "pid long, k long, level long")
        ranges, visits = hierarchy.candidates(held, hierarchy.with_levels(grams, plan), 16, 2)
        places = {(r.pid, r.stream_id, k) for r in ranges.collect() for k in range(r.lo, r.hi + 1)}
        assert set(brute_tokens(streams, patterns)) <= places
        assert all(r.probes >= r.nodes or r.nodes == 0 for r in visits.collect())
        assert sorted(tuple(r) for r in hierarchy.verify(stream, asked, ranges).collect()) == brute_tokens(streams, patterns)


def test_suffix_array_search_on_edge_cases(spark):
    streams = [list("abababab"), list("a"), list("zzzz")]
    patterns = [list("ab"), list("b"), list("abababababab"), [], list("zz"), list("c")]
    stream, asked = tokens_of(spark, streams), spark.createDataFrame(list(enumerate(patterns)), "pid long, tokens array<string>")
    found = suffix_array.find(stream, suffix_array.suffix_array(stream, 8), asked)
    assert sorted(tuple(r) for r in found.collect()) == brute_tokens(streams, patterns)


def test_suffix_arrays_in_memory_and_by_windows_agree(spark, monkeypatch):
    random.seed(6)
    streams = [[random.choice(["a", "b", "é", "\U0001d11e", "\uffff"]) for _ in range(random.randint(1, 60))] for _ in range(30)] + [["a"] * 70]
    patterns = [[random.choice("ab") for _ in range(m)] for m in range(6) for _ in range(5)] + [["é", "\uffff"], ["c"], ["a"] * 64]
    stream, asked = tokens_of(spark, streams), spark.createDataFrame(list(enumerate(patterns)), "pid long, tokens array<string>")
    wanted = [(i, at, r) for i, s in enumerate(streams) for r, at in enumerate(sorted(range(len(s)), key=lambda k: s[k:]))]
    ranks = suffix_array.suffix_array(stream, 70)
    assert sorted(tuple(r) for r in ranks.collect()) == sorted(wanted)
    assert sorted(tuple(r) for r in suffix_array.find(stream, ranks, asked).collect()) == brute_tokens(streams, patterns)
    unnamed = stream.where("stream_id = 3").withColumn("stream_id", F.lit(None).cast("long")).unionByName(stream.where("stream_id = 0"))
    found = suffix_array.find(unnamed, suffix_array.suffix_array(unnamed, 70), asked).collect()
    assert sorted((r.pid, 3 if r.stream_id is None else r.stream_id, r.pos) for r in found) == [r for r in brute_tokens(streams, patterns) if r[1] in (0, 3)]
    for tokens, size in ((1, 1), (5, 2), (5, 20), (100, 3)):
        monkeypatch.setattr(suffix_array, "TOKENS", tokens)
        ids = pa.table({"stream_id": pa.array([None] * 3 + [0] * 4 + [1] + [2] * 12 + [7] * 2, pa.int64())})
        parts = [t.column("stream_id").to_pylist() for t in suffix_array._whole(iter(ids.to_batches(max_chunksize=size)))]
        assert sum(parts, []) == ids.column("stream_id").to_pylist() and sum(len(set(p)) for p in parts) == 5
    # no row is made for a stream and a pattern that it does not hold
    plan = suffix_array.find(stream, ranks, asked)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("CartesianProduct", "NestedLoopJoin", "SortMergeJoin"))
    monkeypatch.setattr(suffix_array, "MOST_TOKENS", 10)
    few, some = stream.where("stream_id < 4 or stream_id = 30"), asked.where("pid % 5 = 0")
    slow = suffix_array.suffix_array(few, 70)
    assert sorted(tuple(r) for r in slow.collect()) == sorted(w for w in wanted if w[0] < 4 or w[0] == 30)
    kept = [(p, s, k) for p, s, k in brute_tokens(streams, patterns) if p % 5 == 0 and (s < 4 or s == 30)]
    assert sorted(tuple(r) for r in suffix_array.find(few, slow, some).collect()) == kept


def test_inclusion_and_exclusion_up_to_an_order(spark):
    p = [0.1, 0.2, 0.05, 0.3]
    row = spark.range(1).select(
        *[probability.all_present(F.array(*map(F.lit, p)), F.lit(8), 0.1, o).alias(f"o{o}") for o in (1, 2, 4)],
        probability.deepest_level(16, F.lit(3)).alias("deep"), probability.child_can_host(16, F.lit(2), F.lit(3)).alias("fits"),
    ).first()
    for order in (1, 2, 4):
        wanted = sum((-0.9) ** k * sum(max(0, 1 - sum(c)) ** 8 for c in itertools.combinations(p, k)) for k in range(order + 1))
        assert row[f"o{order}"] == pytest.approx(min(1, max(0, wanted)))
    assert (row.deep, row.fits) == (2, False)


def test_generated_chains_follow_their_matrix(spark):
    matrix = generators.transition_matrix(4, 1, seed=2)
    rows = generators.markov(spark, 20, 3000, matrix, base=97, seed=1).collect()
    again = generators.markov(spark, 20, 3000, matrix, base=97, seed=1).repartition(3).collect()
    assert sorted(rows) == sorted(again)
    chains = {}
    for r in sorted(rows):
        chains.setdefault(r.stream_id, []).append(ord(r.token) - 97)
    seen = np.zeros((4, 4))
    for chain in chains.values():
        np.add.at(seen, (chain[:-1], chain[1:]), 1)
    wanted = seen.sum(1, keepdims=True) * matrix
    assert (np.abs(seen - wanted) < 5 * np.sqrt(wanted * (1 - matrix)) + 2).all()


def test_files_are_read_and_written(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"one\r\n\n two \nthree")
    assert sorted(r.line for r in streams.read_lines(spark, str(tmp_path / "in")).collect()) == ["", " two ", "one", "three"]
    assert sorted(r.line for r in streams.read_lines(spark, str(tmp_path / "in"), strip=True).collect()) == ["one", "three", "two"]
    assert sorted(r.token for r in streams.read_segments(spark, str(tmp_path / "in"), "\n").collect()) == [" two ", "one", "three"]
    rows = spark.createDataFrame([('x"y', None), ("a;b", "2")], "name string, value string").coalesce(1)
    for _ in range(2):
        streams.write_csv(rows, str(tmp_path / "csv"), append=True, delimiter=";")
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert text.count('"x""y";') == 2 and text.count('"a;b";"2"') == 2 and text.count('"name";"value"') == 2
    streams.write_lines(spark.createDataFrame([("begun",)], "line string"), str(tmp_path / "log"))
    streams.write_lines(spark.createDataFrame([("ended",)], "line string"), str(tmp_path / "log"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect()) == ["begun", "ended"]
    (tmp_path / "perf.csv").write_text("1.0,250,,cycles,x\n1.0,<not counted>,,cache-misses\n2.0,7.5,instructions\n# note\n")
    assert sorted((r.time, r.value, r.event) for r in streams.perf_counters(spark, str(tmp_path / "perf.csv")).collect()) == [(1.0, 250.0, "cycles"), (2.0, 7.5, "instructions")]


def test_streams_answer_every_window(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    parts = sorted(events.collect(), key=lambda r: (r.ts, r.event_id))
    (tmp_path / "in").mkdir()
    for k in range(4):
        spark.createDataFrame(parts[k * len(parts) // 4 : (k + 1) * len(parts) // 4], events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in the order of their times
    users = {}
    for r in parts:
        users.setdefault(r.user_id, []).append(r.event_type)
    some = next(iter(users.values()))
    patterns = [some[:1], some[2:4], some[5:10]]
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    loads.answers_every(stream, "user_id", ["ts", "event_id"], "event_type", patterns, 10).writeStream.format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    wanted = sorted((u, -(-(s + len(p)) // 10), i, s) for u, x in users.items() for i, p in enumerate(patterns) for s in range(len(x) // 10 * 10 - len(p) + 1) if x[s : s + len(p)] == p)
    assert sorted(tuple(r) for r in spark.table("answers").collect()) == wanted
    out = loads.search_batches(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), lambda b: b.where("event_type = 'click'"), str(tmp_path / "out"), str(tmp_path / "at2"))
    out.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.where("event_type = 'click'").count()


@pytest.mark.parametrize("mode", ["chars", "words", "segments"])
def test_streams_of_every_reader(spark, mode):
    docs = spark.createDataFrame([(1, "to be or\nnot to be"), (2, None), (3, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "to be"), (1, "not to be")], "pid long, text string")
    found = sorted(tuple(r) for r in loads.run_stream(docs, asked, mode, presets.preset("cp", 8, 2)).collect())
    assert found == {"chars": [(0, 1, 0), (0, 1, 12), (1, 1, 8)], "words": [(0, 1, 0), (0, 1, 4), (1, 1, 3)], "segments": [(1, 1, 1)]}[mode]


def test_estimators_and_keys(spark):
    tokens = spark.createDataFrame([(k,) for k in ["a"] * 60 + ["b"] * 30 + ["c"] * 10], "key string")
    asked = spark.createDataFrame([("a",), ("b",), ("z",)], "key string")
    exact = {r.key: r.p for r in presets.ExactCounts().estimate(tokens, asked).collect()}
    declared = {r.key: r.p for r in presets.ExactCounts(200).estimate(tokens, asked).collect()}
    sketched = {r.key: r.p for r in presets.Sketched.within(0.05, 0.01).estimate(tokens, asked).collect()}
    assert exact == {"a": 0.6, "b": 0.3, "z": 0.0} and declared == {"a": 0.3, "b": 0.15, "z": 0.0}
    assert sketched["a"] == pytest.approx(0.6, abs=0.05) and 0 <= sketched["z"] < 0.05
    assert [r.p for r in spark.range(1).select(keys.pack([F.lit(5), F.lit(9)], [3, 3]).alias("p")).collect()] == [None]
    with pytest.raises(ValueError):
        keys.interval_bits(16, 5)
    with pytest.raises(ValueError):
        keys.pack([F.lit(1)] * 2, [40, 40])
