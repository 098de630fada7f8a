import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from rillscan.llm import bpe, flac, jaccard, mixing, pii, pseudo, quality, queries, suffixes, token_counts, urls

DATA = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, Key string, counts string, place string"
ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "same text here and there"), (904, "same text here and there"), (905, "wörter ä é 漢字 😀"), (None, "no id at all"), (906, "x" * 30000), (907, "a b " * 3000)]


def frame(spark, rows):
    """Documents with further columns whose names operators use themselves."""
    return spark.createDataFrame([(d, t, "k", "c", "p") for d, t in rows], SCHEMA).repartition(4)


def rows_of(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_jaccard_components_equal_brute_force(spark):
    random.seed(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["A", "a"]
    base = [[random.choice(vocabulary) for _ in range(random.choice([5, 12, 40, 100, 200]))] for _ in range(25)]
    rows = list(ODD)
    for i in range(300):
        words = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 1, 2, 3])):
            words[random.randrange(len(words))] = random.choice(vocabulary)
        rows.append((i, random.choice(" \n\t").join(words)))
    sets = []
    for _, text in rows:
        w = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 85 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    wanted = sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)
    assert rows_of(jaccard.components_of(frame(spark, rows)), ["doc_id", "n_shingles", "component_id"]) == wanted


def test_quality_counts_equal_brute_force_and_empty_tables_work(spark):
    random.seed(2)
    rows = ODD + [(i, "".join(random.choice(["aa ", "bb ", "cc\n", "#* "]) for _ in range(60))) for i in range(60)]

    def counts(text):
        w = re.findall(WORD, text)
        seen, repeated = set(), 0
        for line in text.split("\n"):
            if re.search(WORD, line):
                repeated += line in seen
                seen.add(line)
        places = defaultdict(list)
        for i in range(len(w) - 7):
            places[tuple(w[i : i + 8])].append(i)
        covered = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)

    found = quality.judge(frame(spark, rows))
    assert rows_of(found, ["doc_id", *quality.COUNTS[:5], "base_failed"]) == sorted(((d, *counts(t or "")) for d, t in rows), key=str)
    assert quality.judge(frame(spark, [])).count() == 0
    assert quality.keep_good(frame(spark, ODD)).columns == frame(spark, ODD).columns


def test_fitted_rules_separate_marked_texts():
    patterns = np.array([int("1" * quality.N_RULES, 3), int("1" * quality.N_RULES, 3) - 9])
    good = quality.fit(patterns, np.array([900.0, 60.0]))[0]
    assert good[0] > 0.9 > 0.1 > good[1]


def test_kept_follows_the_posterior_of_given_votes(spark):
    """The verdict on whole texts against plain expectation-maximisation over single documents."""
    random.seed(9)
    good = "Plain words of a good text stand here, and they end. Another line follows with other words in it.\n"
    rows = [(i, good + f"Number {i} differs a little from the rest of them. " * 2) for i in range(60)]
    rows += [(1000 + i, ("### $$$ *** &&& word %% " * 8 + f"{i} ") * 2) for i in range(12)]
    found = {r.doc_id: r for r in quality.judge(frame(spark, rows + ODD)).collect()}
    patterns = {r.doc_id: r.p for r in quality.count(frame(spark, rows), "c", ["doc_id"]).select("doc_id", quality.pattern_of("c").alias("p")).collect()}
    inside = [d for d, _ in rows + ODD[9:10] if not found[d].base_failed]
    shown = {d: [(r, patterns[d] // 3**r % 3) for r in range(quality.N_RULES) if patterns[d] // 3**r % 3 < 2] for d in inside if d in patterns}
    belief = {d: 0.05 if any(v == 0 for _, v in s) else 0.999 for d, s in shown.items()}
    for _ in range(300):
        theta = {}
        for c in (0, 1):
            for r in range(quality.N_RULES):
                n = [sum((belief[d] if c else 1 - belief[d]) for d, s in shown.items() if (r, v) in s) for v in (0, 1)]
                prior = [1, 1] if not c else [w * (quality.TRUST * len(shown) + 2) for w in (quality.WRONG, 1 - quality.WRONG)]
                total = sum(n) + sum(prior)
                theta[c, r] = [(n[v] + prior[v]) / total for v in (0, 1)]
        share = (sum(belief.values()) + 1) / (len(shown) + 2)
        for d, s in shown.items():
            both = [np.prod([theta[c, r][v] for r, v in s]) * (share if c else 1 - share) for c in (0, 1)]
            belief[d] = both[1] / sum(both)
    for d in shown:
        assert found[d].posterior == pytest.approx(belief[d], abs=1e-4) and found[d].kept == (belief[d] >= 0.5)


def test_pseudo_likelihood_prefers_the_corpus(spark):
    rows = [(i, "the cat sat on the mat and the dog ran to the door again " * 8) for i in range(60)] + [(99, "mat the to dog again and ran sat door on cat the " * 8)] + ODD
    found = {r.doc_id: r for r in pseudo.score(frame(spark, rows)).collect()}
    assert found[5].mean_log_likelihood > found[99].mean_log_likelihood
    assert found[901].n_words == 0 and found[901].mean_log_likelihood is None
    assert len(pseudo.score(frame(spark, [])).collect()) == 0


def test_pseudo_likelihood_equals_plain_sums_under_given_parameters(spark, monkeypatch):
    rng = np.random.default_rng(6)
    random.seed(7)
    twice = [f"w{i}" for i in range(4100)] * 2 + [f"Once{i}é" for i in range(60)]
    random.shuffle(twice)
    rows = ODD + [(i, " ".join(twice[20 * i : 20 * i + 20])) for i in range(len(twice) // 20)]
    own = {k: rng.normal(0, 0.5, v) for k, v in pseudo._SHAPES.items()}
    monkeypatch.setattr(pseudo, "train", lambda texts, first, total: np.concatenate([np.ravel(x) for x in own.values()]).astype(np.float32))
    texts = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for _, t in rows]
    tokens = [[w.encode() for w in re.findall(WORD, t)] for t in texts]
    counts = Counter(w for t in tokens for w in t)
    octets = Counter(b for _, t in rows for w in re.findall(WORD, t or "") for b in w.encode())
    raw = [[w.encode() for w in re.findall(WORD, t or "")] for _, t in rows]
    key = {w: int(pseudo._keys(pseudo.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]), lower=True))[0]) for w in counts}
    ranked = sorted(counts, key=lambda w: (-counts[w], key[w]))[: pseudo.COMMON]
    G, K = pseudo.GROUPS, pseudo.OUTCOMES
    number = {w: key[w] % G * K for w in counts} | {w: r % G * K + 1 + r // G for r, w in enumerate(ranked)}
    others = {g: [w for w in set(counts) - set(ranked) if key[w] % G == g] for g in range(G)}

    def log_softmax(z):
        return z - z.max() - np.log(np.exp(z - z.max()).sum())

    wanted = {}
    for (d, _), words, cased in zip(rows, tokens, raw):
        total = 0.0
        for i, w in enumerate(words):
            near = [number[words[i + s]] if 0 <= i + s < len(words) else G * K for s in pseudo.SIDES]
            h = np.tanh(sum(own["side"][k][c] for k, c in enumerate(near)) + own["bias"])
            g, outcome = divmod(number[w], K)
            total += log_softmax(h @ own["group"] + own["group_prior"])[g] + log_softmax(h @ own["word"][g] + own["word_prior"][g])[outcome]
            if outcome == 0:
                size, single = sum(counts[x] for x in others[g]), sum(counts[x] == 1 for x in others[g])
                if counts[w] > 1:
                    total += np.log(counts[w] / size)
                else:
                    total += np.log(single / size) + np.log(G) + sum(np.log((octets[b] + 1) / (sum(octets.values()) + 256)) for b in cased[i])
        wanted.setdefault(d, []).append((len(words), total))
    for r in pseudo.score(frame(spark, rows)).collect():
        assert any(r.n_words == n and abs(r.log_likelihood - x) < 1e-2 + 1e-4 * abs(x) for n, x in wanted[r.doc_id])


def test_pseudo_likelihood_does_not_depend_on_partitions(spark):
    rows = [(i, " ".join(random.Random(i).choice(["a", "b", "c", "dd", "ee"]) for _ in range(40))) for i in range(400)] + ODD
    docs = frame(spark, rows)
    one, many = ({r.doc_id: r.log_likelihood for r in pseudo.score(x).collect() if r.doc_id != 904} for x in (docs.coalesce(1), docs.repartition(8)))
    assert one == pytest.approx(many, abs=1e-2)
    only = spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in pseudo.score(only).collect()} == {(k, 0, 0.0, None) for k in (1, 2, 3)}


def test_pseudo_likelihood_trains_on_every_place(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g h") for i in range(8000)], "doc_id long, text string").coalesce(1)
    assert pseudo.score(docs).first().mean_log_likelihood > -3
    where = np.repeat(np.arange(5), [1, 7, 2, 0, 5])
    assert sorted(np.concatenate([pseudo.windows(where, k) for k in range(pseudo.ROUNDS)])) == list(range(len(where)))


def test_pseudo_likelihood_knows_every_word_by_its_own_count(spark, monkeypatch):
    random.seed(8)
    names = [f"{i:04d}" for i in random.sample(range(10000), 600)]
    # of equal bytes and in equal contexts, half of the words stand in many texts and half in two
    rows = [(k * 1000 + i, f"aa bb {w} cc dd") for i, w in enumerate(names) for k in range(40 if i % 2 else 2)]
    found = []
    for known in (1 << 15, 200, 96):
        monkeypatch.setattr(pseudo, "KNOWN", known)
        found.append({r.doc_id: r.log_likelihood for r in pseudo.score(frame(spark, rows + ODD)).collect()})
    often, seldom = (np.mean([found[0][i] for i in range(half, 600, 2)]) for half in (1, 0))
    assert often > seldom + 1.5
    assert all(found[0][i] == pytest.approx(f[i], abs=1e-3) for f in found[1:] for i in range(600))


def test_flac_round_trip_and_blocks(spark):
    rng = np.random.default_rng(0)
    texts = [b"", b"a" * 577, bytes(rng.integers(0, 256, 3000, dtype=np.uint8)), bytes((np.cumsum(rng.integers(-3, 4, 9000)) % 256).astype(np.uint8)), bytes((128 + 100 * np.sin(np.arange(80000) / 40)).astype(np.uint8))]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    streams = flac.encode_payloads(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for text, (samples, table) in zip(texts, flac.decode_streams(streams)):
        assert (samples + 128).astype(np.uint8).tobytes() == text + b"\xff" * (max(1, -(-len(text) // 576)) * 576 - len(text))
        assert table[:, 0].tolist() == list(range(0, len(samples), 576))
    for place in (-1, -40, len(streams[3]) // 2):
        broken = bytearray(streams[3])
        broken[place] ^= 4
        with pytest.raises(flac.CorruptStream):
            flac.decode_streams([bytes(broken)])
    stored = flac.store(frame(spark, ODD))
    assert flac.store(frame(spark, [])).count() == 0 and flac.digest(flac.decode(stored)).count() == len(ODD)
    assert {r.payload_sha256 for r in flac.digest(flac.decode(stored)).where("doc_id = 901").collect()} == {hashlib.sha256(b"\xff" * 576).hexdigest()}
    assert flac.pcm_blocks(stored).where("doc_id = 906").count() == -(-30000 // 576)


def test_flac_reads_what_another_writer_wrote():
    """A stream put together bit by bit from the format: all kinds of sub-frames, of block sizes and of Rice coding."""
    rng = random.Random(12)

    def crc(data, polynomial, width):
        value = 0
        for byte in data:
            value ^= byte << (width - 8)
            for _ in range(8):
                value = (value << 1 ^ (polynomial if value >> (width - 1) else 0)) & ((1 << width) - 1)
        return value

    def two(value, width):
        return format(value & ((1 << width) - 1), f"0{width}b")

    def rice(value, k):
        folded = 2 * value if value >= 0 else -2 * value - 1
        return "0" * (folded >> k) + "1" + (two(folded, k) if k else "")

    wave = [max(-128, min(127, round(60 * np.sin(t / 9) + rng.randint(-4, 4)))) for t in range(192 + 256 + 100 + 64 + 16)]
    pieces = [wave[:192], wave[192:448], [7] * 100, wave[548:612], wave[612:628]]
    frames = b""
    for number, x in enumerate(pieces):
        n = len(x)
        size_code, size_tail = {192: ("0001", ""), 256: ("1000", "")}.get(n, ("0110", two(n - 1, 8)))
        if number == 0:  # coefficients of order 3, 12 bits, shift 9; 4-bit parameters in four partitions
            c = [700, -300, 90]
            left = [x[t] - (sum(c[j] * x[t - 1 - j] for j in range(3)) >> 9) for t in range(3, n)]
            parts = [left[:45], left[45:93], left[93:141], left[141:]]
            body = "0" + two(32 + 2, 6) + "0" + "".join(two(v, 8) for v in x[:3]) + two(11, 4) + two(9, 5) + "".join(two(v, 12) for v in c) + "00" + two(2, 4) + "".join(two(k, 4) + "".join(rice(v, k) for v in p) for k, p in zip((5, 6, 4, 7), parts))
        elif number == 1:  # fixed of order 2; 5-bit parameters, the second of two partitions escaped to 11 raw bits
            left = [x[t] - 2 * x[t - 1] + x[t - 2] for t in range(2, n)]
            body = "0" + two(8 + 2, 6) + "0" + two(x[0], 8) + two(x[1], 8) + "01" + two(1, 4) + two(3, 5) + "".join(rice(v, 3) for v in left[:126]) + two(31, 5) + two(11, 5) + "".join(two(v, 11) for v in left[126:])
        elif number == 2:
            body = "0" + two(0, 6) + "0" + two(7, 8)
        elif number == 3:
            body = "0" + two(1, 6) + "0" + "".join(two(v, 8) for v in x)
        else:  # fixed of order 0
            body = "0" + two(8, 6) + "0" + "00" + two(0, 4) + two(2, 4) + "".join(rice(v, 2) for v in x)
        first = [0, 192, 448, 548, 612][number]
        coded = bytes([first]) if first < 128 else bytes([0xC0 | first >> 6, 0x80 | first & 63])
        bits = "11111111111110" + "0" + "1" + size_code + "0000" + "0000" + "001" + "0" + "".join(two(v, 8) for v in coded) + size_tail
        head = int(bits, 2).to_bytes(len(bits) // 8, "big")
        head += bytes([crc(head, 0x07, 8)])
        body += "0" * (-len(body) % 8)
        frame_bytes = head + int(body, 2).to_bytes(len(body) // 8, "big")
        frames += frame_bytes + crc(frame_bytes, 0x8005, 16).to_bytes(2, "big")
    samples = [v for p in pieces for v in p]
    info = (16).to_bytes(2, "big") + (256).to_bytes(2, "big") + bytes(6) + (8000 << 44 | 7 << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(np.array(samples, np.int8).tobytes()).digest()
    stream = b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x81" + (5).to_bytes(3, "big") + bytes(5) + frames
    (found, table), = flac.decode_streams([stream])
    assert found.tolist() == samples and table[:, 0].tolist() == [0, 192, 448, 548, 612]


def test_base_spans_equal_plain_patterns(spark):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(digits):
        return sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0

    def brute(text):
        out = []
        for rank, (kind, pattern) in enumerate(plain.items()):
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m[0])
                if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                    continue
                out.append((m.start(), rank, m.end(), kind))
        return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out)).encode()).hexdigest()

    random.seed(5)
    pieces = ["4465053358673456", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "+1 (499) 555-6503", "a@b.c_d@e.f", "a@b.co.uk", "x", "00001.2.3.004"]
    rows = ODD + [(i, "".join(random.choice("abA.@1 2-+()3%_.@4512😀é\n") for _ in range(random.randrange(120)))) for i in range(800)] + [(2000 + i, random.choice(" -.").join(random.choice(pieces) for _ in range(6))) for i in range(200)] + [(5000, "1" * 20000), (5001, "a@b" + ".c" * 9000)]
    found = pii.find(frame(spark, rows))
    assert rows_of(found, ["doc_id", "base_sha256"]) == sorted(((d, brute(t or "")) for d, t in rows), key=str)
    text = 'write x.y@mail.org or token = "0641917ea4e9feb9cda83477b57ac2654884f485" now'
    assert pii.redact(frame(spark, [(1, text), (2, "a clean text of words")]), ["_a", "_b"]).orderBy("doc_id").first().text == "write [email] or [secret] now"


def test_long_secrets_are_one_span_to_their_end(spark):
    random.seed(6)
    hexa, alnum = lambda n: "".join(random.choice("0123456789abcdef") for _ in range(n)), lambda n: "".join(random.choice("abcdefXYZ0123456789") for _ in range(n))
    texts = [f"x token = {hexa(512)} end", f"see {alnum(900)} end", f"{'a' * 250}{hexa(300)} end", f"AKIA{'ABCDEFGH12345678'}-{alnum(300)} end"]
    found = {r.doc_id: r.c for r in frame(spark, list(enumerate(texts))).select("doc_id", pii.candidates(F.col("text")).alias("c")).collect()}
    assert [[(c.start, c.end) for c in found[k] if c.kind == "secret"] for k in range(4)] == [[(2, 522)], [(4, 904)], [(0, 550)], [(0, 20), (20, 321)]]
    assert [r.text for r in pii.redact(frame(spark, [(0, texts[0])]), ["_a", "_b"]).collect()] == ["x [secret] end"]


def test_spans_that_only_overlap_others_are_redacted_whole(spark):
    texts = {
        'password="' + "aB3x" * 80 + '" end': "[secret] end",
        'secret = "Zx9+14995556503Qw8Er7Ty6Ui5Op4" x': "[secret] x",
        "SSN 123-45-6789 x": "SSN [number] x",
        "call 1.2.3.4 555 123 4567 now": "call [ip] now",
        "version 12.345.678 12 of 2019-10-12": "version 12.345.678 12 of 2019-10-12",
    }
    found = {r.doc_id: r.text for r in pii.redact(frame(spark, list(enumerate(texts))), ["_a", "_b"]).collect()}
    assert [found[k] for k in range(len(texts))] == list(texts.values())


def test_places_of_very_many_spans(spark):
    text = " é1.2.3.4" * 3000
    spans = pii.find(frame(spark, [(1, text), (2, None), (3, "")])).orderBy("doc_id").collect()
    assert spans[0].spans == ",".join(f"ip:{9 * k + 2}:{9 * k + 9}" for k in range(3000)) and (spans[0].n_ip, spans[0].n_spans) == (3000, 3000)
    assert [(r.spans, r.n_spans) for r in spans[1:]] == [("", 0)] * 2
    assert pii.find(frame(spark, [])).count() == 0


def test_bpe_equals_tiktoken_and_counts_equal_tokenizers(spark):
    import tiktoken
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(1)
    rows = ODD + [(i, "".join(chr(random.choice([random.randrange(32, 127), random.randrange(0x300), random.randrange(0x1F300, 0x1F700), 32, 10])) for _ in range(50))) for i in range(300)] + [(3000, "<|endoftext|>x<|endoftext|> 's''s")]
    wanted = []
    for d, t in rows:
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        wanted.append((d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows_of(bpe.round_trip(frame(spark, rows), path, public_tokenizers.PATTERN), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == sorted(wanted, key=str)
    encoded = bpe.encode(frame(spark, rows), path, public_tokenizers.PATTERN)
    assert rows_of(bpe.decode(encoded, path, public_tokenizers.PATTERN), ["doc_id", "text_bytes"]) == sorted(((d, bytearray((t or "").encode())) for d, t in rows), key=str)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counted = token_counts.token_counts(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 1024)
    assert rows_of(counted, ["doc_id", "n_bytes", "n_tokens"]) == sorted(((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in rows), key=str)


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "HTTP://WWW.Example.NET/en/x?q"), (4, "a://b.net"), (5, "a://b.net/"), (6, "x://y://z/p#q?r"), (7, "nourl"), (8, "http://x.example.com/de/1"), (9, "http://x.org/fr/#a")]
    found = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [(found[k].host, found[k].path, found[k].rule, found[k].verdict) for k in (3, 5, 8, 9)] == [("www.example.net", "/en/x", "example.net/en/", "allow"), ("b.net", "/", "net/", "block"), ("x.example.com", "/de/1", "example.com/de/", "block"), ("x.org", "/fr/", "org/fr/", "allow")]
    assert (found[4].rule, found[1].host, found[7].path, found[6].host, found[6].path) == (None, "", "", "y:", "//z/p")
    good, bad = [f"news.site{i}.org/story" for i in range(200)], [f"ads.trk{i}.biz/click" for i in range(200)]
    judge = urls.Judge(good[::2], bad[::2])
    held = [(judge.score(x), True) for x in good[1::2]] + [(judge.score(x), False) for x in bad[1::2]]
    cut = urls.calibrate(held)
    assert sum((s >= cut) == a for s, a in held) / len(held) > 0.97


def test_url_models_equal_plain_witten_bell():
    good, bad = ["abcab", "abd", "", "xyz"], ["zzz", "zab"]

    def chance(texts, context, c):
        p = 1 / 256
        for k in range(urls.ORDER + 1):
            tail = context[len(context) - k :]
            seen = [("\x02" * urls.ORDER + t + "\x03") for t in texts]
            follows = [s[i] for s in seen for i in range(urls.ORDER, len(s)) if s[i - k : i] == tail]
            if follows:
                kinds = len(set(follows))
                p = (follows.count(c) + kinds * p) / (len(follows) + kinds)
        return p

    judge = urls.Judge(good, bad)
    for text in ("abc", "zzab", "q", "xyzabd"):
        padded = "\x02" * urls.ORDER + text + "\x03"
        each = [np.log(chance(good, padded[i - urls.ORDER : i], padded[i]) / chance(bad, padded[i - urls.ORDER : i], padded[i])) for i in range(urls.ORDER, len(padded))]
        assert judge.score(text) == pytest.approx(sum(each) / len(each)) or judge.score(text) == pytest.approx(sum(each) / len(text))


def test_url_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "h"), (1, None, "h"), (2, "nourl", "h"), (3, "", "h"), (None, "a://b.example.net/en/", "h"), (4, "x://" + "long." * 30000 + "net/", "h")]
    found = urls.judge(spark.createDataFrame(rows, "page_id long, url string, Host string").repartition(3)).collect()
    assert sorted([(r.page_id, r.host[:20], r.path, r.rule) for r in found], key=str) == sorted([(1, "", "", None)] * 2 + [(2, "", "", None), (3, "", "", None), (None, "b.example.net", "/en/", "example.net/en/"), (4, "long.long.long.long.", "/", "net/")], key=str)
    assert len({r.verdict for r in found if r.host == ""}) == 1
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_urls_learn_from_every_labelled_url(spark):
    random.seed(8)
    names = lambda n: ["".join(random.choices("abcde", k=random.randint(3, 9))) for _ in range(n)]
    rows = [f"x://{a}.org/fr/{b}" for a, b in zip(names(9000), names(9000))] + [f"x://{a}.net/{b}{b}" for a, b in zip(names(600), names(600))] + [f"x://{a}.com/{b}" for a, b in zip(names(200), names(200))]
    found = urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").repartition(7)).collect()
    texts = {kind: sorted({rows[r.page_id][4:] for r in found if r.rule and r.verdict == kind}) for kind in ("allow", "block")}
    assert len(texts["allow"]) > 8500 and len(texts["block"]) > 550
    hashed = spark.createDataFrame([(t,) for kind in texts for t in texts[kind]], "text string").select("text", F.pmod(F.xxhash64("text"), F.lit(urls.HELD)).alias("h")).collect()
    held = {r.text for r in hashed if r.h == 0}
    judge = urls.Judge(*([t for t in texts[kind] if t not in held] for kind in ("allow", "block")))
    cut = urls.calibrate([(judge.score(t), kind == "allow") for kind in texts for t in texts[kind] if t in held])
    wanted = {i: judge.score(rows[i][4:]) for i in range(9600, 9800)}
    scored = {r.page_id: r for r in found if r.rule is None}
    assert set(scored) == set(wanted) and all(scored[i].score == pytest.approx(wanted[i], rel=1e-9) for i in wanted)
    assert all(scored[i].verdict == ("allow" if wanted[i] >= cut else "block") for i in wanted if abs(wanted[i] - cut) > 1e-9)


def test_thresholds_over_parts_equal_those_in_memory(spark):
    random.seed(9)
    for n in (0, 1, 2, 30, 400):
        scores = [(random.choice([0.0, 0.25, -0.5, random.gauss(0.3 if a else -0.3, 1)]), a) for a in random.choices([True, False], k=n)]
        rows = spark.createDataFrame(scores, "score double, a boolean").groupBy("score").agg(F.count(F.when(F.col("a"), 1)).alias("good"), F.count(F.when(~F.col("a"), 1)).alias("bad"))
        assert urls.threshold_of(rows) == pytest.approx(urls.calibrate(scores))


def test_mixing_meets_its_targets(spark):
    random.seed(3)
    rows = [(i, "word and text here. " * random.randint(5, 40)) for i in range(300)] + [(1000 + i, "### | *** " * 30) for i in range(100)] + [(2000 + i, "stupid text of words here. " * 20) for i in range(100)] + ODD
    labels = spark.createDataFrame([(d, 0 if 1000 <= (d or 0) < 2000 else 1, 1 if (d or 0) >= 2000 else 0) for d, _ in rows[:500]], "doc_id long, quality int, toxic int")
    found = mixing.rates(frame(spark, rows), labels, [0.6, 0.2, 0.2], 0.5).collect()
    total = sum(r.n_tokens for r in found)
    for name, share in zip(mixing.DOMAINS, (0.6, 0.2, 0.2)):
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{name}"] for r in found) / total - 0.5 * share) < 0.01
    assert len(found) == len(rows) and all(r.rate >= 0 for r in found)
    assert mixing.rates(frame(spark, []), labels, [1, 1, 1], 0.5).count() == 0


def test_mixing_bears_a_target_out_of_reach(spark):
    # hardly a token of the second domain, and rates of at least 1 hold the third above its target
    low, toxic = np.array([0.0005 * (1 + i % 12) for i in range(100)]), np.array([0.03] * 90 + [0.748] * 10)
    chance, names = np.stack([1 - low - toxic, low, toxic], 1), ["n_tokens", "p_good", "p_low", "p_toxic"]
    members = spark.createDataFrame([(100, *map(float, p)) for p in chance], "n_tokens long, p_good double, p_low double, p_toxic double")
    start, moves = mixing.solve(members, names, [0.92, 0.05, 0.03], 1.1, 1.0, 2.0)
    found = members.withColumn("rate", mixing.rate_of(names, start, moves, 1.0, 2.0)).collect()
    rates = np.full(100, 1.1)
    for _ in range(20000):  # the plain least squares, by small steps
        rates = np.clip(rates - chance @ (chance.T @ rates / 100 - 1.1 * np.array([0.92, 0.05, 0.03])), 1, 2)
    for k, name in enumerate(names[1:]):
        assert abs(sum(r.rate * r[name] for r in found) - rates @ chance[:, k]) < 100 * 0.05
    assert all(r.rate == 1 for r in found if r.p_toxic > 0.5)


def test_pipeline_mixes_a_rare_domain_up_to_three_times(spark, tmp_path):
    good, low = [(i, f"plain words of a good text {i} here. " * 8) for i in range(15)], [(1000 + i, "### | *** " * 30) for i in range(285)]
    spark.createDataFrame([(d, int(d < 1000), 0) for d, _ in good + low], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = Counter(r.doc_id for r in corpus_pipeline.mix(spark, frame(spark, good + low), str(tmp_path)).collect())
    assert {found[d] for d, _ in good} == {3} and all(1 <= found[d] <= 3 for d, _ in low)


@pytest.mark.parametrize("most", [4000, 1])
def test_repeats_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffixes, "MOST_RUNS", most)
    random.seed(3)
    word = lambda n: "".join(random.choice("abcdé \n") for _ in range(n))
    passages = [word(n) for n in (399, 400, 401, 408, 700, 1500, 3000)]
    rows = ODD[:8] + [(i, word(random.randrange(900)) + random.choice(passages) + word(random.randrange(300)) + (random.choice(passages)[random.randrange(200) :] if i % 3 else "")) for i in range(90)] + [(902, "a" * 1200), (903, "ab" * 700), (904, passages[4]), (904, passages[4]), (905, "a" * 400)]
    count = Counter(b[i : i + 400] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - 399))
    wanted = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if count[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        wanted.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    assert rows_of(suffixes.remove_repeats(frame(spark, rows)), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) == sorted(wanted, key=str)


@pytest.mark.parametrize("name", ["jaccard", "flac", "bpe", "counts", "repeats", "score"])
def test_empty_tables_and_only_empty_texts(spark, name):
    path, pattern = public_tokenizers.path, public_tokenizers.PATTERN
    run = {
        "jaccard": jaccard.components_of,
        "flac": lambda d: flac.digest(flac.decode(flac.store(d))),
        "bpe": lambda d: bpe.round_trip(d, path("byte_bpe_50k.tiktoken"), pattern),
        "counts": lambda d: token_counts.token_counts(d, path("byte_bpe_50k.json"), pattern, 1024),
        "repeats": suffixes.remove_repeats,
        "score": pseudo.score,
    }[name]
    assert run(frame(spark, [])).count() == 0
    assert run(frame(spark, [(1, None), (2, ""), (None, None), (2, "")])).count() == 4


def test_stages_bear_empty_tables_nulls_and_clashing_names(spark, tmp_path):
    schema = "doc_id long, text string, _tokens_f string, _Counts string, _base_spans string, c0 string, _at long, key long, component string"
    words = "Plain words of a good text stand here, and they all end with one more line of words. "
    rows = [(d, t, "f", "c", "s", "z", 5, 7, "q") for d, t in ODD + [(50 + k, words + words + str(k)) for k in range(6)]]
    spark.createDataFrame([(50, 1, 0), (51, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        for some in ([], rows):
            docs = spark.createDataFrame(some, schema)
            out = stage(spark, docs, str(tmp_path))
            found = out.collect()
            assert len(found) == 0 or some
            if out.columns != ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]:
                assert out.columns == docs.columns and all((r._tokens_f, r.c0, r["_at"], r["key"]) == ("f", "z", 5, 7) for r in found)


def test_long_texts_cross_chunks_and_segments(spark):
    random.seed(10)
    long = " ".join(f"w{random.randrange(10**6)}" for _ in range(620_000))
    changed = long.replace(" w1", " v1", 200)
    rows = [(1, long), (2, changed), (3, "short " + long[1_000_000:1_000_900])]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(frame(spark, rows)).collect()}
    w = [t.split() for _, t in rows]
    sets = [{tuple(x[i : i + 4]) for i in range(len(x) - 3)} for x in w]
    assert found[1] == (len(sets[0]), 1) and found[3] == (len(sets[2]), 3)
    assert found[2] == (len(sets[1]), 1 if 100 * len(sets[0] & sets[1]) >= 85 * len(sets[0] | sets[1]) else 2)
    twice = [(1, "ab" * 10 + long + "x"), (2, long[300_000:4_500_000] + "y"), (3, "nothing")]
    found = {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.remove_repeats(frame(spark, twice)).collect()}
    assert found == {1: (4_200_000, 1), 2: (4_200_000, 1), 3: (0, 0)}


def test_pipeline_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == names
        if name == "ngram_jaccard":
            parts = {r.doc_id: r.component_id for r in jaccard.components_of(before, 5, 80).collect()}
            assert {r.doc_id for r in docs.collect()} == {d for d, c in parts.items() if d == c}
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and docs.count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_duckdb(spark, name):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    wanted = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(tuple(r) for r in queries.QUERIES[name](spark, DATA).select(*wanted.columns).collect()) == sorted(wanted.fetchall())


#: What the contracts fix and SQL can say of queries that fit models or write formats otherwise.
FIXED = {
    "op2_quality_rules": r"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        g AS (SELECT doc_id, i, list_aggregate(w[i:i + 7], 'string_agg', chr(32)) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
        c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1)) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
            coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(c.n, 0) > 30 * len(w) AS base_failed
        FROM w LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op4_media_columns": """
        SELECT doc_id, n AS n_bytes, size AS payload_bytes, sha256(from_hex(h || repeat('FF', (size - n)::BIGINT))) AS payload_sha256
        FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n, (greatest(1, ceil(strlen(coalesce(text, '')) / 576)) * 576)::BIGINT AS size FROM documents)""",
    "op7_url_filters": r"""
        WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p)
        SELECT page_id, host, path, CASE WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/' WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
            WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/' WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM h""",
    "op8_token_counts": "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents",
}


@pytest.mark.parametrize("name", sorted(FIXED))
def test_fixed_columns_same_as_duckdb(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages"):
        duck.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    wanted = duck.sql(FIXED[name])
    assert sorted((tuple(r) for r in queries.QUERIES[name](spark, DATA).select(*wanted.columns).collect()), key=str) == sorted(wanted.fetchall(), key=str)
