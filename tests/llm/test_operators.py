"""The operators against plain versions on small tables with nulls, empty and long texts, ties and repeated rows."""

import base64
import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from recollect.llm import bpe, decontaminate, graph, jaccard, licenses, media, queries, secrets, sharding, spans, stages, suffixes, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RANKS = P.path("byte_bpe_50k.tiktoken")
DATA = "/root/testdata/sf0.001"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string")


def prose(seed, words):
    q = random.Random(seed)
    return " ".join(q.choice(["Alpha", "beta", "gamma", "délta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) + str(q.randrange(60)) + q.choice(["", "", "", ".", ",", ".\n"]) for _ in range(words))


@pytest.fixture(scope="module")
def rows():
    base = [prose(i, 30 + 13 * i) for i in range(20)]
    near = [b.replace("beta1", "other") for b in base[5:12]]
    mixed = [base[12] + " " + base[3][:400], base[3][:400] + base[13]]
    out = list(enumerate(base + base[:4] + near + mixed + ["", None, " \n\t", "one two", "One Two", "a" * 3000, "x y " * 4000]))
    return out + [out[3], (None, base[2]), (None, None)]


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, rows):
    own = encoding()
    for r in bpe.decode(bpe.encode(table(spark, rows), RANKS, P.PATTERN), RANKS).collect():
        assert list(r["ids"]) == own.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode() and r["n_tokens"] == len(r["ids"])
    encoder = bpe._encoder(bpe.read_ranks(RANKS), P.PATTERN)
    for t in ["    \n\n\t  x", " " * 300, "漢字😀" * 20, "\x00ÿ", "don't 123 !!??", " a", "a ", "a  b\n c \n d\n\n  e  ", "\x1c a\x85 b　 c"]:
        assert encoder.encode(t) == own.encode_ordinary(t)


def test_bpe_edits():
    vocabulary = bpe._encoder(bpe.read_ranks(RANKS), P.PATTERN).vocabulary
    q = random.Random(1)
    for _ in range(60):
        data = bytes(q.choice(b"the andingtion") for _ in range(q.randint(0, 400)))
        held = bpe.Prefixes(vocabulary, data)
        a = q.randint(0, len(data))
        b, new = q.randint(a, len(data)), bytes(q.choice(b"theing") for _ in range(q.randint(0, 5)))
        held.replace(a, b, new)
        whole = data[:a] + new + data[b:] + b"tion"
        held.append(b"tion")
        assert held.tokens() == bpe.Prefixes(vocabulary, whole).tokens() and held.last == bpe.Prefixes(vocabulary, whole).last


def test_bpe_columns():
    """Many pieces at once give the same last tokens as one by one, and many texts the same ids as tiktoken."""
    own, encoder, q = encoding(), bpe._encoder(bpe.read_ranks(RANKS), P.PATTERN), random.Random(5)
    texts = ["".join(q.choice(" \n\ta'sé漢1!Bth") for _ in range(q.randint(0, 200))) for _ in range(300)] + ["", "b" * 64 + " " + "c" * 65 + " " + "=" * 900]
    tokens, counts = encoder.encode_all(texts)
    parts = np.split(tokens, np.cumsum(counts)[:-1])
    assert [x.tolist() for x in parts] == [own.encode_ordinary(x) for x in texts] and encoder.encode_all([])[0].tolist() == []
    pieces = [bytes(q.choice(b"the andingtion") for _ in range(q.randint(1, 64))) for _ in range(200)]
    last = encoder.columns.last(np.frombuffer(b"".join(pieces), np.uint8), np.array(list(map(len, pieces))))
    assert last.tolist() == [x for piece in pieces for x in bpe.Prefixes(encoder.vocabulary, piece).last]


def test_jaccard(spark, rows):
    given = [(i, t) for i, t in rows if i is not None]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(table(spark, rows), 4, 85).where("doc_id is not null").collect()}
    sets = {}
    for i, t in given:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} - {()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert got == {(i, len(sets[i]), find(i)) for i in sets}
    assert jaccard.join(table(spark, []), 4, 85).count() == 0


def test_jaccard_blocks(spark, monkeypatch):
    words = prose(9, 120).split()
    near = [(i, " ".join(words[:60] + [f"w{i}"] + words[61:])) for i in range(40)]
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    assert {r["component_id"] for r in jaccard.join(table(spark, near), 4, 85).collect()} == {0}


def test_jaccard_texts_of_one_doc_id_link(spark):
    a, b = prose(1, 100), prose(2, 90)
    got = jaccard.join(table(spark, [(5, a), (5, b), (3, b), (9, a), (9, ""), (None, a), (7, None)]), 4, 85).where("doc_id is not null").collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(3, 3), (5, 3), (5, 3), (7, 7), (9, 3), (9, 9)]


@pytest.mark.parametrize("stars", [0, 2])
def test_jaccard_at_the_border(spark, monkeypatch, stars):
    """Chains of texts that link with their neighbours only, with and without rounds of stars, in small blocks."""
    monkeypatch.setattr(jaccard, "STARS", stars)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    words = [f"w{i}" for i in range(400)]
    given = [(100 * c + i, " ".join(words[100 * c + 5 * i : 100 * c + 5 * i + 90])) for c in range(3) for i in range(12)]
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(87)} for i, t in given}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {r["doc_id"]: r["component_id"] for r in jaccard.join(table(spark, given), 4, 85).collect()} == {i: find(i) for i in sets}


def test_one_of_each_keeps_rows_without_doc_id_and_texts_of_one_doc_id(spark):
    a, b, c = prose(1, 100), prose(2, 90), prose(3, 80)
    alone = [(None, a), (None, b), (None, b), (None, None), (None, "")]
    once = [(1, a), (2, a + " end"), (3, b), (3, b), (4, None)]
    assert sorted([(r["doc_id"], r["text"]) for r in jaccard.one_of_each(table(spark, once + alone)).collect()], key=str) == sorted([(1, a), (3, b), (4, None), *alone], key=str)
    shared = [(1, a), (2, a + " end"), (2, b), (2, b), (2, c), (3, c), (4, None), (4, "")]
    got = jaccard.one_of_each(table(spark, shared + alone))
    assert got.columns == ["doc_id", "text", "lang"]
    assert sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=str) == sorted([(1, a), (2, b), (2, c), (4, None), (4, ""), *alone], key=str)


def test_components(spark):
    q = random.Random(2)
    edges = [(q.randrange(50), q.randrange(50)) for _ in range(25)] + [(i, i + 1) for i in range(100, 130)]
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got and all(got[x] == find(x) for x in got)


def brute_repeats(rows, length):
    count, texts = collections.Counter(), [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        count.update(b[s : s + length] for s in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        away = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                away[s : s + length] = b"\1" * length
        kept = bytes(x for x, f in zip(b, away, strict=True) if not f)
        out.append((i, len(b), sum(away), len(re.findall(b"\1+", bytes(away))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [8192, 3])
def test_suffixes(spark, rows, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    assert sorted([tuple(r) for r in suffixes.digests(table(spark, rows), 200).collect()], key=str) == brute_repeats(rows, 200)


def test_every_string_has_an_anchor(monkeypatch):
    monkeypatch.setattr(suffixes.arrow, "SLICE_BYTES", 3000)
    q = random.Random(6)
    texts = [bytes(q.choice(b"ab") for _ in range(900)), b"z" * 700, b"xyz" * 300, b"short", b"", bytes(q.choice(b"abcdefgh ") for _ in range(9000))]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    seen = collections.Counter()
    for zero, part, own in suffixes._blocks(data, at, 200):
        places, _, first, last = suffixes.anchor_places(part, own, 200)
        for p, a, b in zip(places, first, last, strict=True):
            assert b - a < 177 and a <= p < a + 177 and b <= p
            seen.update(range(zero + a, zero + b + 1))
    wanted = {s for a, b in zip(at[:-1], at[1:], strict=True) for s in range(a, b - 199)}
    assert set(seen) == wanted and all(seen[s] == 1 for s in wanted if at[3] <= s)


def test_spans(spark, rows):
    got = spans.clean(table(spark, rows)).where("doc_id is not null").collect()
    first, covered, counts = {}, collections.defaultdict(set), {}
    for i, t in sorted({(i, t) for i, t in rows if i is not None and t}):
        s = [tuple(WORD.findall(x)) for x in re.split(r"(?<=[.!?])(?=[ \t\n\x0b\x0c\r])|(?<=\n)", t.translate(LOW))]
        s = [x for x in s if x]
        counts[i] = len(s)
        for a in range(len(s)):
            b = n = 0
            b = a
            while b < len(s) and (b - a < 2 or n < 20):
                n, b = n + len(s[b]), b + 1
            if (b - a >= 2 and n >= 20) or a == 0:
                if first.setdefault(tuple(s[a:b]), (i, a)) != (i, a):
                    covered[i] |= set(range(a, b))
    assert sum(map(len, covered.values())) > 0
    for r in got:
        assert (r["n_sentences"], r["n_removed"]) == (counts.get(r["doc_id"], 0), len(covered[r["doc_id"]]))
        assert r["n_removed"] or r["text"] == dict(rows)[r["doc_id"]]
        assert not (r["n_removed"] and r["n_removed"] == r["n_sentences"]) or r["text"] == ""


def test_spans_cover_all_runs(spark, rows):
    tail = [(800, "Own start. " + "One two three four five six seven eight nine ten. " * 2 + "Last one here. Very last. Other end."), (801, "Ten more. " + "One two three four five six seven eight nine ten. " * 2 + "Last one here. Very last. No more.")]
    given = [*rows, *tail]
    first, covered, texts = {}, collections.defaultdict(set), {}
    for i, t in sorted({(i, t) for i, t in given if i is not None and t}):
        s = [tuple(WORD.findall(x)) for x in re.split(r"(?<=[.!?])(?=[ \t\n\x0b\x0c\r])|(?<=\n)", t.translate(LOW))]
        texts[i] = s = [x for x in s if x]
        for a in range(len(s)):
            for b in range(a + 1, min(len(s), a + 40) + 1):
                long = b - a >= 2 and sum(map(len, s[a:b])) >= 20
                if (long or (a, b) == (0, len(s))) and first.setdefault(tuple(s[a:b]), (i, a)) != (i, a):
                    covered[i] |= set(range(a, b))
    got = {r["doc_id"]: {x for p in r["removed"] for x in range(p["start"], p["end"])} for r in spans.clean(table(spark, given), True).where("doc_id is not null").collect()}
    assert got == {i: covered[i] for i in dict(given) if i is not None}
    assert got[801] >= {3, 4} and not got[800] - {2}


def test_decontamination(spark):
    passages = [prose(100 + i, 25 + i) for i in range(6)]
    docs = [(i, f"{prose(i, 80)} {passages[i % 6] if i % 2 else ''} {prose(50 + i, 40)}") for i in range(20)] + [(90, None), (91, ""), (92, passages[0]), (None, passages[1])]
    edited = passages[2].split()
    edited[0] = "changed"
    docs.append((93, f"{prose(7, 60)} {' '.join(edited)} tail"))
    items = spark.createDataFrame([*enumerate(passages), (8, None), (9, "two words")], "item_id long, text string")
    docs.append((94, "it has two words in it"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(table(spark, docs), items).collect()}
    assert got == {(i, i % 6) for i in range(20) if i % 2} | {(92, 0), (93, 2), (94, 9)}
    assert decontaminate.clean(table(spark, docs), items).where("doc_id % 2 = 0 and doc_id < 20").count() == 10
    assert decontaminate.matches(table(spark, docs), items.where("false")).count() == 0


def test_decontamination_finds_what_all_pairs_find(spark):
    """Every window of an item's length against every item, by the weighted similarity alone."""
    q = random.Random(12)
    passages = [prose(300 + i, q.randint(15, 60)) for i in range(40)]
    docs = []
    for i in range(120):
        words = passages[i % 40].split()
        for _ in range(i // 40):
            words[q.choice([0, 1, len(words) - 2, len(words) - 1])] = f"new{q.randrange(99)}"
        docs.append((i, f"{prose(i, 30)} {' '.join(words)} {prose(900 + i, 25)}"))
    items = list(enumerate(passages))

    def grams(words):
        return collections.Counter(tuple(words[j : j + 5]) for j in range(len(words) - 4))

    wanted = set()
    for i, t in docs:
        own = WORD.findall(t.translate(LOW))
        for item, p in items:
            words = WORD.findall(p.translate(LOW))
            there = grams(words)
            for s in range(len(own) - len(words) + 1):
                here = grams(own[s : s + len(words)])
                shared = sum((here & there).values())
                if shared >= 0.8 * (sum(here.values()) + sum(there.values()) - shared):
                    wanted.add((i, item))
                    break
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(wanted) > 60 and got <= wanted and len(got) >= 0.9 * len(wanted)


def test_block_index_misses_nothing(spark):
    q = random.Random(4)
    high, low = q.getrandbits(63), q.getrandbits(63)
    near = []
    for n in range(20):
        bits = q.sample(range(126), 31)
        h, lo = high, low
        for b in bits:
            h, lo = (h ^ (1 << b), lo) if b < 63 else (h, lo ^ (1 << (b - 63)))
        near.append((n, n, 20, h, lo))
    item = spark.createDataFrame([(0, 20, high, low)], "item_id long, long int, high long, low long")
    seen = spark.createDataFrame(near, "doc_id long, start int, long int, high long, low long")
    parts = seen.select("doc_id", "high", "low", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("block")).withColumn("value", decontaminate._value())
    assert parts.join(decontaminate.index(item), ["block", "value"]).select("doc_id").distinct().count() == 20


def brute_secrets(t):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def test_secrets(spark, rows):
    key, blob = "AKIA" + "Q2" * 9, "aB3dE6gH9jK2mN5pQ8sT1vW4"
    extra = [(500, f'é😀 Token = "{"9f86d081" * 5}" {key} password:abcdefgh secret=short'), (501, f"value {blob} done"), (502, f"commit {blob}"), (503, "0123456789abcdef" * 300)]
    got = {r["doc_id"]: r for r in secrets.digests(table(spark, rows + extra)).collect() if r["doc_id"] is not None}
    for i, t in [*rows, *extra]:
        if i is not None:
            spans_ = brute_secrets(t or "")
            assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans_).encode()).hexdigest()
            assert got[i]["n_assign"] == sum(s[3] == "assign" for s in spans_)
    assert got[501]["spans"] == f"entropy_mixed:6:{6 + len(blob)}" and got[502]["spans"] == ""
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(table(spark, extra)).collect()}
    assert masked[501] == "value [SECRET] done" and key not in masked[500] and masked[500].startswith("é😀 [SECRET]")


def test_secrets_in_long_candidates(spark):
    q = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    blob = "".join(q.choice(letters) for _ in range(1_000_000))
    digits = "".join(q.choice("0123456789abcdef") for _ in range(1_000_000))
    long = [(1, "/aB" * 300_000), (2, "/aB" * 300_000 + "4"), (3, blob), (4, digits), (5, "password=abcdefg1 " * 20_000), (6, "z" * 1_000_000), (7, "0a1b2c3d4e5f6g7h8i9j0k1l2m3n"), (8, "ABCDEFGH23456JKLMNPQ7XYZ22")]
    got = {r["doc_id"]: r for r in secrets.digests(table(spark, long)).collect()}
    assert got[1]["spans"] == "" == got[6]["spans"] and got[2]["spans"] == ""
    assert got[3]["spans"] == "entropy_mixed:0:1000000" and got[4]["n_hex"] == 1 and got[5]["n_assign"] == 20_000
    assert got[7]["spans"] == "entropy_lower:0:28" and got[8]["spans"] == "entropy_upper:0:26"
    assert secrets.redact(table(spark, long[4:5])).first()["text"] == "[SECRET] " * 20_000


def test_entropy_counts(spark):
    text = "aB3dE6gH9jK2mN5pQ8sT1vW4aaaa"
    got = spark.createDataFrame([(text,)], "t string").select(secrets.highest_entropy(F.col("t"), 20).alias("x")).first()["x"]
    plain = max(-sum(n / 20 * np.log2(n / 20) for n in collections.Counter(text[s : s + 20]).values()) for s in range(len(text) - 19))
    assert got == pytest.approx(plain)


def test_sharding(spark, rows):
    got = sharding.digests(table(spark, rows), 5).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    groups = collections.defaultdict(set)
    for r in got:
        groups[r["text_crc32"], r["size"]].add(r["shard"])
    assert max(map(len, groups.values())) == 1 and sharding.digests(table(spark, [])).count() == 0


def test_shards_are_as_small_as_can_be(spark, rows):
    """The largest shard against a search over all capacities, on the groups in the order of the operator."""
    got = sharding.ordered(table(spark, rows)).collect()
    sizes = collections.OrderedDict()
    for r in sorted(got, key=lambda r: r["row"]):
        sizes[r["group"]] = sizes.get(r["group"], 0) + r["size"]
    capacity = max(sizes.values())
    while True:
        n = held = 0
        for x in sizes.values():
            n, held = (n + 1, x) if n == 0 or held + x > capacity else (n, held + x)
        if n <= 5:
            break
        capacity += 1
    out = collections.Counter()
    for r in sharding.shards(table(spark, rows), 5).collect():
        out[r["shard"]] += r["size"]
    assert max(out.values()) == capacity and sum(out.values()) == sum(sizes.values())


def test_capacity_is_minimal():
    for seed in range(200):
        q = random.Random(seed)
        sizes = [q.choice([1, 5, 9, 100, 1000]) for _ in range(q.randint(1, 300))]
        ends, count = np.cumsum(sizes).tolist(), q.choice([1, 3, 24])

        def needed(capacity, sizes=sizes):
            n, held = 1, 0
            for x in sizes:
                n, held = (n + 1, x) if held + x > capacity else (n, held + x)
            return n

        own = sharding.Prefixes(ends, [False] * len(ends))
        capacity = sharding.smallest_capacity(own.surely, count, ends[-1], max(max(sizes), -(-ends[-1] // count)))
        assert needed(capacity) <= count and (capacity == max(sizes) or capacity == -(-ends[-1] // count) or needed(capacity - 1) > count)
        cuts = [0, *sharding.even_cuts(ends, capacity, count), ends[-1]]
        assert all(0 <= b - a <= capacity for a, b in zip(cuts, cuts[1:], strict=False))


def test_few_points_find_the_same_cuts(spark):
    sizes = [random.Random(5).choice([1, 7, 90]) for _ in range(300)]
    ends = np.cumsum(sizes).tolist()
    frame = spark.createDataFrame(list(zip(ends, sizes, strict=True)), "end long, bytes long")
    assert sharding.find_cuts(frame, 7, 5)[0] == sharding.find_cuts(frame, 7, 10_000)[0]


def test_media(spark, rows):
    given = dict(rows)
    stored = media.decode(media.encode(table(spark, rows[:-3]))).collect()
    for r in stored:
        data = (given[r["doc_id"]] or "").encode()
        assert bytes(r["payload"]) == data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data)) and r["n_bytes"] == len(data)
        assert len(r["rgb"]) == r["height"] * r["width"] * 3 and bytes(r["media"][:2]) == b"\xff\xd8"
        assert r["sums"] == np.frombuffer(r["rgb"], np.uint8).reshape(-1, 3).sum(axis=0).tolist()
    got = {r["doc_id"]: r for r in media.digests(table(spark, rows[:-3])).collect()}
    for r in stored:
        own = got[r["doc_id"]]
        assert (own["payload_sha256"], own["media_sha256"], own["tail_crc32"]) == (hashlib.sha256(r["payload"]).hexdigest(), hashlib.sha256(r["media"]).hexdigest(), zlib.crc32(r["payload"][-16:]))
        assert own["feature"] == f"{r['height']}x{r['width']}:{':'.join(map(str, r['sums']))}:{zlib.crc32(bytes(r['rgb'])):08x}"


def test_media_tensor_by_a_plain_reader():
    """Pixel by pixel from the coefficients that the payload stands for, without the reader's arrays."""
    payload = bytes(range(256)) + b" " * 128
    (read_back, tensor), = media.read(media.write([payload]))
    assert read_back == payload and tensor.shape == (16, 16, 3)
    blocks = []
    for start in range(0, 384, 64):
        own = [b if b >= 128 else b - 255 for b in payload[start : start + 64]]
        own[0] = payload[start] if payload[start] >= 128 else payload[start] - 254
        square = np.zeros(64)
        square[media.ZIGZAG] = own
        half = np.array([[(np.sqrt(0.5) if u == 0 else 1) / 2 * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
        blocks.append(np.clip(np.rint(half.T @ square.reshape(8, 8) @ half + 128), 0, 255))
    for y in range(16):
        for x in range(16):
            luma, blue, red = blocks[2 * (y // 8) + x // 8][y % 8, x % 8], blocks[4][y // 2, x // 2] - 128, blocks[5][y // 2, x // 2] - 128
            wanted = np.clip([luma + 1.402 * red, luma - 0.344136 * blue - 0.714136 * red, luma + 1.772 * blue], 0, 255)
            assert np.abs(wanted - tensor[y, x]).max() <= 4


def test_samples_are_the_inverse_transform():
    q = np.random.default_rng(1)
    own = q.integers(-255, 256, (3, 64)).astype(np.int16)
    for block, got in zip(own, media.samples(own, np.ones((3, 64), np.int32)), strict=True):
        square = np.zeros(64)
        square[media.ZIGZAG] = block
        square = square.reshape(8, 8)
        half = np.array([[(np.sqrt(0.5) if u == 0 else 1) / 2 * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
        assert np.abs(np.clip(half.T @ square @ half + 128, 0, 255) - got).max() <= 1


def test_toxicity(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    docs = docs.union(spark.createDataFrame([(9000, None, "en", "s", 0), (9001, "", "en", "s", 0), (9002, "You are a stupid idiot, you pathetic worthless loser!", "en", "s", 9)], docs.schema))
    got = {r["doc_id"]: r for r in toxicity.digests(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert got[9002]["score"] > got[9001]["score"] == got[9000]["score"]
    assert toxicity.digests(docs, labels.where("false")).count() == docs.count()


def test_toxicity_on_rows_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").join(labels, "doc_id", "left_semi")
    got = toxicity.digests(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "score", "predicted").collect()
    good, bad = [r["score"] for r in got if r["toxic"]], [r["score"] for r in got if not r["toxic"]]
    assert len(good) > 3 and np.mean([[(x > y) + (x == y) / 2 for y in bad] for x in good]) >= 0.95
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) >= 0.9


def test_toxicity_with_few_labels(spark):
    docs = table(spark, [(i, "you pathetic stupid idiot" if i < 3 else prose(i, 20)) for i in range(30)])
    labels = spark.createDataFrame([(i, int(i < 3)) for i in range(30)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.fit(docs, labels).score(docs).collect()}
    assert min(got[i] for i in range(3)) > max(got[i] for i in range(3, 30))


def brute_licenses(t):
    own = WORD.findall((t or "").translate(LOW))
    found = [(i, label) for phrase, label in licenses.BASE for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split()]
    return len(own), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_licenses(spark, rows):
    extra = [(700, "Licensed under the Apache License, Version 2.0."), (701, "x CC BY-NC; cc by nc"), (703, "under the MIT license " * 3), (704, "the MIT license")]
    extra.append((702, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"))
    whole = licenses.TEMPLATES[0][1].split()
    extra += [(710, " ".join(whole[:60] + ["added"] + whole[60:])), (711, " ".join(whole[i] for i in sorted(range(len(whole)), key=lambda i: i * 7919 % len(whole))))]
    got = {r["doc_id"]: r for r in licenses.scan(table(spark, rows + extra)).collect()}
    assert len(licenses.scan(table(spark, rows + extra)).collect()) == len(rows + extra)
    for i, t in [*rows, *extra]:
        assert i is None or tuple(got[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == brute_licenses(t)
        assert i is None or (set(got[i]["base_labels"].split(",")) - {""} <= set(got[i]["labels"].split(",")) and 0 <= got[i]["score"] <= 1)
    assert (got[702]["base_labels"], got[702]["labels"]) == ("", "mit") and got[0]["labels"] == ""
    assert (got[710]["labels"], got[711]["labels"]) == ("mit", "")
    aligned = {r["doc_id"]: r["cover"] for r in licenses.spans(table(spark, extra), (("mit", licenses.TEMPLATES[0][1]),)).collect()}
    assert set(aligned) == {710} and 0.95 < aligned[710] < 1


def edited(q, body, most, noise):
    """The words of a template with up to `most` words put in, left out or replaced, and sometimes a run of words in one place."""
    own = list(body)
    for _ in range(q.randint(0, most)):
        i, kind = q.randrange(len(own)), q.randrange(3)
        own[i : i + (kind > 0)] = [q.choice(noise)] if kind < 2 else []
    if most and q.random() < 0.3:
        i = q.randrange(len(own))
        own[i:i] = [q.choice(noise) for _ in range(q.randint(1, 10))]
    return own


def test_edited_licenses_keep_their_label(spark):
    """Every template, long ones with up to 10 edits, between other words, once and twice; but where the words that tell it from another one are gone."""
    q, telling = random.Random(4), {"lgpl": "lesser", "agpl": "affero", "cc-by-nc": "noncommercial", "cc-by-sa": "sharealike"}
    noise = [f"w{i}" for i in range(300)] + "the of software and is in to license this a".split()
    rows, wanted = [], {}
    for label, body in licenses.TEMPLATES:
        body = body.split()
        for rep in range(12):
            own = edited(q, body, 10 if len(body) >= 60 else 2 if len(body) >= 24 else 0, noise)
            around = [[q.choice(noise) for _ in range(q.randrange(150))] for _ in range(2)]
            whole = around[0] + own + around[1] + (body if rep % 4 == 0 else [])
            if label not in telling or len(body) < 60 or own.count(telling[label]) == body.count(telling[label]):
                wanted[len(rows)] = label
                rows.append((len(rows), " ".join(whole)))
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(table(spark, rows)).collect()}
    assert len(wanted) > 500 and {i: (got[i], rows[i][1]) for i in wanted if got[i] != wanted[i]} == {}


def test_licenses_by_name_and_identifier(spark):
    rows = [(0, "// SPDX-License-Identifier: Apache-2.0"), (1, "SPDX-License-Identifier: GPL-3.0-or-later"), (2, "Licensed under MIT."), (3, "SPDX-License-Identifier: unknown"), (4, "licensed under something else"), (5, "mit")]
    assert {r["doc_id"]: r["labels"] for r in licenses.scan(table(spark, rows)).collect()} == {0: "apache-2", 1: "gpl", 2: "mit", 3: "", 4: "", 5: ""}


CLASH = ["score", "predicted", "base", "entropy", "covered", "row", "class", "_tox_p", "_covered", "_number", "_digest", "_secret_spans", "n"]


def clashing(spark, rows):
    """The rows twice, with columns of names that operators use within."""
    docs = table(spark, rows + rows)
    return docs.withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce("doc_id", F.lit(-1))) for c in CLASH})


def test_stages_with_nulls_repeated_rows_and_clashing_columns(spark, rows):
    docs = clashing(spark, rows)
    given = docs.columns
    for name, stage in stages.STAGES:
        out = stage(spark, docs, DATA)
        assert out.columns[: len(given)] == given, name
        for r in out.collect():
            assert all(r[c] == f"{c} {-1 if r['doc_id'] is None else r['doc_id']}" for c in CLASH), name
        empty = stage(spark, docs.where("false"), DATA)
        assert empty.columns[: len(given)] == given and empty.count() == 0, name
    cut_ = spans.clean(docs, True)
    assert cut_.columns[: len(given)] == given and all(r["covered"].startswith("covered ") for r in cut_.collect())


def test_empty_tables(spark):
    none, labels = table(spark, []), spark.read.parquet(f"{DATA}/labels.parquet")
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    for out in (spans.clean(none, True), decontaminate.matches(none, benchmark), bpe.digests(none, RANKS, P.PATTERN), jaccard.join(none, 4, 85), sharding.digests(none), secrets.digests(none), suffixes.digests(none), media.digests(none), toxicity.digests(none, labels), licenses.scan(none)):
        assert out.count() == 0


def test_pipeline_against_its_operators(spark):
    """Each stage on its own input keeps just the rows that its operator's results, taken apart, leave."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    ids = lambda frame: {r["doc_id"] for r in frame.select("doc_id").collect()}
    labels, benchmark = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("labels", "benchmark"))
    scored = toxicity.train(docs, labels).score(docs.select("doc_id", "text"))
    assert ids(stages.drop_toxic(spark, docs, DATA)) == ids(scored.where("score < 0.3"))
    found = jaccard.join(docs, 5, 80)
    one = ids(stages.drop_near_copies(spark, docs, DATA))
    assert one == {r["component_id"] for r in found.collect()} and len(one) < docs.count()
    leaks = ids(decontaminate.matches(docs, benchmark))
    assert ids(stages.drop_leaks(spark, docs, DATA)) == ids(docs) - leaks and leaks
    for r in stages.mask_secrets(spark, docs, DATA).join(docs.select("doc_id", F.col("text").alias("was")), "doc_id").collect():
        spans_ = brute_secrets(r["was"] or "")
        assert (r["text"] != r["was"]) >= bool(spans_) and all(r["was"][a:b] not in r["text"] for a, _, b, k in spans_)
    own = encoding()
    for r in stages.tokenize(spark, docs.limit(50), DATA).collect():
        assert list(r["ids"]) == own.encode_ordinary(r["text"] or "")


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    given = docs.columns
    for name, stage in stages.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == given, name
    out = stages.STAGES[-1][1](spark, docs, DATA)
    assert set(given) < set(out.columns) and out.count() > 100


def test_queries_are_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_its_sql(spark, name):
    frame = queries.queries()[name](spark, DATA)
    con = duckdb.connect()
    for name_of in ("documents", "conversations", "pages", "embeddings"):
        con.sql(f"create view {name_of} as select * from '{DATA}/{name_of}.parquet'")
    wanted = con.sql(queries.oracle_sql()[name])
    assert sorted(map(tuple, frame.select(*wanted.columns).collect()), key=str) == sorted(wanted.fetchall(), key=str)
