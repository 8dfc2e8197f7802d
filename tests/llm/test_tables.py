"""The operators on conversations, pages and embeddings against plain versions and their SQL."""

import base64
import collections
import gzip
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import archives, balls, tries

DATA = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(rows, every=20, most=4):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs[conv].append(((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()), (role, text)))
    convs = {c: [turn for _, turn in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, v in convs.items():
        h = zlib.crc32(str(c).encode()) % most
        whole[c] = tuple(convs.get(int(c / every) * every, [])[:h] + v[h:])
    nodes = collections.defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            nodes[v[:d]].append(c)
    kids, leaves, saved = collections.Counter(k[:-1] for k in nodes if k), collections.Counter(), collections.Counter()
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
    ends = lambda k, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if whole[c] == k))).encode()).hexdigest()
    return sorted((min(m), len(k), str(min(nodes[k[:-1]]) if k else None), len(m), kids[k], leaves[k], saved[k], ends(k, m)) for k, m in nodes.items())


def got_trie(df):
    return sorted((r.conv_id, r.depth, str(r.parent_conv_id), *r[3:]) for r in tries.nodes(df).collect())


@pytest.mark.parametrize("seed", range(5))
def test_trie(spark, seed, monkeypatch):
    """Few different turns, so that intervals cross many blocks and nest; nulls, ties, repeated rows, and pieces of three turns."""
    monkeypatch.setattr(tries, "PIECE", 3)
    q = random.Random(seed)
    deep = [2, 9, 33][seed % 3]
    rows = []
    for c in range([90, 25, 60, 1, 120][seed]):
        for t in range(q.choice([1, deep, q.randrange(1, deep + 1)])):
            rows.append((c * 7 if seed % 2 else c - 5, q.choice([t, t, t, None, 1]), q.choice(["u", "u", None, ""]), q.choice(["a", "b  c", None]) if q.random() < 0.2 else "one two"))
    rows += rows[:4] + [(None, 1, "u", "x")] + [(1000, i, "u", "one two") for i in range(200)] + [(1001, 1, "u", "word " * 200_000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        df = spark.createDataFrame(rows, TURNS).withColumn("words", F.lit("x")).withColumn("codes", F.lit(1)).withColumn("at", F.lit(2))
        assert got_trie(df) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_of_one_conversation_and_of_none(spark):
    assert got_trie(spark.createDataFrame([], TURNS)) == []
    assert got_trie(spark.createDataFrame([(None, 1, "u", "x")], TURNS)) == []
    for rows in ([(3, None, None, None)], [(20, 1, "u", "x y")] * 2, [(5, 1, "u", "a"), (25, 1, "u", "a"), (45, 1, "u", "a")]):
        assert got_trie(spark.createDataFrame(rows, TURNS)) == plain_trie(rows)


def test_trie_of_the_table(spark):
    df = spark.read.parquet(f"{DATA}/conversations.parquet")
    assert got_trie(df) == plain_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def plain_pages(rows):
    firsts, out, used = {}, [], set()
    ordered = sorted(((p is None, p or 0, h or "") for p, _, h in rows))
    for none, p, h in ordered:
        firsts.setdefault(h, None if none else p)
    for none, p, h in ordered:
        shown = (None if none else p, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode())
        out.append((*shown, "revisit", firsts[h]) if h in used else (*shown, "response", None))
        used.add(h)
    return sorted(out, key=str)


PAGES = [(1, "http://a b\n", "<p>x\r\n\r\nWARC/1.1\r\n</p>"), (2, None, "<p>x\r\n\r\nWARC/1.1\r\n</p>"), (5, "", None), (3, "u", ""), (3, "u", ""), (None, "u", ""), (None, None, None), (7, "ü", "ü\n\n"), (8, "x", "HTTP/1.1 x\n\nfoo\nX-Page-Id: 9"), (9, "x", "\n"), (10, "x", " "), (11, "x", "y" * 3_000_000), (4, "x", "y" * 3_000_000), (-6, "x", "filedesc://a 1 2 3 4\n"), (12, "dns:a", "1")]


def test_warc(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("name", F.lit("x")).withColumn("value", F.lit(1)).withColumn("head", F.lit(2))
    for parts in (1, 4):
        assert sorted((tuple(r) for r in archives.digests(df.repartition(parts)).collect()), key=str) == plain_pages(PAGES)
    assert archives.digests(df.limit(0)).collect() == []


def test_warc_with_a_least_size(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert {r["page_id"] for r in archives.digests(df, least=5).where("record_type = 'revisit'").collect()} == {2, 11}


ABOUT = b"1 0 Old Library\nURL IP-address Archive-date Content-type Archive-length\n"
ARC1 = b"filedesc://old.arc 0.0.0.0 19961231235959 text/plain %d\n%s\nhttp://a/b c 1.2.3.4 199702 text/html 25\nHTTP/1.0 200 OK\n\nA\xff\n\nBCDE\ndns:a 1.2.3.4 19970203040506 text/dns 3\nabc\n\nftp://x 1.2.3.4 19970203040506 image/gif 2\n\x00\x01\nhttp://z 1.2.3.4 19970203040506 text/html 500\nHTTP/1.0 200 OK\r\n\r\ncut" % (len(ABOUT), ABOUT)
ARC2 = b"filedesc://new.arc 0.0.0.0 20010101000000 text/plain 200 - - 0 new.arc 123\n2 0 Old Library\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"


def test_arc_files_of_both_versions(spark, tmp_path):
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc/old.arc").write_bytes(ARC1)
    block = ARC2[ARC2.index(b"\n") + 1 :]
    new = ARC2.replace(b" 123\n", f" {len(block)}\n".encode(), 1) + b"\nhttp://a/b 5.6.7.8 20010101000000 text/html 200 - - 0 new.arc 25\nHTTP/1.0 200 OK\n\nA\xff\n\nBCDE\n"
    packed = io.BytesIO()
    for part in (new[: len(new) - 94], new[len(new) - 94 :]):
        with gzip.GzipFile(fileobj=packed, mode="wb") as f:
            f.write(part)
    (tmp_path / "arc/new.arc.gz").write_bytes(packed.getvalue())
    read = list(archives.arc_records(ARC1))
    assert [(r.version, r.fields["URL"], len(r.block), r.truncated) for r in read] == [(1, "filedesc://old.arc", len(ABOUT), False), (1, "http://a/b c", 25, False), (1, "dns:a", 3, False), (1, "ftp://x", 2, False), (1, "http://z", 22, True)]
    archives.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = {(r["uri"], r["record_type"]): r for r in archives.read_warc(spark, str(tmp_path / "warc")).collect()}
    assert set(got) == {("http://a/b c", "revisit"), ("http://a/b", "response"), ("dns:a", "response"), ("ftp://x", "resource"), ("http://z", "response")}
    again, kept = got["http://a/b c", "revisit"], got["http://a/b", "response"]
    assert again["refers_to_id"] == kept["id"] and again["payload_digest"] == kept["payload_digest"] == archives.digest(b"A\xff\n\nBCDE") and again["payload_bytes"] == 8
    assert again["date"] == "1997-02-01T00:00:00Z" and kept["date"] == "2001-01-01T00:00:00Z" and got["dns:a", "response"]["date"] == "1997-02-03T04:05:06Z"
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "warc").glob("*.gz"))
    assert raw.count(b"WARC-Type: warcinfo") == 2 and raw.count(b"WARC-Truncated: length") == 1 and raw.count(archives.PROFILE.encode()) == 1


@pytest.mark.parametrize("broken", [b"http://a 1 2 3 4\n", ARC1.replace(b"1 0 Old", b"7 0 Old"), ARC1.replace(b"text/dns 3", b"text/dns x")])
def test_broken_arc_files_are_named(broken):
    with pytest.raises(ValueError):
        list(archives.arc_records(broken))


def plain_clusters(rows, k, rounds, size):
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    centroids = [v for _, v in seeds]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda: [min(range(len(centroids)), key=lambda c: (away(v, centroids[c]), c)) for _, v in kept]
    for _ in range(rounds):
        own = near()
        for c in range(len(centroids)):
            members = [v for (_, v), x in zip(kept, own, strict=True) if x == c]
            if members:
                centroids[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    own = near()
    d = [away(v, centroids[c]) for (_, v), c in zip(kept, own, strict=True)]
    total = collections.Counter()
    for c, x in zip(own, d, strict=True):
        total[c] += x
    return sorted((str(i), c, x, total[c], sum(d), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), c, x in zip(kept, own, d, strict=True))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit(1)).withColumn("ids", F.lit(2))


@pytest.mark.parametrize("spread", [0.0, 0.02, 3.0])
def test_clusters(spark, spread, monkeypatch):
    """Tight groups go whole by their balls, wide ones by the leaves; nulls, wrong sizes, ties and repeated rows."""
    monkeypatch.setattr(balls, "TREE", 100)
    monkeypatch.setattr(balls, "LEAF", 5)
    q = np.random.default_rng(int(spread * 100))
    middles = q.normal(size=(6, 4)) * 4
    rows = [(int(i), [float(x) for x in middles[i % 6] + q.normal(size=4) * spread]) for i in range(400)]
    rows += rows[:30] + [(None, rows[0][1]), (1, None), (2, []), (3, [1.0] * 3), (4, [1.0, None, 1.0, 1.0]), (5, [1.0, float("nan"), 1.0, 1.0]), (6, [float("-inf")] * 4), (7, [0.0, -0.0, -0.001, 1000.0])]
    for k in (1, 7, 40):
        got = balls.cluster(vectors(spark, rows).repartition(3), k, 3, size=4).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == plain_clusters(rows, k, 3, 4)


def test_clusters_of_few_vectors_and_of_none(spark):
    assert balls.cluster(vectors(spark, []), 40, 5).collect() == balls.cluster(vectors(spark, [(1, [1.0])]), 40, 5).collect() == []
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-5.0, 0.5])]
    assert sorted((str(r[0]), *r[1:]) for r in balls.cluster(vectors(spark, rows), 40, 5, size=2).collect()) == plain_clusters(rows, 40, 5, 2)
    with pytest.raises(Exception, match="squared distances"):
        balls.cluster(vectors(spark, [(1, [1e30, 0.0])]), 1, 1, size=2).collect()


def test_whole_balls_and_exact_sizes():
    q = np.random.default_rng(3)
    v = np.concatenate([q.integers(-40, 40, (200, 8)) + 5000 * i for i in range(4)])
    order, starts, ends, lefts, radii, sums = (np.array(x) for x in balls.build(v))
    for scale in (1, balls.EXACT // 4):
        centroids = np.stack([v[:200].mean(0), v[200:400].mean(0), v[400:].mean(0)]).astype(np.int64) * scale
        near, whole = balls.assign(v[order] * scale, starts, ends, lefts, radii * scale, sums * scale, centroids)
        assert (near == np.square((v[order] * scale)[:, None].astype(object) - centroids[None].astype(object)).sum(2).argmin(1)).all()
        assert sum(ends[b] - starts[b] for b, _ in whole) > 700
