"""Registered queries of runs that change memories or their log: consolidation with its merges, proposals and log entries, and sending."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from recollect.operators import memory, merges
from recollect.plans.catalog import query, r6
from recollect.plans.more import WINNERS
from recollect.session import shared_folder
from recollect.sources import tables as t
from recollect.streaming import sync

NOW = t.NOW_MS
#: Pairs pr (repo, a, b, sim) from a threshold up, gone through in order: taken has those that merge.
GREEDY = """pm AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY sim DESC, a, b) AS n FROM pr WHERE sim >= {least}),
walk AS (SELECT DISTINCT repo, 0::BIGINT AS n, []::VARCHAR[] AS used, false AS good, NULL::VARCHAR AS a, NULL::VARCHAR AS b, 0.0::DOUBLE AS sim FROM pm
  UNION ALL SELECT repo, n, CASE WHEN good THEN list_concat(used, [a, b]) ELSE used END, good, a, b, sim FROM (SELECT pm.repo AS repo, pm.n AS n, used, NOT list_contains(used, pm.a::VARCHAR) AND NOT list_contains(used, pm.b::VARCHAR) AS good, pm.a::VARCHAR AS a, pm.b::VARCHAR AS b, pm.sim AS sim FROM walk JOIN pm ON pm.repo = walk.repo AND pm.n = walk.n + 1)),
taken AS (SELECT a, b, sim FROM walk WHERE good)"""
#: Each vector as it is, and two copies of two thirds of them that are tilted a little and somewhat more.
COPIES = "SELECT CAST(vec_id * 3 AS VARCHAR) AS id, label AS repo, embedding::DOUBLE[] AS e FROM embeddings UNION ALL SELECT CAST(vec_id * 3 + 1 AS VARCHAR), label, list_concat([embedding[1]::DOUBLE + 0.2], embedding[2:64]::DOUBLE[]) FROM embeddings WHERE vec_id % 3 < 2 UNION ALL SELECT CAST(vec_id * 3 + 2 AS VARCHAR), label, list_concat([embedding[1]::DOUBLE, embedding[2]::DOUBLE + 0.4], embedding[3:64]::DOUBLE[]) FROM embeddings WHERE vec_id % 3 > 0"
RUN = f"""{WINNERS}, vc AS (SELECT c.id AS id, c.repo AS repo, e FROM ({COPIES}) c JOIN mem ON mem.id = c.id WHERE valid_to IS NULL),
pr AS (SELECT * FROM (SELECT x.repo AS repo, x.id AS a, y.id AS b, round(list_cosine_similarity(x.e, y.e), 9) AS sim FROM vc x JOIN vc y ON x.repo = y.repo AND x.id < y.id) WHERE sim >= 0.85),
{GREEDY.format(least=0.95)},
chosen AS (SELECT 'merge' AS action, a, b, sim FROM taken UNION ALL SELECT 'propose', a, b, sim FROM pr WHERE sim < 0.95),
dec0 AS (SELECT action, CASE WHEN (-x.useful, -x.importance, x.created_at, x.id) < (-y.useful, -y.importance, y.created_at, y.id) THEN a ELSE b END AS winner, CASE WHEN (-x.useful, -x.importance, x.created_at, x.id) < (-y.useful, -y.importance, y.created_at, y.id) THEN b ELSE a END AS loser, sim AS similarity FROM chosen JOIN m x ON x.id = a JOIN m y ON y.id = b),
lost AS (SELECT loser FROM dec0 WHERE action = 'merge'),
dec AS (SELECT * FROM dec0 WHERE action = 'merge' UNION ALL SELECT * FROM dec0 WHERE action = 'propose' AND winner NOT IN (SELECT loser FROM lost) AND loser NOT IN (SELECT loser FROM lost) AND NOT EXISTS (SELECT 1 FROM prop WHERE (prop.winner = dec0.winner AND prop.loser = dec0.loser) OR (prop.winner = dec0.loser AND prop.loser = dec0.winner)))"""


def _copies(s, d):
    v = t.vectors(s, d).withColumn("embedding", F.col("embedding").cast("array<double>"))
    tilted = lambda place, by: F.transform("embedding", lambda x, i: F.when(i == place, x + by).otherwise(x)).alias("embedding")
    name = lambda k: (F.col("id") * 3 + k).cast("string").alias("id")
    rows = v.select(name(0), "repo", "embedding")
    return rows.union(v.where("id % 3 < 2").select(name(1), "repo", tilted(0, 0.2))).union(v.where("id % 3 > 0").select(name(2), "repo", tilted(1, 0.4)))


def _decisions(s, d):
    return merges.decisions(_copies(s, d), t.memories(s, d), memory.usefulness_scores(t.memory_events(s, d)), t.proposals(s, d))


def _merged(s, d):
    """Its merges alone."""
    return merges.merged(_copies(s, d), t.memories(s, d), memory.usefulness_scores(t.memory_events(s, d))).select("winner", "loser")


@query(f"{RUN} SELECT action, winner, loser, round(similarity, 6) AS similarity FROM dec", recursive=True)
def consolidation_run(s, d):
    """What a run over every vector and its tilted copies merges and proposes."""
    return _decisions(s, d).select("action", "winner", "loser", r6("similarity"))


@query(f"{RUN} SELECT mem.id AS id, coalesce(valid_to, CASE WHEN l.winner IS NOT NULL THEN {NOW} END) AS valid_to, l.winner AS superseded_by, w.loser AS derived_from FROM mem LEFT JOIN dec l ON l.action = 'merge' AND l.loser = mem.id LEFT JOIN dec w ON w.action = 'merge' AND w.winner = mem.id", recursive=True)
def consolidated_memories(s, d):
    """All memories after that run."""
    return merges.after(t.memories(s, d), _merged(s, d), NOW).select("id", "valid_to", "superseded_by", F.array_join("derived_from", ",").alias("derived_from"))


@query(f"{RUN} SELECT loser AS atom_id, 'supersede' AS event_type, '{{\"superseded_by\":\"' || winner || '\"}}' AS payload_json, {NOW} AS created_at FROM dec WHERE action = 'merge' UNION ALL SELECT loser, 'usefulness', '{{\"family\":\"memory_corrected\",\"action\":\"superseded\"}}', {NOW} FROM dec WHERE action = 'merge'", recursive=True)
def consolidation_events(s, d):
    """The log entries of that run."""
    return merges.events(_merged(s, d), NOW)


@query(f", pr AS (SELECT * FROM (SELECT x.label AS repo, x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS sim FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id) WHERE sim >= 0.3), {GREEDY.format(least=0.3)} SELECT a::BIGINT AS a, b::BIGINT AS b, round(sim, 6) AS similarity FROM taken", recursive=True)
def consolidation_merges(s, d):
    pairs = memory.near_pairs(t.vectors(s, d), 0.3, 0.3)
    return merges.greedy(pairs).select("a", "b", r6("similarity"))


ROUND = """n{k} AS (SELECT seq, (row_number() OVER (ORDER BY seq) - 1) // 200 AS batch FROM w{before}),
b{k} AS (SELECT {k} AS round, batch, first_seq, last_seq, events, CASE WHEN (first_seq + {k}) % 4 = 0 THEN NULL WHEN (first_seq + {k}) % 4 = 1 THEN middle ELSE last_seq END AS upto, (SELECT coalesce(max(seq), 0) FROM lg WHERE (synced_at IS NOT NULL OR seq IN (SELECT seq FROM w0)) AND seq < (SELECT min(seq) FROM w{before})) AS cursor
  FROM (SELECT batch, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS events, list_extract(list(seq ORDER BY seq), count(*) // 2 + 1) AS middle FROM n{k} GROUP BY batch)),
w{k} AS (SELECT seq FROM n{k} JOIN b{k} ON n{k}.batch = b{k}.batch WHERE upto IS NULL OR seq > upto)"""
SENT = f""", lg AS (SELECT id::BIGINT + 1 AS seq, id AS atom_id, CASE WHEN id::BIGINT % 13 = 0 THEN 'erase_request' ELSE 'create' END AS event_type, scope, CASE WHEN id::BIGINT % 9 = 4 THEN created_at END AS synced_at FROM mem),
w0 AS (SELECT seq FROM lg WHERE synced_at IS NULL AND scope IN ('team', 'org') AND (event_type = 'erase_request' OR atom_id::BIGINT % 26 <> 0)),
{", ".join(ROUND.format(k=k, before=k - 1) for k in (1, 2, 3))}, b AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3)"""


def _log(s, d):
    """One event for each memory, some sent already, and the memories that are left: some erasures have none."""
    rows = t.memories(s, d)
    n = F.col("id").cast("long")
    said = F.to_json(F.struct("scope", (n % 5).alias("n")))
    events = rows.select((n + 1).alias("seq"), F.when(n % 13 == 0, "erase_request").otherwise("create").alias("event_type"), F.col("id").alias("atom_id"), said.alias("payload_json"), F.col("hash").alias("content_hash"), "created_at", F.when(n % 9 == 4, F.col("created_at")).alias("synced_at"))
    return events, rows.where(n % 26 != 0)


def _receiver(k):
    """A receiver that fails, takes the first half or takes all, by an envelope's first number and the round."""

    def post(body):
        seqs = [e["seq"] for e in json.loads(body)["events"]]
        if (seqs[0] + k) % 4 == 0:
            raise ConnectionError("HTTP 503")
        return seqs[len(seqs) // 2] if (seqs[0] + k) % 4 == 1 else seqs[-1]

    return post


def _sent(s, d):
    folder = shared_folder(s, "sync")
    events, memories = _log(s, d)
    for k in (1, 2, 3):
        sync.ship_once(events, memories, folder, _receiver(k), sync.Sender("1", "device", "workspace"))
    return events, sync.receipts(s, folder)


@query(f"{SENT} SELECT round::INT AS round, batch, first_seq, last_seq, cursor, events::INT AS events, CASE WHEN upto IS NULL THEN 0 WHEN upto = last_seq THEN events ELSE events // 2 + 1 END::INT AS acked, CASE WHEN upto IS NULL THEN 'HTTP 503' END AS error FROM b")
def sync_receipts(s, d):
    """Three rounds of sending the log of all memories to a receiver that fails at times and takes parts at others."""
    return _sent(s, d)[1].withColumn("acked", F.size("acked"))


@query(f"{SENT} SELECT seq, synced_at IS NOT NULL AS before, synced_at IS NOT NULL OR (seq IN (SELECT seq FROM w0) AND seq NOT IN (SELECT seq FROM w3)) AS after FROM lg")
def synced_events(s, d):
    """The log after that."""
    events, sent = _sent(s, d)
    return sync.marked(events.withColumn("before", F.col("synced_at").isNotNull()), sent, t.NOW_MS).select("seq", "before", F.col("synced_at").isNotNull().alias("after"))
