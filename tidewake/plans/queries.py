"""Queries over the driver's tables, and the same in SQL."""

from pyspark.sql import functions as F

from tidewake import streaming
from tidewake.operators import causal, cluster, fold, quorum, requests, ring, validate
from tidewake.plans import views
from tidewake.sources import shared, wal

NOW_US = 1705276800000000  # 2024-01-15
CAPACITY = 20


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def ring_owner(spark, sf_dir):
    return ring.place(views.keys(table(spark, sf_dir, "customer")), ring.points(spark, views.MEMBERS)).select("key", "pos", F.col("nodes")[0].alias("owner"))


def ring_owner_load(spark, sf_dir):
    return ring_owner(spark, sf_dir).groupBy("owner").agg(F.count(F.lit(1)).alias("n_keys"))


def ring_replicas(spark, sf_dir):
    placed = ring.place(views.keys(table(spark, sf_dir, "customer")), ring.points(spark, views.MEMBERS), 3)
    return placed.select("key", F.posexplode("nodes").alias("k", "node")).select("key", (F.col("k") + 1).cast("long").alias("k"), "node")


def ring_movement(spark, sf_dir):
    return ring.movement(views.keys(table(spark, sf_dir, "customer")), ring.points(spark, views.MEMBERS[:4]), ring.points(spark, views.MEMBERS))


def log_lww(spark, sf_dir):
    return fold.last_write(views.user_log(events(spark, sf_dir)))


def log_live_at(spark, sf_dir):
    return fold.live_at(log_lww(spark, sf_dir), NOW_US)


def flat(records):
    return records.select("key", "id", F.array_join("clock", ",").alias("clock"), "value", "deleted")


def causal_siblings(spark, sf_dir):
    return flat(causal.maximal(views.records(events(spark, sf_dir))))


def causal_context(spark, sf_dir):
    return causal.context(views.records(events(spark, sf_dir))).select("key", F.array_join("context", ",").alias("context"))


def causal_conflicts(spark, sf_dir):
    own = views.records(events(spark, sf_dir)).select("event_id", "key", "id", "clock", "value", "deleted")
    odd = own.where("event_id % 50 = 0").withColumn("value", F.concat(F.coalesce("value", F.lit("")), F.lit("x")))
    return causal.conflicts(own.unionByName(odd))


def quorum_read(spark, sf_dir):
    out = quorum.read(views.replica_state(events(spark, sf_dir)), views.replies(events(spark, sf_dir)), 2)
    return out.select("key", F.col("status").cast("long").alias("status"), "value", "siblings", F.array_join("context", ",").alias("context"))


def quorum_write(spark, sf_dir):
    out = quorum.write(views.replies(events(spark, sf_dir)), 2)
    return out.select("key", F.col("status").cast("long").alias("status"), F.array_join(F.transform("stored", lambda r: r.cast("string")), ",").alias("stored"))


def context_free_write(spark, sf_dir):
    out = quorum.write_without_context(views.replica_state(events(spark, sf_dir)), views.replies(events(spark, sf_dir)), 2, 2)
    return out.select("key", F.col("status").cast("long").alias("status"), F.array_join("context", ",").alias("context"))


def repair_rows(spark, sf_dir):
    return quorum.repairs(views.replica_state(events(spark, sf_dir)), views.replies(events(spark, sf_dir)), 2)


def replica_divergence(spark, sf_dir):
    return quorum.divergence(views.replica_state(events(spark, sf_dir)))


def lru_trace(spark, sf_dir):
    return fold.lru(views.ops(events(spark, sf_dir)), CAPACITY).drop("op")


def lru_hit_rate(spark, sf_dir):
    trace = lru_trace(spark, sf_dir)
    hit = (F.col("outcome") == "hit").cast("long")
    return trace.where(F.col("outcome").isin("hit", "miss", "expired")).groupBy("store").agg(F.count(F.lit(1)).alias("gets"), F.sum(hit).alias("hits"))


def durable_trace(spark, sf_dir):
    return fold.durable(views.ops(events(spark, sf_dir)), CAPACITY)


def durable_capacity(spark, sf_dir):
    return durable_trace(spark, sf_dir).drop("op")


def _logged(spark, sf_dir, only="true"):
    """Puts and deletes of the log, numbered without gaps in each store, as log files of some of them; and the log."""
    from pyspark.sql import Window

    log = views.ops(events(spark, sf_dir)).where("op <> 'get'")
    log = log.withColumn("seq", F.row_number().over(Window.partitionBy("store").orderBy("seq")).cast("long"))
    here = shared.folder(spark, "wal")
    put = F.col("op") == "put"
    log = log.withColumn("value", F.when(put, F.col("value"))).withColumn("expires_us", F.when(put & (F.col("ttl_us") > 0), F.col("at_us") + F.col("ttl_us")))
    wal.append(log.where(only), here)
    return here, log


def _store():
    return F.regexp_extract("path", r"store-(\d+)", 1).cast("long").alias("store")


def wal_scan(spark, sf_dir):
    log = wal.strict(wal.scan(spark, _logged(spark, sf_dir)[0]))
    return log.select(_store(), "seq", "op", "key", F.col("value").cast("string").alias("value"))


def recover_state(spark, sf_dir):
    state = wal.recover(spark, _logged(spark, sf_dir)[0])
    return state.select(_store(), "key", "seq", F.col("value").cast("string").alias("value"))


def recover_snapshot(spark, sf_dir):
    """Snapshots of all but store 3 at sequence 20, logs of them from 11 on: what is live at NOW_US."""
    here, log = _logged(spark, sf_dir, "store = 3 or seq > 10")
    then = log.where("store <> 3 and seq <= 20")
    top = then.groupBy("store").agg(F.max("seq").alias("boundary"))
    last = then.groupBy("store", "key").agg(F.max_by(F.struct("seq", "op", "value", "expires_us"), "seq").alias("e")).where("e.op = 'put'").select("store", "key", "e.seq", "e.value", "e.expires_us")
    wal.save_snapshots(top.join(last, "store", "left"), here)
    state = wal.recover(spark, here, NOW_US)
    return state.select(_store(), "key", "seq", F.col("value").cast("string").alias("value"), "expires_us")


def recover_siblings(spark, sf_dir):
    """Logs of version 2: each record of a key, with the one before it as a sibling where neither knows the other."""
    from pyspark.sql import Window

    sibling = F.struct("id", F.map_from_entries(F.transform("clock", lambda c: F.struct(c, F.lit(1).cast("long")))).alias("clock"), "value", "deleted")
    own = views.records(events(spark, sf_dir)).withColumn("own", sibling)
    alone = (F.size("clock") == 1) & F.col("before").isNotNull()
    own = own.withColumn("before", F.lag("own").over(Window.partitionBy("u").orderBy("event_id")))
    own = own.select((F.col("u") % 4).alias("store"), "event_id", F.lit("put").alias("op"), "key", F.lit(None).cast("string").alias("value"), F.when(alone, F.array("before", "own")).otherwise(F.array("own")).alias("siblings"))
    own = own.withColumn("seq", F.row_number().over(Window.partitionBy("store").orderBy("event_id")).cast("long"))
    here = shared.folder(spark, "wal")
    wal.append(own, here)
    return wal.recover(spark, here, NOW_US).select(_store(), "key", "seq", F.explode("siblings").alias("s")).select("store", "key", "seq", "s.id", F.array_join(F.array_sort(F.map_keys("s.clock")), ",").alias("clock"), "s.value", "s.deleted")


def wal_append(spark, sf_dir):
    """Logs of each store's first ten records, and the rest appended without numbers of their own."""
    here, log = _logged(spark, sf_dir, "seq <= 10")
    wal.extend(spark, log.where("seq > 10"), here)
    return wal.strict(wal.scan(spark, here)).select(_store(), "seq", "op", "key", F.col("value").cast("string").alias("value"))


def compacted_state(spark, sf_dir):
    """Logs of each store's first thirty records, compacted, and the rest appended: what is live at NOW_US."""
    here, log = _logged(spark, sf_dir, "seq <= 30")
    new = shared.folder(spark, "compacted")
    wal.compact(spark, here, new)
    wal.extend(spark, log.where("seq > 30"), new)
    return wal.recover(spark, new, NOW_US).select(_store(), "key", "seq", F.col("value").cast("string").alias("value"), "expires_us")


def _flat_state(df):
    return df.withColumn("clock", F.array_join("clock", ","))


def read_live(spark, sf_dir):
    """Reads at NOW_US as the API answers them, with the owner and replicas that head the answer."""
    out = quorum.read(views.replica_state(events(spark, sf_dir)), views.replies(events(spark, sf_dir)), 2, NOW_US)
    placed = ring.place(out, ring.points(spark, views.MEMBERS), 3)
    return placed.select("key", F.col("status").cast("long").alias("status"), "value", "siblings", F.array_join("context", ",").alias("context"), F.col("nodes")[0].alias("owner"), F.array_join("nodes", ",").alias("replicas"))


def _answers(spark, sf_dir):
    e = events(spark, sf_dir)
    return requests.apply_mutations(views.requests(e), views.replica_state(e), views.replies(e), views.replies(e), 2, 2)


def apply_mutations(spark, sf_dir):
    out = _flat_state(_answers(spark, sf_dir)).withColumn("status", F.col("status").cast("long"))
    return out.withColumn("stored", F.array_join(F.transform("stored", lambda r: r.cast("string")), ","))


def partial_commit(spark, sf_dir):
    """What failed writes leave on the replicas that took them."""
    return requests.effects(_answers(spark, sf_dir).where("status = 503")).select("key", F.col("rank").cast("long").alias("rank"), "id", "deleted")


def _delivered(spark, sf_dir):
    """Each record twice, the second time after later ones."""
    own = views.records(events(spark, sf_dir)).select((F.col("u") % 4).alias("store"), "event_id", "key", "id", "clock")
    return own.withColumn("seq", F.explode(F.array(F.col("event_id") * 2, F.col("event_id") * 2 + 2001))).drop("event_id")


def merge_capacity(spark, sf_dir):
    return causal.deliveries(_delivered(spark, sf_dir), 100)


def standalone_api(spark, sf_dir):
    trace = fold.responses(durable_trace(spark, sf_dir))
    return trace.groupBy("store", "op", F.col("status").cast("long").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def record_faults(spark, sf_dir):
    """Records of which some are made invalid."""
    own = views.records(events(spark, sf_dir)).withColumn("n", F.col("event_id") % 6)
    own = own.withColumn("id", F.when(F.col("n") == 0, "").otherwise(F.col("id"))).withColumn("clock", F.when(F.col("n") == 1, F.array(F.lit("other"))).when(F.col("n") == 2, F.concat("clock", F.array(F.lit("")))).otherwise(F.col("clock")))
    own = own.withColumn("expires_us", F.when(F.col("n") == 3, 1).otherwise(F.col("expires_us")))
    return validate.record_faults(own).select("event_id", "fault")


def ring_positions(spark, sf_dir):
    return ring.positions(ring.points(spark, views.MEMBERS)).withColumn("position", F.col("position").cast("string"))


def placement_preview(spark, sf_dir):
    request = '{"key":"user:1","nodes":["a","b","c"],"virtual_nodes":8,"replicas":2}'
    rows = cluster.preview(spark, request)[1]
    return rows.select("node", "idx", F.col("position").cast("string").alias("position"), F.col("key_position").cast("string").alias("key_position"), F.array_join("replicas", ",").alias("replicas"))


def _cluster():
    return cluster.Cluster("b", {n: f"http://{n}.example:8080" for n in views.MEMBERS})


def placement_report(spark, sf_dir):
    out = cluster.report(spark, views.keys(table(spark, sf_dir, "customer")), _cluster())
    return out.withColumn("key_position", F.col("key_position").cast("string")).withColumn("replicas", F.array_join("replicas", ","))


def cluster_fingerprints(spark, sf_dir):
    own = _cluster()
    return spark.range(1).select(F.lit(own.fingerprint()).alias("replicated"), F.lit(own.owner_fingerprint()).alias("single_owner"))


def fan_out(spark, sf_dir):
    asked = views.requests(events(spark, sf_dir)).select("req_id", "key")
    return cluster.fan_out(asked, ring.points(spark, views.MEMBERS), 3).withColumn("rank", F.col("rank").cast("long"))


def owner_routing(spark, sf_dir):
    n = F.col("req_id") % 7
    asked = views.requests(events(spark, sf_dir)).select("req_id", "node", "key", (n < 2).alias("internal"), F.when(n == 1, "old").otherwise("new").alias("config"), (n != 3).alias("reachable"), F.lit(204).alias("local_status"))
    out = cluster.owner_routing(asked, ring.points(spark, views.MEMBERS), "new")
    return out.select("req_id", "owner", "served_by", F.col("status").cast("long").alias("status"))


def replica_calls(spark, sf_dir):
    """A read or a write of each record at some node, with configurations, records and stores that fail at times."""
    own = views.records(events(spark, sf_dir)).withColumn("n", F.col("event_id") % 8)
    one = F.struct("id", "clock", "value", "deleted", "expires_us")
    other = F.struct("id", "clock", F.lit("x").alias("value"), "deleted", "expires_us")
    node = F.element_at(F.array(*map(F.lit, views.MEMBERS)), (F.col("event_id") % 5 + 1).cast("int"))
    sent = F.when(F.col("n") == 1, F.array().cast("array<struct<id:string,clock:array<string>,value:string,deleted:boolean,expires_us:bigint>>")).when(F.col("n") == 2, F.array(one, other)).otherwise(F.array(one, one))
    placed = ring.place(own.select("key", "event_id", "n", node.alias("node"), sent.alias("records")), ring.points(spark, views.MEMBERS), 3)
    method = F.when(F.col("event_id") % 2 == 0, "PUT").otherwise("GET")
    status = cluster.replica_status(F.array_contains("nodes", F.col("node")), F.when(F.col("n") == 3, "old").otherwise("new"), "new", method, F.col("records"), F.col("n") != 4)
    return placed.select("event_id", "node", status.cast("long").alias("status"))


def point_get(spark, sf_dir):
    return fold.point_get(log_lww(spark, sf_dir), "u7", NOW_US)


def key_records(spark, sf_dir):
    return flat(causal.records_of(views.records(events(spark, sf_dir)), "k:31"))


def unversioned_entries(spark, sf_dir):
    """Entries without siblings, as in a store that was written by the standalone service."""
    own = views.records(events(spark, sf_dir))
    entries = own.select("event_id", "key", F.when(F.col("event_id") % 4 > 0, F.array("id")).when(F.col("event_id") % 8 == 0, F.array().cast("array<string>")).alias("siblings"))
    return validate.unversioned(entries).select("event_id", "key")


def _stream(spark, sf_dir):
    path = f"{sf_dir}/event[s].parquet"  # a pattern may name a file as well as a folder
    return spark.readStream.schema(events(spark, sf_dir).schema).parquet(path)


def stream_lww(spark, sf_dir):
    stream = _stream(spark, sf_dir)
    keyed = stream.withColumn("of", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return streaming.last_write(views.ops(keyed, F.col("of")))


def stream_siblings(spark, sf_dir):
    own = views.records(events(spark, sf_dir)).select("key", "id", "clock", "value", "deleted")
    here = shared.folder(spark, "records")
    own.repartition(3).write.parquet(here)
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(here)
    return flat(streaming.siblings(stream))


def stream_window_counts(spark, sf_dir):
    """Operations a day, of the days that lie two hours before the last event and more."""
    stream = _stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("op"))
    return streaming.window_counts(stream, "2 hours", "1 day").select(F.unix_micros("start").alias("start_us"), "op", "n")


def validate_mutations(spark, sf_dir):
    n = F.col("event_id") % 11
    body = F.when(n == 0, "not json").when(n == 1, "{}").when(n == 2, '{"value":"x","ttl_ms":-1}').when(n == 3, '{"value":"x","other":1}').when(n == 4, '{"value":"x","context":{"fake":2}}').when(n == 5, '{"value":"x","context":{"":1}}').when(n == 6, '{"value":"x","ttl_ms":9223372036855}').when(n == 7, '{"value":"x","context":{}}').otherwise(F.concat(F.lit('{"value":"'), F.col("event_id").cast("string"), F.lit('","ttl_ms":5,"context":{"a:1":1}}')))
    method = F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT")
    rows = events(spark, sf_dir).select("event_id", method.alias("method"), body.alias("body"))
    return rows.select("event_id", "method", validate.mutation_status(F.col("method"), F.col("body")).cast("long").alias("status"))


def validate_bodies(spark, sf_dir):
    """More bodies: two objects, trailing text and fields of wrong types."""
    n = F.col("event_id") % 8
    body = F.when(n == 0, '{"value":"x"} {"value":"y"}').when(n == 1, '{"value":"x","ttl_ms":"abc"}').when(n == 2, '{"value":"x","context":5}').when(n == 3, '{"value":5}').when(n == 4, '{"value":"x"} tail').when(n == 5, '{"value":"x","ttl_ms":1.5}').when(n == 6, '{"value":"x","context":{"a":"1"}}').otherwise(' {"value":"x","ttl_ms":null,"context":null}\n')
    method = F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT")
    rows = events(spark, sf_dir).select("event_id", method.alias("method"), body.alias("body"))
    return rows.select("event_id", "method", validate.mutation_status(F.col("method"), F.col("body")).cast("long").alias("status"))


QUERIES = {f.__name__: f for f in (ring_owner, ring_owner_load, ring_replicas, ring_movement, log_lww, log_live_at, causal_siblings, causal_context, causal_conflicts, quorum_read, quorum_write, context_free_write, repair_rows, replica_divergence, lru_trace, lru_hit_rate, durable_capacity, wal_scan, wal_append, compacted_state, recover_state, recover_snapshot, recover_siblings, read_live, apply_mutations, partial_commit, merge_capacity, standalone_api, record_faults, ring_positions, placement_preview, placement_report, cluster_fingerprints, fan_out, owner_routing, replica_calls, point_get, key_records, unversioned_entries, stream_lww, stream_siblings, stream_window_counts, validate_mutations, validate_bodies)}


def _ring(members: str, name: str) -> str:
    return f"""{name}_pts AS (SELECT node, i AS idx, substr(sha256('node:' || strlen(node) || ':' || node || ':' || i), 1, 16) AS pos FROM (SELECT unnest([{members}]) AS node), range(64) t(i)),
{name}_arc AS (SELECT pos AS hi, row_number() OVER (ORDER BY pos, node, idx) AS rn FROM {name}_pts),
{name}_nx AS (SELECT a.rn, p.node, min(CASE WHEN p.pos >= a.hi THEN '0' || p.pos ELSE '1' || p.pos END) AS d FROM {name}_arc a CROSS JOIN {name}_pts p GROUP BY a.rn, p.node),
{name} AS (SELECT h.key, h.kp, n.node, row_number() OVER (PARTITION BY h.key ORDER BY d, node) AS k FROM
  (SELECT key, kp, coalesce(min(CASE WHEN hi >= kp THEN rn END), 1) AS rn FROM keys CROSS JOIN {name}_arc GROUP BY key, kp) h JOIN {name}_nx n ON n.rn = h.rn)"""


_MEMBERS = "'a','b','c','d','e'"
_KEYS = "WITH keys AS (SELECT 'user:' || c_custkey AS key, substr(sha256('key:user:' || c_custkey), 1, 16) AS kp FROM customer),\n"
_FIVE = _KEYS + _ring("'a','b','c','d','e'", "five")
_OPS = """ops AS (SELECT user_id % 4 AS store, event_id + 1 AS seq, CASE WHEN event_type IN ('purchase', 'signup') THEN 'put' WHEN event_type = 'error' THEN 'delete' ELSE 'get' END AS op,
  'k' || (event_id * 7919 % 60) AS key, 'u' || user_id AS u, CAST(event_id AS VARCHAR) AS value, epoch_us(ts) AS at_us, CASE WHEN event_id % 3 = 0 THEN event_id % 50 * 60000000 ELSE 0 END AS ttl_us FROM events)"""
_LWW = f"""WITH {_OPS},
last AS (SELECT u AS key, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(value, seq) AS value, arg_max(CASE WHEN ttl_us > 0 THEN at_us + ttl_us ELSE -1 END, seq) AS x FROM ops WHERE op <> 'get' GROUP BY u),
state AS (SELECT key, seq, value, CASE WHEN x >= 0 THEN CAST(x AS BIGINT) END AS expires_us FROM last WHERE op = 'put')
SELECT * FROM state"""
_RECORDS = """WITH e AS (SELECT event_id, event_id * 31 % 1999 AS u, event_type = 'error' AS deleted FROM events WHERE event_type IN ('purchase', 'signup', 'error')),
l AS (SELECT *, lag(event_id) OVER (PARTITION BY u ORDER BY event_id) AS p FROM e),
r AS (SELECT event_id, u, 'k:' || u AS key, 'e' || event_id AS id, CASE WHEN event_id % 7 = 0 OR p IS NULL THEN ['e' || event_id] ELSE list_sort(['e' || p, 'e' || event_id]) END AS clock,
  CASE WHEN NOT deleted THEN CAST(event_id AS VARCHAR) END AS value, deleted FROM l)"""
_BEATEN = "NOT EXISTS (SELECT 1 FROM {0} a WHERE a.key = b.key AND len(a.clock) > len(b.clock) AND list_has_all(a.clock, b.clock))"
_QUORUM = f"""{_RECORDS},
held AS (SELECT key, rank, id, clock, value, deleted FROM r, (SELECT unnest([1, 2, 3]) AS rank) WHERE rank <> event_id % 5),
reply AS (SELECT key, rank, (u * 7919 + rank * 104729) % 3000 AS arrival FROM (SELECT DISTINCT key, u FROM r), (SELECT unnest([1, 2, 3]) AS rank)),
good AS (SELECT key, rank, row_number() OVER (PARTITION BY key ORDER BY arrival, rank) AS place FROM reply WHERE arrival < 2000),
reached AS (SELECT key FROM good GROUP BY key HAVING count(*) >= 2),
got AS (SELECT DISTINCT h.key, id, clock, value, deleted FROM held h JOIN good g ON g.key = h.key AND g.rank = h.rank AND place <= 2 WHERE h.key IN (SELECT key FROM reached)),
merged AS (SELECT * FROM got b WHERE {_BEATEN.format("got")}),
sums AS (SELECT key, count(*) AS n, count(*) FILTER (NOT deleted) AS live, max(value) FILTER (NOT deleted) AS one FROM merged GROUP BY key),
ctx AS (SELECT key, string_agg(id, ',' ORDER BY id) AS context FROM (SELECT DISTINCT key, unnest(clock) AS id FROM merged) GROUP BY key),
answer AS (SELECT k.key, CASE WHEN q.key IS NULL THEN 503 WHEN coalesce(live, 0) = 0 THEN 404 WHEN n > 1 THEN 409 ELSE 200 END AS status, one, coalesce(n, 0) AS siblings, context
  FROM (SELECT DISTINCT key FROM reply) k LEFT JOIN reached q ON q.key = k.key LEFT JOIN sums s ON s.key = k.key LEFT JOIN ctx c ON c.key = k.key),
written AS (SELECT key, CASE WHEN count(*) FILTER (arrival < 2000) >= 2 THEN 204 ELSE 503 END AS status, coalesce(string_agg(CAST(rank AS VARCHAR), ',' ORDER BY rank) FILTER (arrival < 2000), '') AS stored FROM reply GROUP BY key)"""


def _trace(step: str, outcome: str) -> str:
    return f"""WITH RECURSIVE {_OPS},
o AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY seq) AS n, CASE WHEN ttl_us > 0 THEN at_us + ttl_us ELSE -1 END AS x FROM ops),
t AS (SELECT store, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS seq, CAST([] AS STRUCT(k VARCHAR, x BIGINT)[]) AS s, '' AS outcome FROM (SELECT DISTINCT store FROM ops)
  UNION ALL SELECT store, n, seq, {step} AS s, {outcome} AS outcome FROM (
    SELECT o.*, {{0}} AS s FROM t JOIN o ON o.store = t.store AND o.n = t.n + 1) AS q)
SELECT store, seq, outcome, len(s) AS size FROM t WHERE n > 0"""


_OTHERS, _OWN = "list_filter(s, lambda e: e.k <> key)", "list_filter(s, lambda e: e.k = key)"
_PUT = f"list_append({_OTHERS}, {{'k': key, 'x': CAST(x AS BIGINT)}})"
_STALE = f"({_OWN}[1].x >= 0 AND at_us >= {_OWN}[1].x)"
_LRU = _trace(
    f"CASE WHEN op = 'delete' THEN {_OTHERS} WHEN op = 'put' THEN CASE WHEN len({_OTHERS}) >= {CAPACITY} THEN {_PUT}[2:] ELSE {_PUT} END WHEN len({_OWN}) = 0 THEN s WHEN {_STALE} THEN {_OTHERS} ELSE list_concat({_OTHERS}, {_OWN}) END",
    f"CASE WHEN op = 'delete' THEN CASE WHEN len({_OWN}) > 0 THEN 'deleted' ELSE 'absent' END WHEN op = 'put' THEN CASE WHEN len({_OTHERS}) >= {CAPACITY} THEN 'evicted' ELSE 'stored' END WHEN len({_OWN}) = 0 THEN 'miss' WHEN {_STALE} THEN 'expired' ELSE 'hit' END",
).replace("{0}", "t.s")
_FULL = f"(len({_OWN}) = 0 AND len(s) >= {CAPACITY})"
# A put drops all that has expired, a get its own key only.
_DURABLE = _trace(
    f"CASE WHEN op = 'delete' THEN {_OTHERS} WHEN op = 'get' THEN CASE WHEN {_STALE} THEN {_OTHERS} ELSE s END WHEN {_FULL} THEN s ELSE {_PUT} END",
    f"CASE WHEN op = 'delete' THEN CASE WHEN len({_OWN}) > 0 THEN 'deleted' ELSE 'absent' END WHEN op = 'get' THEN CASE WHEN len({_OWN}) > 0 AND NOT coalesce({_STALE}, false) THEN 'hit' ELSE 'miss' END WHEN {_FULL} THEN 'rejected' ELSE 'stored' END",
).replace("{0}", "CASE WHEN o.op = 'put' THEN list_filter(t.s, lambda e: e.x < 0 OR o.at_us < e.x) ELSE t.s END")
_EXPIRING = "CASE WHEN NOT deleted AND event_id % 3 = 0 THEN epoch_us(ts) + event_id % 50 * 3600000000 END AS expires_us"
_LIVE = (
    _QUORUM.replace("SELECT event_id, event_id * 31 % 1999 AS u", "SELECT event_id, ts, event_id * 31 % 1999 AS u").replace("AS value, deleted FROM l)", f"AS value, deleted, {_EXPIRING} FROM l)")
    .replace("held AS (SELECT key, rank, id, clock, value, deleted", "held AS (SELECT key, rank, id, clock, value, deleted, expires_us").replace("got AS (SELECT DISTINCT h.key, id, clock, value, deleted", "got AS (SELECT DISTINCT h.key, id, clock, value, deleted, expires_us")
    .replace("FILTER (NOT deleted)", f"FILTER (NOT deleted AND (expires_us IS NULL OR {NOW_US} < expires_us))")
)
_RING3 = "keys AS (SELECT DISTINCT key, substr(sha256('key:' || key), 1, 16) AS kp FROM {0}),\n" + _ring("'a','b','c','d','e'", "five")
_ASKED = """asked AS (SELECT event_id AS req_id, ['a','b','c','d','e'][event_id % 5 + 1] AS node, 'k:' || (event_id * 31 % 1999) AS key, event_type = 'click' AS put, event_id % 10 AS n, epoch_us(ts) AS at_us
  FROM events WHERE event_type IN ('click', 'view'))"""
# Without a context (n of 0 and 1 give one) the read decides first; the record's id is the node and a hash of the request.
_ANSWERS = f"""{_QUORUM}, {_ASKED},
met AS (SELECT q.*, coalesce(a.status, 503) AS first, coalesce(a.siblings, 0) AS siblings, coalesce(w.status, 503) AS written, coalesce(w.stored, '') AS stored,
    CASE WHEN n = 0 THEN [] WHEN n = 1 THEN ['e' || (req_id - req_id % 3)] ELSE coalesce(string_split(a.context, ','), []) END AS context, node || ':' || substr(sha256(node || '/' || req_id), 1, 32) AS own
  FROM asked q LEFT JOIN answer a ON a.key = q.key LEFT JOIN written w ON w.key = q.key),
ruled AS (SELECT *, CASE WHEN n = 4 THEN 400 WHEN n > 1 AND first = 503 THEN 503 WHEN n > 1 AND siblings > 1 THEN 409 END AS refused FROM met),
answers AS (SELECT req_id, key, CAST(coalesce(refused, written) AS BIGINT) AS status, CASE WHEN refused IS NULL THEN own END AS id,
    CASE WHEN refused IS NULL THEN array_to_string(list_sort(list_distinct(list_append(context, own))), ',') END AS clock, CASE WHEN refused IS NULL AND put THEN 'v' || req_id END AS value,
    CASE WHEN refused IS NULL THEN NOT put END AS deleted, CASE WHEN refused IS NULL AND put AND n = 3 THEN at_us + 60000000 END AS expires_us, CASE WHEN refused IS NULL THEN stored END AS stored FROM ruled)"""
_WAL = f"WITH {_OPS}, log AS (SELECT store, row_number() OVER (PARTITION BY store ORDER BY seq) AS seq, op, key, CASE WHEN op = 'put' THEN value END AS value FROM ops WHERE op <> 'get')\n"
_SIBLINGS = f"{_RECORDS} SELECT key, id, array_to_string(clock, ',') AS clock, value, deleted FROM r b WHERE {_BEATEN.format('r')}"

ORACLE_SQL = {
    "ring_owner": f"{_FIVE} SELECT key, kp AS pos, node AS owner FROM five WHERE k = 1",
    "ring_owner_load": f"{_FIVE} SELECT node AS owner, count(*) AS n_keys FROM five WHERE k = 1 GROUP BY node",
    "ring_replicas": f"{_FIVE} SELECT key, k, node FROM five WHERE k <= 3",
    "ring_movement": f"""{_FIVE}, {_ring("'a','b','c','d'", "four")} SELECT a.key, a.node AS old, b.node AS new FROM four a JOIN five b ON a.key = b.key AND a.k = 1 AND b.k = 1 WHERE a.node <> b.node""",
    "log_lww": _LWW,
    "log_live_at": f"{_LWW} WHERE expires_us IS NULL OR {NOW_US} < expires_us",
    "causal_siblings": _SIBLINGS,
    "causal_context": f"{_RECORDS} SELECT key, string_agg(id, ',' ORDER BY id) AS context FROM (SELECT DISTINCT key, unnest(clock) AS id FROM r) GROUP BY key",
    "causal_conflicts": f"{_RECORDS} SELECT key, id, CAST(2 AS BIGINT) AS versions FROM r WHERE event_id % 50 = 0",
    "quorum_read": f"{_QUORUM} SELECT key, CAST(status AS BIGINT) AS status, CASE WHEN status = 200 THEN one END AS value, siblings, context FROM answer",
    "quorum_write": f"{_QUORUM} SELECT key, CAST(status AS BIGINT) AS status, stored FROM written",
    "context_free_write": f"""{_QUORUM}, f AS (SELECT a.key, CASE WHEN a.status = 503 THEN 503 WHEN siblings > 1 THEN 409 ELSE w.status END AS status, context FROM answer a JOIN written w ON w.key = a.key)
SELECT key, CAST(status AS BIGINT) AS status, CASE WHEN status = 204 THEN coalesce(context, '') END AS context FROM f""",
    "repair_rows": f"""{_QUORUM}, every AS (SELECT DISTINCT h.key, id, clock FROM held h JOIN good g ON g.key = h.key AND g.rank = h.rank WHERE h.key IN (SELECT key FROM reached))
SELECT b.key, p.rank, b.id FROM every b JOIN reply p ON p.key = b.key WHERE {_BEATEN.format("every")} AND NOT EXISTS (SELECT 1 FROM held h WHERE h.key = b.key AND h.rank = p.rank AND h.id = b.id)""",
    "replica_divergence": f"""{_QUORUM}, every AS (SELECT DISTINCT key, id, clock FROM held)
SELECT b.key, p.rank, count(*) AS missing FROM every b JOIN (SELECT DISTINCT key, rank FROM held) p ON p.key = b.key WHERE {_BEATEN.format("every")} AND NOT EXISTS (SELECT 1 FROM held h WHERE h.key = b.key AND h.rank = p.rank AND h.id = b.id) GROUP BY b.key, p.rank""",
    "lru_trace": _LRU,
    "lru_hit_rate": f"SELECT store, count(*) AS gets, count(*) FILTER (outcome = 'hit') AS hits FROM ({_LRU}) WHERE outcome IN ('hit', 'miss', 'expired') GROUP BY store",
    "durable_capacity": _DURABLE,
    "wal_scan": f"{_WAL} SELECT * FROM log",
    "recover_state": f"{_WAL} SELECT store, key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY store, key ORDER BY seq DESC) AS last FROM log) WHERE last = 1 AND op = 'put'",
    "recover_snapshot": f"""WITH {_OPS}, log AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY seq) AS n FROM ops WHERE op <> 'get'),
last AS (SELECT *, CASE WHEN ttl_us > 0 THEN at_us + ttl_us END AS x, row_number() OVER (PARTITION BY store, key ORDER BY n DESC) AS k FROM log)
SELECT store, key, n AS seq, value, CAST(x AS BIGINT) AS expires_us FROM last WHERE k = 1 AND op = 'put' AND (x IS NULL OR {NOW_US} < x)""",
    "recover_siblings": f"""{_RECORDS}, log AS (SELECT *, u % 4 AS store, row_number() OVER (PARTITION BY u % 4 ORDER BY event_id) AS seq,
  lag(event_id) OVER (PARTITION BY u ORDER BY event_id) AS p, row_number() OVER (PARTITION BY u ORDER BY event_id DESC) AS k FROM r),
top AS (SELECT * FROM log WHERE k = 1),
both_of AS (SELECT store, key, seq, event_id FROM top UNION ALL SELECT store, key, seq, p FROM top WHERE len(clock) = 1 AND p IS NOT NULL)
SELECT b.store, b.key, b.seq, r.id, array_to_string(list_sort(r.clock), ',') AS clock, coalesce(r.value, '') AS value, r.deleted FROM both_of b JOIN r ON r.event_id = b.event_id""",
    "wal_append": f"{_WAL} SELECT * FROM log",
    "read_live": f"""{_LIVE}, {_RING3.format("reply")} SELECT a.key, CAST(status AS BIGINT) AS status, CASE WHEN status = 200 THEN one END AS value, siblings, context, p.owner, p.replicas FROM answer a
JOIN (SELECT key, min(CASE WHEN k = 1 THEN node END) AS owner, string_agg(node, ',' ORDER BY k) AS replicas FROM five WHERE k <= 3 GROUP BY key) p ON p.key = a.key""",
    "apply_mutations": f"{_ANSWERS} SELECT * FROM answers",
    "partial_commit": f"{_ANSWERS} SELECT key, CAST(unnest(string_split(stored, ',')) AS BIGINT) AS rank, id, deleted FROM answers WHERE status = 503 AND stored <> ''",
    "merge_capacity": f"""{_RECORDS}, d AS (SELECT u % 4 AS store, key, id, clock, event_id * 2 + x AS seq FROM r, (SELECT unnest([0, 2001]) AS x)),
came AS (SELECT store, key, row_number() OVER (PARTITION BY store ORDER BY min(seq), key) AS place FROM d GROUP BY store, key)
SELECT d.store, d.seq, d.key, CASE WHEN place > 100 THEN 'rejected'
  WHEN EXISTS (SELECT 1 FROM d o WHERE o.store = d.store AND o.key = d.key AND o.seq < d.seq AND (o.id = d.id OR (len(o.clock) > len(d.clock) AND list_has_all(o.clock, d.clock)))) THEN 'unchanged' ELSE 'stored' END AS outcome
FROM d JOIN came c ON c.store = d.store AND c.key = d.key""",
    "standalone_api": f"""SELECT store, op, status, count(*) AS n FROM (SELECT d.store, o.op, CAST(CASE WHEN outcome = 'rejected' THEN 507 WHEN outcome = 'miss' THEN 404 WHEN outcome = 'hit' THEN 200 ELSE 204 END AS BIGINT) AS status
FROM ({_DURABLE}) d JOIN (SELECT user_id % 4 AS store, event_id + 1 AS seq, CASE WHEN event_type IN ('purchase', 'signup') THEN 'put' WHEN event_type = 'error' THEN 'delete' ELSE 'get' END AS op FROM events) o ON o.store = d.store AND o.seq = d.seq) GROUP BY store, op, status""",
    "record_faults": f"""{_RECORDS} SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'id' WHEN 1 THEN 'clock' WHEN 2 THEN 'context' ELSE 'tombstone' END AS fault FROM r WHERE event_id % 6 IN (0, 1, 2) OR (event_id % 6 = 3 AND deleted)""",
    "ring_positions": f"WITH keys AS (SELECT '' AS key, '' AS kp), {_ring(_MEMBERS, 'five')} SELECT node, CAST(idx AS INTEGER) AS idx, CAST(CAST('0x' || pos AS UBIGINT) AS VARCHAR) AS position FROM five_pts",
    "placement_preview": f"""WITH keys AS (SELECT 'user:1' AS key, substr(sha256('key:user:1'), 1, 16) AS kp), {_ring("'a','b','c'", "three").replace("range(64)", "range(8)")}
SELECT node, CAST(idx AS INTEGER) AS idx, CAST(CAST('0x' || pos AS UBIGINT) AS VARCHAR) AS position, (SELECT CAST(CAST('0x' || kp AS UBIGINT) AS VARCHAR) FROM keys) AS key_position, (SELECT string_agg(node, ',' ORDER BY k) FROM three WHERE k <= 2) AS replicas FROM three_pts""",
    "placement_report": f"""{_FIVE} SELECT key, 'replicated' AS mode, 'b' AS receiving_node, min(CASE WHEN k = 1 THEN node END) AS owner, CAST(CAST('0x' || kp AS UBIGINT) AS VARCHAR) AS key_position, string_agg(node, ',' ORDER BY k) AS replicas, 64 AS virtual_nodes, 2 AS read_quorum, 2 AS write_quorum FROM five WHERE k <= 3 GROUP BY key, kp""",
    "cluster_fingerprints": """WITH n AS (SELECT string_agg('{"id":"' || x || '","address":"http://' || x || '.example:8080"}', ',' ORDER BY x) AS nodes FROM (SELECT unnest(['a','b','c','d','e']) AS x))
SELECT sha256('{"Protocol":1,"Nodes":[' || nodes || '],"Vnodes":64,"N":3,"R":2,"W":2}') AS replicated, sha256('{"Nodes":[' || nodes || '],"VirtualNodes":64}') AS single_owner FROM n""",
    "fan_out": f"WITH {_ASKED}, {_RING3.format('asked')} SELECT req_id, q.key, node_of AS node, k AS rank FROM asked q JOIN (SELECT key, node AS node_of, k FROM five WHERE k <= 3) f ON f.key = q.key",
    "owner_routing": f"""WITH {_ASKED}, {_RING3.format("asked")}, x AS (SELECT req_id, q.node, f.node AS owner, req_id % 7 AS n FROM asked q JOIN five f ON f.key = q.key AND f.k = 1),
y AS (SELECT *, CASE WHEN n < 2 AND (n = 1 OR node <> owner) THEN 409 WHEN n = 3 AND node <> owner THEN 503 END AS bad FROM x)
SELECT req_id, owner, CASE WHEN bad IS NULL THEN owner END AS served_by, CAST(coalesce(bad, 204) AS BIGINT) AS status FROM y""",
    "replica_calls": f"""{_RECORDS}, {_RING3.format("r")}, c AS (SELECT event_id, key, ['a','b','c','d','e'][event_id % 5 + 1] AS node, event_id % 8 AS n, event_id % 2 = 0 AS put FROM r)
SELECT event_id, c.node, CAST(CASE WHEN f.node IS NULL OR n = 3 THEN 409 WHEN put AND n = 2 THEN 400 WHEN n = 4 THEN 503 WHEN put THEN 204 ELSE 200 END AS BIGINT) AS status
FROM c LEFT JOIN (SELECT key, node FROM five WHERE k <= 3) f ON f.key = c.key AND f.node = c.node""",
    "point_get": f"SELECT * FROM ({_LWW}) WHERE key = 'u7' AND (expires_us IS NULL OR {NOW_US} < expires_us)",
    "key_records": f"SELECT * FROM ({_SIBLINGS}) WHERE key = 'k:31'",
    "unversioned_entries": f"{_RECORDS} SELECT event_id, key FROM r WHERE event_id % 4 = 0",
    "compacted_state": f"""WITH {_OPS}, log AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY seq) AS n FROM ops WHERE op <> 'get'),
last AS (SELECT *, CASE WHEN ttl_us > 0 THEN at_us + ttl_us END AS x, row_number() OVER (PARTITION BY store, key ORDER BY n DESC) AS k FROM log)
SELECT store, key, n AS seq, value, CAST(x AS BIGINT) AS expires_us FROM last WHERE k = 1 AND op = 'put' AND (x IS NULL OR {NOW_US} < x)""",
    "stream_lww": _LWW,
    "stream_siblings": _SIBLINGS,
    "stream_window_counts": """SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type AS op, count(*) AS n FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY ALL""",
    "validate_mutations": "SELECT event_id, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS method, CAST(CASE WHEN event_id % 11 IN (0, 2, 3, 4, 5, 6) OR (event_id % 11 = 1 AND event_type <> 'error') THEN 400 ELSE 200 END AS BIGINT) AS status FROM events",
    "validate_bodies": "SELECT event_id, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS method, CAST(CASE WHEN event_id % 8 = 7 THEN 200 ELSE 400 END AS BIGINT) AS status FROM events",
}
