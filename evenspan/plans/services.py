"""Queries of lookups in batches (S19), batches by token budget (U3), store resolution (S14) and job graphs (C6, C7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..graph import Job, run_graph
from ..operators import batching as B
from ..operators import lookup as L
from ..operators.assemble import whitespace_pieces
from ..registry import query
from ..sources import stores as S
from ..sources.scratch import scratch_path
from . import fixtures as X

# ---- S19 ----


def _service():
    """Stands where a remote service would: knows four of five keys, and refuses half of the calls at first."""
    asked = set()

    def ask(keys: list[int]) -> dict[int, str]:
        first = keys[0] not in asked
        asked.add(keys[0])
        if first and keys[0] % 2:
            raise ConnectionError("busy")
        return {k: f"Q{7 * k}" for k in keys if k % 5}

    return ask


@query("s19_batched_lookup", "select o_orderkey, case when o_custkey % 5 <> 0 then 'Q' || 7 * o_custkey end qid, null::varchar error from orders")
def s19b(spark, d):
    o = X.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return L.looked_up(o, "o_custkey", lambda: _service(), value="qid").select("o_orderkey", "qid", "error")


# ---- U3 ----

BUDGET = 4096
BATCH_SQL = rf"""
tn as (select conv_id, turn, conv_id * 1000 + turn id, len(string_split_regex(trim(text), '\s+')) n from conversations),
tp as (select *, greatest(ceil(n / 8.0::double), 1)::bigint * 8 padded from tn),
tr as (select *, row_number() over (partition by padded order by id) rn from tp),
tb as (select conv_id, turn, n, padded, padded || '_' || ((rn - 1) // greatest({BUDGET} // padded, 1)) batch from tr)"""


def _batches(spark, d):
    c = X.table(spark, d, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.size(whitespace_pieces(F.col("text"))).alias("n"))
    return B.budget_batches(c, "n", "id", BUDGET)


@query("u03_token_batches", f"with {BATCH_SQL} select conv_id, turn, padded, batch from tb")
def u03(spark, d):
    return _batches(spark, d).select("conv_id", "turn", "padded", "batch")


@query("u03_padding_share", f"""with {BATCH_SQL}, eb as (select batch, sum(padded) f, sum(n) u from tb group by 1)
 select count(*) n_batches, max(f)::bigint most_tokens, round(1 - sum(u)::double / sum(f)::double, 8) padding from eb""")
def u03_share(spark, d):
    return B.padding_share(_batches(spark, d), "n").withColumn("padding", F.round("padding", 8))


# ---- S14: folders, names and settings made of part ----

STORE_SQL = """
sf as (select 'run' || p_size folder, case p_partkey % 6 when 0 then 'standalone__mean__' when 1 then 'standalone_cls_' when 2 then 'cls_standalone_' when 3 then 'latechunking__segments__' when 4 then 'mean_latechunking_' else 'notes_' end || p_brand nm from part),
sk as (select distinct 'run' || p_size folder, p_size from part),
sj as (select folder, 'standalone_mean' entry, 'given/' || p_size path from sk where p_size % 3 = 0 union all select folder, 'latechunking_cls', 'late/' || p_size from sk where p_size % 4 = 0),
sw as (select folder, kind, choice from sk, (values ('standalone', 'mean'), ('standalone', 'cls'), ('standalone', null), ('latechunking', 'segments'), ('latechunking', 'cls'), ('latechunking', 'mean'), ('latechunking', null)) v(kind, choice)),
sp as (select folder, kind, choice, p, place from sw, (values (1), (2), (3)) x(place), lateral (select case when choice is null then case place when 1 then kind || '__' when 2 then kind || '_' end
  else case place when 1 then kind || '__' || choice when 2 then kind || '_' || choice else choice || '_' || kind end end p) where p is not null),
sb as (select sp.folder, kind, choice, arg_min(nm, (place, nm)) nm from sp join sf on sp.folder = sf.folder and contains(nm, p) group by all)"""


def _stores(spark, d):
    p = X.table(spark, d, "part").withColumn("folder", F.concat(F.lit("run"), "p_size"))
    stem = ("standalone__mean__", "standalone_cls_", "cls_standalone_", "latechunking__segments__", "mean_latechunking_", "notes_")
    files = p.select("folder", F.concat(F.get(F.array(*map(F.lit, stem)), (F.col("p_partkey") % 6).cast("int")), "p_brand", F.lit(".parquet")).alias("file"))
    folders = p.select("folder", "p_size").distinct()
    own = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("given/"), "p_size")).alias("standalone_mean")
    late = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("late/"), "p_size")).alias("latechunking_cls")
    texts = folders.select("folder", F.to_json(F.struct(F.struct(own, late).alias("embedding_paths"))).alias("value"))
    asks = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).cast("string").alias("choice")) for k, cs in S.KINDS.items() for c in (*cs, None)])
    return folders.select("folder", F.inline(asks)), S.manifest(files), S.settings_paths(texts)


@query("s14_store_resolution", f"""with {STORE_SQL} select sw.folder, sw.kind, sw.choice, coalesce(sj.path, sw.folder || '/' || sb.nm || '.parquet') path, case when sj.path is not null then 'settings' when sb.nm is not null then 'name' else 'missing' end rule
 from sw left join sj on sw.folder = sj.folder and sj.entry = sw.kind || '_' || sw.choice left join sb on sb.folder = sw.folder and sb.kind = sw.kind and sb.choice is not distinct from sw.choice""")
def s14_resolved(spark, d):
    return S.resolved(*_stores(spark, d))


# ---- C6, C7 ----


def _jobs(spark, d):
    def lengths(spark, settings, _):
        x = X.table(spark, d, "documents").select("doc_id", "lang", F.size(whitespace_pieces(F.col("text"))).alias("n"))
        return x.filter(F.col("n") >= settings["least"])

    def failing(spark, *_):
        return X.table(spark, d, "no_such_table")

    return {
        "report": Job(lambda s, _, t: t["by_language"].agg(F.count(F.lit(1)).alias("n")), needs=("by_language",)),
        "by_language": Job(lambda s, _, t: t["lengths"].groupBy("lang").agg(F.sum("n").alias("n")), needs=("lengths",)),
        "lengths": Job(lengths, {"least": 50}),
        "embeddings": Job(failing),
        "similarities": Job(lambda s, _, t: t["embeddings"], needs=("embeddings", "lengths")),
    }


@query("c07_job_graph", r"""with n as (select doc_id, lang from documents where len(string_split_regex(trim(text), '\s+')) >= 50)
 select 'lengths' job, 'done' first_run, 'kept' second_run, count(*) n_rows from n union all select 'by_language', 'done', 'kept', count(distinct lang) from n union all select 'report', 'done', 'kept', 1
 union all select 'embeddings', 'failed', 'failed', null union all select 'similarities', 'left', 'left', null""")
def c07_graph(spark, d):
    root, jobs = scratch_path(spark, "jobs"), _jobs(spark, d)
    first, second = run_graph(spark, jobs, root), run_graph(spark, jobs, root)
    rows = [(n, o.state, second[n].state, spark.read.parquet(o.path).count() if o.state == "done" else None) for n, o in first.items()]
    return spark.createDataFrame(rows, "job string, first_run string, second_run string, n_rows long")
