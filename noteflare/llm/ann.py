"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Vectors are dealt to shards of about ``SHARD_ROWS`` by a hash, so a shard's graph has the
same size whatever the corpus.  A shard's graph is a few flat arrays: vectors, node levels and,
for each level, a neighbour table padded with -1.  They are one row of the index table.
A shard is sent to one task, once, followed by the blocks of queries that stream past it: what travels are
queries, a few hundred KB a block and shard, never copies of a graph.  The shards'
answers are merged by a ranking per query.

Equal vectors are one node that carries its smallest ids, as many as can
be asked for; larger ids of a hot vector can't be among the nearest, since ties go to smaller ids.

Largest inner product is turned into nearness for building by one more coordinate that
gives all vectors of a shard the same length; queries have 0 there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteflare.llm.common import arrow_stage, scratch_table, ship

SHARD_ROWS = 8192
BLOCK_QUERIES = 1024
LINKS = 16          # neighbours of a node on upper levels; twice that on the ground
POOL = 64           # nearest nodes considered when a node's neighbours are chosen
BEAM = 128          # nodes kept while searching
EXPAND = 4          # nodes of the beam expanded in one step
ROWS_AT_ONCE = 256


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, dim): rows with an id and a non-null, non-zero vector of finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(vec_col)
    return (vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).select(F.col(id_col).alias("id"), v.alias("vec"))
            .where(~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0)).withColumn("dim", F.size("vec")))


def _nearest(base: np.ndarray, links: int, pool: int) -> np.ndarray:
    """Diverse neighbours of every row among all rows: (n, links) row numbers, -1 padded."""
    n = len(base)
    out = np.full((n, links), -1, np.int32)
    if n < 2:
        return out
    k = min(pool, n - 1)
    for a in range(0, n, ROWS_AT_ONCE):
        rows = np.arange(a, min(n, a + ROWS_AT_ONCE))
        sims = base[rows] @ base.T
        sims[np.arange(len(rows)), rows] = -np.inf
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        score = np.take_along_axis(sims, near, 1)
        order = np.argsort(-score, axis=1)
        near, score = np.take_along_axis(near, order, 1), np.take_along_axis(score, order, 1)
        among = np.einsum("rid,rjd->rij", base[near], base[near], optimize=True)
        taken = np.zeros((len(rows), k), bool)
        closest = np.full((len(rows), k), -np.inf)  # to a chosen neighbour
        for j in range(k):  # a candidate nearer to a chosen neighbour than to the node is passed over
            pick = (score[:, j] > closest[:, j]) & (taken.sum(axis=1) < links)
            taken[:, j] = pick
            closest[pick] = np.maximum(closest[pick], among[pick, j])
        rank = np.where(taken, np.arange(k), k + np.arange(k))  # chosen first, then the nearest passed over
        best = np.argsort(rank, axis=1)[:, :links]
        out[rows, : best.shape[1]] = np.take_along_axis(near, best, 1)
    return out


def _mutual(table: np.ndarray, links: int) -> np.ndarray:
    """Neighbour table with room for links back, (n, 2 * links)."""
    n = len(table)
    out = np.full((n, 2 * links), -1, np.int32)
    out[:, :links] = table
    src, slot = np.nonzero(table >= 0)
    dst = table[src, slot]
    order = np.lexsort((slot, dst))  # links back that are nearest for their source come first
    src, dst = src[order], dst[order]
    nth = np.arange(len(dst)) - np.searchsorted(dst, dst)
    fits = nth < links
    out[dst[fits], links + nth[fits]] = src[fits]
    return out


def build_graph(vectors: np.ndarray, ids: np.ndarray) -> dict:
    """Flat arrays of one shard's graph; levels fall off geometrically by a hash of the id."""
    v = vectors.astype(np.float32)
    norm = np.einsum("ij,ij->i", v, v, dtype=np.float64)
    lifted = np.c_[v, np.sqrt(np.maximum(0, norm.max() - norm))].astype(np.float32)
    u = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / 2**53
    level = np.minimum(np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(LINKS)), 8).astype(np.int32)
    members, tables = [], []
    for at in range(int(level.max()) + 1):
        rows = np.flatnonzero(level >= at).astype(np.int32)
        wide = LINKS * 2 if at == 0 else LINKS
        local = _mutual(_nearest(lifted[rows], wide // 2, POOL), wide // 2)
        members.append(rows)
        tables.append(np.where(local >= 0, rows[np.maximum(local, 0)], -1).astype(np.int32))
    return {"members": members, "tables": tables}


def search_graph(vectors: np.ndarray, members: list, tables: list, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """(Q, beam) row numbers near each query, -1 padded: greedy descent, then a beam on the ground level."""
    n, q = len(vectors), len(queries)
    each = np.arange(q)
    place = np.full(q, members[-1][0])
    best = np.einsum("qd,qd->q", queries, vectors[place])
    for rows, table in zip(reversed(members[1:]), reversed(tables[1:])):
        where = np.full(n, -1, np.int32)
        where[rows] = np.arange(len(rows))
        while True:
            near = table[where[place]]
            sims = np.where(near >= 0, np.einsum("qd,qmd->qm", queries, vectors[near]), -np.inf)
            top = sims.argmax(axis=1)
            better = sims[each, top] > best
            if not better.any():
                break
            place = np.where(better, near[each, top], place)
            best = np.where(better, sims[each, top], best)
    table = tables[0]
    found = np.full((q, beam), -1, np.int32)
    score = np.full((q, beam), -np.inf, np.float32)
    done = np.zeros((q, beam), bool)
    seen = np.zeros((q, n + 1), bool)  # the last column is the padding's
    seen[:, n] = True
    found[:, 0], score[:, 0] = place, best
    seen[each, place] = True
    live = each
    while len(live):
        open_score = np.where(done[live] | (found[live] < 0), -np.inf, score[live])
        pick = np.argpartition(-open_score, min(EXPAND, beam - 1), axis=1)[:, :EXPAND]
        usable_pick = np.take_along_axis(open_score, pick, 1) > -np.inf
        going = usable_pick.any(axis=1)
        live, pick, usable_pick = live[going], pick[going], usable_pick[going]
        if not len(live):
            break
        done[live[:, None], pick] = True
        nodes = np.take_along_axis(found[live], pick, 1)
        near = np.where(usable_pick[:, :, None], table[nodes], -1).reshape(len(live), -1)
        near = np.where(near < 0, n, near)
        near.sort(axis=1)
        fresh = ~seen[live[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[live[:, None], near] = True
        sims = np.einsum("qd,qmd->qm", queries[live], vectors[np.where(fresh, near, 0)])
        all_score = np.concatenate([score[live], np.where(fresh, sims, -np.inf)], axis=1)
        all_found = np.concatenate([found[live], np.where(fresh, near, -1)], axis=1)
        all_done = np.concatenate([done[live], np.zeros(near.shape, bool)], axis=1)
        keep = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
        score[live] = np.take_along_axis(all_score, keep, 1)
        found[live] = np.take_along_axis(all_found, keep, 1)
        done[live] = np.take_along_axis(all_done, keep, 1)
    return found


def shard_counts(reps: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(dim, shards): one row a vector length."""
    return reps.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).alias("shards"))


def build_index(reps: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(dim, shard, ids, vectors, members, tables): one row a shard, from (id, vec, dim) of distinct vectors."""
    sizes = shard_counts(reps, shard_rows)
    dealt = reps.join(F.broadcast(sizes), "dim").withColumn("shard", F.pmod(F.xxhash64("id"), "shards"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, v = pdf["id"].to_numpy(np.int64), np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        g = build_graph(v, ids)
        return pd.DataFrame([{
            "dim": pdf["dim"].iloc[0], "shard": pdf["shard"].iloc[0], "ids": ids.tobytes(), "vectors": v.tobytes(),
            "members": [m.tobytes() for m in g["members"]], "tables": [t.tobytes() for t in g["tables"]]}])

    ship(reps.sparkSession)
    return dealt.groupBy("dim", "shard").applyInPandas(
        build, "dim int, shard long, ids binary, vectors binary, members array<binary>, tables array<binary>")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
            shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found by inner product, itself left out.

    ``queries`` has the columns of ``vectors``; a query is left out of its own answers by id.  Scores are
    inner products of the original vectors in double precision; ties go to
    smaller ids.  Vectors that are null, zero or hold null or non-finite
    components, and rows without an id, take no part on either side; vectors of another length than
    the query's aren't its candidates.  Rows repeating an id with the same vector count
    once.  Other columns are ignored; an empty table on either side gives an empty result.
    """
    rows = usable(vectors, id_col, vec_col).distinct()
    by_vector = Window.partitionBy("vec").orderBy("id")
    low = rows.withColumn("nth", F.row_number().over(by_vector)).where(F.col("nth") <= k + 1)
    reps = scratch_table(low.groupBy("vec").agg(F.min("id").alias("id"), F.first("dim").alias("dim"),
                                                F.array_sort(F.collect_list("id")).alias("copies")), "ann-nodes")
    index = scratch_table(build_index(reps.select("id", "vec", "dim"), shard_rows), "ann-index")

    asked = usable(queries, id_col, vec_col).distinct()
    blocks = F.ceil(F.lit(asked.count() + 1) / BLOCK_QUERIES).cast("long")
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("id"), blocks))
    packed = scratch_table(dealt.groupBy("dim", "block").agg(F.collect_list(F.struct("id", "vec")).alias("q")), "ann-queries")
    # A row a block and shard, by the number of shards alone; each shard's row comes before its blocks.
    sizes = F.broadcast(shard_counts(reps, shard_rows))  # one row a vector length
    sent = packed.join(sizes, "dim").select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"),
                                            "block", "q.id", "q.vec")
    work = (index.withColumn("block", F.lit(-1).cast("long")).unionByName(sent, allowMissingColumns=True)
            .repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), "dim", "shard")
            .sortWithinPartitions("dim", "shard", "block"))

    def search(batches):
        shard, key = None, None
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if r["block"] == -1:
                    key = r["dim"], r["shard"]
                    v = np.frombuffer(r["vectors"]).reshape(-1, r["dim"])
                    members = [np.frombuffer(m, np.int32) for m in r["members"]]
                    tables = [np.frombuffer(t, np.int32).reshape(len(m), -1) for m, t in zip(members, r["tables"])]
                    shard = v, np.frombuffer(r["ids"], np.int64), v.astype(np.float32), members, tables
                    continue
                assert key == (r["dim"], r["shard"])
                v, ids, near_v, members, tables = shard
                asked_v = np.array(r["vec"], np.float64)
                hits = search_graph(near_v, members, tables, asked_v.astype(np.float32), beam)
                exact = np.empty(hits.shape)
                for a in range(0, len(hits), 64):
                    exact[a:a + 64] = np.einsum("qd,qmd->qm", asked_v[a:a + 64], v[np.maximum(hits[a:a + 64], 0)])
                exact[hits < 0] = -np.inf
                order = np.lexsort((ids[np.maximum(hits, 0)], -exact), axis=1)[:, : k + 1]
                top, score = np.take_along_axis(hits, order, 1), np.take_along_axis(exact, order, 1)
                good = top >= 0
                who = np.repeat(np.array(r["id"], np.int64), good.sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(who), pa.array(ids[top[good]]), pa.array(score[good])], names=["query_id", "node", "score"])

    found = arrow_stage(work, search, "query_id long, node long, score double")
    mine = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node")
    near = found.withColumn("nth", F.row_number().over(mine)).where(F.col("nth") <= k + 1)
    ids = reps.select(F.col("id").alias("node"), F.explode("copies").alias("vec_id"))
    spread = near.join(ids, "node").where(F.col("vec_id") != F.col("query_id"))
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (spread.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("vec_id").alias(id_col), "score"))
