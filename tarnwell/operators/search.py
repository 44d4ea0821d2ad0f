"""Dense, keyword and hybrid top-k search, fusion, reranking and diversity.

The query set of a search is stated and bounded; it is taken to the corpus in blocks, each block is scored
against every row in one pass, and only k rows per query leave a batch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.functions import text as T
from tarnwell.session import cut

K1, B = 1.2, 0.75
DENSE_WEIGHT = 0.7
QUERY_BLOCK = 4096
BLOCK_TERMS = 200_000  # query terms taken to the corpus at a time
SCORE_CELLS = 4_000_000  # scores a task holds at a time
SIM_DIGITS = 9  # similarities are equal if they agree when rounded so


def topk(scored: DataFrame, group: str | list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group as ``rank`` 1..k; the limit is applied before the shuffle as well."""
    keys = [group] if isinstance(group, str) else group
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def finite_vector(v: Column, dim: int | None = None) -> Column:
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(ok & (F.size(v) == dim) if dim else ok, F.lit(False))


def _first(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of all that may be among the k first of each row of ``sims``.

    ``topk`` rounds to SIM_DIGITS later, so all within two of their steps of the k-th similarity may be equal to it and
    stay; of columns with the very same similarity only the k smallest ids can be among the first.
    """
    at = sims.shape[1] - min(k, sims.shape[1])
    least = np.partition(sims, at, axis=1)[:, at] - 2 * 10.0**-SIM_DIGITS
    r, c = np.nonzero((sims >= least[:, None]) & np.isfinite(sims))
    if len(r) > k * len(sims):
        order = np.lexsort((ids[c], -sims[r, c], r))
        r, c = r[order], c[order]
        fresh = np.r_[True, (r[1:] != r[:-1]) | (sims[r, c][1:] != sims[r, c][:-1])]
        place = np.arange(len(r)) - np.maximum.accumulate(np.where(fresh, np.arange(len(r)), 0))
        r, c = r[place < k], c[place < k]
    return r, c


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, dim: int) -> DataFrame:
    """qid, id, sim, rank of the k most similar rows of ``corpus(id, embedding)`` for each of ``queries(qid, embedding)``.

    A row is never its own answer. Vectors of another length, with missing or infinite numbers or all zero take no
    part on either side. Equal similarity goes to the smaller id.
    """
    spark = corpus.sparkSession
    usable = corpus.where(finite_vector(F.col("embedding"), dim)).select(F.col("id").cast("long"), "embedding")
    q = queries.where(finite_vector(F.col("embedding"), dim)).select(F.col("qid").cast("long"), "embedding")
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    if blocks > 1:  # so a block doesn't read the query table again
        q = cut(q)
    out = None
    for b in range(blocks):
        rows = list(q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toLocalIterator())
        if not rows:
            continue
        ids = np.array([r.qid for r in rows])
        m = np.array([r.embedding for r in rows], dtype=np.float64)
        block = spark.sparkContext.broadcast((ids, m / np.linalg.norm(m, axis=1, keepdims=True)))

        def score(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            qids, qm = block.value
            for pdf in batches:
                if not len(pdf):
                    continue
                own = pdf["id"].to_numpy()
                x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                sims = qm @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                sims[qids[:, None] == own[None, :]] = -np.inf
                r, c = _first(sims, own, k)
                yield pd.DataFrame({"qid": qids[r], "id": own[c], "sim": sims[r, c]})

        part = usable.mapInPandas(score, "qid long, id long, sim double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "qid long, id long, sim double, rank int")
    return topk(out, "qid", k, F.desc(F.round("sim", SIM_DIGITS)), F.asc("id"))


def _term_blocks(terms: DataFrame) -> tuple[DataFrame, int]:
    """The query terms with the block of their query, and how many blocks keep each within BLOCK_TERMS terms on average."""
    blocks = max(1, -(-terms.count() // BLOCK_TERMS))
    return terms.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks))), blocks


def bm25_topk(queries: DataFrame, corpus: DataFrame, k: int, query_terms=T.query_terms, document_terms=T.document_terms, own: bool = True) -> DataFrame:
    """qid, id, score, rank of the k best of ``bm25_scores`` for each query; equal scores go to the smaller id."""
    return topk(bm25_scores(queries, corpus, query_terms, document_terms, own, k), "qid", k, F.desc(F.round("score", SIM_DIGITS)), F.asc("id"))


def bm25_scores(queries: DataFrame, corpus: DataFrame, query_terms=T.query_terms, document_terms=T.document_terms, own: bool = True, k: int | None = None) -> DataFrame:
    """qid, id, score > 0 of ``corpus(id, text)`` for ``queries(qid, text)``; with ``k`` those that may be among the k best.

    BM25 without inverse document frequency; a repeated query term counts repeatedly. Unless ``own``, a row isn't its
    own answer. Queries are taken to the corpus in blocks of bounded size; a document is
    scored within its row and a batch keeps k rows a query, so no hit is shuffled before the limit.
    """
    spark = corpus.sparkSession
    terms = queries.select(F.col("qid").cast("long"), F.explode(query_terms(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    terms, blocks = _term_blocks(terms)
    docs = corpus.select(F.col("id").cast("long"), document_terms(F.col("text")).alias("terms"))
    mean = docs.agg((F.coalesce(F.sum(F.size("terms")), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("m")).first()["m"]
    out = None
    for b in range(blocks):
        postings: dict[str, list[tuple[int, int]]] = {}
        place: dict[int, int] = {}
        for r in terms.where(F.col("block") == b).toLocalIterator():
            postings.setdefault(r.term, []).append((place.setdefault(r.qid, len(place)), r.times))
        if not place:
            continue
        packed = {t: (np.array([q for q, _ in x]), np.array([n for _, n in x], dtype=float)) for t, x in postings.items()}
        block = spark.sparkContext.broadcast((np.array(list(place), dtype=np.int64), packed))

        def score(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            qids, known = block.value
            step = max(1, SCORE_CELLS // len(qids))
            for pdf in batches:
                for at in range(0, len(pdf), step):
                    ids, lists = pdf["id"].to_numpy()[at : at + step], pdf["terms"].to_numpy()[at : at + step]
                    sums = np.zeros((len(ids), len(qids)))
                    for d, words in enumerate(lists):
                        base = K1 * (1 - B + B * len(words) / mean) if mean else K1
                        for w, tf in Counter(words).items():
                            if w in known:
                                q, times = known[w]
                                sums[d, q] += times * (tf * (K1 + 1) / (tf + base))
                    sums = sums.T
                    sums[(sums <= 0) | ((not own) & (qids[:, None] == ids[None, :]))] = -np.inf
                    hit = np.flatnonzero(np.isfinite(sums).any(axis=1))
                    if len(hit):
                        r, c = _first(sums[hit], ids, k or len(ids))
                        yield pd.DataFrame({"qid": qids[hit[r]], "id": ids[c], "score": sums[hit[r], c]})

        part = docs.mapInPandas(score, "qid long, id long, score double")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "qid long, id long, score double") if out is None else out


def min_max(scored: DataFrame, group: str, score: str, out: str) -> DataFrame:
    """Scores of each list brought to 0..1; a list of equal scores becomes 1."""
    w = W.partitionBy(group)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return scored.withColumn(out, F.when(hi > lo, (F.col(score) - lo) / (hi - lo)).otherwise(1.0))


def fused(dense: DataFrame, sparse: DataFrame, k: int, weight: float = DENSE_WEIGHT) -> DataFrame:
    """qid, id, score, rank of two min-max lists (qid, id, sim) and (qid, id, score) merged; a missing side counts 0."""
    a = min_max(dense, "qid", "sim", "d").select("qid", "id", "d")
    b = min_max(sparse, "qid", "score", "s").select("qid", "id", "s")
    both = a.join(b, ["qid", "id"], "full").select("qid", "id", (weight * F.coalesce("d", F.lit(0.0)) + (1 - weight) * F.coalesce("s", F.lit(0.0))).alias("score"))
    return topk(both, "qid", k, F.desc(F.round("score", 9)), F.asc("id"))


def rank_fused(dense: DataFrame, sparse: DataFrame, k: int) -> DataFrame:
    """Reciprocal ranks: 1 / rank of the dense list plus 0.75 / rank of the keyword list."""
    parts = dense.select("qid", "id", (1.0 / F.col("rank")).alias("p")).unionByName(sparse.select("qid", "id", (0.75 / F.col("rank")).alias("p")))
    return topk(parts.groupBy("qid", "id").agg(F.sum("p").alias("score")), "qid", k, F.desc(F.round("score", 9)), F.asc("id"))


def reranked(candidates: DataFrame) -> DataFrame:
    """qid, id, score, rank of ``candidates(qid, id, question, text)`` by BM25 with the mean length of each list."""
    c = candidates.select("qid", "id", T.rerank_terms(F.col("question")).alias("q"), T.rerank_terms(F.col("text")).alias("t"))
    c = c.withColumn("dl", F.size("t")).withColumn("avgdl", F.avg("dl").over(W.partitionBy("qid")))

    def part(acc, term):
        tf = F.size(F.filter("t", lambda x: x == term))
        return acc + F.when(tf > 0, tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0)

    scored = c.select("qid", "id", F.aggregate("q", F.lit(0.0), part).alias("score"))
    return topk(scored, "qid", 1 << 30, F.desc(F.round("score", 9)), F.asc("id"))


def section_quota(ranked: DataFrame, k: int, quota: int = 2) -> DataFrame:
    """The first k of ``ranked(qid, id, section, rank)`` with at most ``quota`` of a section; a null section is one."""
    inside = F.row_number().over(W.partitionBy("qid", "section").orderBy("rank"))
    kept = ranked.withColumn("section", F.coalesce("section", F.lit("_unknown"))).withColumn("n", inside).where(F.col("n") <= quota)
    return kept.drop("n").withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy("rank"))).where(F.col("place") <= k)


def _diverse(query: np.ndarray, vectors: np.ndarray, known: np.ndarray, k: int, lam: float) -> np.ndarray:
    """Places of the k rows with the best balance of likeness to the query and to what is already picked.

    A row without a vector has that of the query and doesn't make others alike.
    """
    rows = np.where(known[:, None], vectors, query[None, :])
    size = np.linalg.norm(rows, axis=1)
    unit = np.divide(rows, size[:, None], out=np.zeros_like(rows), where=size[:, None] > 0)
    length = np.linalg.norm(query)
    relevance = unit @ (query / length if length else query)
    alike = unit @ unit.T
    nearest, open_, picked = np.full(len(rows), -np.inf), np.ones(len(rows), dtype=bool), []
    for turn in range(min(k, len(rows))):
        penalty = np.where(np.isinf(nearest), 0.0, nearest)
        score = np.where(open_, lam * relevance - (1 - lam) * penalty if turn else relevance, -np.inf)
        best = int(np.argmax(score))
        picked.append(best)
        open_[best] = False
        if known[best]:
            nearest = np.maximum(nearest, alike[:, best])
    return np.array(picked, dtype=np.int64)


def mmr(candidates: DataFrame, k: int, lam: float = 0.7) -> DataFrame:
    """qid, id, place of the k candidates picked for relevance and diversity from ``candidates(qid, id, rank, section, query, embedding)``.

    Groups are the result lists of a search, so they are as small as its k. A list of which less than half (rounded
    down) has a vector is filled by rank with two of a section instead.
    """
    has = F.coalesce((F.size("embedding") > 0) & (F.size("embedding") == F.size("query")), F.lit(False))
    w = W.partitionBy("qid")
    c = candidates.withColumns({"has": has, "few": F.count(F.when(has, 1)).over(w) < F.floor(F.count("*").over(w) / 2)})

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        query = np.asarray(pdf["query"].iloc[0], dtype=float)
        vectors = np.stack([np.asarray(e, dtype=float) if ok else np.zeros_like(query) for e, ok in zip(pdf["embedding"], pdf["has"], strict=True)])
        chosen = _diverse(query, vectors, pdf["has"].to_numpy(), k, lam)
        return pd.DataFrame({"qid": pdf["qid"].iloc[0], "id": pdf["id"].to_numpy()[chosen], "place": range(1, len(chosen) + 1)})

    spread = section_quota(c.where("few").select("qid", "id", "section", "rank"), k).select("qid", "id", F.col("place").cast("int").alias("place"))
    return c.where("not few").groupBy("qid").applyInPandas(pick, "qid long, id long, place int").unionByName(spread)


def step_back_merge(primary: DataFrame, step_back: DataFrame) -> DataFrame:
    """Two ranked lists (qid, id, rank), the first one first, each id once; rank is the new place."""
    both = primary.select("qid", "id", F.lit(0).alias("src"), "rank").unionByName(step_back.select("qid", "id", F.lit(1).alias("src"), "rank"))
    once = topk(both.withColumnRenamed("rank", "pos"), ["qid", "id"], 1, F.asc("src"), F.asc("pos")).drop("rank")
    return topk(once, "qid", 1 << 30, F.asc("src"), F.asc("pos")).select("qid", "id", "src", "rank")


def knn_vote(near: DataFrame, k: int = 5, least: float = 0.4, default: str = "vector") -> DataFrame:
    """qid, label of the k nearest seeds' majority in ``near(qid, sim, label)``; below ``least`` of k it is ``default``.

    Seeds are ordered by similarity, then label, both falling; the label met first wins a tie.
    """
    top = topk(near, "qid", k, F.desc("sim"), F.desc("label"))
    votes = top.groupBy("qid", "label").agg(F.count("*").alias("votes"), F.min("rank").alias("first"))
    best = topk(votes, "qid", 1, F.desc("votes"), F.asc("first"))
    return best.select("qid", F.when(F.col("votes") / k < least, default).otherwise(F.col("label").cast("string")).alias("label"), "votes")


def episodic_topk(queries: DataFrame, episodes: DataFrame, k: int) -> DataFrame:
    """qid, id, sim, rank of the k episodes of the same user most like each of ``queries(qid, user_id, embedding)``.

    ``episodes(id, user_id, embedding)``; those without an embedding take no part, an episode isn't its own answer.
    """
    from tarnwell.functions.vector import cosine

    e = episodes.where("embedding is not null").select("id", "user_id", F.col("embedding").alias("e"))
    pair = queries.where("embedding is not null").join(e, "user_id").where("qid <> id")
    return topk(pair.select("qid", "id", cosine(F.col("embedding"), F.col("e")).alias("sim")), "qid", k, F.desc(F.round("sim", SIM_DIGITS)), F.asc("id"))


def dense_topk_with_nulls(queries: DataFrame, corpus: DataFrame, k: int, dim: int) -> DataFrame:
    """``dense_topk`` in which rows without a usable vector take part with similarity 0, so they rank before negative ones."""
    near = dense_topk(queries, corpus, k, dim).drop("rank")
    rest = corpus.where(~finite_vector(F.col("embedding"), dim)).select(F.col("id").cast("long").alias("id")).orderBy("id").limit(k + 1)
    q = queries.where(finite_vector(F.col("embedding"), dim)).select(F.col("qid").cast("long").alias("qid"))
    zero = q.crossJoin(F.broadcast(rest)).where("qid <> id").withColumn("sim", F.lit(0.0))  # k + 1 rows stand for all of them
    return topk(near.unionByName(zero.select("qid", "id", "sim")), "qid", k, F.desc(F.round("sim", SIM_DIGITS)), F.asc("id"))


def candidates_by_window(windows: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, window, chunk_id, aligned: the chunks that a window names, else all on its pages.

    ``windows(doc_id, window, page_start, page_end, chunk_ids)``, ``chunks(doc_id, chunk_id, page)``. A window whose ids
    name no chunk falls back to its pages as well; one without pages to all chunks of its document.
    """
    key = ["doc_id", "window"]
    named = windows.select(*key, F.explode("chunk_ids").alias("chunk_id")).distinct().join(chunks.select("chunk_id").distinct(), "chunk_id").select(*key, "chunk_id", F.lit(True).alias("aligned"))
    rest = windows.join(named.select(*key).distinct(), key, "left_anti")
    paged = rest.where("page_start is not null and page_end is not null")
    on_page = paged.select(*key, F.explode(F.sequence("page_start", "page_end")).alias("page")).join(chunks.select("doc_id", "page", "chunk_id"), ["doc_id", "page"])
    whole = rest.where("page_start is null or page_end is null").select(*key).join(chunks.select("doc_id", "chunk_id"), "doc_id")
    return named.unionByName(on_page.unionByName(whole, allowMissingColumns=True).select(*key, "chunk_id", F.lit(False).alias("aligned")))
