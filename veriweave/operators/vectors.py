"""Vectors: encoding, checks, points, filters, search and sync."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriweave.functions.encoding import Encoder, HashingEncoder, with_unit_vector
from veriweave.functions.groups import in_parts, spread_if_small, top_per_key
from veriweave.functions.identifiers import name_uuid

PREVIEW_CHARS = 500
DEFAULT_THRESHOLD = 0.5
# At most this many query vectors travel to every task; more are handled block by block.
BROADCAST_QUERIES = 4096
POINTS_PER_BLOCK = 50_000
# Blocks are as small as asked for while there are few of them. Where there would be many, they grow
# up to these sizes, so that neither side is copied once for every few rows of the other.
FEW_BLOCKS = 16
LARGE_QUERY_BLOCK = 65_536
LARGE_POINT_BLOCK = 200_000
_CHUNK = 1024
# Points of one product of a chunk: its result stays in a core's cache.
_TILE = 256
# Pairs that wait for their order, and from how many queries on it pays to look for copies of a point.
_WAITING = 1 << 20
_WITHOUT_COPIES = 256

# Payload field -> metadata field.
PAYLOAD = {
    "document_id": "document_id",
    "document_type": "document_type",
    "case_id": "case_id",
    "crime_number": "crime_number",
    "district": "district_name",
    "police_station": "police_station_name",
    "crime_year": "crime_year",
    "crime_month": "crime_month",
    "crime_category": "crime_category_id",
    "major_crime": "major_crime_id",
    "minor_crime": "minor_crime_id",
    "court": "court_name",
    "officer": "officer_id",
    "created_at": "created_at",
    "updated_at": "updated_at",
}


def encode(df: DataFrame, text: str, load: Callable[[], Encoder] | HashingEncoder, out: str = "vector") -> DataFrame:
    """Add the vector of a text column.

    The encoder is loaded once per Python worker. A batch it fails on gets NULL vectors,
    which the checks report, and the run goes on. It counts as nondeterministic, so that no
    filter on the vector makes Spark encode a text twice.
    """

    def to_vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for batch in batches:
            try:
                yield pd.Series(list(encoder(batch.tolist()).astype("float32")), dtype=object)
            except Exception:
                yield pd.Series([None] * len(batch), dtype=object)

    encoded = F.pandas_udf(to_vector, "array<float>").asNondeterministic()
    return spread_if_small(df).withColumn(out, encoded(F.col(text)))


def vector_issues(text: Column, vector: Column, dimension: int) -> Column:
    """Findings on a text and its vector."""
    inf = float("inf")
    found = [
        F.when(text.isNull() | (F.trim(text) == ""), F.lit("Source document text is empty")),
        F.when(vector.isNull(), F.lit("Generated vector is null")),
        F.when(
            F.size(vector) != dimension,
            F.format_string(f"Dimension mismatch: expected {dimension}, got %d", F.size(vector)),
        ),
        F.when(F.exists(vector, F.isnan), F.lit("Vector contains NaN values")),
        F.when(F.exists(vector, lambda v: F.abs(v) == inf), F.lit("Vector contains Infinity values")),
    ]
    return F.array_compact(F.array(*found))


def check_vectors(df: DataFrame, text: str, vector: str, dimension: int) -> DataFrame:
    """Add ``issues`` and ``is_valid``; only valid rows may become points."""
    checked = df.withColumn("issues", vector_issues(F.col(text), F.col(vector), dimension))
    return checked.withColumn("is_valid", F.size("issues") == 0)


def payload(metadata: Column, text: Column) -> list[Column]:
    """The payload fields of a point."""
    fields = [metadata[source].alias(name) for name, source in PAYLOAD.items()]
    return [*fields, F.coalesce(F.substring(text, 1, PREVIEW_CHARS), F.lit("")).alias("text_preview")]


def encode_documents(documents: DataFrame, load: Callable[[], Encoder], dimension: int) -> DataFrame:
    """Documents with their vector and its findings, a row per document.

    The vector of a document in several parts is that of all of them: of the words of
    all parts for the hashing encoder, the mean of the parts' vectors for any other.
    """
    if not in_parts(documents):
        return check_vectors(encode(documents, "text", load), "text", "vector", dimension)
    first = documents.filter("part_no = 0")
    several = documents.filter("part_no > 0").select("document_id").distinct()
    if isinstance(load, HashingEncoder):
        parts = load.add_counts(documents.join(several, "document_id", "left_semi"), "text", "_v")
    else:
        parts = encode(documents.join(several, "document_id", "left_semi"), "text", load, "_v")
    summed = parts.select("document_id", F.posexplode("_v").alias("place", "v")).groupBy("document_id", "place").agg(
        F.sum(F.col("v").cast("double")).alias("v"), F.count(F.lit(1)).alias("n")
    )
    listed = summed.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("place", "v", "n"))).alias("_l"))
    if isinstance(load, HashingEncoder):
        summed_up = listed.select("document_id", F.transform("_l", lambda x: x["v"]).alias("_sums"))
        whole = with_unit_vector(summed_up, "_sums", "_whole")
    else:
        whole = listed.select("document_id", F.transform("_l", lambda x: (x["v"] / x["n"]).cast("float")).alias("_whole"))
    single = encode(first.join(several, "document_id", "left_anti"), "text", load)
    joined = first.join(whole, "document_id").withColumnRenamed("_whole", "vector")
    return check_vectors(single.unionByName(joined), "text", "vector", dimension)


def points_from(encoded: DataFrame) -> DataFrame:
    """Points of the encoded documents that passed the checks."""
    return encoded.filter("is_valid").select(
        name_uuid(F.col("document_id")).alias("point_id"), "vector", *payload(F.col("metadata"), F.col("text"))
    )


def points_of(documents: DataFrame, load: Callable[[], Encoder], dimension: int) -> DataFrame:
    """Points of documents, from text to payload."""
    return points_from(encode_documents(documents, load, dimension))


def matches(conditions: Mapping[str, Any] | None, columns: Mapping[str, str]) -> Column:
    """All conditions at once: None is empty, a list is any of, else equal (E5).

    ``columns`` maps a column to its simple type; "empty" is NULL or an empty array.
    """
    result = F.lit(True)
    for key, value in (conditions or {}).items():
        c = F.col(key)
        if value is None:
            empty = c.isNull()
            if columns.get(key, "").startswith("array"):
                empty = empty | (F.size(c) == 0)
            result = result & empty
        elif isinstance(value, (list, tuple)):
            result = result & F.coalesce(c.isin(*value), F.lit(False))
        else:
            result = result & F.coalesce(c == F.lit(value), F.lit(False))
    return result


def filter_points(points: DataFrame, conditions: Mapping[str, Any] | None) -> DataFrame:
    """Points that meet the conditions (E5)."""
    return points.filter(matches(conditions, dict(points.dtypes)))


def _best(query_ids, queries, query_keys, point_ids, points, point_keys, k, threshold, skip_self, floors=None):
    """The k best points of each query in one batch: arrays (query position, point id, score).

    Queries that ask for the same keys meet only the points that have them. Key 0 asks for
    nothing; any other must be the point's. ``floors`` has the score of each query's k-th best
    so far, where known: points below it are not told.
    """
    import numpy as np

    if not len(query_ids) or not len(point_ids):
        return np.zeros(0, np.int64), point_ids[:0], np.zeros(0)
    if not query_keys:
        return _best_of(query_ids, queries, point_ids, points, k, threshold, skip_self, floors)
    asked, of = np.unique(np.stack(query_keys, axis=1), axis=0, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    ends = np.cumsum(np.bincount(of.ravel(), minlength=len(asked)))
    found = []
    for wanted, at in zip(asked, np.split(order, ends[:-1])):
        has = np.ones(len(point_ids), bool)
        for key, own in zip(wanted, point_keys):
            if key:
                has &= own == key
        if has.any():
            own = None if floors is None else floors[at]
            q, ids, scores = _best_of(query_ids[at], queries[at], point_ids[has], points[has], k, threshold, skip_self, own)
            found.append((at[q], ids, scores))
    return _keep(found, k) if found else (np.zeros(0, np.int64), point_ids[:0], np.zeros(0))


def _best_of(query_ids, queries, point_ids, points, k, threshold, skip_self, floors=None):
    """As ``_best``, without keys.

    Cosines in single precision tell which pairs can be among the best; those are scored in
    double precision, and the score that a point has to reach rises as points are met.
    """
    import numpy as np
    import pandas as pd

    known = ~np.isnan(points).any(axis=1)
    if not known.all():
        # A vector with NaN has no score.
        point_ids, points = point_ids[known], points[known]
    if not len(point_ids):
        return np.zeros(0, np.int64), point_ids, np.zeros(0)
    # A query leaves out as many points as have its own id.
    more = int(np.unique(point_ids, return_counts=True)[1].max()) if skip_self else 0
    if len(query_ids) >= _WITHOUT_COPIES:
        few = _few_copies(point_ids, points, k + more)
        point_ids, points = point_ids[few], points[few]
    places, names = pd.factorize(point_ids, sort=True)
    if (places < 0).any():
        places, names = np.where(places < 0, len(names), places), np.append(names, point_ids[places < 0][:1])
    small, least = points.astype(np.float32), -np.inf if threshold is None else threshold
    # How far a cosine in single precision and the rounding of scores may be off.
    slack = 2e-6 + 1.2e-7 * points.shape[1]
    found = []
    for start in range(0, len(query_ids), _CHUNK):
        own, own_ids = queries[start:start + _CHUNK], query_ids[start:start + _CHUNK]
        own_small = np.ascontiguousarray(own.astype(np.float32).T)
        # Results lie by point, in one place for all tiles, so that the greatest of each query is found fast.
        room = np.empty((_TILE, len(own)), np.float32)
        floor = np.full(len(own), least) if floors is None else np.maximum(least, floors[start:start + _CHUNK])
        bound = (floor - slack).astype(np.float32)
        kept, pending, waiting, due = np.zeros(0, np.int64), [], 0, 1
        for tile, (first, end) in enumerate(_tiles(len(point_ids), _CHUNK), 1):
            rough = np.matmul(small[first:end], own_small, out=room[:end - first] if end - first <= _TILE else None)
            if tile == 1 and len(rough) > k + more and (floor < -1).any():
                # Before there is a floor: what is below the k-th best here can not stay.
                at = len(rough) - k - more
                rough[np.isnan(rough)] = -np.inf
                bound = np.maximum(bound, np.partition(rough, at, axis=0)[at] - np.float32(2 * slack))
            # Most queries have nothing better in a tile, which the greatest of it tells.
            open_ = np.flatnonzero(rough.max(axis=0) >= bound)
            p, q = np.divmod(np.flatnonzero(np.take(rough, open_, axis=1) >= bound[open_]), max(1, len(open_)))
            if len(q):
                q, p = open_[q], p + first
                # The threshold is held against the score itself. Scores are told to six decimals, so
                # copies tie and their order is that of the ids.
                scores = np.einsum("ij,ij->i", own[q], points[p])
                allowed = scores >= least
                if skip_self:
                    allowed &= own_ids[q] != point_ids[p]
                pending.append(_in_order(q[allowed], scores[allowed], places[p[allowed]]))
                waiting += len(pending[-1])
            if pending and (tile >= due or waiting > _WAITING):
                kept = _first_in_order([kept, *pending], k)
                pending, waiting, due = [], 0, tile + -(-tile // 4)
                asked = kept >> 53
                last = np.searchsorted(asked, np.arange(len(own)), side="right") - 1
                full = last - np.searchsorted(asked, np.arange(len(own)), side="left") >= k - 1
                floor[full] = np.maximum(floor[full], _scores_of(kept[last[full]]))
                bound = np.maximum(bound, (floor - slack).astype(np.float32))
        if pending:
            kept = _first_in_order([kept, *pending], k)
        if len(kept):
            found.append(((kept >> 53) + start, names[kept & 0xFFFFFFFF], _scores_of(kept)))
    if not found:
        return np.zeros(0, np.int64), point_ids[:0], np.zeros(0)
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def _tiles(n, first):
    """Ranges of ``n`` points: a first one that gives the queries a floor, and tiles behind it."""
    starts = [0, *range(first, n, _TILE)]
    return list(zip(starts, [*starts[1:], n]))


def _in_order(q, scores, places):
    """One number per pair, in the order of query (of a chunk), score at six decimals, greatest first, and place of the id."""
    import numpy as np

    millionths = np.rint(scores * 1e6).astype(np.int64)
    return q << 53 | (1_000_100 - millionths) << 32 | places


def _scores_of(pairs):
    return (1_000_100 - (pairs >> 32 & 0x1FFFFF)) / 1e6


def _first_in_order(found, k):
    """The first k pairs of each query."""
    import numpy as np

    pairs = np.sort(np.concatenate(found))
    asked = pairs >> 53
    return pairs[np.arange(len(pairs)) - np.searchsorted(asked, asked, side="left") < k]


def _few_copies(ids, rows, n):
    """Positions of the rows but for copies of a row beyond the ``n`` of least id, which are behind those in every ranking."""
    import numpy as np

    whole = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
    _, of = np.unique(whole, return_inverse=True)
    order = np.lexsort((ids, of))
    place = np.arange(len(of)) - np.searchsorted(of[order], of[order], side="left")
    return np.sort(order[place < n])


def _keep(found, k):
    import numpy as np

    q, ids, scores = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    first = np.searchsorted(q, q, side="left")
    kept = np.arange(len(q)) - first < k
    return q[kept], ids[kept], scores[kept]


def _unit(vectors):
    import numpy as np

    matrix = np.array([np.asarray(v, dtype=np.float64) for v in vectors]).reshape(len(vectors), -1)
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def keys_of(queries: DataFrame, points: DataFrame, equal_on: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Queries (query_id, vector) and points with numbers for the columns that must be equal, and the names of those.

    NULL of a query is 0, which asks for nothing. Rows without a vector are left out.
    """
    names = [f"_k{i}" for i in range(len(equal_on))]

    def number(c: str) -> Column:
        return F.abs(F.xxhash64(F.col(c).cast("string")))

    keys = [F.coalesce(number(c), F.lit(1)).alias(n) for c, n in zip(equal_on, names)]
    asked = [F.when(F.col(c).isNull(), F.lit(0)).otherwise(number(c)).cast("bigint").alias(n) for c, n in zip(equal_on, names)]
    return (
        queries.select("query_id", "vector", *asked).filter("vector IS NOT NULL"),
        points.select("*", *keys).filter("vector IS NOT NULL"), names,
    )


def nearest(
    points: DataFrame,
    queries: DataFrame,
    k: int,
    threshold: float | None = None,
    equal_on: Sequence[str] = (),
    skip_self: bool = False,
    broadcast_queries: int = BROADCAST_QUERIES,
    points_per_block: int = POINTS_PER_BLOCK,
) -> DataFrame:
    """The k points of greatest cosine per query: (query_id, point_id, score, rank).

    ``points``: point_id, vector and the ``equal_on`` columns; ``queries``: query_id,
    vector and the same columns, where NULL asks for nothing. Every task keeps k points
    per query, so the pairs are never written out. Few queries go to all tasks, after
    a count; many are met with the points block by block.
    """
    q, p, names = keys_of(queries, points, equal_on)
    p = p.select("point_id", "vector", *names)
    id_type, point_type = dict(q.dtypes)["query_id"], dict(p.dtypes)["point_id"]
    schema = f"query_id {id_type}, point_id {point_type}, score double"
    n_queries = q.limit(broadcast_queries + 1).count()
    if n_queries <= broadcast_queries:
        local = _nearest_broadcast(p, q, names, k, threshold, skip_self, schema)
    else:
        local = _nearest_blocks(p, q, names, k, threshold, skip_self, schema, broadcast_queries, points_per_block)
    return top_per_key(local, ["query_id"], [F.col("score").desc(), F.col("point_id")], k)


def _nearest_broadcast(p, q, names, k, threshold, skip_self, schema):
    best, unit, keep = _by_value()
    asked = q.toPandas()  # at most BROADCAST_QUERIES rows
    shared = p.sparkSession.sparkContext.broadcast(asked)

    def local(batches):
        import numpy as np
        import pandas as pd

        table = shared.value
        if table.empty:
            return
        ids, vectors = table["query_id"].to_numpy(), unit(table["vector"].tolist())
        query_keys = [table[n].to_numpy() for n in names]
        found = []
        for batch in batches:
            if batch.empty:
                continue
            part = best(
                ids, vectors, query_keys, batch["point_id"].to_numpy(), unit(batch["vector"].tolist()),
                [batch[n].to_numpy() for n in names], k, threshold, skip_self,
            )
            found = [keep([*found, part], k)]
        for q_pos, point_ids, scores in found:
            yield pd.DataFrame({"query_id": ids[q_pos], "point_id": point_ids, "score": np.asarray(scores)})

    return p.mapInPandas(local, schema)


def blocks_of(rows: int, per_block: int, large: int) -> int:
    """Blocks of ``per_block`` rows while they are few; beyond that they grow, up to ``large`` rows."""
    return max(1, min(-(-rows // per_block), max(FEW_BLOCKS, -(-rows // large))))


def _nearest_blocks(p, q, names, k, threshold, skip_self, schema, queries_per_block, points_per_block):
    best, unit, _ = _by_value()
    n_point_blocks = blocks_of(p.count(), points_per_block, LARGE_POINT_BLOCK)
    n_query_blocks = blocks_of(q.count(), queries_per_block, LARGE_QUERY_BLOCK)

    def block(c: str, n: int) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    def all_blocks(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    p_side = p.withColumn("pb", block("point_id", n_point_blocks)).withColumn("qb", all_blocks(n_query_blocks))
    q_side = q.withColumn("qb", block("query_id", n_query_blocks)).withColumn("pb", all_blocks(n_point_blocks))

    def local(points, queries):
        import pandas as pd

        if points.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "point_id": [], "score": []})
        ids = queries["query_id"].to_numpy()
        q_pos, point_ids, scores = best(
            ids, unit(queries["vector"].tolist()), [queries[n].to_numpy() for n in names],
            points["point_id"].to_numpy(), unit(points["vector"].tolist()), [points[n].to_numpy() for n in names],
            k, threshold, skip_self,
        )
        return pd.DataFrame({"query_id": ids[q_pos], "point_id": point_ids, "score": scores})

    return p_side.groupBy("pb", "qb").cogroup(q_side.groupBy("pb", "qb")).applyInPandas(local, schema)


def _by_value():
    """The scoring helpers, shipped with the task so that workers need not import this package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return _best, _unit, _keep


def search(
    points: DataFrame,
    queries: DataFrame,
    k: int,
    threshold: float | None = DEFAULT_THRESHOLD,
    equal_on: Sequence[str] = (),
    skip_self: bool = False,
) -> DataFrame:
    """Hits with their payload, ranked per query (E6 with ``threshold=None``, E7)."""
    hits = nearest(points, queries, k, threshold, equal_on, skip_self)
    return hits.join(points.drop("vector"), "point_id")


def content_hash(text: Column, metadata: Column | None = None) -> Column:
    """Fingerprint of a document that does not change when only its time stamps do."""
    if metadata is None:
        return F.sha2(text, 256)
    stable = F.to_json(metadata.dropFields("created_at", "updated_at"))
    return F.sha2(F.concat_ws("\x1f", text, stable), 256)


def detect_changes(documents: DataFrame, manifest: DataFrame, model: str, compare: str = "version") -> DataFrame:
    """Class of every known document: new, modified, deleted or unchanged.

    ``documents``: document_id and ``compare``; ``manifest``: document_id, model and
    ``compare``. A document encoded by another model counts as modified.
    """
    now = documents.select("document_id", F.col(compare).alias("_now"), F.lit(True).alias("_in_store"))
    then = manifest.select("document_id", F.col(compare).alias("_then"), "model", F.lit(True).alias("_in_manifest"))
    both = now.join(then, "document_id", "full_outer")
    same = F.col("_now").eqNullSafe(F.col("_then")) & (F.col("model") == model)
    change = (
        F.when(F.col("_in_manifest").isNull(), "new")
        .when(F.col("_in_store").isNull(), "deleted")
        .when(same, "unchanged")
        .otherwise("modified")
    )
    return both.select("document_id", change.alias("change"), F.col("_now").alias(compare))


def merge_manifest(
    manifest: DataFrame, updates: DataFrame, removed: DataFrame, model: str, compare: str = "version"
) -> DataFrame:
    """The manifest after a run: removed ids gone, updated ids with their new version."""
    changed = updates.select("document_id").unionByName(removed.select("document_id"))
    kept = manifest.join(changed, "document_id", "left_anti").select("document_id", compare, "model")
    return kept.unionByName(updates.select("document_id", compare, F.lit(model).alias("model")))


def change_counts(changes: DataFrame) -> DataFrame:
    """How many documents are new, modified, deleted and unchanged."""
    return changes.agg(*[
        F.count_if(F.col("change") == c).alias(f"{c}_documents") for c in ("new", "modified", "deleted", "unchanged")
    ])


def encoding_counters(checked: DataFrame) -> DataFrame:
    """Documents read, encoded, uploaded, and valid or rejected."""
    return checked.agg(
        F.count(F.lit(1)).alias("documents_processed"),
        F.count("vector").alias("embeddings_generated"),
        F.count_if("is_valid").alias("vectors_uploaded"),
        F.count_if("is_valid").alias("valid"),
        F.lit(0).cast("bigint").alias("skipped"),
        F.count_if(~F.col("is_valid")).alias("errors"),
    )


def collection_statistics(points: DataFrame) -> DataFrame:
    """Points in a collection and the range of their dimensions."""
    size = F.size("vector").cast("bigint")
    return points.agg(
        F.count(F.lit(1)).alias("points"), F.min(size).alias("min_dimension"), F.max(size).alias("max_dimension")
    )
