"""Near-duplicate embeddings: inverted lists, residual product codes, exact cosine rerank.

Unit vectors go to the list of their nearest coarse centre; the residual is coded per
subspace. A query visits the lists of its nearest centres, gets every distance there from
its lookup tables, and keeps what the code's own error cannot rule out, so the codes lose
no link; only lists that are not visited can. Equal vectors are one entry. A task gets one
block of a list and one block of its queries, and returns sums and a spanning forest of
its links, never the links themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.groups import attach_groups, components
from tabulon.llm.workers import prepare
from tabulon.session import materialise

#: Vectors that fit centres and codes, at most about; entries that a list should hold.
SAMPLE_VECTORS = 16_000
LIST_ENTRIES = 512
CELLS = (64, 4096)
PROBES = 16
SUBSPACES = 8
CODES = 64
LLOYD_ROUNDS = 12
#: Entries of a block of a list, and of a block of queries.
BLOCK_ENTRIES = 1024
BLOCK_QUERIES = 4096
_CHUNK = 256


def _centres(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows; at most as many centres as distinct rows."""
    centres = x[np.unique(np.linspace(0, len(x) - 1, min(k, len(x))).astype(int))].copy()
    for _ in range(LLOYD_ROUNDS):
        near = _nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = count > 0
        centres[full] = sums[full] / count[full][:, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([(x[a : a + 4096] @ centres.T - half).argmax(1) for a in range(0, max(len(x), 1), 4096)]).astype(np.int64)


def _matrix(arrays, width: int) -> np.ndarray:
    out = np.zeros((len(arrays), width))
    for k, v in enumerate(arrays):
        out[k, : len(v)] = v
    return out


def _units(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.maximum(np.abs(raw).max(1, keepdims=True), 1e-300)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _splits(width: int) -> list[np.ndarray]:
    return [p for p in np.array_split(np.arange(width), SUBSPACES) if len(p)]


class Index:
    """Unit coarse centres and the residual codebook of each subspace."""

    def __init__(self, width: int, centres: np.ndarray, books: list[np.ndarray]):
        self.width, self.centres, self.books, self.parts = width, centres, books, _splits(width)

    def encode(self, unit: np.ndarray):
        """(cells by closeness, codes, error) of unit vectors."""
        close = unit @ self.centres.T
        probes = np.argsort(-close, axis=1, kind="stable")[:, :PROBES]
        rest = unit - self.centres[probes[:, 0]]
        codes = np.zeros((len(unit), len(self.parts)), np.uint8)
        error = np.zeros(len(unit))
        for m, (part, book) in enumerate(zip(self.parts, self.books)):
            codes[:, m] = _nearest(rest[:, part], book)
            miss = rest[:, part] - book[codes[:, m]]
            error += (miss * miss).sum(1)
        return probes, codes, np.sqrt(error)

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        return [queries[:, part] @ book.T for part, book in zip(self.parts, self.books)]


def fit_index(entries: DataFrame, width: int, cells: int) -> Index:
    """Centres in one task, then one codebook per task, all on one bounded sample."""
    count = entries.count()
    keep = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE_VECTORS / count)) + 1
    sample = materialise(entries.where(keep).select("vec_id", "vector"))

    def coarse(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id", kind="stable")
        found = _units(_centres(_units(_matrix(part["vector"], width)), cells) + 1e-12)
        return pd.DataFrame({"centre": list(found)})

    rows = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(coarse, "centre array<double>").collect()
    centres = np.array([r[0] for r in rows]).reshape(-1, width)
    parts = _splits(width)

    def fine(part: pd.DataFrame) -> pd.DataFrame:
        at = int(part["subspace"].iloc[0])
        unit = _units(_matrix(part.sort_values("vec_id", kind="stable")["vector"], width))
        rest = unit - centres[(unit @ centres.T).argmax(1)]
        return pd.DataFrame({"subspace": at, "book": [_centres(rest[:, parts[at]], CODES).ravel()]})

    per_part = sample.withColumn("subspace", F.explode(F.array(*[F.lit(k) for k in range(len(parts))])))
    books = {r[0]: np.array(r[1]) for r in per_part.groupBy("subspace").applyInPandas(fine, "subspace int, book array<double>").collect()}
    return Index(width, centres, [books[k].reshape(-1, len(p)) for k, p in enumerate(parts)])


def _encoded(index):
    def run(batches):
        for batch in batches:
            raw = _matrix(batch.column(batch.schema.get_field_index("vector")).to_pylist(), index.value.width)
            probes, codes, error = index.value.encode(_units(raw))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(probes.astype(np.int32)), pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                [*batch.schema.names, "probes", "code", "error"],
            )
    return run


def _spanning(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what a block of links connects."""
    out, open_rows = [], linked.any(1)
    while open_rows.any():
        seed = int(open_rows.argmax())
        mine, reach = np.zeros(len(rows), bool), np.zeros(len(columns), bool)
        fresh = np.array([seed])
        while len(fresh):
            mine[fresh] = True
            reach |= linked[fresh].any(0)
            fresh = np.flatnonzero(linked[:, reach].any(1) & ~mine)
        out += [(int(rows[seed]), int(x)) for x in np.concatenate((rows[mine], columns[reach])) if x != rows[seed]]
        open_rows &= ~mine
    return out


def _search(index, threshold: float):
    def run(key, listed: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        links, counts = [], {}
        if len(listed) and len(asking):
            cell = int(key[2])
            ix, ids, copies = index.value, listed["vec_id"].to_numpy(), listed["copies"].to_numpy()
            raw = _matrix(listed["vector"], ix.width)
            length = np.sqrt((raw * raw).sum(1))
            codes = np.frombuffer(b"".join(listed["code"]), np.uint8).reshape(len(listed), -1)
            error, probed = listed["error"].to_numpy(), [set(p) for p in listed["probes"]]
            totals = np.zeros(len(listed), np.int64)
            for a in range(0, len(asking), _CHUNK):
                part = asking.iloc[a : a + _CHUNK]
                own, own_copies, own_raw = part["q_vec_id"].to_numpy(), part["q_copies"].to_numpy(), _matrix(part["q_vector"], ix.width)
                unit, own_length = _units(own_raw), np.sqrt((own_raw * own_raw).sum(1))
                close = np.repeat((unit @ ix.centres[cell])[:, None], len(ids), 1)
                for m, table in enumerate(ix.tables(unit)):
                    close += table[:, codes[:, m]]
                q, x = np.nonzero((close + error >= threshold - 1e-9) & (own[:, None] != ids))
                cosine = np.einsum("ij,ij->i", own_raw[q], raw[x]) / (own_length[q] * length[x])
                q, x = q[cosine >= threshold], x[cosine >= threshold]
                if not len(q):
                    continue
                for i, n in zip(own, np.bincount(q, copies[x], len(own)).astype(np.int64)):
                    counts[i] = counts.get(i, 0) + int(n)
                # An entry that does not visit the query's list learns of the link here.
                cells = part["q_home"].to_numpy()
                blind = np.array([int(c) not in probed[k] for c, k in zip(cells[q], x)])
                totals += np.bincount(x[blind], own_copies[q[blind]], len(ids)).astype(np.int64)
                linked = np.zeros((len(own), len(ids)), bool)
                linked[q, x] = True
                links += _spanning(linked, own, ids)
            for i, n in zip(ids[totals > 0], totals[totals > 0]):
                counts[i] = counts.get(i, 0) + int(n)
        edges = pd.DataFrame(links, columns=["a", "b"]).assign(n=0)
        sums = pd.DataFrame({"a": list(counts), "b": list(counts), "n": list(counts.values())})
        return pd.concat([edges, sums[sums["n"] > 0]]).astype("int64")
    return run


def _found(entries: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): links with n = 0, and link counts of a with n > 0."""
    spark = entries.sparkSession
    stats = entries.agg(F.count(F.lit(1)), F.countDistinct("label"), F.max(F.size("vector"))).first()
    cells = min(max(CELLS[0], -(-stats[0] // (LIST_ENTRIES * stats[1]))), CELLS[1])
    index = spark.sparkContext.broadcast(fit_index(entries, stats[2], cells))
    vector = entries.schema["vector"].dataType.simpleString()
    fields = f"vec_id long, copies long, label string, vector {vector}, size int, probes array<int>, code binary, error double"
    coded = materialise(
        entries.withColumn("size", F.size("vector")).mapInArrow(_encoded(index), fields).withColumn("cell", F.col("probes")[0])
    )
    asked = coded.select("*", F.explode("probes").alias("visit"))
    lists = coded.groupBy("label", "size", "cell").agg(F.count(F.lit(1)).alias("listed"))
    visits = asked.groupBy("label", "size", F.col("visit").alias("cell")).agg(F.count(F.lit(1)).alias("asking"))
    blocks = materialise(
        lists.join(visits, ["label", "size", "cell"])
        .select("label", "size", "cell", F.ceil(F.col("listed") / BLOCK_ENTRIES).alias("list_blocks"), F.ceil(F.col("asking") / BLOCK_QUERIES).alias("query_blocks"))
    )
    place = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    listed = (
        coded.join(blocks, ["label", "size", "cell"]).withColumn("list_block", place("list_blocks", "list")).withColumn("query_block", every("query_blocks"))
        .select("label", "size", "cell", "list_block", "query_block", "vec_id", "copies", "vector", "code", "error", "probes")
    )
    queries = (
        asked.select("label", "size", F.col("visit").alias("cell"), "vec_id", "copies", "vector", F.col("cell").alias("home"))
        .join(blocks, ["label", "size", "cell"])
        .withColumn("query_block", place("query_blocks", "query")).withColumn("list_block", every("list_blocks"))
    )
    keys = ["label", "size", "cell", "list_block", "query_block"]
    queries = queries.select(*[F.col(c).alias(f"q_{c}") for c in keys], *[F.col(c).alias(f"q_{c}") for c in ("vec_id", "copies", "vector", "home")])
    return materialise(
        listed.groupBy(*keys).cogroup(queries.groupBy(*[f"q_{c}" for c in keys]))
        .applyInPandas(_search(index, threshold), "a long, b long, n long")
    )


def embedding_near_dedup(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row, by cosine >= threshold within a label.

    Rows whose id or label is null, and vectors that are null, empty, zero or hold null or
    non-finite parts, link with nothing; so do vectors of different lengths. Rows that share
    an id share its component. Every link found has its exact cosine; links can only be
    missed if neither vector's nearest lists include the other's. Labels may be of any type that
    can be written as text; floats stay floats, other numbers are read as doubles.
    """
    prepare(vectors.sparkSession)
    vector = F.col(vector_col)
    if vectors.schema[vector_col].dataType != T.ArrayType(T.FloatType(), vectors.schema[vector_col].dataType.containsNull):
        vector = vector.cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), vector.alias("vector"),
        F.coalesce(sound & F.col(label_col).isNotNull() & F.col(id_col).isNotNull(), F.lit(False)).alias("sound"),
    )
    rows = rows.withColumns({"one": F.xxhash64("vector"), "two": F.xxhash64(F.lit(1), "vector")})
    key = ["label", "one", "two"]
    sound_rows = rows.where("sound")
    entries = materialise(
        sound_rows.groupBy(*key).agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.min_by("vector", "vec_id").alias("vector"))
    )
    alone = rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not entries.limit(1).count():
        return alone
    found = _found(entries.select("vec_id", "copies", "label", "vector"), threshold)
    counts = found.where("n > 0").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("links"))
    shared = sound_rows.select("vec_id", *key).distinct().groupBy("vec_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("vec_id")
    ties = sound_rows.join(shared, "vec_id").select(F.col("vec_id").alias("a"), *key).join(entries.select(*key, F.col("vec_id").alias("b")), key).select("a", "b")
    parts = components(found.where("n = 0").select("a", "b").unionByName(ties))
    named = materialise(
        entries.select(*key, "vec_id", "copies").join(counts, "vec_id", "left")
        .join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select(*key, "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    )
    total = named.agg(F.sum("copies")).first()[0]
    linked = attach_groups(sound_rows.select("vec_id", *key), named, key, "copies", total)
    return linked.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionByName(alone)
