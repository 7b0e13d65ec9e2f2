"""Kept collections of vectors: keyed upserts and deletions in whole versions, and search by an inverted file.

A collection belongs to one embedding: provider, model, version and dimension name its folder, and each row carries them, so
that vectors of different embeddings never meet. Rows stand in cells, those of the nearest of some coarse centroids. A change
is written as a folder of its own and becomes visible with a small manifest, which is moved to the next free version number
and never over another; readers take the folders that one manifest names, so they see whole versions only, and a writer that
was overtaken tries the next number. `compact` folds the changes into one folder that holds each key once.

Search is exact if asked to be: a first round visits each query's nearest cells; the angle between query and centroid less
the widest angle within a cell bounds what any row in it can reach, and a second round visits the cells whose bound is not
below what the query has already. Cells with many rows or many queries are dealt out in blocks; each keeps its k best.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire.operators.intake import collection_name
from tidewire.session import checkpointed, small

MOST_CELLS = 4096  # centroids are held whole by each task
SAMPLE = 100_000  # rows that the centroids are fitted on; all rows are assigned
BLOCK = 4096  # rows, and queries, that one task compares at a time


@dataclass(frozen=True)
class Identity:
    provider: str
    model: str
    version: str
    dimension: int

    def __post_init__(self):
        if not (self.provider and self.model and self.version and self.dimension > 0):
            raise ValueError("provider, model, version and dimension name a collection")


class Conflict(Exception):
    """Another writer has taken the version."""


class Collection:
    """The vectors of one embedding. Keys are of one atomic type, that of the first version, payloads are strings.

    Left out by `upsert`: rows whose key is null or whose vector is null, of another dimension, zero, or holds null or
    non-finite entries. Of a key that a batch has several times, the row with the greatest payload (null is least), then
    vector, counts.
    """

    def __init__(self, spark: SparkSession, root: str, identity: Identity, base: str = "items"):
        self.spark, self.identity = spark, identity
        name = collection_name(base, *(F.lit(x) for x in (identity.provider, identity.model, identity.version, identity.dimension)))
        self.folder = f"{root}/{spark.range(1).select(name).first()[0]}"

    # Versions

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        sc = self.spark.sparkContext
        return self._path(self.folder).getFileSystem(sc._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        files, at = self._files(), self._path(f"{self.folder}/versions")
        if not files.exists(at):
            return []
        return sorted(int(s.getPath().getName()[1:]) for s in files.listStatus(at) if s.getPath().getName().startswith("v"))

    def manifest(self, version: int | None = None) -> dict:
        """A version's folders; the latest by default."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise ValueError(f"{self.folder} has no version {'' if version is None else version}".rstrip())
        stream = self._files().open(self._path(f"{self.folder}/versions/v{known[-1] if version is None else version}"))
        found = json.loads(bytes(stream.readAllBytes()).decode())
        stream.close()
        if found["identity"] != asdict(self.identity):
            raise ValueError(f"{self.folder} holds vectors of {found['identity']}")
        return found

    def commit(self, manifest: dict) -> int:
        """Make the manifest's version visible, or raise Conflict if there is one of that number."""
        sc = self.spark.sparkContext
        jvm, files = sc._jvm, self._files()
        draft = self._path(f"{self.folder}/drafts/{uuid.uuid4().hex}")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        to = self._path(f"{self.folder}/versions/v{manifest['version']}")
        files.mkdirs(to.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), sc._jsc.hadoopConfiguration())
        try:
            context.rename(files.makeQualified(draft), files.makeQualified(to), sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            if files.exists(to):
                raise Conflict(manifest["version"]) from e
            raise
        return manifest["version"]

    def _append(self, changes: list[str], attempts: int = 20) -> int:
        """The latest version and these changes as the next one."""
        for _ in range(attempts):
            last = self.manifest()
            try:
                return self.commit({**last, "version": last["version"] + 1, "changes": last["changes"] + [[last["version"] + 1, c] for c in changes]})
            except Conflict:
                continue
        raise Conflict(f"{attempts} versions in a row were taken by others")

    # Writing

    def _usable(self, rows: DataFrame, key: str, vector: str, payload: Column) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        good = F.col(key).isNotNull() & (F.size(v) == self.identity.dimension) & finite & F.exists(v, lambda x: x != 0)
        got = rows.where(good).select(F.col(key).alias("key"), v.alias("vector"), payload.cast("string").alias("payload"))
        return got.groupBy("key").agg(F.max(F.struct("payload", "vector")).alias("r")).select("key", "r.vector", "r.payload")

    def create(self, rows: DataFrame, key: str, vector: str, payload: Column, cells: int = 64, seed: int = 1) -> int:
        """The first version, from a table of any size. Centroids are fitted on a sample bounded by SAMPLE rows."""
        if not 0 < cells <= MOST_CELLS:
            raise ValueError(f"cells must be from 1 to {MOST_CELLS}")
        rows = checkpointed(self._usable(rows, key, vector, payload))
        n = rows.count()
        part = rows if n <= SAMPLE else rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < int((1 << 40) * SAMPLE / n))
        middles = [np.eye(1, self.identity.dimension)[0]]
        if n:
            fitted = KMeans(k=cells, seed=seed, distanceMeasure="cosine", maxIter=10).fit(part.select(array_to_vector(F.transform("vector", lambda x: x / F.array_max(F.transform("vector", F.abs)))).alias("features")))
            middles = fitted.clusterCenters()
        middles = [[float(x) for x in m / np.linalg.norm(m)] for m in middles if np.linalg.norm(m) > 0]
        kept = f"{self.folder}/centroids-{uuid.uuid4().hex}"
        self.spark.createDataFrame(list(enumerate(middles)), "cell int, centroid array<double>").coalesce(1).write.parquet(kept)
        at = self._write(self._in_cells(rows, np.array(middles)), "base")
        return self.commit({"version": 1, "identity": asdict(self.identity), "centroids": kept, "key": rows.schema["key"].dataType.simpleString(), "base": at, "changes": []})

    def _in_cells(self, rows: DataFrame, middles: np.ndarray) -> DataFrame:
        """rows with cell and angle, that from the cell's centroid."""
        held = self.spark.sparkContext.broadcast(middles)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    c = unit(np.stack(b["vector"])) @ held.value.T
                    best = c.argmax(1)
                    b = b.assign(cell=best.astype("int32"), angle=np.arccos(np.clip(c[np.arange(len(b)), best], -1, 1)))
                    yield b

        kind = rows.schema["key"].dataType.simpleString()
        return rows.mapInPandas(assign, f"key {kind}, vector array<double>, payload string, cell int, angle double")

    def _write(self, rows: DataFrame, name: str) -> str:
        at = f"{self.folder}/data/{name}-{uuid.uuid4().hex}"
        for k, v in asdict(self.identity).items():
            rows = rows.withColumn(f"embedding_{k}", F.lit(v))
        rows.repartition("cell", F.pmod(F.xxhash64("key"), F.lit(8))).write.partitionBy("cell").parquet(at)
        return at

    def _centroids(self, manifest: dict) -> np.ndarray:
        return np.array([r.centroid for r in self.spark.read.parquet(manifest["centroids"]).orderBy("cell").collect()])

    def upsert(self, rows: DataFrame, key: str, vector: str, payload: Column) -> int:
        """Put rows in the place of those with their keys, or add them. Returns the version that shows them."""
        m = self.manifest()
        placed = self._in_cells(self._usable(rows.withColumn(key, F.col(key).cast(m["key"])), key, vector, payload), self._centroids(m))
        return self._append([self._write(placed.withColumn("deleted", F.lit(False)), "change")])

    def delete(self, keys: DataFrame, key: str) -> int:
        """Take keys away; those that are not there stay so."""
        gone = keys.select(F.col(key).cast(self.manifest()["key"]).alias("key")).where(F.col("key").isNotNull()).distinct()
        gone = gone.select("key", F.lit(None).cast("array<double>").alias("vector"), F.lit(None).cast("string").alias("payload"), F.lit(-1).alias("cell"), F.lit(0.0).alias("angle"), F.lit(True).alias("deleted"))
        return self._append([self._write(gone, "change")])

    def compact(self, attempts: int = 20) -> int:
        """Fold all changes into one folder. Changes that came meanwhile stay as such."""
        read = self.manifest()
        at = self._write(self.rows(read["version"]), "base")
        for _ in range(attempts):
            last = self.manifest()
            if last["base"] != read["base"]:
                raise Conflict("another writer has compacted the collection")
            try:
                return self.commit({**last, "version": last["version"] + 1, "base": at, "changes": [c for c in last["changes"] if c not in read["changes"]]})
            except Conflict:
                continue
        raise Conflict(f"{attempts} versions in a row were taken by others")

    # Reading

    def _stored(self, at: str, key: str) -> DataFrame:
        own = "embedding_provider string, embedding_model string, embedding_version string, embedding_dimension int"
        got = self.spark.read.schema(f"key {key}, vector array<double>, payload string, angle double, deleted boolean, {own}, cell int").parquet(at)
        for k, v in asdict(self.identity).items():
            got = got.where(F.col(f"embedding_{k}") == F.lit(v)).drop(f"embedding_{k}")
        return got

    def rows(self, version: int | None = None) -> DataFrame:
        """key, vector, payload, cell, angle of a version. Changes are resolved among themselves by key; of the base only
        rows without a change remain, so it is neither sorted nor exchanged while the changed keys are few."""
        m = self.manifest(version)
        columns = ["key", "vector", "payload", "cell", "angle"]
        base = self._stored(m["base"], m["key"]).select(*columns)
        if not m["changes"]:
            return base
        all_ = None
        for number, at in m["changes"]:
            one = self._stored(at, m["key"]).select(*columns, "deleted").withColumn("number", F.lit(number))
            all_ = one if all_ is None else all_.unionByName(one)
        last = all_.groupBy("key").agg(F.max_by(F.struct(*columns[1:], "deleted"), "number").alias("r")).select("key", "r.*")
        return base.join(small(all_.select("key").distinct(), 1_000_000), "key", "left_anti").unionByName(last.where(~F.col("deleted")).drop("deleted"))

    def search(self, queries: DataFrame, key: str, vector: str, k: int = 30, probes: int = 8, least: float | None = None, exact: bool = True, version: int | None = None) -> DataFrame:
        """query, key, payload, score, rank: the k nearest by cosine (4 places), ties to the lesser key, with score >= least.

        k is from 1 to 100. A query without a usable vector has no rows; of repeated queries one counts. Without `exact`
        only the `probes` nearest cells are visited.
        """
        k = max(1, min(int(k), 100))
        m = self.manifest(version)
        middles, rows = self._centroids(m), self.rows(m["version"])
        asked = checkpointed(self._usable(queries, key, vector, F.lit(None)).select(F.col("key").alias("query"), F.col("vector").alias("q")))
        found = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("widest")).collect()  # at most MOST_CELLS
        sizes = self.spark.createDataFrame([(r.cell, r.n) for r in found], "cell int, n long")
        widest = np.full(len(middles), -np.inf)
        for r in found:
            widest[r.cell] = r.widest
        held = self.spark.sparkContext.broadcast((middles, widest))
        kind = asked.schema["query"].dataType.simpleString()

        def visits(first: bool):
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                middles, widest = held.value
                there = np.flatnonzero(widest >= 0)
                for b in batches:
                    if not len(b) or not len(there):
                        continue
                    angle = np.arccos(np.clip(unit(np.stack(b["q"])) @ middles[there].T, -1, 1))
                    near = np.argsort(angle, axis=1, kind="stable")[:, :probes]
                    go = np.zeros(angle.shape, bool)
                    np.put_along_axis(go, near, True, axis=1)
                    if not first:
                        bound = np.cos(np.maximum(0.0, angle - widest[there]))
                        go = ~go & (bound + 1e-4 >= b["reached"].to_numpy()[:, None])  # scores are compared at 4 places
                    i, j = np.nonzero(go)
                    if not len(i):  # an empty column of lists has no type
                        continue
                    yield pd.DataFrame({"query": b["query"].to_numpy()[i], "q": [b["q"].iloc[x] for x in i], "cell": there[j].astype("int32")})

            return run

        shape = f"query {kind}, q array<double>, cell int"
        got = checkpointed(_best(_meet(asked.mapInPandas(visits(True), shape), rows, sizes, k), k))
        if exact and probes < len(found):
            floor = -1.0 if least is None else least
            full = got.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
            reached = F.greatest(F.coalesce(F.col("kth"), F.lit(floor)), F.lit(floor)).alias("reached")
            more = asked.join(full, "query", "left").select("query", "q", reached).mapInPandas(visits(False), shape)
            got = _best(got.drop("rank").unionByName(_meet(checkpointed(more), rows, sizes, k)), k)
        return got if least is None else got.where(F.col("score") >= least)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at unit length; they are scaled by their largest entry first, so that no square over- or underflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    by = W.partitionBy("query").orderBy(F.desc("score"), "key")
    return pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _meet(visits: DataFrame, rows: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """query, key, payload, score: of each block of a cell's rows the k best for each query that visits the cell."""
    counts = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
    plan = F.broadcast(sizes.join(counts, "cell").select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("a"), F.ceil(F.col("m") / BLOCK).cast("int").alias("b")))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(plan, "cell").withColumn("i", spread("a")).withColumn("j", deal("query", "b")).select("cell", "i", "j", "query", "q")
    right = rows.join(plan, "cell").withColumn("j", spread("b")).withColumn("i", deal("key", "a")).select("cell", "i", "j", "key", "vector", "payload")
    types = {c: d.schema[c].dataType.simpleString() for d, c in ((visits, "query"), (rows, "key"))}

    def score(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"query": q["query"][:0], "key": r["key"][:0], "payload": r["payload"][:0], "score": np.zeros(0)})
        r = r.sort_values("key", kind="stable")
        v = unit(np.stack(r["vector"]))
        out = []
        for at in range(0, len(q), 256):
            some = q.iloc[at : at + 256]
            s = np.round(np.clip(unit(np.stack(some["q"])) @ v.T, -1, 1), 4) + 0.0
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            flat = top.ravel()
            out.append(pd.DataFrame({"query": np.repeat(some["query"].to_numpy(), top.shape[1]), "key": r["key"].to_numpy()[flat], "payload": r["payload"].to_numpy()[flat], "score": np.take_along_axis(s, top, 1).ravel()}))
        return pd.concat(out)

    met = left.groupBy("cell", "i", "j").cogroup(right.groupBy("cell", "i", "j"))
    return met.applyInPandas(score, f"query {types['query']}, key {types['key']}, payload string, score double")
