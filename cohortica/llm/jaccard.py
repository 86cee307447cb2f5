"""N-gram Jaccard join through a token-group matrix.

Every text is the set of its distinct ``n``-word shingles.  Equal sets are one
class.  Classes are partitioned into groups of similar ones, the matrix keeps
each group's token union, a class opens a group only if its overlap with the
union can reach the threshold (and sizes fit), and members of opened groups are
compared exactly.

How this is laid out over executors, with s the size of a set and t the
threshold:

* Groups start as classes with the same three min-hashes, cut into chunks of
  about ``CHUNK``.  Inside a chunk, and between the leaders of the chunks, all
  pairs are compared; connected members then become one group each.
* A class can reach t with a member of a group only if ``depth`` of its first
  s - ceil(t*s) + depth tokens, in a fixed order of all tokens, are among those
  of that member.  The matrix is stored for these tokens, (token, group) once.
  The order puts tokens that many texts share last, so shared passages don't
  meet, and no pair meets by a few words that happen to be the same.
* A pair of groups is met from the smaller one; members of a large group are
  compared block by block.  Groups that are already connected are not opened
  again, so a group of near copies costs one row a token whatever its size.

The order only steers cost: links are exact for any order (up to equal 64-bit
hashes of different shingles).

Nulls and edge cases: a null, blank or empty text has no shingle and links with
nothing, each such row is its own component; fewer than n words are one
shingle; repeated rows are linked to each other; a null doc_id is kept and
never names a component with other ids.  An empty table gives an empty result.
Only id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortica.llm import common

CHUNK = 256
#: Tokens of the members and of the queries that one task compares at once.
TASK_TOKENS = 500_000
#: Tokens of their prefixes that a class and a group must share; the prefixes are longer by as many less one.
DEPTH = 4
#: Characters that are cut into shingles at once, about 60 bytes of arrays each; bytes of texts that are Python objects at once.
SLICE_CHARS, SLICE_BYTES = 400_000, 2 << 20
#: Tokens in at least SHARED texts go last in the order; the driver holds MOST_SHARED of them, the most frequent.
SHARED, MOST_SHARED = 20, 200_000
#: Bits of the maps that keep rows nobody asks for out of shuffles: 2**26 bits are 8 MB, whatever the input.
MAP_BITS = 26
#: Below so many edges a join by node needs no care for hubs.
FEW_EDGES = 200_000

_U = np.uint64
_FACTORS = (np.arange(1, 17, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = _U(0xD6E8FEB86659FD93)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct n-word shingles of each text."""
    out: list[np.ndarray] = []
    start = 0
    while start < len(texts):
        stop, size, words = start, 0, []
        while stop < len(texts) and size < SLICE_CHARS:
            words.append((texts[stop] or "").encode("utf-8", "surrogatepass").lower().split())
            size += len(texts[stop] or "")
            stop += 1
        out += _sets(words, n)
        start = stop
    return out


def _sets(words: list[list[bytes]], n: int) -> list[np.ndarray]:
    counts = np.array([len(w) for w in words])
    if not counts.sum():
        return [np.zeros(0, _U) for _ in words]
    buffer = np.frombuffer(b" ".join(b" ".join(w) for w in words if w) + b" ", np.uint8)
    ends = np.flatnonzero(buffer == 32)
    starts = np.r_[0, ends[:-1] + 1]
    sizes = ends - starts
    place = np.arange(len(buffer)) - np.repeat(starts, sizes + 1)
    powers = np.full(int(sizes.max()) + 2, _BASE).cumprod()
    value = _BYTES[buffer] * powers[place]
    value[ends] = 0
    word = _stir(np.add.reduceat(value, starts) + sizes.astype(_U) * _FACTORS[15])
    total = len(word)
    rolled = np.zeros(total, _U)
    for j in range(n):
        rolled[: max(0, total - j)] += word[j:] * _FACTORS[j]
    rolled = _stir(rolled)
    sets, at = [], 0
    for c in counts.tolist():
        if c >= n:
            sets.append(np.unique(rolled[at : at + c - n + 1]))
        elif c:
            short = (word[at : at + c] * _FACTORS[:c]).sum(dtype=_U, keepdims=True)
            sets.append(_stir(short + np.array([c], _U) * _FACTORS[14]))
        else:
            sets.append(np.zeros(0, _U))
        at += c
    return sets


def _key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


class Threshold:
    """Exact comparisons with the similarity num/den."""

    def __init__(self, num: int, den: int):
        if not 0 < num < den:
            raise ValueError("the threshold must lie between 0 and 1")
        self.num, self.den = num, den
        least = next(n for n in range(1, den * den + 2) if self.partners(n))
        self.depth = min(DEPTH, -(-num * least // den))

    def links(self, both, a, b):
        return both * self.den >= (a + b - both) * self.num

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + self.depth

    def partners(self, n: int) -> bool:
        """Whether a set of n can link with another than itself."""
        return n * self.den >= self.num * (n + 1) or (n - 1) * self.den >= self.num * n


class _Order:
    """Tokens few texts have first, by value; shared ones last, the most frequent at the end."""

    def __init__(self, shared: np.ndarray, rank: np.ndarray):
        self.shared, self.rank = shared, rank

    def first(self, tokens: np.ndarray, count: int) -> np.ndarray:
        if not len(self.shared):
            return tokens[:count]
        at = np.minimum(np.searchsorted(self.shared, tokens), len(self.shared) - 1)
        known = self.shared[at] == tokens
        rare = tokens[~known]
        if len(rare) >= count:
            return rare[:count]
        late = tokens[known][np.argsort(self.rank[at[known]], kind="stable")]
        return np.r_[rare, late][:count]


def _signature(tokens: np.ndarray) -> int:
    least = np.array([_stir(tokens * f).min() for f in _FACTORS[:3]], _U)
    return int(_stir((least * _FACTORS[3:6]).sum(dtype=_U)[None])[0].view(np.int64))


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


class _Bits:
    """A bit map of hashes, no matter how many there are; false hits only cost."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed

    @classmethod
    def of(cls, hashes: DataFrame, bits: int) -> _Bits:
        """``hashes``: one long column.  At most 2**(bits - 15) rows of 4 KB reach the driver."""
        (name,) = hashes.columns
        at = F.pmod(F.col(name), F.lit(1 << bits))
        rows = (
            hashes.select(F.shiftright(at, 15).alias("part"), (at % 32768).alias("bit"))
            .groupBy("part").agg(F.expr("bitmap_construct_agg(bit)").alias("map")).collect()
        )
        packed = np.zeros(1 << (bits - 3), np.uint8)
        for x in rows:
            packed[x.part * 4096 : (x.part + 1) * 4096] = np.frombuffer(x.map, np.uint8)
        return cls(packed)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.astype(np.int64) & (len(self.packed) * 8 - 1)
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _id_hash(ids: pa.Array) -> np.ndarray:
    return _stir(ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)).view(np.int64)


# -- stages -------------------------------------------------------------------------------------------------------------


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of Arrow batches of about SLICE_BYTES: texts become Python objects a few at a time."""
    for b in batches:
        pieces = max(1, -(-b.nbytes // SLICE_BYTES))
        rows = max(1, -(-b.num_rows // pieces))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    common.trim()


def _facts(docs: DataFrame, n: int) -> DataFrame:
    """kind 0: doc_id, size, key, mark of a row.  kind 1: a token several texts of a batch have, in ``doc_id``, and their number."""
    kinds = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("size", pa.int64()), ("key", pa.binary()), ("mark", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = shingle_sets(b.column("text").to_pylist(), n)
            keys = [_key(s) if len(s) else None for s in sets]
            columns = [pa.array(np.zeros(len(sets), np.int32)), b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), b.column("mark").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=kinds)
            own = list({k: s for k, s in zip(keys, sets, strict=True) if k}.values())
            if len(own) > 1:
                tokens, times = np.unique(np.concatenate(own), return_counts=True)
                tokens, times = tokens[times > 1].view(np.int64), times[times > 1]
                columns = [pa.array(np.ones(len(tokens), np.int32)), pa.array(tokens), pa.array(times.astype(np.int64)), pa.nulls(len(tokens), pa.binary()), pa.nulls(len(tokens), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    return common.materialize(docs.mapInArrow(run, "kind int, doc_id long, size long, key binary, mark binary"), "jaccard-facts")


def _shared_tokens(facts: DataFrame) -> _Order:
    rows = (
        facts.where("kind = 1").groupBy(F.col("doc_id").alias("token")).agg(F.sum("size").alias("n")).where(F.col("n") >= SHARED)
        .orderBy(F.col("n").desc(), "token").limit(MOST_SHARED).collect()
    )
    tokens = np.array([x.token for x in rows], np.int64).view(_U)
    order = np.argsort(tokens)
    return _Order(tokens[order], (len(rows) - np.arange(len(rows)))[order])


def _classes(docs: DataFrame, n: int, limit: Threshold, order: _Order) -> DataFrame:
    """key, c (its first 8 bytes), size, signature, prefix of every class that can link with another; doc_hash finds a text of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = shingle_sets(b.column("text").to_pylist(), n)
            held, hashes = {}, _id_hash(b.column("doc_id"))
            for s, h in zip(sets, hashes, strict=True):
                if len(s) and limit.partners(len(s)):
                    held.setdefault(_key(s), (s, int(h)))
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(list(held), pa.binary()), "c": pa.array([_short(k) for k in held], pa.int64()),
                "size": pa.array([len(s) for s, _ in held.values()], pa.int64()), "signature": pa.array([_signature(s) for s, _ in held.values()], pa.int64()),
                "doc_hash": pa.array([h for _, h in held.values()], pa.int64()),
                "prefix": pa.array([order.first(s, limit.prefix(len(s))).tobytes() for s, _ in held.values()], pa.binary()),
            })

    rows = docs.mapInArrow(run, "key binary, c long, size long, signature long, doc_hash long, prefix binary")
    return common.materialize(rows.dropDuplicates(["key"]), "jaccard-classes")


def _with_sets(docs: DataFrame, wanted: DataFrame, n: int, bits: int) -> DataFrame:
    """key, tokens of the classes ``wanted`` (key, doc_hash): their texts are found by the id's hash and cut again."""
    found = _Bits.of(wanted.select("doc_hash"), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            texts = b.column("text").filter(pa.array(found.has(_id_hash(b.column("doc_id"))))).to_pylist()
            sets = {_key(s): s for s in shingle_sets(texts, n) if len(s)}
            yield pa.RecordBatch.from_pydict({"key": pa.array(list(sets), pa.binary()), "tokens": pa.array([s.tobytes() for s in sets.values()], pa.binary())})

    rows = docs.mapInArrow(run, "key binary, tokens binary")
    return rows.join(wanted.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])


def _incidence(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    return tokens[order], owner[order]


def _overlaps(query: np.ndarray, matrix: tuple[np.ndarray, np.ndarray], members: int) -> np.ndarray:
    tokens, owner = matrix
    low, high = np.searchsorted(tokens, query), np.searchsorted(tokens, query, side="right")
    sizes = high - low
    at = np.repeat(low - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(int(sizes.sum()))
    return np.bincount(owner[at], minlength=members)


def _forest(keys: list[bytes], sets: list[np.ndarray], limit: Threshold) -> list[tuple[bytes, bytes]]:
    """Links that connect the members of one chunk, without those between members already connected."""
    size = np.array([len(s) for s in sets])
    matrix = _incidence(sets)
    root = np.arange(len(sets))
    links = []
    for i, s in enumerate(sets):
        both = _overlaps(s, matrix, len(sets))
        for j in np.flatnonzero(limit.links(both, len(s), size)):
            if root[i] != root[j]:
                links.append((keys[i], keys[j]))
                root[root == root[j]] = root[i]
    return links


def _chunk_links(members: DataFrame, limit: Threshold) -> DataFrame:
    """a, b: links that connect the members of each (group, chunk)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        got = _forest(pdf["key"].tolist(), [np.frombuffer(t, _U) for t in pdf["tokens"]], limit)
        return pd.DataFrame({"a": [a for a, _ in got], "b": [b for _, b in got]}, columns=["a", "b"])

    return members.groupBy("signature", "chunk").applyInPandas(run, "a binary, b binary")


def _open_groups(rows: DataFrame, limit: Threshold) -> DataFrame:
    """Queries (asks) against a block of one group: bound by the token union, then compare with the members."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        inside, asks = pdf[~pdf["asks"]], pdf[pdf["asks"]]
        links = []
        if len(inside) and len(asks):
            sets = [np.frombuffer(t, _U) for t in inside["tokens"]]
            keys, size = inside["key"].tolist(), np.array([len(s) for s in sets])
            matrix = _incidence(sets)
            union = np.unique(matrix[0])
            single = bool(inside["connected"].iloc[0])
            for key, raw in zip(asks["key"], asks["tokens"], strict=True):
                s = np.frombuffer(raw, _U)
                at = np.minimum(np.searchsorted(union, s), len(union) - 1)
                if int((union[at] == s).sum()) * limit.den < limit.num * len(s):
                    continue  # the group stays closed
                near = np.flatnonzero(limit.links(_overlaps(s, matrix, len(sets)), len(s), size))
                links += [(key, keys[j]) for j in (near[:1] if single else near) if keys[j] != key]
        return pd.DataFrame({"a": [a for a, _ in links], "b": [b for _, b in links]}, columns=["a", "b"])

    return rows.groupBy("unit", "block", "deal").applyInPandas(run, "a binary, b binary")


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the least key of its component) of every end of ``edges`` (a, b): large and small stars by turns."""
    edges = common.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    before, count = None, edges.count()
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # With few edges no node has many; else the hubs' edges are spread over tasks.
        at = (lambda x, y, key: x.join(y, key)) if count < FEW_EDGES else (lambda x, y, key: common.join_hot(x, y, key, "n"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = at(both.where("v > u"), least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = at(large, least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = common.materialize(small.where("a <> b").distinct(), "components")
        state = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        common.discard(small)
        edges = new
        if (state.n, state.h) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        before, count = (state.n, state.h), state.n


def _roots(edges: DataFrame) -> DataFrame:
    """The table of :func:`connected`, without the edges it was made from."""
    found = connected(edges)
    roots = common.materialize(found, "jaccard-roots")
    common.discard(found)
    return roots


def _cut(members: DataFrame) -> DataFrame:
    """Adds ``chunk`` to classes with a signature: chunks of about CHUNK; drops signatures of one class."""
    counts = members.groupBy("signature").agg(F.count("*").alias("_n"), F.sum("size").alias("_t")).where("_n > 1")
    pieces = F.ceil(F.greatest(F.col("_n") / CHUNK, F.col("_t") / TASK_TOKENS))
    return members.join(counts, "signature").withColumn("chunk", F.pmod(F.xxhash64("key"), pieces).cast("long")).drop("_n", "_t")


def _cross_links(docs: DataFrame, classes: DataFrame, units: DataFrame, n: int, limit: Threshold, bits: int) -> DataFrame:
    """Links between classes of different groups.  ``units``: key, unit, connected."""
    spark = docs.sparkSession
    placed = common.materialize(
        classes.join(units, "key", "left").withColumns({"unit": F.coalesce("unit", "c"), "connected": F.coalesce("connected", F.lit(False))}), "jaccard-units"
    )
    tokens = lambda keep: placed.select("c", "unit", "size", "prefix").mapInPandas(_explode(keep), "token long, c long, unit long, size long")
    live = tokens(None).groupBy("token").agg(F.min("unit").alias("u"), F.max("unit").alias("v")).where("u <> v").select("token")
    live = common.materialize(live, "jaccard-live")
    rows = tokens(_Bits.of(live, bits)).join(live, "token", "left_semi")
    sizes = placed.groupBy("unit").agg(
        F.count("*").alias("members"), F.sum("size").alias("tokens"), F.min("size").alias("low"), F.max("size").alias("high"), F.first("connected").alias("connected")
    )
    rows = common.materialize(rows.join(sizes.select("unit", "members", "low", "high"), "unit"), "jaccard-matrix")
    groups = rows.select("token", F.col("unit").alias("group"), F.col("members").alias("group_members"), "low", "high").distinct()
    asks = rows.select("token", "c", "unit", "size", "members")
    smaller = F.struct("members", "unit") < F.struct("group_members", "group")
    fits = (F.col("size") * limit.den >= F.col("low") * limit.num) & (F.col("high") * limit.den >= F.col("size") * limit.num)
    wanted = common.materialize(asks.join(groups, "token").where(smaller & fits).groupBy("c", "group").count().where(F.col("count") >= limit.depth).select("c", "group"), "jaccard-asks")
    common.discard(live, rows)
    # A group is cut into blocks of TASK_TOKENS; so are the queries that meet one block.
    asked = placed.select("key", "c", "size", "doc_hash").join(wanted, "c")
    load = asked.groupBy("group").agg(F.sum("size").alias("asked")).join(sizes.select(F.col("unit").alias("group"), "members", "tokens", "connected"), "group")
    load = load.select(
        "group", "connected", F.ceil(F.greatest(F.col("tokens") / TASK_TOKENS, F.col("members") / 4096)).alias("blocks"), F.ceil(F.col("asked") / TASK_TOKENS).alias("deals")
    )
    load = common.materialize(load, "jaccard-load")
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    queries = asked.join(load, "group").select(
        "key", "doc_hash", "group", "connected", F.pmod(F.xxhash64("key"), "deals").cast("long").alias("deal"), every("blocks").alias("block"), F.lit(True).alias("asks")
    )
    members = placed.select("key", "doc_hash", F.col("unit").alias("group")).join(load, "group").select(
        "key", "doc_hash", "group", "connected", every("deals").alias("deal"), F.pmod(F.xxhash64("key"), "blocks").cast("long").alias("block"), F.lit(False).alias("asks")
    )
    parties = common.materialize(queries.unionByName(members), "jaccard-parties")
    sets = _with_sets(docs, parties.select("key", "doc_hash").distinct(), n, bits)
    links = common.materialize(_open_groups(parties.join(sets, "key").withColumnRenamed("group", "unit"), limit), "jaccard-links")
    common.discard(placed, wanted, load, parties)
    return links


def _explode(keep: _Bits | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.iloc[at : at + 2000]
                sizes = part["prefix"].map(len).to_numpy() // 8
                token = np.frombuffer(b"".join(part["prefix"]), np.int64)
                out = {"token": token} | {c: np.repeat(part[c].to_numpy(), sizes) for c in ("c", "unit", "size")}
                hit = slice(None) if keep is None else keep.has(token)
                yield pd.DataFrame({k: v[hit] for k, v in out.items()})

    return run


def join(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text", bits: int = MAP_BITS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: rows are linked when num/den of their shingles' union is common."""
    rooted = _rooted(docs, F.lit(None).cast("binary"), n, num, den, id_col, text_col, bits)
    names = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows"))
    named = common.join_hot(rooted.select("doc_id", "n_shingles", "root"), names, "root", "rows")
    return named.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _rooted(docs: DataFrame, mark: Column, n: int, num: int, den: int, id_col: str, text_col: str, bits: int) -> DataFrame:
    """doc_id, mark, n_shingles, root of every row; rows of one component have one root, those without a shingle none."""
    limit = Threshold(num, den)
    common.bound_batches(docs.sparkSession)
    marked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), mark.alias("mark"))
    docs = marked.select("doc_id", "text")
    facts = _facts(marked, n)
    classes = _classes(docs, n, limit, _shared_tokens(facts))
    chunks = common.materialize(_cut(classes.select("key", "size", "signature", "doc_hash")), "jaccard-chunks")
    near = common.materialize(_with_sets(docs, chunks, n, bits).join(chunks, "key"), "jaccard-near")
    inner = common.materialize(_chunk_links(near, limit), "jaccard-links")
    # One leader for each chunk of a cut signature: chunks of near copies meet here, before anything is opened.
    cut = near.groupBy("signature").agg(F.countDistinct("chunk").alias("n")).where("n > 1").select("signature")
    leaders = near.groupBy("signature", "chunk").agg(F.min("key").alias("key")).join(cut, "signature").select("key")
    led = _cut(near.drop("chunk").join(leaders, "key", "left_semi"))
    edges = common.materialize(inner.union(_chunk_links(led, limit)), "jaccard-links")
    linked = _roots(edges)
    as_unit = lambda c: F.xxhash64(c)
    loose = near.select("key", "signature", "chunk").join(linked, F.col("key") == F.col("node"), "left_anti")
    units = linked.select(F.col("node").alias("key"), as_unit("root").alias("unit"), F.lit(True).alias("connected")).unionByName(
        loose.select("key", F.xxhash64("signature", "chunk").alias("unit"), F.lit(False).alias("connected"))
    )
    common.discard(chunks, inner, edges)
    cross = _cross_links(docs, classes, units, n, limit, bits)
    common.discard(classes, near)
    roots = _roots(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).union(cross))
    common.discard(linked, cross)
    rows = facts.where("kind = 0").select("doc_id", "mark", F.col("size").alias("n_shingles"), "key")
    return rows.join(roots, F.col("key") == F.col("node"), "left").select("doc_id", "mark", "n_shingles", F.coalesce("root", "key").alias("root"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text", bits: int = MAP_BITS) -> DataFrame:
    """``docs`` with one row of each component, one of the least id; rows without an id or a shingle stay.

    Rows are told by id and text, so rows that share an id but not the text are
    decided each for itself; of rows that share both, one is kept.
    """
    mark = F.unhex(F.md5(F.encode(common.text_or_empty(text_col), "utf-8")))
    rows = _rooted(docs, mark, n, num, den, id_col, text_col, bits).where("doc_id is not null and root is not null")
    rows = rows.groupBy("root", "doc_id", "mark").agg(F.count("*").alias("times"))
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count("*").alias("rows"))
    own = F.struct("doc_id", "mark") == F.col("first")
    judged = common.join_hot(rows, first, "root", "rows")
    fate = common.materialize(
        judged.where(~own | (F.col("times") > 1)).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), own.alias("_repeated")), "jaccard-fate"
    )
    common.discard(judged)
    # Rows whose id is not in the map stay where they are; the texts of the others alone are dealt out.
    met = _met(docs, F.col(id_col).cast("long"), fate.select("_id"), bits)
    named = met.where("_met").withColumns({"_own_id": F.col(id_col).cast("long"), "_own_mark": mark})
    told = named.join(fate, (F.col("_own_id") == F.col("_id")) & (F.col("_own_mark") == F.col("_mark")), "left")
    one = Window.partitionBy("_own_id", "_own_mark").orderBy(F.when(F.col("_repeated"), F.to_json(F.struct(*[docs[c] for c in docs.columns]))))
    left = told.withColumn("_turn", F.row_number().over(one)).where("_id is null or (_repeated and _turn = 1)")
    return met.where("not _met").select(*docs.columns).unionByName(left.select(*docs.columns))


def _met(docs: DataFrame, key: Column, keys: DataFrame, bits: int) -> DataFrame:
    """``docs`` with ``_met``: false only if ``key`` is none of ``keys`` (one column).  A bit map as in _Bits, broadcast, so no row moves."""
    at = lambda k: F.pmod(F.xxhash64(k), F.lit(1 << bits))
    (name,) = keys.columns
    maps = (
        keys.select(F.shiftright(at(name), 15).alias("_part"), (at(name) % 32768).alias("bit"))
        .groupBy("_part").agg(F.expr("bitmap_construct_agg(bit)").alias("_map"))
    )
    maps = common.materialize(maps, "jaccard-met")
    bit = F.col("_at") % 32768
    byte = F.conv(F.hex(F.substring("_map", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = key.isNotNull() & F.getbit(byte, (bit % 8).cast("int")).eqNullSafe(1)
    joined = docs.withColumn("_at", at(key)).join(F.broadcast(maps), F.shiftright("_at", 15) == F.col("_part"), "left")
    return joined.select(*[docs[c] for c in docs.columns], hit.alias("_met"))
