"""Token ids in files of an adaptive context-mixing range coder.

Ids are coded in blocks; each starts with empty models, has its own checksum and
can be read alone.  Per id, order 2 and order 1 predict the id that last followed
the context.  Whether each holds is coded with a probability that mixes two
adaptive estimates (by the confidence of both orders, by the last outcomes) in
the logistic domain, with weights that learn from every miss.  Where neither
holds, order 0 codes the id's four hexadecimal digits with adaptive frequencies.
A range coder of 32 bits is driven by all of them.

An id's code depends on the model all ids before it left, so a block is one
sequential loop of integers, which no column expression or array operation can
express.  It is the Java function ``coder.java``, built in the driver by the
compiler that Spark uses for its own generated code and sent to the executors
with ADD JAR.  The tokenizer and everything else are Python and DataFrames.

A file is a Parquet table of chunks (Spark's committer makes writing safe
against lost executors; any store it reads will do).  ``blob`` of a row:

    "CMX2" | documents u32 | blocks u32 | crc32 of the rest of the head u32
    per document: null flag u8, doc_id i64, ids u32
    per block: ids u32, bytes u32, crc32 of the ids as u32 little-endian
    the blocks' bytes

Chunks hold whole documents, about ``CHUNK`` ids, in ascending doc_id.

Nulls and edge cases: a null text is empty and, as any empty text, just the end
id; null ids come first, ordered by text, in one part, since nothing but their
order could part them; repeated ids are ordered by text; ids of 65,536 and more
are refused; an empty table gives an empty result.  Only id and text are read,
so extra columns cannot clash.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zipfile
from codecs import charmap_decode
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortica.llm import common

CHUNK = 1 << 20
END = 0
_FUNCTIONS = {"Encode": "binary", "Digest": "array<bigint>", "Decode": "binary"}
_FILES = "part int, chunk int, part_start long, n_ids long, blob binary"
#: Class loader of the built functions, by application.
_built: dict[str, object] = {}


def _build(spark: SparkSession):
    """Compiles ``coder.java`` and adds it, as a jar in the shared folder, to the application."""
    jvm = spark.sparkContext._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook(Path(__file__).with_name("coder.java").read_text())
    classes, jar = compiler.getBytecodes(), io.BytesIO()
    with zipfile.ZipFile(jar, "w") as z:
        for c in classes:
            z.writestr(c.replace(".", "/") + ".class", bytes(classes[c]))
    path = jvm.org.apache.hadoop.fs.Path(f"{common.workspace(spark).rstrip('/')}/coder-{uuid.uuid4().hex}.jar")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(jar.getvalue())
    out.close()
    spark.sql(f"ADD JAR '{path.toString()}'")
    return compiler.getClassLoader()


def _function(spark: SparkSession, name: str) -> str:
    """Registers the Java function ``name`` in this session and returns its name in SQL."""
    app, sql = spark.sparkContext.applicationId, f"cohortica_{name.lower()}"
    if app not in _built:
        _built.clear()
        _built[app] = _build(spark)
    if not spark.catalog.functionExists(sql):
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.lang.Object, 0)
        made = _built[app].loadClass(f"cohortica.coder.{name}").getConstructors()[0].newInstance(none)
        session = spark._jsparkSession
        session.udf().register(sql, made, session.parseDataType(T._parse_datatype_string(_FUNCTIONS[name]).json()))
    return sql


def _call(spark: SparkSession, name: str, *columns: str) -> Column:
    return F.call_function(_function(spark, name), *[F.col(c) for c in columns])


class _Known(dict):
    """Codes of strings by ``make``, in two generations of at most ``most``: what nobody asks for goes with the older one."""

    LONG = 64

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        code = self.old.get(key)
        if code is None:
            code = self.make(key)
        if len(key) <= self.LONG:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = code
        return code


class Encoder:
    """Ids, as little-endian unsigned 16-bit integers, of whole texts by the tokenizers library.

    Its byte-level pre-tokenizer cuts a text by the published pattern, and its
    model merges inside the pieces only, so the library's model sees each distinct
    piece once.  No piece holds a blank after anything else, and of white space
    before other text the last blank belongs to what follows: the texts of a batch
    are cut at their blanks, the distinct units into pieces, and the distinct pieces
    are looked up.  Of units with other letters than ``_LETTERS``, apostrophes or
    several line ends in a row the published pattern itself finds the pieces.  Texts
    with a blank between other white space, or with a special token, go to the
    library whole.
    """

    PIECES, UNITS, MARK = 500_000, 100_000, "\x01"
    _INNER = re.compile(r"\s (?:\s|\Z)")
    _LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
    _ODD = f"^$|^\n|\n\n|[^!-&(-~\n{_LETTERS}]"
    _CUT = f" ?[{_LETTERS}]+| ?[0-9]+| ?[^ \n0-9{_LETTERS}]+|\n"

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The visible character of each byte, as the library's byte-level alphabet has it.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        alphabet = {b: b if b in shown else 256 + k for k, b in enumerate(sorted(range(256), key=lambda b: b in shown))}
        merge, cut, visible = self.tokenizer.model.tokenize, regex.compile(pattern).findall, "".join(chr(alphabet[b]) for b in range(256))
        self.odd = self._ODD if pattern == public_tokenizers.PATTERN else ""  # the empty pattern is in every unit
        raw = self._raw

        def piece(p: str) -> bytes:
            return raw([t.id for t in merge(charmap_decode(p.encode("utf-8"), "strict", visible)[0])])

        self.piece = _Known(piece, self.PIECES).__getitem__
        self.whole = lambda text: b"".join(map(self.piece, cut(text)))
        self.unit = _Known(lambda unit: self.whole(" " + unit), self.UNITS).__getitem__

    _PACK = [struct.Struct(f"<{n}H").pack for n in range(17)]

    @classmethod
    def _raw(cls, ids: list[int]) -> bytes:
        n = len(ids)
        try:
            return cls._PACK[n](*ids) if n < 17 else struct.pack(f"<{n}H", *ids)
        except struct.error:
            raise ValueError("ids of 65,536 and more do not fit the file format") from None

    def _coded(self, units: pa.StringArray) -> pa.LargeBinaryArray:
        """The ids of units, with the blank before them, that are not odd."""
        marked = pc.replace_substring_regex(pc.binary_join_element_wise(" ", units, ""), self._CUT, rf"\0{self.MARK}")
        cut = pc.split_pattern(marked, self.MARK)  # an empty string follows the last piece
        return _joined(cut, _looked_up(cut.flatten().dictionary_encode(), self.piece))

    def many(self, texts: pa.StringArray) -> pa.LargeBinaryArray:
        """The ids of every text of ``texts``, which has no nulls."""
        if not len(texts):
            return pa.array([], pa.large_binary())
        cut = pc.split_pattern(texts, " ")
        units = cut.flatten().dictionary_encode()
        known, at = units.dictionary, units.indices.to_numpy()
        odd = pc.match_substring_regex(known, self.odd)
        strange = known.filter(odd).to_numpy(zero_copy_only=False)
        odd = odd.to_numpy(zero_copy_only=False)
        # Units that white space begins or ends, and texts that hold one or a special token.
        bare = pc.ends_with(known, "\n").to_numpy(zero_copy_only=False)
        bare[odd] = [not u or u[0].isspace() or u[-1].isspace() for u in strange]
        starts = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        suspect = np.logical_or.reduceat(bare[at], starts)
        special = np.zeros(len(texts), bool)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        plain = len(known) - len(strange)
        place = np.where(odd, plain + np.cumsum(odd) - 1, np.cumsum(~odd) - 1)[at]
        # The first unit of a text has no blank before it; the ids of a text that goes to the library whole stand there.
        ends = np.append(starts, len(at))
        heads, nothing = [], len(known) + len(texts)
        for i, head in enumerate(known.take(pa.array(at[starts])).to_numpy(zero_copy_only=False)):
            if (suspect[i] or special[i]) and (special[i] or self._INNER.search(texts[i].as_py())):
                heads.append(self._raw(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids))
                place[ends[i] : ends[i + 1]] = nothing
            else:
                heads.append(self.whole(head))
        place[starts] = len(known) + np.arange(len(texts))
        others = pa.array([*map(self.unit, strange), *heads, b""], pa.large_binary())
        return _joined(cut, pa.concat_arrays([self._coded(known.filter(pa.array(~odd))), others]).take(pa.array(place)))

    def ids(self, text: str) -> bytes:
        return self.many(pa.array([text], pa.string()))[0].as_py()


def _looked_up(coded: pa.DictionaryArray, code: Callable[[str], bytes]) -> pa.LargeBinaryArray:
    return pa.array(list(map(code, coded.dictionary.to_numpy(zero_copy_only=False))), pa.large_binary()).take(coded.indices)


def _joined(lists: pa.ListArray, items: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
    """The bytes of each list of ``lists``, whose items stand in ``items`` one after the other."""
    _, offsets, data = items.buffers()
    at = lists.offsets.to_numpy()
    ends = np.frombuffer(offsets, np.int64)[items.offset :][at - at[0]] if len(items) else np.zeros(len(at), np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends), data if data is not None else pa.py_buffer(b"")])


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    """One a Python worker, whose tasks share what it knows."""
    return Encoder(path, pattern)


def write(docs: DataFrame, folder: str, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Encodes every whole text, appends END to each and writes the chunks, in ascending id, below ``folder``.

    ``path`` is a file of a byte-level tokenizer that every executor has (with the
    library that ships it), ``pattern`` the regular expression of its pre-tokenizer.
    """
    if path is None:
        import public_tokenizers

        path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    spark = docs.sparkSession
    common.bound_batches(spark)
    parts = parts or common.task_count(spark)
    ids = F.col(id_col).cast("long")
    cuts = docs.agg(F.percentile_approx(ids, [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted({int(c) for c in cuts})
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("doc_id"))) + 1 if cuts else F.lit(1)
    rows = docs.select(ids.alias("doc_id"), common.text_or_empty(text_col).alias("text")).withColumn(
        "part", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(part)
    )
    kinds = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int64()), ("documents", pa.binary()), ("ids", pa.binary())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, now, start, number = _encoder(path, pattern), None, 0, 0
        documents, held, size = [], [], 0

        def flush():
            nonlocal documents, held, size, start, number
            row = pa.RecordBatch.from_pydict({"part": [now], "chunk": [number], "part_start": [start], "n_ids": [size], "documents": [b"".join(documents)], "ids": [b"".join(held)]}, kinds)
            start, number = start + size, number + 1
            documents, held, size = [], [], 0
            return row

        end = struct.pack("<H", END)
        for batch in batches:
            coded = encoder.many(batch["text"])
            for p, d, ids in zip(batch["part"].to_pylist(), batch["doc_id"].to_pylist(), coded, strict=True):
                if held and (p != now or size >= CHUNK):
                    yield flush()
                if p != now:
                    now, start, number = p, 0, 0
                got = ids.as_py() + end
                documents.append(struct.pack("<BqI", d is None, d or 0, len(got) // 2))
                held.append(got)
                size += len(got) // 2
        if held:
            yield flush()

    dealt = rows.repartitionById(len(cuts) + 2, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "text")
    plain = dealt.mapInArrow(chunks, "part int, chunk int, part_start long, n_ids long, documents binary, ids binary")
    plain.select("part", "chunk", "part_start", "n_ids", _call(spark, "Encode", "documents", "ids").alias("blob")).write.parquet(folder)


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """first (ids before the chunk in the whole table), blob."""
    files = spark.read.schema(_FILES).parquet(folder)
    totals = sorted((x.part, x.n) for x in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # a row a part
    offsets, before = [], 0
    for p, n in totals:
        offsets.append((p, before))
        before += n
    table = spark.createDataFrame(offsets, "part int, part_offset long")
    return files.join(F.broadcast(table), "part").select((F.col("part_offset") + F.col("part_start")).alias("first"), "blob")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, in any order."""
    chunks = common.once(_placed(spark, folder), "x", _call(spark, "Digest", "blob")).select("first", "x")
    at = lambda i, k: F.get("x", (5 * i + k).cast("int"))
    rows = F.transform(F.sequence(F.lit(0), (F.size("x") / 5).cast("int") - 1), lambda i: F.struct(
        F.when(at(i, 0) == 0, at(i, 1)).alias("doc_id"), (F.col("first") + at(i, 2)).alias("start"), at(i, 3).alias("n_tokens"), at(i, 4).alias("ids_crc32")))
    return chunks.select(F.inline(rows))


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, ids (with END) of every document in the files, in any order."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, n, raw in zip(batch["first"], batch["n"], batch["raw"], strict=True):
                table = list(struct.iter_unpack("<BqI", raw[: 13 * n]))
                ids = np.frombuffer(raw[13 * n :], "<u2").astype(np.int32)
                ends = np.cumsum([k for _, _, k in table])
                yield pd.DataFrame({
                    "doc_id": pd.array([None if null else d for null, d, _ in table], dtype="Int64"), "start": [first + e - k for e, (_, _, k) in zip(ends, table, strict=True)],
                    "ids": [ids[e - k : e] for e, (_, _, k) in zip(ends, table, strict=True)],
                })

    count = F.conv(F.hex(F.reverse(F.substring(F.col("blob"), 5, 4))), 16, 10).cast("int")
    decoded = common.once(_placed(spark, folder), "raw", _call(spark, "Decode", "blob"))
    return decoded.select("first", count.alias("n"), "raw").mapInPandas(rows, "doc_id long, start long, ids array<int>")


def round_trip(docs: DataFrame, **how) -> DataFrame:
    """Writes the files into the shared folder and reads them back."""
    spark = docs.sparkSession
    folder = f"{common.workspace(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    write(docs, folder, **how)
    return read(spark, folder)
