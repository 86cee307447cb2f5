"""The pipeline's stages against what each must do with its own input."""

import collections
import zlib

import duckdb
from test_operators import best_windows, components, multiset, words_of

import corpus_pipeline
from cohortica.llm import queries
from cohortica.llm.queries import OP8_SQL

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.count())
    quality, unique, clean, mixed, sharded = kept
    assert before > quality > unique >= clean > 0 and mixed == sharded
    assert docs.groupBy("text_crc32").agg({"shard": "min"}).count() <= clean
    third, fourth = (spark.read.parquet(str(tmp_path / str(k))) for k in (2, 3))
    assert fourth.select("doc_id").distinct().join(third, "doc_id", "left_anti").count() == 0
    assert fourth.groupBy("doc_id").count().where("count > 3").count() == 0


def test_pipeline_runs_whole(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_mixing_equals_its_sql(spark):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(tuple, queries.op8_mixing(spark, SF).select(cols).collect())) == sorted(db.sql(OP8_SQL).df()[cols].itertuples(index=False, name=None))


def test_stages_keep_what_brute_force_keeps(spark, tmp_path):
    """Stages 2 to 4 row by row on their own input; stage 5 by what every dealing must hold."""
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], SF).write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
    good, unique, clean, mixed = [[(r.doc_id, r.text) for r in t.collect()] for t in tables[1:5]]

    assert len({i for i, _ in good}) == len(good)
    assert sorted(i for i, _ in unique) == sorted(i for i, _, least in components(good, 5, 8, 10) if i == least)

    shingles = lambda t: set(multiset(words_of(t), 5))
    asked = [(x, shingles(x[1])) for x in items]
    holds = set()
    for i, t in unique:
        own = shingles(t)
        near = [x for x, s in asked if s & own or len(words_of(x[1])) < 5]
        holds |= {i for i, _ in best_windows([(i, t)], near)}
    assert sorted(i for i, _ in clean) == sorted({i for i, _ in unique} - holds) and holds

    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/2/*.parquet'")
    want = collections.Counter()
    for i, size, taken in db.sql(f"SELECT doc_id, size, taken FROM ({OP8_SQL})").fetchall():
        if size:
            want[i] = taken // size
    assert collections.Counter(i for i, t in mixed if t and t.strip()) == +want

    dealt = tables[5].collect()
    assert collections.Counter((r.doc_id, r.text_crc32) for r in dealt) == collections.Counter((i, zlib.crc32((t or "").encode())) for i, t in mixed)
    for shard in range(corpus_pipeline.SHARDS):
        slots = sorted(r.slot for r in dealt if r.shard == shard)
        assert slots == list(range(len(slots)))
