import random
from pathlib import Path

from pyspark.sql import functions as F

from rosterlab.operators import identity as I
from rosterlab.sources import identity_store as store
from rosterlab.sources import lineups as files
from rosterlab.sources.salaries import scan_salaries
from rosterlab.streaming.upserts import apply_batch, create_log, merge_stream, read_version
from tests_support import identity_tables


def test_lineup_files_keep_their_number(spark, tmp_path):
    for k in (1, 12):
        (tmp_path / f"lineup_{k:02d}.csv").write_text(f"name,pos,team,salary,proj_points,lineup_k\nA,QB,KC,5000,10.5,{k}\nB,RB,KC,x,1,{k}\n")
    got = sorted((r.lineup, r.name, r.salary) for r in files.scan_lineup_files(spark, f"{tmp_path}/lineup_*.csv").collect() if r.salary)
    assert got == [(1, "A", 5000.0), (12, "A", 5000.0)]


def test_salary_scan_is_all_text(spark, tmp_path):
    path = tmp_path / "salaries.csv"
    path.write_text("Name,ID,Salary\nA,007,5000\n")
    rows = scan_salaries(spark, str(path))
    assert [t for _, t in rows.dtypes] == ["string"] * 3 and rows.first().ID == "007"


def test_identity_export_and_import(spark, tmp_path):
    tables = identity_tables(spark)
    for fmt in ("parquet", "csv"):
        store.export_identity(tables, f"{tmp_path}/{fmt}", fmt)
        loaded = store.import_identity(spark, f"{tmp_path}/{fmt}", fmt=fmt)
        counts = {r.table_name: r.row_count for r in I.identity_counts(loaded).collect()}
        assert counts == {"players": 2, "external_ids": 2, "aliases": 3}
        owner = loaded.external_ids.join(loaded.players.withColumnRenamed("id", "player_id"), "player_id").filter("external_id = '9'").first()
        assert owner.canonical_name == "A One"


def test_stream_of_updates_equals_one_merge(spark, tmp_path):
    tables = identity_tables(spark)
    schema = store.EXTERNAL_IDS + ", seq bigint"
    batches = [[(2, "site", "9", "moved", 0.5, 1)], [(1, "site", "9", "back", 0.6, 2), (2, "site", "77", "new", None, 3)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = merge_stream(stream, tables.external_ids, f"{tmp_path}/out", f"{tmp_path}/checkpoint", I.upsert_external_ids, keys=["source_name", "external_id"], buckets=4)
    query.awaitTermination(120)
    last = read_version(spark, f"{tmp_path}/out", query.lastProgress["batchId"] if query.lastProgress["numInputRows"] else query.lastProgress["batchId"] - 1)
    assert last.filter(F.col("external_id") == "77").count() == 1
    assert last.count() == 3


def _same(got, want):
    columns = want.columns
    text = lambda rows: sorted(repr([r[c] for c in columns]) for r in rows.collect())
    assert text(got) == text(want)


def test_log_of_batches_equals_merging_the_whole_table(spark, tmp_path):
    rng = random.Random(4)
    tables = identity_tables(spark)
    name = lambda: rng.choice(["A One", "B Two", "C Three", "D Four", "E Five", "F Six"])
    kinds = {
        "players": (tables.players, I.upsert_players, {"keys": ["canonical_name"], "number": "id"}, "canonical_name string, first_name string, last_name string, position string, team string, nfl_id string, seq bigint"),
        "aliases": (tables.aliases, I.upsert_aliases, {"keys": ["alias_name", "source_name"], "free": "source_name IS NULL"}, store.ALIASES + ", seq bigint"),
    }
    for kind, (table, merge, layout, schema) in kinds.items():
        path = f"{tmp_path}/{kind}"
        create_log(table, path, buckets=3, **layout)
        _same(read_version(spark, path, -1), table)
        for n in range(3):
            if kind == "players":
                rows = [(x := name(), x[0], x[2:], rng.choice(["QB", None]), "KC", None, 10 * n + i) for i in range(3 * (n < 2))]
            else:
                rows = [(rng.randint(5, 6), rng.choice(["Ace", "A.One"]), rng.choice([None, "nfl_api"]), 0.5 * n, 10 * n + i) for i in range(4)]
            batch = spark.createDataFrame(rows, schema)
            table = spark.createDataFrame(merge(table, batch).collect(), table.schema)
            for _ in range(1 + (n == 1)):  # a batch run again changes nothing
                apply_batch(batch, n, path, merge)
            _same(read_version(spark, path, n), table)


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    path = f"{tmp_path}/log"
    start = spark.range(2000).select(F.lit(5).cast("bigint").alias("player_id"), F.lit("site").alias("source_name"), F.col("id").cast("string").alias("external_id"), F.lit("n").alias("player_name_at_source"), F.lit(1.0).alias("confidence_score"))
    start = start.toDF(*[c.split()[0] for c in store.EXTERNAL_IDS.split(", ")])
    create_log(start, path, ["source_name", "external_id"], buckets=8)
    batch = start.limit(1).withColumn("confidence_score", F.lit(0.25)).withColumn("seq", F.lit(1).cast("bigint"))
    apply_batch(batch, 0, path, I.upsert_external_ids)
    assert spark.read.parquet(f"{path}/changes/batch=0").count() == 1
    assert not Path(f"{path}/base/batch=0").exists()
    after = read_version(spark, path, 0)
    assert after.count() == 2000 and after.filter("confidence_score = 0.25").count() == 1
