"""Versioned tables, uploads, paged sources and corpus paths against files and a server of the test."""

import hashlib
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from sievewright.operators import rules
from sievewright.sources import paged_http, tables, uploads, versioned

ROWS = [(1, "m", "a"), (2, "m", "b"), (3, "n", "a"), (4, None, "a"), (5, "m", "x/y=z %41{}"), (6, "m", ""), (7, "m", "null"), (8, "m", None)]


def made(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id long, model string, source string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_parts_are_replaced_appended_and_deleted(spark, tmp_path):
    table = versioned.VersionedTable(spark, str(tmp_path / "t"), ("model", "source"))
    assert table.version() == 0 and table.read() is None and table.parts() == {}
    assert table.replace(made(spark)) == 1
    assert set(table.parts()) == {(m, s) for _, m, s in ROWS} and ids(table.read()) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert sorted(map(tuple, table.read().collect()), key=repr) == sorted(ROWS, key=repr)
    table.append(made(spark, [(11, "m", "a"), (12, "new", "a")]))
    assert ids(table.read()) == [1, 2, 3, 4, 5, 6, 7, 8, 11, 12] and ids(table.read(1)) == [1, 2, 3, 4, 5, 6, 7, 8]
    table.replace(made(spark, [(21, "m", "a"), (22, None, "a"), (23, "m", "x/y=z %41{}")]))
    assert ids(table.read()) == [2, 3, 6, 7, 8, 12, 21, 22, 23]
    table.delete(lambda part: part["source"] == "a")
    assert ids(table.read()) == [2, 6, 7, 8, 23] and ids(table.read(only=lambda p: p["source"] is None)) == [8]
    assert table.delete(lambda part: True) == 5 and table.read().collect() == [] and table.read().columns == ["id", "model", "source"]


def test_a_write_that_dies_leaves_the_table_as_it_was(spark, tmp_path):
    table = versioned.VersionedTable(spark, str(tmp_path / "t"), ("model",))
    table.replace(made(spark))
    dies = made(spark).withColumn("id", F.when(F.col("id") == 5, F.raise_error(F.lit("killed"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="killed"):
        table.replace(dies)
    schema, parts = table._write(made(spark, [(99, "m", "a")]))  # written, and never committed
    assert table.version() == 1 and ids(table.read()) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert table.sweep() >= 1 and ids(table.read()) == [1, 2, 3, 4, 5, 6, 7, 8]
    table._commit(1, schema, {})
    with pytest.raises(versioned.Conflict):
        table._commit(1, schema, parts)
    assert table.version() == 2


def test_an_index_of_another_model_or_width_is_no_index(spark, tmp_path):
    table = versioned.VersionedTable(spark, str(tmp_path / "t"), ("model", "source"))
    assert versioned.compatible(table, "m", 2) is None
    table.replace(spark.createDataFrame([(1, "m", "a", [0.0, 1.0]), (2, "k", "a", [0.0])], "id long, model string, source string, embedding array<double>"))
    assert ids(versioned.compatible(table, "m", 2)) == [1]
    assert versioned.compatible(table, "m", 3) is None and versioned.compatible(table, "z", 2) is None


def test_uploads_are_kept_once_however_often_they_come(spark, tmp_path):
    where, out = tmp_path / "in", str(tmp_path / "out")
    where.mkdir()
    bodies = {"b.png": b"\x00same", "a.png": b"\x00same", "c.png": b"\xff\xfe"}
    for name, body in bodies.items():
        (where / name).write_bytes(body)
    first = uploads.read(spark, str(where))
    rows = {r["path"].rpartition("/")[2]: r for r in uploads.named(first, ".png").collect()}
    assert sorted(rows) == ["a.png", "c.png"]
    assert all(r["name"] == hashlib.sha256(bodies[n]).hexdigest()[:32] + ".png" for n, r in rows.items())
    broken = spark.createDataFrame([("z.png", None), ("y.png", None), ("d.png", b"d")], "path string, content binary")
    assert sorted((r["path"], r["name"]) for r in uploads.named(broken, ".png").collect() if r["name"] is None) == [("y.png", None), ("z.png", None)]
    query = uploads.keep(spark.readStream.format("binaryFile").schema(first.schema).load(str(where)), out, ".png", str(tmp_path / "cp"))
    query.awaitTermination()
    kept = lambda: sorted(r["name"] for r in spark.read.parquet(f"{out}/files").collect())
    assert kept() == sorted({r["name"] for r in rows.values()})
    batch = uploads.named(first.unionByName(first), ".png")
    uploads.put_once(batch, 0, out)  # a batch that is replayed
    uploads.put_once(batch, 7, out)  # the same files in a later batch
    assert kept() == sorted({r["name"] for r in rows.values()})
    bad = spark.read.parquet(f"{out}/unreadable") if (tmp_path / "out" / "unreadable").exists() else None
    assert bad is None
    uploads.put_once(uploads.named(broken, ".png"), 8, out)
    uploads.put_once(uploads.named(broken, ".png"), 8, out)
    assert spark.read.parquet(f"{out}/unreadable").count() == 2 and len(kept()) == 3


@pytest.fixture
def server():
    state = {"rows": [{"id": k, "text": f"row {k} 漢"} for k in range(7)], "short": 1, "asked": []}

    class Pages(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            state["asked"].append(asked["page"])
            begin = (asked["page"] - 1) * asked["perPage"]
            body = json.dumps({"rows": state["rows"][begin : begin + asked["perPage"]]}).encode()
            cut = asked["page"] == 2 and state["short"] > 0
            state["short"] -= cut
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body[: len(body) // 2] if cut else body)

        def log_message(self, *_):
            pass

    running = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{running.server_port}/"
    yield state
    running.shutdown()


def test_pages_are_read_whole_and_a_short_one_again(spark, server):
    spark.dataSource.register(paged_http.PagedHttp)
    rows = spark.read.format("paged_http").option("url", server["url"]).option("pages", "3").option("per_page", "3").option("pause", "0").option("wait", "0").load().collect()
    assert sorted(json.loads(r["record"])["id"] for r in rows) == list(range(7))
    assert sorted(server["asked"]) == [1, 2, 2, 3]


def test_a_stream_of_pages_goes_on_where_it_ended(spark, server, tmp_path):
    spark.dataSource.register(paged_http.PagedHttp)

    def run():
        live = spark.readStream.format("paged_http").option("url", server["url"]).option("per_page", "3").option("pause", "0").option("wait", "0").load()
        query = live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(json.loads(r["record"])["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == list(range(6))  # two full pages; a page that is not full may still grow
    server["rows"] += [{"id": k, "text": "new"} for k in range(7, 11)]
    assert run() == list(range(9))  # each page once, from where the checkpoint says


def test_corpus_path_prefers_the_variable(monkeypatch, tmp_path):
    there = {"d", "f", "v"}
    exists = lambda p: p in there
    assert tables.corpus_path("d", "f", "X_CORPUS", exists) == "d"
    monkeypatch.setenv("X_CORPUS", "v")
    assert tables.corpus_path("d", "f", "X_CORPUS", exists) == "v"
    monkeypatch.setenv("X_CORPUS", "gone")
    assert tables.corpus_path("e", "f", "X_CORPUS", exists) == "f"
    with pytest.raises(FileNotFoundError, match="X_CORPUS"):
        tables.corpus_path("e", None, "X_CORPUS", exists)


def test_a_manual_choice_goes_before_the_route(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, "a b", "q"), (3, "zzz", "p")], "id int, text string, chosen string")
    packs = [rules.Pack("p", ("a", "b"), priority=1, route_min=0.4), rules.Pack("q", ("zz",), route_min=0.4)]
    got = {r["id"]: r["primary"] for r in rules.route(df, packs, "id", "text", F.col("chosen")).collect()}
    assert got == {1: "p", 2: "q", 3: "p"}


def test_the_first_row_as_read_stays(spark, tmp_path):
    rows = [("b", "z"), ("a", "y"), (None, "n"), ("b", "a"), (None, "n"), ("a", "x"), (None, "")]
    df = spark.createDataFrame(rows, "case_id string, text string").coalesce(1)
    facts = tables.write_corpus(df, str(tmp_path / "c"))
    kept = sorted(((r["case_id"] or "", r["text"]) for r in spark.read.parquet(str(tmp_path / "c")).collect()))
    assert kept == [("", ""), ("", "n"), ("", "n"), ("a", "y"), ("b", "z")] and facts["duplicates_dropped"] == 2 and facts["rows"] == 5
