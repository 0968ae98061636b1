"""Snapshots, job tables, progress, the prompt, and the paged source against a local server."""

import io
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from glyphloom.operators import decode, graph
from glyphloom.operators.kernel import build
from glyphloom.operators.sequence import snapshots, stream_pairs
from glyphloom.plans.job import JobConfig, JobRunner
from glyphloom.plans.report import Progress, job_table, prompt_loop
from glyphloom.sources.paged import PagedRows


def test_snapshots(spark):
    df = spark.createDataFrame([(1, "abcabcabcabc"), (2, None)], "doc_id long, text string")
    got = {r["stream_key"]: r["sequencers"] for r in snapshots(df).collect()}
    seq = build("merge")
    for c in "abcabcabcabc":
        seq.push(ord(c))
    for have, want in zip(got[1], seq.snapshot(), strict=True):
        assert (have["name"], have["ints_in"], have["sequences_emitted"], have["ints_per_emit"]) == tuple(want[k] for k in ("name", "ints_in", "sequences_emitted", "ints_per_emit"))
        assert have["gates"][0]["pass_rate"] == want["gates"][0]["pass_rate"] and have["gates"][0]["custom_metrics"] == want["gates"][0]["custom_metrics"]
    assert [s["ints_per_emit"] for s in got[2]] == [None] * 3


def test_job_table(spark):
    df = spark.createDataFrame([(1, "ababab")], "doc_id long, text string")
    runner = JobRunner(JobConfig(meta={"a": "1"}))
    rows = job_table(spark, [runner.measure(df), runner.run(df)]).collect()
    assert rows[0]["tokens_out"] == 5 and rows[0]["job_meta"] == {"a": "1"} and rows[1]["mb_sec"] is None


def test_prompt(spark):
    df = spark.createDataFrame([(1, "ababab")], "doc_id long, text string")
    out = io.StringIO()
    prompt_loop(decode.freeze(graph.edges_accumulate(stream_pairs(df))), ["abab\n", "\n", "aba\n", "quit\n", "ab\n"], out)
    assert out.getvalue().splitlines() == ["ab | ab", "ab | a"]


def test_progress():
    class P:
        name, id, numInputRows, processedRowsPerSecond = "q", "i", 6, 3.0

    class E:
        progress = P

    out = io.StringIO()
    p = Progress(10, out)
    for _ in range(4):
        p.onQueryProgress(E)
    p.onQueryTerminated(None)
    assert out.getvalue().splitlines() == ["q: 12 rows, 3 a second", "q: 24 rows, 3 a second", "ended after 24 rows"]


@pytest.fixture
def api():
    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            bad = q.get("dataset") == "none"
            at, n = int(q["offset"]), int(q["length"])
            rows = [{"row": {"text": None if i == 3 else f"row {i}"}} for i in range(at, min(at + n, 25))]
            self.send_response(404 if bad else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"rows": rows}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/rows"
    server.shutdown()


def test_paged_rows(spark, api):
    spark.dataSource.register(PagedRows)
    read = lambda **o: sorted((r["row_idx"], r["text"]) for r in spark.read.format("paged_rows").options(url=api, **o).load().collect())
    want = [(i, "" if i == 3 else f"row {i}") for i in range(25)]
    assert read(dataset="d", batch="10") == want
    assert read(dataset="d", batch="4", total="12", parts="3", offset="2") == want[2:14]
    assert read(dataset="d", total="100", parts="4", batch="7") == want
    with pytest.raises(Exception, match="404"):
        read(dataset="none")
    with pytest.raises(Exception, match="batch"):
        read(dataset="d", batch="0")
