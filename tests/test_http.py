"""Parquet behind a web server: footers on the driver, row groups on the executors."""

import http.server
import threading

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strataq.plans.engine import Engine
from strataq.sources import parquet


@pytest.fixture(params=[True, False], ids=["ranges", "whole files"])
def site(tmp_path, request):
    """A web folder on this machine, and the requests it got."""
    asked = []

    class Handler(http.server.SimpleHTTPRequestHandler):
        def __init__(self, *args):
            super().__init__(*args, directory=str(tmp_path))

        def log_message(self, *args):
            pass

        def do_GET(self):
            data = (tmp_path / self.path.lstrip("/")).read_bytes()
            want = self.headers.get("Range")
            asked.append(want)
            if want and request.param:
                first, last = map(int, want.removeprefix("bytes=").split("-"))
                self.send_response(206)
                data = data[first : last + 1]
            else:
                self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", tmp_path, asked
    server.shutdown()


def test_rows_and_columns(spark, site):
    url, folder, asked = site
    (folder / "a").mkdir()
    (folder / "b").mkdir()
    one = pa.table({"id": list(range(1000)), "name": [None if k % 7 == 0 else f"n{k}" for k in range(1000)], "f": [k / 4 for k in range(1000)]})
    pq.write_table(one, folder / "a" / "x.parquet", row_group_size=300)
    pq.write_table(one.slice(0, 5), folder / "b" / "x.parquet")  # the same base name elsewhere
    df = parquet.scan_url(spark, f"{url}/a/x.parquet")
    assert df.rdd.getNumPartitions() == 4 and sorted(map(tuple, df.collect())) == sorted(zip(*one.to_pydict().values()))
    assert parquet.scan_url(spark, f"{url}/a/x.parquet", ["f"]).groupBy().sum("f").first()[0] == sum(k / 4 for k in range(1000))
    engine = Engine(spark)
    engine.register_http_table("big", f"{url}/a/x.parquet")
    engine.register_http_table("small", f"{url}/b/x.parquet")
    assert engine.execute("SELECT b.id, s.name FROM big b JOIN small s ON b.id = s.id WHERE b.id > 2").count() == 2
    assert engine.unregister_http_table("big") and not engine.unregister_http_table("big")
    assert asked and all(asked)
