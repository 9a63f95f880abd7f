"""CSV over HTTP, and row estimates."""

import functools
import http.server
import threading

from gridlark.sources import CsvOptions, estimated_rows, read_csv, read_csv_url


def test_csv_over_http(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"x\ny"\n2,\n', encoding="utf-8")
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path))
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        df = read_csv_url(spark, f"http://127.0.0.1:{server.server_port}/a.csv")
        server.shutdown()
    assert df.columns == ["k", "v"] and [tuple(r) for r in df.collect()] == [("1", "x\ny"), ("2", None)]


def test_estimates(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("k,v\n" + "".join(f"{k},value {k}\n" for k in range(60_000)), encoding="utf-8")
    assert 0.8 * 60_000 < estimated_rows(spark, str(path)) < 1.2 * 60_000
    small = tmp_path / "c.csv"
    small.write_text('note\nk,v\n1,"a\nb"\n\n2,c\n', encoding="utf-8")
    assert estimated_rows(spark, str(small), CsvOptions(skip_leading_lines=1)) == 2 == read_csv(spark, str(small), CsvOptions(skip_leading_lines=1)).count()
    (tmp_path / "empty.csv").write_text("")
    assert estimated_rows(spark, str(tmp_path / "empty.csv")) is None
