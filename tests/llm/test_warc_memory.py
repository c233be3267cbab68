"""Archives with large payloads are written and read record by record."""

import gzip
import tracemalloc

import pyarrow as pa

from riskloom.llm import op8_warc


class Frame:
    """Stands for a DataFrame: keeps the function that would run in a task."""

    def __getattr__(self, name):
        return lambda *a, **k: self

    def count(self):
        return 1

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_200_mb_of_payloads_in_one_archive(tmp_path, monkeypatch):
    monkeypatch.setattr(op8_warc, "materialise", lambda df, name: df)
    rows, size = 100, 2_000_000
    one = lambda k: pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([f"http://a/{k}"]), pa.array([chr(97 + k % 26) * size]), pa.array([None], pa.int64())], ["page_id", "url", "html", "refers_to"])
    frame = Frame()
    op8_warc.write_archives(frame, str(tmp_path))
    tracemalloc.start()
    captures = [r for b in frame.run(one(k) for k in range(rows)) for r in b.to_pylist()]
    assert len(captures) == rows and tracemalloc.get_traced_memory()[1] < 12 * size
    frame = Frame()
    op8_warc.read_archives(frame, with_payload=True)
    index = pa.RecordBatch.from_pylist([{**{c: r[c] for c in ("file", "offset", "length", "url_key", "stamp")}, "rank": n} for n, r in enumerate(captures)])
    tracemalloc.reset_peak()
    seen = 0
    for b in frame.run([index]):
        assert b.num_rows * size <= op8_warc.SEND + size
        seen += sum(len(x) for x in b.column(8).to_pylist())
    assert seen == rows * size and tracemalloc.get_traced_memory()[1] < op8_warc.SEND * 2 + 12 * size
    tracemalloc.stop()
    assert len(gzip.decompress((tmp_path / captures[0]["file"].rsplit("/", 1)[1]).read_bytes())) > rows * size
