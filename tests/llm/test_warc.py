"""Archives bounded by bytes: sizes of files, and the same captures whatever the bounds."""

import gzip
from pathlib import Path

import pytest

from meshcast.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h{i % 7}.com/{i}", "x%d " % i * (i * 37 % 900)) for i in range(200)]
    rows += [(500, "http://big.com/", "b" * 300_000), (501, "http://big.com/2", "b" * 300_000), (502, "http://big.com/3", "c" * 40_000), (503, None, None), (503, None, None)]
    rows += [(600 + i, "http://same.com/", "copies of one page " * 1500) for i in range(30)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3, "page_id").cache()


def captures(spark, path):
    rows = warc.read_captures(spark, path).collect()
    return sorted((r.id.rsplit(":", 1)[0], r.kind, r.response.payload_digest or r.original.payload_digest, r.request is not None, r.metadata is not None, r.refers_to is None) for r in rows)


def sizes(path):
    found = [len(gzip.decompress(f.read_bytes())) for f in Path(path).rglob("part-*")]
    return [n for n in found if n]  # an empty partition leaves an empty file


def test_files_are_bounded_by_bytes(spark, pages, tmp_path):
    plain, small, tiny = (str(tmp_path / n) for n in ("plain", "small", "tiny"))
    warc.write_warc(pages, plain)
    warc.write_warc(pages, small, bytes_per_file=100_000, pages_per_file=20)
    warc.write_warc(pages, tiny, bytes_per_file=1, pages_per_file=1)
    # Only the page that is larger by itself passes the bound: its one response, as its copy is a revisit.
    assert sum(n > 100_000 for n in sizes(small)) == 1 and max(sizes(small)) > 300_000
    assert len(sizes(tiny)) == pages.count()
    want = captures(spark, plain)
    assert len(want) == pages.count() == sum(x[3] and x[4] for x in want)
    assert captures(spark, small) == captures(spark, tiny) == want


def test_sizes_in_classes_fill_their_files(spark, tmp_path):
    """Pages of one size share files: as many as fit, so larger ones do not cut the others apart."""
    rows = [(i, "http://a.com/", f"{i:06d}" * 1000) for i in range(64)] + [(100, "http://a.com/", "z" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "w")
    warc.write_warc(pages, path, bytes_per_file=65_536, pages_per_file=32)
    got = sizes(path)
    assert max(got) <= 65_536 and len(got) <= 20


def test_empty_table(spark, pages, tmp_path):
    path = str(tmp_path / "none")
    warc.write_warc(pages.limit(0), path)
    assert warc.read_captures(spark, path).count() == 0
