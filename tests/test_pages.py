"""Pages behind cursors: chains, cut-offs, retries and streams."""

import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.sources import pages as P


def landed(spark, path, rows, size=3):
    df = spark.createDataFrame(rows, "repo string, at string, id int, cursor string, position string")
    P.land(df, str(path), F.col("repo"), F.col("at"), ["id"], size)
    P.register(spark)
    return df


def made():
    rows = [(r, f"2024-0{1 + i % 9}-01", i, "x", "y") for i in range(40) for r in ("a/b", "hot", "hot") if r == "hot" or i % 3 == 0]
    return [(r, at, i, *rest) for i, (r, at, _, *rest) in enumerate(rows)] + [(None, "2024-05-05", 900, "x", "y"), ("odd =*%", None, 901, "x", "y"), ("odd =*%", "2020-01-01", 902, "x", "y")]


def expected(rows):
    out = []
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] or "", r[2]), reverse=True)
        out += [(key or "null", i, r[1], r[2]) for i, r in enumerate(own)]
    return sorted(out, key=repr)


def read(df):
    return sorted(((r.key, r.position, r.created, json.loads(r.node)["id"]) for r in df.collect()), key=repr)


def test_pages_are_read_back_by_their_cursors(spark, tmp_path):
    rows = made()
    landed(spark, tmp_path / "p", rows)
    got = spark.read.format("cursor_pages").option("path", str(tmp_path / "p")).option("shards", 3).load()
    assert read(got) == expected(rows) and got.rdd.getNumPartitions() == 3
    folders = [f for f in (tmp_path / "p").rglob("part-*") if f.suffix == ".json"]
    assert max(len(f.read_text().splitlines()) for f in folders) == 3


def test_since_and_most_end_a_chain(spark, tmp_path):
    rows = made()
    landed(spark, tmp_path / "p", rows)
    source = spark.read.format("cursor_pages").option("path", str(tmp_path / "p"))
    assert read(source.option("since", "2024-06-01").load()) == [r for r in expected(rows) if (r[2] or "") >= "2024-06-01"]
    assert read(spark.read.format("cursor_pages").option("path", str(tmp_path / "p")).option("most", 4).load()) == [r for r in expected(rows) if r[1] < 4]


def test_older_pages_are_not_asked_for(spark, tmp_path):
    """A bound on `created` is pushed down: pages beyond it may even be unreadable."""
    landed(spark, tmp_path / "p", made())
    newest = max(r[1] for r in made() if r[0] == "hot")
    chain = [c for c, *_ in P._chain(P.LandedPages(str(tmp_path / "p")), "hot", P.START)]
    for f in (tmp_path / "p" / "key=hot" / f"cursor={chain[-1]}").glob("part-*"):
        f.write_text("broken")
    rows = spark.read.format("cursor_pages").option("path", str(tmp_path / "p")).load().filter(F.col("created") >= newest)
    assert {r.key for r in rows.collect()} == {r[0] for r in made() if (r[1] or "") >= newest and r[0]}
    with pytest.raises(Exception, match="Expecting value|JSONDecodeError"):
        spark.read.format("cursor_pages").option("path", str(tmp_path / "p")).load().collect()


def test_a_failing_store_is_asked_again(monkeypatch):
    monkeypatch.setattr(P, "WAIT", 0)
    calls = []

    class Store:
        def page(self, key, cursor):
            calls.append(cursor)
            if len(calls) < 3:
                raise OSError("rate limit")
            return [{"position": 0, "next": None}], None

    assert [c for c, *_ in P._chain(Store(), "k", P.START)] == [P.START] and len(calls) == 3
    monkeypatch.setattr(Store, "page", lambda *_: (_ for _ in ()).throw(OSError("down")))
    with pytest.raises(OSError, match="down"):
        list(P._chain(Store(), "k", P.START))


def test_a_stream_goes_on_at_its_cursors(spark, tmp_path):
    rows = made()
    landed(spark, tmp_path / "all", rows)
    there, out, checkpoint = tmp_path / "there", tmp_path / "out", tmp_path / "checkpoint"
    chains = {k: [c for c, *_ in P._chain(P.LandedPages(str(tmp_path / "all")), k, P.START)] for k in P.LandedPages(str(tmp_path / "all")).keys()}

    def arrive(key, some):
        for c in some:
            name = f"key={P._escaped(key)}/cursor={c}"
            shutil.copytree(tmp_path / "all" / name, there / name)

    def run():
        stream = spark.readStream.format("cursor_pages").option("path", str(there)).option("shards", 2).load()
        stream.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start(str(out)).awaitTermination()
        return read(spark.read.parquet(str(out)))

    arrive("hot", chains["hot"][:4])
    assert run() == [r for r in expected(rows) if r[0] == "hot" and r[1] < 12]
    arrive("hot", chains["hot"][4:])
    arrive("a/b", chains["a/b"])
    assert run() == [r for r in expected(rows) if r[0] in ("hot", "a/b")]
    for name in chains.keys() - {"hot", "a/b"}:
        arrive(name, chains[name])
    assert run() == expected(rows) == run()
    assert Path(checkpoint).exists()


def test_no_pages(spark, tmp_path):
    P.register(spark)
    assert spark.read.format("cursor_pages").option("path", str(tmp_path / "none")).load().count() == 0
