"""What tasks hold at once, and that the faster forms give the same."""

import tracemalloc

import numpy as np
import pyarrow as pa

from panelspark.llm import decontaminate, pieces
from panelspark.llm.workspace import ARROW_CONF, Workspace


def test_a_block_of_texts_is_encoded_in_bounded_memory():
    """The arrays of one block took 372 bytes a character (254 now) before unused ones were let go."""
    g = np.random.default_rng(1)
    letters = np.frombuffer(b"etaoinshrdlucmfw", dtype=np.uint8)
    texts = [" ".join(bytes(g.choice(letters, 6)).decode() for _ in range(280)) for _ in range(130)]
    lat = pieces.lattice(pieces.DEFAULT_MODEL, 1.0)
    tracemalloc.start()
    got = pieces.encode_batch(lat, texts, np.arange(len(texts), dtype=np.uint64))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 300 * sum(map(len, texts))
    assert [pieces.decode(lat, x) for x in got] == texts


def test_pieces_come_in_batches_of_one_block(spark, monkeypatch):
    """However large the batches from Spark are, a task encodes and returns one block at a time; pieces do not depend on it."""
    rows = [(i, None if i == 3 else "" if i == 4 else f"some words of text {i} " * (40 if i == 7 else 1 + i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = {r.doc_id: (r.ids, r.n_pieces, r.lossless) for r in pieces.encode_pieces(df).collect()}
    seen, real = [], pieces.encode_batch
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "__key": [str(r[0]) for r in rows]})
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 100)
    monkeypatch.setattr(pieces, "encode_batch", lambda lat, texts, seeds: seen.append(sum(map(len, texts)) if len(texts) > 1 else 0) or real(lat, texts, seeds))
    task = {}  # its function runs in this process
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: task.setdefault("run", f))
    pieces.encode_pieces(df)
    out = list(task["run"](iter([batch])))
    assert len(out) > 5 and max(seen) <= 100
    got = {i: (ids, n, ok) for b in out for i, ids, n, ok in zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in ("doc_id", "ids", "n_pieces", "lossless")), strict=True)}
    assert got == want


def test_python_tasks_get_at_most_eight_megabytes_at_once(spark):
    before = spark.conf.get(ARROW_CONF)
    try:
        spark.conf.set(ARROW_CONF, "64m")
        Workspace(spark)
        assert int(spark.conf.get(ARROW_CONF)) <= 8 << 20
        spark.conf.set(ARROW_CONF, "1m")
        Workspace(spark)
        assert spark.conf.get(ARROW_CONF) == "1m"
    finally:
        spark.conf.set(ARROW_CONF, before)


def test_latent_windows_sum_the_rows_of_known_terms_only():
    """Of windows with one known term in a hundred, sums are held for that one; the vectors are those of plain sums."""
    g = np.random.default_rng(2)
    own = np.arange(0, 1 << decontaminate.TERM_BITS, 100)
    idf = g.random(1 << decontaminate.TERM_BITS).astype(np.float32) + 0.1
    space = decontaminate.LatentSpace(own, idf, g.normal(size=(len(own), 96)).astype(np.float32))
    terms = g.integers(0, 1 << decontaminate.TERM_BITS, 20000)
    starts = np.sort(g.choice(np.arange(500, 19000), 60, replace=False))
    stops = starts + g.integers(8, 300, 60)
    tracemalloc.start()
    got = space.windows(terms, starts, stops)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for v, a, b in zip(got, starts, stops, strict=True):
        want = space.rows[space.place[terms[a:b]]].sum(axis=0) / np.sqrt((idf[terms[a:b]].astype(float) ** 2).sum())
        np.testing.assert_allclose(v, want, atol=2e-4)
    assert most < len(terms) * 96 * 4 / 4, most


def test_marked_places_of_a_mask():
    g = np.random.default_rng(3)
    for n in (0, 1, 7, 8, 9, 64, 1001):
        for share in (0, 0.02, 0.5, 1):
            mask = g.random(n) < share
            assert decontaminate.marked(mask).tolist() == np.flatnonzero(mask).tolist()
