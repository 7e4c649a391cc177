"""Vector codes, hard negatives and packing against brute force, and their edge cases."""

import bisect
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelspark.llm import codes, negatives, packing
from panelspark.llm.workspace import Workspace

SCHEMA = "vec_id long, embedding array<float>, label int, error string, rank string, id string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "clash", "clash", "clash") for i, v, y in rows], SCHEMA)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(rows, scale, multiple=1):
    kept = [(i, v, y) for i, v, y in rows if usable(v)]
    size = max([multiple, *(-(-len(v) // multiple) * multiple for _, v, _ in kept)])
    return [(i, tuple(math.floor(float(np.float32(x)) * scale) for x in v) + (0,) * (size - len(v)), y) for i, v, y in kept]


@pytest.fixture(scope="module")
def vectors():
    g = np.random.default_rng(5)
    rows = [(int(i), g.normal(0, 0.2, 16).astype(np.float32).tolist(), int(i) % 4) for i in range(700)]
    rows += [(i, rows[3][1], 2) for i in range(700, 1000)]  # copies, more than a leaf of a tree holds
    rows += [(50, rows[50][1], 2), (50, rows[7][1], 1), (None, rows[9][1], 3), (None, rows[9][1], None), (1001, None, 1), (1002, [None, 1.0], 1), (1003, [float("nan")] * 16, 1), (1004, [float("inf")] * 16, 1), (1005, [0.5, -0.5], 3), (1006, [], 0), (1050, rows[50][1], None)]
    return rows


def brute_codes(rows, parts, entries, rounds, scale):
    kept = whole(rows, scale, parts)
    start = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in start] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            got = defaultdict(list)
            for _, v, _ in kept:
                got[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [tuple(sum(c) // len(got[k]) for c in zip(*got[k], strict=True)) if k in got else e for k, e in enumerate(books[p])]
    out = []
    for i, v, y in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), y))
    total = defaultdict(int)
    for _, _, e, y in out:
        total[y] += e
    return Counter((i, c, e, total[y]) for i, c, e, y in out), books


@pytest.mark.parametrize("block", [64, 4096])
def test_vector_codes_equal_brute_force(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(codes, "BLOCK", block)
    df = table(spark, vectors).repartition(3)
    got, books = codes.compress_vectors(df, parts=4, entries=9, rounds=3, scale=256)
    want, want_books = brute_codes(vectors, 4, 9, 3, 256)
    assert [[tuple(e) for e in b.tolist()] for b in books] == want_books
    rows = codes.with_label_error(got).select("vec_id", "code", "error", "label_error").collect()
    assert Counter(map(tuple, rows)) == want
    few, _ = codes.compress_vectors(table(spark, vectors[:3]), parts=4, entries=9)
    assert few.count() == 3 and {r["error"] for r in few.collect()} == {0}
    none, books = codes.compress_vectors(table(spark, []))
    assert none.count() == 0 and codes.book_digest(books) == codes.book_digest([])


def test_balls_hold_their_points_and_share_out_exactly():
    g = np.random.default_rng(1)
    x = np.concatenate([g.integers(-300, 300, (900, 5)), np.repeat(g.integers(-300, 300, (1, 5)), 100, axis=0)])
    tree = codes.BallTree.build(x)
    assert sorted(tree.order.tolist()) == list(range(len(x))) and (x[tree.order] == tree.x).all() and (tree.left >= 0).sum() > 20
    for i in range(len(tree.count)):
        own = tree.x[tree.lo[i] : tree.hi[i]]
        assert len(own) == tree.count[i] and (own.sum(axis=0) == tree.total[i]).all()
        assert (np.sqrt(((own - tree.centre[i]) ** 2).sum(axis=1)) <= tree.radius[i] + 1e-6).all()
    for entries in (x[:12], np.repeat(x[:4], 3, axis=0), g.integers(-9, 9, (7, 5)), x[:1]):
        d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        count, total = tree.assign(entries)
        assert count.tolist() == np.bincount(d.argmin(axis=1), minlength=len(entries)).tolist() and total.sum(axis=0).tolist() == x.sum(axis=0).tolist()
        code, error = tree.assign(entries, each=True)
        assert (code == d.argmin(axis=1)[tree.order]).all() and (error == d.min(axis=1)[tree.order]).all()


def brute_negatives(rows, every, n_pos, n_neg, low, high, scale):
    kept = [(k, i, v, y) for k, (i, v, y) in enumerate(whole(rows, scale)) if y is not None]
    order = lambda s, r: (-s, r[1] is None, r[1] or 0)
    out = Counter()
    for a in kept:
        if a[1] is None or a[1] % every:
            continue
        scored = sorted(((sum(p * q for p, q in zip(a[2], r[2], strict=True)), r) for r in kept if r[0] != a[0]), key=lambda x: order(*x))
        for ps, p in [x for x in scored if x[1][3] == a[3]][:n_pos]:
            window = [x for x in scored if x[1][3] != a[3] and low * ps <= 100 * x[0] <= high * ps]
            for rank, (s, r) in enumerate(window[:n_neg], 1):
                out[a[1], p[1], rank, r[1], ps, s] += 1
    return out


@pytest.mark.parametrize("block", [100, 8192])
def test_hard_negatives_equal_brute_force(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    got = negatives.hard_negatives(table(spark, vectors).repartition(3))
    want = brute_negatives(vectors, 50, 5, 3, 50, 95, 256)
    assert sum(want.values()) > 50 and Counter(map(tuple, got.collect())) == want
    assert negatives.hard_negatives(table(spark, [])).count() == 0
    assert negatives.hard_negatives(table(spark, [(50, [1.0], 1), (51, [1.0], 2)])).count() == 0


def test_threshold_search_stops_early_and_loses_nothing():
    g = np.random.default_rng(3)
    x = (g.normal(0, 1, (6000, 3)) * 256).astype(np.int64)
    lists = negatives.Lists(negatives.packed(0, np.arange(6000), np.zeros(6000, bool), np.zeros(6000, np.int64), x))
    for q in x[:5]:
        held = negatives.Held(4)
        scored = negatives.search(q, None, lists.orders, lists, [held], lambda at, s, held=held: held.add(s, lists.noid[at], lists.ids[at], 0, at))
        want = sorted((-int(s), i) for i, s in enumerate(x @ q))[:4]
        assert [(r[0], r[2]) for r in held.rows] == want and scored < 4500


def brute_sequences(lengths, capacity):
    free, n = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(free, x)
        room = free.pop(at) if at < len(free) else capacity
        n += room == capacity
        bisect.insort(free, room - x)
    return n


def check_packing(rows, capacity):
    used = defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(used) == brute_sequences([r["length"] for r in rows], capacity)


def test_packing_equals_brute_force(spark, monkeypatch, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CHUNK_ROWS", 40)
    r = random.Random(4)
    odd = ["It's we'LL 'twas don't!! a²b ½ x_y a\x0bb \x85 c\x1cd <|endoftext|> İx Σίσυφος é 日本語 ３ ''s 'Ve < <| <|", "\x01\x02 a\x01 b\x02", "ǆǄ ªº µ ÿŸ ɐ ¬¦×÷ «hi» 1st 2² 'd'd'", "", None, " \n\t\r "]
    texts = odd + ["a"] * 120 + [" ".join(r.choice(["Alpha,", "beta", "Größe", "x1", "naïve."]) for _ in range(r.randrange(1, 90))) for _ in range(150)] + ["word " * 700]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, "again"), (5, "again"), (None, "no id"), ((1 << 60) + 1, "large id")]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, length string, row string").repartition(4)
    got = packing.pack_documents(df, capacity=128).collect()
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in rows:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for p, s in enumerate(range(0, len(ids), 128)):
            cut = ids[s : s + 128]
            want[i, p, s, len(cut), zlib.crc32(cut.tobytes()), tuple(cut.tolist())] += 1
    assert Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"], tuple(x["ids"])) for x in got) == want
    check_packing(got, 128)
    assert packing.pack_documents(df.limit(0)).count() == 0
    packing.write_sequences(packing.pack_documents(df, capacity=128), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sum(b["n_ids"] for b in back) == sum(x["length"] for x in got) and all(len(b["ids"]) == b["n_ids"] <= 128 for b in back)


@pytest.mark.parametrize("seed", range(3))
def test_rounds_of_best_fit_equal_one_piece_after_another(spark, seed):
    r = random.Random(seed)
    lengths = [r.choice([1, 2, 3, r.randrange(1, 257), r.randrange(1, 40), 200]) for _ in range(400)]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "row long, length long").repartition(5)
    got = packing.best_fit(pieces, 256, Workspace(spark)).join(pieces, "row").withColumnRenamed("place", "offset").collect()
    assert len(got) == len(lengths)
    check_packing(got, 256)


def test_sweep_is_best_fit():
    r = random.Random(9)
    for _ in range(50):
        lengths = [r.randrange(1, 65) for _ in range(r.randrange(1, 200))]
        _, opened = packing.sweep(list(Counter(lengths).items()), [], 64)
        assert opened == brute_sequences(lengths, 64)


def test_a_file_of_another_format_goes_through_the_tokenizer(tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        file = json.load(f)
    file["model"]["end_of_word_suffix"] = "</other>"
    assert packing.WordTokens._merges(file) is None


@pytest.mark.parametrize("name", ["op1_warc", "op11_vector_codes", "op12_hard_negatives"])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from panelspark.llm import queries

    small, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    got = queries.queries()[name](spark, small).select(*names).collect()
    assert got and Counter(map(tuple, got)) == Counter(cur.fetchall())
