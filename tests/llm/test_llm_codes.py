"""Suffix-tree scores, token alignment and vector codes against plain Python."""

import collections
import hashlib
import itertools
import math
import zlib

import numpy as np
import public_tokenizers as files
import pytest

from parley.llm import codebooks, spans
from parley.llm.suffixtree import Shape, suffix_tree_scores

SMALL = Shape(depth=3, least_context=4, least_symbol=2, gain=0.5)


def words_of(text):
    out, word = [], []
    for c in (text or "").translate({k: k + 32 for k in range(65, 91)}) + " ":
        if c in " \t\n\v\f\r":
            if word:
                out.append("".join(word))
            word = []
        else:
            word.append(c)
    return [*out, None]


def scores_by_hand(rows, shape, folds=5, fold=1):
    held = [zlib.crc32(str("" if i is None else i).encode()) % folds == fold for i, _ in rows]
    texts = [words_of(t) for _, t in rows]
    base = collections.Counter(w for h, t in zip(held, texts) if not h for w in t)
    n, v = sum(base.values()), len(base)
    grams = collections.Counter(tuple(t[i : i + k]) for h, t in zip(held, texts) if not h for k in range(1, shape.depth + 2) for i in range(len(t) - k + 1))
    after = collections.defaultdict(dict)
    for g, c in grams.items():
        if len(g) > 1:
            after[g[:-1]][g[-1]] = c
    kept = {}

    def p(context, w):
        """Of w after the longest kept suffix of the context."""
        for k in range(len(context), 0, -1):
            if context[-k:] in kept:
                own, types = kept[context[-k:]]
                c = after[context[-k:]].get(w, 0)
                return ((c if c >= shape.least_symbol else 0) + types * p(context[len(context) - k + 1 :], w)) / (own + types)
        return (base[w] + 0.5) / (n + 0.5 * (v + 1))

    for context in sorted(after, key=len):
        if grams[context] < shape.least_context:
            continue
        mine = {w: c for w, c in after[context].items() if c >= shape.least_symbol}
        total = sum(after[context].values())
        won = sum(c * math.log(c / total / p(context[1:], w)) for w, c in mine.items())
        if mine and won > shape.gain * len(mine):
            kept[context] = (sum(mine.values()), len(mine))
    out = []
    for (i, _), h, t in zip(rows, held, texts):
        lines = [p(tuple(t[max(0, k - shape.depth) : k]), w) for k, w in enumerate(t)]
        out.append((i, h, len(t), sum(base[w] > 0 for w in t), n, sum(math.log10((base[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), sum(map(math.log10, lines))))
    return out, kept


def same_scores(df, expected):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got = sorted((tuple(r) for r in df.collect()), key=key)
    expected = sorted(expected, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in expected], rtol=1e-9)


def test_suffix_tree_matches_plain_python(spark):
    rng = np.random.default_rng(3)
    follow = rng.integers(0, 12, (12, 12, 2))
    rows = []
    for i in range(160):
        a, b, text = 0, 1, []
        for _ in range(int(rng.integers(1, 60))):
            a, b = b, int(follow[a, b, rng.integers(2)]) if rng.random() < 0.8 else int(rng.integers(12))
            text.append(f"W{b}" if rng.random() < 0.5 else f"w{b}")
        rows.append((i, " ".join(text)))
    expected, kept = scores_by_hand(rows, SMALL)
    assert {len(k) for k in kept} == {1, 2, 3}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df = suffix_tree_scores(docs, SMALL, piece=500, bucket_keys=50)
    same_scores(df, expected)
    held = [(r[5], r[6]) for r in expected if r[1]]
    assert sum(s for _, s in held) > sum(b for b, _ in held)


def test_suffix_tree_with_hot_contexts(spark, monkeypatch):
    from parley.llm import suffixtree

    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"the {'abc'[int(k)]}" for k in rng.integers(0, 3, 12))) for i in range(60)]
    monkeypatch.setattr(suffixtree.Totals, "hot", property(lambda self: 100))
    same_scores(suffix_tree_scores(spark.createDataFrame(rows, "doc_id long, text string"), SMALL, piece=300), scores_by_hand(rows, SMALL)[0])


def test_suffix_tree_on_odd_rows(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    shape = Shape(depth=2, least_context=2, least_symbol=1, gain=0.0)
    same_scores(suffix_tree_scores(edge_docs, shape, piece=100), scores_by_hand(rows, shape)[0])
    assert suffix_tree_scores(no_docs).count() == 0


@pytest.fixture(scope="module")
def both():
    return spans.Aligner(files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model"))


def tokens_by_hand(both, text):
    full = (" " + text).encode()
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    da, db = [both.a_bytes[i] for i in a], [both.b_bytes[i] for i in b]
    if b"".join(da) != full or b"".join(db) != full:
        return None
    return a, b, list(itertools.accumulate(map(len, da))), list(itertools.accumulate(map(len, db)))


def alignment_by_hand(both, rows):
    coded = [tokens_by_hand(both, t) if t else None for _, t in rows]
    counts, out = collections.Counter(), []
    for c in coded:
        if c:
            a, b, ea, eb = c
            counts.update((a[ea.index(e)], b[eb.index(e)]) for e in set(ea) & set(eb))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    for (i, _), c in zip(rows, coded):
        if c is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, ea, eb = c
        common, x, y, groups, links = sorted(set(ea) & set(eb)), 0, 0, [], []
        for e in common:
            x2, y2 = ea.index(e) + 1, eb.index(e) + 1
            groups.append(",".join(map(str, a[x:x2])) + "|" + ",".join(map(str, b[y:y2])))
            links.append((a[x2 - 1], b[y2 - 1]))
            x, y = x2, y2
        n_best = sum(counts[p] == most[p[1]] for p in links)
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((i, len(a), len(b), len(groups), len(links), n_best, sum(counts[p] for p in links), sha))
    return out


ODD = [
    "Été naïve <|endoftext|> x </s> <0x41>", "a ▁b", "日本語 \U0001f600 x", "a\nb\n\nc \n d\n", "\n", "\n\n x", "  two  lead ", "tab\t x\t\ty !\x1c z\x85w \xa0q",
    " ", "  ", "\t", "é" * 5 + " \U0001f469‍\U0001f469 ", "don't  stop\r\n now", "\x00a\x00 b",
]


def test_chunks_encode_like_whole_texts(both):
    assert both.chunked
    rng = np.random.default_rng(5)
    letters = "ab \n\t\r!?é日\U0001f600\xa0　\x1c\x0b\x851's_▁᠎\x00"
    texts = ODD + ["".join(letters[int(k)] for k in rng.integers(0, len(letters), rng.integers(1, 14))) for _ in range(3000)]
    for text in texts:
        chunks = both.chunks(text)
        assert "".join(chunks) == " " + text
        parts = list(both.encode(chunks))
        whole = tokens_by_hand(both, text)
        assert (whole is None) == any(p is None for p in parts)
        if whole:
            groups = [g.split("|") for p in parts for g in p.groups.split(";")]
            assert [int(x) for g in groups for x in g[0].split(",")] == whole[0]
            assert [int(x) for g in groups for x in g[1].split(",")] == whole[1]


@pytest.mark.parametrize("piece", [300, 1 << 24])
def test_alignment_matches_plain_python(spark, both, edge_docs, piece):
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()] + [(100 + k, t) for k, t in enumerate(ODD)]
    schema = "doc_id long, text string, pair long, n long, best int, piece string"
    docs = spark.createDataFrame([(*r, 1, 2, 3, "p") for r in rows], schema)
    df = spans.align_tokens(docs, files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model"), piece=piece)
    got = df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[7])
    assert sorted(map(tuple, got), key=order) == sorted(alignment_by_hand(both, rows), key=order)


def test_alignment_on_given_documents(spark, both):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    df = spans.align_tokens(docs, files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model"), piece=50_000)
    got = df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(alignment_by_hand(both, rows))


def test_alignment_of_no_documents(spark, no_docs):
    assert spans.align_tokens(no_docs, files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model")).count() == 0


def codes_by_hand(rows, parts, entries, rounds):
    good = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    ints = [[math.floor(1024 * x) for x in v] for _, v, _ in good]
    w = len(ints[0]) // parts
    seeds = sorted(range(len(good)), key=lambda k: (good[k][0] is None, good[k][0] or 0))[:entries]
    books = [[ints[k][p * w : p * w + w] for k in seeds] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for step in range(rounds + 1):
        own = [[near(x[p * w : p * w + w], books[p]) for p in range(parts)] for x in ints]
        if step < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    mine = [x[p * w : p * w + w] for x, o in zip(ints, own) if o[p][1] == k]
                    if mine:
                        books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = collections.Counter()
    for (_, _, label), o in zip(good, own):
        errors[label] += sum(d for d, _ in o)
    return [(i, "".join(f"{k:02x}" for _, k in o), sum(d for d, _ in o), errors[label], digest) for (i, _, label), o in zip(good, own)]


def vector_rows(rng, n, dim, grid=None):
    """On a coarse grid many distances are equal."""
    out = []
    for i in range(n):
        v = rng.normal(size=dim) if grid is None else rng.integers(-2, 3, dim) / grid
        out.append((i * 3 % n if n % 3 else i, [float(np.float32(x)) for x in v], None if i % 7 == 0 else int(i % 3 == 0)))
    return out


def codes(df, **options):
    got = codebooks.encode_vectors(df, **options).drop("codes").collect()
    return sorted(map(tuple, got), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("grid", [None, 2, 1024])
@pytest.mark.parametrize("candidates", [1, 4])
def test_codes_match_plain_python(spark, grid, candidates):
    rows = vector_rows(np.random.default_rng(6), 301, 8, grid)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    expected = sorted(codes_by_hand(rows, 4, 20, 4), key=lambda r: r[0])
    assert codes(df, entries=20, candidates=candidates) == expected


def test_codes_of_odd_vectors(spark, monkeypatch):
    rows = vector_rows(np.random.default_rng(7), 20, 8)
    bad = [(90, None, 1), (91, [], 1), (92, [1.0] * 7 + [None], 1), (93, [float("nan")] * 8, 1), (94, [float("inf")] + [0.0] * 7, 1)]
    good = [*rows, rows[0], (None, [0.5] * 8, None), (95, [0.0] * 8, 5), (96, [-3.75] * 8, 5)]
    schema = SCHEMA + ", id long, ints string, code int"
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in good + bad + [(97, [1.0] * 4, 1)]], schema)
    expected = sorted(codes_by_hand(good, 4, 256, 4), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert codes(df) == expected
    monkeypatch.setattr(codebooks, "BROADCAST_ROWS", 0)  # as with too many labels to send to all tasks
    assert codes(df) == expected
    assert codes(df.limit(0)) == []
    with pytest.raises(Exception, match="a component is beyond"):
        codes(spark.createDataFrame([(1, [1e9] * 8, 1)], SCHEMA))


def test_bounds_save_searches_and_never_lose():
    rng = np.random.default_rng(8)
    rows = rng.integers(-1000, 1000, (2000, 16))
    old = rows[:64].copy()
    _, bounds = codebooks.full_search(rows, old, 8)
    bounds = codebooks.Bounds.unpack(bounds.pack())
    new = old + rng.integers(-15, 16, old.shape)
    moved = np.sqrt(((new - old) ** 2).sum(axis=1))
    searched = []
    real = codebooks.full_search
    codebooks.full_search = lambda r, e, b: (searched.append(len(r)), real(r, e, b))[1]
    try:
        best, after, needed = codebooks.bounded_search(rows, new, moved, bounds, 6)
    finally:
        codebooks.full_search = real
    exact = codebooks.squared(rows, new)
    assert (best == exact.min(axis=1)).all() and (after.near[:, 0] == exact.argmin(axis=1)).all()
    assert sum(searched) < len(rows) / 2 and 1 <= needed <= 8
    far = np.sqrt(np.take_along_axis(exact, after.near, axis=1))
    assert (after.low <= far + 1e-6).all()
    others = np.sqrt(np.where((np.arange(64) == after.near[:, :, None]).any(axis=1), np.iinfo(np.int64).max, exact)).min(axis=1)
    assert (after.outer <= others + 1e-6).all()
